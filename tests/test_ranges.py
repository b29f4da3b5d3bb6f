"""Places as ranges of paths, and pages deep in an order."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import index as idx, model as m, search as s

NAMES = ["a", "a-b", "a b", "A", "b", "ä", "a.", "0"]


@pytest.fixture(scope="module")
def paths(spark):
    rng = random.Random(4)
    out = {"/" + "/".join(rng.choice(NAMES) for _ in range(rng.randint(1, 5))) for _ in range(400)} | {"/"}
    return sorted(out)


@pytest.mark.parametrize("few", [100, 0])
@pytest.mark.parametrize("places", [[], ["/a"], ["/a/", "/a-b", "/a/b/b"], ["/"], ["/a/a/a", "/b/a b", "/b/a b/ä", "/nowhere", "/a-b/a-b", "/0/0/0/0/0/0"], ["/a/b", "/a/b", "/A"]])
def test_rows_at_or_under_places(spark, paths, places, few):
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(paths)] + [(-1, paths[7])], "id long, path string").repartition(5)
    got = idx.at_or_under(rows, spark.createDataFrame([(p,) for p in places], "path string"), few)
    clean = [p.rstrip("/") for p in places]
    assert got.columns == rows.columns
    assert sorted(r.path for r in got.collect()) == sorted(p for p in [*paths, paths[7]] if any(p == c or p.startswith(c + "/") or c == "" for c in clean))


def test_many_places_reach_over_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rng = random.Random(5)
    paths = [f"/p{i % 40}/{'x' if i % 3 else 'y'}/f{i}" for i in range(2000)]
    places = ["/p1", "/p2/x", "/p30/y", "/p39"] + [f"/p5/x/f{i}" for i in range(0, 2000, 7)]
    rng.shuffle(paths)
    rows = spark.createDataFrame([(p,) for p in paths], "path string")
    got = idx.at_or_under(rows, spark.createDataFrame([(p,) for p in places], "path string"), 0)
    assert sorted(r.path for r in got.collect()) == sorted(p for p in paths if any(p == c or p.startswith(c + "/") for c in places))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_protected_rows_do_not_move(spark):
    import __spark_entry__ as entry

    plan = entry.queries()["protected_rows"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and "rangepartitioning" not in plan


@pytest.mark.parametrize("offset, limit", [(0, 7), (3, 5), (100, 50), (100, None), (299, None), (290, 50), (300, None), (400, 5), (150, 0)])
@pytest.mark.parametrize("shallow", [10_000, 0])
def test_pages_equal_slices(spark, offset, limit, shallow, monkeypatch):
    monkeypatch.setattr(s, "SHALLOW", shallow)
    rng = random.Random(6)
    rows = [(i, f"/x/{i}", rng.choice([None, 1, 2, 3, 50])) for i in range(300)]
    files = idx.migrated(spark.createDataFrame(rows, "id long, path string, width int")).repartition(7)
    for up in (True, False):
        got = [r.id for r in s.search(files, m.SearchQuery(sort=m.Sort("width", up), limit=limit, offset=offset), ["id"]).collect()]
        want = [i for i, _, w in sorted(rows, key=lambda r: (r[2] is None, (r[2] or 0) * (1 if up else -1), r[0]))]
        assert got == want[offset:][: limit if limit is not None else None]


def test_only_the_ranges_of_a_page_are_read(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    files = idx.migrated(spark.range(4000).select("id", (F.col("id") % 1000).cast("int").alias("width")))
    page = s.placed(files, m.Sort("width"), 1000, 1010)
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "__part" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert sorted(r.place for r in page.collect()) == list(range(1001, 1011))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("budget", [0, 1, 37, 500, 10**9])
@pytest.mark.parametrize("moments", [1, 3, 10**6])
def test_evictions_equal_a_loop(spark, budget, moments):
    from tessera.sources.walk import evictions

    rng = random.Random(budget + moments)
    cache = [(f"k{i:03d}", rng.choice([0, 1, 5, 9]), float(rng.randrange(moments))) for i in range(150)]
    held, want = 0, set()
    for n, (key, size, _) in enumerate(sorted(cache, key=lambda x: (-x[2], x[0]))):
        held += size
        if held > budget and n:
            want.add(key)
    got = evictions(spark.createDataFrame(cache, "key string, size long, modified double").repartition(6), budget).collect()
    assert {r.key for r in got} == want and len(got) == len(want)
