"""Query semantics on a few rows, and what must fail."""

import pytest

import __spark_entry__ as entry
from pyspark.sql import functions as F

from tessera.functions.text import search_terms
from tessera.operators import facets as fct, index as idx, model as m, search as s

# path, width, height, size, capture time, make, extension, content hash, image hash
ROWS = [
    ("/archive/2021/harbour fog.tif", 6016, 4016, 31_000_000, 1612345678.0, "Pentax", "tif", "k1", None),
    ("/archive/2021/scan_007.png", 640, 640, 52_000, None, None, "png", None, None),
    ("/archive/2021/raw/harbour-dawn.dng", 2400, 1350, 8_400_000, 1587654321.0, "leica", "dng", None, None),
    ("/archive/2021/raw/twin one.webp", 320, 300, 7_000, None, None, "webp", "k2", "m7"),
    ("/archive/2021/raw/twin two.webp", 320, 300, 9_000, None, None, "webp", "k3", "m7"),
    ("/inbox/poster.jpg", 640, 640, 52_000, None, "", "jpg", None, None),
    ("/inbox/copy of fog.tif", None, None, 31_000_000, 1612345678.0, "PENTAX", "tif", "k1", None),
]
FOG, SCAN, DAWN, ONE, TWO, POSTER, COPY = (r[0].rsplit("/", 1)[1] for r in ROWS)


def table(spark, rows):
    kinds = dict(x.split() for x in idx.FILES.split(", "))
    made = spark.createDataFrame([(i + 1, *r) for i, r in enumerate(rows)], "id long, path string, width int, height int, size long, capture_time double, camera_make string, ext string, content_hash string, image_hash string")
    made = made.withColumns({"parent_dir": F.regexp_replace("path", "/[^/]*$", ""), "name": F.substring_index("path", "/", -1), "mtime": F.lit(1.7e9), "device": F.lit(1).cast("long"), "inode": F.lit(1).cast("long"), "indexed_at": F.lit(1.0)})
    return made.withColumns({c: F.lit(None).cast(k) for c, k in kinds.items() if c not in made.columns}).select(*idx.COLUMNS)


@pytest.fixture(scope="module")
def seed(spark):
    return table(spark, ROWS).cache()


def names(files, predicate=None, scope=None):
    q = m.SearchQuery(scope or m.Everywhere(), predicate or m.All())
    return sorted(r.name for r in s.matching(files, q).collect())


CASES = [
    (m.ExactDimensions(640, 640), [SCAN, POSTER]),
    (m.Width(m.AtLeast(2400)), [FOG, DAWN]),
    (m.Height(m.AtMost(300)), [ONE, TWO]),
    (m.FileSize(m.Between(60e3, 7e3)), [SCAN, ONE, TWO, POSTER]),
    (m.Megapixels(m.AtLeast(3.2)), [FOG, DAWN]),
    (m.Megapixels(m.Between(0.4, 0.41)), [SCAN, POSTER]),
    (m.AspectRatio(m.Between(1.77, 1.78)), [DAWN]),
    (m.AspectRatio(m.Between(0.99, 1.0)), [SCAN, POSTER]),
    (m.CameraMake("pentax"), [FOG, COPY]),
    (m.CaptureDate(1600000000.0, 1700000000.0), [FOG, COPY]),
    (m.FilenameText("harb"), [FOG, DAWN]),
    (m.FilenameText("fog harbour"), [FOG]),
    (m.FilenameText("fog poster"), []),
    (m.FilenameText('" OR 1=1'), []),
    (m.FilenameText("%%"), []),
    (m.HasDuplicates(), [FOG, ONE, TWO, COPY]),
    (m.Or((m.CameraMake("LEICA"), m.FileExtension(("png", "jpg")))), [SCAN, DAWN, POSTER]),
    (m.And((m.HasDuplicates(), m.Not(m.FileExtension(("tif",))))), [ONE, TWO]),
    (m.Or(), []),
    (m.FileExtension(()), []),
    (m.Not(m.CameraMake("Pentax")), [SCAN, DAWN, ONE, TWO, POSTER]),
    (m.Not(m.Width(m.AtLeast(1))), [COPY]),
]


@pytest.mark.parametrize(("predicate", "want"), CASES)
def test_predicates(seed, predicate, want):
    assert names(seed, predicate) == sorted(want)


def test_nothing_asked_means_everything(seed):
    assert names(seed, m.And()) == names(seed, m.FilenameText("\t ")) == sorted(r[0].rsplit("/", 1)[1] for r in ROWS)


def test_scopes(seed):
    assert names(seed, scope=m.Folder("/archive/2021", False)) == sorted([FOG, SCAN])
    assert names(seed, scope=m.Folder("/archive/2021/raw/")) == names(seed, scope=m.Folder("/archive/2021/raw")) == sorted([DAWN, ONE, TWO])
    assert len(names(seed, scope=m.Folder("/archive"))) == 5 and len(names(seed, scope=m.Folder("/"))) == len(ROWS)
    assert names(seed, scope=m.Folder("/arch")) == names(seed, scope=m.Folder("/ARCHIVE")) == []


def test_a_twin_outside_the_scope_counts(seed):
    assert names(seed, m.HasDuplicates(), m.Folder("/inbox")) == [COPY]


@pytest.mark.parametrize("path", ["", "archive", "../archive"])
def test_invalid_scopes(seed, path):
    with pytest.raises(m.InvalidScope):
        s.matching(seed, m.SearchQuery(m.Folder(path)))


def test_depth(seed):
    def nest(n):
        p = m.CameraMake("Leica")
        for _ in range(n):
            p = m.Not(p)
        return p

    assert names(seed, nest(40)) == [DAWN]
    with pytest.raises(m.PredicateTooDeep):
        s.matching(seed, m.SearchQuery(predicate=nest(300)))


def test_sorts_and_pages(seed):
    page = lambda **k: [r.name for r in s.search(seed, m.SearchQuery(**k)).collect()]
    by_size = [FOG, COPY, DAWN, SCAN, POSTER, TWO, ONE]  # ties by id
    assert page(sort=m.Sort("size", False), limit=3) == by_size[:3]
    assert page(sort=m.Sort("size", False), limit=3, offset=3) == by_size[3:6]
    assert len(page(offset=5)) == 2
    assert page(sort=m.Sort("captureDate"))[:3] == [DAWN, FOG, COPY]
    assert page(sort=m.Sort("captureDate", False))[:3] == [FOG, COPY, DAWN]
    assert page(sort=m.Sort("height"))[-1] == page(sort=m.Sort("height", False))[-1] == COPY
    ties = page(sort=m.Sort("height"))
    assert [x for i in range(0, 8, 2) for x in page(sort=m.Sort("height"), limit=2, offset=i)] == ties


def test_json_round_trip():
    q = m.SearchQuery(m.Folder("/a", False), m.And(tuple(c for c, _ in CASES)), m.Sort("width", False), 3, 4)
    assert m.from_json(m.to_json(q)) == q


@pytest.mark.parametrize(("text", "terms"), [("fog at dawn", ["fog", "at", "dawn"]), ("", None), ("\t", None), ("?!", []), ("(((", []), ("~ ~", []), ("🌫", []), ("Müller 07", ["Müller", "07"]), ("港", ["港"])])
def test_search_terms(text, terms):
    assert search_terms(text) == terms


def test_facets(spark):
    rows = [(f"/x/{i}.{e}", 5, 5, 1, None, k, e, None, None) for i, (e, k) in enumerate([("gif", "Ricoh"), ("psd", None), ("gif", "Ricoh"), ("orf", ""), ("gif", "Sigma")])]
    got = {(r.facet, r.bucket): r.n for r in fct.facets(table(spark, rows), m.SearchQuery(limit=2, offset=1)).collect()}
    assert got == {("total", None): 5, ("ext", "gif"): 3, ("ext", "psd"): 1, ("ext", "orf"): 1, ("camera_make", "Ricoh"): 2, ("camera_make", "Sigma"): 1}
    one = fct.facet_maps(fct.facets(table(spark, rows), m.SearchQuery())).first()
    assert one.total == 5 and one.by_extension["gif"] == 3 and one.by_camera == {"Ricoh": 2, "Sigma": 1}


def test_scope_and_columns_reach_the_scan(spark, seed, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    path = idx.write_generation(seed, str(tmp_path), 1)
    index = spark.read.schema(idx.FILES).parquet(path)
    plan = s.search(index, m.SearchQuery(m.Folder("/archive"), m.Width(m.AtLeast(1920)), limit=5), ["id", "path"])._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(path,/archive/)" in plan and "LessThan(path,/archive0)" in plan and "GreaterThanOrEqual" in plan
    assert "TakeOrderedAndProject" in plan and "camera_make" not in plan.split("ReadSchema")[1]
    facets = fct.facets(index, m.SearchQuery())._jdf.queryExecution().executedPlan().toString()
    assert facets.count("FileScan") == 1


def test_registered_searches_push_scopes_to_the_index(spark):
    plan = entry.queries()["scope_recursive"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters")[1].split("ReadSchema")[0]
    assert "GreaterThan(path," in pushed and "LessThan(path," in pushed
