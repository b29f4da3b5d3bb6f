"""The nearest vectors from lists with bounds, against a full scan."""

import numpy as np
import pytest

from tessera.operators import vectors as vec


def full_scan(queries, rows, k):
    good = {i: np.array(x, float) for i, x in rows if x is not None and len(x) == 8 and all(v is not None and np.isfinite(v) for v in x)}
    out = []
    for i in queries:
        if i in good:
            near = sorted((-round(float(good[i] @ x), 9), j) for j, x in good.items() if j != i)[:k]
            out += [(i, j, place + 1) for place, (_, j) in enumerate(near)]
    return sorted(out)


def made(kind, n=300):
    rng = np.random.default_rng(3)
    if kind == "apart":
        x = rng.normal(size=(n, 8))
    elif kind == "crowded":
        x = rng.normal(size=(6, 8))[rng.integers(0, 6, n)] * rng.choice([0.5, 1, 3], (n, 1)) + 0.01 * rng.normal(size=(n, 8))
    else:  # many copies, and vectors of length nought
        x = np.round(rng.normal(size=(5, 8)), 2)[rng.integers(0, 5, n)]
        x[::17] = 0
    return [(i, [float(v) for v in row]) for i, row in enumerate(x)]


@pytest.mark.parametrize("kind", ["apart", "crowded", "copies"])
@pytest.mark.parametrize("pivots, block, first, lot", [(1024, 2048, 4, 20_000), (30, 10, 1, 20_000), (7, 25, 2, 5), (1, 40, 3, 20_000)])
def test_top_k_equals_a_full_scan(spark, kind, pivots, block, first, lot, monkeypatch):
    monkeypatch.setattr(vec, "LOT", lot)
    rows = made(kind)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = vec.top_k(df.filter("vec_id % 20 = 0"), df, 5, first=first, pivots=pivots, block=block).collect()
    assert sorted((r.query, r.id, r.place) for r in got) == full_scan(range(0, 300, 20), rows, 5)


def test_odd_vectors_have_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = made("apart", 40) + [(100, None), (101, []), (102, [1.0] * 7), (103, [nan] * 8), (104, [1.0] * 7 + [inf]), (105, [1.0] * 7 + [None])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = vec.top_k(df, df, 3).collect()
    assert sorted((r.query, r.id, r.place) for r in got) == full_scan([i for i, _ in rows], rows, 3)
    assert vec.top_k(df.limit(0), df, 3).count() == vec.top_k(df, df.limit(0), 3).count() == 0
    few = spark.createDataFrame(rows[:2], df.schema)
    assert sorted((r.query, r.id, r.place) for r in vec.top_k(few, few, 5).collect()) == [(0, 1, 1), (1, 0, 1)]


def test_crowded_vectors_are_read_in_part_and_without_a_nested_loop(spark):
    df = spark.createDataFrame(made("crowded"), "vec_id long, embedding array<double>")
    seen: list = []
    out = vec.top_k(df.filter("vec_id % 20 = 0"), df, 5, first=1, pivots=30, block=10, seen=seen)
    assert seen[2] < 0.6 * seen[0] * seen[1]
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
