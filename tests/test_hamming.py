"""Pairs of hashes within a distance: no pair is missed, none comes twice, and few unlike ones are compared."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import duplicates as dup, hamming
from tessera.sources import adapters as ad


def near_hashes(seed=1, centres=120, around=6, reach=15):
    rng, out = np.random.default_rng(seed), []
    for c in rng.integers(-(2**63), 2**63 - 1, centres, dtype=np.int64).view(np.uint64):
        out.append(int(c))
        for _ in range(around):
            out.append(int(c) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, reach + 1), replace=False)))
    return np.unique(np.array(out, np.uint64))


def all_pairs(x, threshold):
    return {(i, i + 1 + int(j)) for i in range(len(x)) for j in np.flatnonzero(np.bitwise_count(x[i] ^ x[i + 1 :]) <= threshold)}


@pytest.mark.parametrize("parts, threshold", [(1, 12), (2, 12), (4, 12), (1, 0), (1, 5), (2, 5), (2, 20), (4, 3)])
@pytest.mark.parametrize("slices", [1, 5])
def test_each_pair_once(parts, threshold, slices):
    x, got = near_hashes(reach=threshold + 4), []
    for k in range(slices):
        a, b = hamming.meet(x, None, parts, threshold, k, slices)
        got += zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist())
    assert len(got) == len(set(got)) and set(got) == all_pairs(x, threshold)


def test_every_small_difference_leaves_a_mask():
    rng = np.random.default_rng(2)
    for parts in (1, 2):
        masks = np.array([t[2] for t in hamming.tables(parts, 12)], np.uint64)
        assert len(masks) == {1: 8191, 2: 190}[parts] and min(int(x).bit_count() for x in masks) >= {1: 24, 2: 12}[parts]
        for _ in range(500):
            differ = np.uint64(sum(1 << int(b) for b in rng.choice(64, 12, replace=False)))
            meets = np.flatnonzero((masks & differ) == 0)
            assert len(meets)
            first = hamming.tables(parts, 12)[meets[0]]
            assert hamming.own_table(np.array([differ]), parts, 12)[0] == first[0] << 16 | first[1]


def compared(n, share=16):
    """How many pairs of n random hashes are compared, from a share of the tables where there are many."""
    x = np.unique(np.random.default_rng(n).integers(-(2**63), 2**63 - 1, n, dtype=np.int64).view(np.uint64))
    parts, seen = (2 if n <= hamming.TWO_PARTS else 1), [0]
    share = 1 if parts == 2 else share
    hamming.meet(x, None, parts, 12, 0, share, seen)
    return seen[0] * share


def test_comparisons_grow_slowly():
    assert compared(320_000, 64) <= compared(20_000) * 16**1.3


@pytest.mark.parametrize("group, two_parts", [(10**6, 10**6), (10**6, 0), (150, 10**6)])
def test_the_job_equals_all_pairs(spark, group, two_parts, monkeypatch):
    monkeypatch.setattr(hamming, "CHUNK", 40)
    x = near_hashes(centres=60)
    rows = spark.createDataFrame([(int(v) >> 32, int(v) & 0xFFFFFFFF) for v in x], "hi long, lo long").select(F.struct("hi", "lo").alias("v"))
    number = lambda s: s.hi << 32 | s.lo
    got = hamming.near_pairs_of(rows, len(x), 12, two_parts, group).collect()
    at = {int(v): i for i, v in enumerate(x)}
    assert sorted((at[number(r.v)], at[number(r.w)]) for r in got) == sorted(all_pairs(x, 12))
    assert all((number(r.v) ^ number(r.w)).bit_count() == r.distance for r in got)


def test_both_ways_of_pairing_agree(spark):
    x = near_hashes(centres=40)
    rows = spark.createDataFrame([(int(v) >> 32, int(v) & 0xFFFFFFFF) for v in [*x, *x[:5]]], "hi long, lo long")
    nested, masked = ({tuple(r) for r in dup.value_pairs(rows, 12, limit).collect()} for limit in (10**6, 0))
    assert nested == masked and len(nested) > len(x)
    assert dup.value_pairs(rows.limit(0), 12, 0).count() == 0


@pytest.mark.parametrize("threshold", [0, 1, 3, 12, 20])
def test_buckets_and_tiles_find_each_pair_once(threshold, monkeypatch):
    monkeypatch.setattr(hamming, "WIDTH", 7)
    monkeypatch.setattr(hamming, "TILE", 20)
    x = near_hashes(centres=60, reach=threshold + 4)
    got = [(int(a), int(b)) for i, j in hamming.near(x[::2], x[1::2], threshold) for a, b in zip(i, j)]
    assert len(got) == len(set(got)) and {tuple(sorted((2 * a, 2 * b + 1))) for a, b in got} == {(a, b) for a, b in all_pairs(x, threshold) if a % 2 != b % 2}
    assert not list(hamming.near(x[:0], x, threshold)) and not list(hamming.near(x, x[:0], threshold))


def test_random_hashes_are_compared_in_few_buckets():
    """One pair in ten shares a bucket, for every place that two hashes may differ in."""
    parts = hamming.buckets(12)
    assert sum(bits for _, bits, _ in parts) == 64 and sum(2 if len(o) > 1 else 1 for *_, o in parts) == 13
    assert sum(len(o) / 2**bits for _, bits, o in parts) <= 0.1


@pytest.mark.parametrize("chunk", [1, 10**6])
def test_near_pairs_leave_tasks_as_ids_and_are_all_pairs(spark, chunk, monkeypatch):
    """Pairs within and across chunks, in name order, with the highest bit differing too; rows of one exact group don't pair."""
    n, x = 1300, near_hashes(centres=200)
    x = np.concatenate([x, x[:40], x[:30] ^ np.uint64(1 << 63)])[:n]
    rows = [(i, f"/{(7919 * i) % 10007:05d}", f"{int(v):016x}", "k" if i % 9 == 0 else None) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, path string, phash string, content_hash string").withColumn("name", F.col("path")).withColumn("image_hash", F.lit(None).cast("string"))
    got = dup.near_pairs(df, chunk=chunk)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    want = {(*sorted((i, j), key=lambda k: rows[k][1]), (int(x[i]) ^ int(x[j])).bit_count()) for i, j in all_pairs(x, 12) if not (i % 9 == 0 and j % 9 == 0)}
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(want) and set(found) == want
    assert "Join" not in plan  # before, pairs of hashes were joined with rows twice, which moved every pair


def test_a_file_of_near_pairs_has_two_chunks_and_runs_of_equal_values(spark):
    """Before, a file had the pairs of any chunks as they were found, three bytes a pair on larger tables."""
    x = near_hashes(centres=200)
    rows = [(i, f"/{(7919 * i) % 10007:05d}", f"{int(v):016x}") for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, path string, phash string").withColumn("name", F.col("path")).withColumns({c: F.lit(None).cast("string") for c in ("image_hash", "content_hash")})
    place = {i: n for n, (i, *_) in enumerate(sorted(rows, key=lambda r: r[1]))}
    parts = {}
    for part, a, b, d in dup.near_pairs(df, chunk=1).select(F.spark_partition_id(), "a", "b", "distance").collect():
        parts.setdefault(part, []).append((d, place[a], place[b]))
    chunks = -(-len(x) // 1000)
    for found in parts.values():
        assert found == sorted(found) and len({(a * chunks // len(x), b * chunks // len(x)) for _, a, b in found}) == 1
    assert len(parts) == chunks * (chunks + 1) // 2 > 1


def test_hashes_of_words_are_made_without_moving_texts(spark):
    docs = spark.createDataFrame([(1, "b a  A\tc"), (1, "d"), (2, ""), (3, "x"), (4, None), (5, "y"), (6, "é Ü"), (None, "z")], "i long, text string")
    got = {r.i: r.phash for r in ad.word_phash(docs).collect()}
    for i, words in ((1, "a b c d"), (6, "é ü")):
        low = {}
        for m in (hashlib.md5(w.encode()).hexdigest() for w in words.split()):
            bucket = int(m[:2], 16) % 64
            low[bucket] = min(low.get(bucket, 1 << 32), int(m[2:10], 16))
        assert got[i] == f"{sum(v % 2 << b for b, v in low.items()):016x}"
    assert got[5] == "not-a-hash" and got[3] is None and got.get(2) is None and got.get(4) is None
    assert "Generate" not in ad.word_phash(docs)._jdf.queryExecution().optimizedPlan().toString()  # before, a row for each word


def test_rounds_take_a_share_of_many_rows(spark, monkeypatch):
    x = np.random.default_rng(8).integers(0, 2**63, 600)
    df = spark.createDataFrame([(i, f"/{i:04d}", int(v) >> 32, int(v) & 0xFFFFFFFF) for i, v in enumerate(x)], "id long, path string, hi long, lo long")
    cand = df.select("id", "path", F.struct(F.col("path").alias("n"), F.col("path").alias("p")).alias("place"), "hi", "lo", F.lit(None).cast("struct<ns:string,hash:string>").alias("key"))
    rounds, find = [], dup.seeds_of
    monkeypatch.setattr(dup, "seeds_of", lambda *a: rounds.append(len(a[0])) or find(*a))
    dup.star_cover(cand, batch=4)
    assert rounds[0] == 600 // dup.ROUNDS and len(rounds) <= dup.ROUNDS + 1


def test_seeds_of_one_hash_and_group_are_compared_once(monkeypatch):
    """Copies in one exact group don't claim one another, so all are seeds; before, each was compared with each."""
    x, who, sizes = np.full(900, 5, np.uint64), np.zeros(900, np.int64), []
    real = dup.near
    monkeypatch.setattr(dup, "near", lambda a, b, t: sizes.append(len(b)) or real(a, b, t))
    assert dup.seeds_of(x, who, 12, lot=100).tolist() == list(range(900)) and max(sizes) == 1
    x, who = np.array([5, 9, 5, 9, 5], np.uint64), np.array([1, 1, 1, 2, 1])
    assert dup.unlike(x, who).tolist() == [0, 1, 3]
