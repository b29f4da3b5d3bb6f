"""Exact and near duplicate groups of catalogue rows.

Exact groups share an image hash, or, where both have none, a content hash; the two are separate namespaces. Near groups are
stars: in name order, a row that no earlier seed claims becomes a seed and claims later rows whose perceptual hash is near.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import model as m
from .hamming import near, near_pairs_of
from .search import matching
from .staging import written

THRESHOLD, CEILING, NESTED_LIMIT, BATCH, HOT = 12, 100_000, 20_000, 30_000, 1 / 1000
#: Rows of a chunk whose pairs a task finds; pairs that are put in order at once; tasks at most; rounds of the star cover, about, while a round's rows are fewer than MOST; rows and seeds that a
#: task compares at once.
CHUNK, PAIRS, MOST_TASKS, ROUNDS, MOST, LOT, WIDE = 100_000, 1_000_000, 65_536, 24, 200_000, 200_000, 50_000
PHASH = r"^[0-9a-fA-F]{16}$"


def exact_key() -> Column:
    """(namespace, hash), or null."""
    return F.when(F.col("image_hash").isNotNull(), F.struct(F.lit("i").alias("ns"), F.col("image_hash").alias("hash"))).when(F.col("content_hash").isNotNull(), F.struct(F.lit("c").alias("ns"), F.col("content_hash").alias("hash")))


def exact_candidates(rows: DataFrame) -> DataFrame:
    """rows whose key more than one row has, with the key. Counts are partial sums; rows come back by an equi-join."""
    keyed = rows.withColumn("key", exact_key()).filter("key is not null")
    many = keyed.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    return keyed.join(many, "key")


def exact_groups(rows: DataFrame) -> DataFrame:
    """(group_no, copy_no, file_no, id, path, ns, hash, kind, content_hash).

    Files of a group are in the order of (lower-cased name, path), groups in that of their first file, copies (files of one
    content hash, null being one) in that of first appearance. A group's kind is its first file's.
    """
    place = F.struct(F.lower("name").alias("n"), F.col("path").alias("p")).alias("place")
    # a few columns of the rows, so that these are made once; then what has twins, which is read four times below
    keyed = written(rows.select("id", "path", place, exact_key().alias("key"), "image_hash_kind", "content_hash").filter("key is not null"), "keys")
    many = keyed.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1").select("key")
    found = written(keyed.join(many, "key"), "exact")
    heads = found.groupBy("key").agg(F.min("place").alias("head"), F.min_by("image_hash_kind", "place").alias("kind"))
    numbered = group_numbers(heads, "head")
    copies = found.groupBy("key", "content_hash").agg(F.min("place").alias("copy_head"))
    copies = copies.withColumn("copy_no", F.dense_rank().over(Window.partitionBy("key").orderBy("copy_head")))
    named = found.join(numbered, "key").join(copies.select(F.col("key").alias("k"), F.col("content_hash").alias("ch"), "copy_no"), (F.col("key") == F.col("k")) & F.col("content_hash").eqNullSafe(F.col("ch")))
    file_no = F.row_number().over(Window.partitionBy("key").orderBy("place"))
    return named.select("group_no", "copy_no", file_no.alias("file_no"), "id", "path", F.col("key.ns").alias("ns"), F.col("key.hash").alias("hash"), "kind", "content_hash")


def group_numbers(heads: DataFrame, order: str, name: str = "group_no") -> DataFrame:
    """heads with consecutive numbers in an order: ranges are sorted side by side, and each adds the sizes of those before."""
    ranged = written(heads.repartitionByRange(order).sortWithinPartitions(order).withColumn("__part", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("__part").agg(F.count("*").alias("__size"))
    before = sizes.select(F.col("__part"), (F.sum("__size").over(Window.orderBy("__part")) - F.col("__size")).alias("__before"))  # a row for each range
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(order))
    return ranged.join(F.broadcast(before), "__part").withColumn(name, (inside + F.col("__before")).cast("long")).drop("__part", "__before")


def nested(groups: DataFrame) -> DataFrame:
    """One row per group: copies as an array of (content_hash, files)."""
    copies = groups.groupBy("group_no", "copy_no", "content_hash").agg(F.array_sort(F.collect_list(F.struct("file_no", "id", "path"))).alias("files"))
    return copies.groupBy("group_no").agg(F.array_sort(F.collect_list(F.struct("copy_no", "content_hash", "files"))).alias("copies"))


def half(c: Column, start: int) -> Column:
    return F.conv(F.substring(c, start, 8), 16, 10).cast("long")


def distance(a: str, b: str) -> Column:
    """Differing bits of two 64-bit hashes held as halves (x.hi, x.lo)."""
    return F.bit_count(F.col(f"{a}.hi").bitwiseXOR(F.col(f"{b}.hi"))) + F.bit_count(F.col(f"{a}.lo").bitwiseXOR(F.col(f"{b}.lo")))


def near_candidates(rows: DataFrame) -> DataFrame:
    """Rows with a readable perceptual hash: id, name order, halves and exact key."""
    good = rows.filter(F.coalesce(F.col("phash").rlike(PHASH), F.lit(False)))
    return good.select("id", "path", F.struct(F.lower("name").alias("n"), F.col("path").alias("p")).alias("place"), half(F.col("phash"), 1).alias("hi"), half(F.col("phash"), 9).alias("lo"), exact_key().alias("key"))


def value_pairs(values: DataFrame, threshold: int = THRESHOLD, nested_limit: int = NESTED_LIMIT) -> DataFrame:
    """Pairs (v, w, distance) of distinct hashes (hi, lo) within the threshold, v <= w; a value pairs with itself too.

    Up to nested_limit values, each is compared with all, the counted side being broadcast. Beyond, hashes meet under the masks of a
    code, which miss no pair. Both ways are exact.
    """
    values = values.select(F.struct("hi", "lo").alias("v")).distinct()
    if values.limit(nested_limit + 1).count() <= nested_limit:
        pairs = values.join(F.broadcast(values.select(F.col("v").alias("w"))), F.col("v") <= F.col("w"))
        return pairs.withColumn("distance", distance("v", "w")).filter(F.col("distance") <= threshold)
    values = written(values, "values")
    return near_pairs_of(values, values.count(), threshold).unionByName(values.select("v", F.col("v").alias("w"), F.lit(0).alias("distance")))


def numbered_rows(cand: DataFrame) -> DataFrame:
    """(rank, id, x, who) of near_candidates: the place in name order, the hash as one number, and a number that rows of one exact group share."""
    ranked = group_numbers(cand, "place", "rank")
    ranked = written(ranked.select("rank", "id", F.shiftleft("hi", 32).bitwiseOR(F.col("lo")).alias("x"), "key"), "ranked")
    many = written(ranked.filter("key is not null").groupBy("key").agg(F.count("*").alias("n"), F.min("rank").alias("who")).filter("n > 1"), "twins")
    # keys that many rows have, at most 1 / HOT of them, are sent to the rows; rows of other groups meet them by key
    often = F.col("n") > ranked.count() * HOT
    hot, few = F.broadcast(many.filter(often).select("key", "who")), many.filter(~often).select("key", "who")
    keyed = ranked.filter("key is not null")
    rest = keyed.join(hot.select("key"), "key", "left_anti").join(few, "key", "left")
    each = [keyed.join(hot, "key"), rest, ranked.filter("key is null").withColumn("who", F.lit(None).cast("long"))]
    rows = each[0].unionByName(each[1]).unionByName(each[2]).select("rank", "id", "x", F.coalesce("who", "rank").alias("who"))
    return written(rows, "rows")


def near_pairs(rows: DataFrame, threshold: int = THRESHOLD, chunk: int = CHUNK, lot: int = PAIRS) -> DataFrame:
    """(a, b, distance): ids of rows within the threshold, a before b in name order, not both in one exact group.

    Rows are cut into chunks in name order, each pair of which is a task's; pairs leave it as ids, lot by lot, and are never joined.
    Their number may grow with the square of the rows, and so do their making and their writing. So a file holds the pairs of two
    chunks, whose ids a column's dictionary has room for, and a lot is in the order of (distance, a), which are then runs of equal values.
    """
    rows = numbered_rows(written(near_candidates(rows), "near"))
    count = rows.count()
    chunks = max(1, -(-count // max(min(chunk, count // 16), 1000)))
    own = F.expr(f"int((rank - 1) * {chunks} div {max(1, count)})")
    packed = rows.groupBy(own.alias("own")).agg(F.sort_array(F.collect_list(F.struct("rank", "id", "x", "who"))).alias("rows"))
    packed = packed.select("own", *[F.col(f"rows.{c}").alias(c) for c in ("id", "x", "who")])
    cells = F.transform(F.sequence(F.lit(0), F.lit(chunks - 1)), lambda h: F.struct(F.least("own", h).alias("a"), F.greatest("own", h).alias("b")))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[tuple[int, int], list[np.ndarray]] = {}
        for b in batches:
            for k, (own, *cell) in enumerate(zip(*(b.column(c).to_pylist() for c in ("own", "ca", "cb")))):
                side = [b.column(c)[k].values.to_numpy() for c in ("id", "x", "who")]
                if cell[0] == cell[1]:
                    yield from found(side)
                elif (before := waiting.pop((*cell,), None)) is None:
                    waiting[(*cell,)] = side
                else:
                    yield from found(before, side) if own == cell[1] else found(side, before)

    def found(one: list[np.ndarray], other: list[np.ndarray] | None = None) -> Iterator[pa.RecordBatch]:
        """The pairs of two chunks, the earlier one first, or of one chunk."""
        (i, x, w), (j, y, v) = one, other or one
        x, y, held, n = x.view(np.uint64), y.view(np.uint64), [], 0

        def settled() -> pa.RecordBatch:
            far, place = np.divmod(np.sort(np.concatenate(held)), len(x) * len(y))
            at, to = np.divmod(place, len(y))
            return pa.RecordBatch.from_arrays([pa.array(i[at]), pa.array(j[to]), pa.array(far.astype(np.int32))], ["a", "b", "distance"])

        for at, to in near(x, y, threshold):
            fine = (w[at] != v[to]) & (i[at] != j[to])
            if other is None:
                fine &= at < to
            at, to = at[fine], to[fine]
            held.append((np.bitwise_count(x[at] ^ y[to]).astype(np.int64) * len(x) + at) * len(y) + to)
            n += len(at)
            if n > lot:
                yield settled()
                held, n = [], 0
        if n:
            yield settled()

    dealt = packed.withColumn("cell", F.explode(cells)).select("own", F.col("cell.a").alias("ca"), F.col("cell.b").alias("cb"), "id", "x", "who")
    dealt = dealt.repartitionById(min(MOST_TASKS, chunks * (chunks + 1) // 2), F.expr("int(cb * (cb + 1) / 2 + ca)"))
    return dealt.mapInArrow(compare, "a long, b long, distance int")


def unlike(x: np.ndarray, who: np.ndarray) -> np.ndarray:
    """Places of the first of each hash and exact group: a later seed with both claims nothing that the first doesn't."""
    return np.sort(np.unique(np.stack([x.view(np.int64), who]), axis=1, return_index=True)[1])


def seeds_of(x: np.ndarray, who: np.ndarray, threshold: int, lot: int = 8192) -> np.ndarray:
    """Places of the hashes, in name order, that no earlier seed of another exact group is near."""
    claimed, seeds = np.zeros(len(x), bool), np.zeros(0, np.int64)
    for lo in range(0, len(x), lot):
        some = seeds[unlike(x[seeds], who[seeds])]
        for at, to in near(x[lo : lo + lot], x[some], threshold):
            claimed[lo + at[who[lo + at] != who[some[to]]]] = True
        new, end = [], min(len(x), lo + lot)
        for i in range(lo, end):
            if not claimed[i]:
                new.append(i)
                claimed[i:end] |= (np.bitwise_count(x[i] ^ x[i:end]) <= threshold) & (who[i] != who[i:end])
        seeds = np.r_[seeds, np.array(new, np.int64)]
    return seeds


def claims_of(rank: np.ndarray, x: np.ndarray, who: np.ndarray, seeds: tuple[np.ndarray, np.ndarray, np.ndarray], threshold: int, width: int = WIDE) -> np.ndarray:
    """The rank of the first seed (rank, x, who; in order) before each row that is near it and of another exact group, or -1. Rows that one of
    the first `width` seeds claims aren't compared with the others."""
    out, left = np.full(len(x), -1, np.int64), np.arange(len(x))
    for lo in range(0, len(seeds[0]), width):
        r, y, w = (c[lo : lo + width] for c in seeds)
        first = np.full(len(left), len(r), np.int64)
        for at, to in near(x[left], y, threshold):
            fine = (w[to] != who[left[at]]) & (r[to] < rank[left[at]])
            np.minimum.at(first, at[fine], to[fine])
        hit = first < len(r)
        out[left[hit]] = r[first[hit]]
        left = left[~hit]
    return out


def lots(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches of about so many rows."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= size:
            yield pa.concat_batches(held)
            held, n = [], 0
    if held:
        yield pa.concat_batches(held)


def star_cover(cand: DataFrame, threshold: int = THRESHOLD, batch: int = BATCH) -> tuple[DataFrame, DataFrame]:
    """(rows, claims): rows of near_candidates with their rank in name order, and (rank, seed_rank, distance) of each row that an earlier
    seed reaches, the earliest such seed being its own.

    In name order, a row that no earlier seed claims is a seed and claims later rows near it, its own exact group left out. A round
    takes the first `batch` undecided rows, finds the seeds among them, sends these to all tasks and lets each undecided row look
    for the first one that claims it; so no pairs are made, and rows that are near one another, whether thousands of copies or
    of near copies, are gone once one of them is a seed. Rounds follow the number of seeds. A comparison is an exclusive or and a count of
    bits in numpy arrays; there are as many as rows times seeds at most.
    """
    spark = cand.sparkSession
    rows = numbered_rows(cand)
    batch = max(batch, min(rows.count() // ROUNDS, MOST))
    rest, claims = rows.select("rank", "x", "who"), None
    while (head := rest.orderBy("rank").limit(batch).toArrow()).num_rows:
        r, x, who = (head.column(c).to_numpy() for c in ("rank", "x", "who"))
        at = seeds_of(x.view(np.uint64), who, threshold)
        at = at[unlike(x[at], who[at])]
        sent = spark.sparkContext.broadcast((r[at], x[at].view(np.uint64), who[at]))

        def look(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in lots(batches, LOT):
                rank, x, who = (b.column(i).to_numpy() for i in range(3))
                seed = claims_of(rank, x.view(np.uint64), who, sent.value, threshold)
                own = np.searchsorted(sent.value[0], seed)
                far = np.bitwise_count(x.view(np.uint64) ^ sent.value[1][np.minimum(own, len(sent.value[0]) - 1)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(seed), pa.array(far)], ["rank", "x", "who", "seed_rank", "distance"])

        looked = written(rest.mapInArrow(look, "rank long, x long, who long, seed_rank long, distance int"), "looked")
        found = looked.filter("seed_rank >= 0").select("rank", "seed_rank", "distance")
        claims = found if claims is None else claims.unionByName(found)
        rest = looked.filter((F.col("seed_rank") < 0) & (F.col("rank") > int(r[-1]))).select("rank", "x", "who")
    return rows, spark.createDataFrame([], "rank long, seed_rank long, distance int") if claims is None else claims


def near_groups(rows: DataFrame, threshold: int = THRESHOLD, batch: int = BATCH) -> DataFrame:
    """(group_no, seed_id, match_no, match_id, distance): groups by seed in name order, matches by distance, then name order.

    Numbers within a group are places in one order of all matches, less the group's first; no group is ordered in one task.
    """
    ranked, claims = star_cover(written(near_candidates(rows), "near"), threshold, batch)
    numbered = group_numbers(claims.withColumn("at", F.struct("seed_rank", "distance", "rank")), "at", "nth")
    numbered = written(numbered.drop("at"), "matches")
    heads = group_numbers(numbered.groupBy("seed_rank").agg(F.min("nth").alias("least")), "seed_rank")
    ids = ranked.select("rank", "id")
    heads = heads.join(ids.withColumnsRenamed({"rank": "seed_rank", "id": "seed_id"}), "seed_rank")
    named = numbered.join(heads, "seed_rank").join(ids.withColumnRenamed("id", "match_id"), "rank")
    return named.select("group_no", "seed_id", (F.col("nth") - F.col("least") + 1).alias("match_no"), "match_id", "distance")


@dataclass
class Report:
    exact: DataFrame
    near: DataFrame | None
    near_skipped: int | None


def duplicate_report(files: DataFrame, query: m.SearchQuery, threshold: int = THRESHOLD, ceiling: int | None = CEILING) -> Report:
    """Both tiers over one snapshot of the rows that match. Over the ceiling the near tier is refused and counted; None lifts it."""
    rows = written(matching(files, query), "scope")
    count = rows.agg(near_tier(ceiling).alias("x")).first().x
    if count.refused:
        return Report(exact_groups(rows), None, count.with_phash)
    return Report(exact_groups(rows), near_groups(rows, threshold), None)


def near_tier(ceiling: int | None) -> Column:
    """(with_phash, refused): how many rows have a perceptual hash, malformed ones included, and whether they are too many."""
    n = F.count("phash")
    return F.struct(n.alias("with_phash"), (F.lit(False) if ceiling is None else n > ceiling).alias("refused"))


def duplicates_of(files: DataFrame, file_id: int) -> DataFrame:
    """Rows that share a file's exact key."""
    keyed = files.withColumn("key", exact_key())
    own = keyed.filter(F.col("id") == file_id).select("key")
    return keyed.filter(F.col("id") != file_id).join(own, "key", "left_semi").drop("key")
