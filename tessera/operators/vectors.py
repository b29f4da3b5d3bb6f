"""The nearest vectors by inner product, exactly, from inverted lists with bounds.

Vectors are listed by their nearest pivot; a list is cut into blocks of bounded size. No vector of a block has a larger inner
product with q than q.c + |q| r, c being the pivot and r the largest distance of the block's vectors from it. A query reads the blocks
with the largest bounds first; its k-th best value then says which further blocks could still hold a better one, and only these are
read. What is left unread can't matter, so the answer is that of a full scan, whatever pivots were drawn; these decide how
much is read. Where vectors are unlike one another in all directions, r is about their length and most blocks are read.

Pivots (a bounded number) and the bounds of blocks (a bounded number: blocks grow with the table) go to all tasks. Queries move once for
each block that they read, blocks once for each lot of queries that reads them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .staging import written

#: At most so many pivots; vectors in a block at least, and blocks at most; blocks that a query reads first; queries in a lot.
PIVOTS, BLOCK, BLOCKS, FIRST, LOT = 1024, 2048, 20_000, 4, 20_000
#: Values are compared as rounded to DIGITS; what could round to the same counts as no worse.
DIGITS, SLACK = 9, 2e-9


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of an array column as one matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dims)


def usable(df: DataFrame, id_col: str, vector_col: str, dims: int) -> DataFrame:
    """(id, x): vectors of the right length without null or non-finite components."""
    x = F.col(vector_col).cast("array<double>")
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return df.select(F.col(id_col).cast("long").alias("id"), x.alias("x")).filter((F.size("x") == dims) & ~bad)


class Lists:
    """Vectors (id, x) in blocks round pivots: blocks has (block, id, x); centres, radii and numbers say what each block holds."""

    def __init__(self, vectors: DataFrame, dims: int, pivots: int = PIVOTS, block: int = BLOCK):
        self.dims, spark = dims, vectors.sparkSession
        n = vectors.count()
        block = max(block, math.ceil(n / BLOCKS))
        drawn = vectors.orderBy(F.xxhash64("id"), "id").limit(max(1, min(pivots, math.ceil(n / block)))).select("x").collect()
        centres = np.array([r.x for r in drawn], np.float64).reshape(-1, dims)
        sent = spark.sparkContext.broadcast((centres, (centres**2).sum(axis=1)))

        def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c, sizes = sent.value
            for b in batches:
                x = matrix(b.column(1), dims)
                at = (sizes[None, :] - 2 * (x @ c.T)).argmin(axis=1) if len(x) else np.zeros(0, np.int64)
                far = np.sqrt(((x - c[at]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at), pa.array(far)], ["id", "x", "list", "far"])

        placed = written(vectors.mapInArrow(listed, "id long, x array<double>, list long, far double"), "lists")
        sizes = placed.groupBy("list").agg(F.ceil(F.count("*") / block).cast("long").alias("cuts"))  # a row for each pivot
        cut = placed.join(F.broadcast(sizes), "list").withColumn("cut", F.pmod(F.xxhash64("id"), F.col("cuts")))
        stats = sorted(tuple(r) for r in cut.groupBy("list", "cut").agg(F.max("far")).collect())  # a row for each block
        self.centres = centres[[s[0] for s in stats]].reshape(-1, dims)
        self.radii = np.array([s[2] for s in stats], np.float64)
        names = spark.createDataFrame([(s[0], s[1], i) for i, s in enumerate(stats)], "list long, cut long, block long")
        self.blocks = cut.join(F.broadcast(names), ["list", "cut"]).select("block", "id", "x")


def best(ids: np.ndarray, values: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest values as rounded, smaller ids first among equals."""
    values = np.round(values, DIGITS)
    at = np.arange(len(values)) if len(values) <= k else np.flatnonzero(values >= np.partition(values, len(values) - k)[len(values) - k])
    return at[np.lexsort((ids[at], -values[at]))][:k]


def read_blocks(visits: DataFrame, lists: Lists, k: int, lots: int) -> DataFrame:
    """(query, id, value): the best k of each visited block. visits: block, query, q."""
    dims = lists.dims
    wanted = visits.withColumn("lot", F.pmod(F.xxhash64("query"), F.lit(lots)))
    sent = lists.blocks.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lots - 1).cast("long")))) if lots > 1 else lists.blocks.withColumn("lot", F.lit(0).cast("long"))

    def compare(own: pa.Table, block: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if own.num_rows and block.num_rows:
            q, x = matrix(own["q"], dims), matrix(block["x"], dims)
            queries, ids = own["query"].to_numpy(), block["id"].to_numpy()
            for lo in range(0, len(q), 512):
                values = q[lo : lo + 512] @ x.T
                values[queries[lo : lo + 512, None] == ids[None, :]] = -np.inf
                for i, row in enumerate(values):
                    at = best(ids, row, k)
                    at = at[row[at] > -np.inf]
                    out.append((np.full(len(at), queries[lo + i]), ids[at], row[at]))
        cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"query": pa.array(cols[0]), "id": pa.array(cols[1]), "value": pa.array(cols[2], pa.float64())})

    return wanted.groupBy("block", "lot").cogroup(sent.groupBy("block", "lot")).applyInArrow(compare, "query long, id long, value double")


def top_k(queries: DataFrame, vectors: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", first: int = FIRST, pivots: int = PIVOTS, block: int = BLOCK, seen: list | None = None) -> DataFrame:
    """(query, id, place, value): for each query the k other vectors of largest inner product, rounded to DIGITS, smaller ids first among
    equals. Vectors that are null, of another length than the first one, or hold null or non-finite components have no part in it.
    Ids are unique integers. seen: gets the number of blocks, of queries and of (query, block) pairs read."""
    empty = vectors.sparkSession.createDataFrame([], "query long, id long, place long, value double")
    one = vectors.filter(F.size(vector_col) > 0).select(F.size(vector_col).alias("n")).first()
    if one is None:
        return empty
    table, asked = (written(usable(df, id_col, vector_col, one.n), "vectors") for df in (vectors, queries))
    if table.isEmpty() or (count := asked.count()) == 0:
        return empty
    lists = Lists(table, one.n, pivots, block)
    sent = table.sparkSession.sparkContext.broadcast((lists.centres, lists.radii))
    lots, dims = math.ceil(count / LOT), one.n

    def choose(late: bool):
        def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c, r = sent.value
            for b in batches:
                q = matrix(b.column(1), dims)
                bounds = q @ c.T + np.sqrt((q**2).sum(axis=1))[:, None] * r[None, :]
                early = np.zeros(bounds.shape, bool)
                np.put_along_axis(early, np.argsort(-bounds, axis=1, kind="stable")[:, :first], True, axis=1)
                which = ~early & (bounds + SLACK + 1e-12 * np.abs(bounds) >= b.column(2).to_numpy(zero_copy_only=False)[:, None]) if late else early
                row, at = np.nonzero(which)
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row))], ["block", "query", "q"])

        return visits

    schema = "block long, query long, q array<double>"
    own = asked.select(F.col("id").alias("query"), F.col("x").alias("q"))
    early = written(read_blocks(own.withColumn("safe", F.lit(0.0)).mapInArrow(choose(False), schema), lists, k, lots), "early")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.round("value", DIGITS).desc(), "id"))
    kth = early.withColumn("place", rank).filter(F.col("place") == k).select("query", F.col("value").alias("safe"))
    further = own.join(kth, "query", "left").select("query", "q", F.coalesce("safe", F.lit(float("-inf"))).alias("safe")).mapInArrow(choose(True), schema)
    if seen is not None:
        seen += [len(lists.radii), count, count * min(first, len(lists.radii)) + further.count()]
    found = early.unionByName(read_blocks(further, lists, k, lots))
    return found.withColumn("place", rank).filter(F.col("place") <= k).select("query", "id", F.col("place").cast("long").alias("place"), F.round("value", DIGITS).alias("value"))
