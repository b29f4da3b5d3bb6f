"""Embedding near-duplicates by dual traversal of cover trees: exact threshold pairs under cosine.

Vectors are normalised in double precision; on the unit sphere cosine >= t is chord distance <= sqrt(2 - 2t), a metric, so
cover trees apply. Equal vectors form one class with a weight. Spark deals the classes into regions (the nearest of as many
pivots as there are regions, in number bounded by PIVOT_VALUES), regions into parts of bounded size (by hash, so that a crowded
region is split), and each part becomes a tree: nested levels of centres with halving radii, each point under a centre within
the level's radius, each node with its true covering radius. The parts of a region form groups of bounded size; a task compares
two groups. For each pair of parts, node pairs are compared from the top: a pair of nodes whose centres are further apart than the
threshold and both covering radii has no link and is pruned; one whose centres are so near that all points must link is
counted whole; the rest is expanded, at last by exact dot products. Pairs of groups whose balls are too far apart are pruned
before any data moves.

Results gathered: links counted per class and a spanning set of links, never all pairs of a crowded group.

Defined results. Vectors that are null, empty, zero or hold null or non-finite components link with nothing; each is its own
component. Vectors of different lengths don't link. Repeated rows and equal vectors are linked like any others. Null ids:
such rows count as linked vectors, their component is the smallest id that isn't null. Other columns are ignored.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .common import bounded_broadcast, staged, table
from .components import connected_components

COSINE, PART, GROUP, MAX_TOPS, MAX_PAIRS = 0.9, 4096, 8, 20_000, 500_000
PART_VALUES, PIVOT_VALUES = 1_000_000, 1_000_000
TOP_RADIUS, LEVELS = 1.0, 4
#: Rows and columns of dot products at a time: they stay in a core's cache.
BLOCK = (256, 2048)
FEW = 16
#: Distances nearer to a bound than this are never decided by it.
SLACK = 1e-6


class Tree:
    """A cover tree over the rows of x.

    levels[i] is (rows, cover, first, count, members): the centres' rows, the true radius over all that lies under each, where
    a centre's children start in the next level and how many it has, and the rows under each centre. Centres are nested, the
    radius that makes them halves from level to level, and the last level has every row.
    """

    def __init__(self, x: np.ndarray):
        self.x, self.x32 = x, x.astype(np.float32)
        n, radius, centres = len(x), TOP_RADIUS, np.zeros(0, np.int64)
        rows, parents = [], []
        for _ in range(LEVELS):
            centres, owner = self._cover(centres, radius)
            rows.append(centres)
            parents.append(owner)
            radius /= 2
            if len(centres) == n:
                break
        rows.append(np.arange(n))
        # from the finest level up: each node lies under one parent, so that pruning a pair prunes all below it
        levels, orders = [], []
        for i in range(len(rows) - 1, 0, -1):
            up = parents[i - 1][rows[i]]
            order = np.argsort(up, kind="stable")
            orders.append((i, order, np.bincount(up, minlength=len(rows[i - 1]))))
        under = np.arange(n)  # the node of level i above each row
        place: dict[int, np.ndarray] = {len(rows) - 1: under}
        for i in range(len(rows) - 1, 0, -1):
            under = parents[i - 1][rows[i]][under]
            place[i - 1] = under
        counts = {i: c for i, _, c in orders}
        kids = {i: o for i, o, _ in orders}
        for i, own in enumerate(rows):
            under = place[i]
            cover = np.zeros(len(own))
            np.maximum.at(cover, under, np.linalg.norm(x - x[own[under]], axis=1))
            by = np.argsort(under, kind="stable")
            size = np.bincount(under, minlength=len(own))
            if i + 1 < len(rows):
                count = counts[i + 1]
                levels.append((own, cover, kids[i + 1], np.cumsum(count) - count, count, by, np.cumsum(size) - size, size))
            else:
                levels.append((own, cover, None, None, None, by, np.cumsum(size) - size, size))
        self.levels = levels

    def packed(self) -> list:
        """The levels to send; row numbers in 32 bits."""
        return [tuple(a if a is None or a.dtype.kind == "f" else a.astype(np.int32) for a in level) for level in self.levels]

    @classmethod
    def unpacked(cls, x: np.ndarray, levels: list) -> Tree:
        out = cls.__new__(cls)
        out.x = x
        out.x32 = out.x.astype(np.float32)
        out.levels = [tuple(a if a is None or a.dtype.kind == "f" else a.astype(np.int64) for a in level) for level in levels]
        return out

    def under(self, level: int, node: int) -> np.ndarray:
        """The rows under a node."""
        _, _, _, _, _, by, first, size = self.levels[level]
        return by[first[node] : first[node] + size[node]]

    def all_under(self, level: int, nodes: np.ndarray) -> np.ndarray:
        """The rows under any of the nodes."""
        _, _, _, _, _, by, first, size = self.levels[level]
        k = size[nodes]
        return by[np.repeat(first[nodes] - (np.cumsum(k) - k), k) + np.arange(k.sum())]

    def children(self, level: int, node: int) -> np.ndarray:
        """The nodes of the next level under a node; a node of the last level is its own only child."""
        _, _, kids, first, count, *_ = self.levels[level]
        return np.array([node]) if kids is None else kids[first[node] : first[node] + count[node]]

    def _cover(self, centres: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """A net that contains the given centres: each row is within radius of its owner, the nearest centre."""
        x, n = self.x, len(self.x)
        limit = 1 - radius * radius / 2  # of the dot product
        best, owner = np.full(n, -2.0), np.full(n, -1)
        chosen = centres.tolist()

        def assign(new: list[int], base: int) -> None:
            for a in range(0, len(new), 512):
                dots = x @ x[new[a : a + 512]].T
                top = dots.argmax(axis=1)
                value = dots[np.arange(n), top]
                better = value > best
                best[better], owner[better] = value[better], base + a + top[better]

        if chosen:
            assign(chosen, 0)
        for a in range(0, n, 256):
            rows = np.arange(a, min(n, a + 256))
            rows = rows[best[rows] < limit]
            if not len(rows):
                continue
            dots, taken, new = x[rows] @ x[rows].T, np.zeros(len(rows), bool), []
            for i in range(len(rows)):
                if not taken[i]:
                    new.append(int(rows[i]))
                    taken |= dots[i] >= limit
            assign(new, len(chosen))
            chosen += new
        return np.array(chosen, np.int64), owner


def dual_links(a: Tree, b: Tree, cosine: float, wa: np.ndarray, wb: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Weights linked to each row of a, of b, and a spanning set of links (row of a, row of b)."""
    limit = math.sqrt(max(0.0, 2 - 2 * cosine))
    na, nb = np.zeros(len(a.x), np.int64), np.zeros(len(b.x), np.int64)
    links: list[tuple[int, int]] = []
    depth = max(len(a.levels), len(b.levels))
    # a step is a pair of node lists to compare crosswise, or one of paired nodes; steps lie on a stack, deepest first
    todo: list[tuple[int, np.ndarray, np.ndarray, bool]] = [(0, np.arange(len(a.levels[0][0])), np.arange(len(b.levels[0][0])), True)]
    while todo:
        level, xs, ys, cross = todo.pop()
        la, lb = min(level, len(a.levels) - 1), min(level, len(b.levels) - 1)
        ra, rb = a.levels[la][0], b.levels[lb][0]
        ca, cb = a.levels[la][1], b.levels[lb][1]
        if cross:
            # nodes of few rows go straight down to their rows; other nodes of like radii share one bound, tested in single
            # precision, and each pair's own bounds follow
            px, py = [], []
            few_x, few_y = a.levels[la][7][xs] <= FEW, b.levels[lb][7][ys] <= FEW
            leaf = level >= depth - 1
            if not leaf and few_x.any() and few_y.any():
                todo.append((depth - 1, a.all_under(la, xs[few_x]), b.all_under(lb, ys[few_y]), True))
            for u_nodes, v_nodes in [(u, v) for u in like_radii(xs, ca) for v in like_radii(ys, cb)] if leaf else [(u, v) for x, y in ((xs[~few_x], ys), (xs[few_x], ys[~few_y])) for u in like_radii(x, ca) for v in like_radii(y, cb)]:
                if len(u_nodes) and len(v_nodes):
                    far = min(2.0, limit + ca[u_nodes].max() + cb[v_nodes].max() + 1e-3)
                    bound = np.float32(1 - far * far / 2)
                    for t in range(0, len(v_nodes), BLOCK[1]):
                        v_part = v_nodes[t : t + BLOCK[1]]
                        right = np.ascontiguousarray(b.x32[rb[v_part]].T)
                        for s in range(0, len(u_nodes), BLOCK[0]):
                            dots = a.x32[ra[u_nodes[s : s + BLOCK[0]]]] @ right
                            if dots.max() >= bound:  # most blocks of unlike vectors end here
                                u, v = np.nonzero(dots >= bound)
                                px.append(u_nodes[s + u])
                                py.append(v_part[v])
            if not px:
                continue
            xs, ys = np.concatenate(px), np.concatenate(py)
        if not len(xs):
            continue
        if len(xs) > 200_000:
            todo += [(level, xs[s : s + 200_000], ys[s : s + 200_000], False) for s in range(0, len(xs), 200_000)]
            continue
        dots = np.einsum("ij,ij->i", a.x[ra[xs]], b.x[rb[ys]])
        if level >= depth - 1:
            hit = dots >= cosine
            rows_a, rows_b = ra[xs[hit]], rb[ys[hit]]
            np.add.at(na, rows_a, wb[rows_b])
            np.add.at(nb, rows_b, wa[rows_a])
            links += spanning(rows_a, rows_b, len(a.x))
            continue
        gap, reach = np.sqrt(np.maximum(0, 2 - 2 * dots)), ca[xs] + cb[ys]
        sizes = a.levels[la][7][xs] * b.levels[lb][7][ys]
        whole = (gap + reach <= limit - SLACK) & (sizes >= 64)
        for x, y in zip(xs[whole].tolist(), ys[whole].tolist(), strict=True):
            rows_a, rows_b = a.under(la, x), b.under(lb, y)
            na[rows_a] += wb[rows_b].sum()
            nb[rows_b] += wa[rows_a].sum()
            links += [(int(rows_a[0]), q) for q in rows_b.tolist()] + [(p, int(rows_b[0])) for p in rows_a.tolist()]
        still = (gap - reach <= limit + SLACK) & ~whole
        xs, ys = xs[still], ys[still]
        if not len(xs):
            continue
        down_a, down_b = level < len(a.levels) - 1, level < len(b.levels) - 1
        nx = a.levels[la][4][xs] if down_a else np.ones(len(xs), np.int64)
        ny = b.levels[lb][4][ys] if down_b else np.ones(len(ys), np.int64)
        large = nx * ny > 16_384
        for x, y in zip(xs[large].tolist(), ys[large].tolist(), strict=True):
            todo.append((level + 1, a.children(la, x) if down_a else np.array([x]), b.children(lb, y) if down_b else np.array([y]), True))
        xs, ys, nx, ny = xs[~large], ys[~large], nx[~large], ny[~large]
        cut = np.cumsum(nx * ny) // 200_000
        for part in np.unique(cut):
            own = cut == part
            x, y, kx, ky = xs[own], ys[own], nx[own], ny[own]
            pair = np.repeat(np.arange(len(x)), kx * ky)
            step = np.arange(len(pair)) - np.repeat(np.cumsum(kx * ky) - kx * ky, kx * ky)
            i, j = step // ky[pair], step % ky[pair]
            cx = a.levels[la][2][a.levels[la][3][x[pair]] + i] if down_a else x[pair]
            cy = b.levels[lb][2][b.levels[lb][3][y[pair]] + j] if down_b else y[pair]
            todo.append((level + 1, cx, cy, False))
    return na, nb, links


def like_radii(nodes: np.ndarray, cover: np.ndarray) -> list[np.ndarray]:
    """The nodes, split by covering radius."""
    kind = np.searchsorted([1e-9, 0.1, 0.3, 0.6], cover[nodes])
    return [nodes[kind == k] for k in np.unique(kind)]


def spanning(rows_a: np.ndarray, rows_b: np.ndarray, shift: int) -> list[tuple[int, int]]:
    """Of links from rows_a to rows_b, a forest that connects the same; rows of b are told apart by shift."""
    up: dict[int, int] = {}

    def root(v: int) -> int:
        while (w := up.setdefault(v, v)) != v:
            up[v] = v = up[w]
        return v

    out = []
    for p, q in zip(rows_a.tolist(), rows_b.tolist(), strict=True):
        x, y = root(p), root(q + shift)
        if x != y:
            up[x] = y
            out.append((p, q))
    return out


def clean(vector: list | None) -> np.ndarray | None:
    """The vector divided by its length, or None if it links with nothing."""
    if not vector or any(v is None for v in vector):
        return None
    x = np.array(vector, np.float64)
    if not np.isfinite(x).all():
        return None
    top = np.abs(x).max()
    if top == 0:
        return None
    x = x / top
    return x / np.linalg.norm(x)


def apart(a: str, b: str) -> Column:
    """Distance of two vectors."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, part: int = PART, group: int = GROUP) -> DataFrame:
    """(id, n_links, component): links to other vectors, and the smallest id reachable."""
    spark = df.sparkSession
    source = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    if not source.schema["v"].dataType.simpleString() in ("array<float>", "array<double>"):
        source = source.withColumn("v", F.col("v").cast("array<double>"))
    fine = F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = staged(source.select("id", F.when(F.coalesce(fine, F.lit(False)), F.col("v")).alias("v")), "vectors")
    # one class for each distinct vector: partial sums before the shuffle, so copies never meet in one task
    classes = staged(rows.filter("v is not null").groupBy("v").agg(F.min("id").alias("first"), F.count("*").alias("n")).withColumn("cls", F.monotonically_increasing_id()), "classes")
    widest = classes.agg(F.max(F.size("v")).alias("d")).first().d or 1
    part = max(16, min(part, PART_VALUES // widest))  # a part's bytes are bounded for long vectors too
    parts = -(-classes.count() // part)
    lot = max(1, min(group, -(-parts // 4)))  # parts of a group
    pivots = max(1, min(PIVOT_VALUES // widest, -(-parts // lot)))
    picked = [np.array(x.v, np.float64) for x in classes.select("v").orderBy(F.xxhash64("v")).limit(pivots).collect()]
    if not picked:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    by_size: dict[int, np.ndarray] = {}
    for d in {len(p) for p in picked}:
        by_size[d] = np.array([p / np.linalg.norm(p) for p in picked if len(p) == d])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for v in b.column(1).to_pylist():
                x, p = clean(v), by_size.get(len(v))
                out.append(-1 if x is None or p is None else int((p @ x).argmax()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([len(v) for v in b.column(1).to_pylist()], pa.int32()), pa.array(out, pa.int32()), b.column(1)], ["cls", "n", "dim", "pivot", "v"])

    placed = staged(classes.select("cls", "v", "n").mapInArrow(place, f"cls long, n long, dim int, pivot int, v {rows.schema['v'].dataType.simpleString()}"), "placed")
    crowd = placed.groupBy("dim", "pivot").agg(F.count("*").alias("size"))
    chunk = F.pmod(F.xxhash64("cls"), F.ceil(F.col("size") / part).cast("long")).cast("int")
    dealt = placed.join(F.broadcast(crowd), ["dim", "pivot"]).withColumn("chunk", chunk)  # at most pivots and dims rows
    # whole parts go as one row each: packed rows of bounded number; parts of a region are a group, or several
    packed = dealt.groupBy("dim", "pivot", "chunk").agg(F.collect_list(F.struct("cls", "n", "v")).alias("rows"))
    packed = staged(packed.select(F.struct("dim", "pivot", F.floor(F.col("chunk") / lot).cast("int").alias("lot")).alias("group"), F.col("chunk").alias("part"), "dim", "rows"), "parts")

    def unit(x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def unpack(column: pa.Array, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        item = column[i].values
        ids, weights = item.field("cls").to_numpy(zero_copy_only=False), item.field("n").to_numpy(zero_copy_only=False)
        return ids, weights, item.field("v").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ids, weights, raw = unpack(b.column(3), i)
                x = unit(raw)
                centre = x.mean(axis=0)
                centre = centre / (np.linalg.norm(centre) or 1)
                far = float(np.linalg.norm(x - centre, axis=1).max())
                packed_tree = pickle.dumps((ids, weights, np.ascontiguousarray(raw), Tree(x).packed()), protocol=5)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), b.column(1).slice(i, 1), b.column(2).slice(i, 1), pa.array([centre.tolist()], pa.list_(pa.float64())), pa.array([far]), pa.array([packed_tree], pa.binary())], ["group", "part", "dim", "centre", "far", "tree"])

    key = "struct<dim:int,pivot:int,lot:int>"
    trees = staged(packed.mapInArrow(top, f"group {key}, part int, dim int, centre array<double>, far double, tree binary"), "trees")
    limit = math.sqrt(2 - 2 * cosine)
    # a group's ball holds those of its parts
    own = trees.select("group", "dim", "centre", "far")
    middle = own.groupBy("group", "dim").agg(F.min(F.struct("far", "centre"))["centre"].alias("middle"))
    tops = staged(own.join(middle, ["group", "dim"]).groupBy("group", "dim", "middle").agg(F.max(apart("centre", "middle") + F.col("far")).alias("far")), "tops")
    n_tops, lots = tops.count(), 4 * spark.sparkContext.defaultParallelism
    p = tops.select(*[F.col(c).alias("p_" + c) for c in tops.columns])
    q = tops.select(*[F.col(c).alias("q_" + c) for c in tops.columns])
    near = (F.col("p_group") <= F.col("q_group")) & (apart("p_middle", "q_middle") - F.col("p_far") - F.col("q_far") <= limit + SLACK)
    if n_tops <= MAX_TOPS:
        met = p.repartition(spark.sparkContext.defaultParallelism).join(F.broadcast(q), (F.col("p_dim") == F.col("q_dim")) & near)
    else:  # one side is dealt to lots, the other goes to all of them
        p, q = p.withColumn("p_lot", F.pmod(F.xxhash64("p_group"), F.lit(lots))), q.withColumn("q_lot", F.explode(F.sequence(F.lit(0), F.lit(lots - 1))))
        met = p.join(q, (F.col("p_lot") == F.col("q_lot")) & (F.col("p_dim") == F.col("q_dim")) & near)
    pairs = staged(met.select(F.col("p_group").alias("ga"), F.col("q_group").alias("gb")), "pairs")
    # a task compares two groups: all parts of the one are held, those of the other pass by; a group goes to as many tasks as
    # it may have links with, so parts move once per pair of groups and not per pair of parts
    asked = pairs.select("ga", "gb", F.explode(F.array_distinct(F.array("ga", "gb"))).alias("group"))
    joined = trees.select("group", "part", "tree").join(bounded_broadcast(asked, MAX_PAIRS), "group")
    joined = joined.select("ga", "gb", (F.col("group") != F.col("ga")).alias("second"), "part", "tree")
    joined = joined.repartition(max(spark.sparkContext.defaultParallelism, min(4096, 2 * pairs.count())), "ga", "gb").sortWithinPartitions("ga", "gb", "second", "part")

    def opened(raw: bytes) -> tuple[np.ndarray, np.ndarray, Tree]:
        ids, weights, x, levels = pickle.loads(raw)  # written by `top` above
        return ids, weights, Tree.unpacked(unit(x), levels)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held = None, []
        for b in batches:
            for i in range(b.num_rows):
                this, second = (b.column(0)[i].as_py(), b.column(1)[i].as_py()), b.column(2)[i].as_py()
                if this != task:
                    task, held = this, []
                own = opened(b.column(4)[i].as_py())
                if not second:
                    held.append(own)
                for other in held if second or this[0] == this[1] else ():
                    yield linked(other, own)

    def linked(a: tuple, b: tuple) -> pa.RecordBatch:
        (ida, wa, ta), (idb, wb, tb) = a, b
        na, nb, links = dual_links(ta, tb, cosine, wa, wb)
        if a is b:
            cls, n = ida[na > 0], na[na > 0]
        else:
            cls, n = np.concatenate([ida[na > 0], idb[nb > 0]]), np.concatenate([na[na > 0], nb[nb > 0]])
        links = sorted({(min(x, y), max(x, y)) for r, s in links if (x := int(ida[r])) != (y := int(idb[s]))})
        k = len(cls)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([cls, np.array([x for x, _ in links], np.int64)]), pa.int64()), pa.array([None] * k + [y for _, y in links], pa.int64()), pa.array(np.concatenate([n, np.zeros(len(links), np.int64)]), pa.int64())], ["a", "b", "n"]
        )

    found = staged(joined.mapInArrow(compare, "a long, b long, n long"), "found")
    counts = found.filter("b is null").groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("linked"))
    groups = connected_components(found.filter("b is not null").select("a", "b"))
    named = classes.select("cls", "v", "first", "n").join(counts, "cls", "left").join(groups, F.col("cls") == F.col("node"), "left").withColumn("group", F.coalesce("component", "cls"))
    least = named.groupBy("group").agg(F.min("first").alias("lowest"))
    result = staged(named.join(least, "group").select("v", F.greatest(F.coalesce("linked", F.lit(0)) - 1, F.col("n") - 1).cast("long").alias("n_links"), "lowest"), "named")
    out = rows.filter("v is not null").join(result, "v").select("id", "n_links", F.col("lowest").alias("component"))
    rest = rows.filter("v is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return out.unionByName(rest).select(F.col("id").alias(id_col), "n_links", "component")


def op4_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every embedding."""
    out = near_duplicates(table(spark, sf_dir, "embeddings"))
    return out.select("vec_id", "n_links", F.col("component").alias("component_id"), F.col("vec_id").eqNullSafe(F.col("component")).alias("kept"))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
fine AS (SELECT * FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b ON a.vec_id <> b.vec_id AND CASE WHEN len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) >= 0.9 ELSE false END),
r AS (SELECT vec_id, vec_id AS c FROM v UNION SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.c)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = vec_id) AS n_links, min(c) AS component_id, min(c) = vec_id AS kept FROM r GROUP BY vec_id
"""
