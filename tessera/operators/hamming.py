"""Pairs of 64-bit hashes within a Hamming distance, without comparing all pairs: covering masks from a linear code.

Give each bit position i of a part a vector m(i) of `dims` bits. For each v other than 0 there is a mask: the positions whose m(i)
has an odd number of bits in common with v. Two hashes that differ in fewer than `dims` places of the part agree under at least one
mask: the vectors of these places leave out some direction, and its v is orthogonal to all of them. So grouping by the masked
hash, once for each mask, misses no pair, whatever the vectors are; how few unlike pairs meet depends on how many positions the
lightest masks have. m(i) is (1, x, x^3) over the field whose elements number the positions, which gives every mask of 64 positions 24
or more.

With one part of 64 bits there are 2^13 - 1 masks for a threshold of 12, and of random hashes 1 pair in 40,000 meets; with two
parts of 32 bits (of which one differs in fewer places than its share of 13) there are 190 masks and 1 pair in 170 meets. Two
parts serve until pairs get many.

A pair that meets under several masks counts under the first alone: the places of a pair span a space whose orthogonal v's are
known by elimination, so each table decides by itself which pairs are its own, and nothing has to be made distinct.

`near` compares two sets of hashes in one task in a plainer way, that needs few sorts: hashes are cut into parts, of which one
differs in a place at most (or, in the last, in none), so hashes meet in the bucket of a part or one beside it, and buckets are compared
in tiles that stay in the cache. Of random hashes 1 pair in 10 is compared, at about a nanosecond each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Up to so many hashes two parts; so many hashes in a group; so many in a row that moves; masked hashes that a task sorts, about; near
#: pairs that wait until their own table is known.
TWO_PARTS, GROUP, CHUNK, TASK, SETTLE = 100_000, 500_000, 20_000, 200_000_000, 250_000
#: Hashes compared at once: a tile of 8 bytes each stays in the cache.
TILE, WIDTH = 32_768, 1024
# Primitive polynomials over two elements, by degree.
FIELD = {4: 0b10011, 5: 0b100101, 6: 0b1000011}


def times(a: int, b: int, degree: int) -> int:
    out = 0
    while b:
        if b & 1:
            out ^= a
        a, b = a << 1, b >> 1
        if a >> degree & 1:
            a ^= FIELD[degree]
    return out


@cache
def code(positions: int, dims: int) -> tuple[int, ...]:
    """Masks of a basis: bit i of the b-th says whether m(i) has bit b."""
    degree = positions.bit_length() - 1
    vectors = []
    for x in range(positions):
        m, power, at = 1, x, 1
        while at < dims:
            m |= power << at
            power, at = times(power, times(x, x, degree), degree), at + degree
        vectors.append(m)
    return tuple(sum((vectors[i] >> b & 1) << i for i in range(positions)) for b in range(dims))


@cache
def design(parts: int, threshold: int) -> tuple[tuple[int, ...], ...]:
    """The basis masks of each part. Parts share threshold + 1 dimensions, so some part differs in fewer places than it has."""
    size, share = 64 // parts, divmod(threshold + 1, parts)
    return tuple(tuple(x << (size * j) for x in code(size, share[0] + (j < share[1]))) for j in range(parts))


@cache
def tables(parts: int, threshold: int) -> tuple[tuple[int, int, int], ...]:
    """(part, v, mask) of all tables."""
    out = []
    for j, basis in enumerate(design(parts, threshold)):
        for v in range(1, 1 << len(basis)):
            mask = 0
            for b, x in enumerate(basis):
                mask ^= x if v >> b & 1 else 0
            out.append((j, v, mask))
    return tuple(out)


def own_table(differ: np.ndarray, parts: int, threshold: int) -> np.ndarray:
    """part << 16 | v of the first table under which hashes with these differing bits meet."""
    out = np.full(len(differ), -1, np.int64)
    for j, basis in enumerate(design(parts, threshold)):
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for b, x in enumerate(basis):
            now, made = differ & np.uint64(x), np.full(len(differ), 1 << b, np.int64)
            for before, low, combined in kept:
                hit = (now & low) != 0
                now = np.where(hit, now ^ before, now)
                made = np.where(hit, made ^ combined, made)
            out = np.where((now == 0) & (out < 0), j << 16 | made, out)
            kept.append((now, now & (~now + np.uint64(1)), made))
    return out


def meetings(x: np.ndarray, side: np.ndarray | None, parts: int, threshold: int, slice_no: int, slices: int, seen: list[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(a, b), lot by lot: indices of pairs within the threshold that belong to every slices-th table from slice_no on. side: only pairs of
    both sides count. seen: gets the number of pairs compared."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    waiting = 0

    def settled() -> tuple[np.ndarray, np.ndarray]:
        a, b, table = (np.concatenate(c) for c in zip(*found))
        found.clear()
        mine = own_table(x[a] ^ x[b], parts, threshold) == table
        return a[mine], b[mine]

    for j, v, mask in tables(parts, threshold)[slice_no::slices]:
        key = x & np.uint64(mask)
        order = np.argsort(key)
        key = key[order]
        at, step = np.flatnonzero(key[1:] == key[:-1]), 1
        while len(at):
            a, b = order[at], order[at + step]
            if seen is not None:
                seen[0] += len(a)
            near = np.bitwise_count(x[a] ^ x[b]) <= threshold
            if side is not None:
                near &= side[a] != side[b]
            if near.any():
                a, b = a[near], b[near]
                found.append((a, b, np.full(len(a), j << 16 | v)))
                waiting += len(a)
                if waiting > SETTLE:
                    yield settled()
                    waiting = 0
            step += 1
            at = at[at + step < len(x)]
            at = at[key[at + step] == key[at]]
    if found:
        yield settled()


def meet(*args, **more) -> tuple[np.ndarray, np.ndarray]:
    """All of meetings at once."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)), *meetings(*args, **more)]
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


@cache
def buckets(threshold: int) -> tuple[tuple[int, int, tuple[int, ...]], ...]:
    """(shift, bits, offsets of the keys to look under) of each part. A part counts two places where one may differ, else one; together they
    count threshold + 1, so hashes within the threshold meet in some part."""
    pairs, odd = divmod(threshold + 1, 2)
    last = (max(1, 64 // (pairs + 1) - 3) if pairs else 64) if odd else 0
    sizes = [(64 - last) // pairs + (i < (64 - last) % pairs) for i in range(pairs)]
    out, shift = [], 0
    for bits, offsets in [*((n, (0, *(1 << b for b in range(n)))) for n in sizes), *([(last, (0,))] if odd else [])]:
        out.append((shift, bits, offsets))
        shift += bits
    return tuple(out)


def near(x: np.ndarray, y: np.ndarray, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j), lot by lot: indices of all x and y within the threshold, each pair once, j rising within a lot's rows of x."""
    tile, bits_of = np.empty(TILE, np.uint64), np.empty(TILE, np.uint8)  # kept, as fresh memory costs more than the comparing
    parts = buckets(threshold) if threshold < 16 else ((0, 0, (0,)),)  # beyond, buckets would exclude little
    for p, (shift, bits, offsets) in enumerate(parts):
        key = lambda v: ((v >> np.uint64(shift)) & np.uint64((1 << bits) - 1)).astype(np.uint16 if bits <= 16 else np.uint64)  # noqa: B023, E731
        keys = (key(y)[None, :] ^ np.array(offsets, np.uint64).astype(np.uint16 if bits <= 16 else np.uint64)[:, None]).T.ravel()
        by_key, own = np.argsort(keys, kind="stable"), key(x)
        keys, columns = keys[by_key], by_key // len(offsets)
        rows = np.argsort(own, kind="stable")
        own, xs, ys = own[rows], x[rows], y[columns]
        cut = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, np.int64)
        low, high = (np.searchsorted(keys, own[cut], side=s).tolist() for s in ("left", "right"))
        for a, b, lo, hi in zip(cut.tolist(), [*cut[1:].tolist(), len(own)], low, high):
            for s in range(lo, hi, WIDTH):
                w = min(WIDTH, hi - s)
                for r in range(a, b, max(1, TILE // w)):
                    n = w * (min(b, r + max(1, TILE // w)) - r)
                    np.bitwise_xor(xs[r : r + n // w, None], ys[s : s + w], out=tile[:n].reshape(-1, w))
                    hit = np.flatnonzero(np.bitwise_count(tile[:n], out=bits_of[:n]) <= threshold)
                    if len(hit):
                        i, j = r + hit // w, s + hit % w
                        differ, first = xs[i] ^ ys[j], np.ones(len(hit), bool)
                        for at, size, few in parts[:p]:  # a pair that an earlier part finds is that part's
                            first &= np.bitwise_count(differ & np.uint64(((1 << size) - 1) << at)) > (1 if len(few) > 1 else 0)
                        if first.any():
                            yield rows[i[first]], columns[j[first]]


def near_pairs_of(values: DataFrame, count: int, threshold: int, two_parts: int = TWO_PARTS, group: int = GROUP) -> DataFrame:
    """(v, w, distance), v < w: pairs of distinct hashes (v: a struct of the halves hi and lo) within the threshold. count: how many
    there are.

    Hashes are dealt into groups of bounded size; a task has two groups, or one, and a share of the tables. Hashes move as arrays.
    """
    parts = 2 if count <= two_parts else 1
    groups, chunks = math.ceil(count / group), math.ceil(count / CHUNK)
    masks = len(tables(parts, threshold))
    slices = min(masks, max(8, math.ceil(masks * min(count, 2 * group) / TASK)))
    number = F.shiftleft(F.col("v.hi"), 32).bitwiseOR(F.col("v.lo"))
    packed = values.select(number.alias("x"), F.pmod(F.xxhash64("v"), F.lit(chunks)).alias("chunk")).groupBy("chunk").agg(F.collect_list("x").alias("xs"))
    own = F.pmod("chunk", F.lit(groups)).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), lambda h: F.struct(F.least(own, h).alias("a"), F.greatest(own, h).alias("b")))
    dealt = packed.withColumn("own", own).withColumn("cell", F.explode(cells)).withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))

    def compare(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [(b.column("own"), b.column("xs")) for b in batches]
        x = np.concatenate([xs.flatten().to_numpy(zero_copy_only=False) for _, xs in found]).view(np.uint64)
        side = np.concatenate([np.repeat(own.to_numpy(), xs.value_lengths().to_numpy()) for own, xs in found]) if key[0] != key[1] else None
        half = np.uint64(0xFFFFFFFF)
        for a, b in meetings(x, side, parts, threshold, key[2].as_py(), slices):
            low, high = np.minimum(x[a], x[b]), np.maximum(x[a], x[b])
            cols = (low >> np.uint64(32), low & half, high >> np.uint64(32), high & half)
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], ["vh", "vl", "wh", "wl"])

    made = dealt.select(F.col("cell.a").alias("a"), F.col("cell.b").alias("b"), "slice", "own", "xs")
    out = made.repartition(min(4096, groups * (groups + 1) // 2 * slices), "a", "b", "slice").groupBy("a", "b", "slice").applyInArrow(compare, "vh long, vl long, wh long, wl long")
    pair = out.select(F.struct(F.col("vh").alias("hi"), F.col("vl").alias("lo")).alias("v"), F.struct(F.col("wh").alias("hi"), F.col("wl").alias("lo")).alias("w"))
    bits = lambda h: F.bit_count(F.col(f"v.{h}").bitwiseXOR(F.col(f"w.{h}")))
    return pair.withColumn("distance", bits("hi") + bits("lo"))
