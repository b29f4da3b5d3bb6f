"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints of 64 bits come from hashed word shingles. Equal fingerprints form one class. Two fingerprints that differ in
at most `radius` bits agree on at least two of `radius + 2` bit blocks (with radius 4: any two of six), so each class goes
to one bucket per pair of blocks, keyed by the bits of both; that is exact, no link is missed. In a bucket the fingerprints
lie as 64 vertical bit planes: one query is compared with 64 others per machine word, differing bits are added by carry-save
counters, and lanes are abandoned once all in a word have passed the radius.

A bucket yields a spanning set of its links (each fingerprint is reached once), never all pairs. A bucket over `chunk`
fingerprints is cut into chunks by hash, and each pair of chunks is a task of its own; all pairs of chunks together cover all
pairs of fingerprints, so hot buckets are split without loss. Connected components are found on the links in Spark.

Defined results. Null or empty text and text without words: fingerprint zero, linked like any other. Fewer words than a
shingle has: the whole sequence is the only shingle. Repeated rows: each row has its result. Null ids: rows keep their
fingerprint; their component is the smallest id that isn't null in it, if any. Other columns are ignored by the operator.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import join_sums, staged, table
from .components import connected_components

SHINGLE, SEED, RADIUS = 4, 42, 4
CHUNK = 4096
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The SimHash of a text: bit i is set if it is set in over half of the shingles' XXH64."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        return xxh64_intdigest(line, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    hashes = [xxh64_intdigest(line[a:b], seed) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)]
    return majority(np.array(hashes, np.uint64))


def majority(hashes: np.ndarray) -> int:
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        counts += np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp): fp is the fingerprint as a signed long."""
    out = T.StructType([df.schema[id_col], T.StructField("fp", T.LongType())])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], [id_col, "fp"])

    return df.select(id_col, text_col).mapInArrow(part, out)


def planes_of(fps: np.ndarray) -> np.ndarray:
    """64 bit planes over the fingerprints, as words of 64 lanes: planes[bit, word]."""
    words = -(-len(fps) // 64)
    bits = np.zeros((words * 64, 64), np.uint8)
    bits[: len(fps)] = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def within(planes: np.ndarray, query: int, words: np.ndarray, open_lanes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the given words, those with open lanes within the radius of query, and these lanes.

    The count of differing bits per lane is held in vertical counters; lanes that passed the radius stay marked, and words
    whose open lanes all have passed it are abandoned every eight planes.
    """
    size = max(1, int(radius).bit_length())
    planes = planes[:, words]
    lanes = open_lanes[words]
    counters = [np.zeros(len(words), np.uint64) for _ in range(size)]
    over = ~lanes
    for bit in range(64):
        carry = planes[bit] ^ (FULL if query >> bit & 1 else np.uint64(0))
        for k in range(size):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        over |= carry
        if bit % 8 == 7:
            past = over.copy()
            # counters above the radius: compare with the constant, most significant plane first
            equal = np.full(len(words), FULL)
            for k in range(size - 1, -1, -1):
                if radius >> k & 1:
                    equal &= counters[k]
                else:
                    past |= equal & counters[k]
                    equal &= ~counters[k]
            keep = past != FULL
            if not keep.all():
                words, planes, over, past = words[keep], planes[:, keep], over[keep], past[keep]
                counters = [c[keep] for c in counters]
            over |= past
            if not len(words):
                break
    return words, ~over


def spanning_links(fps: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links (index, index) that connect whatever links within the radius connect: a breadth-first forest."""
    n = len(fps)
    if n < 2:
        return []
    if n == 2:
        return [(0, 1)] if int(fps[0] ^ fps[1]).bit_count() <= radius else []
    planes = planes_of(fps)
    open_lanes = np.zeros(planes.shape[1] * 64, np.uint8)
    open_lanes[:n] = 1
    open_lanes = np.packbits(open_lanes, bitorder="little").view(np.uint64)
    links: list[tuple[int, int]] = []
    words = np.arange(planes.shape[1])
    values = fps.tolist()
    for seed in range(n):
        if not int(open_lanes[seed >> 6]) >> (seed & 63) & 1:
            continue
        open_lanes[seed >> 6] &= ~(np.uint64(1) << np.uint64(seed & 63))
        todo = [seed]
        while todo:
            x = todo.pop()
            words = words[open_lanes[words] != 0]
            if not len(words):
                return links
            hit, lanes = within(planes, values[x], words, open_lanes, radius)
            for w, lane in zip(hit.tolist(), lanes.tolist(), strict=True):
                open_lanes[w] &= ~np.uint64(lane)
                while lane:
                    low = lane & -lane
                    y = w * 64 + low.bit_length() - 1
                    links.append((x, y))
                    todo.append(y)
                    lane ^= low
    return links


def block_masks(radius: int) -> list[int]:
    """Masks of all pairs of radius + 2 blocks of the 64 bits."""
    cuts = [round(i * 64 / (radius + 2)) for i in range(radius + 3)]
    blocks = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [x | y for x, y in combinations(blocks, 2)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_links(classes: DataFrame, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """(a, b): links between distinct fingerprints that connect all that are within the radius. classes: fp, distinct."""
    masks = block_masks(radius)
    keyed = classes.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("table"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for i, m in enumerate(masks)])).alias("x")).select("fp", "x.*")
    # buckets of one fingerprint have no links; counts are partial sums before the shuffle
    sizes = staged(keyed.groupBy("table", "key").agg(F.count("*").alias("n")).filter("n > 1"), "buckets")
    full = keyed.join(sizes, ["table", "key"])
    # a bucket of n fingerprints has c = ceil(n / chunk) chunks; a fingerprint goes to the c tasks of its chunk and each other
    parts = F.ceil(F.col("n") / chunk).cast("long")
    own = F.pmod(F.xxhash64("fp"), parts)
    tasks = F.transform(F.sequence(F.lit(0).cast("long"), parts - 1), lambda j: F.least(own, j) * parts + F.greatest(own, j))
    dealt = full.select("table", "key", F.explode(F.when(parts == 1, F.array(F.lit(0).cast("long"))).otherwise(tasks)).alias("task"), "fp")
    gathered = dealt.groupBy("table", "key", "task").agg(F.collect_list("fp").alias("fps")).select("fps")

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(0)
            a, c = [], []
            values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            for i in range(len(column)):
                fps = np.sort(values[offsets[i] : offsets[i + 1]].view(np.uint64))
                for x, y in spanning_links(fps, radius):
                    a.append(fps[x])
                    c.append(fps[y])
            yield pa.RecordBatch.from_arrays([pa.array(np.array(x, np.uint64).view(np.int64), pa.int64()) for x in (a, c)], ["a", "b"])

    return gathered.mapInArrow(part, "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """(id, fp, component): component is the smallest id reachable over links."""
    prints = staged(fingerprints(df, id_col, text_col, shingle), "fingerprints").withColumnRenamed(id_col, "id")
    classes = staged(prints.groupBy("fp").agg(F.min("id").alias("first")), "classes")
    groups = connected_components(near_links(classes.select("fp"), radius))
    named = staged(classes.join(groups, classes["fp"] == groups["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("group")), "groups")
    least = staged(named.groupBy("group").agg(F.min("first").alias("component"), F.count("*").alias("n")), "least")
    by_class = staged(join_sums(named, least, "group", named.count()).select("fp", "component"), "components")
    return prints.join(by_class, "fp").select(F.col("id").alias(id_col), "fp", "component")


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with one document of each group: the one whose id is its component's. Rows without an id stay, and so do rows that
    repeat a kept id."""
    found = near_duplicates(df.filter(F.col(id_col).isNotNull()), id_col, text_col)
    gone = found.filter(F.col(id_col) != F.col("component")).select(F.col(id_col).alias("gone")).distinct()
    return df.join(gone, F.col(id_col) == gone["gone"], "left_anti")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint and component of every document."""
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
