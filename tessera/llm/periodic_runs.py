"""Periodic runs of words: maximal pairs in a bottom-up LCP-interval tree with left-word classes.

A run is a stretch of consecutive words with smallest period p, at least twice as long as p, that no neighbouring word extends.
Such a run that starts at s and has n words is the same as a maximal pair: the n - p words from s and from s + p are equal,
what follows them differs, and what stands before them differs. Conversely a maximal pair whose distance is no more than its
length is a run of that distance or of a divisor of it, which then is a pair with the same start and end. So pairs are all
that is looked for; nothing is extended, and of pairs with one start and end the smallest distance counts.

Words of a text are suffixes in order; intervals of suffixes that share l words are closed bottom-up by a stack. A closed
interval holds its places by the word on their left: places of one class make no pair, and an interval of one class is merged
without a look. Between the two places of a smallest period there is no third one of the same interval (a word sequence
would equal a rotation of itself), so a merge compares new neighbours alone: places of the smaller lists with the nearest ones
of the largest. Runs of at least MIN_WORDS words have pairs of at least half as many, so the tree starts at that depth, and only
places that can pair are put into it: their class differs from another's within the same SEED words, which occur again no
farther than words around here keep occurring again.

Texts are independent: there is no shuffle, and a lot of texts is in memory at once. Work in a text of n words is n log n.

Defined results. Null and empty texts: no words, no runs, an empty collapsed text. Ties and repeated rows: each row is
answered by itself. Null ids stay. Other columns are ignored, whatever their names. Very long texts are taken whole.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .common import table
from .word_arrays import lots, numbered, split_words

MIN_WORDS = 12
SEED = MIN_WORDS // 2
_ODD = np.random.default_rng(11).integers(1 << 62, 1 << 63, SEED + 1, dtype=np.int64).astype(np.uint64) * 2 + 1


def firsts(sorted_values: np.ndarray) -> np.ndarray:
    """Whether a value differs from the one before it."""
    return np.concatenate(([True], sorted_values[1:] != sorted_values[:-1])) if len(sorted_values) else np.zeros(0, bool)


def places_that_pair(x: np.ndarray, doc: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, groups): places whose SEED words occur again in the text, after other words and near enough. x: word numbers,
    ends: where each word's text ends. Equal SEED words have one group; groups are told apart by hashes, so that places with
    unlike words might share one, which costs time and nothing else."""
    at = np.flatnonzero(np.arange(len(x)) + SEED <= ends)
    if not len(at):
        return at, at
    h = doc[at].astype(np.uint64) * _ODD[SEED]
    for j in range(SEED):
        h += x[at + j].astype(np.uint64) * _ODD[j]
    h ^= h >> np.uint64(29)
    order = np.argsort(h)
    new = firsts(h[order])
    order = order[~new | ~np.concatenate((new[1:], [True]))]
    order = order[np.lexsort((order, h[order]))]  # places of a group in order
    place, new = at[order], firsts(h[order])
    if not len(place):
        return place, place
    # words that go on occurring again: no pair of a place is longer than that
    repeats = np.zeros(len(x) + 1, bool)
    repeats[place] = True
    stops = np.flatnonzero(~repeats)
    reach = stops[np.searchsorted(stops, place)] - place + SEED - 1
    left = np.where(place > 0, np.where(doc[place - 1] == doc[place], x[place - 1], -1), -1)
    group, starts = np.cumsum(new) - 1, np.flatnonzero(new)
    mixed = (np.minimum.reduceat(left, starts) != np.maximum.reduceat(left, starts))[group]
    gap = np.diff(place)
    near = np.zeros(len(place), bool)
    near[:-1] |= ~new[1:] & (gap <= reach[:-1])
    near[1:] |= ~new[1:] & (gap <= reach[1:])
    good = mixed & near
    return place[good], group[good]


def suffix_levels(x: np.ndarray, doc: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Ranks by prefix doubling: levels[k] orders the places by their next 2 ** k words within their text, shorter first;
    equal ranks mean equal words. The last level has no equal ranks."""
    n = len(x)
    order = np.lexsort((x, doc))
    new = firsts(doc[order]) | firsts(x[order])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    levels, h = [rank], 1
    tied = order[~(new & np.concatenate((new[1:], [True])))]
    while len(tied):
        rank = levels[-1]
        then = np.where(tied + h < ends[tied], rank[np.minimum(tied + h, n - 1)], -1)
        inner = np.lexsort((then, rank[tied]))
        tied, then = tied[inner], then[inner]
        old = rank[tied]
        outer = firsts(old)
        new = outer | firsts(then)
        count = np.arange(len(tied))
        since = np.maximum.accumulate(np.where(new, count, 0)) - np.maximum.accumulate(np.where(outer, count, 0))
        rank = rank.copy()
        rank[tied] = old + since
        levels.append(rank)
        tied = tied[~(new & np.concatenate((new[1:], [True])))]
        h *= 2
    return levels


def common_words(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words from the places a and b on are equal."""
    n, a, b, total = len(levels[0]), a.copy(), b.copy(), np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        inside = (a < n) & (b < n)
        same = inside & (levels[k][np.minimum(a, n - 1)] == levels[k][np.minimum(b, n - 1)])
        step = np.where(same, 1 << k, 0)
        a, b, total = a + step, b + step, total + step
    return total


def merged(shared: int, kids: list[tuple[list[int], int | None]], left: dict[int, int], found: list[tuple[int, int, int]]) -> tuple[list[int], int | None]:
    """An interval from its parts, each (places in order, their left word or None if they have several). Pairs of places of
    different parts and classes, no farther apart than the words they share, go to found as (start, length, period)."""
    kinds = {kid[1] for kid in kids}
    one = kinds.pop() if len(kinds) == 1 else None
    kids.sort(key=lambda kid: len(kid[0]))
    most, rest = kids[-1][0], kids[:-1]
    if 8 * sum(len(kid[0]) for kid in rest) >= len(most):
        whose = {p: i for i, (places, _) in enumerate(kids) for p in places}
        everything = sorted(whose)
        if one is None:
            for a, b in zip(everything, everything[1:]):
                if b - a <= shared and whose[a] != whose[b] and left[a] != left[b] and shared + b - a >= MIN_WORDS:
                    found.append((a, shared + b - a, b - a))
        return everything, one
    for places, _ in rest:
        at = [bisect_left(most, p) for p in places]
        if one is None:
            for p, k in zip(places, at):
                for a, b in ((most[k - 1], p) if k else (p, p), (p, most[k]) if k < len(most) else (p, p)):
                    if a < b and b - a <= shared and left[a] != left[b] and shared + b - a >= MIN_WORDS:
                        found.append((a, shared + b - a, b - a))
        for p, k in zip(reversed(places), reversed(at)):
            most.insert(k, p)
    return most, one


def maximal_pairs(places: list[int], shared: list[int], left: dict[int, int]) -> list[tuple[int, int, int]]:
    """(start, length, period) of pairs, in suffix order: shared[i] words are common to places i - 1 and i."""
    found: list[tuple[int, int, int]] = []
    stack: list[tuple[int, list]] = []
    for i in range(1, len(places) + 1):
        depth = shared[i] if i < len(places) else -1
        last = ([places[i - 1]], left[places[i - 1]])
        while stack and stack[-1][0] > depth:
            level, kids = stack.pop()
            last = merged(level, [*kids, last], left, found)
        if depth < SEED:
            continue  # nothing that far up is a run
        if stack and stack[-1][0] == depth:
            stack[-1][1].append(last)
        else:
            stack.append((depth, [last]))
    return found


def find_runs(x: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(texts, runs): for each run its text and (start in the text, length, period), by text, start and period."""
    lengths = np.diff(bounds)
    doc, ends = np.repeat(np.arange(len(lengths)), lengths), np.repeat(bounds[1:], lengths)
    seeds, groups = places_that_pair(x, doc, ends)
    none = np.zeros(0, np.int64), np.zeros((0, 3), np.int64)
    if not len(seeds):
        return none
    # suffixes of texts with such places alone
    asked = np.zeros(len(lengths), bool)
    asked[doc[seeds]] = True
    inside = np.flatnonzero(asked[doc])
    moved = np.cumsum(asked[doc]) - 1
    own = moved[seeds]
    x, doc_in, ends_in = x[inside], doc[inside], moved[ends[inside] - 1] + 1
    levels = suffix_levels(x, doc_in, ends_in)
    order = np.argsort(levels[-1][own])
    own = own[order]
    shared = np.concatenate(([-1], common_words(levels, own[:-1], own[1:])))
    before = np.where(own > 0, np.where(doc_in[own - 1] == doc_in[own], x[own - 1], -1), -1)
    found = maximal_pairs(own.tolist(), shared.tolist(), dict(zip(own.tolist(), before.tolist())))
    if not found:
        return none
    runs = np.array(sorted(found), np.int64)
    runs = runs[np.concatenate(([True], (runs[1:, :2] != runs[:-1, :2]).any(axis=1)))]  # the smallest period of a start and length
    texts = doc_in[runs[:, 0]]
    runs[:, 0] = inside[runs[:, 0]] - bounds[texts]
    order = np.lexsort((runs[:, 2], runs[:, 0], texts))
    return texts[order], runs[order]


def analysed(texts: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """(words, runs, collapsed text) of each text."""
    bounds, words = split_words(texts)
    owner, runs = find_runs(numbered(words)[0].astype(np.int64), bounds)
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, bounds[owner] + runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, bounds[owner] + runs[:, 0] + runs[:, 1], -1)
    stays = np.cumsum(edges)[:-1] == 0
    kept = np.concatenate(([0], np.cumsum(stays)))[bounds]
    collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(kept, pa.int32()), words.filter(pa.array(stays))), " ")
    fields = [pa.field(c, pa.int64()) for c in ("start", "length", "period")]
    listed = pa.StructArray.from_arrays([pa.array(runs[:, i]) for i in range(3)], fields=fields)
    counts = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(texts)))))
    return pa.array(np.diff(bounds)), pa.ListArray.from_arrays(pa.array(counts, pa.int32()), listed), collapsed


def periodic_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, runs, collapsed): all runs of each text by start and period, and the text without what they repeat.

    Of a run the first period stays; kept words are joined by one space.
    """
    run = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
    names = ["id", "n_words", "runs", "collapsed"]
    out = T.StructType([T.StructField(c, t) for c, t in zip(names, (df.schema[id_col].dataType, T.LongType(), T.ArrayType(run), T.StringType()))])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in lots(b.column(1)):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), *analysed(b.column(1).slice(lo, hi - lo))], names)

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(part, out)


def with_repeats(text: Column, key: Column) -> Column:
    """The contract's texts: of a tenth of the documents, all words from some place on repeat the first ones from there."""
    words = F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")
    h, n = F.crc32(key.cast("string").cast("binary")), F.size(words).cast("long")
    g = F.floor(h / 10)
    a = g % F.nullif(n, F.lit(0))
    p = 1 + F.floor((n - a) / (3 + g % 8))
    cycle = F.slice(words, (a + 1).cast("int"), p.cast("int"))
    tail = F.slice(F.flatten(F.array_repeat(cycle, F.ceil((n - a) / p).cast("int"))), F.lit(1), (n - a).cast("int"))
    return F.when((h % 10 == 0) & text.isNotNull() & (n > 0), F.array_join(F.concat(F.slice(words, F.lit(1), a.cast("int")), tail), " ")).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of every document, some of which repeat themselves by rule."""
    docs = table(spark, sf_dir, "documents")
    found = periodic_runs(docs.select("doc_id", with_repeats(F.col("text"), F.col("doc_id")).alias("text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    top = found.withColumn("top", best)
    return top.select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), (-F.col("top.start")).alias("start"), F.col("top.length").alias("length"), (-F.col("top.period")).alias("period"),
        F.floor(1000 * F.col("top.length") / -F.col("top.period")).alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
