"""LM scoring with a Brown class-based bigram model.

P(token | before) = P(class | class before) * P(token | class), both smoothed by one. Words are counted over all learning
documents in Spark, and the number of classes grows with the vocabulary (class_number). Classes are found in two steps:

1. Words whose share of the tokens is at least EXCHANGE_SHARE (hence at most 1/EXCHANGE_SHARE words) are assigned one by one
   by exchange clustering; rarer words move with others of their shape, their last SUFFIX bytes and length. A pass is one Spark
   aggregation of how often each class precedes and follows the ids whose turn is next, then a sweep over these. A sweep that
   lowers the measured likelihood is taken back and its ids are halved, as neighbours that move at once chase one another; so
   the likelihood of the kept classes never falls. Passes end when it settles or after ROUNDS.
2. Each rarer word is exchanged by itself, in Spark: its pairs of neighbouring classes are counted as rows by word, and a
   task gives it the class of the highest likelihood under the class counts of step 1, which are broadcast; leaving the class of
   its shape must win more than LEAVE. The result is a table by word that grows with the vocabulary. If the likelihood of
   all learning documents is lower than before, step 2 is taken back.

Scoring: classes and counts of words with a share of at least LOOKUP_SHARE (at most 1/LOOKUP_SHARE words) go to the tasks; what
remains of a document, its distinct rarer words, is joined with the table by word in Spark and gathered by document. So nothing
that grows with the vocabulary is held in one place, and no key of the join holds more than a bounded share of the learning
tokens. Words that no learning document has take the class of their shape.

Defined results. Null or empty text: one token, the end. No learning documents: N = V = 0 and every token has probability
one in either score. Repeated rows: each has its own result and counts as a document. Null ids: held_out is false, the row
is learnt from. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .common import fold, staged, table
from .word_arrays import lots, numbered, split_words, sums

FOLDS, HELD_OUT = 7, 2
LEAST_CLASSES, ROUNDS, TURNS, SHAPES, SUFFIX, LONG = 32, 10, 2, 4096, 3, 15
#: Passes go on while the likelihood's part that the classes decide grows by this share in TURNS of them.
SETTLED = 5e-4
#: What a rarer word must win, in natural logarithms of the likelihood, to leave the class of its shape.
LEAVE = 1.0
#: A rarer word's key: its shape and so many bits of its hash. Words of one key share a class; nothing else depends on it.
KEY_BITS, CLASS_BITS = 27, 12
EXCHANGE_SHARE, LOOKUP_SHARE = 2e-5, 1e-6
FLUSH = 300_000


def words_of(text: str | None) -> list[bytes]:
    """Words: A-Z lower-cased, split at ASCII white space. bytes do just that."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_lots(batches: Iterator[pa.RecordBatch], column: int = 0, **size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, pa.Array]]:
    """(rows, bounds, words) of lots of bounded size: row i has words[bounds[i]:bounds[i + 1]], those of words_of."""
    for b in batches:
        for lo, hi in lots(b.column(column), **size):
            rows = b.slice(lo, hi - lo)
            bounds, words = split_words(pc.ascii_lower(rows.column(column)))
            yield rows, bounds, words.cast(pa.binary())


def bytes_rows(flat: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Rows of bytes, row i being flat[bounds[i]:bounds[i + 1]]."""
    offsets = pa.py_buffer((bounds * flat.itemsize).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, offsets, pa.py_buffer(np.ascontiguousarray(flat))])


def flat_rows(rows: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, flat) of rows of bytes: what bytes_rows packed."""
    if not len(rows):
        return np.zeros(1, np.int64), np.zeros(0, kind)
    _, offsets, data = rows.buffers()
    ends = np.frombuffer(offsets, np.int32)[rows.offset : rows.offset + len(rows) + 1].astype(np.int64)
    flat = np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]].view(kind)
    return (ends - ends[0]) // flat.itemsize, flat


def count_words(texts: DataFrame) -> DataFrame:
    """(word, c). texts: one column. Counted within tasks before the shuffle, in lots of bounded size."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, words in word_lots(batches, lot_bytes=40 * FLUSH):
            number, distinct = numbered(words)
            yield pa.RecordBatch.from_arrays([distinct, pa.array(np.bincount(number, minlength=len(distinct)))], ["word", "c"])

    return texts.mapInArrow(part, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


#: The steps of crc32 for each byte.
CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    CRC = np.where(CRC & 1, CRC >> 1 ^ np.uint32(0xEDB88320), CRC >> 1).astype(np.uint32)


def shapes_of(words: pa.Array) -> np.ndarray:
    """The number of each word's shape: crc32 of its last bytes and its length."""
    ends, data = flat_rows(words, np.uint8)
    length, crc = np.diff(ends), np.full(len(words), 0xFFFFFFFF, np.uint32)
    for k in range(SUFFIX, 0, -1):
        some = np.nonzero(length >= k)[0]
        crc[some] = CRC[(crc[some] ^ data[ends[1:][some] - k]) & 0xFF] ^ crc[some] >> np.uint32(8)
    crc = CRC[(crc ^ np.minimum(length, LONG).astype(np.uint32)) & 0xFF] ^ crc >> np.uint32(8)
    return (~crc % np.uint32(SHAPES)).astype(np.int64)


class Classes:
    """Word ids and their classes. Id 0 is the end, then the exchanged words, then the shapes."""

    def __init__(self, words: list[bytes], classes: int):
        self.words = pa.array(words, pa.binary())
        self.n = 1 + len(words) + SHAPES
        self.classes = classes
        # by rank, so that classes start out alike in size; the end has class 0 for itself
        self.of = np.concatenate([[0], 1 + np.arange(self.n - 1) % (classes - 1)]).astype(np.int64)

    @property
    def ids(self) -> dict[bytes, int]:
        return {w: 1 + i for i, w in enumerate(self.words.to_pylist())}

    def numbers(self, words: pa.Array) -> np.ndarray:
        """The ids of words."""
        out = places_in(words, self.words) + 1
        rare = np.nonzero(out == 0)[0]
        out[rare] = self.n - SHAPES + shapes_of(words.take(pa.array(rare)))
        return out

    def sequence(self, words: list[bytes]) -> list[int]:
        return self.numbers(pa.array(words, pa.binary())).tolist()


def places_in(words: pa.Array, known: pa.Array) -> np.ndarray:
    """Where each word stands in known, -1 if nowhere."""
    return pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def shape(word: str) -> Column:
    """The number of a word's shape, from its last bytes and its length."""
    length = F.unhex(F.lpad(F.hex(F.least(F.octet_length(word), F.lit(LONG)).cast("long")), 2, "0"))
    return (F.crc32(F.concat(F.substring(word, -SUFFIX, SUFFIX), length)) % SHAPES).cast("int")


def encoded(texts: DataFrame, model: Classes) -> DataFrame:
    """(ids): each text's word ids and an end, packed; texts are split into words once for all exchange rounds."""
    shared = texts.sparkSession.sparkContext.broadcast(model)
    kind = np.uint16 if model.n <= 65_536 else np.uint32

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for _, bounds, words in word_lots(batches):
            rows = np.arange(len(bounds))
            flat = np.zeros(len(words) + len(bounds) - 1, kind)
            flat[np.arange(len(words)) + np.repeat(rows[:-1], np.diff(bounds))] = m.numbers(words)
            yield pa.RecordBatch.from_arrays([bytes_rows(flat, bounds + rows)], ["ids"])

    packed = staged(texts.mapInArrow(part, "ids binary"), "ids", "zstd")
    # a pass sends a table of ids and classes from each task, so there are no more tasks than keep the cores busy
    return packed.coalesce(3 * texts.sparkSession.sparkContext.defaultParallelism)


def class_number(v: int) -> int:
    """How many classes a vocabulary of v words has: they grow with its fourth root, so that class pairs grow with its square root."""
    return max(LEAST_CLASSES, round(1.25 * v**0.25))


def neighbours(ids: DataFrame, model: Classes, of: np.ndarray, turn: int, turns: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class pairs, and how often each class precedes and follows each id whose turn it is (ids x classes; other rows are zero)."""
    size, c = model.n, model.classes
    kind = np.uint16 if size <= 65_536 else np.uint32
    shared = ids.sparkSession.sparkContext.broadcast(of)
    names = [f"c{i}" for i in range(c)]
    own = -(-size // turns)  # the most ids that one turn has

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value
        before, after, pairs = np.zeros(own * c, np.int64), np.zeros(own * c, np.int64), np.zeros(c * c, np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                seq = np.frombuffer(b"".join([kind(0).tobytes(), *whole.column(0).slice(at, 1000).to_pylist()]), kind).astype(np.int64)
                cls = of[seq]
                mine = seq % turns == turn
                pairs += np.bincount(cls[:-1] * c + cls[1:], minlength=c * c)
                k = mine[1:]
                before += np.bincount((seq[1:] // turns * c + cls[:-1])[k], minlength=own * c)
                k = mine[:-1]
                after += np.bincount((seq[:-1] // turns * c + cls[1:])[k], minlength=own * c)
        all_rows = np.concatenate([before.reshape(-1, c), after.reshape(-1, c), pairs.reshape(-1, c)])
        used = np.nonzero(all_rows.any(axis=1))[0]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), *(pa.array(all_rows[used, i]) for i in range(c))], ["k", *names])

    schema = T.StructType([T.StructField("k", T.LongType()), *(T.StructField(x, T.LongType()) for x in names)])
    rows = ids.mapInArrow(part, schema).groupBy("k").agg(*[F.sum(x).alias(x) for x in names]).toPandas()  # at most 2 * ids + classes rows
    found = np.zeros((2 * own + c, c))
    found[rows["k"].to_numpy(np.int64)] = rows[names].to_numpy(np.float64)
    before, after = np.zeros((model.n, c)), np.zeros((model.n, c))
    n = len(before[turn::turns])
    before[turn::turns], after[turn::turns] = found[:n], found[own : own + n]
    return found[2 * own :], before, after


def plogp(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def pair_counts(after: np.ndarray, of: np.ndarray, classes: int) -> np.ndarray:
    out = np.zeros((classes, classes))
    np.add.at(out, of, after)
    return out


def likelihood(pairs: np.ndarray) -> float:
    """The part of the log likelihood that depends on the classes."""
    return float(plogp(pairs).sum() - plogp(pairs.sum(axis=1)).sum() - plogp(pairs.sum(axis=0)).sum())


def exchange(before: np.ndarray, after: np.ndarray, of: np.ndarray, classes: int, turn: int = 0, turns: int = 1, pairs: np.ndarray | None = None) -> np.ndarray:
    """One sweep: each id whose turn it is moves to the class of the highest likelihood, given its neighbours' classes.

    What precedes and follows an id is counted by the classes before the sweep, so ids take turns: neighbours that all move
    at once would chase one another. pairs: the class pairs, where after holds only the ids whose turn it is.
    """
    of = of.copy()
    pairs = pair_counts(after, of, classes) if pairs is None else pairs.copy()
    size = np.bincount(of, minlength=classes)
    for w in np.argsort(-after.sum(axis=1), kind="stable"):
        a = of[w]
        if w == 0 or w % turns != turn or size[a] < 2:
            continue
        left, right = before[w], after[w]
        pairs[a] -= right
        pairs[:, a] -= left
        np.maximum(pairs, 0, out=pairs)
        rows, cols = pairs.sum(axis=1), pairs.sum(axis=0)
        gain = (plogp(pairs + right) - plogp(pairs)).sum(axis=1) + (plogp(pairs + left[:, None]) - plogp(pairs)).sum(axis=0)
        gain -= plogp(rows + right.sum()) - plogp(rows) + plogp(cols + left.sum()) - plogp(cols)
        gain[0] = -np.inf
        b = int(gain.argmax())
        if gain[b] <= gain[a] + 1e-9:
            b = a
        pairs[b] += right
        pairs[:, b] += left
        size[a] -= 1
        size[b] += 1
        of[w] = b
    return of


def exchanged(ids: DataFrame, model: Classes, rounds: int) -> tuple[np.ndarray, list[float]]:
    """Step 1: moves model.of to the classes found; their pairs, and the likelihoods of the classes that were kept, which never fall."""
    turn, turns = 0, TURNS
    pairs, before, after = neighbours(ids, model, model.of, turn, turns)
    kept = [likelihood(pairs)]
    for _ in range(rounds):
        of = exchange(before, after, model.of, model.classes, turn, turns, pairs)
        if (of == model.of).all():
            value = kept[-1]
        else:
            then = (turn + 1) % turns
            found = neighbours(ids, model, of, then, turns)
            value = likelihood(found[0])
            if value <= kept[-1]:
                # the half of these ids that has the same remainder by twice the turns; its counts are here already
                turns *= 2
                continue
            model.of, (pairs, before, after), turn = of, found, then
        kept.append(value)
        if len(kept) > TURNS and value - kept[-1 - TURNS] < SETTLED * abs(value) or value == kept[-2]:
            break
    return pairs, kept


def key_of(word: bytes, at: int) -> int:
    return at << KEY_BITS | xxhash.xxh64_intdigest(word, 42) & (1 << KEY_BITS) - 1


def key(word: str) -> Column:
    """key_of as a column."""
    return F.shiftleft(shape(word).cast("long"), KEY_BITS).bitwiseOR(F.xxhash64(word).bitwiseAND((1 << KEY_BITS) - 1))


def moved(learn: DataFrame, model: Classes, pairs: np.ndarray) -> DataFrame:
    """Step 2: (h, cls) of each key of a rarer word."""
    c, first = model.classes, model.n - SHAPES
    fit = pairs + 1.0 / c
    # what a word of class c adds to the log likelihood for one neighbour before it, and for one after it
    left = np.log(fit) - np.log(fit.sum(axis=1, keepdims=True)) - np.log(fit.sum(axis=0))
    right = (np.log(fit) - np.log(fit.sum(axis=1, keepdims=True))).T.copy()
    left[:, 0] = right[:, 0] = -np.inf
    shared = learn.sparkSession.sparkContext.broadcast((model, left, right))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value[0]
        own: list[np.ndarray] = []
        held = 0

        def out() -> pa.RecordBatch:
            k, n = np.unique(np.concatenate([np.zeros(0, np.int64), *own]), return_counts=True)
            low = (1 << 2 * CLASS_BITS) - 1
            return pa.RecordBatch.from_arrays([pa.array(k >> 2 * CLASS_BITS), pa.array((k & low).astype(np.int32)), pa.array(n.astype(np.int64))], ["h", "pair", "n"])

        for _, bounds, words in word_lots(batches):
            seq = m.numbers(words)
            place = 1 + np.arange(len(seq)) + np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            cls = np.zeros(len(seq) + len(bounds), np.int64)  # class 0 stands before, between and after the texts
            cls[place] = m.of[seq]
            at = np.nonzero(seq >= first)[0]
            number, distinct = numbered(words.take(pa.array(at)))
            hashes = np.fromiter((xxhash.xxh64_intdigest(w, 42) & (1 << KEY_BITS) - 1 for w in distinct.to_numpy(zero_copy_only=False)), np.int64, len(distinct))
            h = seq[at] - first << KEY_BITS | hashes[number]
            own.append(h << 2 * CLASS_BITS | cls[place[at] - 1] << CLASS_BITS | cls[place[at] + 1])
            held += len(at)
            if held > 12 * FLUSH:
                yield out()
                own, held = [], 0
        yield out()

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, left, right = shared.value
        for whole in batches:
            for lo in range(0, whole.num_rows, 2000):
                b = whole.slice(lo, 2000)
                lists = b.column(1)
                ends = np.cumsum(lists.value_lengths().to_numpy())
                starts = np.concatenate([[0], ends[:-1]])
                flat = lists.flatten()
                pair, n = flat.field(0).to_numpy().astype(np.int64), flat.field(1).to_numpy()[:, None]
                best = np.empty(b.num_rows, np.int64)
                was = m.of[first + (b.column(0).to_numpy() >> KEY_BITS)]
                cuts = np.unique(np.concatenate([np.searchsorted(ends, np.arange(0, ends[-1], 50_000), "right"), [b.num_rows]]))
                for x, y in zip(np.concatenate([[0], cuts[:-1]]), cuts, strict=True):
                    if x == y:
                        continue
                    part = slice(starts[x], ends[y - 1])
                    value = np.add.reduceat(n[part] * (left[pair[part] >> CLASS_BITS] + right[pair[part] & (1 << CLASS_BITS) - 1]), starts[x:y] - starts[x])
                    value[np.arange(y - x), was[x:y]] += LEAVE
                    best[x:y] = value.argmax(axis=1)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(best.astype(np.int32))], ["h", "cls"])

    counted = learn.mapInArrow(contexts, "h long, pair int, n long").repartition("h").groupBy("h", "pair").agg(F.sum("n").alias("n"))
    # a list has at most classes * classes entries
    return staged(counted.groupBy("h").agg(F.collect_list(F.struct("pair", "n")).alias("pairs")).mapInArrow(choose, "h long, cls int"), "moved")


def sequences(docs: DataFrame, model: Classes, frequent: list[tuple[int, bytes]], ids: int, middle: dict[bytes, int], rare: DataFrame, n_docs: int) -> DataFrame:
    """(id, learn, n_tokens, known, logs, codes): of each document the summed logarithms of c + 1, and its classes, packed.

    middle, rare: the classes of rarer words that the tasks hold, and of those that are joined.
    """
    spark = docs.sparkSession
    code = np.uint8 if model.classes <= 256 else np.uint16
    marked = np.uint8 if model.classes <= 128 else np.uint16
    look = pa.array([w for _, w in frequent], pa.binary())
    later = np.array([model.of[1 + i] if i < ids else middle[w] for i, (_, w) in enumerate(frequent)] + [0], np.int64)
    shared = spark.sparkContext.broadcast((model, look, later, np.log10(np.array([c for c, _ in frequent] + [0], float) + 1), float(np.log10(n_docs + 1)), n_docs > 0))
    fields = [("row", T.LongType()), ("word", T.BinaryType()), ("slot", T.IntegerType()), ("id", docs.schema["id"].dataType), ("learn", T.BooleanType())]
    fields += [("n_tokens", T.LongType()), ("known", T.LongType()), ("logs", T.DoubleType()), ("codes", T.BinaryType()), ("slots", T.BinaryType())]
    schema = T.StructType([T.StructField(k, t) for k, t in fields])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, look, later, logs, end_log, any_end = shared.value
        first, row = m.n - SHAPES, TaskContext.get().partitionId() << 40
        for b, bounds, words in word_lots(batches, 2):
            n, doc = b.num_rows, np.repeat(np.arange(b.num_rows), np.diff(bounds))
            places = places_in(words, look)
            out = np.nonzero(places < 0)[0]
            number, distinct = numbered(words.take(pa.array(out)))
            # each text's classes between two ends; the last bit marks the rarer words
            codes = np.zeros(len(words) + 2 * n, np.int64)
            inner = np.arange(len(words)) + 2 * doc + 1
            codes[inner] = later[places] << 1
            codes[inner[out]] = m.of[first + shapes_of(distinct)][number] << 1 | 1
            # the rarer words of a text in the order in which they first come; a word's slot is its number in its text
            _, at, own = np.unique(doc[out] * max(len(distinct), 1) + number, return_index=True, return_inverse=True)
            order = np.argsort(at)
            rank = np.empty(len(at), np.int64)
            rank[order] = np.arange(len(at))
            own, at = rank[own], at[order]
            of = doc[out[at]]
            slot = np.arange(len(at)) - np.searchsorted(of, np.arange(n))[of]
            # of each rarer word, how far its slot is from the next new one, mostly zero
            newest = np.maximum.accumulate(own)
            back = newest + 1 - np.diff(newest, prepend=-1) - own
            tops = {
                "n_tokens": pa.array(np.diff(bounds) + 1), "known": pa.array(sums(places >= 0, bounds) + any_end),
                "logs": pa.array(np.bincount(doc, weights=logs[places], minlength=n) + end_log),
                "codes": bytes_rows(codes.astype(marked), bounds + 2 * np.arange(n + 1)), "slots": bytes_rows(back.astype(np.int32), np.searchsorted(out, bounds)),
            }
            columns = {"row": pa.array(row + np.concatenate([np.arange(n), of]))}
            columns["word"] = pa.concat_arrays([pa.nulls(n, pa.binary()), distinct.take(pa.array(number[at]))])
            columns["slot"] = pa.concat_arrays([pa.nulls(n, pa.int32()), pa.array(slot.astype(np.int32))])
            for name, i in (("id", 0), ("learn", 1)):
                columns[name] = pa.concat_arrays([b.column(i), pa.nulls(len(at), b.column(i).type)])
            for name, values in tops.items():
                columns[name] = pa.concat_arrays([values, pa.nulls(len(at), values.type)])
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
            row += n

    parts = staged(docs.select("id", "learn", "text").mapInArrow(cut, schema), "sequences", "zstd")
    found = parts.filter(F.col("slot").isNotNull()).select("row", "word", "slot").join(rare, "word")
    found = found.select("row", F.shiftleft(F.col("slot").cast("long"), CLASS_BITS).bitwiseOR(F.col("cls")).alias("cls"), "c")
    # moved as plain rows: lists of one entry each would be several times their size
    found = found.repartition("row").groupBy("row").agg(F.collect_list(F.struct("cls", "c")).alias("found"))
    whole = parts.filter(F.col("slot").isNull()).select("row", *(k for k, _ in fields[3:])).join(found, "row", "left")
    out_fields = T.StructType([T.StructField(k, t) for k, t in fields[3:9]])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bounds, both = flat_rows(b.column("codes"), marked)
            where, back = flat_rows(b.column("slots"), np.int32)
            lists = b.column("found")
            found = np.repeat(np.arange(b.num_rows), lists.value_lengths().fill_null(0).to_numpy())
            flat = lists.flatten()
            cls, c = flat.field(0).to_numpy(), np.log10(flat.field(1).to_numpy() + 1.0)
            # slots are numbered on from text to text
            fresh = np.concatenate([[0], np.cumsum(back == 0)])
            slot = fresh[:-1] - back
            at = fresh[where[:-1]][found] + (cls >> CLASS_BITS)
            by_slot, log_of = np.full(fresh[-1], -1, np.int64), np.zeros(fresh[-1])
            by_slot[at], log_of[at] = cls & (1 << CLASS_BITS) - 1, c
            own, rare = (both >> 1).astype(code), np.nonzero(both & 1)[0]
            seen = by_slot[slot] >= 0
            own[rare[seen]] = by_slot[slot[seen]]
            doc = np.repeat(np.arange(b.num_rows), np.diff(where))
            known = b.column("known").to_numpy() + sums(seen, where)
            logs = b.column("logs").to_numpy() + np.bincount(doc, weights=log_of[slot], minlength=b.num_rows)
            columns = {"known": pa.array(known), "logs": pa.array(logs), "codes": bytes_rows(own, bounds)}
            yield pa.RecordBatch.from_arrays([columns[k] if k in columns else b.column(k) for k in out_fields.names], out_fields.names)

    return staged(whole.select(*out_fields.names, "slots", "found").mapInArrow(fill, out_fields), "classed")


def learnt_pairs(classed: DataFrame, c: int) -> np.ndarray:
    """Class pairs of the learning documents after step 2."""
    code = np.uint8 if c <= 256 else np.uint16

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.zeros(c * c, np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                seq = np.frombuffer(b"".join(whole.column(0).slice(at, 1000).to_pylist()), code).astype(np.int64)
                # a document begins and ends with class 0, which no word has: where two stand together, a document begins
                both = seq[:-1] * c + seq[1:]
                inside = np.ones(len(both), bool)
                inside[np.cumsum([len(x) // code().nbytes for x in whole.column(0).slice(at, 1000).to_pylist()])[:-1] - 1] = False
                pairs += np.bincount(both[inside], minlength=c * c)
        used = np.nonzero(pairs)[0]
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(pairs[used])], ["k", "n"])

    out = np.zeros(c * c)
    for r in classed.filter("learn").select("codes").mapInArrow(part, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():  # classes * classes at most
        out[r.k] = r.n
    return out.reshape(c, c)


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", classes: int | None = None, rounds: int = ROUNDS) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) of each row."""
    spark = df.sparkSession
    held = F.coalesce(fold(FOLDS, "id") == HELD_OUT, F.lit(False))
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("learn", ~held)
    learn = docs.filter("learn").select("text")
    counts = staged(count_words(learn), "counts")
    n_docs = learn.count()
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n, v = total.n + n_docs, total.v + (n_docs > 0)
    share = F.col("c") / F.lit(float(max(n, 1)))
    often = counts.filter(share >= LOOKUP_SHARE).select("c", "word").toArrow()  # at most 1 / LOOKUP_SHARE
    frequent = sorted(zip(often["c"].to_pylist(), often["word"].to_pylist(), strict=True), key=lambda x: (-x[0], x[1]))
    n_ids = sum(c / max(n, 1) >= EXCHANGE_SHARE for c, _ in frequent)
    model = Classes([w for _, w in frequent[:n_ids]], classes or class_number(v))
    c = model.classes
    pairs, _ = exchanged(encoded(learn, model), model, rounds)
    old_of_shape = F.element_at(F.array(*map(F.lit, model.of[model.n - SHAPES :].tolist())), shape("word") + 1).cast("int")
    rarer = counts.filter(share < EXCHANGE_SHARE).withColumn("h", key("word")).withColumn("old", old_of_shape)
    rarer = rarer.join(moved(learn, model, pairs), "h", "left").select("word", "c", "old", F.coalesce("cls", "old").alias("cls"))
    rarer = staged(rarer, "rarer")

    def classed_by(cls: str) -> DataFrame:
        found = rarer.filter(share >= LOOKUP_SHARE).select("word", cls).toArrow()  # at most 1 / LOOKUP_SHARE
        middle = dict(zip(found["word"].to_pylist(), found[cls].to_pylist(), strict=True))
        return sequences(docs, model, frequent, n_ids, middle, rarer.filter(share < LOOKUP_SHARE).select("word", "c", F.col(cls).alias("cls")), n_docs)

    classed = classed_by("cls")
    after = learnt_pairs(classed, c)
    new = likelihood(after) >= likelihood(pairs)
    if new:
        pairs = after
    else:
        classed = classed_by("old")
    # tokens and distinct words of each class
    tokens, kinds = np.zeros(c), np.zeros(c)
    tokens[0], kinds[0] = n_docs, n_docs > 0
    for i, (k, _) in enumerate(frequent[:n_ids]):
        tokens[model.of[1 + i]] += k
        kinds[model.of[1 + i]] += 1
    for r in rarer.groupBy(F.col("cls" if new else "old").alias("k")).agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():  # a row for each class
        tokens[r.k] += r.c
        kinds[r.k] += r.n
    step = np.log10((pairs + 1) / (pairs.sum(axis=1, keepdims=True) + c))
    below = np.log10(tokens + kinds + 1)
    if not n_docs:
        step, below = np.zeros_like(step), np.zeros_like(below)
    shared = spark.sparkContext.broadcast((step, below))
    code = np.uint8 if c <= 256 else np.uint16
    out = T.StructType([T.StructField("id", docs.schema["id"].dataType), *(T.StructField(k, t) for k, t in (("n_tokens", T.LongType()), ("n_known", T.LongType()), ("logs", T.DoubleType()), ("score", T.DoubleType())))])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, below = shared.value
        for b in batches:
            bounds, cls = flat_rows(b.column(4), code)
            doc = np.repeat(np.arange(b.num_rows), np.diff(bounds) - 1)
            after = np.ones(len(cls), bool)
            after[bounds[:-1]] = False  # a document's first code is the end before it
            at = np.nonzero(after)[0]
            own = b.column(3).to_numpy() + np.bincount(doc, weights=step[cls[at - 1], cls[at]] - below[cls[at]], minlength=b.num_rows)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), pa.array(own, pa.float64())], out.names)

    scored = classed.select("id", "n_tokens", "known", "logs", "codes").mapInArrow(part, out)
    base_below = math.log10(n + v + 1) if n_docs else 0.0
    return scored.select(
        F.col("id").alias(id_col), held.alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * F.lit(base_below)).alias("base_score"), "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )


def op7_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document."""
    return score(table(spark, sf_dir, "documents"))
