"""Importance resampling towards a target: the documents that look most like another table, drawn with noise.

Words of all texts fall into BUCKETS by their checksum. A bucket's gain is the logarithm of how much more often the target's
words fall into it than the source's; a text's weight is the sum of gains over its words, taken from one array. Weight plus
Gumbel noise, a function of the document's id alone, is its score, and the highest scores are a weighted draw without
replacement.

1. Counts: each task adds its words to one array of BUCKETS numbers; Spark adds these up by bucket.
2. Scores: the array of gains (BUCKETS numbers, whatever the input) goes to all tasks. Scores are written once.
3. Cutoff: jobs over the written scores count exactly how many reach a threshold, and the range of thresholds is halved, STEPS
   halvings a job, until one is left; among documents with just that score the ids are halved in the same way.
4. Ranks: rows above the cutoff are range-partitioned by score and id and numbered side by side.

No rows are sorted but those drawn, none reach the driver, and no task has more than a range of them.

Defined results. Null and empty texts: no words, weight 0, never drawn where a minimum of words is asked for. Ties: the smaller
id first. Repeated rows each count and are drawn by themselves; if the cutoff falls among rows of one score and id, some of these are
drawn, alike as they are in all but possibly their text. Null ids come last among ties and take the noise of the id "null".
Empty tables: no rows; an empty target has no counts. Other columns are ignored, whatever their names. Very long texts are read
whole. Ids are integers.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .common import staged, table
from .word_arrays import lots, numbered, split_letters, sums

BUCKETS, SEED, MIN_WORDS, SHARE = 10_000, 2024, 20, 10
STEPS = 4
LAST_ID = (1 << 63) - 1


def buckets_of(texts: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, bucket of each word)."""
    bounds, words = split_letters(texts)
    at, distinct = numbered(words)
    own = np.fromiter((zlib.crc32(w) % buckets for w in distinct.cast(pa.binary()).to_pylist()), np.int64, len(distinct))
    return bounds, own[at]


def bucket_counts(df: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How many words of all texts fall into each bucket."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for lo, hi in lots(b.column(0)):
                total += np.bincount(buckets_of(b.column(0).slice(lo, hi - lo), buckets)[1], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    rows = df.select(text_col).mapInArrow(part, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # at most one row a bucket
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r.bucket] = r.n
    return out


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of how much likelier each bucket is in the target, each count raised by one."""
    s, t, n = int(source.sum()), int(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log((b + 1) * (s + n) / ((a + 1) * (t + n)))) for a, b in zip(source.tolist(), target.tolist())], np.int64)


def noise(key: Column, seed: int) -> Column:
    """floor(1000 x Gumbel noise) of an id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def weights(df: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_features, weight) of each row."""
    out = T.StructType([T.StructField("id", df.schema[id_col].dataType), T.StructField("n_features", T.LongType()), T.StructField("weight", T.LongType())])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in lots(b.column(1)):
                bounds, own = buckets_of(b.column(1).slice(lo, hi - lo), len(gains))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(np.diff(bounds)), pa.array(sums(gains[own], bounds))], out.names)

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(part, out)


def halved(low: int, high: int, count: Callable[[list[int]], list[int]], most: int, steps: int = STEPS) -> int:
    """The least threshold in low..high + 1 that at most `most` rows lie beyond. count(thresholds) tells how many do; it falls as
    thresholds rise, and none lie beyond high + 1. Each call has the middles that `steps` halvings may come by."""
    high += 1
    while low < high:
        middles, ranges = set(), [(low, high)]
        for _ in range(steps):
            middles |= {(a + b) // 2 for a, b in ranges if a < b}
            ranges = [x for a, b in ranges if a < b for x in ((a, (a + b) // 2), ((a + b) // 2 + 1, b))]
        asked = sorted(middles)
        beyond = dict(zip(asked, count(asked)))
        for _ in range(steps):
            if low < high:
                middle = (low + high) // 2
                low, high = (low, middle) if beyond[middle] <= most else (middle + 1, high)
    return low


def counts_beyond(rows: DataFrame, beyond: Callable[[int], Column]) -> Callable[[list[int]], list[int]]:
    return lambda asked: list(rows.agg(*[F.count_if(beyond(x)).alias(f"c{i}") for i, x in enumerate(asked)]).first())


def draw(scored: DataFrame, amount: int) -> DataFrame:
    """scored (id, score, may_be_drawn, ...; written once) with rank: 1, 2, ... for the amount of rows with the highest scores, smaller
    ids first among equals, null for the rest."""
    unranked = scored.withColumn("rank", F.lit(None).cast("long"))
    able = scored.filter("may_be_drawn")
    ends = able.agg(F.min("score").alias("low"), F.max("score").alias("high")).first()
    if ends.low is None or amount <= 0:
        return unranked
    # rows of this score or more are too many, or just enough, or there are no more
    score = halved(ends.low - 1, ends.high, counts_beyond(able, lambda x: F.col("score") > x), amount)
    above = able.filter(F.col("score") > score).count()
    tied = able.filter(F.col("score") == score)
    key = F.coalesce("id", F.lit(LAST_ID))
    span = tied.agg(F.min(key).alias("low"), F.max(key).alias("high"), F.count("*").alias("n")).first()
    last = LAST_ID
    if span.n and above + span.n > amount:
        # the smallest id up to which there are enough: thresholds are taken from the far end, so that counts fall
        want = amount - above
        last = halved(span.low, span.high, counts_beyond(tied, lambda x: key > x), span.n - want)
    drawn = F.col("may_be_drawn") & ((F.col("score") > score) | ((F.col("score") == score) & (key <= last)))
    order = [F.col("score").desc(), key.asc()]
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    ranged = staged(scored.filter(drawn).repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"__part": F.spark_partition_id(), "__place": place}), "drawn")
    before, total = {}, 0
    for r in sorted(ranged.groupBy("__part").count().collect()):  # a row for each range
        before[r[0]], total = total, total + r[1]
    offsets = scored.sparkSession.createDataFrame(sorted(before.items()) or [(0, 0)], "__part int, __before long")
    rank = F.col("__before") + F.col("__place") + 1
    ranked = ranged.join(F.broadcast(offsets), "__part").withColumn("rank", F.when(rank <= amount, rank).cast("long"))
    return ranked.select(*unranked.columns).unionByName(unranked.filter(~F.coalesce(drawn, F.lit(False))))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", share: int = SHARE, min_words: int = MIN_WORDS, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """(id, n_features, weight, score, rank) of each row; the `share` per cent with the highest scores of those of min_words or more have a
    rank."""
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} must be an integer")
    gains = gains_of(bucket_counts(docs, text_col, buckets), bucket_counts(target, target_text, buckets))
    weighed = weights(docs, gains, id_col, text_col).withColumn("score", F.col("weight") + noise(F.col("id"), seed))
    scored = staged(weighed.withColumn("may_be_drawn", F.col("n_features") >= min_words), "scores")
    amount = share * scored.filter("may_be_drawn").count() // 100
    return draw(scored, amount).drop("may_be_drawn")


def op13_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents, drawn towards the benchmark."""
    out = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


ORACLE = r"""
WITH RECURSIVE crc(k, b, v) AS (SELECT 0, i, i FROM range(256) t(i) UNION ALL SELECT k + 1, b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM crc WHERE k < 8),
tab AS (SELECT list(v ORDER BY b) AS tab FROM crc WHERE k = 8),
split AS (SELECT 's' AS side, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM documents
UNION ALL SELECT 't', NULL, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') FROM benchmark),
rows AS (SELECT side, doc_id, row_number() OVER () AS r, ws FROM split),
words AS (SELECT side, r, unnest(ws) AS w FROM rows),
hexed AS (SELECT w, hex(encode(w)) AS h FROM (SELECT DISTINCT w FROM words)),
bytes AS (SELECT w, list_transform(range(len(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)) AS bs FROM hexed),
bucket AS (SELECT w, xor(list_reduce(bs, lambda c, x: xor(tab[xor(c & 255, x) + 1], c >> 8), CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT)) % 10000 AS b FROM bytes, tab),
counts AS (SELECT b, count(*) FILTER (side = 's') AS s, count(*) FILTER (side = 't') AS t FROM words JOIN bucket USING (w) GROUP BY b),
totals AS (SELECT sum(s) AS s, sum(t) AS t FROM counts),
gains AS (SELECT b, CAST(floor(1000 * ln(CAST((c.t + 1) * (n.s + 10000) AS DOUBLE) / CAST((c.s + 1) * (n.t + 10000) AS DOUBLE))) AS BIGINT) AS gain FROM counts c, totals n),
weighed AS (SELECT r, sum(gain) AS weight FROM words JOIN bucket USING (w) JOIN gains USING (b) WHERE side = 's' GROUP BY r),
scored AS (SELECT doc_id, r, CAST(len(ws) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM rows LEFT JOIN weighed USING (r) WHERE side = 's'),
placed AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN CAST(rank AS BIGINT) END AS rank FROM scored LEFT JOIN placed USING (r)
"""
