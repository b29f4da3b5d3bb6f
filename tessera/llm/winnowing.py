"""Benchmark decontamination by winnowing, in DataFrame functions only.

Texts become words; every run of `K` words has a hash; of each window of `W` consecutive hashes the least is kept. A shared
span of K + W - 1 = 13 words has all hashes of some window in common, so its least hash is kept on both sides: joining kept
hashes misses no shared window. Hits are extended: at each matching place the document's words around it are compared with
the whole item window. Items shorter than 13 words are one window; where there are such, the windows of hashes are as small as the
shortest of at least K words needs, and runs of fewer words are looked up for items of fewer words.

Candidates are looked for with Spark's quick lower(); equal words stay equal under it and the bounds of words don't move, so
nothing is missed. The comparison of words itself lower-cases A-Z alone.

Only what a document shares with the items is gathered by document, so a group is no larger than its document. Item
fingerprints are broadcast if a count shows few rows, and joined by shuffle otherwise.

Defined results. Null or empty text: no words, not contaminated. Items without words have no window. Every row has a
result row, repeated rows too. Null ids are ids like any other;
a null item_id is listed as the empty string and counted. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import bounded_broadcast, staged, table

SPAN, K = 13, 5
W = SPAN - K + 1
# What lies between words.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
MAX_BROADCAST_ROWS = 200_000


def quick_words(text: Column) -> Column:
    # the capital sigma is the one letter whose lower case depends on what stands around it
    plain = F.replace(F.coalesce(text, F.lit("")), F.lit("Σ"), F.lit("σ"))
    return F.array_remove(F.split(F.lower(plain), BETWEEN), "")


def exact_words(text: Column) -> Column:
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(lower, BETWEEN), "")


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that later expressions read but never compute anew, as they would inside a lambda after projects
    are merged: an array of one value, exploded, stays a step of its own."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def runs(words: Column, k: int | Column = K) -> Column:
    """Hashes of all runs of k words, in order; null if there are fewer words."""
    k = F.lit(k) if isinstance(k, int) else k
    return F.when(F.size(words) >= k, F.transform(F.sequence(F.lit(1), F.size(words) - k + 1), lambda i: F.xxhash64(F.slice(words, i, k))))


def winnowed(hashes: Column, w: int = W) -> Column:
    """The least hash of each window of w, distinct; of fewer hashes: all."""
    n = F.size(hashes)
    least = F.transform(F.sequence(F.lit(1), n - w + 1), lambda i: F.array_min(F.slice(hashes, i, w)))
    return F.array_distinct(F.when(n >= w, least).otherwise(hashes))


def item_windows(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, window, hash, at, k): each distinct window of an item, the least hash of its runs of k words and its place.

    Hashes are of quick words; windows hold the exact ones. k is K, or the number of words where a window has fewer.
    """
    base = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item_id"), quick_words(F.col(text_col)).alias("q"), exact_words(F.col(text_col)).alias("x"))
    size = F.least(F.lit(SPAN), F.size("x"))
    cut = base.filter(F.size("x") > 0).withColumn("len", size).withColumn("i", F.explode(F.sequence(F.lit(1), F.size("x") - F.col("len") + 1)))
    cut = cut.select("item_id", F.slice("x", F.col("i"), F.col("len")).alias("window"), F.slice("q", F.col("i"), F.col("len")).alias("q"), F.least(F.col("len"), F.lit(K)).alias("k")).distinct()
    hashed = cut.withColumn("h", runs(F.col("q"), F.col("k")))
    return hashed.select("item_id", "window", "k", F.array_min("h").alias("hash"), F.array_position("h", F.array_min("h")).cast("int").alias("at"))


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", max_broadcast: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """(id, n_words, n_hit, n_items, item_ids, text_hash) for each row; the operator's whole result."""
    windows = staged(item_windows(items, item_id, item_text), "windows")
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("th", F.xxhash64("text"))
    lengths = sorted(x.k for x in windows.select("k").distinct().collect())  # at most K of them
    words = once(docs, "q", quick_words(F.col("text"))).select("id", "th", "q")
    # the least hash of a window is the least of any smaller window around it, so windows as small as the shortest item's find
    # all items; runs of fewer than K words, of items that short, may stand anywhere
    least = windows.filter(F.col("k") == K).agg(F.min(F.size("window")).alias("n")).first().n or SPAN
    none = F.array().cast("array<bigint>")
    for k in lengths:
        words = once(words, f"h{k}", F.coalesce(runs(F.col("q"), k), none))
    kept = [winnowed(F.col(f"h{k}"), least - K + 1) if k == K else F.array_distinct(F.col(f"h{k}")) for k in lengths]
    prints = F.concat(*kept) if kept else none
    # the first entry, null, carries the document itself past the join: one generator makes both kinds of rows
    rows = words.select("id", "th", F.size("q").cast("long").alias("n_words"), F.explode(F.concat(F.array(F.lit(None).cast("bigint")), prints)).alias("hash"))
    hashes = windows.select("hash").distinct()
    if hashes.limit(max_broadcast + 1).count() <= max_broadcast:
        met = rows.join(F.broadcast(hashes.withColumn("found", F.lit(True))), "hash", "left").filter(F.col("found") | F.col("hash").isNull())
        found = met.select("id", "th", "n_words", "hash")
    else:  # rows without a hash don't move to where a null would be joined
        found = rows.filter("hash is not null").join(hashes, "hash").select("id", "th", "n_words", "hash").unionByName(rows.filter("hash is null").select("id", "th", "n_words", "hash"))
    per_doc = staged(found.groupBy("id", "th", "n_words").agg(F.collect_set("hash").alias("hashes"), F.count_if(F.col("hash").isNull()).alias("copies")), "hits")
    hit = per_doc.filter(F.size("hashes") > 0).select(F.col("id").alias("hit_id"), F.col("th").alias("hit_th"), "hashes")
    again = docs.join(hit, F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("th") == F.col("hit_th"))).select("id", "th", "text", "hashes")
    again = once(once(again, "q", quick_words(F.col("text"))), "x", exact_words(F.col("text"))).drop("text")
    for k in lengths:
        again = once(again, f"h{k}", F.coalesce(runs(F.col("q"), k), none))
    # places of shared runs, each with the words around it
    around = SPAN - 1
    places = [
        F.transform(
            F.filter(F.transform(F.col(f"h{k}"), lambda h, i: F.struct(h.alias("hash"), (i + 1).alias("p"))), lambda s: F.array_contains("hashes", s["hash"])),
            lambda s: F.struct(s["hash"].alias("hash"), F.lit(k).alias("k"), s["p"].alias("p"), F.greatest(s["p"] - around, F.lit(1)).alias("low"), F.slice("x", F.greatest(s["p"] - around, F.lit(1)), F.lit(2 * SPAN)).alias("near")),
        )
        for k in lengths
    ]
    at = again.select("id", "th", F.explode(F.concat(*places)).alias("s")).select("id", "th", "s.*") if lengths else None
    if at is None:
        return each_row(per_doc).select(F.col("id").alias(id_col), "n_words", F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), F.array().cast("array<string>").alias("item_ids"), F.col("th").alias("text_hash"))
    small = bounded_broadcast(windows, max_broadcast)
    start = F.col("p") - F.col("at") + 1
    extended = at.join(small, ["hash", "k"]).withColumn("start", start).filter(F.col("start") >= 1).filter(F.slice("near", F.col("start") - F.col("low") + 1, F.size("window")) == F.col("window"))
    spans = extended.select("id", "th", "item_id", F.col("start").alias("a"), (F.col("start") + F.size("window")).alias("b"))
    covered = spans.groupBy("id", "th").agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("spans"), F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    count = F.aggregate(
        "spans", F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
        lambda acc, s: F.struct((acc["n"] + F.greatest(s["b"] - F.greatest(s["a"], acc["to"]), F.lit(0))).alias("n"), F.greatest(acc["to"], s["b"]).alias("to")),
        lambda acc: acc["n"],
    )
    hits = covered.select(F.col("id").alias("hit_id"), F.col("th").alias("hit_th"), count.cast("long").alias("n_hit"), "item_ids")
    out = per_doc.join(hits, F.col("id").eqNullSafe(F.col("hit_id")) & F.col("th").eqNullSafe(F.col("hit_th")), "left")
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    return each_row(out).select(F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"), F.col("th").alias("text_hash"))


def each_row(results: DataFrame) -> DataFrame:
    """A result for each row that had the same id and text."""
    return results.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))


def contaminated() -> Column:
    """Whether hits cover at least a twentieth of the words."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without contaminated ones; all columns stay."""
    bad = decontaminate(docs, items, id_col, text_col).filter(contaminated()).select(F.col(id_col).alias("bad_id"), F.col("text_hash").alias("bad_hash"))
    return docs.join(bad, F.col(id_col).eqNullSafe(bad["bad_id"]) & (F.xxhash64(F.col(text_col)) == bad["bad_hash"]), "left_anti")


def op8_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document shares with the benchmark."""
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), contaminated().alias("contaminated"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
bl AS (SELECT item_id, w, least(13, len(w)) AS n FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bl)),
sizes AS (SELECT DISTINCT n FROM win),
grams AS (SELECT row, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT row, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT row, item_id, i, win.n AS n FROM grams JOIN win ON grams.n = win.n AND grams.g = win.g),
cover AS (SELECT row, count(DISTINCT p) AS n_hit FROM (SELECT row, unnest(range(i, i + n)) AS p FROM hits) GROUP BY row),
items AS (SELECT row, count(*) AS n_items, sha256(string_agg(id, ',' ORDER BY id)) AS h FROM (SELECT DISTINCT row, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY row)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(h, sha256('')) AS items_sha256,
coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN cover ON d.row = cover.row LEFT JOIN items ON d.row = items.row
"""
