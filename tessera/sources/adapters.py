"""The given tables in the catalogue's shape: documents become files, events become a journal.

Each adapter exists twice, as DataFrame expressions and as SQL for the oracle; both follow the same formulas.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.index import COLUMNS, FILES, prune, upsert, write_generation
from ..operators.model import Everywhere
from ..operators.staging import folder
from ..operators.store import Generation, Store

MAC_KINDS = "CASE ext WHEN 'jpg' THEN 'jpeg-scan-v1' WHEN 'png' THEN 'png-idat-v1' WHEN 'webp' THEN 'webp-chunk-v1' WHEN 'heic' THEN 'heic-item-v1' END"
#: Expressions that both engines read alike; {sha} is the text's hex SHA-256.
SHARED = {
    "id": "i + 1",
    "size": "CAST(n_chars AS BIGINT)",
    "mtime": "CAST(1700000000 + 60 * i + 0.125 * (i % 8) AS DOUBLE)",
    "device": "CAST(1 + i % 2 AS BIGINT)",
    "inode": "CAST(i + 1000 AS BIGINT)",
    "volume_uuid": "CASE i % 3 WHEN 1 THEN 'VOL-A' WHEN 2 THEN 'VOL-B' END",
    "width": "CASE WHEN i % 11 <> 0 THEN CAST(200 + (37 * i) % 4000 AS INT) END",
    "height": "CASE WHEN i % 11 = 0 THEN NULL WHEN i % 97 = 1 THEN 0 ELSE CAST(150 + (53 * i) % 3000 AS INT) END",
    "capture_time": "CASE WHEN i % 7 <> 0 THEN CAST(1500000000 + (7919 * i) % 100000000 AS DOUBLE) END",
    "capture_offset": "CASE i % 4 WHEN 0 THEN '-05:00' WHEN 1 THEN '+00:00' WHEN 3 THEN '+5:30' END",
    "camera_make": "CASE i % 9 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 5 THEN 'CANON' WHEN 6 THEN 'Nikon' WHEN 7 THEN 'Apple' WHEN 8 THEN 'É-Cam' ELSE 'Canon' END",
    "camera_model": "CASE i % 5 WHEN 0 THEN NULL WHEN 1 THEN 'EOS R5' WHEN 2 THEN 'eos r5' ELSE 'T1' END",
    "orientation": "CAST(1 + i % 8 AS INT)",
    "hashed_at": "CASE WHEN i % 10 <> 3 THEN CAST(1750000000 AS DOUBLE) END",
    "indexed_at": "CAST(1750000000 AS DOUBLE)",
}
EXT = "CASE {first} % 6 WHEN 0 THEN 'jpg' WHEN 1 THEN 'png' WHEN 2 THEN 'heic' WHEN 3 THEN 'webp' WHEN 4 THEN 'cr2' ELSE 'tiff' END"
PARENT = "concat(CASE WHEN i % 50 = 0 THEN '/LIB/' ELSE '/lib/' END, source, '/', lang)"
NAME = "concat(CASE WHEN i % 2 = 0 THEN 'IMG_' ELSE 'img-' END, lang, '-', lpad(CAST(i AS STRING), CAST(greatest(6, length(CAST(i AS STRING))) AS INT), '0'), '.', ext)"


#: Index folders that this application has written, and libraries it has published, by the state of the documents they come from.
_generations: dict[tuple, str] = {}
_libraries: dict[tuple, list[Generation]] = {}


def state_of(spark: SparkSession, path: str) -> tuple:
    """(name, size, time) of a table's files: changes whenever its rows may have."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)
    return tuple(sorted((x.getPath().getName(), x.getLen(), x.getModificationTime()) for x in found))


def files(spark: SparkSession, sf_dir: str, with_phash: bool = False, fresh: bool = False) -> DataFrame:
    """The catalogue's index over documents: written once for each application and state of the documents, laid out by path, so scopes
    and predicates prune. fresh: written again."""
    key = (spark.sparkContext.applicationId, sf_dir, with_phash, state_of(spark, f"{sf_dir}/documents.parquet"))
    if fresh or key not in _generations:
        _generations[key] = write_generation(derived(spark, sf_dir, with_phash), f"{folder(spark)}/index-{uuid.uuid4().hex}", 1)
    return spark.read.schema(FILES).parquet(_generations[key])


def library(spark: SparkSession, sf_dir: str, number: int = 1) -> tuple[DataFrame, DataFrame]:
    """(files, postings) of a published generation: 1 has all files, in 2 what a later walk found is merged, in 3 the rest is pruned."""
    key = (spark.sparkContext.applicationId, sf_dir, state_of(spark, f"{sf_dir}/documents.parquet"))
    if key not in _libraries:
        _libraries[key] = [Generation()]
        _generations[key] = f"{folder(spark)}/library-{uuid.uuid4().hex}"
    store, made = Store(spark, _generations[key]), _libraries[key]
    while len(made) <= number:
        old, walked = store.files(made[-1]), next_generation(files(spark, sf_dir))
        rows = (lambda: files(spark, sf_dir), lambda: upsert(old, walked), lambda: prune(old, walked, Everywhere()))[len(made) - 1]()
        made.append(store.commit(made[-1], rows))
    return store.files(made[number]), store.postings(made[number])


def derived(spark: SparkSession, sf_dir: str, with_phash: bool = False) -> DataFrame:
    """The rows of the index. phash is null unless asked for, as it reads every word."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("i"), "text", "lang", "source", "n_chars")
    base = docs.withColumn("sha", F.sha2("text", 256)).withColumn("ext", F.expr(EXT.format(first="CAST(conv(substr(sha, 1, 2), 16, 10) AS INT)")))
    base = base.withColumn("parent_dir", F.expr(PARENT)).withColumn("name", F.expr(NAME)).withColumn("image_hash_kind", F.expr(f"CASE WHEN i % 10 <> 3 THEN {MAC_KINDS} END"))
    own = {c: F.expr(e) for c, e in SHARED.items()} | {
        "path": F.concat("parent_dir", F.lit("/"), "name"),
        "content_hash": F.expr("CASE WHEN i % 10 <> 3 THEN sha2(concat(text, CASE WHEN i % 2 = 0 THEN '' ELSE '#edited' END), 256) END"),
        "image_hash": F.when(F.col("image_hash_kind").isNotNull(), F.sha2(F.concat("image_hash_kind", F.lit(":"), "text"), 256)),
    }
    if not with_phash:
        return base.select(*[own.get(c, F.lit(None).cast("string") if c == "phash" else F.col(c)).alias(c) for c in COLUMNS])
    known = base.select("i", *[own.get(c, F.col(c)).alias(c) for c in COLUMNS if c != "phash"])  # before the join, so that texts don't move
    return known.join(word_phash(docs), "i", "left").select(*COLUMNS)


def word_phash(docs: DataFrame) -> DataFrame:
    """(i, phash): a one-bit min-hash over 64 buckets of a text's distinct words. A text's minima are found in its own row, so 64 numbers
    of it move, and not its words; rows that repeat an i count as one text."""
    number = lambda m, a, n: F.conv(F.substring(m, a, n), 16, 10).cast("long")
    placed = lambda m: F.shiftleft(number(m, 1, 2) % 64, 32).bitwiseOR(number(m, 3, 8))  # noqa: E731  the bucket above the value
    words = F.filter(F.array_distinct(F.split(F.lower("text"), r"\s+")), lambda w: w != "")
    rows = least(docs.select("i", F.transform(F.transform(words, F.md5), placed).alias("m")))
    merged = least(rows.groupBy("i").agg(F.flatten(F.collect_list("m")).alias("m")))
    bits = lambda low: F.aggregate(F.filter("m", lambda x: (x < 1 << 37) == F.lit(low)), F.lit(0).cast("long"), lambda s, x: s + F.call_function("shiftleft", x % 2, (F.shiftright(x, 32) % 32).cast("int")))
    hexed = lambda c: F.lower(F.lpad(F.hex(c), 8, "0"))
    value = F.when(F.size("m") == 0, None).when(F.col("i") == 5, "not-a-hash").when(F.col("i") % 10 != 3, F.concat(hexed(bits(False)), hexed(bits(True))))
    return merged.select("i", value.alias("phash"))


def least(rows: DataFrame) -> DataFrame:
    """rows (i, m) with the least number of each bucket left in m."""
    ordered, bucket = rows.select("i", F.sort_array("m").alias("m")), lambda x: F.shiftright(x, 32)
    first = F.zip_with("m", F.concat(F.array(F.lit(-1).cast("long")), "m"), lambda x, before: F.when(bucket(x) != bucket(before), x))
    return ordered.select("i", F.array_compact(first).alias("m"))


def _duck(text: str) -> str:
    return text.replace("AS STRING", "AS VARCHAR")


FILES_SQL = f"""docs AS (SELECT doc_id AS i, text, lang, source, n_chars, sha256(text) AS sha FROM documents),
docs2 AS (SELECT *, {EXT.format(first="CAST(('0x' || substr(sha, 1, 2)) AS INTEGER)")} AS ext FROM docs),
files AS (SELECT {", ".join(f"{_duck(e)} AS {c}" for c, e in SHARED.items())}, ext, {PARENT} AS parent_dir, {_duck(NAME)} AS name, concat({PARENT}, '/', {_duck(NAME)}) AS path,
CASE WHEN i % 10 <> 3 THEN sha256(concat(text, CASE WHEN i % 2 = 0 THEN '' ELSE '#edited' END)) END AS content_hash,
CASE WHEN i % 10 <> 3 THEN {MAC_KINDS} END AS image_hash_kind,
CASE WHEN i % 10 <> 3 AND {MAC_KINDS} IS NOT NULL THEN sha256(concat({MAC_KINDS}, ':', text)) END AS image_hash FROM docs2)"""

PHASH_SQL = """words AS (SELECT i, md5(w) AS m FROM (SELECT i, unnest(list_distinct(regexp_split_to_array(lower(text), '\\s+'))) AS w FROM docs) WHERE w <> ''),
low AS (SELECT i, CAST(('0x' || substr(m, 1, 2)) AS BIGINT) % 64 AS bucket, min(CAST(('0x' || substr(m, 3, 8)) AS BIGINT)) AS v FROM words GROUP BY ALL),
halves AS (SELECT i + 1 AS pid, CAST(sum(CASE WHEN bucket < 32 THEN (v % 2) << (bucket % 32) ELSE 0 END) AS BIGINT) AS lo, CAST(sum(CASE WHEN bucket >= 32 THEN (v % 2) << (bucket % 32) ELSE 0 END) AS BIGINT) AS hi FROM low WHERE i % 10 <> 3 GROUP BY i)"""


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a journal: a batch per user and day; kinds and states by fixed rules."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select(*[F.expr(e).alias(c) for c, e in JOURNAL.items()])


# one state a batch now and then, so that every refusal occurs
JOURNAL = {
    "op_id": "event_id",
    "batch_id": "concat('b', CAST(user_id AS STRING), '-', CAST(date_part('day', ts) AS STRING))",
    "kind": "CASE WHEN event_type = 'error' AND event_id % 5 = 0 THEN 'delete' WHEN event_type IN ('view', 'signup') THEN 'move' WHEN event_type = 'click' THEN 'copy' WHEN event_type = 'purchase' AND event_id % 50 = 1 THEN 'shred' ELSE 'trash' END",
    "src": "concat('/lib/src', CAST(event_id % 20 AS STRING), '/f', CAST(event_id % 700 AS STRING), '.jpg')",
    "dst": "CASE WHEN event_type IN ('view', 'signup', 'click') AND event_id % 37 <> 0 OR event_id % 11 = 3 THEN concat('/out/f', CAST(event_id % 500 AS STRING), '.jpg') END",
    "trash_url": "CASE WHEN event_id % 6 = 0 THEN concat('/trash/', CAST(event_id AS STRING)) END",
    "timestamp": "CAST(1704067200 + (event_id * 7200) % 6000000 AS DOUBLE)",
    "state": "CASE WHEN user_id % 7 = 0 AND event_id % 3 = 0 THEN 'in_flight' WHEN user_id % 7 = 1 AND event_id % 4 = 0 THEN 'failed' WHEN user_id % 7 = 2 AND event_id % 4 = 0 THEN 'reconciled' WHEN user_id % 7 = 3 THEN 'skipped' WHEN event_id % 211 = 0 THEN 'lost' ELSE 'complete' END",
}
JOURNAL_SQL = f"journal AS (SELECT {', '.join(f'{_duck(e)} AS {c}' for c, e in JOURNAL.items())} FROM events)"


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What exists on disk, for journal reconcile: places that the journal names, present or changed by a rule on the name."""
    j = journal(spark, sf_dir)
    named = j.select("src").unionByName(j.select(F.col("dst").alias("src"))).unionByName(j.select(F.col("trash_url").alias("src"))).filter("src is not null").distinct()
    return named.select(F.col("src").alias("path")).selectExpr(*FACTS).filter("there").drop("there")


NUM = "CAST(concat('0', regexp_replace({p}, '[^0-9]', ''{g})) AS BIGINT)"
_n, _ng = NUM.format(p="path", g=""), NUM.format(p="path", g=", 'g'")
FACTS = ["path", f"1000 + {_n} % 3 AS size", f"CAST(1700000000 + {_n} % 5 AS DOUBLE) AS mtime", f"{_n} AS inode", f"{_n} % 4 <> 1 AS there"]
KNOWN = ["path", f"1000 + {_n} % 2 AS size", f"CAST(1700000000 + {_n} % 4 AS DOUBLE) AS mtime", f"{_n} AS inode", f"{_n} % 5 <> 2 AS there"]
FACTS_SQL = f"""named AS (SELECT DISTINCT src AS path FROM (SELECT src FROM journal UNION ALL SELECT dst FROM journal UNION ALL SELECT trash_url FROM journal) WHERE src IS NOT NULL),
facts AS (SELECT {", ".join(x.replace(_n, _ng) for x in FACTS)} FROM named WHERE {_ng} % 4 <> 1),
known AS (SELECT {", ".join(x.replace(_n, _ng) for x in KNOWN)} FROM named WHERE {_ng} % 5 <> 2)"""


def known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the catalogue has of the journal's places."""
    j = journal(spark, sf_dir)
    named = j.select("src").unionByName(j.select(F.col("dst").alias("src"))).unionByName(j.select(F.col("trash_url").alias("src"))).filter("src is not null").distinct()
    return named.select(F.col("src").alias("path")).selectExpr(*KNOWN).filter("there").drop("there")


def next_generation(index: DataFrame) -> DataFrame:
    """What a later walk finds: some files gone, some changed, some new."""
    i = F.col("id") - 1
    seen = index.filter(i % 17 != 0)
    changed = i % 13 == 0
    out = seen.withColumn("mtime", F.when(changed, F.col("mtime") + 1).otherwise(F.col("mtime"))).withColumn("volume_uuid", F.when(i % 4 == 0, F.lit(None)).otherwise(F.lit("VOL-B")).cast("string"))
    moved = F.when(i % 19 == 0, F.concat(F.lit("/new"), F.col("path"))).otherwise(F.col("path"))
    return out.withColumn("path", moved).withColumn("width", F.when(changed, 1).otherwise(F.col("width")))


NEXT_SQL = """walked AS (SELECT * REPLACE (CASE WHEN (id - 1) % 13 = 0 THEN mtime + 1 ELSE mtime END AS mtime, CASE WHEN (id - 1) % 4 <> 0 THEN 'VOL-B' END AS volume_uuid,
CASE WHEN (id - 1) % 19 = 0 THEN concat('/new', path) ELSE path END AS path, CASE WHEN (id - 1) % 13 = 0 THEN 1 ELSE width END AS width) FROM files WHERE (id - 1) % 17 <> 0)"""
