"""Small helpers that the operators of this package share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_own_dir: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; a folder of ours where that is unset, in local mode alone."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    key = spark.sparkContext.applicationId
    if key not in _own_dir:
        _own_dir[key] = "file://" + tempfile.mkdtemp(prefix="tessera-")
    return _own_dir[key]


def staged(df: DataFrame, tag: str, codec: str = "snappy") -> DataFrame:
    """Write df once to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}-{tag}"
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """df with a broadcast hint if it has at most max_rows rows (counted), else df as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


HOT_KEY_SHARE = 1 / 1000


def join_sums(rows: DataFrame, sums: DataFrame, key: str, total: int) -> DataFrame:
    """rows with the sums of their key (an inner join; sums: key, n, ...), in which no key gathers in one task.

    Sums of keys that more than HOT_KEY_SHARE of the total rows have, 1/HOT_KEY_SHARE at most, are broadcast; the rest is
    joined by shuffle.
    """
    hot = F.broadcast(sums.filter(F.col("n") > total * HOT_KEY_SHARE))
    rest = rows.join(hot.select(key), key, "left_anti").join(sums.filter(F.col("n") <= total * HOT_KEY_SHARE), key)
    return rows.join(hot, key).unionByName(rest)


def fold(mod: int, key: str = "doc_id") -> Column:
    """crc32 of the key as text, modulo mod."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % mod
