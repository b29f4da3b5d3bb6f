"""The tree walk: files below a root as rows, with what was skipped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..operators.staging import written
from .media import OPAQUE, extension, in_opaque_bundle, is_junk, media_kind


def listing(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """(path, size, mtime) of the files below root, without reading their content."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    path = F.regexp_replace(F.col("path"), r"^[a-z0-9]+:/+", "/")
    return found.select(path.alias("path"), F.col("length").alias("size"), (F.unix_micros("modificationTime") / 1e6).alias("mtime"))


def split_path(path: Column) -> dict[str, Column]:
    """parent_dir, name and ext of a path."""
    name = F.substring_index(path, "/", -1)
    parent = F.regexp_replace(F.regexp_replace(path, r"/[^/]*$", ""), r"^$", "/")
    return {"parent_dir": parent, "name": name, "ext": extension(name)}


def walked(files: DataFrame) -> DataFrame:
    """Of a listing, the entries to index: no junk names, nothing in opaque bundles, only media."""
    out = files.withColumns(split_path(F.col("path")))
    junk = F.exists(F.split(F.col("path"), "/"), lambda part: is_junk(part))
    return out.filter(~junk & ~in_opaque_bundle(F.col("path"))).withColumn("media", media_kind(F.col("ext"))).filter("media is not null")


def skip_reason(error: Column, seen_before: Column) -> Column:
    """Why a walk left a place out. A file that is gone isn't an entry to report; other errors are no evidence of deletion."""
    return (
        F.when(seen_before, "symlinkLoop")
        .when(error == "ENOENT", F.lit(None))
        .when(error.isin("EACCES", "EPERM"), "unreadable")
        .when(error.isNotNull(), "unstatable")
    )


def first_seen_directories(dirs: DataFrame) -> DataFrame:
    """Directories by (device, inode): the first path keeps the place, others are loops and carry a reason.

    dirs: path, device, inode, error. The first path is a minimum per key, so no group is gathered.
    """
    first = dirs.groupBy("device", "inode").agg(F.min("path").alias("first"))
    out = dirs.join(first, ["device", "inode"])
    return out.select("path", "device", "inode", skip_reason(F.col("error"), F.col("path") != F.col("first")).alias("reason"), (F.col("error").isNull() & (F.col("path") == F.col("first"))).alias("entered"))


def folder_children(files: DataFrame, folder: str) -> DataFrame:
    """(name, files): the folders right below a folder, in natural order, with the number of files under each."""
    base = folder.rstrip("/") + "/"
    rest = F.substring(F.col("path"), len(base) + 1, 1 << 30)
    below = files.filter(F.col("path").startswith(base)).select(rest.alias("rest")).filter(F.col("rest").contains("/"))
    name = F.substring_index("rest", "/", 1)
    kept = below.select(name.alias("name")).filter(~is_junk(F.col("name")) & ~F.coalesce(extension(F.col("name")).isin(*OPAQUE), F.lit(False)))
    return kept.groupBy("name").agg(F.count("*").alias("files")).orderBy(natural_key(F.col("name")), "name")


def natural_key(name: Column) -> Column:
    """Digits compare as numbers of any length: every run of digits follows its own length, leading zeros left out."""
    runs = F.regexp_extract_all(F.lower(name), F.lit(r"(\d+|\D+)"), 1)
    number = lambda x: F.concat(F.lpad(F.length(F.ltrim(x, F.lit("0"))).cast("string"), 10, "0"), F.ltrim(x, F.lit("0")))
    return F.array_join(F.transform(runs, lambda x: F.when(x.rlike(r"^\d"), number(x)).otherwise(x)), "")


def evictions(cache: DataFrame, budget: int) -> DataFrame:
    """Cache entries to evict: oldest first until the rest fits the budget; the newest one always stays.

    cache: key, size, modified. Ranges of (modified, key), newest first, are summed side by side, and each adds the bytes of those before;
    entries of one moment are as many ranges as they fill.
    """
    order = [F.col("modified").desc(), F.col("key").asc()]
    ranged = written(cache.select("key", "size", "modified").repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "cache")
    per = ranged.groupBy("__part").agg(F.sum("size").alias("bytes"))
    ahead = Window.orderBy("__part")  # a row for each range
    newer = per.select("__part", (F.sum("bytes").over(ahead) - F.col("bytes")).alias("newer"), (F.row_number().over(ahead) == 1).alias("newest"))
    inside = Window.partitionBy("__part").orderBy(*order)
    ranked = ranged.join(F.broadcast(newer), "__part").withColumns({"held": F.col("newer") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)), "place": F.row_number().over(inside)})
    return ranked.filter((F.col("held") > budget) & ~(F.col("newest") & (F.col("place") == 1))).select("key", "size", "modified")
