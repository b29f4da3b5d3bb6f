"""Facet counts under a query's filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import model as m
from .search import matching


def facets(files: DataFrame, query: m.SearchQuery) -> DataFrame:
    """(facet, bucket, n) for ext, camera_make and total, from one scan; null and empty buckets are left out."""
    rows = matching(files, query).select("ext", "camera_make")
    sets = rows.groupingSets([["ext"], ["camera_make"], []], "ext", "camera_make").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    named = sets.select(
        F.when(F.col("g") == 1, "ext").when(F.col("g") == 2, "camera_make").otherwise("total").alias("facet"), F.when(F.col("g") == 1, F.col("ext")).when(F.col("g") == 2, F.col("camera_make")).alias("bucket"), "n"
    )
    return named.filter((F.col("facet") == "total") | (F.coalesce("bucket", F.lit("")) != ""))


def self_excluding_ext(files: DataFrame, query: m.SearchQuery, extensions: list[str]) -> DataFrame:
    """(facet, bucket, n) where ext buckets ignore the extension filter, and makes and the total obey it. One scan."""
    rows = matching(files, query).select("ext", "camera_make", F.col("ext").isin([e.lower() for e in extensions]).alias("chosen"))
    sets = rows.groupingSets([["ext"], ["camera_make"], []], "ext", "camera_make").agg(F.count("*").alias("every"), F.count_if("chosen").alias("chosen"), F.grouping_id().alias("g"))
    out = sets.select(
        F.when(F.col("g") == 1, "ext").when(F.col("g") == 2, "camera_make").otherwise("total").alias("facet"),
        F.when(F.col("g") == 1, F.col("ext")).when(F.col("g") == 2, F.col("camera_make")).alias("bucket"),
        F.when(F.col("g") == 1, F.col("every")).otherwise(F.col("chosen")).alias("n"),
    )
    return out.filter((F.col("facet") == "total") | (F.coalesce("bucket", F.lit("")) != "") & (F.col("n") > 0))


def facet_maps(counts: DataFrame) -> DataFrame:
    """One row: by_extension and by_camera as maps, and the total."""
    of = lambda name: F.map_from_entries(F.collect_list(F.when(F.col("facet") == name, F.struct("bucket", "n"))))
    return counts.agg(of("ext").alias("by_extension"), of("camera_make").alias("by_camera"), F.max(F.when(F.col("facet") == "total", F.col("n"))).alias("total"))


def agreement(c: Column) -> Column:
    """Over a selection: the one value, null if all are empty, or '<mixed>'. Null and '' are one value."""
    value = F.coalesce(c, F.lit(""))
    return F.when(F.min(value) == F.max(value), F.nullif(F.min(value), F.lit(""))).otherwise("<mixed>")


def selection_summary(rows: DataFrame, raw_extensions: tuple[str, ...]) -> DataFrame:
    """One row: make, model and offset that a selection agrees on, and its number of raw files."""
    readable = F.when(F.col("capture_offset").rlike(r"^[+-]\d\d:\d\d$"), F.col("capture_offset"))
    offset = F.when(F.min(readable) == F.max(readable), F.min(readable))
    return rows.agg(agreement(F.col("camera_make")).alias("make"), agreement(F.col("camera_model")).alias("model"), offset.alias("offset"), F.count_if(F.col("ext").isin(*raw_extensions)).alias("raw_files"), F.count("*").alias("files"))
