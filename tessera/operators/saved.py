"""Saved searches: a table of named queries in their JSON form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import model as m
from .search import matching

SCHEMA = "id long, name string, query string, is_builtin boolean"


def saved_table(spark: SparkSession, searches: dict[str, m.SearchQuery], builtin: bool = False) -> DataFrame:
    return spark.createDataFrame([(i + 1, n, m.to_json(q), builtin) for i, (n, q) in enumerate(searches.items())], SCHEMA)


def counts(files: DataFrame, saved: DataFrame) -> DataFrame:
    """(name, n): how many rows each saved search matches. Saved searches are what users named, so few."""
    each = [matching(files, m.from_json(r.query)).agg(F.lit(r.name).alias("name"), F.count("*").alias("n")) for r in saved.collect()]
    return reduce(DataFrame.unionByName, each) if each else files.sparkSession.createDataFrame([], "name string, n long")
