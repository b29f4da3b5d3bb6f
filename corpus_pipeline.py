"""From raw documents to token ids: five stages, each over all that the one before it kept.

Defined results of the stages. Null and empty texts: scored like any text without words; near-duplicates of one another, so one
of those with an id stays; never contaminated, without secrets and without token ids. Null ids: such rows stay in each stage that
doesn't judge their text. Repeated rows: each is judged by itself, and near-duplicate removal keeps all rows of the id that it
keeps. Very long texts are read whole. Further columns are kept up to the last stage, whatever their names. Empty table: empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm import pieces, pu_quality, secrets, simhash, winnowing
from tessera.llm.common import staged, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return pu_quality.keep_good(docs, table(spark, sf_dir, "labels"))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    return simhash.keep_first(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more stands in benchmark windows go."""
    return winnowing.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets give way to a placeholder; n_chars follows the new text."""
    return secrets.redact(docs)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and whether they decode to the text."""
    return pieces.encode(docs).select("doc_id", F.col("ids").alias("token_ids"), "n_tokens", "round_trip")


STAGES = [
    ("quality classifier", keep_quality),
    ("simhash near-dedup", keep_one_of_each_group),
    ("benchmark decontamination", drop_benchmark),
    ("secret scans", hide_secrets),
    ("sentencepiece encoding", to_pieces),
]

#: A trained model, components and tokens are beyond SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = staged(docs, f"stage-{i}")
    return docs
