"""Empty tables, very long texts and hot keys, for the operators whose own tests have none."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import class_lm, pieces, pu_quality, secrets, simhash, winnowing
from tessera.llm.common import join_sums

LONG_WORDS = 150_000


def docs_of(spark, rows):
    """documents whose other columns clash with names that operators use inside."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({c: F.lit("x") for c in ("id", "fp", "component", "node", "ids", "score", "n", "w", "key")})


@pytest.fixture(scope="module")
def long_text():
    rng = random.Random(31)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(1, 7))) for _ in range(3000)]
    return " ".join(rng.choices(words, k=LONG_WORDS))


def test_empty_tables(spark):
    none = docs_of(spark, [(1, "x")]).limit(0)
    assert pieces.encode(none).count() == 0 and pieces.decode(pieces.encode(none)).count() == 0
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_first(none).count() == 0
    assert secrets.scan(none).count() == 0


def test_long_texts_are_encoded_whole(spark, long_text):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    got = pieces.encode(docs_of(spark, [(1, long_text), (2, "a" * 5000)])).collect()
    assert {r.doc_id: r.ids for r in got} == {1: model.encode(long_text), 2: model.encode("a" * 5000)}
    assert all(r.round_trip for r in got)


def test_secrets_at_the_end_of_a_long_text_are_found(spark, long_text):
    text = long_text + " password=hunter2x AKIA" + "B" * 16 + " " + "0f" * 14
    (row,) = secrets.scan(docs_of(spark, [(1, text)])).collect()
    at = len(long_text) + 1
    assert {(s.kind, s.start, s.end) for s in row.spans} >= {("assign", at, at + 17), ("access", at + 18, at + 38), ("hex", at + 39, at + 67)}


def test_a_hit_at_the_end_of_a_long_text_counts(spark, long_text):
    item = "these thirteen words are what the benchmark asks and nobody else would write"
    assert len(item.split()) == 13
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    (row,) = winnowing.decontaminate(docs_of(spark, [(1, f"{long_text} {item}")]), items).withColumn("contaminated", winnowing.contaminated()).collect()
    assert (row.n_words, row.n_hit, row.n_items, row.contaminated) == (LONG_WORDS + 13, 13, 1, False)


def test_long_texts_are_fingerprinted_whole(spark, long_text):
    cut = long_text[: len(long_text) // 2]
    got = {r.doc_id: r for r in simhash.near_duplicates(docs_of(spark, [(1, long_text), (2, long_text + " end"), (3, cut[::-1])])).collect()}
    assert got[1].component == got[2].component == 1 and got[3].component == 3


def test_every_token_of_a_long_text_is_scored(spark, long_text):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    learnt = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 != 2)
    got = {r.doc_id: r for r in class_lm.score(docs_of(spark, [(held, long_text), (learnt, "a b")]), classes=4).collect()}
    assert got[held].n_tokens == LONG_WORDS + 1 and got[held].held_out and got[learnt].train_tokens == 3


def test_long_texts_have_a_quality(spark, long_text):
    rows = [(i, f"word {i} and some more. " * (1 + i % 5)) for i in range(40)] + [(99, long_text)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    got = pu_quality.score(docs_of(spark, rows), labels).collect()
    assert len(got) == 41 and all(0 <= r.score <= 1 for r in got)


@pytest.mark.parametrize("share", [0, 0.2, 1])
def test_sums_are_joined_alike_however_many_keys_are_hot(spark, share, monkeypatch):
    monkeypatch.setattr("tessera.llm.common.HOT_KEY_SHARE", share)
    rows = spark.createDataFrame([(i, 0 if i % 3 else i) for i in range(60)], "id long, key long")
    sums = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    got = {(r.id, r.key, r.n, r.least) for r in join_sums(rows, sums, "key", 60).collect()}
    assert got == {(i, 0, 41, 0) if i % 3 or i == 0 else (i, i, 1, i) for i in range(60)}
