"""The pipeline's stages over a small table, held against the operators' own results."""

import corpus_pipeline
from tessera.llm import pieces, pu_quality, secrets, simhash, winnowing
from tessera.llm.common import table

SF = "/root/testdata/sf0.001"


def test_stages_take_effect_and_keep_columns(spark):
    docs = table(spark, SF, "documents")
    names, rest = docs.columns, docs
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, rest = rest, stage(spark, rest, SF).cache()
        if i < 4:
            assert rest.columns == names
        ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
        if i == 0:
            assert ids(rest) == sorted(r.doc_id for r in pu_quality.score(before, table(spark, SF, "labels")).collect() if r.predicted)
        if i == 1:
            assert ids(rest) == sorted({r.component for r in simhash.near_duplicates(before).collect()})
        if i == 2:
            bad = {r.doc_id for r in winnowing.decontaminate(before, table(spark, SF, "benchmark")).collect() if r.n_hit and 20 * r.n_hit >= r.n_words}
            assert ids(rest) == [d for d in ids(before) if d not in bad]
        if i == 3:
            assert {r.doc_id: r.text for r in rest.collect()} == {r.doc_id: secrets.redacted(r.text) for r in before.collect()}
            assert all(r.n_chars == len(r.text) for r in rest.collect())
        if i == 4:
            vocab = pieces.load()
            texts = {r.doc_id: r.text for r in before.collect()}
            assert all(r.round_trip and pieces.decode_ids(r.token_ids, vocab) == texts[r.doc_id] for r in rest.collect())


def test_stages_on_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "one two three four five six"), (3, "one two three four five six"), (4, "one two three four five six"), (None, "a text without an id"), (5, "word " * 20_000 + "end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' AS lang", "'s' AS source", "CAST(length(text) AS BIGINT) AS n_chars", "'x' AS hash", "1L AS id")
    rest = docs
    for _, stage in corpus_pipeline.STAGES[1:4]:
        rest = stage(spark, rest, SF).cache()
        assert rest.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in rest.collect()) == [0, 1, 3, 3, 5]
    last = corpus_pipeline.STAGES[4][1](spark, rest, SF).collect()
    assert len(last) == 5 and all(r.round_trip for r in last)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
