"""Transcripts in single rows, among rows without any marker."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import chat

SAYS = {"system": ["System", "[system]", "### Instruction:"], "user": ["User", "Human", "**user:**", "Q", "<|user|>"], "assistant": ["Assistant", "AI", "### Response:", "A", "<|assistant|>"]}


def transcript(rng):
    """(text, turns): two to six turns of one to three lines; some markers stand on a line of their own."""
    order = ["user", "assistant"] * 3 if rng.random() < 0.7 else ["system", "user", "assistant", "user", "assistant"]
    text, turns = [], []
    for role in order[: rng.randint(2, 6)]:
        lines = [" ".join(rng.choice("alpha beta gamma delta what why so then".split()) for _ in range(rng.randint(1, 40))) + rng.choice(["", ".", "?"]) for _ in range(rng.randint(1, 3))]
        mark = rng.choice(SAYS[role])
        mark += "" if mark[0] in "[#*<" else ":"
        text.append(f"{mark}{rng.choice([' ', chr(10)]) if mark[0] in '[#<' else ' '}" + "\n".join(lines))
        turns.append((role, "\n".join(lines)))
    return "\n".join(text), turns


@pytest.fixture(scope="module")
def given(spark):
    return spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")


@pytest.mark.parametrize("transcripts, others", [(5, True), (50, True), (400, True), (50, False)])
@pytest.mark.parametrize("role", [None, "assistant", "user"])
def test_transcripts_are_split_whatever_else_is_there(spark, given, transcripts, others, role):
    if role and transcripts not in (50,):
        pytest.skip("roles of the rows matter alike at every share")
    rng = random.Random(transcripts)
    made = {10**9 + i: transcript(rng) for i in range(transcripts)}
    rows = spark.createDataFrame([(i, 0, role, t) for i, (t, _) in made.items()], given.schema)
    got = chat.format_turns(given.unionByName(rows) if others else rows, use_roles=False).collect()
    found: dict = {}
    for r in sorted(got, key=lambda r: (r.conv_id, r.turn, r.part)):
        found.setdefault(r.conv_id, []).append((r.role, r.text))
    wrong = [i for i, (_, turns) in made.items() if found[i] != turns]
    assert not wrong, [(made[i], found[i]) for i in wrong[:2]]
    if others:
        assert sum(len(v) for i, v in found.items() if i < 10**9) == given.count()  # rows without markers are whole


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_no_given_row_is_split_and_roles_hold(spark, sf):
    df = spark.read.parquet(f"/root/testdata/{sf}/conversations.parquet")
    got = chat.op10_chat(spark, f"/root/testdata/{sf}").collect()
    assert len(got) == df.count() and not any(r.part for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.role == r.role_given for r in held) >= 0.98 * len(held) - 1


def test_a_marker_stays_where_no_turn_of_its_role_opens(spark, given):
    rows = [(10**9, 0, "user", "Answer: is a word, answer this:\nnot: a speaker"), (10**9 + 1, 0, "user", "notes\nthe user: said so")]
    got = {r.conv_id: r for r in chat.format_turns(given.unionByName(spark.createDataFrame(rows, given.schema)), use_roles=True).filter(f"conv_id >= {10**9}").collect()}
    assert got[10**9].text == rows[0][3] and got[10**9].role == "user"  # the role that is given isn't the marker's
    assert got[10**9 + 1].text == rows[1][3]


def test_the_path_of_a_transcript_is_the_best_of_all(spark, given):
    lots = chat.lots_of(given, "conv_id", "turn", "role", "text")
    step, emit = chat.fit(lots.join(chat.long_ones(lots), "lot", "left").fillna(False), False)
    for text in ("User: a\nb\nAssistant: c\nUser: d", "plain\ntext?\nlines", "A: no\nQ:\nlong question here?", "System: x"):
        lines = chat.lines_of(text, True)

        def value(path, lines=lines):
            return sum(step[a, b] + emit[b, m, f] for a, b, (m, f, *_) in zip([chat.STATES, *path], path, lines))

        paths = {p: value(p) for p in itertools.product(range(chat.STATES), repeat=len(lines))}
        found = tuple(chat.decode_lines(lines, chat.START, np.zeros(chat.STATES), step, emit))
        assert paths[found] == pytest.approx(max(paths.values())) and np.isfinite(paths[found])
        assert all(bool(m) == (s % 2 == 0) for s, (m, *_) in zip(found[1:], lines[1:]))
