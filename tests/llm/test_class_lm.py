"""The class model's two steps and its scores against plain loops, with words of all three bands of frequency."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import class_lm


def rows_of(n=240, seed=71):
    """Texts of alternating kinds of words, whose frequencies fall from very frequent to unique; a third of the rows are one text."""
    rng = random.Random(seed)
    kinds = [[f"{k}{i}{e}" for i in range(80)] for k, e in (("a", "x"), ("b", "y"), ("c", "x"))]
    pick = lambda k: kinds[k % 3][min(int(rng.expovariate(0.12)), 79)]
    rows = [(i, " ".join(pick(j) if rng.random() < 0.9 else f"u{rng.randrange(10**6)}" for j in range(rng.randint(0, 50)))) for i in range(n)]
    return rows + [(1000 + i, rows[3][1]) for i in range(n // 2)] + [(2000, None), (2001, ""), (None, "a1x B1Y É"), (5, rows[5][1])]


def docs_of(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    return df.withColumns({c: F.lit("x") for c in ("id", "row", "word", "slot", "learn", "old", "new", "cls", "h", "c")})


def held(d):
    return d is not None and zlib.crc32(str(d).encode()) % 7 == 2


def plain_moves(learn, model, pairs):
    """The class of each key, word by word."""
    c, first = model.classes, model.n - class_lm.SHAPES
    fit = [[pairs[i][j] + 1 / c for j in range(c)] for i in range(c)]
    out_of, into = [sum(r) for r in fit], [sum(r[j] for r in fit) for j in range(c)]
    seen = defaultdict(Counter)
    for words in learn:
        seq = [0, *model.sequence(words), 0]
        for i, w in enumerate(words, 1):
            if seq[i] >= first:
                seen[class_lm.key_of(w, seq[i] - first)][model.of[seq[i - 1]], model.of[seq[i + 1]]] += 1
    values = {}
    for h, contexts in seen.items():
        was = model.of[first + (h >> class_lm.KEY_BITS)]
        values[h] = {
            k: sum(n * (math.log(fit[p][k] / out_of[p] / into[k]) + math.log(fit[k][q] / out_of[k])) for (p, q), n in contexts.items()) + class_lm.LEAVE * (k == was)
            for k in range(1, c)
        }
    return values


@pytest.mark.parametrize("better", [True, False])
def test_scores_of_all_bands_against_plain_loops(spark, monkeypatch, better):
    monkeypatch.setattr(class_lm, "EXCHANGE_SHARE", 0.01)
    monkeypatch.setattr(class_lm, "LOOKUP_SHARE", 0.004)
    monkeypatch.setattr(class_lm, "FLUSH", 50)
    steps = {}
    first_step, second_step = class_lm.exchanged, class_lm.moved

    def exchanged(ids, model, rounds):
        steps["pairs"], steps["kept"] = first_step(ids, model, rounds)
        return steps["pairs"], steps["kept"]

    def moved(learn, model, pairs):
        steps["model"], steps["moved"] = model, second_step(learn, model, pairs)
        return steps["moved"]

    monkeypatch.setattr(class_lm, "exchanged", exchanged)
    monkeypatch.setattr(class_lm, "moved", moved)
    if not better:  # as if step 2 had lowered the likelihood
        whole = class_lm.likelihood
        monkeypatch.setattr(class_lm, "likelihood", lambda p: whole(p) if "moved" not in steps or p is steps["pairs"] else -math.inf)
    rows = rows_of()
    got = class_lm.score(docs_of(spark, rows), classes=6).collect()
    model, learn = steps["model"], [class_lm.words_of(t) for d, t in rows if not held(d)]
    first = model.n - class_lm.SHAPES
    # step 1: likelihoods that rise, of pairs that are those of the classes returned
    assert steps["kept"] == sorted(steps["kept"]) and steps["kept"][-1] > steps["kept"][0]
    pairs_of = lambda classes: np.array([[seen[i, j] for j in range(6)] for i in range(6)]) if (seen := Counter(x for s in classes for x in zip(s, s[1:], strict=False))) else None
    assert (steps["pairs"] == pairs_of([[int(model.of[i]) for i in (0, *model.sequence(w), 0)] for w in learn])).all()
    # step 2: the best class of each key
    chosen = {r.h: r.cls for r in steps["moved"].collect()}
    values = plain_moves(learn, model, steps["pairs"])
    assert chosen.keys() == values.keys()
    assert all(values[h][k] == pytest.approx(max(values[h].values())) for h, k in chosen.items())
    assert any(k != model.of[first + (h >> class_lm.KEY_BITS)] for h, k in chosen.items())
    # scores
    counts = Counter(w for x in learn for w in x)

    def class_of(w):
        i = model.sequence([w])[0]
        h = class_lm.key_of(w, i - first) if i >= first else None
        return int(chosen[h]) if better and w in counts and h in chosen else int(model.of[i])

    pairs = pairs_of([[0, *map(class_of, w), 0] for w in learn])
    tokens, kinds = Counter({0: len(learn)}), Counter({0: 1})
    for w, n in counts.items():
        tokens[class_of(w)] += n
        kinds[class_of(w)] += 1
    n, v = sum(counts.values()) + len(learn), len(counts) + 1
    shares = [x / n for x in counts.values()]
    assert all(any(lo <= s < hi for s in shares) for lo, hi in ((0, 0.004), (0.004, 0.01), (0.01, 1)))
    want = []
    for d, t in rows:
        words = class_lm.words_of(t)
        cls, c = [0, *map(class_of, words), 0], [*(counts[w] for w in words), len(learn)]
        own = sum(math.log10((pairs[a, b] + 1) / (pairs[a].sum() + 6)) + math.log10((k + 1) / (tokens[b] + kinds[b] + 1)) for a, b, k in zip(cls, cls[1:], c, strict=False))
        base = sum(math.log10((k + 1) / (n + v + 1)) for k in c)
        want.append((d is None, d or 0, held(d), len(c), sum(k > 0 for k in c), n, round(base, 6), round(own, 6), round(10 ** (-own / len(c)), 4)))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6), round(r.perplexity, 4)) for r in got) == sorted(want)


def test_keys_are_the_same_in_spark_and_python(spark):
    words = [w.encode() for w in ("", "a", "abc", "é", "日本語", "x" * 99, *rows_of()[1][1].split())]
    model = class_lm.Classes([], 4)
    got = spark.createDataFrame([(w,) for w in words], "word binary").select(class_lm.key("word").alias("h")).collect()
    assert [r.h for r in got] == [class_lm.key_of(w, i - 1) for w, i in zip(words, model.sequence(words), strict=True)]


def test_classes_grow_with_the_vocabulary():
    numbers = [class_lm.class_number(10**k) for k in range(13)]
    assert numbers == sorted(numbers) and numbers[0] == class_lm.LEAST_CLASSES and numbers[9] > 200 and numbers[12] > 1000


def test_nothing_to_learn_from(spark):
    ids = [i for i in range(200) if held(i)]
    got = class_lm.score(docs_of(spark, [(i, "some words") for i in ids])).collect()
    assert {(r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score, r.perplexity) for r in got} == {(True, 3, 0, 0, 0.0, 0.0, 1.0)}


def test_words_in_lots_are_those_of_plain_splits():
    rng = random.Random(5)
    bits = ["A", "zZ", "É", "日本", " ", "\t", "\n", "\v", "\f", "\r", "\x00", "\x1c", "\x85", "\u2003", "x" * 40, "0"]
    texts = [None, "", " ", *("".join(rng.choices(bits, k=rng.randrange(60))) for _ in range(300)), None]
    rows = pa.RecordBatch.from_arrays([pa.array([7, *range(len(texts))]), pa.array(["cut off", *texts], pa.string())], ["id", "text"]).slice(1)
    model = class_lm.Classes([b"a", b"zz", b"0"], 4)
    seen, sizes = [], []
    for some, bounds, words in class_lm.word_lots(iter([rows]), 1, lot_bytes=500):
        sizes.append(some.num_rows)
        words_of = words.to_pylist()
        seen += [(i, words_of[lo:hi]) for i, lo, hi in zip(some.column(0).to_pylist(), bounds, bounds[1:], strict=False)]
        first = model.n - class_lm.SHAPES
        plain = {b"a": 1, b"zz": 2, b"0": 3}
        assert model.numbers(words).tolist() == [plain.get(w) or first + zlib.crc32(w[-3:] + bytes([min(len(w), 15)])) % class_lm.SHAPES for w in words_of]
    assert len(sizes) > 5 and seen == [(i, class_lm.words_of(t)) for i, t in enumerate(texts)]


def test_packed_rows_come_back():
    flat, bounds = np.arange(9, dtype=np.uint16), np.array([0, 0, 4, 4, 9])
    rows = class_lm.bytes_rows(flat, bounds)
    assert rows.to_pylist() == [flat[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)]
    for lo, hi in ((0, 4), (1, 2), (2, 4), (3, 1)):
        got, values = class_lm.flat_rows(rows.slice(lo, max(hi - lo, 0)), np.uint16)
        assert values.tolist() == flat[bounds[lo] : bounds[max(hi, lo)]].tolist() and got.tolist() == (bounds[lo : max(hi, lo) + 1] - bounds[lo]).tolist()
