"""Periodic runs, token counts and resampling against brute force, and on rows with nulls, empty texts, repeats and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import periodic_runs, target_resampling, token_counts
from tessera.llm.word_arrays import lots, split_letters, split_words


def docs_of(spark, rows):
    """rows of (doc_id, text); with columns whose names the operators use themselves."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({c: F.lit("x") for c in ("id", "n_words", "runs", "collapsed", "n_tokens", "weight", "score", "rank", "bucket", "__part", "start")})


# --- words ------------------------------------------------------------------------------------------------------------


def test_words_of_slices_nulls_and_white_space():
    texts = ["skipped", " a\tb\x0bc\x0cd\r\n", None, "", "   ", "x y  z", "A1-b_ÉÉ,ßz"]
    cut = pa.array(texts).slice(1)
    bounds, words = split_words(cut)
    assert [words.to_pylist()[a:b] for a, b in zip(bounds, bounds[1:])] == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts[1:]]
    bounds, words = split_letters(cut)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    assert [words.to_pylist()[a:b] for a, b in zip(bounds, bounds[1:])] == [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(lower)) for t in texts[1:]]
    assert [hi - lo for lo, hi in lots(cut, 12)] and sum(hi - lo for lo, hi in lots(cut, 1)) == len(cut)


# --- 11 ---------------------------------------------------------------------------------------------------------------


def runs_by_force(w):
    found = {}
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i < len(w) - p:
            if w[i] != w[i + p]:
                i += 1
                continue
            start = i
            while i < len(w) - p and w[i] == w[i + p]:
                i += 1
            if (length := i - start + p) >= max(12, 2 * p):
                found.setdefault((start, length), p)
    return sorted((s, n, p) for (s, n), p in found.items())


def collapsed_by_force(w):
    dropped = {i for s, n, p in runs_by_force(w) for i in range(s + p, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in dropped)


def periodic_texts():
    rng, out = random.Random(3), []
    for _ in range(400):
        words = [rng.choice("abcdefghijklmnopqrstuvwxyz"[: rng.choice([1, 2, 3, 26])]) for _ in range(rng.randint(0, 120))]
        for _ in range(rng.randint(0, 3)):
            if len(words) > 4:
                i, p = rng.randrange(len(words)), rng.randint(1, 20)
                words[i:i] = (words[i : i + p] * rng.randint(2, 6))[: rng.randint(1, 100)]
        out.append(words)
    a, b = "a", "ab"
    while len(b) < 700:
        a, b = b, b + a
    thue = "a"
    while len(thue) < 700:
        thue += thue.translate(str.maketrans("ab", "ba"))
    return [*out, list(b), list(thue), ["x"] * 500, [w for i in range(60) for w in f"{i} the same six words here again".split()], "p q r s t u".split() * 2, "p q r s t".split() * 2]


def test_runs_equal_brute_force(spark):
    words = periodic_texts()
    rows = [(i, " ".join(w)) for i, w in enumerate(words)] + [(None, "z " * 12), (-1, None), (-2, ""), (-3, " \n "), (5, " ".join(words[5]))]
    got = periodic_runs.periodic_runs(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    answer = {t or "": None for _, t in rows}
    by_id = {i: (t or "").split() for i, t in rows}
    assert len(answer) > 300
    for r in got:
        w = by_id[r.id]
        assert [tuple(x) for x in r.runs] == runs_by_force(w) and r.n_words == len(w) and r.collapsed == collapsed_by_force(w)


def test_lots_of_any_size_give_the_same_runs():
    texts = pa.array([" ".join(w) for w in periodic_texts()[:80]])
    whole = periodic_runs.analysed(texts)
    cut = [periodic_runs.analysed(texts.slice(lo, hi - lo)) for lo, hi in lots(texts, 500)]
    for k in range(3):
        assert whole[k].to_pylist() == [x for part in cut for x in part[k].to_pylist()]


def test_places_that_share_a_hash_change_nothing(monkeypatch):
    words = periodic_texts()[:60]
    texts = pa.array([" ".join(w) for w in words])
    monkeypatch.setattr(periodic_runs, "_ODD", np.zeros(periodic_runs.SEED + 1, np.uint64))
    assert [[tuple(x.values()) for x in r] for r in periodic_runs.analysed(texts)[1].to_pylist()] == [runs_by_force(w) for w in words]


@pytest.mark.parametrize("text, longest", [("a " * 200_000, (0, 200_000, 1)), (" ".join(f"{i} the same six words here again" for i in range(30_000)), None), ("one two three " * 50_000, (0, 150_000, 3))])
def test_very_long_texts_are_searched_whole(text, longest):
    runs = periodic_runs.analysed(pa.array([text]))[1].to_pylist()[0]
    assert [tuple(x.values()) for x in runs] == ([longest] if longest else [])


def contract_words(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def test_run_query_follows_its_contract(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice("abcdefgh") + str(rng.randint(0, 30)) for _ in range(rng.randint(0, 90)))) for i in range(300)] + [(1000, None), (1001, ""), (1002, "\t a \x0b a ")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in periodic_runs.op11_periodic_runs(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        w, r = contract_words(i, text), got[i]
        runs = runs_by_force(w)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *(best or (None,) * 3)) and r.exponent_milli == (1000 * best[1] // best[2] if best else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed_by_force(w).encode()).hexdigest()
    assert sum(r.n_runs > 0 for r in got.values()) > 10


# --- 12 ---------------------------------------------------------------------------------------------------------------


ODD_TEXTS = [
    "", "a" * 4000, "ab" * 3000, "it's we'll <|endoftext|> x<|startoftext|>y<|EndOfText|><|endoftext|>", "é é ́x ÀÉ İstanbul ΣΑΣ 123 4५6 😀😀 ​　a b\x85c\x1cd",
    "''''s 's't", "日本語テキスト", "İİ ﬁ ǅ", "!!!???...---", "aaa!!!aaa123bbb", "\x00\x01 \x7f", "a　b　 　 c",
]


def odd_texts():
    rng = random.Random(1)
    return ODD_TEXTS + ["".join(rng.choice("aAéΣß'st<|>endofx .!0٣日́ \t\nİ　") for _ in range(rng.randint(1, 80))) for _ in range(1500)]


def test_token_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(token_counts.TOKENIZER)
    rows = [*enumerate(odd_texts()), (-1, None), (None, "a b"), (3, ODD_TEXTS[3])]
    got = token_counts.count_tokens(docs_of(spark, rows)).collect()
    want = Counter((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    assert Counter(map(tuple, got)) == want


def test_what_a_worker_keeps_is_bounded_and_changes_nothing(monkeypatch):
    token_counts.load.cache_clear()
    words = [w for t in odd_texts() for w in t.split()]
    whole = token_counts.count_words(words, token_counts.TOKENIZER)
    token_counts.load.cache_clear()
    monkeypatch.setattr(token_counts, "KEPT", 50)
    assert np.concatenate([token_counts.count_words(words[i : i + 40], token_counts.TOKENIZER) for i in range(0, len(words), 40)]).tolist() == whole.tolist()
    _, known, kept = token_counts.load(token_counts.TOKENIZER)
    assert len(known) <= 51 + 40 and len(kept) <= 51 + 400
    token_counts.load.cache_clear()


def left_first(ranks, made, symbols):
    """Merges one place at a time: the lowest rank, the leftmost of those."""
    s = list(symbols)
    while found := [(ranks[p], i) for i, p in enumerate(zip(s, s[1:])) if p in ranks]:
        r, i = min(found)
        s[i : i + 2] = [made[r]]
    return len(s)


@pytest.mark.parametrize("orderly", [True, False])
def test_merges_at_once_equal_one_place_at_a_time(orderly):
    rng, size = random.Random(5), 12
    for _ in range(40):
        pairs, made, known = [], [], 4
        while len(pairs) < 20:
            top = known if orderly else size
            p = (rng.randrange(top), rng.randrange(top))
            if p not in pairs:
                pairs.append(p)
                made.append(known if orderly and known < size else rng.randrange(size))
                known = min(size, known + 1)
        if orderly:  # later merges use what earlier ones made, never the other way round
            pairs, made = pairs[: size - 4], made[: size - 4]
        merges = token_counts.Merges.__new__(token_counts.Merges)
        keys = np.array([a * size + b for a, b in pairs])
        merges.size, merges.order = size, np.argsort(keys, kind="stable")
        merges.keys, merges.made = keys[merges.order], np.array(made)
        merges.careful = np.array([any(made[r] in pairs[q] for q in range(r + 1)) for r in range(len(pairs))])
        assert not orderly or not merges.careful.any()
        seqs = [[rng.randrange(4 if orderly else size) for _ in range(rng.randint(1, 30))] for _ in range(30)]
        got = merges.surviving(np.array([x for s in seqs for x in s]), np.array([len(s) for s in seqs]))
        assert got.tolist() == [left_first({p: r for r, p in enumerate(pairs)}, made, s) for s in seqs]


# --- 13 ---------------------------------------------------------------------------------------------------------------


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def resampled_by_force(docs, target, share, least):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    bucket = lambda w: zlib.crc32(w.encode()) % 10_000
    s, t = (Counter(bucket(w) for x in side for w in words(x)) for side in ([x for _, x in docs], target))
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total_s + 10_000) / ((s[b] + 1) * (total_t + 10_000))))
    rows = []
    for i, text in docs:
        ws = words(text)
        weight = sum(gain(bucket(w)) for w in ws)
        h = int(hashlib.sha256(f"2024:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(ws), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): k + 1 for k, r in enumerate(able[: share * len(able) // 100])}
    return sorted((r[0] is None, r[0] or 0, *r[1:], rank.get(id(r), 0)) for r in rows)


@pytest.mark.parametrize("share, least", [(10, 20), (55, 0), (100, 3), (0, 0)])
def test_resampling_equals_brute_force(spark, share, least):
    rng = random.Random(4)
    some = lambda n, k: " ".join(rng.choice("Apple pear Éclair 7up don't x-ray".split()) + str(rng.randint(0, k)) for _ in range(n))
    docs = [(i, some(rng.randint(0, 40), 30)) for i in range(200)] + [(500, None), (501, ""), (None, some(30, 5)), (-7, some(25, 3))]
    docs += [docs[3], docs[3]]
    target = [some(30, 5), None, some(12, 9)]
    got = target_resampling.resample(docs_of(spark, docs), spark.createDataFrame([(t,) for t in target], "text string"), share=share, min_words=least).collect()
    assert sorted((r.id is None, r.id or 0, r.n_features, r.weight, r.score, r["rank"] or 0) for r in got) == resampled_by_force(docs, target, share, least)


@pytest.mark.parametrize("amount", [0, 1, 7, 40, 41, 60, 99, 100, 101])
def test_cutoffs_among_ties(spark, amount):
    rows = [(i % 90 if i != 50 else None, (i // 40) * 10, i % 10 != 9) for i in range(110)]
    scored = spark.createDataFrame(rows, "id long, score long, may_be_drawn boolean")
    able = sorted(((-s, i is None, i or 0) for i, s, ok in rows if ok))
    got = target_resampling.draw(scored, amount).collect()
    ranked = sorted((r["rank"], -r.score, r.id is None, r.id or 0) for r in got if r["rank"])
    assert len(got) == len(rows) and [x[0] for x in ranked] == list(range(1, min(amount, len(able)) + 1)) and [x[1:] for x in ranked] == able[:amount]


def test_halving_asks_few_times():
    values, asked = sorted(random.Random(2).choices(range(-(10**6), 10**6), k=1000)), []

    def count(thresholds):
        asked.append(len(thresholds))
        return [sum(v > t for v in values) for t in thresholds]

    for most in (0, 1, 500, 999):
        asked.clear()
        cut = target_resampling.halved(values[0] - 1, values[-1], count, most)
        assert sum(v > cut for v in values) <= most < sum(v > cut - 1 for v in values) and len(asked) <= 6 and max(asked) <= 15


def test_empty_tables(spark):
    none = docs_of(spark, [(1, "x")]).limit(0)
    assert periodic_runs.periodic_runs(none).count() == 0 and token_counts.count_tokens(none).count() == 0
    assert target_resampling.resample(none, none).count() == 0
    (row,) = target_resampling.resample(docs_of(spark, [(1, "a b c")]), none, share=100, min_words=1).collect()
    assert (row.n_features, row["rank"]) == (3, 1)
    with pytest.raises(TypeError):
        target_resampling.resample(none.withColumn("doc_id", F.lit("a")), none)
