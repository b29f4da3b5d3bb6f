"""Each operator against a brute-force version, and on rows with nulls, empty texts, repeats and clashing columns."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import chat, class_lm, embedding_links, html_text, passages, pieces, pu_quality, secrets, simhash, winnowing
from tessera.llm.components import connected_components

WORDS = [a + b for a in "ba ce di fo gu ka le mi no pu ra se ti vo xu".split() for b in "lan mer tis rox dup fin gol hex".split()]


def text_of(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def docs_of(spark, rows, clash=True):
    """rows of (doc_id, text); with columns whose names the operators use themselves."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({c: F.lit("x") for c in ("id", "h", "fp", "n", "key", "row", "word", "score", "hash", "component")}) if clash else df


class Union:
    def __init__(self):
        self.up = {}

    def root(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


# --- components --------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("shape", ["random", "path", "star", "none"])
def test_components(spark, shape):
    rng = random.Random(2)
    links = {"random": [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(50)], "path": [(i, i + 1) for i in range(60)], "star": [(0, i) for i in range(1, 50)], "none": []}[shape]
    truth = Union()
    for a, b in links:
        truth.join(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: truth.root(x) for a, b in links if a != b for x in (a, b)}


# --- 1 -----------------------------------------------------------------------------------------------------------------


def test_passages_cover_every_shared_window(spark):
    rng = random.Random(7)
    shared = [text_of(rng, 70), text_of(rng, 55)]
    texts = [text_of(rng, rng.randint(60, 200)) for _ in range(12)]
    for i in (1, 4, 6):
        texts[i] = f"{text_of(rng, 20)} {shared[0]} {texts[i]}"
    for i in (2, 4):
        texts[i] = f"{texts[i]} {shared[1]}"
    words = texts[8].split()
    words[30] = words[61] = "changed"
    rows = [*enumerate(texts), (20, texts[3]), (21, " ".join(words)), (22, None), (23, ""), (24, "short text"), (None, texts[1]), (4, texts[4])]
    got = passages.passages(docs_of(spark, rows)).collect()
    by = defaultdict(list)
    split = {d: t.lower().encode().split() for d, t in rows if d is not None and t}
    for r in got:
        by[r.id].append((r.start, r.end))
        by[r.other_id].append((r.other_start, r.other_end))
        if r.identity == 1:
            assert split[r.id][r.start : r.end] == split[r.other_id][r.other_start : r.other_end]
    seen = defaultdict(set)
    for d, w in split.items():
        for i in range(len(w) - 49):
            seen[tuple(w[i : i + 50])].add((d, i))
    for places in seen.values():
        if len({d for d, _ in places}) > 1:
            assert all(any(a <= i and i + 50 <= b for a, b in by[d]) for d, i in places)
    assert {d for d in by} == {1, 2, 4, 6, 3, 20, 8, 21}


def test_a_passage_of_parts_from_several_documents_is_one_passage(spark):
    rng = random.Random(14)
    parts = [text_of(rng, 11) for _ in range(6)]
    rows = [(i, f"{text_of(rng, 40)} {p} {text_of(rng, 40)}") for i, p in enumerate(parts)]
    rows += [(10 + i, f"{text_of(rng, 30)} {' '.join(parts)} {text_of(rng, 30)}") for i in range(2)]
    got = passages.passages(docs_of(spark, rows)).collect()
    assert [(r.id, r.start, r.end, r.other_id) for r in got] == [(11, 30, 96, 10)]


def test_passages_with_evenly_spaced_changes_are_found(spark):
    rng = random.Random(15)
    rows = []
    for i in range(40):
        words = text_of(rng, 55).split()
        changed = [f"other{i}" if j % 6 == 5 and j < 50 else w for j, w in enumerate(words)]
        rows += [(i, " ".join([text_of(rng, 30), *words, text_of(rng, 30)])), (100 + i, " ".join([text_of(rng, 30), *changed, text_of(rng, 30)]))]
    got = passages.passages(docs_of(spark, rows)).collect()
    assert {(r.id, r.other_id) for r in got} == {(100 + i, i) for i in range(40)}


def test_a_passage_in_many_documents_whose_parts_are_elsewhere_is_found(spark):
    rng = random.Random(16)
    rows, expected = [], set()
    for at in range(0, 600, 100):
        words = text_of(rng, 60).split()
        parts = [words[:34], words[26:], words]  # each seed of the whole is in a part
        for i in range(14):  # every other document has one part only
            rows.append((at + i, " ".join([text_of(rng, 30), *parts[2 if i > 1 and i % 2 == 0 else (i + 1) // 2 % 2], text_of(rng, 30)])))
        expected |= {(at + i, at + 2) for i in range(4, 14, 2)}
    got = passages.passages(docs_of(spark, rows)).collect()
    assert expected <= {(r.id, r.other_id) for r in got if r.start <= 30 and r.end >= 90}


def test_every_passage_of_a_pair_of_documents_is_found(spark):
    rng = random.Random(17)
    x, y, z = (text_of(rng, 60) for _ in range(3))
    own = lambda: text_of(rng, 30)
    rows = [(1, f"{x} {own()} {y}"), (2, f"{x} {own()} {y}"), (3, f"{own()} {z} {own()}"), (4, f"{z} {text_of(rng, 200)} {z}")]
    rows += [(5, f"{rows[3][1]} {own()}")]
    got = passages.passages(docs_of(spark, rows)).collect()
    covers = lambda i, start: any(r.id == i and r.start <= start and r.end >= start + 60 for r in got)
    assert covers(2, 0) and covers(2, 90) and covers(4, 0) and covers(4, 260) and covers(5, 260)
    twice = passages.passages(docs_of(spark, [(1, rows[3][1]), (2, rows[2][1])])).collect()
    assert {s for s in (0, 260) if any(r.id == 2 and r.other_start <= s and r.other_end >= s + 60 for r in twice)} == {0, 260}


def test_chains_are_the_best_by_brute_force():
    rng, k = random.Random(3), passages.K
    for _ in range(60):
        runs = sorted({(rng.randint(0, 90), rng.randint(0, 90), rng.randint(k, 15)) for _ in range(rng.randint(2, 9))})
        value: list = []
        for j, (q, t, n) in enumerate(runs):
            value.append(float(n))
            for i, (c, d, m) in enumerate(runs):
                qe, te = c + m - k + 1, d + m - k + 1
                if i < j and qe <= q and te <= t:
                    over = max(0, c + m - q, d + m - t)
                    value[j] = max(value[j], n - over + value[i] - passages.GAP * (q - qe + t - te))
        chains = passages.chains_of(np.array(runs).T)
        assert sorted(x for c in chains for x in zip(*c.tolist(), strict=True)) == runs
        for c in chains:
            assert (np.diff(c[0]) > 0).all() and (np.diff(c[1]) > 0).all()

        def score(c):
            total = float(c[2][0])
            for i in range(1, c.shape[1]):
                qe, te = (c[x][i - 1] + c[2][i - 1] - k + 1 for x in (0, 1))
                total += c[2][i] - max(0, qe + k - 1 - c[0][i], te + k - 1 - c[1][i]) - passages.GAP * (c[0][i] - qe + c[1][i] - te)
            return total

        if not any(max(c - a, d - b) > passages.MAX_GAP for a, b, _ in runs for c, d, _ in runs):  # no chain is cut
            assert max(map(score, chains)) == pytest.approx(max(value))


@pytest.mark.parametrize(("rate", "least"), [(0, 1.0), (0.05, 0.97), (0.1, 0.9)])
def test_recall_of_edited_passages(spark, rate, least):
    """200 passages of 60 words, of whose words `rate` are changed, left out or followed by another; found: 45 words of it."""
    rng, rows, truth = random.Random(21), [], {}
    for i in range(200):
        words, edited = text_of(rng, 60).split(), []
        for w in words:
            kind = rng.random() if rng.random() < rate else 1
            edited += [w] if kind == 1 else [f"new{rng.random()}"] if kind < 0.6 else [w, f"new{rng.random()}"] if kind < 0.8 else []
        rows += [(i, f"{text_of(rng, 30)} {' '.join(words)} {text_of(rng, 30)}"), (1000 + i, f"{text_of(rng, 30)} {' '.join(edited)} {text_of(rng, 30)}")]
        truth[1000 + i] = 30, 30 + len(edited)
    got = passages.passages(docs_of(spark, rows)).collect()
    assert all(r.other_id == r.id - 1000 for r in got)
    found = {r.id for r in got if min(r.end, truth[r.id][1]) - max(r.start, truth[r.id][0]) >= 45}
    assert len(found) >= least * 200


@pytest.mark.parametrize("copies", [3, 8, 40])
def test_copies_of_a_passage_are_found_however_many_there_are(spark, copies):
    rng, rows, expected, k = random.Random(22), [], set(), 0
    for _ in range(10):
        parts = [text_of(rng, 40) for _ in range(2)]
        for c in range(-2, copies):
            rows.append((k, f"{text_of(rng, 30)} {parts[c] if c < 0 else ' '.join(parts)} {text_of(rng, 30)}"))
            expected |= {k} if c > 0 else set()
            k += 1
            if c > 2 and c % 2:  # documents with one part stand between
                rows.append((k, f"{text_of(rng, 30)} {parts[c % 4 // 2]} {text_of(rng, 30)}"))
                k += 1
    found = {r.id for r in passages.passages(docs_of(spark, rows)).collect() if r.start <= 30 and r.end >= 110}
    assert found == expected


def test_frequent_seeds_are_linked_within_tasks_too(spark):
    rng = random.Random(23)
    words = text_of(rng, 70).split()
    rows = [(i, " ".join([text_of(rng, 20), *(w if rng.random() > 0.04 or i % 2 else "x" for w in words), text_of(rng, 20)])) for i in range(300)]
    for share in (1e-3, 0.5):  # all of the passage's seeds, none of them
        got = passages.passages(docs_of(spark, rows).repartition(5), hot_share=share).collect()
        found = {i for r in got for i in (r.id, r.other_id)}
        assert found == set(range(300)) and len(got) < 12 * len(rows)


@pytest.mark.parametrize("options", [{}, {"hot_share": 1e-3}, {"few": None}])
def test_texts_that_repeat_one_word_find_one_another(spark, options):
    """Stretches of one word, a short one before or after a long one in some; nothing else is shared."""
    rng = random.Random(47)
    stretch = lambda i: [f"{'of ' * (20 + i % 9)}{text_of(rng, 25)}", "of " * (55 + 3 * i)][:: 1 if i % 3 else -1]
    rows = [(i, f"{text_of(rng, 30)} {' '.join(stretch(i))} {text_of(rng, 30)}") for i in range(14)]
    got = passages.passages(docs_of(spark, rows).repartition(4), **options).collect()
    assert all(min(r.end - r.start, r.other_end - r.other_start) >= passages.MIN_WORDS for r in got)
    reached = {0}
    for _ in rows:
        reached |= {x for r in got for x in (r.id, r.other_id) if r.id in reached or r.other_id in reached}
    assert reached == set(range(14))
    if "few" in options:  # each with each
        assert {(r.id, r.other_id) for r in got} == {(i, j) for i in range(14) for j in range(i)}


def not_told(got, whole, least=passages.MIN_WORDS):
    """Rows of whole whose documents `got` neither lists together nor lists with the same words of a third one."""
    places, pairs = {}, {(r.id, r.other_id) for r in got}
    for r in got:
        places.setdefault(r.id, []).append((r.other_id, r.start, r.end, r.other_start, r.other_end))
        places.setdefault(r.other_id, []).append((r.id, r.other_start, r.other_end, r.start, r.end))
    meets = lambda doc, low, high: [x for x in places.get(doc, []) if x[1] < high and x[2] > low]
    told = lambda r: any(x[0] == y[0] and min(x[4], y[4]) - max(x[3], y[3]) >= least for x in meets(r.id, r.start, r.end) for y in meets(r.other_id, r.other_start, r.other_end))
    return [tuple(r) for r in whole if (r.id, r.other_id) not in pairs and not told(r)]


@pytest.mark.parametrize("options", [{}, {"hot_share": 1e-3}])
@pytest.mark.parametrize("kind", ["blocks", "one word", "windows"])
def test_no_link_is_lost_however_frequent_the_seeds(spark, kind, options):
    """Each pair that all places each with each give is listed, or both documents are with the same words of a third one."""
    rng, rows = random.Random(61), []
    blocks = [text_of(rng, 27) for _ in range(9)]
    for i in range(16 if kind == "one word" else 50):
        if kind == "blocks":  # each block is in a third of the documents, two in a row in a few
            rows.append((i, f"{text_of(rng, 20)} {' '.join(rng.sample(blocks, 3))} {text_of(rng, 20)}"))
        elif kind == "one word":
            rows.append((i, " ".join(f"{text_of(rng, 12)} {'of ' * rng.choice([20, 52, 56, 60])}" for _ in range(2))))
        else:  # stretches of one text that begin and end anywhere
            words, low = " ".join(blocks).split(), rng.randrange(180)
            rows.append((i, f"{text_of(rng, 20)} {' '.join(words[low : low + rng.randint(52, 80)])} {text_of(rng, 20)}"))
    docs = docs_of(spark, rows).repartition(3)
    whole = [r for r in passages.passages(docs, few=None).collect() if r.identity == 1.0 and r.end - r.start > passages.MIN_WORDS]
    assert len({(r.id, r.other_id) for r in whole}) > 30
    assert not_told(passages.passages(docs, **options).collect(), whole) == []


def test_no_link_is_lost_between_near_copies_of_a_passage(spark):
    rng = random.Random(5)
    words = text_of(rng, 100).split()
    rows = [(i, " ".join([text_of(rng, 20), *(w if rng.random() > 0.05 else text_of(rng, 1) for w in words), text_of(rng, 20)])) for i in range(24)]
    docs = docs_of(spark, rows).repartition(3)
    whole = passages.passages(docs, few=None).collect()
    assert len({(r.id, r.other_id) for r in whole}) == 24 * 23 // 2
    assert not_told(passages.passages(docs).collect(), whole) == []


def test_passages_edges(spark):
    rng = random.Random(24)
    long_text = text_of(rng, 60_000)
    assert passages.passages(docs_of(spark, [(1, "x")]).limit(0)).count() == 0
    got = passages.passages(docs_of(spark, [(1, long_text), (2, f"{text_of(rng, 30)} {long_text[200_000:]}"), (3, None), (4, ""), (3, None)])).collect()
    assert [(r.id, r.other_id, r.end - r.start > 20_000, r.identity) for r in got] == [(2, 1, True, 1.0)]
    copy = text_of(rng, 60)
    named = spark.createDataFrame([("a", copy), ("b", copy + " more"), (None, copy)], "doc_id string, text string")
    assert {(r.id, r.other_id) for r in passages.passages(named).collect()} in ({("a", "b")}, {("b", "a")})


# --- 2 -----------------------------------------------------------------------------------------------------------------


def test_html(spark):
    pages = [(i, f"https://h.example/{i}", f"<html><body><div><ul><li>Home<li>News</ul></div><div><p>Body number {i} &amp; more.<p>Second  line\n{i}</div><div class='legal'>Terms of use</div></body></html>") for i in range(9)]
    pages += [(20, None, None), (21, "x", ""), (22, "http://b.example/", "<article><h1>T</h1><p>a<br>b &lt;c&gt;</p><div class='comments'>no</div><form>no</form></article><footer>no</footer>"), (22, "http://b.example/", "<p>again")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit("z")).withColumn("templates", F.lit("z"))
    got = sorted((r.page_id, r.text) for r in html_text.extract(df).collect())
    assert got[0] == (0, "Body number 0 & more.\n\nSecond line 0")  # menu and legal line recur on the host
    assert got[9:] == [(20, ""), (21, ""), (22, "T\n\na b <c>"), (22, "again")]


def test_html_templates_inside_articles(spark):
    box = "<div class='box'><p>Get our letter every week.</p></div>"
    page = lambda i: f"<main><article><h2>Summary</h2><p>Story {i} is <b>not</b> long.</p>{box}</article><article><p>Second story {i}.</p></article></main>"
    pages = [(i, f"https://h.example/{i}", page(i)) for i in range(6)]
    pages += [(20 + i, f"https://copied.example/{i}", "<article><p>One article.</p><p>On all pages.</p></article>") for i in range(6)]
    pages += [(30 + i, f"https://main.example/{i}", f"<main><p>Text {i}.</p><p>All rights reserved.</p></main>") for i in range(6)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[3] == "Summary\n\nStory 3 is not long.\n\nSecond story 3."
    assert got[22] == "One article.\n\nOn all pages."
    assert got[31] == "Text 1."


@pytest.mark.parametrize("name", ["related work", "social-policy", "promotion-analysis", "alert fatigue", "label"])
def test_prose_is_not_deleted_by_a_class_alone(name):
    body = " ".join(["words of the article itself"] * 8)
    tag = "label" if name == "label" else "section"
    assert html_text.main_text(f"<article><h1>T</h1><{tag} class='{name}'>{body}</{tag}></article>").replace("\n\n", " ").replace("T ", "T") == f"T{body}"


def test_what_is_not_the_article_goes():
    gone = ["<div class='ad'>Buy now.</div>", "<div class='comments-list'><p>I think so.</p></div>", "<aside>x</aside>", "<div class='related'><a href='/1'>One</a></div>", "<div id='share_buttons'>s</div>", "<nav>m</nav>", "<form>f</form>"]
    page = f"<body><header>h</header><div class='cookie-banner'>ok?</div><main><p>Lead.</p><article><h1>T</h1>{''.join(gone)}<p>One.</p></article><article><p>Two.</p></article><article class='comment'><p>No.</p></article></main><footer>f</footer></body>"
    assert html_text.main_text(page) == "Lead.\n\nT\n\nOne.\n\nTwo."


def test_templates_against_brute_force(spark):
    rng, rows = random.Random(41), []
    for i in range(60):
        host, body = i % 3, [f"<p>{text_of(rng, 12)}</p>" for _ in range(4)]
        if i % 2:
            body.insert(rng.randint(0, 4), f"<div><b>Letter {host}</b> every week.</div>")
        rows.append((i, f"https://h{host}.example/{i}", f"<div>Top {host}</div><ul><li>Home</li></ul><article>{''.join(body)}</article><p>Rights of {host}.</p>"))
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    for r in got:  # all that recurs is known here
        html = rows[r.page_id][2]
        article = html[html.index("<article>") :].split("</article>")[0]
        assert r.text.split("\n\n") == [x for x in re.findall(r"<p>(.*?)</p>", article)]
        assert r.n_templates == 3 + r.page_id % 2


def test_html_edges(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_text.extract(empty).count() == 0
    long_page = "<article>" + "".join(f"<p>word {i}</p>" for i in range(30_000)) + "</article>"
    got = html_text.extract(spark.createDataFrame([(1, "x", long_page), (1, "x", long_page), (None, None, "<p>a")], empty.schema)).collect()
    assert sorted(len(r.text.split("\n\n")) for r in got) == [1, 30_000, 30_000]


def test_html_is_the_same_at_any_size_of_broadcast(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    assert sorted(html_text.extract(df).collect()) == sorted(html_text.extract(df, max_broadcast=0).collect())


def test_deep_and_broken_html():
    assert html_text.main_text("<div>" * 5000 + "x" + "</div>" * 10) == "x"
    assert html_text.main_text("a < b <b>c</i></b> <!-- d") == "a < b c"
    assert html_text.main_text("<p>x<script>y</p>") == "x"


# --- 3 -----------------------------------------------------------------------------------------------------------------


def test_pu_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    got = pu_quality.op3_pu_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    right = sum((r.predicted == 1) == (r.quality == 1) for r in got) / len(got)
    assert right > 0.98
    for r in got[:200]:
        assert (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) == r.held_out and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)


def test_pu_quality_edges(spark):
    rng = random.Random(1)
    rows = [(i, text_of(rng, 40)) for i in range(30)] + [(50, None), (51, ""), (None, "a b"), (1, "again")]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)] + [(21, 0, 0), (22, None, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    out = pu_quality.score(docs_of(spark, rows), labels).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    none = pu_quality.score(docs_of(spark, rows), labels.limit(0)).collect()
    assert {r.score for r in none} == {pu_quality.DEFAULT_PRIOR}
    assert pu_quality.score(docs_of(spark, rows).limit(0), labels).count() == 0
    kept = pu_quality.keep_good(docs_of(spark, rows), labels)
    assert kept.columns == docs_of(spark, rows).columns


# --- 4 -----------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("part", [4096, 16])
def test_cover_tree_equals_all_pairs(spark, part):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(12, 8))
    x = base[rng.integers(0, 12, 150)] + rng.normal(size=(150, 8)) * rng.choice([0.01, 0.1, 0.3], (150, 1))
    x[140:] = x[3]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(200, None), (201, [0.0] * 8), (202, [float("nan")] * 8), (203, [1.0, 2.0]), (204, [2.0, 4.0]), (205, []), (3, x[3].tolist()), (206, [None] * 8), (207, [float("inf")] + [0.0] * 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cls", F.lit(1)).withColumn("v", F.lit(1))
    got = embedding_links.near_duplicates(df, part=part).collect()
    vectors = [(i, u) for i, v in rows if (u := embedding_links.clean(v)) is not None]
    links, truth = Counter(), Union()
    for a, (i, u) in enumerate(vectors):
        for j, w in vectors[a + 1 :]:
            if len(u) == len(w) and u @ w >= 0.9:
                links[i] += 1
                links[j] += 1
                truth.join(i, j)
    assert len(got) == len(rows)
    for r in got:
        if r.vec_id != 3:
            assert r.n_links == links[r.vec_id], r
        assert r.component == truth.root(r.vec_id)


def test_cover_tree_is_the_same_with_many_groups(spark, monkeypatch):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(40, 6))
    x = base[rng.integers(0, 40, 400)] + rng.normal(size=(400, 6)) * 0.15
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    whole = sorted(embedding_links.near_duplicates(df).collect())
    monkeypatch.setattr(embedding_links, "MAX_TOPS", 0)
    monkeypatch.setattr(embedding_links, "MAX_PAIRS", 0)
    assert sorted(embedding_links.near_duplicates(df, part=16, group=2).collect()) == whole
    assert embedding_links.near_duplicates(df.limit(0)).count() == 0


# --- 5 -----------------------------------------------------------------------------------------------------------------

HARD = ["", " ", "  a", "a  b ", "▁", "a▁b", "▁▁a ▁ b", "x\n\ty 😀 ▁", " ▁", "日本語 é", "don't  stop\r\n", "  nbsp", "ﷺ"]


def test_pieces_round_trip_and_equal_the_library(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows = [*enumerate(HARD + texts), (9000, None), (None, "x")]
    got = pieces.encode(docs_of(spark, rows)).collect()
    assert all(r.round_trip for r in got) and len(got) == len(rows)
    by = {r.doc_id: r.ids for r in got}
    for i, t in rows:
        if t and "▁" not in t:
            assert by[i] == model.encode(t), t
    back = pieces.decode(pieces.encode(docs_of(spark, rows)))
    assert {r.doc_id: r.text for r in back.collect()} == {i: t or "" for i, t in rows}


def test_additive_scores_by_brute_force():
    rng = random.Random(4)
    scores = {w: (-rng.random() * 9, i) for i, w in enumerate(["a", "b", "ab", "ba", "aba", "abb", "▁", "▁a", "bab"])}
    vocab = pieces.Vocabulary(scores, list(range(100, 356)), [], -9.0, False)

    def best(w):
        ways = [(0.0, [])] if not w else []
        for k in range(1, len(w) + 1):
            if w[:k] in scores:
                v, ids = best(w[k:])
                ways.append((scores[w[:k]][0] + v, [scores[w[:k]][1], *ids]))
        if w and w[0] not in scores:
            v, ids = best(w[1:])
            ways.append((vocab.least - pieces.UNKNOWN + v, [100 + x for x in w[0].encode()] + ids))
        return max(ways)

    words = ["▁" + "".join(rng.choice("ab") for _ in range(rng.randint(0, 7))) for _ in range(200)] + ["▁aça", "ç"]
    for w, raw in pieces.encode_words(words, vocab).items():
        assert np.frombuffer(raw, "<i4").tolist() == best(w)[1]


# --- 6 -----------------------------------------------------------------------------------------------------------------


def base_spans(text):
    out = []
    for m in re.finditer(r"""(?a:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[1]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24]
    return sorted(out)


def test_secrets_equal_plain_patterns(spark):
    rng = random.Random(6)
    parts = ["password", "Secret", "TOKEN", "api_key", "ApiKey", "passwd", "=", ": ", " = \"", "'", "abc", "x" * 7, "deadbeef" * 3, "AKIA", "ABCDEFGH12345678", "é", "\n", " ", "f" * 23, "f" * 24, "ſ", "tokentoken=abcdef"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(1500)]
    for t in texts:
        assert [s for s in secrets.find_secrets(t) if s[1] < 3] == base_spans(t), t
    body = "A1b2C3d4E5f6G7h8I9j0K1l2M3n4O5"
    good = f"ghp_{body}{secrets.checksum62(body)}"
    assert [s[1] for s in secrets.find_secrets(f"x {good} y")] == [3]
    assert secrets.find_secrets(f"x {good[:-1]}{'0' if good[-1] != '0' else '1'} y") == []
    df = docs_of(spark, [(1, f"é {good}!"), (2, None), (3, ""), (None, "token=abcdef"), (1, "clean")]).withColumn("n_chars", F.lit(5).cast("long"))
    out = {(r.doc_id, r.text): r.n_chars for r in secrets.redact(df).collect()}
    assert out == {(1, "é [SECRET]!"): 11, (2, None): 5, (3, ""): 0, (None, "[SECRET]"): 8, (1, "clean"): 5}
    assert secrets.scan(df).count() == 5 and secrets.scan(df.limit(0)).count() == 0


# --- 7 -----------------------------------------------------------------------------------------------------------------


def test_language_model_base_scores(spark):
    rng = random.Random(8)
    rows = [(i, text_of(rng, rng.randint(0, 60)).title()) for i in range(60)] + [(100, None), (101, ""), (None, "ba ce"), (5, "\x0bnew\x1cword é É ")]
    got = class_lm.score(docs_of(spark, rows), classes=6).collect()
    assert len(got) == len(rows)
    split = lambda t: re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower())
    counts: Counter = Counter()
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    for d, t in rows:
        if not held(d):
            counts.update([*split(t), None])
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for d, t in rows:
        w = [*split(t), None]
        want[d, held(d), len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 6)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)
    assert class_lm.score(docs_of(spark, rows).limit(0)).count() == 0


def test_exchange_finds_planted_classes():
    rng = random.Random(9)
    kinds = [["a1", "a2", "a3"], ["b1", "b2", "b3"], ["c1", "c2"]]
    seq = [rng.choice(kinds[i % 3]) for i in range(6000)]
    words = sorted({w for k in kinds for w in k})
    model = class_lm.Classes([w.encode() for w in words], 4)
    ids = np.array([0, *model.sequence([w.encode() for w in seq]), 0])
    def counts():
        before, after = (np.zeros((model.n, 4)) for _ in range(2))
        np.add.at(before, (ids[1:], model.of[ids[:-1]]), 1)
        np.add.at(after, (ids[:-1], model.of[ids[1:]]), 1)
        return before, after

    value = lambda: class_lm.likelihood(class_lm.pair_counts(counts()[1], model.of, 4))
    reached = [value()]
    for i in range(12):
        model.of = class_lm.exchange(*counts(), model.of, 4, i % 2, 2)
        reached.append(value())
    for k, kind in enumerate(kinds):
        for w in kind:
            model.of[model.ids[w.encode()]] = 1 + k
    assert max(reached) > reached[0] + 0.9 * (value() - reached[0])


# --- 8 -----------------------------------------------------------------------------------------------------------------


def hits_of(text, items):
    cut = lambda t: [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
    words, hit, found = cut(text), set(), set()
    for name, t in items:
        w = cut(t)
        k = min(13, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            for j in range(len(words) - k + 1):
                if words[j : j + k] == w[i : i + k]:
                    hit |= set(range(j, j + k))
                    found.add(str(name))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("limit", [10_000, 0])
@pytest.mark.parametrize("short", [True, False])
def test_decontamination_equals_brute_force(spark, limit, short):
    rng = random.Random(10)
    items = [(i, text_of(rng, rng.randint(13, 30)).title()) for i in range(6)] + [(6, None), (7, "!!"), (8, "İx É ΟΔΟΣ " + text_of(rng, 14))]
    items += [(9, "fomer tilan"), (10, text_of(rng, 7)), (11, "ralan")] if short else []
    rows = [(i, text_of(rng, 60)) for i in range(8)] + [(20, None), (21, ""), (22, items[0][1].upper().replace(" ", "--") + " tail"), (23, text_of(rng, 9) + " " + items[1][1] + ", " + items[1][1]), (24, items[8][1] + " x"), (26, items[8][1].replace("ΟΔΟΣ ", "ΟΔΟΣ'")), (25, " ".join(items[2][1].split()[2:14])), (None, items[3][1]), (22, "other row"), (22, "other row")]
    got = winnowing.decontaminate(docs_of(spark, rows), spark.createDataFrame(items, "item_id long, text string").withColumn("hash", F.lit(1)), max_broadcast=limit).collect()
    want = sorted((str(d), *hits_of(t, items)) for d, t in rows)
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, list(r.item_ids)) for r in got) == want


def test_decontamination_without_items_or_documents(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = docs_of(spark, [(1, "a b"), (2, None)])
    assert [(r.n_hit, r.n_items) for r in winnowing.decontaminate(docs, none).collect()] == [(0, 0)] * 2
    assert winnowing.decontaminate(docs.limit(0), none).count() == 0
    assert winnowing.drop_contaminated(docs, none).count() == 2


# --- 9 -----------------------------------------------------------------------------------------------------------------


def test_simhash_equals_brute_force(spark):
    rng = random.Random(11)
    base = [text_of(rng, 200) for _ in range(12)]
    rows = list(enumerate(base))
    for i in range(40):
        w = rng.choice(base).split()
        w[rng.randrange(len(w))] = "new"
        rows.append((100 + i, " ".join(w)))
    rows += [(300, None), (301, ""), (302, "one two"), (303, "One two"), (304, "é É"), (None, base[0]), (5, base[5])]
    got = simhash.near_duplicates(docs_of(spark, rows)).collect()

    def print_of(t):
        w = (t or "").encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0

    prints = {(d, t): print_of(t) for d, t in rows}
    truth = Union()
    known = [(d, f) for (d, _), f in prints.items() if d is not None]
    for i, (d, f) in enumerate(known):
        for e, g in known[i + 1 :]:
            if (f ^ g).bit_count() <= 4:
                truth.join(d, e)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            assert r.component == truth.root(r.doc_id)
    assert sorted(r.fp % (1 << 64) for r in got) == sorted(print_of(t) for _, t in rows)
    kept = simhash.keep_first(docs_of(spark, rows))
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d) for d, _ in rows if d is None or truth.root(d) == d)


@pytest.mark.parametrize("chunk", [8, 4096])
def test_bit_sliced_links_connect_what_all_pairs_connect(spark, chunk):
    rng = random.Random(12)
    seeds = [rng.getrandbits(64) for _ in range(5)]
    fps = sorted({rng.choice(seeds) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(200)})
    df = spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long")
    got, want = Union(), Union()
    for r in simhash.near_links(df, chunk=chunk).collect():
        assert ((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 4
        got.join(r.a % (1 << 64), r.b % (1 << 64))
    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                want.join(a, b)
    assert [got.root(f) for f in fps] == [want.root(f) for f in fps]


# --- 10 ----------------------------------------------------------------------------------------------------------------


def test_chat_recovers_hidden_roles(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    hidden = df.withColumn("role", F.when(F.pmod(F.xxhash64("conv_id", "turn"), F.lit(5)) == 0, F.lit(None)).otherwise(F.col("role")))
    got = chat.format_turns(hidden).filter("part = 0").select("conv_id", "turn", F.col("role").alias("found"), "role_given").join(df, ["conv_id", "turn"]).collect()
    assert all(r.found == r.role for r in got if r.role_given)
    asked = [r for r in got if r.role_given is None]
    assert len(asked) > 50 and sum(r.found == r.role for r in asked) / len(asked) > 0.9


def test_chat_transcripts_and_edges(spark):
    rows = [(1, 0, None, "User: hi\nthere\nAssistant: hello\n### Human:\nok"), (2, 0, "user", None), (2, 1, "", ""), (2, 1, "assistant", "x"), (2, None, "weird", "y"), (None, 0, "human", "z"), (2, 1, "assistant", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segment", F.lit(1)).withColumn("entry", F.lit(1))
    got = chat.format_turns(df).collect()
    one = [(r.part, r.role, r.text) for r in sorted(got, key=lambda r: r.part) if r.conv_id == 1]
    assert one == [(0, "user", "hi\nthere"), (1, "assistant", "hello"), (2, "user", "ok")]
    assert sum(r.conv_id == 2 for r in got) == 5 and sum(r.conv_id is None for r in got) == 1  # a repeated row is a turn
    assert chat.format_turns(df.limit(0)).count() == 0


def test_long_conversations_are_decoded_as_a_whole(spark, monkeypatch):
    rng = random.Random(13)
    rows = [(1, i, None if rng.random() < 0.3 else ("user", "assistant")[i % 2], text_of(rng, (6, 60)[i % 2])) for i in range(40)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = sorted((r.turn, r.part, r.role) for r in chat.format_turns(df).collect())
    monkeypatch.setattr(chat, "SEGMENT", 7)
    assert sorted((r.turn, r.part, r.role) for r in chat.format_turns(df).collect()) == whole


def test_roles_come_from_the_lines_alone(spark):
    sf = "/root/testdata/sf0.1"
    got = chat.op10_chat(spark, sf).filter("part = 0").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == spark.read.parquet(f"{sf}/conversations.parquet").count() and len(held) > 1000
    assert sum(r.role == r.role_given for r in held) / len(held) > 0.95
    assert sum(r.role == r.role_given for r in got) / len(got) > 0.95
    # roles that are nonsense change nothing where they are held out
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    held = F.crc32(F.col("conv_id").cast("string").cast("binary")) % chat.FOLDS == chat.HELD_OUT
    other = df.withColumn("role", F.when(held, F.lit("assistant")).otherwise(F.col("role")))
    rows = lambda x: sorted((r.conv_id, r.turn, r.part, r.rendered) for r in chat.format_turns(x, use_roles=False).collect())
    assert rows(df) == rows(other)


def test_decoded_paths_are_the_best_of_all(spark):
    rng, nr = random.Random(31), np.random.default_rng(31)
    for _ in range(20):
        step = np.log(nr.random((chat.STATES + 1, chat.STATES)))
        step[:, 1::2] = [[x if s // 2 == r else -np.inf for r, x in enumerate(row[1::2])] if s < chat.STATES else [-np.inf] * 3 for s, row in enumerate(step)]
        emit = np.log(nr.random((chat.STATES, chat.MARKS, chat.FEATURES)))
        lines = [(rng.randrange(chat.MARKS), rng.randrange(chat.FEATURES), "") for _ in range(5)]

        def value(path, step=step, emit=emit, lines=lines):
            return sum(step[a, b] + emit[b, m, f] for a, b, (m, f, _) in zip([chat.STATES, *path], path, lines, strict=False))

        best = max(value(p) for p in itertools.product(range(chat.STATES), repeat=len(lines)))
        found = chat.decode_lines(lines, chat.START, np.zeros(chat.STATES), step, emit)
        assert value(found) == pytest.approx(best) == pytest.approx(chat.transfer(lines, step, emit)[chat.STATES].max())


def test_very_long_conversations_are_chained_in_levels(spark, monkeypatch):
    rng = random.Random(33)
    rows = [(None, i, ("user", "assistant")[i % 2], text_of(rng, (6, 60)[(i + i // 50) % 2])) for i in range(230)] + [(7, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    marks = lambda lots: lots.join(chat.long_ones(lots), "lot", "left").fillna(False)
    step, emit = chat.fit(marks(chat.lots_of(df, "conv_id", "turn", "role", "text")), False)

    def value():
        """The score of the path that is found; other paths may be as good."""
        got = sorted((r.turn, r.role) for r in chat.format_turns(df, use_roles=False).filter("conv_id is null").collect())
        path = [chat.STATES, *(2 * chat.ROLES.index(r) for _, r in got)]
        return sum(step[a, b] + emit[b, m, f] for a, b, (m, f, *_) in zip(path, path[1:], (x for i, r in enumerate(rows[:230]) for x in chat.lines_of(r[3], i == 0)), strict=False))

    whole = value()
    monkeypatch.setattr(chat, "SEGMENT", 4)
    monkeypatch.setattr(chat, "CHAIN", 5)
    assert value() == pytest.approx(whole)


def test_class_scores_by_hand(spark):
    """With two classes (the end, all words) nothing can move, so the model can be written down."""
    rng = random.Random(51)
    rows = [(i, text_of(rng, rng.randint(0, 30))) for i in range(60)] + [(70, None), (71, ""), (3, "a repeated id"), (72, text_of(rng, 30_000))]
    got = class_lm.score(docs_of(spark, rows), classes=2).collect()
    words = lambda t: (t or "").encode().lower().split()
    learn = [words(t) for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    counts, steps = Counter(w for x in learn for w in x), Counter()
    for x in learn:
        classes = [0, *(1 for _ in x), 0]
        steps.update(zip(classes, classes[1:], strict=False))
    out_of, total, kinds = [sum(steps[a, b] for b in (0, 1)) for a in (0, 1)], [len(learn), sum(counts.values())], [1, len(counts)]

    def value(text):
        tokens = [None, *words(text), None]
        c = lambda w: len(learn) if w is None else counts[w]
        k = lambda w: int(w is not None)
        return sum(math.log10((steps[k(a), k(b)] + 1) / (out_of[k(a)] + 2)) + math.log10((c(b) + 1) / (total[k(b)] + kinds[k(b)] + 1)) for a, b in zip(tokens, tokens[1:], strict=False))

    assert sorted((r.doc_id, round(r.score, 6)) for r in got) == sorted((i, round(value(t), 6)) for i, t in rows)
    assert class_lm.score(docs_of(spark, rows).limit(0)).count() == 0


def test_shapes_are_the_same_in_spark_and_python(spark):
    rng = random.Random(52)
    words = ["a", "ab", "abc", "é", "日本語", "x" * 40, *text_of(rng, 50).split()]
    model = class_lm.Classes([], 4)
    rows = spark.createDataFrame([(w.encode(),) for w in words], "word binary").select(class_lm.shape("word").alias("s")).collect()
    assert [r.s + 1 for r in rows] == model.sequence([w.encode() for w in words])


def test_classes_help_on_held_out_text(spark):
    got = [r for r in class_lm.op7_class_lm(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got) + 0.1 * sum(r.n_tokens for r in got)


@pytest.mark.parametrize("shortest", [2, 5, 8, 13])
def test_winnowing_with_short_items_against_brute_force(spark, shortest):
    rng = random.Random(53)
    items = [(f"i{k}", text_of(rng, n)) for k, n in enumerate([shortest, 13, 20, 40])] + [("none", "!"), (None, text_of(rng, 15))]
    rows = [(i, f"{text_of(rng, 10)} {rng.choice(items)[1]} {text_of(rng, rng.randint(0, 60))} {' '.join(rng.choice(items)[1].split()[3:17])}") for i in range(40)]
    rows += [(50, None), (51, ""), (7, rows[7][1]), (7, rows[7][1]), (52, text_of(rng, 20_000) + " " + items[2][1])]
    got = winnowing.decontaminate(docs_of(spark, rows), spark.createDataFrame(items, "item_id string, text string")).collect()
    words = lambda t: [w for w in re.split(winnowing.BETWEEN, (t or "").lower()) if w]
    windows = defaultdict(set)
    for k, t in items:
        w = words(t)
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[i : i + n])].add(k or "")
    want = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for a in range(len(w) - n + 1):
                if (own := tuple(w[a : a + n])) in windows:
                    hit |= set(range(a, a + n))
                    found |= windows[own]
        want.append((i, len(w), len(hit), sorted(found)))
    assert sorted((r.doc_id, r.n_words, r.n_hit, list(r.item_ids)) for r in got) == sorted(want)


def test_secret_query_columns_against_brute_force(spark):
    got = {r.doc_id: r for r in secrets.op6_secret_scan(spark, "/root/testdata/sf0.001").collect()}
    base = {
        "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
        "access": re.compile("AKIA[A-Z0-9]+"),
        "hex": re.compile("[0-9a-f]+"),
    }
    fine = {"assign": lambda m: len(m[2]) >= 6, "access": lambda m: len(m[0]) >= 20, "hex": lambda m: len(m[0]) >= 24}
    for d in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect():
        found = {k: [m.span() for m in x.finditer(d.text or "") if fine[k](m)] for k, x in base.items()}
        r, order = got[d.doc_id], list(base)
        spans = sorted((a, order.index(k), b) for k, xs in found.items() for a, b in xs)
        text = ",".join(f"{order[k]}:{a}:{b}" for a, k, b in spans)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(len(found[k]) for k in order)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert set(filter(None, text.split(","))) <= set(r.spans.split(","))
