"""Pages whose marks mislead: wrappers, anchors, cards, leads; and templates that decide between them."""

import pytest

from tessera.llm import html_text

WORDS = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty twenty-one"
PROSE = f"<p>{WORDS} first.</p><p>{WORDS} second.</p>"
TEXT = f"{WORDS} first.\n\n{WORDS} second."


@pytest.mark.parametrize(
    "html, text",
    [
        (f"<body><form action='/x'><input name=v><div>{PROSE}</div><select><option>a</select></form></body>", TEXT),
        (f"<body><form><nav>menu</nav><main>{PROSE}</main></form></body>", TEXT),
        (f"<body><article>{PROSE}<form><label>Your mail, please</label><input></form></article></body>", TEXT),
        (f"<body><div class='modal-content'><article>{PROSE}</article></div><div class=modal>Sign up now</div></body>", TEXT),
        (f"<body><div class=comments><article class=comment>{PROSE} and {PROSE}</article></div><article>{PROSE}</article></body>", TEXT),
        (f"<body><article>{PROSE}</article><form><p>{WORDS} {WORDS} {WORDS} consent text that is longer than the article</p></form></body>", TEXT),
        (f"<body><article><section id='cookies'><p>{WORDS} first.</p></section><section id=footer-text><p>{WORDS} second.</p></section></article></body>", TEXT),
        (f"<body><article>{PROSE}<section class='cookies'><p>{WORDS}</p></section></article></body>", TEXT),
        (f"<body><article>{PROSE}</article><article class='card teaser'><h2>Other</h2><p>{WORDS}</p></article></body>", TEXT),
        (f"<body><article>{PROSE}</article><article><h2><a href='/other'>Other story</a></h2><p>{WORDS}</p></article></body>", TEXT),
        (f"<body><article><p>{WORDS} first.</p></article><article><h2>Part two</h2><p>{WORDS} second.</p></article></body>", f"{WORDS} first.\n\nPart two\n\n{WORDS} second."),
        (f"<body><div><h1>Title</h1><p>A lead.</p><article>{PROSE}</article></div></body>", f"Title\n\nA lead.\n\n{TEXT}"),
        (f"<body><h1>Away</h1><div>between</div><article>{PROSE}</article></body>", TEXT),
        (f"<body><p class=notice>Read this</p><article>{PROSE}</article></body>", TEXT),
        ("<body><article class=teaser><p>all there is</p></article></body>", "all there is"),
        ("<form></form>", ""),
    ],
)
def test_main_text(html, text):
    assert html_text.main_text(html) == text


def test_templates_decide_what_stands_before_an_article(spark):
    """On a host the site's name and a slogan stand before each article, as titles do; what recurs goes, the rest stays."""
    page = lambda i: f"<body><div><h1>The Site</h1><h2>Title {i}</h2><p>Our slogan, day by day.</p><article><p>{WORDS} number {i}.</p></article></div><div>{i} unmarked words at the end</div></body>"
    rows = [(i, f"http://a.example/{i}", page(i)) for i in range(12)] + [(99, "http://b.example/1", page(99))]
    got = {r.page_id: (r.text, r.n_templates) for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == (f"Title {i}\n\n{WORDS} number {i}.", 2) for i in range(12))
    assert got[99] == (f"The Site\n\nTitle 99\n\nOur slogan, day by day.\n\n{WORDS} number 99.", 0)  # nothing recurs on a host of one page


def test_templates_decide_on_pages_without_articles(spark):
    rows = [(i, f"http://a.example/{i}", f"<body><div class=x><p>Welcome to our pages, all of them.</p></div><div class=y><p>{WORDS} {i}.</p></div><div class=z>All rights are ours.</div></body>") for i in range(9)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"{WORDS} {i}." for i in range(9)}


def test_the_given_pages_are_as_before(spark):
    """All given pages have one article, no card and no heading beside it: their text is the article's, whatever else is marked."""
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        root = html_text.parse(r.html)
        todo, articles = [root], []
        while todo:
            node = todo.pop()
            articles += [node] if node.tag == "article" else []
            todo += [k for k in node.kids if isinstance(k, html_text.Node)]
        assert len(articles) == 1 and html_text.main_text(r.html) == "\n\n".join(html_text.blocks_of(articles[0]))
