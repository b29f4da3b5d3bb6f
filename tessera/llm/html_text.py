"""HTML extraction: subtrees that recur across a host's pages are templates and go; the article's text stays.

A page becomes a tree. Each subtree gets a hash of its tags, classes, text and children. Spark counts, per host, the pages on
which each hash occurs outside explicit articles (pre-aggregated, distinct per page). Hashes found on many pages of a host are
that host's template and are cut out of the page first. Then go elements whose tag, role or class says that they are menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles or reader comments; a class that may as well be about the subject
doesn't delete running text. A form or a marked element around the page's longest article, or around half of the prose of a page without
one, is a wrapper and stays. The blocks inside explicit articles (article, main) are
counted by the different articles that hold them, as the same article may well stand on many pages; headings, single items and cells,
and what is part of a sentence stay. The text is that of all articles of the page, in its order; of an article in a main
element, that of the main element. Of several articles, cards that lead to other pages are left out. Headings and paragraphs that stand
right before an article belong to it, unless they recur on the host.

A host's template hashes are few: each is on at least `min_share` of its pages, so there are at most 1/min_share times as
many as a page has subtrees on average. They are joined to the pages by host, broadcast if their counted rows are few.

Defined results. Null or empty html: empty text. Null url: host ''. Repeated rows: each row is extracted by itself (and is
counted as a page of its own). Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import html as html_lib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import bounded_broadcast, staged, table

# HTML's elements without an end tag, with raw text, and those that make a block of their own.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe xmp noframes".split())
BLOCKS = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul option select video audio".split())
# Blocks that may say the same in many articles without being a template.
PARTS = set("article main body html h1 h2 h3 h4 h5 h6 hr li dt dd tr td th tbody thead tfoot caption figcaption legend option summary".split())
# A start tag of the key ends an open element of the values.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
ENDS_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul li dd dt".split())
LIMITS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}
# Elements, roles and words of class or id that mark what isn't the article.
DROPPED = set("head script style noscript template nav footer aside button select option textarea iframe svg canvas object embed dialog menu title input".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
SURE = set("ad ads advert adverts advertisement advertisements advertising adsense adslot adbox cookie cookies consent gdpr sponsor sponsors sponsored sidebar sidebars nav navs navbar navigation footer footers masthead breadcrumb breadcrumbs comment comments disqus share sharing newsletter newsletters subscribe signup popup popups modal modals login pagination pager copyright disclaimer".split())
# Words that mark such a part too, but may be about the article's subject: prose under them stays.
MAYBE = set("banner banners notice notices alert alerts promo promos promotion promotions menu menus replies reply respond social related recommended subscription overlay widget widgets toolbar skip".split())
# What such words are combined with.
WITH = set("area bar block body bottom box button buttons container content count entry footer form group header holder icon icons inner item items left line link links list main message module page panel right section site slot strip text thread title top unit user widget wrap wrapper".split())
HEADERS = set("header headers topbar".split())
# Words of a card that leads to another page; words under which even most of a page's prose isn't the article.
CARDS = set("card cards teaser teasers preview tile snippet excerpt related recommended promo".split())
NEVER = set("comment comments reply replies respond disqus ad ads advert adverts advertisement advertisements advertising".split())
LEADS = set("h1 h2 hgroup p".split())
ANCHORED = set("section h1 h2 h3 h4 h5 h6".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")
SPACE = re.compile(r"[ \t\n\r\f\v]+")
MIN_PAGES, MIN_SHARE, MAX_BROADCAST_ROWS, PROSE = 3, 0.2, 100_000, 20
#: Inside articles, where short paragraphs may be alike by chance: of a host's different articles.
INSIDE_SHARE = 0.5


class Node:
    __slots__ = ("attrs", "kids", "tag")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.kids = tag, attrs, []


def host_of(url: str | None) -> str:
    m = HOST.match(url or "")
    return m[1].lower() if m else ""


def parse(html: str) -> Node:
    """A tree of nodes; kids are nodes and raw text."""
    root = Node("#root")
    stack, at, n = [root], 0, len(html)
    while at < n:
        m = TOKEN.search(html, at)
        if not m:
            stack[-1].kids.append(html[at:])
            break
        if m.start() > at:
            stack[-1].kids.append(html[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            block = tag in BLOCKS
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if not block and stack[i].tag in BLOCKS:
                    break  # an inline element's end doesn't end a block
            continue
        if tag in ENDS_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag in BLOCKS:
                    break
        if tag in ENDS:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in ENDS[tag]:
                    del stack[i:]
                    break
                if stack[i].tag in LIMITS.get(tag, ()):
                    break
        node = Node(tag, m[3])
        stack[-1].kids.append(node)
        if tag in VOID or m[3].endswith("/"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(html, at)
            node.kids.append(html[at : end.start() if end else n])
            at = end.end() if end else n
            continue
        stack.append(node)
    return root


def attributes(node: Node) -> dict[str, str]:
    if "=" not in node.attrs and "hidden" not in node.attrs:
        return {}
    return {m[1].lower(): html_lib.unescape(m[2] or m[3] or m[4] or "") for m in ATTR.finditer(node.attrs)}


def is_prose(node: Node) -> bool:
    """Whether there is running text under a node: PROSE words or more, few of them in links."""
    plain = linked = 0
    todo: list = [(node, False)]
    while todo:
        x, inside = todo.pop()
        if isinstance(x, str):
            n = len(x.split())
            plain, linked = plain + n * (not inside), linked + n * inside
        elif x.tag not in RAW:
            todo += [(k, inside or x.tag == "a") for k in x.kids]
    return plain >= PROSE and linked <= 0.3 * (plain + linked)


def names_of(text: str) -> list[set[str]]:
    """The words of each class or id."""
    return [set(re.split(r"[_-]+", x)) - {""} for x in text.lower().split()]


def plain_words(root: Node) -> dict[int, int]:
    """Words outside links under each node, by id(node)."""
    order, todo = [], [(root, False)]
    while todo:
        node, linked = todo.pop()
        order.append((node, linked))
        if node.tag not in RAW:
            todo += [(k, linked or k.tag == "a") for k in node.kids if isinstance(k, Node)]
    out: dict[int, int] = {}
    for node, linked in reversed(order):
        out[id(node)] = 0 if node.tag in RAW else sum(out[id(k)] if isinstance(k, Node) else 0 if linked else len(k.split()) for k in node.kids)
    return out


def never(node: Node) -> bool:
    a = attributes(node) if node.attrs else {}
    return node.tag in DROPPED - {"form"} or any(x & NEVER and x <= SURE | MAYBE | WITH for x in names_of(a.get("class", "") + " " + a.get("id", "")))


def wrappers(root: Node) -> set[int]:
    """What stays although it looks like a form or a part beside the article, by id(node): the elements around the page's longest article, or,
    on a page without articles, those that hold half of its prose."""
    words = plain_words(root)
    longest, ways, todo = None, [], [(root, ())]
    while todo:
        node, above = todo.pop()
        if node is not root and never(node):
            continue
        if is_article(node):
            if longest is None or words[id(node)] > longest:
                longest, ways = words[id(node)], list(above)
            continue
        todo += [(k, (*above, id(node))) for k in node.kids if isinstance(k, Node)]
    if longest is not None:
        return set(ways)
    out, todo = set(), [root]
    while todo:
        node = todo.pop()
        if words[id(node)] >= max(PROSE, 0.5 * words[id(root)]) and (node is root or not never(node)):
            out.add(id(node))
            todo += [k for k in node.kids if isinstance(k, Node)]
    return out


def marked(node: Node, in_article: bool, stay: set[int] = frozenset()) -> bool:
    """Whether tag, role, class or id says that the node isn't part of the article. stay: those of which only the tag counts.

    A class or id counts as a whole, all of its parts being words that mark or go with such words; `social-policy` isn't one. The id of
    a section or heading inside an article is a place to link to: prose under it stays.
    """
    if id(node) in stay:
        return False
    if node.tag in DROPPED or node.tag == "form" or node.tag == "header" and not in_article:
        return True
    a = attributes(node)
    if not a:
        return False
    if "hidden" in a or a.get("aria-hidden") == "true" or a.get("role", "").lower() in ROLES or re.search(r"display\s*:\s*none", a.get("style", ""), re.I):
        return True
    anchor = in_article and node.tag in ANCHORED and is_prose(node)
    names = names_of(a.get("class", "") + " " + ("" if anchor else a.get("id", "")))
    if node.tag in ("html", "body", "article", "main"):
        return node.tag == "article" and any(x & {"comment", "comments", "reply"} and x <= SURE | MAYBE | WITH for x in names)
    names = [x for x in names if x <= SURE | MAYBE | WITH | HEADERS]
    if any(x & SURE or not in_article and x & HEADERS for x in names):
        return True
    return any(x & MAYBE for x in names) and not is_prose(node)


def is_article(node: Node) -> bool:
    return node.tag in ("article", "main") or bool(node.attrs) and (a := attributes(node)).get("role", "").lower() in ("main", "article") or bool(node.attrs) and "articlebody" in attributes(node).get("itemprop", "").lower()


def number(digest: bytes) -> int:
    return int.from_bytes(digest, "little", signed=True)


def subtree_hashes(root: Node) -> dict[int, tuple[int, int]]:
    """(hash, hash of the article it is in or 0) of each subtree that may be a template, by id(node); none that hold an article are."""
    own: dict[int, bytes] = {}
    # children before parents, without recursion: pages may nest deeply
    order, todo = [], [(root, None)]
    while todo:
        node, article = todo.pop()
        explicit = is_article(node)
        order.append((node, article, explicit))
        todo += [(k, node if explicit else article) for k in node.kids if isinstance(k, Node)]
    closed: set[int] = set()
    for node, _, explicit in reversed(order):
        if explicit or any(isinstance(k, Node) and id(k) in closed for k in node.kids):
            closed.add(id(node))
        h = hashlib.blake2b(digest_size=8)
        h.update(f"{node.tag}|{SPACE.sub(' ', node.attrs).strip()}".encode("utf-8", "replace"))
        for k in node.kids:
            h.update(b"<" + own[id(k)] if isinstance(k, Node) else b">" + SPACE.sub(" ", k).strip().encode("utf-8", "replace"))
        own[id(node)] = h.digest()
    out: dict[int, tuple[int, int]] = {}
    for node, article, _ in order:
        if id(node) in closed:
            continue
        if article is None:
            out[id(node)] = (number(own[id(node)]), 0)
        elif node.tag in BLOCKS and node.tag not in PARTS:  # inside an article a hash of its own, as it is counted by itself
            out[id(node)] = (number(hashlib.blake2b(b"inside" + own[id(node)], digest_size=8).digest()), number(own[id(article)]) or 1)
    return out


def page_hashes(html: str | None) -> list[tuple[int, int]]:
    """The distinct hashes of a page's subtrees that may be templates, each with its article's or 0; (1, its hash) for an article."""
    if not html:
        return []
    found = set(subtree_hashes(parse(html)).values())
    return sorted(found | {(1, article) for _, article in found if article})


def is_card(node: Node) -> bool:
    """Whether an article only leads to another page: by its class, or because its heading is a link."""
    a = attributes(node) if node.attrs else {}
    if any(x & CARDS and x <= CARDS | SURE | MAYBE | WITH | {"article", "post", "story"} for x in names_of(a.get("class", ""))):
        return True
    todo = [k for k in node.kids if isinstance(k, Node)]
    while todo:
        k = todo.pop(0)
        if k.tag in ("h1", "h2", "h3", "h4"):
            inner = [x for x in k.kids if not isinstance(x, str) or x.strip()]
            return len(inner) == 1 and isinstance(inner[0], Node) and inner[0].tag == "a" and not attributes(inner[0]).get("href", "#").startswith("#")
        todo = [x for x in k.kids if isinstance(x, Node)] + todo
    return False


def articles_of(root: Node, stay: set[int]) -> list[Node]:
    """Explicit articles that aren't in one another, without cards beside them, each after the headings and paragraphs right before it."""
    found: list[tuple[Node, list[Node]]] = []
    todo: list[tuple[Node, list[Node]]] = [(root, [])]
    while todo:
        node, before = todo.pop()
        if node is not root and marked(node, False, stay):
            continue
        if is_article(node):
            found.append((node, before))
            continue
        kids, lead, more = [k for k in node.kids if isinstance(k, Node) or k.strip()], [], []
        for k in kids:
            if isinstance(k, Node) and k.tag in LEADS and not marked(k, False, stay):
                lead.append(k)
                more.append((k, []))
            elif not (isinstance(k, Node) and k.tag == "hr"):  # which also stands where a template was cut out
                if isinstance(k, Node):
                    more.append((k, lead if is_article(k) else []))
                lead = []
        todo += reversed(more)
    whole = [x for x in found if not is_card(x[0])] or found
    return [y for node, before in whole for y in (*(before if node.tag == "article" else ()), node)]


def blocks_of(node: Node, stay: set[int] = frozenset()) -> list[str]:
    """Text of the blocks under node, in page order, without what is marked."""
    blocks: list[str] = []
    line: list[str] = []

    def close() -> None:
        if line:
            text = " ".join(html_lib.unescape("".join(line)).split())
            if text:
                blocks.append(text)
            line.clear()

    inside = is_article(node)
    todo: list = [node]
    while todo:
        x = todo.pop()
        if x is None:
            close()
        elif isinstance(x, str):
            line.append(x)
        elif x is node or not marked(x, inside, stay):
            if x.tag == "br":
                line.append(" ")
            block = x.tag in BLOCKS
            if block:
                close()
                todo.append(None)
            todo += reversed(x.kids)
    close()
    return blocks


def without(root: Node, dropped: set[int], hashes: dict[int, tuple[int, int]]) -> int:
    """Cuts the templates' subtrees out of a tree, and says how many."""
    n, todo = 0, [root]
    while todo:
        node = todo.pop()
        gone = {id(k) for k in node.kids if id(k) in hashes and hashes[id(k)][0] in dropped}
        if gone:
            n += len(gone)
            # text on either side of a block stays apart
            node.kids = [k if id(k) not in gone else Node("hr") for k in node.kids if id(k) not in gone or k.tag in BLOCKS]
        todo += [k for k in node.kids if isinstance(k, Node)]
    return n


def main_parts(html: str | None, templates: set[int] | None = None) -> tuple[str, int]:
    """(the article's text, its blocks joined by two line ends; how many template subtrees were cut out of the page)."""
    if not html:
        return "", 0
    root, templates = parse(html), templates or set()
    cut = without(root, templates, subtree_hashes(root)) if templates else 0
    stay = wrappers(root)
    return "\n\n".join(b for x in articles_of(root, stay) or [root] for b in blocks_of(x, stay)), cut


def main_text(html: str | None, templates: set[int] | None = None) -> str:
    return main_parts(html, templates)[0]


def templates_by_host(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, inside_share: float = INSIDE_SHARE) -> DataFrame:
    """(host, templates): hashes of subtrees on at least min_pages and min_share of a host's pages, or inside_share of its different articles.

    pages: url, html.
    """

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hosts, hashes, articles = [], [], []
            for url, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = [(0, 0), *page_hashes(html)]  # 0 counts the page itself, 1 an article
                hosts += [host_of(url)] * len(own)
                hashes += [h for h, _ in own]
                articles += [a for _, a in own]
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(hashes, pa.int64()), pa.array(articles, pa.int64())], ["host", "hash", "article"])

    each = pages.mapInArrow(part, "host string, hash long, article long").groupBy("host", "hash", "article").agg(F.count("*").alias("n"))
    inside = F.col("article") != 0  # an article counts once, however many pages have it
    seen = each.groupBy("host", "hash", inside.alias("inside")).agg(F.sum(F.when(inside, 1).otherwise(F.col("n"))).alias("n"))
    many = staged(seen.filter(F.col("n") >= min_pages), "subtrees")  # read three times below
    total = many.filter("hash in (0, 1)").select("host", "inside", F.col("n").alias("pages"))
    return many.filter("hash not in (0, 1)").join(total, ["host", "inside"]).filter(F.col("n") >= F.when(F.col("inside"), inside_share).otherwise(min_share) * F.col("pages")).groupBy("host").agg(F.sort_array(F.collect_set("hash")).alias("templates"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", max_broadcast: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """(id, url, text, n_templates) of each row; n_templates: recurring subtrees that were cut out of the page."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    found = bounded_broadcast(staged(templates_by_host(rows.select("url", "html")), "templates"), max_broadcast)
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    joined = rows.withColumn("host", host).join(found, "host", "left").select("page_id", "url", "html", "templates")
    out = T.StructType([rows.schema["page_id"], rows.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_templates", T.LongType())])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [main_parts(h, set(t or ())) for h, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x for x, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], ["page_id", "url", "text", "n_templates"])

    return joined.mapInArrow(part, out)


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))
