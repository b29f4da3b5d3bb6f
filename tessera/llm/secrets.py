"""Secret scans: keyword prefilter, anchored patterns near hits, then checksum validation.

One Aho-Corasick automaton walks the lower-cased text and yields the places of all keywords at once. Only there, anchored
regular expressions run. Long hexadecimal runs have no keyword: a byte map turns each text into hex/other, and a substring
search for the shortest run that counts plays the keyword's part. Tokens that embed a checksum (CRC-32 in base 62 after a
service prefix) count only if it holds.

Defined results. Null text: like an empty one, no spans. Ties and repeated rows: each row is scanned by itself, so repeated
rows give equal rows. Null doc_id: kept as null. Other columns, whatever their names, are ignored by `scan` and kept by
`redact`. Spans are in code points, the end exclusive.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import table

# Kinds in the order in which ties at one start are listed.
KINDS = ("assign", "access", "hex", "github", "npm")
# Keywords of the prefilter and the kind that each leads to.
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign",
    "akia": "access", "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github", "npm_": "npm",
}
# The patterns, anchored at a keyword's start. `assign` runs on the lower-cased text.
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
CHECKED = {"github": re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"), "npm": re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")}
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24
PLACEHOLDER = "[SECRET]"

_HEX = bytes(104 if c in b"0123456789abcdef" else 46 for c in range(256))  # h or .
_automaton = None


def _keywords():
    global _automaton
    if _automaton is None:
        import ahocorasick

        _automaton = ahocorasick.Automaton()
        for word, kind in KEYWORDS.items():
            _automaton.add_word(word, (len(word), kind))
        _automaton.make_automaton()
    return _automaton


def checksum62(body: str) -> str:
    """The six base-62 digits of the CRC-32 that service tokens carry after their body."""
    n, out = zlib.crc32(body.encode()), ""
    while n:
        n, d = divmod(n, 62)
        out = BASE62[d] + out
    return out.rjust(6, "0")


def find_secrets(text: str | None) -> list[tuple[int, int, int]]:
    """(start, index into KINDS, end) of each span, in order."""
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    low = raw.lower()  # A-Z only, so places stay as they are
    found: list[tuple[int, int, int]] = []
    past = dict.fromkeys(KINDS, 0)
    lowered = low.decode("utf-8", "surrogatepass")
    for last, (n, kind) in _keywords().iter(lowered):
        start = last - n + 1
        if start < past[kind]:
            continue
        if kind == "assign":
            if m := ASSIGN.match(lowered, start):
                past[kind] = m.end()
                if m.end(1) - m.start(1) >= MIN_ASSIGN:
                    found.append((start, 0, m.end()))
        elif kind == "access":
            if m := ACCESS.match(text, start):
                past[kind] = m.end()
                if m.end() - start >= MIN_ACCESS:
                    found.append((start, 1, m.end()))
        elif (m := CHECKED[kind].match(text, start)) and checksum62(m[1]) == m[2]:
            past[kind] = m.end()
            found.append((start, KINDS.index(kind), m.end()))
    runs, at = raw.translate(_HEX), 0
    while (at := runs.find(b"h" * MIN_HEX, at)) >= 0:
        end = runs.find(b".", at)
        end = len(runs) if end < 0 else end
        start = at if len(raw) == len(text) else len(raw[:at].decode("utf-8", "surrogatepass"))
        found.append((start, 2, start + end - at))
        at = end
    return sorted(found)


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redacted(text: str | None) -> str | None:
    """text with each span, or run of overlapping spans, replaced by the placeholder."""
    out, at, spans = [], 0, find_secrets(text)
    if not spans:
        return text
    merged: list[list[int]] = []
    for a, _, b in spans:
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    for a, b in merged:
        out += [text[at:a], PLACEHOLDER]
        at = b
    return "".join([*out, text[at:]])


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans): for each row an array of (kind, start, end), by start and kind."""
    kind = df.schema[id_col].dataType
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    out = T.StructType([T.StructField(id_col, kind), T.StructField("spans", T.ArrayType(span))])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in find_secrets(t)] for t in b.column(1).to_pylist()]
            at = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, at)], [id_col, "spans"])

    return df.select(id_col, text_col).mapInArrow(part, out)


def redact(df: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """df with secrets in its text replaced; length_col, if there is one, follows the new text. All columns stay."""
    names, schema = df.columns, df.schema
    at = names.index(text_col)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = pa.array([redacted(t) for t in b.column(at).to_pylist()], b.column(at).type)
            yield pa.RecordBatch.from_arrays([new if i == at else c for i, c in enumerate(b.columns)], schema=b.schema)

    out = df.mapInArrow(part, schema)
    if length_col in names and length_col != text_col:
        out = out.withColumn(length_col, F.when(F.col(text_col).isNull(), F.col(length_col)).otherwise(F.char_length(text_col)).cast(schema[length_col].dataType))
    return out


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All secrets of all documents, with the digest columns."""
    out = scan(table(spark, sf_dir, "documents"))
    text = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    some = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    count = lambda kind: F.size(some(kind)).cast("long")
    base = F.array_join(F.transform(some(*KINDS[:3]), text), ",")
    return out.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(base, 256).alias("base_sha256"), F.array_join(F.transform("spans", text), ",").alias("spans"),
    )
