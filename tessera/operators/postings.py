"""An inverted index of the words of files: (term, id, field), kept in segments that are laid out by term.

A segment is range-partitioned and sorted by term and id, so a word is an equality and the start of a word a range on the column
that Parquet's statistics are ordered by; a word that a third of all files have is spread over as many ranges as it fills. A
later segment says which (id, field) it replaces; what earlier ones have of these is void. Fields: n for names, o for text read
from the file.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import name_tokens

POSTINGS, DROPPED = "term string, id long, field string", "id long, field string"
NAME, OCR = "n", "o"


def words_of(rows: DataFrame, text_col: str, field: str) -> DataFrame:
    """(term, id, field) of the distinct words of a column; null texts have none."""
    return rows.select(F.explode(F.array_distinct(name_tokens(F.col(text_col)))).alias("term"), "id", F.lit(field).alias("field"))


def laid_out(postings: DataFrame) -> DataFrame:
    return postings.repartitionByRange("term", "id").sortWithinPartitions("term", "id")


def after_last(prefix: str) -> str | None:
    """The least string after all that begin with prefix, as code points are ordered; None if there is none."""
    for i in range(len(prefix) - 1, -1, -1):
        if prefix[i] != "\U0010ffff":
            c = ord(prefix[i]) + 1
            return prefix[:i] + chr(0xE000 if c == 0xD800 else c)
    return None


def begins(term: Column, prefix: str) -> Column:
    """A range, not a pattern, so that statistics prune."""
    end = after_last(prefix)
    return (term >= prefix) & (term < end) if end else term >= prefix


def ids_with(postings: DataFrame, words: list[str]) -> DataFrame:
    """(id) of the files that have all words, in whichever fields, the last one as the start of a word. Only rows of these words move, and of
    each task a row for an id."""
    term, whole, last = F.col("term"), sorted(set(words[:-1])), words[-1]
    tests = [term == w for w in whole] + [begins(term, last)]
    met = postings.filter(reduce(Column.__or__, tests)).groupBy("id").agg(*[F.bool_or(t).alias(f"t{i}") for i, t in enumerate(tests)])
    return met.filter(reduce(Column.__and__, [F.col(f"t{i}") for i in range(len(tests))])).select("id")


def joined(segments: list[tuple[DataFrame | None, DataFrame]]) -> DataFrame:
    """The valid rows of (dropped, added) segments, oldest first."""
    out = segments[0][1]
    for dropped, added in segments[1:]:
        out = (out if dropped is None else out.join(dropped, ["id", "field"], "left_anti").select("term", "id", "field")).unionByName(added)
    return out
