"""String functions: ASCII folding, words of names, search terms."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Letters with a mark and what is left without it, for folding names inside Catalyst.
MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćĉċčďēĕėęěĝğġģĥĩīĭįĵķĺļľńņňōŏőŕŗřśŝşšţťũūŭůűųŵŷźżž"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyaaaccccdeeeeegggghiiiijklllnnnooorrrssssttuuuuuuwyzzz"


def ascii_fold(c: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def name_tokens(*columns: Column) -> Column:
    """The words of all given columns: runs of letters and digits, lower-cased, without marks."""
    text = F.concat_ws(" ", *columns)
    folded = F.regexp_replace(F.translate(F.lower(text), MARKED, PLAIN), r"\p{Mn}+", "")
    return F.array_remove(F.split(folded, r"[^\p{L}\p{N}]+"), "")


def fold_term(term: str) -> str:
    """As name_tokens folds a word."""
    folded = term.lower().translate(str.maketrans(MARKED, PLAIN))
    return "".join(c for c in folded if unicodedata.category(c) != "Mn")


def search_terms(text: str) -> list[str] | None:
    """None if there is no input, [] if nothing in it can be searched for, else its terms; the last is a prefix."""
    if not text.strip("\0").strip():
        return None
    return [t for t in re.split(r"[^\w]|_", text) if t and any(unicodedata.category(c)[0] in "LN" for c in t)]


def folded_words(terms: list[str]) -> list[str]:
    """The words that terms ask for, as name_tokens folds them; the last one is a start."""
    return [w for t in terms for w in re.split(r"[\W_]+", fold_term(t)) if w]


def matches_terms(tokens: Column, terms: list[str]) -> Column:
    """All terms are words, the last one the start of a word."""
    folded = folded_words(terms)
    if not folded:
        return F.lit(False)
    test = F.exists(tokens, lambda x: x.startswith(folded[-1]))
    for word in folded[:-1]:
        test &= F.array_contains(tokens, word)
    return test


def trimmed(c: Column) -> Column:
    """Without white space and NUL at the ends; null if nothing is left."""
    return F.nullif(F.regexp_replace(c, r"^[\s\x00]+|[\s\x00]+$", ""), F.lit(""))
