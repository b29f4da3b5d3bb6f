"""Token counts of a word-end BPE vocabulary: merges of many pre-tokens at once, as ragged numpy arrays.

Texts are cut at ASCII white space, which no pre-token holds and nothing composes across, and each distinct word of a lot is
looked at once. Its pre-tokens become one flat array of symbols with a rank for each neighbouring pair. In each step every
sequence that still has a pair gives up all places of its lowest-ranked one, left to right; only ranks beside a merge are
looked up again, and finished sequences leave the arrays. What is left of a sequence is its number of tokens.

Taking all places of a pair in one step equals taking the leftmost one again and again as long as no merge makes a symbol
that an earlier merge uses; merges that do (none in the given vocabulary) are taken one place at a time.

Words and pre-tokens that a worker has counted are kept, up to KEPT of each. No shuffle; a lot of texts is in memory at once.

Defined results. Null and empty texts: 0 bytes, 0 tokens. Strings of special tokens inside texts count as one token, as the
library has it by default. Ties and repeated rows: each row is answered by itself. Null ids stay. Other columns are ignored,
whatever their names. Very long texts are taken whole.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import table
from .word_arrays import lots, numbered, split_words, sums

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
LIMIT = 2048
KEPT, JOINED = 1_000_000, 5_000
WORD_LOT = 16 << 20
NONE = np.int64(1 << 40)  # the rank of what isn't a pair


class Merges:
    """A vocabulary file as arrays: symbols of characters, pairs in order with their rank and what they become."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, added = spec["model"], spec["added_tokens"]
        plain = ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges")
        if model["type"] != "BPE" or any(model.get(k) for k in plain) or any(t["normalized"] or t["single_word"] for t in added):
            raise ValueError(f"{path} asks for more than merges of bytes")
        self.library = Tokenizer.from_file(path)  # for its normalizer and pre-tokenizer alone
        special = "|".join(sorted((re.escape(t["content"]) for t in added), key=len, reverse=True)) or r"(?!)"
        self.special, self.apart = re.compile(special), re.compile(rf"{special}|\s")
        self.mark = os.path.commonprefix([t["content"] for t in added]) if added else "\0"
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        letters = {ord(t): i for t, i in vocab.items() if len(t) == 1}
        self.inner, self.last = np.full(max(letters) + 1, -1, np.int64), np.full(max(letters) + 1, -1, np.int64)
        for c, i in letters.items():
            self.inner[c], self.last[c] = i, vocab.get(chr(c) + end, -1)
        self.size = len(vocab)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        a, b = (np.array([vocab[m[i]] for m in merges], np.int64) for i in (0, 1))
        self.made = np.array([vocab[x + y] for x, y in merges], np.int64)
        keys = a * self.size + b
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        # the first merge that uses a symbol; a merge whose symbol an earlier one uses is taken one place at a time
        used = np.full(self.size, len(merges), np.int64)
        np.minimum.at(used, a, np.arange(len(merges)))
        np.minimum.at(used, b, np.arange(len(merges)))
        self.careful = used[self.made] <= np.arange(len(merges))

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], NONE)

    def surviving(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """How many symbols of each sequence (none of them empty) are left after all merges."""
        counts, seq = lengths.copy(), np.repeat(np.arange(len(lengths)), lengths)
        rank = np.full(len(symbols), NONE)  # of a symbol and the next one
        inside = np.flatnonzero(seq[1:] == seq[:-1])
        rank[inside] = self.ranks(symbols[inside], symbols[inside + 1])
        while len(symbols):
            starts = np.flatnonzero(np.concatenate(([True], seq[1:] != seq[:-1])))
            sizes = np.diff(np.append(starts, len(seq)))
            low = np.minimum.reduceat(rank, starts)
            live = low < NONE
            if not live.all():
                stay = np.repeat(live, sizes)
                symbols, seq, rank, low, sizes = symbols[stay], seq[stay], rank[stay], low[live], sizes[live]
                if not len(symbols):
                    break
            lowest = np.repeat(low, sizes)
            hit = np.flatnonzero(rank == lowest)
            # of hits in a row (a symbol and itself) every other one, from the left
            lead = np.concatenate(([True], np.diff(hit) > 1))
            count = np.arange(len(hit))
            hit = hit[(count - np.maximum.accumulate(np.where(lead, count, 0))) % 2 == 0]
            first = np.concatenate(([True], seq[hit][1:] != seq[hit][:-1]))
            hit = hit[first | ~self.careful[lowest[hit]]]
            symbols[hit] = self.made[lowest[hit]]
            stay = np.ones(len(symbols), bool)
            stay[hit + 1] = False
            np.subtract.at(counts, seq[hit], 1)
            new = (np.cumsum(stay) - 1)[hit]
            symbols, seq, rank = symbols[stay], seq[stay], rank[stay]
            beside = np.concatenate((new, new[new > 0] - 1))
            more = beside + 1 < len(seq)
            more[more] = seq[beside[more] + 1] == seq[beside[more]]
            rank[beside[~more]] = NONE
            rank[beside[more]] = self.ranks(symbols[beside[more]], symbols[beside[more] + 1])
        return counts

    def pretokens(self, words: list[str]) -> tuple[list[int], list[str]]:
        """(place of its word, pre-token) of each pre-token of the words, special tokens left out."""
        owners: list[int] = []
        tokens: list[str] = []
        joined: list[int] = []
        for i, w in enumerate(words):
            if w.isascii() and w.isalpha():
                owners.append(i)
                tokens.append(w.lower())
            elif self.apart.search(w):  # special tokens are cut out of the text as it is; other white space would merge with ours
                mine = [t for part in self.special.split(w) if part for t in self.split(part)]
                owners += [i] * len(mine)
                tokens += [t for t, _ in mine]
            else:
                joined.append(i)
        for lo in range(0, len(joined), JOINED):
            some = joined[lo : lo + JOINED]
            text = self.library.normalizer.normalize_str(" ".join(words[i] for i in some))
            gaps = [k for k, c in enumerate(text) if c == " "]
            if len(gaps) != len(some) - 1:  # normalizing touched white space after all: word by word
                for i in some:
                    mine = self.split(words[i])
                    owners += [i] * len(mine)
                    tokens += [t for t, _ in mine]
                continue
            found = self.library.pre_tokenizer.pre_tokenize_str(text)
            at = np.searchsorted(np.array(gaps, np.int64), np.fromiter((x[1][0] for x in found), np.int64, len(found)))
            owners += np.array(some, np.int64)[at].tolist()
            tokens += [t for t, _ in found]
        return owners, tokens

    def split(self, text: str) -> list[tuple[str, tuple[int, int]]]:
        return self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))

    def count(self, tokens: list[str]) -> np.ndarray:
        """The number of tokens of each pre-token."""
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        points = np.frombuffer("".join(tokens).encode("utf-32-le"), np.uint32).astype(np.int64)
        symbols = self.inner[points]
        ends = np.cumsum(lengths) - 1
        symbols[ends] = self.last[points[ends]]
        if (symbols < 0).any():
            raise ValueError("the vocabulary lacks a byte")
        return self.surviving(symbols, lengths)


@cache
def load(path: str) -> tuple[Merges, dict[str, int], dict[str, int]]:
    """The vocabulary, and what this worker has counted: words and pre-tokens."""
    return Merges(path), {}, {}


def count_words(words: list[str], path: str) -> np.ndarray:
    """The number of tokens of each word."""
    merges, known, kept = load(path)
    fresh = [w for w in words if w not in known]
    owners, tokens = merges.pretokens(fresh)
    if len(kept) > KEPT:
        kept.clear()
    new = [t for t in dict.fromkeys(tokens) if t not in kept]
    if new:
        kept |= zip(new, merges.count(new).tolist())
    counts = np.fromiter((len(merges.special.findall(w)) if merges.mark in w else 0 for w in fresh), np.int64, len(fresh))
    np.add.at(counts, np.array(owners, np.int64), np.fromiter(map(kept.__getitem__, tokens), np.int64, len(tokens)))
    if len(known) > KEPT:
        now = dict(known)
        known.clear()
    else:
        now = known
    now |= zip(fresh, counts.tolist())
    return np.fromiter(map(now.__getitem__, words), np.int64, len(words))


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(id, n_bytes, n_tokens): UTF-8 bytes and tokens of each text, without begin and end tokens. tokenizer: a file that every
    executor has at this path."""
    out = T.StructType([T.StructField("id", df.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in lots(b.column(1), WORD_LOT):
                texts = b.column(1).slice(lo, hi - lo)
                bounds, words = split_words(texts)
                at, distinct = numbered(words)
                counts = count_words(distinct.to_pylist(), tokenizer)
                n_bytes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), n_bytes, pa.array(sums(counts[at], bounds))], out.names)

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(part, out)


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The length of every document in bytes and tokens."""
    out = count_tokens(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
