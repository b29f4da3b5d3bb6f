"""Words of an Arrow column of texts as flat arrays: what operators on words inside tasks share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are taken in lots of about so many bytes, so memory follows neither the batch nor the partition; a longer text is a lot of its own.
LOT_BYTES = 4 << 20

# Bytes that stand between words (all of ASCII but digits and letters); A-Z become a-z.
_LETTERS = np.arange(256, dtype=np.uint8)
_LETTERS[:128] = 32
_LETTERS[48:58], _LETTERS[97:123], _LETTERS[65:91] = np.arange(48, 58), np.arange(97, 123), np.arange(97, 123)


def lots(texts: pa.Array, lot_bytes: int = LOT_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows [lo, hi) that hold about lot_bytes each."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + lot_bytes, "right")))
        yield lo, hi
        lo = hi


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(bounds, words): row i has words[bounds[i]:bounds[i + 1]], the runs of bytes without ASCII white space. Null: none."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = lists.flatten()
    some = pc.not_equal(flat, "")  # white space at an end leaves an empty string
    ends = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
    kept = np.concatenate(([0], np.cumsum(some.to_numpy(zero_copy_only=False)))).astype(np.int64)
    return kept[ends], flat.filter(some)


def split_letters(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """As split_words, for words of digits, letters and all that isn't ASCII, A-Z being lower-cased."""
    texts = pc.fill_null(texts, "")
    _, offsets, data = texts.buffers()
    if data is None:
        return split_words(texts)
    mapped = pa.py_buffer(_LETTERS[np.frombuffer(data, np.uint8)])
    return split_words(pa.Array.from_buffers(texts.type, len(texts), [None, offsets, mapped], 0, texts.offset))


def numbered(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(number of each word, distinct words)."""
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The sum of values in each row."""
    before = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return before[bounds[1:]] - before[bounds[:-1]]
