"""SentencePiece encoding and decoding by shared-prefix Viterbi.

Spaces become the mark U+2581, a mark is put in front, and the text splits into marked words: marks followed by characters
that are none. No piece of the vocabulary has a mark after another character, so a text is encoded as its words are. The
distinct marked words of a batch that are not known yet are sorted, which is a trie in depth-first order: a word reuses the
forward scores of the prefix that it shares with the word before it, and only its own characters are computed.

Two kinds of vocabulary have two kinds of score. Where scores are log probabilities, a path's score is their sum; of equal
ones the path with the longest last piece wins. Where scores are merge ranks, sums would not give what the model stands for:
there a transition between two pieces scores 0 if merging their characters in rank order gives just these two, and minus
infinity otherwise. Each prefix has one path of score 0, and the one of the whole word is the model's own encoding.
Characters that no piece covers become byte pieces.

The vocabulary (of fixed size) is read on the driver from a path that is a parameter, and broadcast. Words that were encoded
are kept per task up to a fixed number and then forgotten, which changes no result.

Defined results. Null or empty text: no ids; it decodes to the empty string. A mark that stands in the text itself is encoded
as bytes, so decoding gives it back. Repeated rows: each has its own result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import table

MARK = "▁"
WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MAX_KNOWN, MAX_PAIRS = 800_000, 1_000_000
#: Words that this process has encoded, by vocabulary: later tasks of a worker go on with them.
_known: dict[str, dict[str, bytes]] = {}
#: Below the least score by so much is what a character costs that no piece covers.
UNKNOWN = 10.0


@dataclass
class Vocabulary:
    """Pieces by text, byte pieces, what each id decodes to, and the pieces as a trie from their last character back."""

    scores: dict[str, tuple[float, int]]
    bytes_: list[int]
    texts: list[bytes]
    least: float
    ranked: bool
    pairs: dict[int, bool] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.names = {i: p for p, (_, i) in self.scores.items()}
        self.trie: list = [{}, -1, 0.0]  # children, id or -1, score
        for piece, (score, i) in self.scores.items():
            node = self.trie
            for c in reversed(piece):
                node = node[0].setdefault(c, [{}, -1, 0.0])
            node[1:] = i, score


def load(path: str = MODEL) -> Vocabulary:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    scores, bytes_, texts = {}, [0] * 256, []
    for i in range(n):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            bytes_[int(piece[3:5], 16)] = i
            texts.append(bytes([int(piece[3:5], 16)]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            texts.append(b"")
        else:
            if MARK in piece.lstrip(MARK):
                raise ValueError(f"piece {i} has a mark after another character; words can't be encoded one by one")
            scores[piece] = (model.get_score(i), i)
            texts.append(piece.replace(MARK, " ").encode())
    values = [x for x, _ in scores.values()]
    ranked = all(x <= 0 and x == int(x) for x in values)  # log probabilities are no whole numbers
    # a piece that merging never makes isn't used
    used = {p: x for p, x in scores.items() if not ranked or merged(p, scores) == [p]}
    return Vocabulary(used, bytes_, texts, min(values), ranked)


def merged(text: str, scores: dict[str, tuple[float, int]]) -> list[str]:
    """The pieces that merging in rank order makes of a short text, by the definition."""
    parts = list(text)
    while len(parts) > 1:
        rank, at = max(((scores[a + b][0], -i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in scores), default=(0, 1))
        if at > 0:
            break
        parts[-at : 2 - at] = [parts[-at] + parts[1 - at]]
    return parts


def joins(a: int, b: int, vocab: Vocabulary) -> bool:
    """Whether piece b may follow piece a: merging their characters gives just these two."""
    known = vocab.pairs.get(a << 32 | b)
    if known is None:
        if len(vocab.pairs) > MAX_PAIRS:
            vocab.pairs.clear()
        x, y = vocab.names[a], vocab.names[b]
        known = vocab.pairs[a << 32 | b] = merged(x + y, vocab.scores) == [x, y]
    return known


def encode_words(words: list[str], vocab: Vocabulary) -> dict[str, bytes]:
    """The ids of each distinct word, as little-endian 32-bit numbers; words in any order."""
    out: dict[str, bytes] = {}
    trie, lost, ranked, pairs = vocab.trie, vocab.least - UNKNOWN, vocab.ranked, vocab.pairs
    best: list[float] = [0.0]
    starts, last = [0], [-1]  # of the best path to each place: where its last piece starts, and its id or -1
    before = ""
    for word in sorted(set(words)):
        n, same = len(word), 0
        for x, y in zip(word, before, strict=False):
            if x != y:
                break
            same += 1
        del best[same + 1 :], starts[same + 1 :], last[same + 1 :]
        for end in range(same + 1, n + 1):
            top, start, piece, node, a = best[end - 1] + lost, end - 1, -1, trie, end
            found = []
            while a and (node := node[0].get(word[a - 1])) is not None:
                a -= 1
                if node[1] >= 0:
                    found.append((a, node))
            if ranked:
                for a, node in reversed(found):  # the longest first: it is the one most often
                    left, own = last[a], node[1]
                    if left < 0 or (known if (known := pairs.get(left << 32 | own)) is not None else joins(left, own, vocab)):
                        start, piece = a, own
                        break
            else:
                for a, node in found:
                    if (value := best[a] + node[2]) >= top:
                        top, start, piece = value, a, node[1]
            best.append(top)
            starts.append(start)
            last.append(piece)
        ids, at = [], n
        while at:
            start, piece = starts[at], last[at]
            if piece >= 0:
                ids.append(piece)
            else:
                ids += [vocab.bytes_[x] for x in reversed(word[start:at].encode("utf-8", "surrogatepass"))]
            at = start
        out[word] = struct.pack(f"<{len(ids)}i", *reversed(ids))
        before = word
    return out


def marked_words(text: str) -> list[str]:
    if "  " not in text and MARK not in text and text[:1] != " " and text[-1:] != " ":
        return [MARK + w for w in text.split(" ")]
    return WORD.findall(MARK + text.replace(" ", MARK))


def pieces_of(texts: list[str | None], vocab: Vocabulary, known: dict[str, bytes]) -> list[bytes]:
    """The ids of each text. known: words that were encoded, kept for later batches."""
    literal = b"".join(np.array([vocab.bytes_[x]], "<i4").tobytes() for x in MARK.encode())
    out = []
    if len(known) > MAX_KNOWN:
        known.clear()
    split = [[] if not t else [marked_words(p) if p or not i else [] for i, p in enumerate(t.split(MARK))] for t in texts]
    # a mark that stands in a text is a seam: what follows it starts without a mark of its own
    for parts in split:
        for p in parts[1:]:
            if p:
                p[:1] = [p[0][1:]] if p[0] != MARK else []
    new = {w for parts in split for p in parts for w in p if w not in known}
    known |= encode_words(list(new), vocab)
    for parts in split:
        out.append(literal.join(b"".join(map(known.__getitem__, p)) for p in parts))
    return out


def decode_ids(ids: list[int] | np.ndarray | None, vocab: Vocabulary) -> str:
    """The text that ids stand for."""
    if ids is None or not len(ids):
        return ""
    raw = b"".join(map(vocab.texts.__getitem__, ids))
    return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, check: bool = True) -> DataFrame:
    """(id, ids, n_tokens, round_trip): round_trip says whether decoding the ids gives the text back."""
    spark = df.sparkSession
    vocab = spark.sparkContext.broadcast(load(model))
    out = T.StructType([df.schema[id_col], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), T.StructField("round_trip", T.BooleanType())])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = vocab.value, _known.setdefault(model, {})
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                texts = b.column(1).to_pylist()
                raw = pieces_of(texts, own, known)
                sizes = np.array([len(x) // 4 for x in raw], np.int64)
                flat = np.frombuffer(b"".join(raw), "<i4")
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))
                good = [decode_ids(flat[offsets[i] : offsets[i + 1]].tolist(), own) == (t or "") for i, t in enumerate(texts)] if check else [None] * len(texts)
                yield pa.RecordBatch.from_arrays([b.column(0), ids, pa.array(sizes), pa.array(good, pa.bool_())], [id_col, "ids", "n_tokens", "round_trip"])

    return df.select(id_col, text_col).mapInArrow(part, out)


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """(id, text) from ids."""
    vocab = df.sparkSession.sparkContext.broadcast(load(model))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([decode_ids(x, vocab.value) for x in b.column(1).to_pylist()], pa.string())], [id_col, "text"])

    return df.select(id_col, ids_col).mapInArrow(part, T.StructType([df.schema[id_col], T.StructField("text", T.StringType())]))


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of every document, and whether they decode to its text."""
    return encode(table(spark, sf_dir, "documents")).select("doc_id", F.col("ids").alias("token_ids"), "n_tokens", "round_trip")
