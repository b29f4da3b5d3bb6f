"""Quality classifier by positive-unlabelled learning with the non-negative risk estimator.

Trusted positives are labelled documents of quality 1 from the learning fold; the unlabelled set is all documents. With the
logistic loss l and class prior p, the risk is p E_P[l(f)] + max(0, E_U[l(-f)] - p E_P[l(-f)]). The model is additive over
text statistics and their squares. Each Newton step is one Spark aggregation of gradient and Hessian over all rows; nothing
but these sums, of fixed size, reaches the driver, and no row is sampled. Where the second term falls below zero the step
follows the first alone. The class prior is given, or estimated from positives and unlabelled text: a logistic regression tells
how likely a document is labelled, its mean over the positives is the share of good documents that are labelled, and the share
of all documents that are labelled divided by it is the prior. Labels of quality 0 are used for nothing.

Defined results. Null or empty text: the statistics of an empty text, scored like any other. Labels that are null or
contradict one another for a document teach nothing. Repeated rows: each has its own score. No labels at all: the prior is
the score. Other columns, whatever their names, are never read by `score` and are kept by `keep_good`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import fold, staged, table

STEPS, RIDGE, THRESHOLD, FOLDS, HELD_OUT = 12, 0.25, 0.7, 4, 2
PRIOR_STEPS, PRIOR_RIDGE, PRIOR_RANGE = 8, 0.01, (0.05, 0.95)
#: The prior where nothing is labelled.
DEFAULT_PRIOR = 0.8
# Characters whose share is a statistic of its own.
MARKS = b"!#$%&*|.,?-/@=<>\"'()_+:;[]{}~^\\`"
N_STATS = 7 + len(MARKS) + 12


def stats(text: str | None) -> np.ndarray:
    """Statistics of a text: shares of kinds of characters, of repeated words and lines, lengths."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    out = np.zeros(N_STATS)
    if not raw:
        return out
    n = len(raw)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    kinds = [counts[65:91].sum(), counts[97:123].sum(), counts[48:58].sum(), counts[32], counts[10], counts[128:].sum(), counts[9]]
    out[:7] = np.sqrt(np.array(kinds) / n)
    out[7 : 7 + len(MARKS)] = np.sqrt(counts[list(MARKS)] / n)
    words = raw.split()
    m = len(words)
    if not m:
        return out
    lines = raw.split(b"\n")
    distinct = len(set(words))
    sizes = np.fromiter(map(len, words), np.int64, m)
    same = sum(map(bytes.__eq__, words, words[1:])) / m
    pairs = len(set(zip(words, words[1:], strict=False))) / max(1, m - 1)
    ends = np.frombuffer(raw, np.uint8)
    out[7 + len(MARKS) :] = [
        np.log1p(m), np.log1p(n) / 2, distinct / m, np.sqrt(same), 1 - pairs, sizes.mean() / 8, sizes.std() / 8, (sizes == 1).mean(), np.sqrt(1 - len(set(lines)) / len(lines)),
        np.log1p(m / len(lines)), np.log(distinct) / np.log(m + 1), np.sqrt((ends[1:] == ends[:-1]).mean()) if n > 1 else 0.0,
    ]
    return out


def expanded(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standardised statistics, bounded, their squares, and one."""
    z = np.clip((x - mean) / scale, -6, 6)
    return np.concatenate([z, z * z / 6, np.ones((len(z), 1))], axis=1)


def sums(df: DataFrame, of) -> np.ndarray:
    """The sum over all rows of what `of` gives for a batch (statistics, positive): one vector of fixed length."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(0).values.slice(b.column(0).offsets[0].as_py()).to_numpy(zero_copy_only=False)[: b.num_rows * N_STATS].reshape(b.num_rows, N_STATS).astype(np.float64)
            got = of(x, b.column(1).to_numpy(zero_copy_only=False).astype(bool))
            total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], ["i", "v"])

    rows = df.select("x", "positive").mapInArrow(part, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    return np.array([r.v for r in sorted(rows, key=lambda r: r.i)])


class Model:
    """A fitted scorer: small arrays that go to the tasks."""

    def __init__(self, prior: float, mean: np.ndarray | None = None, scale: np.ndarray | None = None, weights: np.ndarray | None = None):
        self.prior, self.mean, self.scale, self.weights = prior, mean, scale, weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.prior)
        f = expanded(x, self.mean, self.scale) @ self.weights
        return np.round(1 / (1 + np.exp(-np.clip(f, -40, 40))), 9)


def statistics(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    out = T.StructType([T.StructField("id", df.schema[id_col].dataType), T.StructField("x", T.ArrayType(T.FloatType()))])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([stats(t) for t in b.column(1).to_pylist()], np.float32).reshape(-1, N_STATS)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * N_STATS), pa.array(x.ravel(), pa.float32()))], ["id", "x"])

    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(part, out)


def learned(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """(lid, q): one agreed label per document of the learning folds."""
    own = labels.select(F.col(id_col).alias("lid"), F.col(label_col).cast("int").alias("q")).filter(F.col("q").isin(0, 1) & F.col("lid").isNotNull() & (fold(FOLDS, "lid") != HELD_OUT))
    return own.groupBy("lid").agg(F.min("q").alias("q"), F.max("q").alias("top")).filter("q = top").select("lid", "q")


def full(v: np.ndarray, d: int) -> np.ndarray:
    """A symmetric matrix from its upper half."""
    h = np.zeros((d, d))
    h[np.triu_indices(d)] = v
    return h + np.triu(h, 1).T


def estimated_prior(data: DataFrame, mean: np.ndarray, scale: np.ndarray, n: float, labelled: float) -> float:
    """The share of good documents, from which are labelled good and what all look like. Newton steps over sums."""
    d = 2 * N_STATS + 1
    upper, ridge = np.triu_indices(d), np.r_[np.full(d - 1, PRIOR_RIDGE + 3 / n), 1e-9]
    w, seen = np.zeros(d), 1.0
    w[-1] = np.log(max(1.0, labelled) / max(1.0, n - labelled))
    for _ in range(PRIOR_STEPS):

        def of(x: np.ndarray, p: np.ndarray, w: np.ndarray = w) -> np.ndarray:
            e = expanded(x, mean, scale)
            s = 1 / (1 + np.exp(-np.clip(e @ w, -40, 40)))
            return np.concatenate([[s[p].sum()], e.T @ (s - p), ((e * (s * (1 - s))[:, None]).T @ e)[upper]])

        v = sums(data, of)
        seen = v[0] / labelled
        step = np.linalg.solve(full(v[1 + d :], d) / n + np.diag(ridge), v[1 : 1 + d] / n + ridge * w)
        if np.abs(step).max() < 1e-3:
            break
        w = w - step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
    return float(np.clip(labelled / n / max(seen, 1e-9), *PRIOR_RANGE))


def fit(rows: DataFrame, labels: DataFrame, prior: float | None = None, steps: int = STEPS) -> Model:
    """The model of least non-negative risk. rows: id, x (staged statistics of all documents); labels: lid, q."""
    good = labels.filter("q = 1").select("lid")
    data = staged(rows.join(good, rows["id"] == good["lid"], "left").select("x", F.col("lid").isNotNull().alias("positive")), "learn")
    first = sums(data, lambda x, p: np.concatenate([[len(x), p.sum()], x.sum(axis=0), (x * x).sum(axis=0)]))
    if not len(first) or not first[1]:
        return Model(DEFAULT_PRIOR if prior is None else prior)
    n, mean = first[0], first[2 : N_STATS + 2] / first[0]
    scale = np.sqrt(np.maximum(first[N_STATS + 2 :] / n - mean**2, 1e-6))
    d = 2 * N_STATS + 1
    upper = np.triu_indices(d)
    if prior is None:
        prior = estimated_prior(data, mean, scale, n, first[1])

    def terms(w: np.ndarray):
        def of(x: np.ndarray, p: np.ndarray) -> np.ndarray:
            e = expanded(x, mean, scale)
            f = np.clip(e @ w, -40, 40)
            s = 1 / (1 + np.exp(-f))
            curve = s * (1 - s)
            g, c = e[p], curve[p]
            return np.concatenate([[p.sum(), np.logaddexp(0, -f[p]).sum(), np.logaddexp(0, f[p]).sum(), np.logaddexp(0, f).sum()], e.T @ s, g.T @ s[p], g.sum(axis=0), ((e * curve[:, None]).T @ e)[upper], ((g * c[:, None]).T @ g)[upper]])

        return of

    w, best = np.zeros(d), (np.inf, np.zeros(d))
    w[-1] = np.log(prior / (1 - prior))
    last = None
    for _ in range(steps):
        v = sums(data, terms(w))
        np_, up, down, un = v[:4]
        gu, gp, gs = v[4 : 4 + d] / n, v[4 + d : 4 + 2 * d] / np_, v[4 + 2 * d : 4 + 3 * d] / np_
        k = len(upper[0])
        hu, hp = full(v[4 + 3 * d : 4 + 3 * d + k], d) / n, full(v[4 + 3 * d + k :], d) / np_
        positive, negative = prior * up / np_, un / n - prior * down / np_
        risk = positive + max(0.0, negative) + RIDGE / 2 * (w[:-1] ** 2).sum()
        if risk < best[0] - 1e-9:
            if best[0] - risk < 1e-6:
                best = (risk, w.copy())
                break
            best, last = (risk, w.copy()), None
        elif last is not None:  # the step went too far: half of it
            last = last / 2
            if np.abs(last).max() < 1e-3:
                break
            w = best[1] + last
            continue
        ridge = RIDGE * np.r_[np.ones(d - 1), 1e-3]
        if negative >= 0:
            gradient, curve = gu - prior * gs, hu  # l(f) - l(-f) = -f, so the positives' part is linear
        else:
            gradient, curve = prior * (gp - gs), prior * hp
        step = -np.linalg.solve(curve + np.diag(ridge), gradient + ridge * w)
        last = step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
        w = w + last
    return Model(prior, mean, scale, best[1])


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", prior: float | None = None) -> DataFrame:
    """(id, held_out, score, predicted) for each row of docs."""
    rows = staged(statistics(docs, id_col, text_col), "statistics")
    model = fit(rows, staged(learned(labels, id_col, label_col), "labels"), prior)
    out = T.StructType([rows.schema["id"], T.StructField("score", T.DoubleType())])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array(b.column(1).to_pylist(), np.float64).reshape(-1, N_STATS)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(x))], ["id", "score"])

    found = rows.mapInArrow(part, out)
    held = F.coalesce(fold(FOLDS, "id") == HELD_OUT, F.lit(False))
    return found.select(F.col("id").alias(id_col), held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that score below the threshold; all columns stay."""
    rows = staged(statistics(docs, id_col, text_col), "statistics")
    model = fit(rows, staged(learned(labels, id_col, label_col), "labels"))
    at = docs.columns.index(text_col)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([stats(t) for t in b.column(at).to_pylist()], np.float32).astype(np.float64).reshape(-1, N_STATS)
            yield b.filter(pa.array(model.score(x) >= threshold))

    return docs.mapInArrow(part, docs.schema)


def op3_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document."""
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
