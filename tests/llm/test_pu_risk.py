"""The risk that is minimised, its minimum and the prior, against plain numpy over all rows at once."""

import random

import numpy as np
import pytest

from tessera.llm import pu_quality as pu


@pytest.fixture(scope="module")
def small(spark):
    rng = random.Random(9)
    good = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(400)]
    texts = []
    for i in range(240):
        n = rng.randint(20, 120)
        texts.append(" ".join(rng.choice(good) for _ in range(n)) + "." if i % 3 else " ".join(rng.choice(good[:4]) + rng.choice(["!!", "$", "#1"]) for _ in range(n)))
    labelled = [i for i in range(240) if i % 3 and i % 4 == 1]
    x = np.array([pu.stats(t) for t in texts], np.float32).astype(np.float64)
    rows = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, x array<float>")
    labels = spark.createDataFrame([(i, 1) for i in labelled] + [(0, 0)], "lid long, q int")
    mask = np.zeros(240, bool)
    mask[labelled] = True
    return rows, labels, x, mask


def risk(w, e, positive, prior):
    """Prior x loss of positives as good, and the rest of the loss of all as bad, not below zero; and the ridge."""
    f = np.clip(e @ w, -40, 40)
    good, bad = np.logaddexp(0, -f), np.logaddexp(0, f)
    negative = bad.mean() - prior * bad[positive].mean()
    return prior * good[positive].mean() + max(0.0, negative) + pu.RIDGE / 2 * (w[:-1] ** 2).sum(), negative


@pytest.mark.parametrize("prior", [0.25, 0.4])
def test_the_fit_is_the_minimum_of_the_risk(small, prior):
    rows, labels, x, positive = small
    model = pu.fit(rows, labels, prior, steps=40)
    mean, scale = x.mean(axis=0), np.sqrt(np.maximum((x * x).mean(axis=0) - x.mean(axis=0) ** 2, 1e-6))
    assert model.mean == pytest.approx(mean, abs=1e-5) and model.scale == pytest.approx(scale, abs=1e-4)
    e = pu.expanded(x, model.mean, model.scale)
    least, negative = risk(model.weights, e, positive, prior)
    assert negative > 0
    slope = [(risk(model.weights + h, e, positive, prior)[0] - risk(model.weights - h, e, positive, prior)[0]) / 2e-4 for h in 1e-4 * np.eye(len(model.weights))]
    assert np.abs(slope[:-1]).max() < 5e-3 and abs(slope[-1]) < 5e-3
    rng = np.random.default_rng(1)
    assert all(risk(model.weights + s * rng.normal(size=len(slope)), e, positive, prior)[0] > least - 1e-7 for s in (1e-3, 0.03, 0.3) for _ in range(40))


def test_the_clamp_keeps_the_negative_part_from_paying(small):
    """With a high prior the unclamped risk could be lowered by a negative part below zero; the fit stays where that pays nothing."""
    rows, labels, x, positive = small
    model = pu.fit(rows, labels, 0.66, steps=40)
    e = pu.expanded(x, model.mean, model.scale)
    least, negative = risk(model.weights, e, positive, 0.66)
    assert abs(negative) < 0.02
    rng = np.random.default_rng(2)
    assert all(risk(model.weights + s * rng.normal(size=e.shape[1]), e, positive, 0.66)[0] > least - 1e-3 for s in (1e-3, 0.03, 0.3) for _ in range(40))


def test_unlabelled_text_alone_tells_the_prior(small):
    """A third of the texts is junk, and labels are a random part of the good ones."""
    rows, labels, x, positive = small
    model = pu.fit(rows, labels)
    assert model.prior == pytest.approx(2 / 3, abs=0.12)
    # the same from plain Newton steps over all rows
    n, d = len(x), 2 * pu.N_STATS + 1
    e, ridge, w = pu.expanded(x, model.mean, model.scale), np.r_[np.full(d - 1, pu.PRIOR_RIDGE + 3 / n), 1e-9], np.zeros(d)
    w[-1] = np.log(positive.sum() / (n - positive.sum()))
    for _ in range(pu.PRIOR_STEPS):
        s = 1 / (1 + np.exp(-np.clip(e @ w, -40, 40)))
        seen = s[positive].mean()
        step = np.linalg.solve((e * (s * (1 - s))[:, None]).T @ e / n + np.diag(ridge), e.T @ (s - positive) / n + ridge * w)
        if np.abs(step).max() < 1e-3:
            break
        w -= step * min(1.0, 4 / np.abs(step).max())
    assert model.prior == pytest.approx(np.clip(positive.mean() / seen, *pu.PRIOR_RANGE), abs=1e-3)


def test_scores_are_those_of_the_weights(small):
    rows, labels, x, _ = small
    model = pu.fit(rows, labels, 0.66)
    f = np.array([sum(a * b for a, b in zip(row, model.weights)) for row in pu.expanded(x[:20], model.mean, model.scale)])
    assert model.score(x[:20]) == pytest.approx(1 / (1 + np.exp(-f)), abs=1e-6)
    good = model.score(x)[np.arange(240) % 3 != 0]
    bad = model.score(x)[np.arange(240) % 3 == 0]
    assert np.median(good) > 0.7 > np.median(bad)
