"""All fits at once against single fits in NumPy."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from urbanchange.operators import classify, linear, metrics

NAMES = ["a", "b", "c"]


def table(spark, n=400, seed=3):
    rng = np.random.default_rng(seed)
    label = (rng.random(n) < 0.3).astype(int)
    pdf = pd.DataFrame(
        {"id": np.arange(n), "label": label, "a": rng.normal(label * 1.2, 1), "b": rng.lognormal(label * 0.4, 1), "c": rng.normal(0, 3, n)}
    )
    return pdf, spark.createDataFrame(pdf)


def plain_power(x):
    """The best parameter by golden section on the likelihood."""

    def y(lam):
        p, out = x >= 0, np.empty_like(x)
        out[p] = np.log1p(x[p]) if abs(lam) < 1e-9 else ((1 + x[p]) ** lam - 1) / lam
        out[~p] = -np.log1p(-x[~p]) if abs(lam - 2) < 1e-9 else -((1 - x[~p]) ** (2 - lam) - 1) / (2 - lam)
        return out

    def loss(lam):
        return len(x) / 2 * np.log(y(lam).var()) - (lam - 1) * (np.sign(x) * np.log1p(np.abs(x))).sum()

    low, high, g = -6.0, 6.0, (5**0.5 - 1) / 2
    for _ in range(90):
        a, b = high - g * (high - low), low + g * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    lam = (low + high) / 2
    return lam, y(lam)


def plain_fit(x, label, loss, c):
    """Gradient descent with a quasi-Newton start is too slow to be plain: damped Newton, dense."""
    n = np.bincount(label, minlength=2)
    weight = (n.sum() / (2 * n))[label]
    side, w = np.where(label == 1, 1.0, -1.0), np.zeros(x.shape[1] + 1)
    z = np.c_[x, np.ones(len(x))]
    free = np.ones(len(w))
    free[-1] = loss != "logistic"

    def objective(w):
        f = side * (z @ w)
        each = np.log1p(np.exp(-f)) if loss == "logistic" else np.maximum(0, 1 - f) ** 2
        return c * weight @ each + 0.5 * (free * w**2).sum()

    for _ in range(100):
        eps = 1e-6
        f = side * (z @ w)
        if loss == "logistic":
            p = 1 / (1 + np.exp(f))
            g, h = -(weight * side * p) @ z, (z.T * (weight * p * (1 - p))) @ z
        else:
            s = np.maximum(0, 1 - f)
            g, h = -2 * (weight * side * s) @ z, 2 * (z.T * (weight * (s > 0))) @ z
        move = np.linalg.solve(c * h + np.diag(free + eps * (free == 0)), c * g + free * w)
        t = 1.0
        while objective(w - t * move) > objective(w) and t > 1e-9:
            t /= 2
        w = w - t * move
    return w


@pytest.mark.parametrize("loss", ["logistic", "squared_hinge"])
@pytest.mark.parametrize("block", [37, 1 << 14])
def test_equal_to_single_fits(spark, monkeypatch, loss, block):
    monkeypatch.setattr(linear, "BLOCK_ROWS", block)
    pdf, df = table(spark)
    folds, repeats, strengths = 3, 2, [0.01, 1.0, 10.0]
    rows = linear.fold_rows(df, "id", NAMES, folds, repeats)
    splits = [*linear.all_splits(folds, repeats), linear.Split(0, -1)]
    fits = linear.fit_weights(rows, linear.Family(loss), splits, strengths, NAMES)
    dealt = {r["key"]: r["folds"] for r in rows.collect()}
    for s, (repeat, fold) in enumerate(splits):
        train = pdf[[dealt[i][repeat] != fold for i in pdf.id]]
        scaled = []
        for j, c in enumerate(NAMES):
            lam, y = plain_power(train[c].to_numpy())
            assert fits.powers.lambdas[s, j] == pytest.approx(lam, abs=1e-6)
            scaled.append((y - y.mean()) / y.std())
        for c in strengths:
            mine = fits.weights[(fits.split == s) & (fits.strength == c)][0]
            want = plain_fit(np.stack(scaled, axis=1), train.label.to_numpy(), loss, c)
            np.testing.assert_allclose(mine, want, atol=2e-5)


def test_held_out_scores(spark):
    """Every row once per candidate and repeat, by the fit that has not seen it."""
    pdf, df = table(spark)
    spec = classify.ModelSpec("LR", classify.logistic_regression, {"C": [0.1, 1.0]})
    out = classify.cross_validated(df, NAMES, spec, spec.candidates(), "id", folds=4, repeats=2)
    got = out.toPandas()
    assert len(got) == 400 * 2 * 2 and not got.duplicated(["candidate", "repeat", "id"]).any()
    assert got.groupby(["candidate", "repeat", "fold"]).id.nunique().between(99, 101).all()
    assert (metrics.cv_metrics(out, ["candidate"]).toPandas().roc_auc > 0.75).all()
    whole = classify.fit(df, NAMES, spec, {"C": 1.0})(df).toPandas()
    assert ((whole.score > 0) == whole.pred).all() and np.allclose(whole.probability, 1 / (1 + np.exp(-whole.score)))


def test_missing_and_constant(spark):
    pdf, df = table(spark, 60)
    with pytest.raises(ValueError, match="lack"):
        linear.fold_rows(df.selectExpr("id", "label", "a", "if(id = 3, null, b) b", "c"), "id", NAMES)
    rows = linear.fold_rows(df.selectExpr("id", "label", "a", "7.0 b", "c"), "id", NAMES)
    fits = linear.fit_weights(rows, linear.Family("logistic"), [linear.Split(0, -1)], [1.0], NAMES)
    assert fits.powers.lambdas[0, 1] == 1.0 and np.isfinite(fits.weights).all() and fits.weights[0, 1] == pytest.approx(0)
