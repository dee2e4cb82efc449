"""Many linear classifiers in one optimisation: all candidates, folds and repeats together.

A fit is a pair of a candidate (penalty strength) and a split (rows of one fold held out, or
none). The coefficients of all fits are one matrix. A step is one aggregation over the rows: each
block of rows adds up loss, gradient and Hessian of every fit, with the fold of a row as a mask,
and Spark adds the blocks. So the number of scans is that of Newton steps, however many fits there
are. The power parameters of all splits are found in the same way beforehand.

What leaves a task is (fits) x (predictors + 1)^2 numbers at most, whatever the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from urbanchange.functions.skew import materialize
from urbanchange.operators.folds import stratified_folds

BLOCK_ROWS = 1 << 14  # rows of a task, about
LARGEST = 1e9  # size of a power parameter beyond which there is none
PASSES = 200  # over the rows, at most; Newton steps take about ten


@dataclass(frozen=True)
class Family:
    """A loss: ``logistic``, or ``squared_hinge``, which also penalises the intercept."""

    loss: str


class Split(NamedTuple):
    repeat: int
    fold: int  # -1: nothing is held out


def fold_rows(
    df: DataFrame, key: str, predictors: Sequence[str], folds: int = 1, repeats: int = 1, seed: int = 42, label: str = "label"
) -> DataFrame:
    """``key``, ``label``, predictors as ``x`` and the fold of each repeat as ``folds``, in blocks.

    A missing predictor is an error: there is no loss for it.
    """
    for r in range(repeats):
        name = f"_fold{r}"
        df = stratified_folds(df, key, label, folds, seed + r, name) if folds > 1 else df.withColumn(name, F.lit(0))
    x = F.array(*[F.col(c).cast("double") for c in predictors])
    rows = df.select(
        F.col(key).alias("key"), F.col(label).cast("int").alias("label"), x.alias("x"),
        F.array(*[F.col(f"_fold{r}") for r in range(repeats)]).alias("folds"),
    )
    rows = materialize(rows)
    missing = F.exists("x", lambda v: v.isNull() | F.isnan(v))
    total, holes = rows.agg(F.count(F.lit(1)), F.count(F.when(missing, 1))).first()
    if holes:
        raise ValueError(f"{holes} rows lack a predictor")
    return rows.repartition(max(1, -(-total // BLOCK_ROWS)), F.xxhash64("key"))


def all_splits(folds: int, repeats: int) -> list[Split]:
    return [Split(r, f) for r in range(repeats) for f in range(folds)]


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = batch.num_rows
    x, folds = (batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(n, -1) for c in ("x", "folds"))
    return x, batch.column("label").to_numpy(zero_copy_only=False), folds


def summed(rows: DataFrame, evaluate: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """The sum over all rows of a function of blocks (x, label, folds) that gives a matrix.

    Tasks add up their batches; the lines of the matrices are then added by number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            if batch.num_rows:
                total += evaluate(*_arrays(batch))
        yield lines(range(len(total)), total)

    def lines(numbers, total) -> pa.RecordBatch:
        values = pa.array(list(total), pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), values], ["id", "v"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, v in zip(batch.column("id").to_pylist(), batch.column("v")):
                sums[i] = sums.get(i, 0.0) + v.values.to_numpy()
        if sums:
            yield lines(list(sums), sums.values())

    made = rows.select("x", "label", "folds").mapInArrow(run, "id int, v array<double>")
    made = made.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")
    out = np.zeros(shape)
    for row in made.mapInArrow(add, "id int, v array<double>").collect():
        out[row["id"]] = row["v"]
    return out


# -- power parameters -----------------------------------------------------------------------


def _moments(t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Integrals of s^k exp(t s) over s from 0 to 1, for k = 0, 1, 2."""
    small = np.abs(t) < 0.5
    far = np.where(small, 1.0, t)
    e = np.exp(np.minimum(far, 700.0))
    zeroth = (e - 1) / far
    first = (e - zeroth) / far
    out = [zeroth, first, (e - 2 * first) / far]
    near, term = np.where(small, t, 0.0), np.ones_like(t)
    series = [np.zeros_like(t) for _ in range(3)]
    for m in range(14):
        for k in range(3):
            series[k] += term / (m + k + 1)
        term = term * near / (m + 1)
    return tuple(np.where(small, a, b) for a, b in zip(series, out))


def power_derivatives(x: np.ndarray, lam: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The Yeo-Johnson transform of ``x`` and its first two derivatives in the parameter."""
    u, sign = np.log1p(np.abs(x)), np.where(x < 0, -1.0, 1.0)
    m0, m1, m2 = _moments(np.where(x < 0, 2 - lam, lam) * u)
    return sign * u * m0, u**2 * m1, sign * u**3 * m2


class Powers(NamedTuple):
    """Per split and predictor: parameter, mean and deviation of the transformed values."""

    lambdas: np.ndarray
    means: np.ndarray
    stds: np.ndarray

    def scaled(self, x: np.ndarray, split: int) -> np.ndarray:
        """Transformed and standardised predictors, and a one for the intercept."""
        y = power_derivatives(x, self.lambdas[split])[0]
        return np.c_[(y - self.means[split]) / self.stds[split], np.ones(len(x))]


def fit_powers(rows: DataFrame, splits: Sequence[Split], names: Sequence[str], precision: float = 1e-9) -> Powers:
    """Maximum-likelihood power parameters of all splits and predictors by Newton steps.

    Each step is one scan that gives first and second derivative of every profile likelihood as
    sums. A step that leaves the bracket known so far is replaced by a bisection of it, or, while
    one side is open, by a longer move. Constant predictors keep 1; missing values are left out. A likelihood that still grows
    beyond ``LARGEST`` is an error.
    """
    shape = (len(splits), len(names))
    reference = summed(rows, lambda x, y, f: np.stack([np.nansum(x, axis=0), (~np.isnan(x)).sum(axis=0)]), (2, shape[1]))
    centre = reference[0] / np.maximum(reference[1], 1)
    lam = np.ones(shape)

    def sums(at: np.ndarray) -> tuple[np.ndarray, ...]:
        def evaluate(x: np.ndarray, label: np.ndarray, folds: np.ndarray) -> np.ndarray:
            grown = np.sign(x) * np.log1p(np.abs(x))
            out = np.empty((shape[0], 8 * shape[1]))
            for s, (repeat, fold) in enumerate(splits):
                take = folds[:, repeat] != fold
                y, d1, d2 = (
                    a[take] - b for a, b in zip(power_derivatives(x, at[s]), power_derivatives(centre, at[s]))
                )
                known = (~np.isnan(x[take])).sum(axis=0)
                terms = [y, d1, d2, y * y, y * d1, d1 * d1 + y * d2, grown[take]]
                out[s] = np.concatenate([known, *[np.nansum(t, axis=0) for t in terms]])
            return out

        got = summed(rows, evaluate, (shape[0], 8 * shape[1])).reshape(shape[0], 8, shape[1])
        n = np.maximum(got[:, 0], 1)
        y, d1, d2, yy, yd, dd = (got[:, k] / n for k in range(1, 7))
        var = yy - y * y
        return n, y, var, 2 * (yd - y * d1), 2 * (dd - d1 * d1 - y * d2), got[:, 7]

    low, high = np.full(shape, -np.inf), np.full(shape, np.inf)
    reach, open_ = np.ones(shape), None
    for _ in range(PASSES):
        with np.errstate(all="ignore"):
            n, mean, var, slope, bend, logs = sums(lam)
            if open_ is None:
                open_ = var > 1e-24 * (1 + centre**2)
            first = np.where(open_, -n / 2 * slope / var + logs, 0.0)
            second = -n / 2 * (bend / var - (slope / var) ** 2)
            low, high = np.where(first > 0, lam, low), np.where(first <= 0, lam, high)
            step = np.where(second < 0, -first / second, np.nan)
            new = lam + step
            closed = np.isfinite(low) & np.isfinite(high)
            far = ~np.isfinite(new) | (np.abs(step) > reach)
            new = np.where(far, lam + np.sign(first) * reach, new)
            outside = closed & ((new <= low) | (new >= high))
            new = np.where(outside, (low + high) / 2, new)
            reach = np.where(far & ~closed, reach * 4, reach)
        moved = np.abs(new - lam)
        settled = ~open_ | (moved <= precision * (1 + np.abs(lam)))
        if settled.all():
            break
        lam = np.where(settled, lam, new)
        if (np.abs(lam) > LARGEST).any():
            lost = names[int(np.argwhere(np.abs(lam) > LARGEST)[0][1])]
            raise ValueError(f"no best power parameter for {lost!r} below {LARGEST:g}")
    shift = np.stack([power_derivatives(centre, a)[0] for a in lam])
    std = np.sqrt(np.maximum(var, 0))
    return Powers(lam, mean + shift, np.where(std > 1e-12, std, 1.0))


# -- coefficients ---------------------------------------------------------------------------


class Fits(NamedTuple):
    """All fits of one family: the split and the strength of each, and their coefficients."""

    splits: list[Split]
    powers: Powers
    split: np.ndarray
    strength: np.ndarray
    weights: np.ndarray  # fits x (predictors + 1), the intercept last


def class_weights(rows: DataFrame, splits: Sequence[Split]) -> np.ndarray:
    """Balanced weights of both classes in each split; an absent class counts as one row."""

    def evaluate(x: np.ndarray, label: np.ndarray, folds: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(label[folds[:, r] != f], minlength=2)[:2] for r, f in splits])

    counts = np.maximum(summed(rows, evaluate, (len(splits), 2)), 1)
    return counts.sum(axis=1, keepdims=True) / (2 * counts)


def block_loss(loss: str, z: np.ndarray, label: np.ndarray, row_weight: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, ...]:
    """Loss, gradient and Hessian of each line of ``w`` over a block of rows."""
    score = z @ w.T
    side = np.where(label == 1, 1.0, -1.0)[:, None]
    v = row_weight[:, None]
    if loss == "logistic":
        p = 1 / (1 + np.exp(-np.clip(score, -700, 700)))
        value, pull, bend = v * np.logaddexp(0, -side * score), v * (p - (side > 0)), v * p * (1 - p)
    else:
        short = np.maximum(0, 1 - side * score)
        value, pull, bend = v * short**2, -2 * v * side * short, 2 * v * (short > 0)
    hessian = np.stack([z.T @ (bend[:, m, None] * z) for m in range(len(w))])
    return value.sum(axis=0), pull.T @ z, hessian


def fit_weights(
    rows: DataFrame, family: Family, splits: Sequence[Split], strengths: Sequence[float], names: Sequence[str],
    passes: int = PASSES,
) -> Fits:
    """Coefficients of every (split, strength): half the squared norm plus strength times loss.

    Newton steps with backtracking for each fit by itself; a pass evaluates all that are not done.
    A fit is done when a full step would lower its objective by less than 1e-12 of it.
    """
    powers = fit_powers(rows, splits, names)
    balance = class_weights(rows, splits)
    d = len(names) + 1
    split = np.repeat(np.arange(len(splits)), len(strengths))
    strength = np.tile(np.asarray(strengths, float), len(splits))
    penalised = np.ones(d)
    if family.loss == "logistic":
        penalised[-1] = 0
    w = np.zeros((len(split), d))
    trial, value = w.copy(), np.full(len(split), np.inf)
    step, decline = np.zeros_like(w), np.zeros(len(split))
    active = np.ones(len(split), bool)
    for _ in range(passes):
        at = np.flatnonzero(active)

        def evaluate(x: np.ndarray, label: np.ndarray, folds: np.ndarray) -> np.ndarray:
            out = np.zeros((len(at), 1 + d + d * d))
            for s in np.unique(split[at]):
                repeat, fold = splits[s]
                take = folds[:, repeat] != fold
                mine = np.flatnonzero(split[at] == s)
                parts = block_loss(
                    family.loss, powers.scaled(x[take], s), label[take], balance[s][label[take]], trial[at[mine]]
                )
                out[mine] = np.concatenate([parts[0][:, None], parts[1], parts[2].reshape(len(mine), -1)], axis=1)
            return out

        got = summed(rows, evaluate, (len(at), 1 + d + d * d)) * strength[at, None]
        now = got[:, 0] + 0.5 * (penalised * trial[at] ** 2).sum(axis=1)
        for k, m in enumerate(at):
            if now[k] > value[m] - 1e-4 * decline[m]:  # the step was too long
                step[m] /= 2
                decline[m] /= 2
                active[m] = decline[m] > 1e-12 * (1 + abs(value[m]))
                trial[m] = w[m] + step[m] if active[m] else w[m]
                continue
            w[m], value[m] = trial[m], now[k]
            gradient = got[k, 1 : 1 + d] + penalised * w[m]
            hessian = got[k, 1 + d :].reshape(d, d) + np.diag(np.maximum(penalised, 1e-10))
            step[m] = -np.linalg.solve(hessian, gradient)
            decline[m] = -gradient @ step[m]
            active[m] = decline[m] > 1e-12 * (1 + abs(value[m]))
            trial[m] = w[m] + step[m]
        if not active.any():
            break
    return Fits(list(splits), powers, split, strength, w)


def held_out_scores(rows: DataFrame, fits: Fits, candidates: int, key: str) -> DataFrame:
    """Every row's score in the fits that held it out: one row per candidate and repeat."""
    names = ["candidate", "repeat", "fold", key, "label", "pred", "score"]
    kind = T.StructType(
        [*T.StructType.fromDDL("candidate int, repeat int, fold int"), T.StructField(key, rows.schema["key"].dataType),
         *T.StructType.fromDDL("label int, pred int, score double")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, label, folds = _arrays(batch)
            for s, (repeat, fold) in enumerate(fits.splits):
                take = np.flatnonzero(folds[:, repeat] == fold)
                if not len(take):
                    continue
                scores = fits.powers.scaled(x[take], s) @ fits.weights[fits.split == s].T
                keys = batch.column("key").take(pa.array(take))
                for c in range(candidates):
                    same = lambda v: pa.array(np.full(len(take), v, np.int32))
                    yield pa.RecordBatch.from_arrays(
                        [same(c), same(repeat), same(fold), keys, pa.array(label[take].astype(np.int32)),
                         pa.array((scores[:, c] > 0).astype(np.int32)), pa.array(scores[:, c].copy())],
                        names,
                    )

    return rows.mapInArrow(run, kind)
