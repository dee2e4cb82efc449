"""Classifiers behind the power transform: grid search and repeated cross-validation."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanchange.functions.skew import materialize
from urbanchange.operators import forest, linear
from urbanchange.operators.folds import repeated_folds
from urbanchange.operators.metrics import METRICS, cv_metrics, positive_weight
from urbanchange.operators.transforms import PowerTransform, PowerTransformModel

ESTIMATOR_ARGS = {"featuresCol": "_x", "labelCol": "label", "weightCol": "_w"}


@dataclass(frozen=True)
class ModelSpec:
    """A linear family, a forest or a factory ``build(params, weight_sum)``, and its grid."""

    name: str
    build: linear.Family | Forest | Callable[[dict[str, Any], float], Any]
    grid: dict[str, list[Any]] = field(default_factory=dict)
    weighting: str = "balanced"
    skip_roc_auc: bool = False

    def candidates(self) -> list[dict[str, Any]]:
        names = list(self.grid)
        return [dict(zip(names, v)) for v in itertools.product(*self.grid.values())]


# Fitted all together by `linear`; other builders are fitted one by one.
logistic_regression = linear.Family("logistic")
linear_svc = linear.Family("squared_hinge")


def boosted_trees(params: dict[str, Any], total: float):
    return GBTClassifier(
        maxIter=params.get("n_estimators", 100),
        maxDepth=params.get("max_depth", 6),
        stepSize=params.get("learning_rate", 0.3),
        seed=params.get("seed", 42),
        **ESTIMATOR_ARGS,
    )


@dataclass(frozen=True)
class Forest:
    """A forest of balanced bootstraps, without a limit of depth."""


balanced_forest = Forest()


# The parameter grids of the study.
C_GRID = {"C": [0.01, 0.1, 1.0, 10.0]}
BOOSTING_GRID = {
    "n_estimators": [100, 200, 300],
    "max_depth": [3, 5, 10],
    "learning_rate": [0.01, 0.1, 0.2],
}


def default_specs() -> list[ModelSpec]:
    return [
        ModelSpec("LogisticRegression", logistic_regression, C_GRID),
        ModelSpec("LinearSVC", linear_svc, C_GRID, skip_roc_auc=True),
        ModelSpec("GBT", boosted_trees, BOOSTING_GRID, weighting="positive"),
    ]


FOREST = ModelSpec("BalancedRandomForest", balanced_forest)


def _weighted(train: DataFrame, weighting: str) -> tuple[DataFrame, float]:
    """Training rows with their weight, and the total weight."""
    row = train.agg(
        F.count(F.when(F.col("label") == 0, 1)).alias("neg"),
        F.count(F.when(F.col("label") == 1, 1)).alias("pos"),
    ).first()
    neg, pos = max(row["neg"], 1), max(row["pos"], 1)
    if weighting == "positive":
        w0, w1 = 1.0, neg / pos
    else:
        w0, w1 = (neg + pos) / (2.0 * neg), (neg + pos) / (2.0 * pos)
    weight = F.when(F.col("label") == 1, F.lit(w1)).otherwise(F.lit(w0))
    return train.withColumn("_w", weight), neg * w0 + pos * w1


def fit(df: DataFrame, predictors: Sequence[str], spec: ModelSpec, params: dict[str, Any]):
    """Fit transform and classifier on ``df``; returns ``predict(DataFrame) -> DataFrame``.

    Predictions have ``pred``, the raw ``score``, and the ``probability`` of class 1 (null for
    a classifier that gives none).
    """
    if isinstance(spec.build, linear.Family):
        return _fit_linear(df, predictors, spec, params)
    if isinstance(spec.build, Forest):
        rows = linear.fold_rows(df, df.columns[0], predictors)
        made = forest.fit(rows, len(predictors), **_forest_options(params))
        return lambda rows: made.predict(rows, predictors)
    power = PowerTransform(predictors).fit(df)
    vector = VectorAssembler(inputCols=list(predictors), outputCol="_x")
    weighted, total = _weighted(df, spec.weighting)
    model = spec.build(params, total).fit(vector.transform(power.transform(weighted)))

    def predict(rows: DataFrame) -> DataFrame:
        out = model.transform(vector.transform(power.transform(rows)))
        return out.select(
            *rows.columns,
            F.col("prediction").cast("int").alias("pred"),
            vector_to_array("rawPrediction")[1].alias("score"),
            (
                vector_to_array("probability")[1]
                if "probability" in out.columns
                else F.lit(None).cast("double")
            ).alias("probability"),
        )

    return predict


def _strengths(candidates: Sequence[dict[str, Any]]) -> list[float]:
    return [params.get("C", 1.0) for params in candidates]


def _passes(candidates: Sequence[dict[str, Any]]) -> int:
    return max(params.get("max_iter", linear.PASSES) for params in candidates)


def _forest_options(params: dict[str, Any]) -> dict[str, int]:
    return {"trees": params.get("n_estimators", 500), "seed": params.get("seed", 42)}


def forest_votes(
    df: DataFrame, sets: Sequence[Sequence[str]], params: dict[str, Any], key: str, folds: int, repeats: int = 1, seed: int = 42
) -> DataFrame:
    """Out-of-fold predictions of a forest per set of predictors, all sets and folds at once.

    ``candidate`` is the place of the set. Predictors that sets share are held once.
    """
    names = list(dict.fromkeys(c for columns in sets for c in columns))
    rows = linear.fold_rows(df, key, names, folds, repeats, seed)
    place = {c: j for j, c in enumerate(names)}
    splits = linear.all_splits(folds, repeats)
    models = [forest.Model(s, [place[c] for c in columns]) for columns in sets for s in splits]
    votes = forest.held_out_votes(rows, models, len(names), **_forest_options(params))
    known = [(m, m // len(splits), *splits[m % len(splits)]) for m in range(len(models))]
    named = F.broadcast(df.sparkSession.createDataFrame(known, "model int, candidate int, repeat int, fold int"))
    return votes.join(named, "model").select(
        "candidate", "repeat", "fold", F.col("key").alias(key), "label", (F.col("score") > 0.5).cast("int").alias("pred"), "score"
    )


def _fit_linear(df: DataFrame, predictors: Sequence[str], spec: ModelSpec, params: dict[str, Any]):
    key = df.columns[0]  # only names rows
    rows = linear.fold_rows(df, key, predictors)
    made = linear.fit_weights(rows, spec.build, [linear.Split(0, -1)], _strengths([params]), predictors, _passes([params]))
    power = PowerTransformModel(tuple(predictors), *(tuple(a[0].tolist()) for a in made.powers))
    *slopes, intercept = made.weights[0].tolist()
    terms = [F.lit(w) * F.col(f"_scaled.{c}") for w, c in zip(slopes, predictors)]
    score = sum(terms, F.lit(intercept))

    def predict(rows: DataFrame) -> DataFrame:
        scaled = F.struct(*[c.alias(name) for name, c in power.expressions().items()])
        out = rows.withColumn("_scaled", scaled).withColumn("score", score)
        chance = 1 / (1 + F.exp(-F.col("score"))) if spec.build.loss == "logistic" else F.lit(None).cast("double")
        return out.select(*rows.columns, (F.col("score") > 0).cast("int").alias("pred"), "score", chance.alias("probability"))

    return predict


def cross_validated(
    df: DataFrame,
    predictors: Sequence[str],
    spec: ModelSpec,
    candidates: Sequence[dict[str, Any]],
    key: str,
    folds: int,
    repeats: int = 1,
    seed: int = 42,
) -> DataFrame:
    """Out-of-fold predictions of every candidate on stratified folds dealt here.

    A linear family is fitted for all candidates, folds and repeats at once.
    """
    if isinstance(spec.build, linear.Family):
        rows = linear.fold_rows(df, key, predictors, folds, repeats, seed)
        splits = linear.all_splits(folds, repeats)
        made = linear.fit_weights(rows, spec.build, splits, _strengths(candidates), predictors, _passes(candidates))
        return linear.held_out_scores(rows, made, len(candidates), key)
    if isinstance(spec.build, Forest):
        each = [forest_votes(df, [predictors], params, key, folds, repeats, seed) for params in candidates]
        return reduce(DataFrame.unionByName, [t.withColumn("candidate", F.lit(i)) for i, t in enumerate(each)])
    dealt = materialize(repeated_folds(df, key, "label", folds, repeats, seed))
    return out_of_fold(dealt, predictors, spec, candidates, key, folds, repeats)


def out_of_fold(
    df: DataFrame,
    predictors: Sequence[str],
    spec: ModelSpec,
    candidates: Sequence[dict[str, Any]],
    key: str,
    folds: int,
    repeats: int = 1,
    parallel: int = 4,
) -> DataFrame:
    """Predictions of every candidate of a factory for every held-out row.

    ``df`` carries repeat and fold, both numbered from 0. The power transform is fitted once
    per training fold and shared by the candidates; ``parallel`` splits are fitted at a time.
    All metrics are later read from this one table.
    """
    vector = VectorAssembler(inputCols=list(predictors), outputCol="_x")

    def one_split(split: tuple[int, int]) -> list[DataFrame]:
        repeat, fold = split
        parts = []
        here = df.where(F.col("repeat") == repeat)
        train = here.where(F.col("fold") != fold)
        test = here.where(F.col("fold") == fold)
        power = PowerTransform(predictors).fit(train)
        weighted, total = _weighted(train, spec.weighting)
        ready = vector.transform(power.transform(weighted)).select("_x", "label", "_w").persist()
        held = vector.transform(power.transform(test)).select(key, "label", "_x")
        for i, params in enumerate(candidates):
            model = spec.build(params, total).fit(ready)
            parts.append(
                model.transform(held).select(
                    F.lit(i).alias("candidate"),
                    F.lit(repeat).alias("repeat"),
                    F.lit(fold).alias("fold"),
                    key,
                    "label",
                    F.col("prediction").cast("int").alias("pred"),
                    vector_to_array("rawPrediction")[1].alias("score"),
                )
            )
        ready.unpersist()
        return parts

    splits = list(itertools.product(range(repeats), range(folds)))
    with ThreadPoolExecutor(parallel) as pool:
        parts = [part for made in pool.map(one_split, splits) for part in made]
    return materialize(reduce(DataFrame.unionByName, parts))


@dataclass
class TunedModel:
    name: str
    best_params: dict[str, Any]
    cv_best_score: float
    predict: Callable[[DataFrame], DataFrame]


def grid_search(
    df: DataFrame,
    predictors: Sequence[str],
    spec: ModelSpec,
    key: str,
    *,
    folds: int = 10,
    scoring: str = "f1_weighted",
    seed: int = 42,
) -> tuple[TunedModel, DataFrame]:
    """Mean fold score of every candidate, and the best one (the first on a tie), refitted."""
    candidates = spec.candidates()
    table = cross_validated(df, predictors, spec, candidates, key, folds, 1, seed)
    scores = cv_metrics(table, ["candidate"], skip_roc_auc=scoring != "roc_auc")
    rows = scores.orderBy("candidate").collect()
    best = max(rows, key=lambda r: (r[scoring], -r["candidate"]))
    listed = df.sparkSession.createDataFrame(
        [
            (spec.name, r["candidate"], str(candidates[r["candidate"]]), float(r[scoring]))
            for r in rows
        ],
        "model string, candidate int, params string, score double",
    )
    chosen = candidates[best["candidate"]]
    tuned = TunedModel(spec.name, chosen, float(best[scoring]), fit(df, predictors, spec, chosen))
    return tuned, listed


def repeated_cv(
    df: DataFrame,
    predictors: Sequence[str],
    spec: ModelSpec,
    params: dict[str, Any],
    key: str,
    *,
    folds: int = 10,
    repeats: int = 3,
    seed: int = 42,
    svc_auc: bool = False,
) -> DataFrame:
    """Mean of each metric over repeated stratified folds, one row."""
    table = cross_validated(df, predictors, spec, [params], key, folds, repeats, seed)
    skip = spec.skip_roc_auc and not svc_auc
    return cv_metrics(table, skip_roc_auc=skip).select(F.lit(spec.name).alias("model"), *METRICS)


@dataclass(frozen=True)
class ClassifyConfig:
    grid_cv_folds: int = 10
    repeated_cv_splits: int = 10
    repeated_cv_repeats: int = 3
    grid_scoring: str = "f1_weighted"
    seed: int = 42
    specs: tuple[ModelSpec, ...] | None = None


def train_and_evaluate(
    df: DataFrame, predictors: Sequence[str], key: str, config: ClassifyConfig = ClassifyConfig()
) -> DataFrame:
    """Tune every classifier, then score the winner by repeated cross-validation."""
    results = []
    for spec in config.specs or default_specs():
        only = spec.candidates()
        if len(only) == 1:  # nothing to choose from
            best = only[0]
        else:
            tuned, _ = grid_search(
                df,
                predictors,
                spec,
                key,
                folds=config.grid_cv_folds,
                scoring=config.grid_scoring,
                seed=config.seed,
            )
            best = tuned.best_params
        scored = repeated_cv(
            df,
            predictors,
            spec,
            best,
            key,
            folds=config.repeated_cv_splits,
            repeats=config.repeated_cv_repeats,
            seed=config.seed,
        )
        results.append(scored.withColumn("best_params", F.lit(str(best))))
    return reduce(DataFrame.unionByName, results)


__all__ = [
    "FOREST",
    "ClassifyConfig",
    "ModelSpec",
    "default_specs",
    "fit",
    "grid_search",
    "positive_weight",
    "repeated_cv",
    "train_and_evaluate",
]
