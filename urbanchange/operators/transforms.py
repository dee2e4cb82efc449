"""Monotone transforms and the Yeo-Johnson power transform."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urbanchange.functions.columns import yeo_johnson
from urbanchange.functions.skew import materialize
from urbanchange.operators.linear import Split, fit_powers


@dataclass(frozen=True)
class TransformConfig:
    log_transform: bool = False
    cube_root: bool = False
    inverse_sine: bool = False
    pt_transform: bool = True


@dataclass(frozen=True)
class PowerTransformModel:
    """Fitted parameters; ``transform`` is one projection."""

    columns: tuple[str, ...]
    lambdas: tuple[float, ...]
    means: tuple[float, ...]
    stds: tuple[float, ...]

    def expressions(self) -> dict[str, Column]:
        parts = zip(self.columns, self.lambdas, self.means, self.stds, strict=True)
        return {
            c: (yeo_johnson(F.col(c).cast("double"), F.lit(lam)) - F.lit(m)) / F.lit(s)
            for c, lam, m, s in parts
        }

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns(self.expressions())


class PowerTransform:
    """Yeo-Johnson with maximum-likelihood parameter per column, then standardisation.

    Newton steps on the profile likelihoods of all columns together, one scan each. A constant
    column keeps its values; a likelihood without a maximum and a missing value are errors.
    """

    def __init__(self, columns: Sequence[str]):
        self.columns = tuple(columns)

    def fit(self, df: DataFrame) -> PowerTransformModel:
        x = [F.col(c).cast("double") for c in self.columns]
        known = df.select(F.lit(0).alias("key"), F.lit(0).alias("label"), *[c.alias(f"x{j}") for j, c in enumerate(x)])
        rows = materialize(known.select(
            "key", "label", F.array(*[f"x{j}" for j in range(len(x))]).alias("x"), F.array(F.lit(0)).alias("folds")
        ))
        powers = fit_powers(rows, [Split(0, -1)], self.columns)
        return PowerTransformModel(self.columns, *(tuple(a[0].tolist()) for a in powers))


def transform_predictors(
    df: DataFrame, predictors: Sequence[str], config: TransformConfig = TransformConfig()
) -> DataFrame:
    """Apply the chosen transforms in the order log1p, cube root, arcsinh, power."""
    for wanted, function in (
        (config.log_transform, F.log1p),
        (config.cube_root, F.cbrt),
        (config.inverse_sine, F.asinh),
    ):
        if wanted:
            df = df.withColumns({c: function(F.col(c).cast("double")) for c in predictors})
    return PowerTransform(predictors).fit(df).transform(df) if config.pt_transform else df
