"""Socioeconomic measures per area, brought to one area vintage."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from urbanchange.config import MEASURES
from urbanchange.functions.columns import row_sum
from urbanchange.functions.skew import join_lookup, materialize

KEY = "lsoa_code"

# Labels in the published tables.
HOUSING_DOMAIN = "g. Barriers to Housing and Services Domain"
INCOME_DOMAIN = "b. Income Deprivation Domain"
LEVEL4_CATEGORY = (
    "Level 4 qualifications or above: degree (BA, BSc), higher degree (MA, PhD, PGCE), "
    "NVQ level 4 to 5, HNC, HND, RSA Higher Diploma, BTEC Higher level, professional "
    "qualifications (for example, teaching, nursing, accountancy)"
)


def recode_vintage(
    df: DataFrame, lookup: DataFrame, code: str, lookup_from: str, lookup_to: str
) -> DataFrame:
    """Move rows onto the target codes and average every numeric column per target code.

    Rows without a target drop out, because a missing target code is not an area.
    """
    links = lookup.where(F.col(lookup_to).isNotNull()).select(
        F.col(lookup_from).alias(code), F.col(lookup_to).alias("_to")
    )
    numbers = [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name != code
    ]
    return (
        join_lookup(df, links, [code])
        .groupBy(F.col("_to").alias(KEY))
        .agg(*[F.avg(f"`{n}`").alias(n) for n in numbers])
    )


def share_of_columns(
    df: DataFrame, code: str, part: Sequence[str], whole: str
) -> DataFrame:
    """Summed ``part`` columns in percent of the ``whole`` column; nulls add nothing."""
    value = row_sum(list(part)) / F.nullif(F.col(f"`{whole}`"), F.lit(0)) * 100.0
    return df.select(F.col(f"`{code}`").alias(KEY), value.alias("value"))


def category_share(
    df: DataFrame, code: str, category: str, value: str, wanted: str
) -> DataFrame:
    """Share of one category in the sum over all categories, from a long table.

    Repeated (code, category) rows are averaged first, as in a pivot; a code that lacks
    the category has share 0.
    """
    cells = df.groupBy(F.col(f"`{code}`").alias(KEY), F.col(f"`{category}`").alias("_c")).agg(
        F.avg(f"`{value}`").alias("_v")
    )
    part = F.sum(F.when(F.col("_c") == wanted, F.col("_v")))
    return (
        cells.where(F.col(KEY).isNotNull() & F.col("_c").isNotNull())
        .groupBy(KEY)
        .agg(
            (
                F.coalesce(part, F.lit(0.0)) / F.nullif(F.sum("_v"), F.lit(0.0)) * 100.0
            ).alias("value")
        )
    )


def ratio_recoded(
    df: DataFrame,
    lookup: DataFrame,
    code: str,
    part: str,
    whole: str,
    lookup_from: str,
    lookup_to: str,
) -> DataFrame:
    """Percentage of two columns, averaged onto the target vintage."""
    ratio = df.select(
        F.col(f"`{code}`").alias("_code"),
        (F.col(f"`{part}`") / F.nullif(F.col(f"`{whole}`"), F.lit(0)) * 100.0).alias("value"),
    )
    return recode_vintage(ratio, lookup, "_code", lookup_from, lookup_to).select(KEY, "value")


def domain_values(
    df: DataFrame,
    domain: str,
    *,
    code: str,
    domain_col: str,
    measurement_col: str,
    value: str,
    measurement: str = "Rank",
) -> DataFrame:
    """One domain of a long index release for one measurement.

    Duplicates are averaged. Every area that has any domain for the measurement appears;
    where the wanted one is missing its value is 0.
    """
    wanted = F.avg(F.when(F.col(f"`{domain_col}`") == domain, F.col(f"`{value}`")))
    return (
        df.where((F.col(f"`{measurement_col}`") == measurement) & F.col(f"`{code}`").isNotNull())
        .groupBy(F.col(f"`{code}`").alias(KEY))
        .agg(F.coalesce(wanted, F.lit(0.0)).alias("value"))
    )


def wide_column_recoded(
    df: DataFrame, lookup: DataFrame, column: str, code: str, lookup_from: str, lookup_to: str
) -> DataFrame:
    """One column of a wide release, averaged onto the target vintage."""
    slim = df.select(F.col(f"`{code}`").alias("_code"), F.col(f"`{column}`").alias("value"))
    return recode_vintage(slim, lookup, "_code", lookup_from, lookup_to).select(KEY, "value")


def assemble(series: dict[str, DataFrame]) -> DataFrame:
    """Full outer join of named ``[lsoa_code, value]`` series into one wide table.

    With unique codes the join is one grouped pass over the stacked series. Duplicate codes
    multiply, so when the grouped pass counts any, a chain of outer joins is run instead.
    Rows without a code are left out.
    """
    wanted = [f"t{t}_{m}" for m in MEASURES for t in (1, 2)]
    names = [c for c in wanted if c in series] + [c for c in series if c not in wanted]
    parts = {
        n: series[n]
        .where(F.col(KEY).isNotNull())
        .select(KEY, F.col("value").cast("double").alias(n))
        for n in names
    }
    stacked = reduce(
        DataFrame.unionByName,
        [p.select(KEY, F.lit(n).alias("_m"), F.col(n).alias("_v")) for n, p in parts.items()],
    )

    def own(n: str):
        return F.col("_m") == n

    grouped = materialize(
        stacked.groupBy(KEY).agg(
            *[F.max(F.when(own(n), F.col("_v"))).alias(n) for n in names],
            F.greatest(*[F.count_if(own(n)) for n in names], F.lit(0)).alias("_most"),
        )
    )
    if grouped.where("_most > 1").isEmpty():
        return grouped.drop("_most")
    return reduce(lambda left, right: left.join(right, KEY, "full"), parts.values())
