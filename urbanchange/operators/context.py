"""Neighbourhood methods: spatial-context prediction, PCA with two-means."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from urbanchange.functions.skew import materialize


def spatial_context(
    pairs: DataFrame,
    neighborhood: int = 3,
    excluded: int = 0,
    by: Sequence[str] = ("band",),
) -> DataFrame:
    """|pre * sum(pre*post) / sum(pre^2) - post| over a square without its central cross.

    The neighbourhood is a product of two offset sets, so the sum is taken along image
    rows and then along image columns: range windows of one image line each, instead of a
    copy of every pixel per neighbour. Cells outside the image count as zero. ``pairs`` are
    complete images, every cell present (see masks.on_grid).
    """
    by = list(by)
    e, n = excluded, neighborhood

    def arms(value: str, window):
        before = F.sum(value).over(window.rangeBetween(-n, -(e + 1)))
        after = F.sum(value).over(window.rangeBetween(e + 1, n))
        return F.coalesce(before, F.lit(0.0)) + F.coalesce(after, F.lit(0.0))

    along = W.partitionBy(*by, "row_").orderBy("col_")
    across = W.partitionBy(*by, "col_").orderBy("row_")
    return (
        pairs.select(
            *by,
            "row_",
            "col_",
            "v1",
            "v2",
            (F.col("v1") * F.col("v1")).alias("_pp"),
            (F.col("v1") * F.col("v2")).alias("_pq"),
        )
        .withColumns({"_pp": arms("_pp", along), "_pq": arms("_pq", along)})
        .withColumns({"_pp": arms("_pp", across), "_pq": arms("_pq", across)})
        .select(
            *by,
            "row_",
            "col_",
            F.abs(
                F.col("v1") * F.col("_pq") / F.nullif("_pp", F.lit(0.0)) - F.col("v2")
            ).alias("value"),
        )
    )


def neighbour_blocks(df: DataFrame, bands: Sequence[int], block: int = 3) -> DataFrame:
    """Zero-padded block x block neighbourhood of every cell, all bands, as one array.

    Two window passes over image lines collect the neighbours; no row is copied. ``df``
    holds complete images.
    """
    half = block // 2
    offsets = range(-half, block - half)
    along = W.partitionBy("band", "row_").orderBy("col_")
    across = W.partitionBy("band", "col_").orderBy("row_")

    def shifted(value, window, d: int):
        return F.coalesce(F.sum(value).over(window.rangeBetween(d, d)), F.lit(0.0))

    rows = df.select("band", "row_", "col_", "value").withColumns(
        {f"_c{d}": shifted("value", along, d) for d in offsets}
    )
    names = [(dr, dc) for dr in offsets for dc in offsets]
    blocks = rows.select(
        "band",
        "row_",
        "col_",
        F.array(*[shifted(f"_c{dc}", across, dr) for dr, dc in names]).alias("_block"),
    )
    empty = F.array_repeat(F.lit(0.0), len(names))
    return blocks.groupBy("row_", "col_").agg(
        F.flatten(
            F.array(
                *[
                    F.coalesce(F.max(F.when(F.col("band") == b, F.col("_block"))), empty)
                    for b in bands
                ]
            )
        ).alias("block")
    )


def pca_kmeans(
    pairs: DataFrame,
    bands: Sequence[int],
    block: int = 3,
    rate: float = 0.9,
    seed: int = 42,
) -> DataFrame:
    """Two clusters of the difference image's neighbourhoods after PCA to ``rate`` variance."""
    delta = pairs.select(
        "band", "row_", "col_", F.abs(F.col("v2") - F.col("v1")).alias("value")
    ).na.fill(0.0, ["value"])
    blocks = neighbour_blocks(delta, bands, block)
    width = len(bands) * block * block
    parts = blocks.select("row_", "col_", *[F.col("block")[i].alias(f"_f{i}") for i in range(width)])
    vectors = materialize(
        VectorAssembler(inputCols=[f"_f{i}" for i in range(width)], outputCol="_v")
        .transform(parts)
        .select("row_", "col_", "_v")
    )
    scaled = (
        StandardScaler(withMean=True, withStd=True, inputCol="_v", outputCol="_s")
        .fit(vectors)
        .transform(vectors)
    )
    full = PCA(k=width, inputCol="_s", outputCol="_p").fit(scaled)
    explained = full.explainedVariance.toArray().cumsum()
    k = int((explained < rate).sum()) + 1
    reduced = PCA(k=min(k, width), inputCol="_s", outputCol="_p").fit(scaled).transform(scaled)
    model = KMeans(k=2, seed=seed, featuresCol="_p", predictionCol="cluster").fit(reduced)
    return model.transform(reduced).select("row_", "col_", "cluster")
