"""The stages of a study: composite, changes, score, modeling table, evaluation, export.

Each stage takes and returns DataFrames; callers write them with ``sources`` between
stages, or chain them in one session.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanchange.config import Grid, Study
from urbanchange.functions.skew import join_lookup, materialize
from urbanchange.operators import classify, export, measures, score, sweep, table
from urbanchange.operators.composite import fuse_solar_days, median_composite, require_scenes
from urbanchange.operators.masks import PIXEL, mask_clouds
from urbanchange.operators.overlay import planning_coverage
from urbanchange.operators.registry import binary_changes
from urbanchange.operators.reproject import reproject_layer
from urbanchange.operators.rings import layer_bounds
from urbanchange.operators.scanfill import rasterize_zones
from urbanchange.operators.zones import feature_matrix
from urbanchange.sources.scenes import search_scenes


def build_composite(
    boundary: DataFrame,
    scenes: DataFrame,
    observations: DataFrame,
    year: int,
    study: Study = Study(),
    *,
    boundary_crs: str | None = None,
    max_cloud: float | None = None,
    lon: float | None = None,
    order: Sequence[str] = ("ts", "scene_id"),
) -> DataFrame:
    """Cloud-masked seasonal median of the scenes over the boundary's bounding box.

    Scenes of one local solar day count as one observation. ``boundary_crs`` is given when
    the boundary is not in the CRS of the scene catalogue.
    """
    if boundary_crs is not None:
        boundary = reproject_layer(boundary, boundary_crs, study.geographic_crs)
    box = layer_bounds(boundary).first()
    bbox = (box["min_x"], box["min_y"], box["max_x"], box["max_y"])
    found = search_scenes(scenes, bbox, year, max_cloud=max_cloud, study=study)
    require_scenes(found, f"{year} over {bbox}")
    used = join_lookup(observations, found.select("scene_id"), ["scene_id"], "left_semi")
    middle = (bbox[0] + bbox[2]) / 2 if lon is None else lon
    daily = fuse_solar_days(mask_clouds(used), PIXEL, order, middle)
    return median_composite(daily.withColumn("scl", F.lit(None).cast("int")), PIXEL).select(
        F.lit(year).alias("year"), *PIXEL, "value"
    )


def detect_changes(
    composites: DataFrame,
    earlier,
    later,
    grid: Grid,
    methods: Sequence[str] = ("simple_diff",),
    **options,
) -> DataFrame:
    """Binary change maps of every method: model, band, row_, col_, changed."""
    base = materialize(composites)
    maps = [
        binary_changes(base, earlier, later, grid, m, **options.get(m, {})) for m in methods
    ]
    return reduce(DataFrame.unionByName, maps)


def score_areas(
    series: dict[str, DataFrame], boundary: DataFrame, study: Study = Study()
) -> DataFrame:
    """Measures of both dates to scored areas; ranks are taken inside the study area only."""
    wide = score.study_area(measures.assemble(series), boundary, measures.KEY)
    return score.area_score(wide, study.weights, measures.KEY)


def modeling_table(
    scores: DataFrame,
    changes: DataFrame,
    zones: DataFrame,
    planning: DataFrame,
    grid: Grid,
    layers: Sequence[str],
    study: Study = Study(),
    *,
    bands: Sequence[int] | None = None,
    model: str = "simple_diff",
    score_code: str = measures.KEY,
    target: table.TargetConfig = table.TargetConfig(),
) -> table.ModelingTable:
    """Scores, change shares of one method and planning shares, one row per area."""
    key = study.code
    phi = feature_matrix(
        changes.where(F.col("model") == model), zones, grid, bands or study.bands, model
    ).withColumnRenamed("code", key)
    plans = planning_coverage(zones, planning, layers).withColumnRenamed("code", key)
    return table.assemble_modeling_table(scores, phi, plans, target, score_code, key=key)


def evaluate_models(
    built: table.ModelingTable,
    config: classify.ClassifyConfig = classify.ClassifyConfig(),
    study: Study = Study(),
) -> DataFrame:
    """Tuned and cross-validated classifiers, one row per model."""
    rows = built.data.select(
        study.code, F.col(built.target).cast("int").alias("label"), *built.predictors
    )
    return classify.train_and_evaluate(materialize(rows), built.predictors, study.code, config)


def sweep_thresholds(
    scores: DataFrame,
    pairs: DataFrame,
    zones: DataFrame,
    planning: DataFrame,
    grid: Grid,
    layers: Sequence[str],
    study: Study = Study(),
    *,
    bands: Sequence[int] | None = None,
    thresholds: Sequence[int] | None = None,
    score_code: str = measures.KEY,
    **options,
) -> DataFrame:
    """Metrics of the change-threshold sweep on the same population and target."""
    key = study.code
    limits = list(thresholds or sweep.default_thresholds())
    owners = rasterize_zones(zones, grid)
    phi = sweep.threshold_features(pairs, owners, zones, limits, bands or study.bands)
    plans = planning_coverage(zones, planning, layers).withColumnRenamed("code", key)
    built = table.assemble_modeling_table(
        scores, phi.withColumnRenamed("code", key), plans, score_code=score_code, key=key
    )
    labelled = built.data.withColumn("label", F.col(built.target).cast("int"))
    return sweep.evaluate_thresholds(labelled, list(layers), key, limits, **options)


def export_areas(
    scores: DataFrame,
    changes: DataFrame,
    zones: DataFrame,
    grid: Grid,
    study: Study = Study(),
    *,
    bands: Sequence[int] | None = None,
    model: str = "simple_diff",
    score_code: str = measures.KEY,
) -> DataFrame:
    """Shareable table: score columns, label and the change features of one method."""
    key = study.code
    phi = feature_matrix(
        changes.where(F.col("model") == model), zones, grid, bands or study.bands, model
    ).withColumnRenamed("code", key)
    return export.export_table(
        table.ensure_key(scores, score_code, key), phi, key, study.boundary_crs
    )
