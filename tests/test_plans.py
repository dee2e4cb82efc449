"""A small study from observations to models."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_geometry import box, layer

from urbanchange.config import Grid, Study
from urbanchange.operators import classify, masks, measures
from urbanchange.operators.score import DISADVANTAGED, MEASURE_COLUMNS
from urbanchange.plans import study as plans

GRID = Grid(24, 24)
BANDS = [1, 2]


def scene_tables(spark, year, seed, moved=False):
    rng = np.random.default_rng(seed)
    scenes = [(f"s{i}", f"{year}-07-{i + 1:02d} 10:00:00", 10.0 * i, 0.0, 0.0, 24.0, 24.0) for i in range(4)]
    obs = []
    for i in range(4):
        image = rng.normal(100, 3, (2, 24, 24)) + 8.0 * np.arange(24)
        if moved:
            image[:, :8, :12] += 300
        for b, r, c in np.ndindex(image.shape):
            obs.append((f"s{i}", f"{year}-07-{i + 1:02d} 10:00:00", b + 1, r, c, image[b, r, c], 9 if i == 1 and r == 0 else 4))
    cols = "scene_id string, t string, cloud_cover double, min_x double, min_y double, max_x double, max_y double"
    s = spark.createDataFrame(scenes, cols).withColumn("ts", F.to_timestamp("t")).drop("t")
    o = spark.createDataFrame(
        pd.DataFrame(obs, columns=["scene_id", "t", "band", "row_", "col_", "value", "scl"])
    )
    for c in ("band", "row_", "col_", "scl"):
        o = o.withColumn(c, F.col(c).cast("int"))
    return s, o.withColumn("ts", F.to_timestamp("t")).drop("t")


def test_study(spark):
    codes = [f"E{i:02d}" for i in range(36)]
    squares = layer(spark, [(c, [box(4 * (i % 6), 4 * (i // 6), 4 * (i % 6) + 4, 4 * (i // 6) + 4)]) for i, c in enumerate(codes)])
    town = layer(spark, [("p", [box(0, 0, 9, 9)])], "feature_id").withColumn("layer", F.lit("town"))
    composites = None
    for year, moved in ((2016, False), (2021, True)):
        s, o = scene_tables(spark, year, year, moved)
        one = plans.build_composite(squares, s, o, year, lon=0.0)
        assert one.count() == 2 * 24 * 24
        composites = one if composites is None else composites.unionByName(one)
        with pytest.raises(RuntimeError):
            plans.build_composite(squares, s, o, year + 1)
    composites = composites.withColumnRenamed("year", "period")
    changes = plans.detect_changes(composites, 2016, 2021, GRID)
    changed = changes.where("changed = 1 and band = 1").select("row_", "col_").collect()
    block = [r for r in changed if r["row_"] < 8 and r["col_"] < 12]
    assert len(block) > 70 and len(changed) - len(block) < 10

    rng = np.random.default_rng(0)
    series = {
        m: spark.createDataFrame(pd.DataFrame({"lsoa_code": [*codes, "X"], "value": rng.normal(size=37)}))
        for m in MEASURE_COLUMNS
    }
    boundary = squares.select(F.col("code").alias("lsoa_code"))
    scores = plans.score_areas(series, boundary)
    assert scores.count() == 36 and scores.where("lsoa_code = 'X'").count() == 0
    assert scores.where(DISADVANTAGED).count() >= 18

    built = plans.modeling_table(scores, changes, squares, town, GRID, ["town"], bands=BANDS)
    assert built.predictors == ["features_band_1_simple_diff", "features_band_2_simple_diff", "town"]
    assert 8 <= built.data.count() <= 10
    spec = classify.ModelSpec("LR", classify.logistic_regression, {"C": [1.0], "max_iter": [10]})
    config = classify.ClassifyConfig(2, 2, 1, specs=(spec,))
    assert plans.evaluate_models(built, config).count() == 1

    pairs = masks.pair(composites, 2016, 2021)
    points = plans.sweep_thresholds(
        scores, pairs, squares, town, GRID, ["town"], bands=BANDS, thresholds=[20],
        spec=spec, params={"max_iter": 5}, folds=2,
    )
    assert points.columns == ["threshold", "f1", "balanced_accuracy", "roc_auc"]
    shared = plans.export_areas(scores, changes, squares, GRID, bands=BANDS)
    first = shared.where(F.col(Study.code) == "E00").first()
    assert first["features_band_1_simple_diff"] == pytest.approx(100.0, abs=40)
    assert measures.KEY not in shared.columns
