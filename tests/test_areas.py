"""Scores, measures, modeling table, transforms, classifiers, sweep, export."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from urbanchange.operators import classify, export, folds, measures, metrics, score, sweep, table, transforms
from urbanchange.operators.score import DISADVANTAGED, INDEX_T1, INDEX_T2, MEASURE_COLUMNS, SCORE


def wide(seed=0, n=60):
    rng = np.random.default_rng(seed)
    data = {"lsoa_code": [f"E{i:03d}" for i in range(n)]}
    data.update({c: rng.normal(size=n) for c in MEASURE_COLUMNS})
    return pd.DataFrame(data)


def test_score_is_the_change_of_the_index(spark):
    pdf = wide()
    got = score.area_score(spark.createDataFrame(pdf)).toPandas().set_index("lsoa_code").sort_index()
    ranks = pdf.set_index("lsoa_code").rank(pct=True) * 100
    index = {t: sum(0.25 * ranks[f"t{t}_{m}"] for m in ("age", "edu", "house", "income")) for t in (1, 2)}
    assert np.allclose(got[SCORE], index[2] - index[1])
    assert np.allclose(got[SCORE], got[INDEX_T2] - got[INDEX_T1])
    assert (got[DISADVANTAGED] == (index[1] <= index[1].quantile(0.5) + 1e-9)).all()


def test_monotone_rescaling_changes_nothing(spark):
    a = score.area_score(spark.createDataFrame(wide())).orderBy("lsoa_code").toPandas()
    b = score.area_score(spark.createDataFrame(wide().assign(t1_age=lambda d: d.t1_age * 1000 + 7)))
    assert np.allclose(a[SCORE], b.orderBy("lsoa_code").toPandas()[SCORE])


def test_weights_must_match(spark):
    with pytest.raises(ValueError):
        score.weighted_index(spark.createDataFrame(wide()), (0.5, 0.5))


def test_missing_index_is_not_flagged(spark):
    df = spark.createDataFrame([(1, None), (2, 5.0), (3, 7.0)], f"code int, {INDEX_T1} double")
    got = {r["code"]: r[DISADVANTAGED] for r in score.flag_disadvantaged(df).collect()}
    assert got == {1: False, 2: True, 3: False}


def test_binarise_keeps_the_extremes(spark):
    df = spark.range(100).select(F.col("id").cast("double").alias(SCORE))
    got = table.binarize(df).toPandas()
    assert got[table.TARGET].value_counts().to_dict() == {1.0: 25, 0.0: 25}
    by_score = dict(zip(got[SCORE], got[table.TARGET]))
    assert by_score[99.0] == 1 and by_score[0.0] == 0
    kept = table.binarize(df, table.TargetConfig(drop_middle=False))
    assert kept.count() == 100 and kept.where(F.col(table.TARGET).isNull()).count() == 50
    labelled = export.add_binary_label(df)
    assert labelled.where("gentrified = 1").count() == 25 and labelled.count() == 100


def modeling_inputs(spark, n=40):
    codes = [f"E{i:03d}" for i in range(n)]
    scores = pd.DataFrame(
        {"lsoa_code": codes, SCORE: np.arange(n, dtype=float), DISADVANTAGED: [i < 20 for i in range(n)]}
    )
    phi = pd.DataFrame({"LSOA11CD": codes, "features_band_1_m": 1.0, "features_band_2_m": 2.0})
    plan = pd.DataFrame({"LSOA11CD": codes, "lsoa_codes": codes, "Town_Centre_Boundaries": 3.0})
    return [spark.createDataFrame(p) for p in (scores, phi, plan)]


def test_assemble_joins_keys_and_leaves_admin_out(spark):
    built = table.assemble_modeling_table(*modeling_inputs(spark))
    assert built.predictors == ["features_band_1_m", "features_band_2_m", "Town_Centre_Boundaries"]
    assert built.data.where(~F.col(DISADVANTAGED)).count() == 0
    everyone = table.assemble_modeling_table(
        *modeling_inputs(spark), table.TargetConfig(disadvantaged_only=False)
    )
    assert built.data.count() == 10 and everyone.data.count() == 20
    extra = modeling_inputs(spark)[1].select("LSOA11CD", F.lit(1.0).alias("chn2011"))
    more = table.assemble_modeling_table(
        *modeling_inputs(spark), extra_baseline=extra, extra_predictors=["chn2011"]
    )
    assert more.predictors[-1] == "chn2011"
    with pytest.raises(KeyError):
        table.restrict_to_disadvantaged(modeling_inputs(spark)[1])


def test_recode_drops_areas_without_target(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", 9.0), ("d", 5.0)], "old string, v double")
    lookup = spark.createDataFrame([("a", "X"), ("b", "X"), ("d", None), ("a", "Y")], "f string, t string")
    got = {r["lsoa_code"]: r["v"] for r in measures.recode_vintage(df, lookup, "old", "f", "t").collect()}
    assert got == {"X": 2.0, "Y": 1.0}


def test_assemble_unique_and_duplicate_codes(spark):
    def series(*rows):
        return spark.createDataFrame(list(rows), "lsoa_code string, value double")

    parts = {"t1_age": series(("a", 1.0), ("b", 2.0), (None, 9.0)), "t2_age": series(("b", 3.0), ("c", 4.0))}
    got = sorted(map(tuple, measures.assemble(parts).collect()), key=str)
    assert got == [("a", 1.0, None), ("b", 2.0, 3.0), ("c", None, 4.0)]
    parts["t2_age"] = series(("b", 3.0), ("b", 5.0))
    got = sorted(map(tuple, measures.assemble(parts).collect()), key=str)
    assert got == [("a", 1.0, None), ("b", 2.0, 3.0), ("b", 2.0, 5.0)]


def yeo_johnson(x, lam):
    out = np.empty_like(x)
    p = x >= 0
    out[p] = np.log1p(x[p]) if abs(lam) < 1e-12 else ((x[p] + 1) ** lam - 1) / lam
    out[~p] = -np.log1p(-x[~p]) if abs(lam - 2) < 1e-12 else -((1 - x[~p]) ** (2 - lam) - 1) / (2 - lam)
    return out


def test_power_transform_fits_by_likelihood(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"a": rng.lognormal(0, 1, 400), "b": rng.normal(0, 2, 400), "c": 3.0, "d": rng.integers(0, 10, 400) == 0})
    pdf["d"] = pdf["d"].astype(float)
    df = spark.createDataFrame(pdf)
    model = transforms.PowerTransform(["a", "b", "c", "d"]).fit(df)
    for i, c in enumerate("ab"):
        x = pdf[c].to_numpy()

        def ll(lam):
            return -len(x) / 2 * np.log(yeo_johnson(x, lam).var()) + (lam - 1) * np.sum(np.sign(x) * np.log1p(np.abs(x)))

        lattice = np.arange(-4000, 4001) / 1000
        assert model.lambdas[i] == pytest.approx(lattice[np.argmax([ll(v) for v in lattice])], abs=1.01e-3)
    assert model.lambdas[2] == 1.0 and model.lambdas[3] < -5
    out = model.transform(df).toPandas()
    assert np.allclose(out[["a", "b"]].mean(), 0, atol=1e-9) and np.allclose(out[["a", "b"]].std(ddof=0), 1)
    assert np.isfinite(out["c"]).all()


def labelled(spark, n=300, seed=5):
    rng = np.random.default_rng(seed)
    y = (rng.uniform(size=n) < 0.3).astype(int)
    return spark.createDataFrame(
        pd.DataFrame({"id": np.arange(n), "label": y, "x1": rng.normal(y * 2.0, 1), "x2": rng.lognormal(0, 1, n)})
    )


def test_folds_are_stratified_and_repeatable(spark):
    df = labelled(spark)
    a, b = (folds.stratified_folds(df, "id", k=5).toPandas().set_index("id").fold for _ in range(2))
    assert (a.sort_index() == b.sort_index()).all()
    per = folds.stratified_folds(df, "id", k=5).groupBy("fold", "label").count().toPandas()
    assert per.groupby("label")["count"].agg(lambda s: s.max() - s.min()).max() <= 1
    repeated = folds.repeated_folds(df, "id", k=5, repeats=2).toPandas().pivot(index="id", columns="repeat", values="fold")
    assert (repeated[0] != repeated[1]).any()


def test_metrics(spark):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"label": rng.integers(0, 2, 200), "score": rng.integers(0, 9, 200) / 3.0})
    pdf["pred"] = (pdf.score > 1).astype(int)
    df = spark.createDataFrame(pdf)
    pos, neg = pdf.score[pdf.label == 1].to_numpy(), pdf.score[pdf.label == 0].to_numpy()
    auc = np.mean((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg))
    assert metrics.roc_auc(df).first()[0] == pytest.approx(auc)
    recalls = [(pdf.pred[pdf.label == c] == c).mean() for c in (0, 1)]
    assert metrics.balanced_accuracy(df).first()[0] == pytest.approx(np.mean(recalls))
    f1 = 0
    for c in (0, 1):
        tp = ((pdf.pred == c) & (pdf.label == c)).sum()
        f1 += (pdf.label == c).sum() * 2 * tp / ((pdf.pred == c).sum() + (pdf.label == c).sum())
    assert metrics.f1_weighted(df).first()[0] == pytest.approx(f1 / 200)
    assert metrics.positive_weight(df) == pytest.approx(len(neg) / len(pos))
    skipped = metrics.cv_metrics(df.withColumns({"repeat": F.lit(0), "fold": F.col("label") * 0}), skip_roc_auc=True)
    assert np.isnan(skipped.first()["roc_auc"])


def test_classifiers_beat_the_majority(spark):
    df = labelled(spark).cache()
    specs = [
        (classify.default_specs()[0], {"C": 1.0, "max_iter": 50}),
        (classify.default_specs()[1], {"C": 1.0, "max_iter": 10}),
        (classify.default_specs()[2], {"n_estimators": 5, "max_depth": 3, "learning_rate": 0.2}),
        (classify.FOREST, {"n_estimators": 40}),
    ]
    for spec, params in specs:
        row = classify.repeated_cv(df, ["x1", "x2"], spec, params, "id", folds=2, repeats=1).first()
        assert row["balanced_accuracy"] > 0.7, spec.name
        assert np.isnan(row["roc_auc"]) == spec.skip_roc_auc
    tuned, listed = classify.grid_search(
        df,
        ["x1", "x2"],
        classify.ModelSpec("LR", classify.logistic_regression, {"C": [1e-6, 1.0], "max_iter": [20]}),
        "id",
        folds=2,
    )
    assert listed.count() == 2 and tuned.best_params["C"] in (1e-6, 1.0)
    assert len(classify.default_specs()[2].candidates()) == 27


def test_sweep(spark):
    limits = sweep.default_thresholds()
    assert len(limits) == 30 and limits[0] == 100 and limits[-1] == 800
    assert limits == [r["threshold"] for r in sweep.thresholds_table(spark).orderBy("i").collect()]
    df = labelled(spark).withColumnsRenamed({"x1": "f_10", "x2": "f_110"})
    assert sweep.columns_by_threshold(df.columns) == {10: ["f_10"], 110: ["f_110"]}
    with pytest.raises(ValueError):
        sweep.evaluate_thresholds(df, [], "id", [99])
    points = spark.createDataFrame([(5, 0.5), (3, 0.7), (9, 0.7)], "threshold int, f1 double")
    assert sweep.best_threshold(points).first()["threshold"] == 3


def test_export_keeps_listed_columns(spark):
    scores = score.area_score(spark.createDataFrame(wide())).withColumn("raw_count", F.lit(1))
    phi = spark.createDataFrame([("E001", 0.5)], "lsoa_code string, features_band_1_m double")
    out = export.export_table(scores, phi, "lsoa_code")
    assert "raw_count" not in out.columns and out.count() == 60
    assert out.where("features_band_1_m is not null").count() == 1
