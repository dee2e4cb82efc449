"""Modeling table, transforms, folds, metrics, classifiers, sweep, export and map layers."""

from __future__ import annotations

from pyspark.sql import functions as F

from urbanchange.catalog.fixtures import BANDS, LAYERS, fx, grid, planning, zones
from urbanchange.catalog.geometry import coverage, phi
from urbanchange.catalog.raster import pairs, rounded
from urbanchange.catalog.score import census, full_score
from urbanchange.functions.columns import yeo_johnson
from urbanchange.functions.skew import materialize
from urbanchange.operators import (
    classify,
    export,
    folds,
    maplayers,
    metrics,
    scanfill,
    sweep,
    transforms,
)
from urbanchange.operators import table as modeling
from urbanchange.operators.score import DISADVANTAGED, INDEX_T1, INDEX_T2, MEASURE_COLUMNS, SCORE

PREDICTORS = ["x1", "x2", "x3"]
PHI = [f"features_band_{b}_simple_diff" for b in BANDS]
SWEEP_BANDS = BANDS


def clf(spark, sf):
    return fx(spark, sf, "fx_clf")


def binarize(spark, sf):
    scored = full_score(spark, sf).select("code", SCORE)
    return rounded(modeling.binarize(scored), SCORE)


def restrict_flag(spark, sf):
    kept = modeling.restrict_to_disadvantaged(full_score(spark, sf))
    return rounded(kept.select("code", INDEX_T1), INDEX_T1)


def modeling_parts(spark, sf):
    scored = full_score(spark, sf).select("code", SCORE, DISADVANTAGED)
    return modeling.assemble_modeling_table(
        scored, phi(spark, sf), coverage(spark, sf), score_code="code", key="code"
    )


def modeling_table(spark, sf):
    return rounded(modeling_parts(spark, sf).data, SCORE, *PHI, *LAYERS)


def monotone_transforms(spark, sf):
    config = transforms.TransformConfig(True, True, True, False)
    out = transforms.transform_predictors(clf(spark, sf), ["x1", "x2"], config)
    return rounded(out.select("doc_id", "x1", "x2"), "x1", "x2")


def yeo_johnson_fixed(spark, sf):
    """Both branches at several parameters, on signed balances."""
    balance = F.col("t1_house") / 100000.0 - F.col("t2_house") / 100000.0
    out = census(spark, sf).select(
        "code",
        *[
            yeo_johnson(balance, F.lit(lam)).alias(name)
            for name, lam in (("yj_m1", -1.0), ("yj_0", 0.0), ("yj_h", 0.5), ("yj_2", 2.0))
        ],
    )
    return rounded(out, "yj_m1", "yj_0", "yj_h", "yj_2")


def yeo_johnson_fit(spark, sf):
    """Maximum-likelihood parameters of two columns."""
    model = transforms.PowerTransform(["x1", "x2"]).fit(clf(spark, sf))
    return clf(spark, sf).agg(
        F.count(F.lit(1)).alias("n"),
        F.lit(round(model.lambdas[0], 3)).alias("lambda_x1"),
        F.lit(round(model.lambdas[1], 3)).alias("lambda_x2"),
    )


def class_weights(spark, sf):
    return rounded(metrics.class_weights(clf(spark, sf)), "weight")


def stratified_folds(spark, sf):
    return folds.stratified_folds(clf(spark, sf).select("doc_id", "label"), "doc_id", k=10)


def repeated_folds(spark, sf):
    out = folds.repeated_folds(clf(spark, sf).select("doc_id", "label"), "doc_id", k=10)
    return out.select("doc_id", "label", "repeat", "fold")


def balanced_accuracy(spark, sf):
    return rounded(metrics.balanced_accuracy(clf(spark, sf)), "balanced_accuracy")


def f1_weighted(spark, sf):
    return rounded(metrics.f1_weighted(clf(spark, sf)), "f1_weighted")


def roc_auc(spark, sf):
    return rounded(metrics.roc_auc(clf(spark, sf)), "roc_auc")


def cv_metrics(spark, sf):
    table = folds.repeated_folds(clf(spark, sf), "doc_id", k=10, repeats=3)
    return rounded(metrics.cv_metrics(table), *metrics.METRICS)


def _resubstituted(spark, sf, spec, params):
    """Fit on all rows, predict all rows."""
    rows = materialize(clf(spark, sf).select("doc_id", "label", *PREDICTORS))
    predicted = classify.fit(rows, PREDICTORS, spec, params)(rows)
    return predicted.select("doc_id", "label", "pred", F.round("score", 4).alias("score"))


def clf_logreg(spark, sf):
    return _resubstituted(spark, sf, classify.default_specs()[0], {"C": 1.0})


def clf_svc(spark, sf):
    return _resubstituted(spark, sf, classify.default_specs()[1], {"C": 1.0})


def clf_gbt(spark, sf):
    return _resubstituted(
        spark,
        sf,
        classify.default_specs()[2],
        {"n_estimators": 10, "max_depth": 3, "learning_rate": 0.1},
    )


def clf_balanced_rf(spark, sf):
    return _resubstituted(spark, sf, classify.FOREST, {})


def grid_search(spark, sf):
    """The whole grid of the logistic regression over ten folds."""
    spec = classify.default_specs()[0]
    rows = materialize(clf(spark, sf).select("doc_id", "label", *PREDICTORS))
    return classify.grid_search(rows, PREDICTORS, spec, "doc_id", folds=10)[1]


def model_comparison(spark, sf):
    """Default grids and folds for the linear models; boosted trees with one small candidate."""
    *linear_specs, boosted = classify.default_specs()
    small = classify.ModelSpec(
        boosted.name, boosted.build, {"n_estimators": [5], "max_depth": [3], "learning_rate": [0.1]}, boosted.weighting
    )
    rows = materialize(clf(spark, sf).select("doc_id", "label", *PREDICTORS))
    whole = classify.ClassifyConfig(specs=tuple(linear_specs))
    cut = classify.ClassifyConfig(2, 2, 1, specs=(small,))
    parts = [classify.train_and_evaluate(rows, PREDICTORS, "doc_id", c) for c in (whole, cut)]
    return parts[0].unionByName(parts[1])


def price_pairs(spark, sf):
    """Composite pairs in hundreds, a range like that of surface reflectance."""
    return pairs(spark, sf).withColumns({"v1": F.col("v1") / 100.0, "v2": F.col("v2") / 100.0})


def sweep_thresholds(spark, sf):
    """Changed pixels at every default threshold."""
    limits = F.array(*[F.lit(t) for t in sweep.default_thresholds()])
    gap = F.abs(F.col("v2") - F.col("v1"))
    hits = (
        price_pairs(spark, sf)
        .select(F.explode(F.filter(limits, lambda t: gap > t)).alias("threshold"))
        .groupBy("threshold")
        .agg(F.count(F.lit(1)).alias("changed_px"))
    )
    return sweep.thresholds_table(spark).join(hits, "threshold", "left").select(
        "i", "threshold", F.coalesce("changed_px", F.lit(0)).alias("changed_px")
    )


def sweep_features(spark, sf, limits):
    z = zones(spark, sf)
    owners = scanfill.rasterize_zones(z, grid(spark, sf))
    return sweep.threshold_features(price_pairs(spark, sf), owners, z, limits, SWEEP_BANDS)


def threshold_features(spark, sf):
    out = sweep_features(spark, sf, sweep.default_thresholds())
    return rounded(out, *out.columns[1:])


def threshold_sweep(spark, sf):
    """The whole sweep: 30 thresholds, quartile label of the disadvantaged areas, 500 trees, 5 folds."""
    scored = full_score(spark, sf).select("code", SCORE, DISADVANTAGED)
    features = sweep_features(spark, sf, sweep.default_thresholds())
    built = modeling.assemble_modeling_table(scored, features, coverage(spark, sf), score_code="code", key="code")
    labelled = built.data.withColumn("label", F.col(built.target).cast("int"))
    return sweep.evaluate_thresholds(labelled, LAYERS, "code")


def sweep_points(spark, sf):
    """Share of correct length-based guesses at each length limit, as sweep points."""
    limits = F.array(*[F.lit(t) for t in sweep.default_thresholds()])
    right = (F.col("score") > F.col("threshold")).cast("int") == F.col("label")
    return (
        clf(spark, sf)
        .withColumn("threshold", F.explode(limits))
        .groupBy("threshold")
        .agg(
            F.round(F.avg(right.cast("double")), 6).alias("f1"),
            F.round(F.avg(F.when(F.col("label") == 1, right.cast("double"))), 6).alias(
                "balanced_accuracy"
            ),
        )
    )


def best_threshold(spark, sf):
    return sweep.best_threshold(sweep_points(spark, sf))


def binary_label(spark, sf):
    scored = full_score(spark, sf).select("code", SCORE)
    return rounded(export.add_binary_label(scored), SCORE)


def export_table(spark, sf):
    scored = full_score(spark, sf).withColumn("internal", F.lit(1))
    out = export.export_table(scored, phi(spark, sf), "code")
    return rounded(out, *MEASURE_COLUMNS, INDEX_T1, INDEX_T2, SCORE, *PHI)


def map_layer_score(spark, sf):
    out = maplayers.score_layer(full_score(spark, sf)).select("code", "fill", "outline_only")
    return rounded(out, "fill")


def borough_probability(spark, sf):
    """Zones of the first image columns and their planning areas, one layer unknown."""
    z = zones(spark, sf, "ab").withColumns(
        {"borough": F.floor(F.col("code") % 32 / 4), "probs": F.col("code") % 10 / F.lit(10.0)}
    )
    layers = ["town", "conservation", "missing_layer"]
    out = maplayers.borough_layer(z, planning(spark, sf), [0, 2], layers)
    return rounded(out, *layers)


QUERIES = {
    f.__name__: f
    for f in (
        binarize,
        restrict_flag,
        modeling_table,
        monotone_transforms,
        yeo_johnson_fit,
        class_weights,
        clf_logreg,
        clf_svc,
        clf_gbt,
        clf_balanced_rf,
        stratified_folds,
        repeated_folds,
        grid_search,
        balanced_accuracy,
        f1_weighted,
        roc_auc,
        cv_metrics,
        model_comparison,
        sweep_thresholds,
        threshold_features,
        threshold_sweep,
        best_threshold,
        binary_label,
        export_table,
        map_layer_score,
        borough_probability,
    )
}
QUERIES["yeo_johnson"] = yeo_johnson_fixed


def _yj(x: str, lam: str) -> str:
    lam = f"({lam})"
    return (
        f"case when {x} >= 0 then case when abs({lam}) < 1e-12 then ln(1+{x}) "
        f"else (pow({x}+1, {lam})-1)/{lam} end else case when abs({lam}-2) < 1e-12 "
        f"then -ln(1-{x}) else -(pow(1-{x}, 2-{lam})-1)/(2-{lam}) end end"
    )


def _folds(seed: str, k: int) -> str:
    return (
        f"(row_number() over (partition by label, {seed} order by "
        f"md5(concat(cast({seed} as varchar), '_', cast(doc_id as varchar))), doc_id) - 1) % {k}"
    )


def _quartiles(table: str) -> str:
    return f"""case when gentrification_score > (select quantile_cont(gentrification_score, 0.75) from {table})
      then 1 when gentrification_score < (select quantile_cont(gentrification_score, 0.25) from {table}) then 0 end"""


_BALANCED = "(avg(case when label=0 then case when pred=0 then 1e0 else 0e0 end end) + avg(case when label=1 then case when pred=1 then 1e0 else 0e0 end end))/2"
_F1 = """((count(*) filter (label=1))*2e0*(count(*) filter (label=1 and pred=1))
    /greatest((count(*) filter (label=1))+(count(*) filter (pred=1)),1)
  + (count(*) filter (label=0))*2e0*(count(*) filter (label=0 and pred=0))
    /greatest((count(*) filter (label=0))+(count(*) filter (pred=0)),1))/count(*)"""

STATEMENTS = {
    "o_poor": """
        select s.*, p.* exclude (code), c.* exclude (code) from o_score s join o_phi p on p.code=s.code
          join o_coverage c on c.code=s.code where s.disadvantaged""",
    "o_cv": f"""
        select *, {_folds("(42+rep)", 10)} fold
        from fx_clf cross join (select unnest([0,1,2]) rep)""",
    "o_auc": """
        select rep, fold, (sum(case when label=1 then r end) - np*(np+1)/2e0)/(np*nn) auc from (
          select *, rank() over (partition by rep, fold order by score)
              + (count(*) over (partition by rep, fold, score) - 1)/2e0 r,
            count(*) filter (label=1) over (partition by rep, fold) np,
            count(*) filter (label=0) over (partition by rep, fold) nn from o_cv)
        group by rep, fold, np, nn""",
    "o_lambda": """
        select c, lam, row_number() over (partition by c order by
            -count(*)/2e0*ln(var_pop(YJ)) + (lam-1)*sum(sign(x)*ln(1+abs(x))) desc) rn
        from (select c, x, k/1000e0 lam from (select 'x1' c, x1 x from fx_clf
              union all select 'x2', x2 from fx_clf)
            cross join (select unnest(range(-4000, 4001)) k))
        group by c, lam""".replace("YJ", _yj("x", "lam")),
    "o_points": """
        select t threshold, round(avg(ok),6) f1, round(avg(case when label=1 then ok end),6) balanced_accuracy
        from (select t, label, case when (case when score > t then 1 else 0 end) = label then 1e0 else 0e0 end ok
          from fx_clf cross join (select cast(round_even(100+i*700/29e0, 0) as int) t
            from (select unnest(range(0,30)) i)))
        group by t""",
    "o_price": "select band, row_, col_, abs(v2/100e0 - v1/100e0) gap from o_pairs",
}

_SWEPT = ", ".join(
    f"round(100e0*count(case when g.band={b} and gap>{t} then 1 end)/a.area,6) features_band_{b}_{t}"
    for b in SWEEP_BANDS
    for t in sweep.default_thresholds()
)
_EXPORTED = ", ".join(
    f"round({c},6) {c}"
    for c in (*MEASURE_COLUMNS, INDEX_T1, INDEX_T2, SCORE)
)

ORACLE = {
    "binarize": f"""
        select code, round(gentrification_score,6) gentrification_score,
          cast(g as double) gentrification_binary
        from (select code, gentrification_score, {_quartiles("o_score")} g from o_score) where g is not null""",
    "restrict_flag": """
        select code, round(neighborhood_index_t1,6) neighborhood_index_t1 from o_score where disadvantaged""",
    "modeling_table": f"""
        select code, round(gentrification_score,6) gentrification_score, disadvantaged,
          {", ".join(f"round({c},6) {c}" for c in (*PHI, *LAYERS))}, cast(g as double) gentrification_binary
        from (select *, {_quartiles("o_poor")} g from o_poor) where g is not null""",
    "monotone_transforms": """
        select doc_id, round(asinh(cbrt(ln(1+x1))),6) x1, round(asinh(cbrt(ln(1+x2))),6) x2 from fx_clf""",
    "yeo_johnson": "select code, "
    + ", ".join(
        f"round({_yj('b', lam)}, 6) {name}"
        for name, lam in (("yj_m1", "-1e0"), ("yj_0", "0e0"), ("yj_h", "0.5e0"), ("yj_2", "2e0"))
    )
    + " from (select code, t1_house/100000e0 - t2_house/100000e0 b from fx_census)",
    "yeo_johnson_fit": """
        select count(*) n, round((select lam from o_lambda where c='x1' and rn=1),3) lambda_x1,
          round((select lam from o_lambda where c='x2' and rn=1),3) lambda_x2 from fx_clf""",
    "class_weights": """
        select label, count(*) n, round((select count(*) from fx_clf)
          /(2e0*count(*)), 6) weight from fx_clf group by label""",
    "stratified_folds": f"""
        select doc_id, label, cast({_folds("42", 10).replace("label, 42", "label")} as int) fold from fx_clf""",
    "repeated_folds": f"""
        select doc_id, label, cast(rep as int) "repeat", cast({_folds("(42+rep)", 10)} as int) fold
        from fx_clf cross join (select unnest([0,1,2]) rep)""",
    "balanced_accuracy": f"select round({_BALANCED}, 6) balanced_accuracy from fx_clf",
    "f1_weighted": f"select round({_F1}, 6) f1_weighted from fx_clf",
    "roc_auc": """
        select round(avg(case when p.score > n.score then 1e0 when p.score = n.score then 0.5e0 else 0e0 end),6) roc_auc
        from fx_clf p cross join fx_clf n where p.label = 1 and n.label = 0""",
    "cv_metrics": f"""
        select round(avg(b),6) balanced_accuracy, round(avg(f),6) f1_weighted, round(avg(auc),6) roc_auc
        from (select rep, fold, {_BALANCED} b, {_F1} f from o_cv group by rep, fold) join o_auc using (rep, fold)""",
    "sweep_thresholds": """
        select cast(i as int) i, t threshold, (select count(*) from o_price where gap > t) changed_px
        from (select i, cast(round_even(100+i*700/29e0, 0) as int) t from (select unnest(range(0,30)) i))""",
    "threshold_features": f"""
        select a.code, {_SWEPT} from o_area a left join
          (select code, band, gap from o_owner join o_price using (row_, col_)) g on g.code = a.code
        group by a.code, a.area""",
    "best_threshold": """
        select threshold, f1, balanced_accuracy from o_points order by f1 desc, threshold limit 1""",
    "binary_label": f"""
        select code, round(gentrification_score,6) gentrification_score, {_quartiles("o_score")} gentrified
        from o_score""",
    "export_table": f"""
        select s.code, {_EXPORTED}, disadvantaged, {_quartiles("o_score")} gentrified,
          {", ".join(f"round({c},6) {c}" for c in PHI)}
        from o_score s left join o_phi p on p.code = s.code""",
    "map_layer_score": """
        select code, case when disadvantaged then round(gentrification_score,6) end fill,
          not disadvantaged outline_only from o_score""",
    "borough_probability": """
        select cast(z.code % 32 // 4 as bigint) borough, z.code, z.code % 10 / 10e0 probs,
          round(coalesce(sum(shared) filter (layer='town'),0),6) town,
          round(coalesce(sum(shared) filter (layer='conservation'),0),6) conservation,
          0e0 missing_layer
        from fx_zones z left join o_shared s on s.code = z.code
        where z.kind in ('a','b') and z.code % 32 // 4 in (0, 2) group by z.code""",
}
