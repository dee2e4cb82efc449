"""Measures, ranks and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from urbanchange.catalog.fixtures import fx, table
from urbanchange.functions.ordering import with_percentile_ranks
from urbanchange.functions.skew import materialize
from urbanchange.operators import measures, score
from urbanchange.operators.score import DISADVANTAGED, INDEX_T1, INDEX_T2, MEASURE_COLUMNS, SCORE


def rounded(df, *cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


def census(spark, sf):
    return fx(spark, sf, "fx_census")


def recode_vintage(spark, sf):
    df = census(spark, sf).select("code", "t1_age", "t1_house")
    out = measures.recode_vintage(df, fx(spark, sf, "fx_lookup"), "code", "old_code", "new_code")
    return rounded(out, "t1_age", "t1_house")


def age_share(spark, sf):
    df = census(spark, sf).withColumn("everyone", F.lit(200.0))
    out = measures.share_of_columns(df, "code", ["t1_age", "t2_age"], "everyone")
    return rounded(out, "value")


def category_share(spark, sf):
    out = measures.category_share(
        fx(spark, sf, "fx_long"), "code", "category", "value", "1-URGENT"
    )
    return rounded(out, "value")


def ratio_recode(spark, sf):
    out = measures.ratio_recoded(
        census(spark, sf),
        fx(spark, sf, "fx_lookup"),
        "code",
        "t1_income",
        "t1_house",
        "old_code",
        "new_code",
    )
    return rounded(out, "value")


def domain_pivot(spark, sf):
    out = measures.domain_values(
        fx(spark, sf, "fx_long"),
        "2-HIGH",
        code="code",
        domain_col="category",
        measurement_col="measurement",
        value="value",
        measurement="F",
    )
    return rounded(out, "value")


def wide_column_recode(spark, sf):
    out = measures.wide_column_recoded(
        census(spark, sf), fx(spark, sf, "fx_lookup"), "t1_house", "code", "old_code", "new_code"
    )
    return rounded(out, "value")


def assemble_measures(spark, sf):
    base = census(spark, sf)
    series = {
        c: base.where(F.col(c).isNotNull()).select(
            F.col("code").alias("lsoa_code"), F.col(c).alias("value")
        )
        for c in MEASURE_COLUMNS
    }
    return rounded(measures.assemble(series), *MEASURE_COLUMNS)


def study_area(spark, sf):
    boundary = table(spark, sf, "customer").where("c_acctbal > 0").selectExpr("c_custkey as code")
    return rounded(score.study_area(census(spark, sf), boundary, "code"), *MEASURE_COLUMNS)


def percentile_rank(spark, sf):
    return rounded(with_percentile_ranks(materialize(census(spark, sf)), MEASURE_COLUMNS, key="code"), *MEASURE_COLUMNS)


def weighted_index(spark, sf):
    df = score.weighted_index(census(spark, sf), (0.4, 0.3, 0.2, 0.1))
    return rounded(df.select("code", INDEX_T1, INDEX_T2), INDEX_T1, INDEX_T2)


def disadvantaged(spark, sf):
    df = score.flag_disadvantaged(score.weighted_index(census(spark, sf)))
    return df.select("code", DISADVANTAGED)


def full_score(spark, sf):
    return score.area_score(census(spark, sf), key="code")


def area_score(spark, sf):
    out = full_score(spark, sf)
    return rounded(out, *MEASURE_COLUMNS, INDEX_T1, INDEX_T2, SCORE)


def ward_scores(spark, sf):
    values = (INDEX_T1, INDEX_T2, SCORE)
    out = score.ward_scores(
        full_score(spark, sf), fx(spark, sf, "fx_wards"), "code", "ward", values
    )
    return rounded(out, *values)


QUERIES = {
    "recode_vintage": recode_vintage,
    "age_share": age_share,
    "category_share": category_share,
    "ratio_recode": ratio_recode,
    "domain_pivot": domain_pivot,
    "wide_column_recode": wide_column_recode,
    "assemble_measures": assemble_measures,
    "study_area": study_area,
    "percentile_rank": percentile_rank,
    "weighted_index": weighted_index,
    "disadvantaged": disadvantaged,
    "area_score": area_score,
    "ward_scores": ward_scores,
}

_M = ", ".join(f"round({c}, 6) {c}" for c in MEASURE_COLUMNS)


def _rank(c: str) -> str:
    return (
        f"case when {c} is not null then (rank() over (order by {c}) "
        f"+ (count(*) over (partition by {c}) - 1)/2e0) / count({c}) over () * 100e0 end {c}"
    )


STATEMENTS = {
    "o_ranked": "select code, " + ", ".join(_rank(c) for c in MEASURE_COLUMNS) + " from fx_census",
    "o_indexed": """
        select *, 0.25e0*t1_age+0.25e0*t1_edu+0.25e0*t1_house+0.25e0*t1_income neighborhood_index_t1,
          0.25e0*t2_age+0.25e0*t2_edu+0.25e0*t2_house+0.25e0*t2_income neighborhood_index_t2
        from o_ranked""",
    "o_score": """
        select i.*, coalesce(neighborhood_index_t1 <=
            (select quantile_cont(neighborhood_index_t1, 0.5) from o_indexed), false) disadvantaged,
          neighborhood_index_t2 - neighborhood_index_t1 gentrification_score from o_indexed i""",
}

ORACLE = {
    "recode_vintage": """
        select new_code lsoa_code, round(avg(t1_age),6) t1_age, round(avg(t1_house),6) t1_house
        from fx_census join fx_lookup on code=old_code where new_code is not null group by new_code""",
    "age_share": """
        select code lsoa_code,
          round((coalesce(t1_age,0)+coalesce(t2_age,0))/200e0*100,6) "value" from fx_census""",
    "category_share": """
        select code lsoa_code, round(coalesce(sum(case when category='1-URGENT' then v end),0)
          / sum(v) * 100, 6) "value"
        from (select code, category, avg(value) v from fx_long group by all) group by code""",
    "ratio_recode": """
        select new_code lsoa_code, round(avg(t1_income/t1_house*100),6) "value"
        from fx_census join fx_lookup on code=old_code where new_code is not null group by new_code""",
    "domain_pivot": """
        select code lsoa_code,
          round(coalesce(avg(case when category='2-HIGH' then value end),0),6) "value"
        from fx_long where measurement='F' group by code""",
    "wide_column_recode": """
        select new_code lsoa_code, round(avg(t1_house),6) "value"
        from fx_census join fx_lookup on code=old_code where new_code is not null group by new_code""",
    "assemble_measures": f"""
        select code lsoa_code, {_M} from fx_census
        where coalesce({", ".join(MEASURE_COLUMNS)}) is not null""",
    "study_area": f"""
        select code, {_M} from fx_census
        where code in (select c_custkey from customer where c_acctbal > 0)""",
    "percentile_rank": f"select code, {_M} from o_ranked",
    "weighted_index": """
        select code,
          round(0.4e0*t1_age+0.3e0*t1_edu+0.2e0*t1_house+0.1e0*t1_income,6) neighborhood_index_t1,
          round(0.4e0*t2_age+0.3e0*t2_edu+0.2e0*t2_house+0.1e0*t2_income,6) neighborhood_index_t2
        from fx_census""",
    "disadvantaged": """
        select code, coalesce(ni <= (select quantile_cont(ni, 0.5) from
            (select 0.25e0*t1_age+0.25e0*t1_edu+0.25e0*t1_house+0.25e0*t1_income ni from fx_census)),
          false) disadvantaged
        from (select code, 0.25e0*t1_age+0.25e0*t1_edu+0.25e0*t1_house+0.25e0*t1_income ni
              from fx_census)""",
    "area_score": f"""
        select code, {_M}, round(neighborhood_index_t1,6) neighborhood_index_t1,
          round(neighborhood_index_t2,6) neighborhood_index_t2, disadvantaged,
          round(gentrification_score,6) gentrification_score from o_score""",
    "ward_scores": """
        select ward, round(avg(neighborhood_index_t1),6) neighborhood_index_t1,
          round(avg(neighborhood_index_t2),6) neighborhood_index_t2,
          round(avg(gentrification_score),6) gentrification_score
        from o_score join fx_wards using (code) where ward is not null group by ward""",
}
