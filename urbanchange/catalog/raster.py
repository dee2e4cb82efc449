"""Sources, composites, masks, mosaics, resampling and raster statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from urbanchange.catalog.fixtures import BANDS, fx, grid, table, zones
from urbanchange.functions import columns
from urbanchange.functions.skew import materialize
from urbanchange.operators import composite, masks, mosaic, raster_stats, reproject, resample
from urbanchange.plans import study
from urbanchange.sources import pixels, scenes

PIXEL = ["period", "band", "row_", "col_"]


def observations(spark, sf):
    return fx(spark, sf, "fx_obs")


def composites(spark, sf, keep_empty=True):
    """Median composites of both periods; only observed pixels have a row."""
    out = composite.median_composite(
        observations(spark, sf), months=(6, 8), keep_empty=keep_empty
    )
    return out.withColumn("value", F.round("value", 4))


def full_composites(spark, sf):
    """The same on the complete grid, unobserved pixels as null rows."""
    cells = fx(spark, sf, "fx_cells")
    stack = cells.withColumn("band", F.explode(F.array(*[F.lit(b) for b in BANDS]))).withColumn(
        "period", F.explode(F.array(F.lit(1), F.lit(2)))
    )
    return masks.on_grid(composites(spark, sf, keep_empty=False), stack, PIXEL)


def pairs(spark, sf):
    return masks.pair(full_composites(spark, sf), 1, 2)


def rounded(df, *cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


def year_tiles(spark, sf):
    return pixels.year_tiles(fx(spark, sf, "fx_scenes").select("scene_id", "name"), 1998)


def band_from_name(spark, sf):
    names = table(spark, sf, "lineitem").select(
        F.concat(
            F.lit("features_band_"),
            F.col("l_linenumber").cast("string"),
            F.lit("_fc_model_"),
            F.col("l_returnflag"),
            F.lit(".tiff"),
        ).alias("name")
    )
    return (
        names.withColumn("band", pixels.band_from_name(F.col("name")))
        .groupBy("band")
        .agg(F.count(F.lit(1)).alias("files"))
    )


def scene_search(spark, sf):
    found = scenes.search_scenes(fx(spark, sf, "fx_scenes"), (3.0, 3.0, 9.0, 9.0), 1998)
    return found.select("scene_id", "cloud_cover", "min_x", "min_y", "max_x", "max_y")


def composite_window(spark, sf):
    years = table(spark, sf, "orders").select(F.year("o_orderdate").alias("year"))
    return years.groupBy("year").agg(F.count(F.lit(1)).alias("scenes")).select(
        "year",
        "scenes",
        columns.window_start(F.col("year")).cast("string").alias("first_day"),
        columns.window_end(F.col("year")).cast("string").alias("last_day"),
    )


def valid_mask(spark, sf):
    raw = table(spark, sf, "lineitem").select(
        F.col("l_linenumber").alias("band"),
        F.expr(
            "case when l_tax = 0 then double('NaN') when l_discount = 0 then -9999D "
            "else l_extendedprice end"
        ).alias("value"),
    )
    return (
        masks.valid_pixels(raw, nodata=-9999.0)
        .groupBy("band")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if("valid").alias("n_valid"),
            F.round(F.sum(F.when(F.col("valid"), F.col("value"))), 2).alias("total"),
        )
    )


def valid_pct(spark, sf):
    out = masks.valid_percentage(
        full_composites(spark, sf), grid(spark, sf), ["period", "band"]
    )
    return rounded(out, "valid_pct")


def scl_mask(spark, sf):
    return (
        masks.mask_clouds(observations(spark, sf))
        .groupBy("period", "scl")
        .agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("n_clear"))
    )


def solar_day_fuse(spark, sf):
    clear = masks.mask_clouds(observations(spark, sf))
    fused = composite.fuse_solar_days(
        clear, order=("ts", "obs_id", "tile", "value"), lon=-45.0
    )
    return fused.withColumn("solar_day", F.col("solar_day").cast("string"))


def median_composite(spark, sf):
    return composites(spark, sf)


def seasonal_composite(spark, sf):
    """Boundary box, scene search, cloud mask, one value per solar day, median."""
    boundary = zones(spark, sf, "a")
    seen = observations(spark, sf).withColumn("scene_id", F.floor(F.col("obs_id") / 10))
    out = study.build_composite(
        boundary,
        fx(spark, sf, "fx_scenes"),
        seen.drop("period"),
        1998,
        max_cloud=60.0,
        order=("ts", "obs_id", "tile", "value"),
    )
    return rounded(out, "value", digits=4)


def band_assets(spark, sf):
    counts = observations(spark, sf).groupBy("band").agg(F.count(F.lit(1)).alias("n"))
    return composite.with_asset_names(counts)


def landcover_mode(spark, sf):
    return composite.landcover_mode(fx(spark, sf, "fx_landcover"))


def green_mask(spark, sf):
    return (
        composite.with_green_mask(fx(spark, sf, "fx_landcover"))
        .groupBy("cls", "label", "green")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def clip_boundary(spark, sf):
    clipped = mosaic.clip_to_boundary(
        observations(spark, sf), zones(spark, sf, "a"), grid(spark, sf)
    )
    return clipped.groupBy("band", "row_", "col_").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")
    )


def mosaic_last(spark, sf):
    return mosaic.mosaic(
        masks.mask_clouds(observations(spark, sf)),
        PIXEL,
        ("tile", "obs_id", "value"),
        "last",
    )


def mosaic_avg(spark, sf):
    out = mosaic.mosaic(masks.mask_clouds(observations(spark, sf)), PIXEL)
    return rounded(out, "value", digits=6)


def clip_merge_year(spark, sf):
    tiles = masks.mask_clouds(observations(spark, sf)).where("period = 1")
    out = mosaic.clip_and_merge(tiles, zones(spark, sf, "b"), grid(spark, sf))
    return rounded(out, "value", digits=6)


def masked_diff(spark, sf):
    out = masks.masked_difference(pairs(spark, sf))
    return rounded(out, "diff", digits=6)


def missing_mask(spark, sf):
    cells = fx(spark, sf, "fx_cells")
    first = composites(spark, sf).where("period = 1 and band = 1")
    return masks.missing_mask(first.select("row_", "col_", "value"), cells)


def combined_mask(spark, sf):
    return masks.combined_mask(pairs(spark, sf)).select("band", "row_", "col_", "missing")


def apply_mask(spark, sf):
    flagged = masks.combined_mask(pairs(spark, sf))
    return masks.apply_mask(flagged, "v1").select("band", "row_", "col_", "v1")


def zscore_stack(spark, sf):
    stack = materialize(full_composites(spark, sf))
    return rounded(masks.zscore(stack), "value")


def no_data_mask(spark, sf):
    return masks.no_data_mask(materialize(full_composites(spark, sf)))


def minmax01(spark, sf):
    gap = masks.masked_difference(materialize(pairs(spark, sf)))
    out = masks.minmax01(
        gap.select("band", "row_", "col_", F.abs("diff").alias("value")), "value", ["band"]
    )
    return rounded(out, "value")


def resample_bilinear(spark, sf):
    g = grid(spark, sf)
    image = masks.apply_mask(masks.combined_mask(pairs(spark, sf)), "v2")
    out = resample.resample_bilinear(
        image.select("band", "row_", "col_", F.coalesce("v2", F.lit(0.0)).alias("value")),
        (g.height, g.width),
        (g.height * 2, g.width * 2),
    )
    return rounded(out, "value", digits=7)


def reproject_vertices(spark, sf):
    points = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("vertex"),
        (F.col("c_custkey") % 97 / F.lit(97.0) - 0.5).alias("x"),
        (F.lit(51.3) + F.col("c_custkey") % 89 / F.lit(200.0)).alias("y"),
    )
    return rounded(
        reproject.reproject_vertices(points, "EPSG:4326", "EPSG:32630"), "x", "y", digits=3
    )


def band_stats(spark, sf):
    out = raster_stats.band_statistics(
        materialize(full_composites(spark, sf)), ["period", "band"]
    )
    names = [c for c in out.columns if c not in ("period", "band")]
    return rounded(out, *names, digits=6)


def zonal_stats(spark, sf):
    band = full_composites(spark, sf).where("period = 1 and band = 3")
    out = raster_stats.zonal_statistics(zones(spark, sf), band, grid(spark, sf))
    return rounded(out, "min", "mean", "max", "median", digits=6)


QUERIES = {
    f.__name__: f
    for f in (
        year_tiles,
        band_from_name,
        scene_search,
        composite_window,
        valid_mask,
        valid_pct,
        scl_mask,
        solar_day_fuse,
        median_composite,
        seasonal_composite,
        band_assets,
        landcover_mode,
        green_mask,
        clip_boundary,
        mosaic_last,
        mosaic_avg,
        clip_merge_year,
        masked_diff,
        missing_mask,
        combined_mask,
        apply_mask,
        zscore_stack,
        no_data_mask,
        minmax01,
        resample_bilinear,
        reproject_vertices,
        band_stats,
        zonal_stats,
    )
}

_ASSETS = (
    "(1,'B1','coastal'),(2,'B2','blue'),(3,'B3','green'),(4,'B4','red'),(5,'B5','rededge1'),"
    "(6,'B6','rededge2'),(7,'B7','rededge3'),(8,'B8','nir'),(9,'B8A','nir08'),"
    "(10,'B11','swir16'),(11,'B12','swir22')"
)
_CLASSES = (
    "(0,'water'),(1,'trees'),(2,'grass'),(3,'flooded_vegetation'),(4,'crops'),"
    "(5,'shrub_and_scrub'),(6,'built'),(7,'bare'),(8,'snow_and_ice')"
)
_IN_A = "(row_%4+0.5e0)*3 > 4*(col_%4+0.5e0)"

STATEMENTS = {
    "o_clear": """
        select *, case when scl not in (0,1,3,8,9,10) then value end clear from fx_obs""",
    "o_comp": """
        select period, band, row_, col_, round(quantile_cont(clear, 0.5), 4) "value"
        from o_clear where month(ts) between 6 and 8 group by all""",
    "o_full": """
        select p.period, b.band, c.row_, c.col_, o."value"
        from fx_cells c cross join (select unnest([1,2]) period) p
          cross join (select unnest([1,2,3,4,5,6,7]) band) b
          left join o_comp o on o.period=p.period and o.band=b.band and o.row_=c.row_ and o.col_=c.col_""",
    "o_pairs": """
        select a.band, a.row_, a.col_, a."value" v1, b."value" v2
        from o_full a join o_full b using (band, row_, col_) where a.period=1 and b.period=2""",
    "o_filled": """
        select period, band, row_, col_, coalesce("value", min("value") over (partition by period)) v
        from o_full""",
    "o_z": """
        select period, band, row_, col_, (v - avg(v) over (partition by period))
          / stddev_pop(v) over (partition by period) z from o_filled""",
    # Cell centre inside the triangle: code, in the trapezoid: code + 1, in the square: code + 2.
    "o_cover": f"""
        select row_, col_, cast(floor(row_/4e0)*32 + floor(col_/4e0)*4 as int)
            + case when {_IN_A} then 0 else 1 end code, 0 ord from fx_cells
        union all
        select row_, col_, cast(floor(row_/4e0)*32 + floor(col_/4e0)*4 as int) + 2, 1 from fx_cells
        where row_%4 in (1,2) and col_%4 in (1,2)""",
}

ORACLE = {
    "year_tiles": """
        select scene_id, name from fx_scenes where o_day = date '1998-08-31'""".replace(
        "o_day", "cast(ts as date)"
    ),
    "band_from_name": """
        select l_linenumber band, count(*) files from lineitem group by l_linenumber""",
    "scene_search": """
        select scene_id, cloud_cover, min_x, min_y, max_x, max_y from fx_scenes
        where cast(ts as date) between date '1998-06-01' and date '1998-08-31' and cloud_cover < 20
          and min_x <= 9 and max_x >= 3 and min_y <= 9 and max_y >= 3""",
    "composite_window": """
        select cast(year(o_orderdate) as int) "year", count(*) scenes,
          concat(cast(year(o_orderdate) as varchar), '-06-01') first_day,
          concat(cast(year(o_orderdate) as varchar), '-08-31') last_day
        from orders group by year(o_orderdate)""",
    "valid_mask": """
        select l_linenumber band, count(*) n, count(*) filter (l_tax <> 0 and l_discount <> 0) n_valid,
          round(sum(l_extendedprice) filter (l_tax <> 0 and l_discount <> 0), 2) total
        from lineitem group by l_linenumber""",
    "valid_pct": """
        select period, band, round(100e0*count("value")/count(*), 6) valid_pct from o_full
        group by period, band""",
    "scl_mask": """
        select period, scl, count(*) n,
          count(case when scl in (2,4,5,6,7) then value end) n_clear from fx_obs group by period, scl""",
    "solar_day_fuse": """
        select band, row_, col_, cast(cast(ts - interval 3 hour as date) as varchar) solar_day, "value"
        from (select *, clear "value", row_number() over (partition by band, row_, col_,
            cast(ts - interval 3 hour as date)
            order by (clear is null), ts, obs_id, tile, clear) rn
          from (select * exclude (value) from o_clear)) where rn = 1""",
    "median_composite": 'select period, band, row_, col_, "value" from o_comp',
    "seasonal_composite": """
        select 1998 "year", band, row_, col_, round(quantile_cont("value", 0.5), 4) "value" from (
          select band, row_, col_, clear "value", row_number() over (
            partition by band, row_, col_, cast(ts + to_seconds(cast(240*lon as bigint)) as date)
            order by (clear is null), ts, obs_id, tile, clear) rn
          from o_clear, (select (min(x0) + max(x0) + 3)/2e0 lon, min(x0) bx0, max(x0)+3 bx1,
              min(y0) by0, max(y0)+4 by1 from fx_zones where kind='a') b
          where obs_id // 10 in (select scene_id from fx_scenes
            where cast(ts as date) between date '1998-06-01' and date '1998-08-31'
              and cloud_cover < 60 and min_x <= bx1 and max_x >= bx0 and min_y <= by1 and max_y >= by0))
        where rn = 1 group by band, row_, col_""",
    "band_assets": f"""
        select band, n, band_name, asset from (select band, count(*) n from fx_obs group by band)
        join (values {_ASSETS}) a(b, band_name, asset) on b = band""",
    "landcover_mode": """
        select row_, col_, cls from (select row_, col_, cls,
            row_number() over (partition by row_, col_ order by count(*) desc, cls) rn
          from fx_landcover group by row_, col_, cls) where rn = 1""",
    "green_mask": f"""
        select cls, label, label in ('trees','grass') green, count(*) n
        from fx_landcover join (values {_CLASSES}) c(k, label) on k = cls group by cls, label""",
    "clip_boundary": f"""
        select band, row_, col_, count(*) n, round(sum(value),2) total from fx_obs
        where {_IN_A} group by band, row_, col_""",
    "mosaic_last": """
        select period, band, row_, col_, "value" from (
          select period, band, row_, col_, clear "value", row_number() over (
            partition by period, band, row_, col_
            order by (clear is null), tile desc, obs_id desc, clear desc) rn from o_clear)
        where rn = 1""",
    "mosaic_avg": """
        select period, band, row_, col_, round(avg(clear),6) "value" from o_clear
        group by period, band, row_, col_""",
    "clip_merge_year": f"""
        select band, row_, col_, round(avg(clear),6) "value" from o_clear
        where period = 1 and not ({_IN_A}) group by band, row_, col_""",
    "masked_diff": "select band, row_, col_, v1, v2, round(v2-v1,6) diff from o_pairs",
    "missing_mask": """
        select row_, col_, case when "value" is null then 1 else 0 end missing
        from o_full where period=1 and band=1""",
    "combined_mask": """
        select band, row_, col_, case when v1 is null or v2 is null then 1 else 0 end missing
        from o_pairs""",
    "apply_mask": """
        select band, row_, col_, case when v1 is null or v2 is null then 0 else v1 end v1
        from o_pairs""",
    "zscore_stack": 'select period, band, row_, col_, round(z,6) "value" from o_z',
    "no_data_mask": """
        select period, row_, col_, ("value" is null
          or "value" = min("value") over (partition by period)) no_data
        from o_full where band = 1""",
    "minmax01": """
        select band, row_, col_, round((d - min(d) over w) / (max(d) over w - min(d) over w), 6) "value"
        from (select band, row_, col_, abs(v2-v1) d from o_pairs) window w as (partition by band)""",
    "resample_bilinear": """
        select band, t_row row_, t_col col_, round(sum("value" * wr * wc), 7) "value" from (
          select p.band, r.t t_row, c.t t_col, r.w wr, c.w wc,
            case when p.v1 is null or p.v2 is null then 0 else p.v2 end "value"
          from o_pairs p
          join (select t, cast(s as int) s, sum(w) w from (
              select t, floor(pos) s, 1 - (pos - floor(pos)) w from o_axis_r
              union all select t, least(floor(pos)+1, n-1), pos - floor(pos) from o_axis_r)
            group by t, s) r on r.s = p.row_
          join (select t, cast(s as int) s, sum(w) w from (
              select t, floor(pos) s, 1 - (pos - floor(pos)) w from o_axis_c
              union all select t, least(floor(pos)+1, n-1), pos - floor(pos) from o_axis_c)
            group by t, s) c on c.s = p.col_)
        group by band, t_row, t_col""",
    "band_stats": """
        select period, band, round(avg("value"),6) mean, round(quantile_cont("value",0.5),6) median,
          round(min("value"),6) "min", round(max("value"),6) "max",
          round(stddev_pop("value"),6) std, round(quantile_cont("value",0.25),6) p25,
          round(quantile_cont("value",0.75),6) p75,
          round(100e0*(count(*)-count("value"))/count(*),6) null_pct
        from o_full group by period, band""",
    "zonal_stats": """
        select z.code, count("value") "count", round(min("value"),6) "min",
          round(avg("value"),6) mean, round(max("value"),6) "max",
          round(quantile_cont("value",0.5),6) median
        from fx_zones z left join o_cover c on c.code = z.code
          left join (select * from o_full where period=1 and band=3) f
            on f.row_ = c.row_ and f.col_ = c.col_ group by z.code""",
}
STATEMENTS["o_axis_r"] = """
    select t, n, least(greatest((t+0.5e0)*0.5e0-0.5e0, 0), n-1) pos
    from (select unnest(range(0, 2*n)) t, n from (select max(row_)+1 n from fx_cells))"""
STATEMENTS["o_axis_c"] = """
    select t, n, least(greatest((t+0.5e0)*0.5e0-0.5e0, 0), n-1) pos
    from (select unnest(range(0, 2*n)) t, n from (select max(col_)+1 n from fx_cells))"""
