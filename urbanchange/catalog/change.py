"""Change maps, thresholds, components and patches."""

from __future__ import annotations

from pyspark.sql import functions as F

from urbanchange.catalog.fixtures import BANDS, fx, grid
from urbanchange.catalog.geometry import changes
from urbanchange.catalog.raster import full_composites, pairs, rounded
from urbanchange.functions.skew import materialize
from urbanchange.operators import (
    agreement,
    components,
    context,
    feature_diff,
    masks,
    patches,
    registry,
    simple_diff,
    threshold,
)

SIZE, STRIDE = 4, 2


def continuous(spark, sf):
    return simple_diff.change_map(materialize(full_composites(spark, sf)), 1, 2)


def filled_pairs(spark, sf):
    """Both composites with missing pixels as 0."""
    return pairs(spark, sf).na.fill(0.0, ["v1", "v2"])


def simple_diff_map(spark, sf):
    return rounded(continuous(spark, sf), "value")


def otsu(spark, sf):
    return rounded(threshold.otsu(materialize(continuous(spark, sf))), "threshold")


def multi_otsu(spark, sf):
    return rounded(threshold.multi_otsu(materialize(continuous(spark, sf))), "lower", "threshold")


def scaled_otsu(spark, sf):
    base = materialize(continuous(spark, sf))
    cut = threshold.scaled_otsu(base, 1.5)
    return (
        threshold.above(base, cut)
        .groupBy("band")
        .agg(F.sum("changed").alias("changed_px"))
        .join(rounded(cut, "threshold"), "band")
    )


def adaptive_threshold(spark, sf):
    flags = threshold.adaptive(continuous(spark, sf), 3)
    return flags.select("band", "row_", "col_", "changed")


def remove_small(spark, sf):
    return components.remove_small(changes(spark, sf), 4, tile=8)


def segment_labels(spark, sf):
    return components.segment(changes(spark, sf), 10, tile=8)


def change_map(spark, sf):
    return registry.binary_changes(
        materialize(full_composites(spark, sf)), 1, 2, grid(spark, sf)
    )


def extract_patches(spark, sf):
    packed = patches.extract_patches(filled_pairs(spark, sf), grid(spark, sf), SIZE, STRIDE, "v1")
    p = F.col("patch")
    return packed.select(
        "band",
        "pi",
        "pj",
        F.size(p).cast("long").alias("cells"),
        F.round(p[0], 4).alias("top_left"),
        F.round(p[SIZE - 1], 4).alias("top_right"),
        F.round(p[SIZE * SIZE - 1], 4).alias("bottom_right"),
        F.round(F.aggregate(p, F.lit(0.0), lambda a, v: a + v), 4).alias("total"),
    )


def reconstruct(spark, sf):
    base = materialize(filled_pairs(spark, sf))
    packed = patches.extract_patches(base, grid(spark, sf), SIZE, STRIDE, "v1")
    scaled = patches.unpack_patches(packed, SIZE).withColumn(
        "value", F.col("value") * (F.col("pi") + 1)
    )
    out = patches.reconstruct(scaled, base.select("band", "row_", "col_"), SIZE, STRIDE)
    return rounded(out, "value", digits=4)


def score_patches(spark, sf):
    base = materialize(filled_pairs(spark, sf))
    out = patches.score_patches(base, grid(spark, sf), patches.mean_abs_diff, SIZE, STRIDE)
    return rounded(out, "value")


def feature_diff_map(spark, sf):
    stack = materialize(full_composites(spark, sf))
    gaps = masks.no_data_mask(stack).where("period = 1 and no_data")
    features = stack.withColumnRenamed("band", "channel").na.fill(0.0, ["value"])
    return rounded(feature_diff.feature_difference(features, 1, 2, gaps), "value")


def spatial_context(spark, sf):
    return rounded(context.spatial_context(filled_pairs(spark, sf)), "value", digits=4)


def triangle_threshold(spark, sf):
    base = materialize(continuous(spark, sf))
    tri = threshold.triangle(base).withColumnRenamed("threshold", "triangle")
    level = threshold.otsu_8bit(base).withColumnRenamed("threshold", "otsu_level")
    return rounded(tri.join(level, "band"), "triangle", "otsu_level")


def pca_kmeans(spark, sf):
    return context.pca_kmeans(filled_pairs(spark, sf), BANDS)


def map_agreement(spark, sf):
    fuzzy = continuous(spark, sf).withColumnRenamed("value", "p")
    both = fuzzy.join(
        changes(spark, sf).withColumnRenamed("changed", "t"), ["band", "row_", "col_"]
    )
    out = agreement.map_agreement(both, "p", "t", ["band"])
    return rounded(out, "dice_loss", "mse")


QUERIES = {
    "simple_diff": simple_diff_map,
    "otsu": otsu,
    "multi_otsu": multi_otsu,
    "scaled_otsu": scaled_otsu,
    "adaptive_threshold": adaptive_threshold,
    "remove_small": remove_small,
    "segment_labels": segment_labels,
    "change_map": change_map,
    "extract_patches": extract_patches,
    "reconstruct": reconstruct,
    "score_patches": score_patches,
    "feature_diff": feature_diff_map,
    "spatial_context": spatial_context,
    "triangle_threshold": triangle_threshold,
    "pca_kmeans": pca_kmeans,
    "map_agreement": map_agreement,
}

_BIN = "cast(case when v = 1 then 255 else floor(v * 256) end as int)"


def _reach(source: str, gap: str) -> str:
    """Pairs of connected pixels by repeated steps to neighbours."""
    return f"""
        -- cols: band, ra, ca, rb, cb
        select band, row_, col_, row_, col_ from {source}
        union
        select r.band, r.ra, r.ca, s.row_, s.col_ from NAME r join {source} s
          on s.band = r.band and {gap}"""


_FOUR = "abs(s.row_ - r.rb) + abs(s.col_ - r.cb) = 1"
_EIGHT = "greatest(abs(s.row_ - r.rb), abs(s.col_ - r.cb)) = 1"

STATEMENTS = {
    "o_sd": """
        select band, row_, col_, (d - min(d) over w) / (max(d) over w - min(d) over w) v
        from (select a.band, a.row_, a.col_, abs(b.z - a.z) d
          from o_z a join o_z b using (band, row_, col_) where a.period=1 and b.period=2)
        window w as (partition by band)""",
    "o_hist": f"select band, {_BIN} b, count(*) n from o_sd group by 1, 2",
    "o_bins": """
        select k.band, k.b, coalesce(h.n, 0) n from (select band, unnest(range(0,256)) b
          from (select distinct band from o_hist)) k left join o_hist h using (band, b)""",
    "o_cum": """
        select band, b, cast(sum(n) over w as bigint) w1, cast(sum(n*b) over w as bigint) s1,
          cast(sum(n) over (partition by band) as bigint) wt,
          cast(sum(n*b) over (partition by band) as bigint) st
        from o_bins window w as (partition by band order by b)""",
    "o_otsu": """
        select band, (b+0.5e0)/256 thr from (select band, b, row_number() over (partition by band
            order by w1*(wt-w1)*(s1/w1-(st-s1)/(wt-w1))*(s1/w1-(st-s1)/(wt-w1)) desc, b) rn
          from o_cum where w1 > 0 and w1 < wt) where rn = 1""",
    "o_multi": """
        select band, (i+0.5e0)/256 lo, (j+0.5e0)/256 hi from (
          select x.band, x.b i, y.b j, row_number() over (partition by x.band order by
            case when x.w1>0 then cast(x.s1 as double)*x.s1/x.w1 else 0 end
            + case when y.w1>x.w1 then cast(y.s1-x.s1 as double)*(y.s1-x.s1)/(y.w1-x.w1) else 0 end
            + case when y.wt>y.w1 then cast(y.st-y.s1 as double)*(y.st-y.s1)/(y.wt-y.w1) else 0 end
            desc, x.b, y.b) rn
          from o_cum x join o_cum y on x.band = y.band and x.b < y.b and y.b < 255) where rn = 1""",
    "o_cm0": """
        select s.band, s.row_, s.col_ from o_sd s join o_multi m on m.band = s.band where s.v > m.hi""",
    "o_reach_cm": _reach("o_cm0", _FOUR).replace("NAME", "o_reach_cm"),
    "o_reach_4": _reach("o_changed", _FOUR).replace("NAME", "o_reach_4"),
    "o_reach_8": _reach("o_changed", _EIGHT).replace("NAME", "o_reach_8"),
    "o_comp8": """
        select band, ra row_, ca col_, min(rb*100000+cb) root, count(*) px
        from o_reach_8 group by band, ra, ca""",
    "o_patch": f"""
        select p.band, i pi, j pj, p.row_-i*{STRIDE} pr, p.col_-j*{STRIDE} pc,
          coalesce(v1,0) v1, coalesce(v2,0) v2, p.row_, p.col_
        from o_pairs p
          join (select unnest(range(0, cast(greatest(max(row_)+1-{SIZE}+{STRIDE}, 0)//{STRIDE} as bigint))) i from fx_cells)
            on p.row_ between i*{STRIDE} and i*{STRIDE}+{SIZE - 1}
          join (select unnest(range(0, cast(greatest(max(col_)+1-{SIZE}+{STRIDE}, 0)//{STRIDE} as bigint))) j from fx_cells)
            on p.col_ between j*{STRIDE} and j*{STRIDE}+{SIZE - 1}""",
    "o_sizes": "select max(row_) + 1 h, max(col_) + 1 w from fx_cells",
    "o_levels": """
        select band, cast(least(floor(v*255), 255) as int) b, count(*) n from o_sd group by 1, 2""",
    "o_tri_ends": """
        select band, case when lo > 0 then lo-1 else lo end lo, case when hi < 255 then hi+1 else hi end hi,
          top, peak from (select band, min(b) lo, max(b) hi, max(n) peak,
            arg_min(b, -n*1000 + b) top from o_levels group by band)""",
    "o_tri": """
        select band, flip, f, t, peak from (select band, (top-lo) < (hi-top) flip, peak,
          case when (top-lo) < (hi-top) then 255-hi else lo end f,
          case when (top-lo) < (hi-top) then 255-top else top end t from o_tri_ends)""",
    "o_taps": """
        select sigma, k, g / sum(g) over (partition by sigma) g from (
          select sigma, k, exp(-0.5e0*(k/sigma)*(k/sigma)) g from (
            select sigma, unnest(range(-cast(floor(4*sigma+0.5) as bigint),
              cast(floor(4*sigma+0.5) as bigint)+1)) k
            from (select unnest([101e0,151e0,201e0]) sigma)))""",
    # One 1-D blur matrix per axis: weight of source s for target t, edges repeated.
    "o_blur_r": """
        select sigma, t, least(greatest(t+k, 0), h-1) s, sum(g) g
        from (select unnest(range(0, h)) t, h from o_sizes) cross join o_taps group by 1, 2, 3""",
    "o_blur_c": """
        select sigma, t, least(greatest(t+k, 0), w-1) s, sum(g) g
        from (select unnest(range(0, w)) t, w from o_sizes) cross join o_taps group by 1, 2, 3""",
    "o_gauss1": """
        select sigma, band, row_, t col_, sum(v*g) v from o_sd join o_blur_c on s = col_
        group by 1, 2, 3, 4""",
    "o_gauss": """
        select g1.sigma, band, r.t row_, col_, sum(v*g) v from o_gauss1 g1
          join o_blur_r r on r.s = g1.row_ and r.sigma = g1.sigma group by 1, 2, 3, 4""",
    "o_ad0": """
        select cast(g.sigma as bigint)*100 + g.band band, g.row_, g.col_
        from o_gauss g join o_sd s on s.band=g.band and s.row_=g.row_ and s.col_=g.col_
        where s.v > 2*g.v""",
    "o_reach_ad": _reach("o_ad0", _FOUR).replace("NAME", "o_reach_ad"),
}

ORACLE = {
    "simple_diff": 'select band, row_, col_, round(v, 6) "value" from o_sd',
    "otsu": "select band, round(thr, 6) threshold from o_otsu",
    "multi_otsu": 'select band, round(lo, 6) "lower", round(hi, 6) threshold from o_multi',
    "scaled_otsu": """
        select s.band, count(*) filter (v > 1.5e0*thr) changed_px, round(any_value(1.5e0*thr), 6) threshold
        from o_sd s join o_otsu o on o.band = s.band group by s.band""",
    "adaptive_threshold": """
        select s.band, s.row_, s.col_, case when exists (select 1 from (
            select band % 100 band, ra, ca from o_reach_ad group by o_reach_ad.band, ra, ca
            having count(*) >= 3) k
          where k.band = s.band and k.ra = s.row_ and k.ca = s.col_) then 1 else 0 end changed
        from o_sd s""",
    "remove_small": """
        select p.band, p.row_, p.col_, case when k.ra is null then 0 else 1 end changed
        from o_pairs p left join (select band, ra, ca from o_reach_4 group by band, ra, ca
          having count(*) >= 4) k on k.band = p.band and k.ra = p.row_ and k.ca = p.col_""",
    "segment_labels": """
        select p.band, p.row_, p.col_, case when c.px >= 10 then d.label else 0 end "label"
        from o_pairs p left join o_comp8 c using (band, row_, col_)
          left join (select band, root, dense_rank() over (partition by band order by root) "label"
            from (select distinct band, root from o_comp8)) d
          on d.band = c.band and d.root = c.root""",
    "change_map": """
        select 'simple_diff' model, s.band, s.row_, s.col_,
          case when k.ra is null then 0 else 1 end changed
        from o_sd s left join (select band, ra, ca from o_reach_cm group by band, ra, ca
          having count(*) >= 4) k on k.band = s.band and k.ra = s.row_ and k.ca = s.col_""",
    "extract_patches": f"""
        select band, pi, pj, count(*) cells, round(max(case when pr=0 and pc=0 then v1 end),4) top_left,
          round(max(case when pr=0 and pc={SIZE - 1} then v1 end),4) top_right,
          round(max(case when pr={SIZE - 1} and pc={SIZE - 1} then v1 end),4) bottom_right,
          round(sum(v1),4) total from o_patch group by band, pi, pj""",
    "reconstruct": """
        select p.band, p.row_, p.col_, round(coalesce(avg(q.v1*(q.pi+1)),0),4) "value"
        from o_pairs p left join o_patch q using (band, row_, col_) group by 1, 2, 3""",
    "score_patches": """
        select band, row_, col_, round((v - min(v) over w)/nullif(max(v) over w - min(v) over w, 0),6) "value"
        from (select p.band, p.row_, p.col_, coalesce(avg(s.score),0) v from o_pairs p
          left join o_patch q using (band, row_, col_)
          left join (select band, pi, pj, avg(abs(v2-v1)) score from o_patch group by 1, 2, 3) s
            on s.band = q.band and s.pi = q.pi and s.pj = q.pj group by 1, 2, 3)
        window w as (partition by band)""",
    "feature_diff": """
        select row_, col_, round((d - min(d) over ())/(max(d) over () - min(d) over ()),6) "value"
        from (select row_, col_, abs(avg(z) filter (period=1) - avg(z) filter (period=2)) d from (
            select period, row_, col_, (v - avg(v) over (partition by period))
              / stddev_pop(v) over (partition by period) z
            from (select f.period, f.row_, f.col_, case when n.gap then 0 else coalesce(f."value",0) end v
              from o_full f join (select row_, col_, ("value" is null or "value" = min("value") over ()) gap
                from o_full where band=1 and period=1) n using (row_, col_)))
          group by row_, col_)""",
    "spatial_context": """
        select p.band, p.row_, p.col_, round(abs(p.v1*sum(q.v1*q.v2)/nullif(sum(q.v1*q.v1),0) - p.v2),4) "value"
        from (select band, row_, col_, coalesce(v1,0) v1, coalesce(v2,0) v2 from o_pairs) p
          left join (select band, row_, col_, coalesce(v1,0) v1, coalesce(v2,0) v2 from o_pairs) q
          on q.band = p.band and abs(q.row_-p.row_) between 1 and 3 and abs(q.col_-p.col_) between 1 and 3
        group by p.band, p.row_, p.col_, p.v1, p.v2""",
    "triangle_threshold": """
        select t.band, round((case when flip then 255-(best-1) else best-1 end)*0.5e0/255, 6) triangle,
          round(lvl/255e0, 6) otsu_level
        from (select band, flip, at_ best from (
            select s.band, s.flip, s.at_, row_number() over (partition by s.band order by
              case when s.at_ = s.f then 0 else s.peak*s.at_ + (s.f-s.t)*coalesce(l.n,0) end desc, s.at_) rn
            from (select *, unnest(range(f, t+1)) at_ from o_tri) s
              left join o_levels l on l.band = s.band and l.b = case when s.flip then 255-s.at_ else s.at_ end)
          where rn = 1) t
        join (select band, b lvl from (select band, b, row_number() over (partition by band order by
              w1*(wt-w1)*(s1/w1-(st-s1)/(wt-w1))*(s1/w1-(st-s1)/(wt-w1)) desc, b) rn
            from (select band, b, cast(sum(n) over w as bigint) w1, cast(sum(n*b) over w as bigint) s1,
                cast(sum(n) over (partition by band) as bigint) wt,
                cast(sum(n*b) over (partition by band) as bigint) st
              from o_levels window w as (partition by band order by b)) where w1 < wt) where rn = 1) o
        on o.band = t.band""",
    "map_agreement": """
        select s.band, round(1e0 - (2e0*sum(s.v*t)+1e0)/(sum(s.v)+sum(t)+1e0), 6) dice_loss,
          round(avg((s.v-t)*(s.v-t)), 6) mse
        from o_sd s join (select p.band, p.row_, p.col_,
            case when abs(p.v2-p.v1) > 20000 then 1 else 0 end t from o_pairs p) c
          using (band, row_, col_) group by s.band""",
}
