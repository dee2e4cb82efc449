"""Polygons, zones and their areas."""

from __future__ import annotations

from pyspark.sql import functions as F

from urbanchange.catalog.fixtures import BANDS, LAYERS, fx, grid, planning, table, zones
from urbanchange.catalog.raster import pairs, rounded
from urbanchange.functions.skew import materialize
from urbanchange.operators import maplayers, overlay, rings, scanfill
from urbanchange.operators import zones as zonal


def changes(spark, sf):
    """A binary change map: pixels whose composite moved by more than 20,000."""
    moved = F.abs(F.col("v2") - F.col("v1")) > 20000
    return pairs(spark, sf).select(
        "band", "row_", "col_", F.coalesce(moved, F.lit(False)).cast("int").alias("changed")
    )


def layer_bounds(spark, sf):
    return rings.layer_bounds(zones(spark, sf), ["kind"])


def ring_clean(spark, sf):
    """Open, clockwise and repeated vertices in; rectangles without area drop out."""
    dirty = table(spark, sf, "part").selectExpr(
        "p_partkey as feature_id",
        "double(p_partkey % 13) as x",
        "double(p_size) as y",
        "double(p_size % 5) as w",
        "if(p_partkey % 2 = 0, 2D, 1D) as h",
    )
    p = [("x", "y"), ("x", "y"), ("x", "y + h"), ("x + w", "y + h"), ("x + w", "y")]
    points = ",".join(f"named_struct('x', {a}, 'y', {b})" for a, b in p)
    cleaned = rings.clean_rings(
        dirty.selectExpr("feature_id", f"array(array({points})) as rings")
    )
    return cleaned.select(
        "feature_id",
        F.size(F.col("rings")[0]).cast("long").alias("vertices"),
        F.round(rings.signed_area(F.col("rings")[0]), 6).alias("signed_area"),
    )


def polygon_area(spark, sf):
    return rounded(rings.polygon_area(zones(spark, sf)), "area")


def rasterize_zones(spark, sf):
    return scanfill.rasterize_zones(zones(spark, sf), grid(spark, sf))


def count_change_px(spark, sf):
    z = zones(spark, sf)
    owners = scanfill.rasterize_zones(z, grid(spark, sf))
    return zonal.count_changed(changes(spark, sf), owners, z)


def phi(spark, sf):
    return zonal.feature_matrix(changes(spark, sf), zones(spark, sf), grid(spark, sf), BANDS)


def phi_matrix(spark, sf):
    out = phi(spark, sf)
    return rounded(out, *out.columns[1:])


def coverage(spark, sf):
    return overlay.planning_coverage(zones(spark, sf), planning(spark, sf), LAYERS)


def planning_coverage(spark, sf):
    return rounded(coverage(spark, sf), *LAYERS)


def clip_layer_area(spark, sf):
    out = overlay.clipped_layer_area(planning(spark, sf), zones(spark, sf, "c"))
    return rounded(out.where("area > 1e-9"), "area")


def conservation_overlap(spark, sf):
    layer = planning(spark, sf).where("layer = 'conservation'")
    out = maplayers.protected_overlap(
        materialize(changes(spark, sf)), layer, zones(spark, sf, "ab"), grid(spark, sf)
    )
    return rounded(out, "inside_pct")


QUERIES = {
    f.__name__: f
    for f in (
        layer_bounds,
        ring_clean,
        polygon_area,
        rasterize_zones,
        count_change_px,
        phi_matrix,
        planning_coverage,
        clip_layer_area,
        conservation_overlap,
    )
}

_PHI = ", ".join(
    f"100e0*count(case when c.band={b} then 1 end)/a.area features_band_{b}_simple_diff"
    for b in BANDS
)
_COVER = ", ".join(
    f"coalesce(sum(case when layer='{n}' then shared end),0)/any_value(z.area)*100e0 {n}"
    for n in LAYERS
)

STATEMENTS = {
    "o_area": """
        select code, kind, x0, y0,
          case kind when 'a' then 6e0 when 'b' then 10e0 else 4e0 end area from fx_zones""",
    "o_owner": """
        select row_, col_, arg_max(code, ord) code from o_cover group by row_, col_""",
    "o_changed": """
        select band, row_, col_ from o_pairs where abs(v2-v1) > 20000""",
    "o_phi": f"""
        select a.code, {_PHI} from o_area a left join
          (select code, band from o_owner join o_changed using (row_, col_)) c on c.code = a.code
        group by a.code, a.area""",
    # Rectangle and block overlap, then the part left of the line x = x0 + 3/4 (y - y0): the
    # integral over y of that line's distance from the rectangle's left side, held in [0, w].
    "o_boxes": """
        select z.code, z.kind, z.area, p.layer, p.feature_id,
          greatest(p.min_x, z.x0) xa, least(p.max_x, z.x0+4) xb,
          greatest(p.min_y, z.y0) ya, least(p.max_y, z.y0+4) yb, z.x0, z.y0,
          greatest(0, least(p.max_x, z.x0+3) - greatest(p.min_x, z.x0+1))
            * greatest(0, least(p.max_y, z.y0+3) - greatest(p.min_y, z.y0+1)) square
        from o_area z join fx_planning p
          on p.min_x < z.x0+4 and p.max_x > z.x0 and p.min_y < z.y0+4 and p.max_y > z.y0""",
    "o_shared": """
        select code, layer, feature_id,
          case kind when 'c' then square when 'a' then leftside
            else (xb-xa)*(yb-ya) - leftside end shared
        from (select *, (cb*cb - ca*ca)/2/0.75e0
            + (xb-xa)*greatest(0, yb - greatest(ya, y0 + (xb-x0)/0.75e0)) leftside
          from (select *, greatest(0, least(xb-xa, x0+0.75e0*(ya-y0)-xa)) ca,
              greatest(0, least(xb-xa, x0+0.75e0*(yb-y0)-xa)) cb from o_boxes))""",
    "o_coverage": f"""
        select z.code, {_COVER} from o_area z left join o_shared s on s.code = z.code
        group by z.code""",
}

ORACLE = {
    "layer_bounds": """
        select kind, min(x0 + case kind when 'c' then 1e0 else 0e0 end) min_x,
          min(y0 + case kind when 'c' then 1e0 else 0e0 end) min_y,
          max(x0 + case kind when 'a' then 3e0 when 'b' then 4e0 else 3e0 end) max_x,
          max(y0 + case kind when 'c' then 3e0 else 4e0 end) max_y
        from fx_zones group by kind""",
    "ring_clean": """
        select p_partkey feature_id, cast(5 as bigint) vertices,
          round((p_size % 5) * case when p_partkey % 2 = 0 then 2e0 else 1e0 end, 6) signed_area
        from part where p_size % 5 <> 0""",
    "polygon_area": "select code, round(area, 6) area from o_area",
    "rasterize_zones": "select row_, col_, code from o_owner",
    "count_change_px": """
        select z.code, count(c.band) changed_px from fx_zones z
          left join o_owner o on o.code = z.code
          left join o_changed c on c.row_ = o.row_ and c.col_ = o.col_ group by z.code""",
    "phi_matrix": "select code, "
    + ", ".join(
        f"round(features_band_{b}_simple_diff, 6) features_band_{b}_simple_diff" for b in BANDS
    )
    + " from o_phi",
    "planning_coverage": "select code, "
    + ", ".join(f"round({n}, 6) {n}" for n in LAYERS)
    + " from o_coverage",
    "clip_layer_area": """
        select code, layer, feature_id, round(square, 6) area from o_boxes
        where kind = 'c' and square > 1e-9""",
    "conservation_overlap": """
        select band, count(*) filter (i) inside, count(*) filter (not i) outside,
          round(100e0 * count(*) filter (i) / count(*), 6) inside_pct
        from (select band, exists (select 1 from fx_planning p where layer='conservation'
            and col_+0.5e0 >= min_x and col_+0.5e0 < max_x
            and row_+0.5e0 >= min_y and row_+0.5e0 < max_y) i from o_changed)
        group by band""",
}
