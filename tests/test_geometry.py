from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from urbanchange.config import Grid
from urbanchange.functions import skew
from urbanchange.operators import maplayers, overlay, raster_stats, reproject, rings, scanfill, zones

RINGS = "array<array<struct<x:double,y:double>>>"


def layer(spark, polygons, name="code"):
    """``polygons``: (code, [ring, ...]) with rings as point lists, burned in order."""
    rows = [(c, i, [[(float(x), float(y)) for x, y in r] for r in rs]) for i, (c, rs) in enumerate(polygons)]
    return spark.createDataFrame(rows, f"{name} string, ord int, rings {RINGS}")


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


def star(rng, cx, cy, n, size):
    angles = np.sort(rng.uniform(0, 2 * math.pi, n))
    radii = rng.uniform(0.3, 1, n) * size
    return [(cx + r * math.cos(a), cy + r * math.sin(a)) for a, r in zip(angles, radii)]


def inside(ring_list, x, y):
    odd = False
    for ring in ring_list:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                odd = not odd
    return odd


def clip_convex(subject, clip):
    """Area of a polygon cut by a convex counter-clockwise polygon."""
    out = list(subject)
    for (ax, ay), (bx, by) in zip(clip, clip[1:] + clip[:1]):
        side = lambda p: (bx - ax) * (p[1] - ay) - (by - ay) * (p[0] - ax)  # noqa: B023, E731
        points, out = out, []
        for p, q in zip(points, points[1:] + points[:1]):
            sp, sq = side(p), side(q)
            if sp >= 0:
                out.append(p)
            if sp * sq < 0:
                t = sp / (sp - sq)
                out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
        if not out:
            return 0.0
    return area(out)


def area(ring):
    return sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1])) / 2


def test_change_density_of_two_halves(spark):
    """Changed pixels counted once per zone, divided by the zone's area in square metres."""
    grid = Grid(10, 10, 0.0, 100.0, 10.0, -10.0)
    halves = layer(spark, [("LEFT", [box(0, 0, 50, 100)]), ("RIGHT", [box(50, 0, 100, 100)])])
    hits = [(1, 0, c, 1) for c in (0, 1, 2, 5, 6)]
    changes = spark.createDataFrame(hits, "band int, row_ int, col_ int, changed int")
    got = zones.feature_matrix(changes, halves, grid, [1], "m").collect()
    got = {r["code"]: r["features_band_1_m"] for r in got}
    assert got == {"LEFT": pytest.approx(3 / 5000 * 100), "RIGHT": pytest.approx(2 / 5000 * 100)}
    owners = scanfill.rasterize_zones(halves, grid)
    assert owners.count() == 100
    counted = {r[0]: r[1] for r in zones.count_changed(changes, owners, halves).collect()}
    assert counted == {"LEFT": 3, "RIGHT": 2}
    assert zones.feature_matrix(changes, halves, grid, []).columns == ["code"]


@pytest.mark.parametrize("dy", [1.0, -1.0])
def test_scanfill_like_point_in_polygon(spark, dy):
    rng = np.random.default_rng(0)
    shapes = [
        ("S", [star(rng, 10, 9, 15, 9.7)]),
        ("H", [box(2.2, 1.3, 17.7, 16.6), box(5.1, 5.2, 11.4, 9.9)]),
        ("OUT", [box(-9.5, -9.5, 3.3, 40.5)]),
        ("S", [star(rng, 25, 9, 9, 4.1)]),
    ]
    grid = Grid(22, 18, 0.0, 0.0 if dy > 0 else 18.0, 1.0, dy)
    got = scanfill.covered_cells(layer(spark, shapes), ["code", "ord"], grid).collect()
    got = {(r["ord"], r["row_"], r["col_"]) for r in got}
    want = {
        (k, r, c)
        for k, (_, rs) in enumerate(shapes)
        for r in range(18)
        for c in range(22)
        if inside(rs, c + 0.5, grid.y0 + (r + 0.5) * dy)
    }
    assert got == want


def test_last_zone_wins_but_statistics_count_twice(spark):
    grid = Grid(4, 4)
    z = layer(spark, [("A", [box(0, 0, 4, 4)]), ("B", [box(1, 1, 3, 3)]), ("E", [box(9, 9, 10, 10)])])
    owner = {(r["row_"], r["col_"]): r["code"] for r in scanfill.rasterize_zones(z, grid).collect()}
    assert owner[1, 1] == "B" and owner[0, 0] == "A" and len(owner) == 16
    values = [(r, c, None if (r, c) == (0, 0) else float(4 * r + c)) for r in range(4) for c in range(4)]
    pixels = spark.createDataFrame(values, "row_ int, col_ int, value double")
    for hot_rows in (10**6, 2):
        stats = raster_stats.zonal_statistics(z, pixels, grid, hot_rows=hot_rows).collect()
        stats = {r["code"]: r for r in stats}
        assert stats["A"]["count"] == 15 and stats["B"]["count"] == 4 and stats["E"]["count"] == 0
        assert stats["A"]["mean"] == pytest.approx(120 / 15) and stats["A"]["median"] == 8
        assert stats["B"]["median"] == 7.5 and stats["E"]["mean"] is None
    only = raster_stats.zonal_statistics(z, pixels, grid, stats=("count", "max"))
    assert only.columns == ["code", "count", "max"]


def test_clean_rings(spark):
    z = layer(
        spark,
        [
            ("CW", [box(0, 0, 2, 2)[::-1], box(0.5, 0.5, 1, 1)]),
            ("DUP", [[(0, 0), (0, 0), (4, 0), (4, 0), (4, 4), (0, 0)]]),
            ("LINE", [[(0, 0), (1, 1), (2, 2)]]),
            ("NOHOLE", [box(0, 0, 2, 2), [(0.1, 0.1), (0.2, 0.2)]]),
        ],
    )
    got = {r["code"]: r["rings"] for r in rings.clean_rings(z).collect()}
    assert set(got) == {"CW", "DUP", "NOHOLE"}
    assert area([tuple(p) for p in got["CW"][0]][:-1]) == 4
    assert area([tuple(p) for p in got["CW"][1]][:-1]) == -0.25
    assert len(got["DUP"][0]) == 4 and len(got["NOHOLE"]) == 1
    areas = {r["code"]: r["area"] for r in rings.polygon_area(z).collect()}
    assert areas["CW"] == 3.75 and areas["DUP"] == 8 and areas["LINE"] == 0


@pytest.mark.parametrize("size", [None, 1.7, 50.0])
def test_intersection_areas(spark, size):
    rng = np.random.default_rng(1)
    stars = [(f"S{i}", star(rng, *rng.uniform(0, 20, 2), 12, rng.uniform(1, 6))) for i in range(8)]
    boxes = [(f"B{i}", box(x, y, x + w, y + h)) for i, (x, y, w, h) in enumerate(rng.uniform(1, 9, (6, 4)))]
    turned = [(n, [(0.8 * x - 0.6 * y, 0.6 * x + 0.8 * y) for x, y in b]) for n, b in boxes]
    features = boxes + [("T" + n, b) for n, b in turned]
    a = layer(spark, [(n, [s if i % 2 else s[::-1]]) for i, (n, s) in enumerate(stars)])
    b = layer(spark, [(n, [p]) for n, p in features], "feature_id").withColumn("layer", F.lit("L"))
    got = overlay.intersection_areas(a, b, ["code"], ["layer", "feature_id"], size, hot_rows=3)
    got = {(r["code"], r["feature_id"]): r["area"] for r in got.collect()}
    for n, s in stars:
        for m, p in features:
            assert got.get((n, m), 0.0) == pytest.approx(clip_convex(s, p), abs=1e-9)


def test_intersection_with_holes_and_coverage(spark):
    a = layer(spark, [("A", [box(0, 0, 10, 10), box(2, 2, 8, 8)]), ("FAR", [box(90, 90, 91, 91)])])
    p = layer(spark, [("1", [box(0, 0, 5, 5)]), ("2", [box(0, 0, 5, 5), box(1, 1, 2, 2)])], "feature_id")
    p = p.withColumn("layer", F.lit("town"))
    got = overlay.planning_coverage(a, p, ["town", "park"]).collect()
    got = {r["code"]: r for r in got}
    want = (25 - 9) + (25 - 9 - 1)
    assert got["A"]["town"] == pytest.approx(want / 64 * 100)
    assert got["A"]["park"] == 0 and got["FAR"]["town"] == 0


def test_ordnance_survey_worked_example(spark):
    """Published example: 52 39 27.2531 N, 1 43 4.5177 E is E 651409.903, N 313177.270."""
    p = reproject.PROJECTIONS["EPSG:27700"]
    lat = 52 + 39 / 60 + 27.2531 / 3600
    lon = 1 + 43 / 60 + 4.5177 / 3600
    df = spark.createDataFrame([(lon, lat)], "x double, y double")
    east, north = reproject.project(F.col("x"), F.col("y"), p)
    row = df.select(east.alias("e"), north.alias("n")).first()
    assert row["e"] == pytest.approx(651409.903, abs=2e-3)
    assert row["n"] == pytest.approx(313177.270, abs=2e-3)
    back = reproject.unproject(F.lit(row["e"]), F.lit(row["n"]), p)
    got = df.select(back[0].alias("x"), back[1].alias("y")).first()
    assert got["x"] == pytest.approx(lon, abs=1e-10) and got["y"] == pytest.approx(lat, abs=1e-10)


def test_utm_meridian_and_round_trips(spark):
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    e2 = f * (2 - f)
    phi = np.linspace(0, math.radians(51.5), 400001)
    integrand = a * (1 - e2) / (1 - e2 * np.sin(phi) ** 2) ** 1.5
    arc = np.sum((integrand[1:] + integrand[:-1]) / 2 * np.diff(phi))
    df = spark.createDataFrame([(-3.0, 51.5), (-0.1, 51.4), (0.3, 51.7)], "x double, y double")
    utm = reproject.reproject_vertices(df, "EPSG:4326", "EPSG:32630").collect()
    assert utm[0]["x"] == pytest.approx(500000, abs=1e-6)
    assert utm[0]["y"] == pytest.approx(k0 * arc, abs=1e-3)
    there = reproject.reproject_vertices(df, "EPSG:4326", "EPSG:32630")
    back = reproject.reproject_vertices(there, "EPSG:32630", "EPSG:4326").collect()
    grid = reproject.reproject_vertices(df, "EPSG:32630", "EPSG:32630").collect()
    for r, s in zip(df.collect(), back):
        assert s["x"] == pytest.approx(r["x"], abs=1e-9) and s["y"] == pytest.approx(r["y"], abs=1e-9)
    assert grid == df.collect()
    with pytest.raises(ValueError):
        reproject.reproject_vertices(df, "EPSG:4326", "EPSG:9999")


def test_datum_shift_is_metre_level(spark):
    """Greenwich observatory area: WGS84 -0.0015, 51.4779 lies near E 538884, N 177322."""
    df = spark.createDataFrame([(-0.0015, 51.4779)], "x double, y double")
    row = reproject.reproject_vertices(df, "EPSG:4326", "EPSG:27700").first()
    assert abs(row["x"] - 538884) < 60 and abs(row["y"] - 177322) < 60
    there = reproject.reproject_vertices(df, "EPSG:4326", "EPSG:27700")
    back = reproject.reproject_vertices(there, "EPSG:27700", "EPSG:4326").first()
    assert back["x"] == pytest.approx(-0.0015, abs=1e-5)
    z = layer(spark, [("A", [[(-0.0015, 51.4779), (0.1, 51.5), (0.0, 51.6)]])])
    rings_ = reproject.reproject_layer(z, "EPSG:4326", "EPSG:27700").first()["rings"]
    assert rings_[0][0]["x"] == pytest.approx(row["x"]) and len(rings_[0]) == 3


def test_map_layers(spark):
    grid = Grid(4, 2, 100.0, 50.0, 10.0, -10.0)
    changes = spark.createDataFrame([(1, 0, 0, 1), (1, 1, 3, 1), (1, 0, 1, 0)], "band int, row_ int, col_ int, changed int")
    points = [(r["x"], r["y"]) for r in maplayers.change_points(changes, grid).collect()]
    assert sorted(points) == [(105.0, 45.0), (135.0, 35.0)]
    extent = layer(spark, [("A", [box(100, 30, 140, 50)])])
    protected = layer(spark, [("P", [box(100, 40, 120, 50)])], "feature_id")
    row = maplayers.protected_overlap(changes, protected, extent, grid).first()
    assert (row["inside"], row["outside"], row["inside_pct"]) == (1, 1, 50.0)


def test_pairs_of_areas_over_many_tasks(spark, monkeypatch):
    """Tasks grow with the pairs, although their bytes would fit one; hot polygons are salted."""
    monkeypatch.setattr(skew, "TASK_ROWS", 20, raising=False)
    a = layer(spark, [(f"Z{i}", [box(i % 10, i // 10, i % 10 + 1.5, i // 10 + 1.5)]) for i in range(100)])
    b = layer(spark, [("ALL", [box(0, 0, 20, 20)])] + [(f"F{i}", [box(i, i, i + 2, i + 2)]) for i in range(9)], "feature_id")
    for hot_rows in (10**6, 10):
        got = overlay.intersection_areas(a, b.withColumn("layer", F.lit("L")), ["code"], ["layer", "feature_id"], 4.0, hot_rows)
        rows = got.withColumn("task", F.spark_partition_id()).collect()
        assert len({r["task"] for r in rows}) > 5
        areas = {(r["code"], r["feature_id"]): r["area"] for r in rows}
        assert all(areas[f"Z{i}", "ALL"] == pytest.approx(2.25) for i in range(100))
        for i in range(100):
            for f in range(9):
                sides = [max(0.0, min(c + 1.5, f + 2) - max(c, f)) for c in (i % 10, i // 10)]
                assert areas.get((f"Z{i}", f"F{f}"), 0.0) == pytest.approx(sides[0] * sides[1])
