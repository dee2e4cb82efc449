"""Reprojection of vertices with transverse-Mercator series as column expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Projection:
    """Ellipsoid and transverse-Mercator parameters of a projected CRS."""

    a: float
    inv_f: float
    k0: float
    lon0: float
    lat0: float
    fe: float
    fn: float
    datum: str


# Published parameters of the two projected systems in use, and of the
# datum shift from WGS84 to OSGB36 (metres, arc seconds, ppm).
PROJECTIONS = {
    "EPSG:32630": Projection(
        6378137.0, 298.257223563, 0.9996, -3.0, 0.0, 500000.0, 0.0, "WGS84"
    ),
    "EPSG:27700": Projection(
        6377563.396, 299.3249646, 0.9996012717, -2.0, 49.0, 400000.0, -100000.0, "OSGB36"
    ),
}
WGS84 = (6378137.0, 298.257223563)
TO_OSGB36 = (-446.448, 125.157, -542.060, -0.1502, -0.2470, -0.8421, 20.4894)


def _series(p: Projection):
    f = 1.0 / p.inv_f
    n = f / (2.0 - f)
    scale = p.a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    forward = (
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
        61 * n**3 / 240 - 103 * n**4 / 140,
        49561 * n**4 / 161280,
    )
    backward = (
        n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360,
        n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440,
        17 * n**3 / 480 - 37 * n**4 / 840,
        4397 * n**4 / 161280,
    )
    return math.sqrt(f * (2.0 - f)), scale, forward, backward


def _meridian_offset(p: Projection) -> float:
    """Northing of the latitude of origin, from the same series."""
    e, scale, forward, _ = _series(p)
    lat = math.radians(p.lat0)
    t = math.sinh(math.atanh(math.sin(lat)) - e * math.atanh(e * math.sin(lat)))
    xi = math.atan(t)
    return p.k0 * scale * (xi + sum(c * math.sin(2 * (j + 1) * xi) for j, c in enumerate(forward)))


def project(lon: Column, lat: Column, p: Projection) -> tuple[Column, Column]:
    """Degrees on the projection's own datum to easting and northing."""
    e, scale, forward, _ = _series(p)
    phi, dlon = F.radians(lat), F.radians(lon - p.lon0)
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(dlon)), F.atanh(F.sin(dlon) / F.sqrt(1.0 + t * t))
    north, east = xi, eta
    for j, c in enumerate(forward):
        k = 2.0 * (j + 1)
        north = north + c * F.sin(k * xi) * F.cosh(k * eta)
        east = east + c * F.cos(k * xi) * F.sinh(k * eta)
    return (
        p.fe + p.k0 * scale * east,
        p.fn - _meridian_offset(p) + p.k0 * scale * north,
    )


def unproject(x: Column, y: Column, p: Projection) -> tuple[Column, Column]:
    """Easting and northing to degrees on the projection's own datum."""
    e, scale, _, backward = _series(p)
    xi = (y - p.fn + _meridian_offset(p)) / (p.k0 * scale)
    eta = (x - p.fe) / (p.k0 * scale)
    xi1, eta1 = xi, eta
    for j, c in enumerate(backward):
        k = 2.0 * (j + 1)
        xi1 = xi1 - c * F.sin(k * xi) * F.cosh(k * eta)
        eta1 = eta1 - c * F.cos(k * xi) * F.sinh(k * eta)
    tau1 = F.sin(xi1) / F.sqrt(F.pow(F.sinh(eta1), 2.0) + F.pow(F.cos(xi1), 2.0))
    # Conformal to geodetic latitude by fixed-point iteration on asinh(tan).
    target = F.asinh(tau1)
    psi = target
    for _ in range(5):
        psi = target + e * F.atanh(e * F.tanh(psi))
    lat = F.degrees(F.atan(F.sinh(psi)))
    lon = p.lon0 + F.degrees(F.atan2(F.sinh(eta1), F.cos(xi1)))
    return lon, lat


def _cartesian(lon: Column, lat: Column, a: float, inv_f: float):
    e2 = (2.0 - 1.0 / inv_f) / inv_f
    phi, lam = F.radians(lat), F.radians(lon)
    nu = a / F.sqrt(1.0 - e2 * F.pow(F.sin(phi), 2.0))
    return (
        nu * F.cos(phi) * F.cos(lam),
        nu * F.cos(phi) * F.sin(lam),
        nu * (1.0 - e2) * F.sin(phi),
    )


def _geodetic(x: Column, y: Column, z: Column, a: float, inv_f: float):
    e2 = (2.0 - 1.0 / inv_f) / inv_f
    b = a * (1.0 - 1.0 / inv_f)
    p = F.sqrt(x * x + y * y)
    theta = F.atan2(z * a, p * b)
    lat = F.atan2(
        z + e2 / (1.0 - e2) * b * F.pow(F.sin(theta), 3.0),
        p - e2 * a * F.pow(F.cos(theta), 3.0),
    )
    return F.degrees(F.atan2(y, x)), F.degrees(lat)


def _shift(lon: Column, lat: Column, source, target, sign: float):
    """Seven-parameter shift between two ellipsoids; accurate to a few metres."""
    tx, ty, tz, rx, ry, rz, ppm = (sign * v for v in TO_OSGB36)
    rx, ry, rz = (math.radians(r / 3600.0) for r in (rx, ry, rz))
    m = 1.0 + ppm * 1e-6
    x, y, z = _cartesian(lon, lat, *source)
    return _geodetic(
        tx + m * x - rz * y + ry * z,
        ty + rz * x + m * y - rx * z,
        tz - ry * x + rx * y + m * z,
        *target,
    )


def _steps(source: str, target: str):
    """Coordinate steps from one CRS to the other, each a function of two columns."""
    for crs in (source, target):
        if crs != "EPSG:4326" and crs not in PROJECTIONS:
            raise ValueError(f"unknown CRS {crs!r}")
    if source == target:
        return []
    before, after = PROJECTIONS.get(source), PROJECTIONS.get(target)
    osgb = (PROJECTIONS["EPSG:27700"].a, PROJECTIONS["EPSG:27700"].inv_f)
    datums = (before.datum if before else "WGS84", after.datum if after else "WGS84")
    steps = []
    if before:
        steps.append(lambda a, b: unproject(a, b, before))
    if datums == ("WGS84", "OSGB36"):
        steps.append(lambda a, b: _shift(a, b, WGS84, osgb, 1.0))
    elif datums == ("OSGB36", "WGS84"):
        steps.append(lambda a, b: _shift(a, b, osgb, WGS84, -1.0))
    if after:
        steps.append(lambda a, b: project(a, b, after))
    return steps


def reproject_vertices(
    df: DataFrame, source: str, target: str, x: str = "x", y: str = "y"
) -> DataFrame:
    """Replace ``x``, ``y`` of a vertex table by coordinates in ``target``.

    EPSG:4326, 32630 and 27700 are known. Row-wise expressions only: no shuffle.
    """
    for step in _steps(source, target):
        east, north = step(F.col(x).cast("double"), F.col(y).cast("double"))
        df = df.withColumns({x: east, y: north})
    return df


def moved_rings(rings: Column, source: str, target: str) -> Column:
    """Rings of one polygon in another CRS, vertex order kept."""

    def moved(step):
        def point(p: Column) -> Column:
            east, north = step(p["x"], p["y"])
            return F.struct(east.alias("x"), north.alias("y"))

        return lambda ring: F.transform(ring, point)

    for step in _steps(source, target):
        rings = F.transform(rings, moved(step))
    return rings


def reproject_layer(df: DataFrame, source: str, target: str) -> DataFrame:
    """The same for the ``rings`` of a polygon layer, vertex order kept, without a shuffle."""
    df = df.withColumn("rings", moved_rings(F.col("rings"), source, target))
    return df.withColumn("crs", F.lit(target)) if "crs" in df.columns else df


def in_crs(layer: DataFrame, target: str | None) -> DataFrame:
    """A layer whose rows name their ``crs``, in the CRS of a raster; an unknown one is an error.

    A layer without that column is taken to be in the raster's CRS, and so are rows that leave it
    null. A raster without a CRS (``target`` None) moves nothing.
    """
    if "crs" not in layer.columns or target is None:
        return layer
    known = ["EPSG:4326", *PROJECTIONS]
    _steps(target, target)  # refuse an unknown target
    bad = F.raise_error(F.concat(F.lit("unknown CRS "), F.col("crs"))).cast(layer.schema["rings"].dataType)
    rings = F.when(F.col("crs").isNull() | (F.col("crs") == target), F.col("rings"))
    for source in known:
        if source != target:
            rings = rings.when(F.col("crs") == source, moved_rings(F.col("rings"), source, target))
    return layer.withColumn("rings", rings.otherwise(bad)).withColumn("crs", F.lit(target))
