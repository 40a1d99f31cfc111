"""Affine transforms, web-mercator formulas and geometry expressions (SQL text)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Fixed value: half the circumference used by the mercator formulas, in metres.
HALF_WORLD = "20037508.34D"


def mercator_x(lon: str) -> str:
    return f"(({lon}) * {HALF_WORLD} / 180.0D)"


def mercator_y(lat: str) -> str:
    return f"(ln(tan((90.0D + ({lat})) * pi() / 360.0D)) * {HALF_WORLD} / pi())"


def longitude(x: str) -> str:
    return f"(({x}) / {HALF_WORLD} * 180.0D)"


def latitude(y: str) -> str:
    return f"(atan(exp(({y}) / {HALF_WORLD} * pi())) * 360.0D / pi() - 90.0D)"


def reproject_parts(parts: str, src: str, dst: str) -> str:
    """Parts with every vertex moved between 4326 and 3857; other pairs stay as they are."""
    def each(fx, fy):
        return f"transform({parts}, p -> transform(p, v -> named_struct('x', {fx('v.x')}, 'y', {fy('v.y')})))"

    return (
        f"CASE WHEN {src} = 4326 AND {dst} = 3857 THEN {each(mercator_x, mercator_y)} "
        f"WHEN {src} = 3857 AND {dst} = 4326 THEN {each(longitude, latitude)} ELSE {parts} END"
    )


def with_bbox(geoms: DataFrame, parts: str = "parts", prefix: str = "") -> DataFrame:
    """Bounding box columns of nested parts."""
    flat = lambda axis: f"transform(flatten({parts}), v -> v.{axis})"
    return geoms.selectExpr(
        "*",
        f"array_min({flat('x')}) AS {prefix}minx", f"array_min({flat('y')}) AS {prefix}miny",
        f"array_max({flat('x')}) AS {prefix}maxx", f"array_max({flat('y')}) AS {prefix}maxy",
    )


def normalize_crs(text: str, epsg: str):
    """Local pseudo-mercator descriptions count as 3857."""
    return F.when(
        F.col(text).startswith("LOCAL_CS") & F.col(text).contains("Pseudo-Mercator"), F.lit(3857)
    ).otherwise(F.col(epsg))


def raster_bounds(meta: DataFrame) -> DataFrame:
    return meta.selectExpr(
        "*", "c AS left", "f + height * e AS bottom", "c + width * a AS right", "f AS top"
    )


def wgs84_bounds(meta: DataFrame) -> DataFrame:
    """West, south, east, north of each raster; geographic rasters keep their bounds."""
    df = raster_bounds(meta)
    pick = lambda col, fn: f"CASE WHEN epsg = 3857 THEN {fn(col)} ELSE {col} END"
    return df.selectExpr(
        "*",
        f"{pick('left', longitude)} AS west", f"{pick('bottom', latitude)} AS south",
        f"{pick('right', longitude)} AS east", f"{pick('top', latitude)} AS north",
    )


def next_pow2(n: str) -> str:
    """Smallest power of two not below an integer."""
    return f"CASE WHEN {n} <= 1 THEN 1 ELSE cast(shiftleft(1, length(bin({n} - 1))) AS int) END"
