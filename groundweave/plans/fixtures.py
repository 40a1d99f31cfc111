"""Test scenes and catalogues derived from the generated tables by integer rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.geo import reproject_parts
from ..functions.palette import preset_classes, preset_rows
from ..session import attach, cut


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _by_zone(values, div: str) -> str:
    """Lookup by zone, in the array spelling of the engine (0-based or 1-based)."""
    if div == "div":
        return "array(" + ", ".join(map(str, values)) + ")[zone]"
    return "([" + ", ".join(map(str, values)) + "])[zone + 1]"


# Base colours per zone: asphalt, concrete, vegetation, dry grass, soil, sand, water.
ZONE_BANDS = {
    "b1": (60, 178, 40, 186, 120, 228, 30),
    "b2": (60, 178, 120, 178, 82, 198, 90),
    "b3": (64, 176, 44, 110, 48, 160, 150),
    "b4": (80, 80, 190, 150, 80, 80, 15),
}
CAR = {"b1": 200, "b2": 40, "b3": 40}


def band_sql(band: str, div: str) -> str:
    """Value of a band, in the integer-division spelling of the engine."""
    base = _by_zone(ZONE_BANDS[band], div)
    value = f"{base} + n"
    if band in CAR:
        shadow = f"({base} + n) {div} 3"
        value = (
            f"CASE WHEN zone = 0 AND mrow % 20 IN (8, 9) AND col % 25 BETWEEN 10 AND 13 THEN {CAR[band]} "
            f"WHEN mrow % 20 >= 16 AND col % 25 < 10 THEN {shadow} ELSE {value} END"
        )
    return f"cast(least(255, greatest(0, {value})) AS int)"


_TABLES: dict[tuple[str, str], DataFrame] = {}


def pixel_table(spark: SparkSession, sf: str) -> DataFrame:
    """The test rasters as a pixel table in the shared folder, written once per application.

    raster_id, row, col, zone, b1..b4, height, width, and the nearest preset class ``label``.
    """
    key = (spark.sparkContext.applicationId, sf)
    if key not in _TABLES:
        e = table(spark, sf, "events").select("event_id", "user_id")
        e = e.selectExpr(
            "event_id div 100 AS mrow",
            "cast(event_id % 100 AS int) AS col",
            "(event_id * 7919 + user_id * 31) % 17 - 8 AS n",
        )
        e = e.selectExpr("*", "cast(((mrow div 20) * 3 + (col div 25) * 5) % 7 AS int) AS zone")
        px = e.selectExpr(
            "cast(mrow div 50 AS int) AS raster_id",
            "cast(mrow % 50 AS int) AS row",
            "col",
            "zone",
            *[f"{band_sql(b, 'div')} AS {b}" for b in ZONE_BANDS],
        )
        px = cut(px.repartition("raster_id", F.expr("row div 512")), "bands")
        px = attach(px, dims(px), ["raster_id"])
        _TABLES[key] = cut(px.selectExpr("*", f"{nearest_class_sql('b1', 'b2', 'b3')} AS label"), "pixels")
    return _TABLES[key]


def scene(spark: SparkSession, sf: str) -> DataFrame:
    """Pixels of the test rasters: raster_id, row, col, zone, b1..b4, height, width."""
    return pixel_table(spark, sf).drop("label")


def dims(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("raster_id").agg(
        (F.max("row") + 1).cast("int").alias("height"), (F.max("col") + 1).cast("int").alias("width")
    )


def sized(pixels: DataFrame) -> DataFrame:
    """Pixels with their raster's height and width."""
    if "height" in pixels.columns:
        return pixels
    return attach(pixels, dims(pixels), ["raster_id"])


def raster_meta(spark: SparkSession, sf: str) -> DataFrame:
    return dims(scene(spark, sf)).selectExpr(
        "raster_id", "width", "height", "4 AS bands", "'uint8' AS dtype", "3857 AS epsg",
        "0.5D AS a", "0D AS b", "1000.0D * raster_id AS c", "0D AS d", "-0.5D AS e", "500000.0D AS f",
    )


def classes(spark: SparkSession) -> DataFrame:
    return preset_classes(spark)


def nearest_class_sql(r: str, g: str, b: str) -> str:
    """1-based index of the nearest preset colour as integer arithmetic on literals.

    |x|^2 is the same for every class, so |c|^2 - 2 x.c decides; the index is packed
    into the low digits, so the least value carries the first nearest class.
    """
    rows = ", ".join(
        f"struct({16 * (cr * cr + cg * cg + cb * cb) + i}, {32 * cr}, {32 * cg}, {32 * cb})"
        for i, _, _, _, cr, cg, cb, _, _ in preset_rows()
    )
    best = f"array_min(transform(array({rows}), c -> c.col1 - c.col2 * p.r - c.col3 * p.g - c.col4 * p.b))"
    return f"cast(pmod(transform(array(named_struct('r', {r}, 'g', {g}, 'b', {b})), p -> {best})[0], 16) AS int)"


def labels13(spark: SparkSession, sf: str) -> DataFrame:
    return pixel_table(spark, sf).select("raster_id", "row", "col", "label")


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Scene pixels with their preset label in one row."""
    return pixel_table(spark, sf)


def geoms(spark: SparkSession, sf: str) -> DataFrame:
    """Vector features in metres: points, lines, triangles and boxes with a hole.

    Pixel-unit anchors keep a quarter offset, so that no edge lies on a pixel border.
    """
    key = (spark.sparkContext.applicationId, f"{sf}#geoms")
    if key in _TABLES:
        return _TABLES[key]
    s = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    s = s.selectExpr(
        "s_suppkey AS feature_id",
        "cast(s_nationkey % 3 AS int) AS layer_idx",
        "s_suppkey % 2 AS rid",
        "element_at(array('point', 'line', 'triangle', 'box'), cast(s_suppkey % 4 + 1 AS int)) AS kind",
        "cast((s_suppkey * 37) % 90 AS double) + 0.25D + CASE WHEN s_suppkey % 7 = 0 THEN 5000D ELSE 0D END AS x0",
        "cast((s_suppkey * 53) % 45 AS double) + 0.25D AS y0",
        "cast(2 + s_suppkey % 8 AS double) AS s",
    )
    at = lambda dx, dy: f"named_struct('x', 1000D*rid + 0.5D*(x0+{dx}), 'y', 500000D - 0.5D*(y0+{dy}))"
    ring = lambda pts: "array(" + ", ".join(at(*p) for p in pts) + ")"
    shapes = {
        "point": [[("0D", "0D")]],
        "line": [[("0D", "0D"), ("s", "s*0.5D"), ("s*1.5D", "s*0.3D")]],
        "triangle": [[("0D", "0D"), ("s", "0D"), ("0D", "s"), ("0D", "0D")]],
        "box": [
            [("0D", "0D"), ("s", "0D"), ("s", "s"), ("0D", "s"), ("0D", "0D")],
            [("s*0.3D", "s*0.3D"), ("s*0.7D", "s*0.3D"), ("s*0.7D", "s*0.7D"), ("s*0.3D", "s*0.7D"), ("s*0.3D", "s*0.3D")],
        ],
    }
    parts = "CASE " + " ".join(
        f"WHEN kind = '{k}' THEN array({', '.join(ring(r) for r in rings)})" for k, rings in shapes.items()
    ) + " END"
    made = s.selectExpr(
        "layer_idx", "feature_id", "kind",
        f"CASE WHEN feature_id % 10 = 9 THEN filter({parts}, p -> false) ELSE {parts} END AS parts",
        "3857 AS epsg",
    )
    _TABLES[key] = cut(made, "geoms")
    return _TABLES[key]


def mixed_geoms(spark: SparkSession, sf: str) -> DataFrame:
    """The features of geoms() with a CRS per layer: degrees, none, metres."""
    return geoms(spark, sf).withColumns({
        "parts": F.expr(f"CASE WHEN layer_idx % 3 = 0 THEN {reproject_parts('parts', '3857', '4326')} ELSE parts END"),
        "epsg": F.expr("CASE layer_idx % 3 WHEN 0 THEN 4326 WHEN 2 THEN 3857 END")})


def layers(spark: SparkSession, sf: str) -> DataFrame:
    """One layer per nation: the keys exercise every colour-resolution path."""
    return table(spark, sf, "nation").selectExpr(
        "cast(n_nationkey AS int) AS layer_idx",
        "concat('layer-', n_nationkey) AS id",
        "CASE n_nationkey % 6 WHEN 1 THEN 'user-b' WHEN 3 THEN 'BM_SAND' ELSE n_name END AS name",
        "CASE n_nationkey % 6 WHEN 0 THEN 'user-1' WHEN 2 THEN 'class-13' ELSE 'none' END AS class_id",
        "CASE WHEN n_nationkey % 6 = 4 THEN n_nationkey * 10 END AS override_r",
        "CASE WHEN n_nationkey % 6 = 4 THEN 20 END AS override_g",
        "CASE WHEN n_nationkey % 6 = 4 THEN 30 END AS override_b",
    )


def user_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Caller-given classes, one per region."""
    return table(spark, sf, "region").selectExpr(
        "cast(r_regionkey + 1 AS int) AS class_idx",
        "concat('user-', r_regionkey + 1) AS id",
        "concat('user-', element_at(array('a','b','c','d','e'), cast(r_regionkey + 1 AS int))) AS name",
        "concat('#', lpad(hex((r_regionkey * 2500000 + 4210752) % 16777216), 6, '0')) AS color",
    )


def rasters(spark: SparkSession, sf: str) -> DataFrame:
    """A metadata-only catalogue of rasters, one per order."""
    return table(spark, sf, "orders").selectExpr(
        "o_orderkey AS raster_id",
        "concat('/in/', o_custkey % 7, '/scene ', o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN '.tif' WHEN 1 THEN '.TIFF' "
        "WHEN 2 THEN '.jpg' WHEN 3 THEN '.png' ELSE '.txt' END) AS path",
        "(o_custkey % 97) * 50.0D AS left",
        "(o_orderkey % 89) * 50.0D AS top",
        "cast(200 + o_orderkey % 300 AS int) AS width",
        "cast(200 + o_custkey % 300 AS int) AS height",
        "cast(3 + o_orderkey % 2 AS int) AS bands",
        "CASE WHEN o_orderkey % 2 = 0 THEN 3857 ELSE 4326 END AS epsg",
    )


def vectors(spark: SparkSession, sf: str, n: int = 6) -> DataFrame:
    """Feature vectors: the first ``n`` components of every embedding."""
    return table(spark, sf, "embeddings").selectExpr(
        "vec_id", f"transform(slice(embedding, 1, {n}), v -> cast(v AS double)) AS x", "label"
    )


def progress(spark: SparkSession, sf: str) -> DataFrame:
    """Progress events: one pipeline task per user group."""
    return table(spark, sf, "events").selectExpr(
        "user_id % 20 AS task_id", "cast(ts AS timestamp) AS ts", "event_id AS seq",
        "CASE event_type WHEN 'view' THEN 'Loading raster' WHEN 'click' THEN 'Feature extraction' "
        "WHEN 'purchase' THEN 'KMeans clustering' WHEN 'signup' THEN 'Pixel assignment' ELSE 'Saving output' END AS phase",
        "cast(cast(floor(value) AS bigint) % 100 AS int) AS done", "100 AS total",
    )


# Score names of a cluster, in the order they are computed.
SCORES = ["veg", "road", "water", "asphalt", "line", "water_conf", "dry", "sand", "grass",
          "gray", "dark_gray", "achro", "warm", "size", "blue_dom"]
SCORE_STEPS = [7, 11, 13, 17, 19, 23, 29, 31, 37, 41, 43, 47, 53, 59, 61]


def clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Models of 13 clusters with colours, counts and scores spread over all rules."""
    p = table(spark, sf, "part").selectExpr("p_partkey AS k", "p_size AS size0")
    return p.selectExpr(
        "k div 13 AS model_id", "cast(k % 13 + 1 AS int) AS cluster",
        "cast((k * 37 + size0 * 5) % 256 AS int) AS r", "cast((k * 73 + size0 * 3) % 256 AS int) AS g",
        "cast(CASE WHEN k % 3 = 0 THEN (k * 37 + size0 * 5 + k % 11) % 256 ELSE (k * 29) % 256 END AS int) AS b",
        "1 + (k * 7919) % 1000 AS pixels",
        *[f"((k * {step} + size0) % 101) / 100.0D AS {name}" for name, step in zip(SCORES, SCORE_STEPS)],
    )
