"""Queries over per-pixel features."""

from pyspark.sql import functions as F

from ..operators import features as ft, focal
from ..oracle.base import around, box, mirror101, sql
from .fixtures import scene, sized
from .registry import query

PX = "raster_id:i row:i col:i "
_GRAY = "(b1 + b2 + b3) / 3.0::DOUBLE"
_K5 = "[" + ", ".join(f"{w!r}" for w in focal.gaussian_kernel(11)) + "]"


def _pixelwise(name, col, expr, duck):
    @query(name, f"{PX}{col}:d6", sql("scene", f"SELECT raster_id, row, col, {duck} AS {col} FROM scene"))
    def run(spark, sf):
        return scene(spark, sf).selectExpr("raster_id", "row", "col", f"{expr} AS {col}")


_pixelwise("gray", "gray", ft.GRAY, _GRAY)
_pixelwise("ndvi", "ndvi", ft.NDVI, "(b4 - b3) / (b4 + b3 + 1e-6)")
_pixelwise(
    "vari", "vari", ft.VARI,
    "greatest(-1, least(1, (b2 - b1) / (CASE WHEN abs(b2 + b1 - b3) < 1e-6 THEN 1e-6 ELSE (b2 + b1 - b3)::DOUBLE END)))",
)
_pixelwise(
    "saturation", "saturation", ft.SATURATION,
    "(greatest(b1, b2, b3) - least(b1, b2, b3)) / (greatest(b1, b2, b3) + 1e-6)",
)


@query("colour_indices", PX + "exg:d6 ndwi:d6 luma:d6", sql(
    "scene", "SELECT raster_id, row, col, 2 * b2 - b1 - b3 AS exg, (b2 - b4) / (b2 + b4 + 1e-6) AS ndwi, "
    "0.299::DOUBLE * b1 + 0.587::DOUBLE * b2 + 0.114::DOUBLE * b3 AS luma FROM scene"))
def colour_indices(spark, sf):
    return scene(spark, sf).selectExpr(
        "raster_id", "row", "col", f"{ft.EXG} AS exg", f"{ft.NDWI} AS ndwi", f"{ft.LUMA} AS luma"
    )


@query("spectral_mean", PX + "mean_b1:d6 mean_b2:d6 mean_b3:d6 mean_b4:d6", sql(
    "scene dims px", "SELECT raster_id, row, col, m1/9 AS mean_b1, m2/9 AS mean_b2, m3/9 AS mean_b3, m4/9 AS mean_b4 FROM sums",
    sums=box("px", {f"m{i}": f"q.b{i}" for i in range(1, 5)}, 3)))
def spectral_mean(spark, sf):
    return ft.spectral_mean(sized(scene(spark, sf)), ["b1", "b2", "b3", "b4"])


_TEXTURE = "sqrt(greatest(0, (9 * t2 - t1 * t1)::DOUBLE / (81 * 9)))"


@query("texture_std", PX + "texture:d6", sql(
    "scene dims px", f"SELECT raster_id, row, col, {_TEXTURE} AS texture FROM sums",
    sums=box("px", {"t1": "q.b1+q.b2+q.b3", "t2": "(q.b1+q.b2+q.b3)*(q.b1+q.b2+q.b3)"}, 3)))
def texture_std(spark, sf):
    return ft.texture_std(sized(scene(spark, sf)))


_DISK2 = "dy*dy + dx*dx <= 4"
_GRAY8_STRETCH = f"CASE WHEN hi > lo THEN CAST(floor(({_GRAY} - lo) / (hi - lo) * 255.0::DOUBLE) AS INT) ELSE 0 END"
ENTROPY_CTES = {
    "g8": f"""SELECT raster_id, row, col, {_GRAY8_STRETCH} AS v FROM scene JOIN (
        SELECT raster_id, min({_GRAY}) AS lo, max({_GRAY}) AS hi FROM scene GROUP BY raster_id) USING (raster_id)""",
    "hist": f"""SELECT p.raster_id, p.row, p.col, q.v, count(*) AS n FROM g8 p, {around(2, 'dy')}, {around(2, 'dx')}
        JOIN g8 q ON q.raster_id = p.raster_id AND q.row = p.row + dy AND q.col = p.col + dx
        WHERE {_DISK2} GROUP BY ALL""",
    "ent": """SELECT raster_id, row, col, -sum(n / t * log2(n / t)) AS entropy FROM (
        SELECT *, sum(n) OVER (PARTITION BY raster_id, row, col)::DOUBLE AS t FROM hist) GROUP BY raster_id, row, col""",
}


@query("local_entropy", PX + "entropy:d6", sql("scene dims px", "SELECT * FROM ent", **ENTROPY_CTES))
def local_entropy(spark, sf):
    return ft.local_entropy(sized(scene(spark, sf)))


ALL_FLAGS = {"spectral": True, "texture": True, "indices": True, "color_indices": True, "entropy": True}
FEATURES = "f_b1 f_b2 f_b3 f_b4 f_texture f_ndvi f_vari f_saturation f_entropy".split()


@query("feature_table", PX + " ".join(f"{f}:d6" for f in FEATURES), sql(
    "scene dims px", f"""SELECT raster_id, row, col, m1/9 AS f_b1, m2/9 AS f_b2, m3/9 AS f_b3, m4/9 AS f_b4,
        {_TEXTURE} AS f_texture, (b4 - b3) / (b4 + b3 + 1e-6) AS f_ndvi,
        greatest(-1, least(1, (b2 - b1) / (CASE WHEN abs(b2 + b1 - b3) < 1e-6 THEN 1e-6 ELSE (b2 + b1 - b3)::DOUBLE END))) AS f_vari,
        (greatest(b1, b2, b3) - least(b1, b2, b3)) / (greatest(b1, b2, b3) + 1e-6) AS f_saturation, entropy AS f_entropy
        FROM scene JOIN sums USING (raster_id, row, col) JOIN ent USING (raster_id, row, col)""",
    sums=box("px", {f"m{i}": f"q.b{i}" for i in range(1, 5)} | {
        "t1": "q.b1+q.b2+q.b3", "t2": "(q.b1+q.b2+q.b3)*(q.b1+q.b2+q.b3)"}, 3), **ENTROPY_CTES))
def feature_table(spark, sf):
    return ft.feature_table(sized(scene(spark, sf)), ALL_FLAGS, ["b1", "b2", "b3", "b4"])


P98_CTE = """SELECT raster_id, greatest(quantile_cont(v, 0.98), 1) AS scale FROM (
    SELECT raster_id, unnest([b1, b2, b3])::DOUBLE AS v FROM scene) GROUP BY raster_id"""


@query("p98_scale", PX + "s1:d6 s2:d6 s3:d6", sql(
    "scene", "SELECT raster_id, row, col, least(1, b1 / scale) AS s1, least(1, b2 / scale) AS s2, least(1, b3 / scale) AS s3 "
    "FROM scene JOIN p98 USING (raster_id)", p98=P98_CTE))
def p98_scale(spark, sf):
    return ft.p98_scale(scene(spark, sf))


EDGE_CTES = {
    "p98": P98_CTE,
    "luma": """SELECT raster_id, row, col, height, width, 0.299::DOUBLE * least(1, b1 / scale) + 0.587::DOUBLE * least(1, b2 / scale)
        + 0.114::DOUBLE * least(1, b3 / scale) AS v FROM px JOIN p98 USING (raster_id)""",
    "grad": """SELECT p.raster_id, p.row, p.col,
        CASE WHEN p.height = 1 THEN 0 WHEN u.v IS NULL THEN d.v - p.v WHEN d.v IS NULL THEN p.v - u.v ELSE (d.v - u.v) / 2 END AS gy,
        CASE WHEN p.width = 1 THEN 0 WHEN l.v IS NULL THEN r.v - p.v WHEN r.v IS NULL THEN p.v - l.v ELSE (r.v - l.v) / 2 END AS gx
        FROM luma p LEFT JOIN luma u ON u.raster_id = p.raster_id AND u.row = p.row - 1 AND u.col = p.col
        LEFT JOIN luma d ON d.raster_id = p.raster_id AND d.row = p.row + 1 AND d.col = p.col
        LEFT JOIN luma l ON l.raster_id = p.raster_id AND l.row = p.row AND l.col = p.col - 1
        LEFT JOIN luma r ON r.raster_id = p.raster_id AND r.row = p.row AND r.col = p.col + 1""",
    "edges": """SELECT raster_id, row, col, m AS magnitude, least(1, m / p95) AS strength, least(1, m / p95) > 0.30 AS edge
        FROM (SELECT *, sqrt(gx * gx + gy * gy) AS m FROM grad) JOIN (
            SELECT raster_id, greatest(quantile_cont(sqrt(gx * gx + gy * gy), 0.95), 1e-6) AS p95 FROM grad GROUP BY raster_id)
        USING (raster_id)""",
}


@query("edge_mask", PX + "magnitude:d6 strength:d6 edge:b", sql("scene dims px", "SELECT * FROM edges", **EDGE_CTES))
def edge_mask(spark, sf):
    px = ft.p98_scale(sized(scene(spark, sf)))
    return ft.gradient_edges(px, "0.299D * s1 + 0.587D * s2 + 0.114D * s3")


HSV_SQL = """SELECT raster_id, row, col, b1, b2, b3, v, CASE WHEN v = 0 THEN 0 ELSE round_even((v - lo) * 255.0::DOUBLE / v, 0)::INT END AS s,
    CASE WHEN v = lo THEN 0 ELSE round_even((CASE WHEN hue < 0 THEN hue + 360 ELSE hue END) / 2, 0)::INT % 180 END AS h
    FROM (SELECT *, CASE WHEN v = lo THEN 0 WHEN v = b1 THEN 60.0::DOUBLE * (b2 - b1 + b1 - b3) / (v - lo)
        WHEN v = b2 THEN 120 + 60.0::DOUBLE * (b3 - b1) / (v - lo) ELSE 240 + 60.0::DOUBLE * (b1 - b2) / (v - lo) END AS hue
      FROM (SELECT *, greatest(b1, b2, b3) AS v, least(b1, b2, b3) AS lo FROM scene))"""


@query("hsv8", PX + "h:i s:i v:i", sql("scene", "SELECT * FROM hsv", hsv=HSV_SQL))
def hsv8(spark, sf):
    return ft.hsv8(scene(spark, sf))


_G8 = "((b1 * 4899 + b2 * 9617 + b3 * 1868 + 8192) // 16384)"
GAUSS_CTES = {
    "gr": f"SELECT raster_id, row, col, height, width, {_G8}::DOUBLE AS g FROM px",
    "gx": f"""SELECT p.raster_id, p.row, p.col, p.height, p.width, sum(k * q.g) AS m1, sum(k * q.g * q.g) AS m2
        FROM gr p, (SELECT unnest(range(-5, 6)) AS dx, unnest({_K5}) AS k)
        JOIN gr q ON q.raster_id = p.raster_id AND q.row = p.row AND q.col = {mirror101('p.col + dx', 'p.width')}
        GROUP BY ALL""",
    "gy": f"""SELECT p.raster_id, p.row, p.col, sum(k * q.m1) AS m1, sum(k * q.m2) AS m2
        FROM gx p, (SELECT unnest(range(-5, 6)) AS dy, unnest({_K5}) AS k)
        JOIN gx q ON q.raster_id = p.raster_id AND q.col = p.col AND q.row = {mirror101('p.row + dy', 'p.height')}
        GROUP BY p.raster_id, p.row, p.col""",
}


@query("gaussian_std", PX + "std:d3", sql(
    "scene dims px", "SELECT raster_id, row, col, sqrt(greatest(m2 - m1 * m1, 0)) AS std FROM gy", **GAUSS_CTES))
def gaussian_std(spark, sf):
    return ft.gaussian_std(sized(scene(spark, sf)))


@query("segment_features", "raster_id:i segment:i mean_b1:d6 mean_b2:d6 mean_b3:d6 mean_b4:d6 gray_std:d6 ndvi:d6", sql(
    "scene", f"""SELECT raster_id, (row // 10) * 10 + col // 10 AS segment, avg(b1) AS mean_b1, avg(b2) AS mean_b2, avg(b3) AS mean_b3,
        avg(b4) AS mean_b4, stddev_pop({_GRAY}) AS gray_std, avg((b4 - b3) / (b4 + b3 + 1e-6)) AS ndvi FROM scene GROUP BY ALL"""))
def segment_features(spark, sf):
    px = scene(spark, sf).withColumn("segment", F.expr("cast((row div 10) * 10 + col div 10 AS int)"))
    return ft.segment_features(px)


@query("superpixels", PX + "segment:l")
def superpixels(spark, sf):
    return ft.superpixels(sized(scene(spark, sf)), n_segments=60, rounds=4)
