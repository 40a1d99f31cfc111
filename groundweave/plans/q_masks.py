"""Queries over feature masks."""

from pyspark.sql import functions as F

from ..functions import palette as pal
from ..operators import grid, masks as mk, runs as rn
from ..oracle.base import boxes, components, dilate, erode, sql
from ..session import attach, bounded
from .fixtures import classes, labels13, labelled, raster_meta, scene, sized
from .q_features import GAUSS_CTES, HSV_SQL
from .q_postproc import LAB, MASK, lab, road_mask
from .q_vectors import classified
from .registry import ORACLES, query

PX = "raster_id:i row:i col:i "
DEPS = "scene dims px"


def _fp(footprint):
    """A footprint as offsets, for the generic SQL (cells reached by (dy, dx))."""
    return " UNION ALL ".join(f"SELECT {dy} AS dy, unnest(range({-l}, {r} + 1)) AS dx" for dy, (l, r) in footprint.items())


def _dil(mask, fp):
    return f"""SELECT DISTINCT m.raster_id, m.row - dy AS row, m.col - dx AS col FROM {mask} m JOIN dims d USING (raster_id), ({_fp(fp)})
        WHERE m.row - dy BETWEEN 0 AND height - 1 AND m.col - dx BETWEEN 0 AND width - 1"""


def _ero(mask, fp):
    n = sum(l + r + 1 for l, r in fp.values())
    return f"""SELECT p.raster_id, p.row, p.col FROM px p, ({_fp(fp)}) LEFT JOIN {mask} q ON q.raster_id = p.raster_id AND q.row = p.row + dy AND q.col = p.col + dx
        GROUP BY p.raster_id, p.row, p.col HAVING count(q.row) + count(*) FILTER (WHERE p.row + dy NOT BETWEEN 0 AND p.height - 1 OR p.col + dx NOT BETWEEN 0 AND p.width - 1) = {n}"""


def _clean(name, src, open_fp, close_fp):
    return {f"{name}e": _ero(src, open_fp), f"{name}o": _dil(f"{name}e", open_fp), f"{name}d": _dil(f"{name}o", close_fp), f"{name}c": _ero(f"{name}d", close_fp)}


def _filled(mask, out):
    back = f"{out}_back"
    return {back: f"SELECT raster_id, row, col FROM px EXCEPT SELECT raster_id, row, col FROM {mask}", **components(back),
        out: f"""SELECT raster_id, row, col FROM {mask} UNION SELECT b.raster_id, b.row, b.col FROM {back}_cc b JOIN (
            SELECT c.raster_id, comp FROM {back}_cc c JOIN dims USING (raster_id) GROUP BY c.raster_id, comp
            HAVING NOT bool_or(row = 0 OR row = height - 1 OR col = 0 OR col = width - 1)) USING (raster_id, comp)"""}


def _areas(mask):
    """Contour area by 2x2 blocks of pixels."""
    return {f"{mask}_area": f"""SELECT raster_id, comp, sum(CASE n WHEN 4 THEN 1 WHEN 3 THEN 0.5 ELSE 0 END) AS contour_area FROM (
        SELECT raster_id, comp, row - dy AS qr, col - dx AS qc, count(*) AS n FROM {mask}_cc, (SELECT unnest([0, 1]) AS dy), (SELECT unnest([0, 1]) AS dx) GROUP BY ALL) GROUP BY ALL"""}


# Hull by support lines: a directed pair of end pixels with no other on its right is an edge of it.
def _hulls(mask):
    return {
        "ends": f"SELECT raster_id, comp, row AS y, unnest([min(col), max(col)]) AS x FROM {mask}_cc GROUP BY raster_id, comp, row",
        "pts": "SELECT DISTINCT raster_id, comp, x, y FROM ends",
        "sides": """SELECT p.raster_id, p.comp, p.x AS px, p.y AS py, q.x AS qx, q.y AS qy FROM pts p JOIN pts q ON p.raster_id = q.raster_id AND p.comp = q.comp AND (p.x, p.y) <> (q.x, q.y)
        WHERE NOT EXISTS (SELECT 1 FROM pts o WHERE o.raster_id = p.raster_id AND o.comp = p.comp AND ((q.x - p.x) * (o.y - p.y) - (q.y - p.y) * (o.x - p.x) < 0
            OR (q.x - p.x) * (o.y - p.y) = (q.y - p.y) * (o.x - p.x) AND (o.x - p.x) * (o.x - q.x) + (o.y - p.y) * (o.y - q.y) > 0))""",
        "hulls": "SELECT raster_id, comp, sum(px * qy - qx * py) / 2 AS hull_area FROM sides GROUP BY raster_id, comp",
    }


def _shapes(mask):
    """Box, contour and hull of every 8-connected component of a mask without holes."""
    return {**components(mask, 8), f"{mask}_box": boxes(mask), **_areas(mask), **_hulls(mask),
        "shapes": f"""SELECT b.raster_id, b.comp, area, contour_area, coalesce(hull_area, 0) AS hull_area, CASE WHEN hull_area > 0 THEN contour_area / hull_area ELSE 0 END AS solidity,
            contour_area / (bw * bh) AS extent, greatest(bw, bh) / least(bw, bh) AS aspect, r0, c0 AS q0 FROM {mask}_box b JOIN {mask}_area USING (raster_id, comp) LEFT JOIN hulls USING (raster_id, comp)"""}


def _duck(text):
    import re
    return re.sub(r"(\S+) \* 3 div 10", r"(\1 * 3 // 10)", text)


def _detector(where, open_fp, close_fp, least, share):
    return {"hsv": HSV_SQL, "m0": f"SELECT raster_id, row, col FROM hsv WHERE {where}", **_clean("m", "m0", open_fp, close_fp), **_filled("mc", "mf"),
        **components("mf", 8), **_areas("mf"),
        "found": f"SELECT c.raster_id, c.row, c.col FROM mf_cc c JOIN mf_area a USING (raster_id, comp) JOIN dims USING (raster_id) WHERE contour_area >= greatest({least}, height * width * {share})"}


@query("detect_trees", PX, sql(DEPS, "SELECT * FROM found", **_detector(mk.TREE, rn.ellipse(3), rn.ellipse(11), 400, 0.002)))
def detect_trees(spark, sf):
    return mk.detect_tiled(sized(scene(spark, sf)), mk.detect_trees)


@query("detect_fields", PX, sql(DEPS, "SELECT * FROM found", **_detector(mk.FIELD, rn.ellipse(5), rn.rect(15), 800, 0.005)))
def detect_fields(spark, sf):
    return mk.detect_tiled(sized(scene(spark, sf)), mk.detect_fields)


@query("detect_buildings", PX, sql(DEPS, "SELECT * FROM found", hsv=HSV_SQL, m0=f"SELECT raster_id, row, col FROM hsv WHERE {mk.BUILDING}", **_clean("m", "m0", rn.ellipse(3), rn.rect(9)),
    **_filled("mc", "mf"), **_shapes("mf"), found="""SELECT c.raster_id, c.row, c.col FROM mf_cc c JOIN shapes s USING (raster_id, comp) JOIN dims USING (raster_id)
        WHERE contour_area >= greatest(300, height * width * 0.0015) AND contour_area <= height * width * 0.35 AND hull_area > 0 AND solidity >= 0.55 AND aspect <= 7 AND extent >= 0.35"""))
def detect_buildings(spark, sf):
    return mk.detect_tiled(sized(scene(spark, sf)), mk.detect_buildings)


_BR = "((b1 + b2 + b3) // 3)"


@query("detect_water", PX, sql(DEPS, "SELECT * FROM found", **GAUSS_CTES, hsv=HSV_SQL,
    wp=f"SELECT *, {_BR} AS br FROM hsv JOIN (SELECT raster_id, row, col, round(sqrt(greatest(m2 - m1 * m1, 0)), 9) AS std FROM gy) USING (raster_id, row, col)",
    m0=f"SELECT raster_id, row, col FROM wp WHERE {_duck(mk.WATER)}", valid=f"SELECT raster_id, row, col FROM scene WHERE {_BR} > 5",
    **_clean("m", "m0", rn.ellipse(3), rn.ellipse(21)), mv="SELECT * FROM mc INTERSECT SELECT * FROM valid", mx=_dil("mv", rn.ellipse(3)), my="SELECT * FROM mx INTERSECT SELECT * FROM valid",
    **_filled("my", "mf"), **components("mf", 8), **_areas("mf"),
    mean="SELECT c.raster_id, c.comp, avg(b1) AS r, avg(b2) AS g, avg(b3) AS b FROM mf_cc c JOIN scene USING (raster_id, row, col) GROUP BY ALL",
    found="""SELECT c.raster_id, c.row, c.col FROM mf_cc c JOIN mf_area a USING (raster_id, comp) JOIN mean USING (raster_id, comp) JOIN dims USING (raster_id)
        WHERE contour_area >= greatest(200, height * width * 0.001) AND contour_area <= height * width * 0.95
        AND NOT (contour_area < height * width * 0.01 AND ((r > b + 30 AND r > g + 20) OR (r > 200 AND g > 200 AND b > 200)))"""))
def detect_water(spark, sf):
    return mk.detect_tiled(sized(scene(spark, sf)), mk.detect_water)


@query("fill_holes", PX, sql(LAB, "SELECT * FROM filled", **MASK, **_filled("mask", "filled")))
def fill_holes(spark, sf):
    runs, d = road_mask(spark, sf)
    return rn.pixels_of(rn.fill_holes(runs, d))


@query("component_shape", "raster_id:i area:l contour_area:d6 hull_area:d6 solidity:d6 extent:d6 aspect:d6 r0:i q0:i", sql(LAB, "SELECT * FROM shapes", **MASK, **_filled("mask", "filled"), **_shapes("filled")))
def component_shape(spark, sf):
    runs, d = road_mask(spark, sf)
    return mk.component_shape(rn.components(rn.fill_holes(runs, d), connectivity=8))


_SETS = {"a": "SELECT raster_id, row, col FROM lab WHERE label IN (1, 8) AND (row * 7 + col * 3) % 11 <> 0", "b": "SELECT raster_id, row, col FROM lab WHERE label = 13 OR col % 10 = 3"}


# Rasters whose both masks are empty keep a row: every third raster is left out of the masks to have some.
_MERGED = "SELECT * FROM a WHERE raster_id % 3 <> 1 UNION SELECT * FROM b WHERE raster_id % 3 <> 1"


@query("union_masks", PX + "empty:b", sql(LAB, "SELECT raster_id, row, col, row IS NULL AS empty FROM dims LEFT JOIN (SELECT raster_id, row, col FROM merged) USING (raster_id)", **_SETS, merged=_MERGED))
def union_masks(spark, sf):
    runs, d = road_mask(spark, sf)
    other = rn.runs_of(lab(spark, sf).where("label = 13 OR col % 10 = 3"))
    return mk.union_masks(runs.where("raster_id % 3 <> 1"), other.where("raster_id % 3 <> 1"), d)


@query("mask_close_ellipse", PX, sql(LAB, "SELECT * FROM mc", **MASK, md=_dil("mask", rn.ellipse(15)), mc=_ero("md", rn.ellipse(15))))
def mask_close_ellipse(spark, sf):
    runs, d = road_mask(spark, sf)
    return rn.pixels_of(mk.close_mask(runs, d))


@query("extend_borders", PX, sql(LAB, """SELECT * FROM mask UNION SELECT raster_id, row, col FROM md JOIN (SELECT *, least(60, least(height, width) // 6) AS z FROM dims) USING (raster_id)
    WHERE row < z OR row >= height - z OR col < z OR col >= width - z""", **MASK, md=_dil("mask", rn.ellipse(20))))
def extend_borders(spark, sf):
    runs, d = road_mask(spark, sf)
    return rn.pixels_of(mk.extend_borders(runs, d))


@query("colourise_mask", PX + "r:i g:i b:i", sql(LAB, """SELECT s.raster_id, s.row, s.col, CASE WHEN m.row IS NULL THEN 0 ELSE 45 END AS r,
    CASE WHEN m.row IS NULL THEN 0 ELSE 45 END AS g, CASE WHEN m.row IS NULL THEN 0 ELSE 48 END AS b FROM scene s LEFT JOIN mask m ON m.raster_id = s.raster_id AND m.row = s.row AND m.col = s.col""", **MASK))
def colourise_mask(spark, sf):
    runs, _ = road_mask(spark, sf)
    return mk.colourise(scene(spark, sf), rn.pixels_of(runs), (45, 45, 48))


def ordered_masks(spark, sf):
    """Road, water and stripe masks in painting order."""
    px = labelled(spark, sf)
    def part(where, order, rgb):
        return px.where(where).selectExpr("raster_id", "row", "col", f"{order} AS mask_order", *[f"{v} AS {c}" for c, v in zip("rgb", rgb)])
    road = part("label IN (1, 8) AND (row * 7 + col * 3) % 11 <> 0", 0, (45, 45, 48))
    return road.unionByName(part("label = 13", 1, (28, 107, 160))).unionByName(part("col % 10 = 3", 2, (124, 252, 0)))


_RGB = "JOIN classes c ON c.class_idx = l.label"


@query("merge_feature_masks", PX + "r:i g:i b:i", sql(LAB, f"""SELECT l.raster_id, l.row, l.col, CASE WHEN l.col % 10 = 3 THEN 124 WHEN label = 13 THEN 28 WHEN m THEN 45 ELSE c.r END AS r,
    CASE WHEN l.col % 10 = 3 THEN 252 WHEN label = 13 THEN 107 WHEN m THEN 45 ELSE c.g END AS g, CASE WHEN l.col % 10 = 3 THEN 0 WHEN label = 13 THEN 160 WHEN m THEN 48 ELSE c.b END AS b
    FROM (SELECT *, label IN (1, 8) AND (row * 7 + col * 3) % 11 <> 0 AS m FROM lab) l {_RGB}"""))
def merge_feature_masks(spark, sf):
    return mk.merge_masks(classified(spark, sf), ordered_masks(spark, sf))


@query("merge_road_mask", PX + "r:i g:i b:i", sql(LAB, f"""SELECT l.raster_id, l.row, l.col, CASE WHEN m THEN 45 ELSE c.r END AS r, CASE WHEN m THEN 45 ELSE c.g END AS g, CASE WHEN m THEN 48 ELSE c.b END AS b
    FROM (SELECT *, label IN (1, 8) AND (row * 7 + col * 3) % 11 <> 0 AS m FROM lab) l {_RGB}"""))
def merge_road_mask(spark, sf):
    runs, _ = road_mask(spark, sf)
    return mk.merge_road_mask(classified(spark, sf), rn.pixels_of(runs))


@query("align_mask", PX, sql("scene dims meta", """SELECT s.raster_id, s.row, s.col FROM scene s JOIN meta m USING (raster_id) JOIN (SELECT DISTINCT raster_id, row // 2 AS mr, col // 2 AS mc FROM scene
    WHERE (row // 2 + col // 2) % 3 = 0 AND row >= 4) k ON k.raster_id = s.raster_id
    AND k.mr = floor(((f + (s.row + 0.5) * e) - (f - 1)) / -1.0) AND k.mc = floor(((c + (s.col + 0.5) * a) - (c + 1)) / 1.0)"""))
def align_mask(spark, sf):
    meta = raster_meta(spark, sf).select("raster_id", "a", "c", "e", "f")
    target = attach(scene(spark, sf).select("raster_id", "row", "col"), meta, ["raster_id"])
    coarse = scene(spark, sf).where("row >= 4").selectExpr("raster_id", "cast(row div 2 AS int) AS row", "cast(col div 2 AS int) AS col").where("(row + col) % 3 = 0").distinct()
    grid2 = meta.selectExpr("raster_id", "1.0D AS ma", "c + 1 AS mc", "-1.0D AS me", "f - 1 AS mf")
    return grid.align_mask(target, coarse, grid2)


_CONF = "(VALUES " + ", ".join(f"({i}, '{t}', '{s}', {c[0]}, {c[1]}, {c[2]}, {th}::DOUBLE)" for i, (t, s, _, c, th, _) in enumerate(mk.FEATURES)) + ") AS v(mask_order, feature, suffix, r, g, b, threshold)"


@query("feature_config", "raster_id:i feature:s suffix:s mask_order:i threshold:d6 pixels:l", sql("scene classes labels13",
    f"SELECT raster_id, feature, suffix, mask_order, threshold, count(*) AS pixels FROM {_CONF} JOIN classes c USING (r, g, b) JOIN labels13 ON label = class_idx GROUP BY ALL"))
def feature_config(spark, sf):
    conf = mk.feature_config(spark).join(classes(spark).select("class_idx", "r", "g", "b"), ["r", "g", "b"])
    counts = labels13(spark, sf).groupBy("raster_id", F.col("label").alias("class_idx")).agg(F.count("*").alias("pixels"))
    return counts.join(F.broadcast(conf), "class_idx")


def _closed(name):
    return {f"{name}1": _dil(name, rn.ellipse(15)), f"{name}2": _ero(f"{name}1", rn.ellipse(15))}


@query("extract_features", "suffix:s mask_order:i raster_id:i row:i col:i r:i g:i b:i", sql(DEPS,
    "SELECT 'fields_grass' AS suffix, 3 AS mask_order, *, 124 AS r, 252 AS g, 0 AS b FROM fld2 UNION ALL "
    "SELECT 'fields_agriculture', 4, *, 189, 183, 107 FROM fld2 UNION ALL SELECT 'trees', 2, *, 34, 139, 34 FROM tre2",
    fld=sql(DEPS, "SELECT * FROM found", **_detector(mk.FIELD, rn.ellipse(5), rn.rect(15), 800, 0.005)),
    tre=sql(DEPS, "SELECT * FROM found", **_detector(mk.TREE, rn.ellipse(3), rn.ellipse(11), 400, 0.002)), **_closed("fld"), **_closed("tre")))
def extract_features(spark, sf):
    px = sized(scene(spark, sf))
    return mk.extract_features(px, "fields").unionByName(mk.extract_features(px, "trees"))


@query("extract_water", "suffix:s mask_order:i raster_id:i row:i col:i r:i g:i b:i", sql(DEPS,
    " UNION ALL ".join(f"SELECT '{suffix}' AS suffix, {order} AS mask_order, raster_id, row, col, 28 AS r, 107 AS g, 160 AS b FROM wat2"
                       for order, suffix in ((5, "water_bodies"), (6, "water_channels"), (7, "water_other"))), wat=ORACLES["detect_water"], **_closed("wat")))
def extract_water(spark, sf):
    return mk.extract_features(sized(scene(spark, sf)), "water")


@query("extract_buildings", "suffix:s mask_order:i raster_id:i row:i col:i r:i g:i b:i", sql(DEPS,
    "SELECT 'buildings' AS suffix, 1 AS mask_order, raster_id, row, col, 180 AS r, 180 AS g, 180 AS b FROM bld2", bld=ORACLES["detect_buildings"], **_closed("bld")))
def extract_buildings(spark, sf):
    return mk.extract_features(sized(scene(spark, sf)), "buildings")


_PF = ", ".join(f"avg(CASE WHEN {c} THEN 1.0::DOUBLE ELSE 0 END) AS {k}" for k, (c, _) in mk.PREFILTER.items())
HOUGH = {"th": """SELECT *, (b1 + b2 + b3) / 3 AS br, greatest(b1, b2, b3) - least(b1, b2, b3) AS sat FROM (
        SELECT raster_id, row * oh // height AS row, col * ow // width AS col, any_value(oh) AS height, any_value(ow) AS width, avg(b1) AS b1, avg(b2) AS b2, avg(b3) AS b3 FROM (SELECT *,
          least(height, greatest(1, floor(height / (greatest(height, width) / 64.0::DOUBLE))))::INT AS oh, least(width, greatest(1, floor(width / (greatest(height, width) / 64.0::DOUBLE))))::INT AS ow FROM px)
        GROUP BY raster_id, row * oh // height, col * ow // width)""",
    "hl": f"""SELECT raster_id, theta, round(round(col * cos(radians(theta)) + row * sin(radians(theta)), 9)) AS rho, row * cos(radians(theta)) - col * sin(radians(theta)) AS along, least(height, width) AS side
        FROM (SELECT * FROM th WHERE {mk.GRAYISH}), (SELECT unnest(range(180)) AS theta)""",
    "hp": """SELECT *, sum(st) OVER (PARTITION BY raster_id, theta, rho ORDER BY along ROWS UNBOUNDED PRECEDING) AS piece FROM (
        SELECT *, CASE WHEN along - lag(along) OVER (PARTITION BY raster_id, theta, rho ORDER BY along) <= 10 THEN 0 ELSE 1 END AS st FROM (
          SELECT *, count(*) OVER (PARTITION BY raster_id, theta, rho) AS votes FROM hl) WHERE votes >= 12)""",
    "hs": "SELECT raster_id, theta, rho, piece, max(along) - min(along) AS length FROM hp GROUP BY raster_id, theta, rho, piece HAVING max(along) - min(along) >= greatest(8, floor(any_value(side) * 0.07))"}


@query("road_linearity", "raster_id:i theta:i rho:i piece:i length:d6", sql(DEPS, "SELECT * FROM hs", **HOUGH))
def road_linearity(spark, sf):
    return mk.road_linearity(sized(scene(spark, sf)), side=64)


@query("should_extract", "raster_id:i feature:s share:d6 run:b", sql(DEPS, "SELECT raster_id, feature, share, valid < 100 OR (share > bound AND (feature <> 'roads' OR segments > 0)) AS run FROM ("
    + " UNION ALL ".join(f"SELECT raster_id, valid, '{k}' AS feature, {k} AS share, {lim} AS bound, (SELECT count(*) FROM hs WHERE hs.raster_id = pf.raster_id) AS segments FROM pf" for k, (_, lim) in mk.PREFILTER.items()) + ")",
    **HOUGH, pf=f"SELECT raster_id, count(*) AS valid, {_PF} FROM th WHERE b1 > 5 OR b2 > 5 OR b3 > 5 GROUP BY raster_id"))
def should_extract(spark, sf):
    return mk.should_extract(sized(scene(spark, sf)), side=64)
