"""Queries over vector layers and their overlay on classified rasters."""

from pyspark.sql import functions as F

from ..functions import geo, palette as pal
from ..operators import grid, materials as mt, vector as vc
from ..oracle.base import sql
from ..sources.vectors import drop_empty
from .fixtures import classes, geoms, labels13, layers, raster_meta, rasters, scene, sized, table, user_classes
from .registry import query

_CAND = "(VALUES " + ", ".join(f"({i}, {r}, {g}, {b})" for i, (r, g, b) in enumerate(pal.OVERLAY_CANDIDATES)) + ") AS v(pos, cr, cg, cb)"
_RGB = "('0x' || color[2:3])::INT AS r, ('0x' || color[4:5])::INT AS g, ('0x' || color[6:7])::INT AS b"


def _auto(sets, key):
    return f"""SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY CASE WHEN d > 80 THEN 0 ELSE 1 END, pos) - 1 AS layer_no, cr, cg, cb FROM (
        SELECT {key}, pos, cr, cg, cb, min(sqrt((r-cr)**2 + (g-cg)**2 + (b-cb)**2)) AS d FROM {sets}, {_CAND} GROUP BY ALL)"""


LAYER_CTES = {"given": f"SELECT id, name, {_RGB}, 0 AS one FROM user_classes", "auto": _auto("given", "one"),
    "coloured": """SELECT l.layer_idx, l.id, """ + ", ".join(
        f"coalesce(a.{c}, b.{c}, p.{c}, q.{c}, override_{c}, au.c{c}, {v}) AS {c}" for c, v in zip("rgb", pal.OVERLAY_FALLBACK)) + """ FROM layers l
        LEFT JOIN given a ON a.id = l.class_id LEFT JOIN given b ON b.name = l.name LEFT JOIN classes p ON p.id = l.class_id
        LEFT JOIN classes q ON q.name = l.name LEFT JOIN auto au ON au.layer_no = l.layer_idx"""}


def coloured(spark, sf):
    return vc.resolve_layer_colours(layers(spark, sf), user_classes(spark, sf), classes(spark))


@query("layer_colours", "layer_idx:i id:s r:i g:i b:i", sql("user_classes layers classes", "SELECT * FROM coloured", **LAYER_CTES))
def layer_colours(spark, sf):
    return coloured(spark, sf)


@query("auto_colours", "set_id:l layer_no:i r:i g:i b:i", sql("", """SELECT set_id, layer_no, coalesce(cr, 255) AS r, coalesce(cg, 255) AS g, coalesce(cb, 0) AS b
    FROM (SELECT DISTINCT set_id, unnest(range(12)) AS layer_no FROM sets) LEFT JOIN auto USING (set_id, layer_no)""",
    sets="SELECT p_partkey // 6 AS set_id, (p_partkey * 37) % 256 AS r, (p_partkey * 91) % 256 AS g, (p_partkey * 53) % 256 AS b FROM part", auto=_auto("sets", "set_id")))
def auto_colours(spark, sf):
    sets = table(spark, sf, "part").selectExpr("p_partkey div 6 AS set_id", "(p_partkey * 37) % 256 AS r", "(p_partkey * 91) % 256 AS g", "(p_partkey * 53) % 256 AS b")
    wanted = sets.select("set_id").distinct().selectExpr("set_id", "explode(sequence(0, 11)) AS layer_no")
    return mt.overlay_colours(sets, wanted, ["set_id"])


@query("align_crs", "feature_id:l part:i pos:i x:d4 y:d4", sql("anchors verts", """SELECT feature_id, part, pos,
    CASE WHEN feature_id % 3 = 0 THEN (x / 1024) * 20037508.34::DOUBLE / 180 ELSE x / 1024 END AS x,
    CASE WHEN feature_id % 3 = 0 THEN ln(tan((90.0::DOUBLE + y / 16384) * pi() / 360)) * 20037508.34::DOUBLE / pi() ELSE y / 16384 END AS y FROM verts"""))
def align_crs(spark, sf):
    g = drop_empty(geoms(spark, sf)).selectExpr(
        "feature_id", "transform(parts, p -> transform(p, v -> named_struct('x', v.x / 1024, 'y', v.y / 16384))) AS parts",
        "CASE feature_id % 3 WHEN 0 THEN 4326 WHEN 1 THEN NULL ELSE 3857 END AS epsg")
    out = vc.align_crs(g, "3857").selectExpr("feature_id", "posexplode(parts) AS (part, ring)").selectExpr("feature_id", "part + 1 AS part", "posexplode(ring) AS (pos, v)")
    return out.selectExpr("feature_id", "part", "pos + 1 AS pos", "v.x AS x", "v.y AS y")


@query("bounds_fallback", "raster_id:l layer_idx:i use_original:b", sql("anchors verts rasters", """SELECT raster_id, layer_idx,
    (ax1 < l OR ax0 > r OR ay1 < b OR ay0 > t) AND NOT (ox1 < l OR ox0 > r OR oy1 < b OR oy0 > t) AS use_original FROM
    (SELECT layer_idx, min(x) AS ox0, max(x) AS ox1, min(y) AS oy0, max(y) AS oy1, min(x / 20037508.34::DOUBLE * 180) AS ax0, max(x / 20037508.34::DOUBLE * 180) AS ax1,
       min(degrees(2 * atan(exp(y / 20037508.34::DOUBLE * pi())) - pi() / 2)) AS ay0, max(degrees(2 * atan(exp(y / 20037508.34::DOUBLE * pi())) - pi() / 2)) AS ay1
     FROM (SELECT layer_idx, x, y - 499000 AS y FROM verts) GROUP BY layer_idx),
    (SELECT raster_id, "left" AS l, "left" + width * 0.5 AS r, top AS t, top - height * 0.5 AS b FROM rasters)"""))
def bounds_fallback(spark, sf):
    g = geoms(spark, sf).selectExpr("layer_idx", "feature_id", "transform(parts, p -> transform(p, v -> named_struct('x', v.x, 'y', v.y - 499000D))) AS parts", "3857 AS epsg")
    bounds = rasters(spark, sf).selectExpr("raster_id", "left", "left + width * 0.5D AS right", "top", "top - height * 0.5D AS bottom")
    return vc.bounds_fallback(vc.align_crs(g, "4326"), g, bounds)


def _touch(kinds):
    """Cells met by a segment (slab test on every cell) and cells with an inside centre."""
    return {
        "seg": """SELECT v.feature_id, v.layer_idx, v.kind, m.raster_id, m.height, m.width, (v.x - m.c) / m.a AS x0, (v.y - m.f) / m.e AS y0,
            (coalesce(n.x, v.x) - m.c) / m.a AS x1, (coalesce(n.y, v.y) - m.f) / m.e AS y1 FROM verts v JOIN meta m ON true
            LEFT JOIN verts n ON n.feature_id = v.feature_id AND n.part = v.part AND n.pos = v.pos + 1
            WHERE (v.kind = 'point' OR n.x IS NOT NULL) AND v.kind IN """ + kinds + """ AND abs(v.x - m.c) < 500""",
        "cells": "SELECT s.*, p.row, p.col FROM seg s JOIN scene p ON p.raster_id = s.raster_id",
        "slab": """SELECT *, CASE WHEN x1 = x0 THEN CASE WHEN x0 >= col AND x0 < col + 1 THEN 0 ELSE 2 END ELSE least((col - x0) / (x1 - x0), (col + 1 - x0) / (x1 - x0)) END AS ta,
            CASE WHEN x1 = x0 THEN CASE WHEN x0 >= col AND x0 < col + 1 THEN 1 ELSE -1 END ELSE greatest((col - x0) / (x1 - x0), (col + 1 - x0) / (x1 - x0)) END AS tb,
            CASE WHEN y1 = y0 THEN CASE WHEN y0 >= row AND y0 < row + 1 THEN 0 ELSE 2 END ELSE least((row - y0) / (y1 - y0), (row + 1 - y0) / (y1 - y0)) END AS tc,
            CASE WHEN y1 = y0 THEN CASE WHEN y0 >= row AND y0 < row + 1 THEN 1 ELSE -1 END ELSE greatest((row - y0) / (y1 - y0), (row + 1 - y0) / (y1 - y0)) END AS td FROM cells""",
        "burned": """SELECT DISTINCT raster_id, layer_idx, feature_id, row, col FROM slab WHERE greatest(ta, tc, 0) <= least(tb, td, 1) UNION
            SELECT raster_id, layer_idx, feature_id, row, col FROM cells WHERE kind NOT IN ('point', 'line')
            AND (y0 > row + 0.5) <> (y1 > row + 0.5) AND col + 0.5 < x0 + (row + 0.5 - y0) * (x1 - x0) / (y1 - y0)
            GROUP BY ALL HAVING count(*) % 2 = 1""",
    }


VEC_DEPS = "scene dims meta anchors verts"
ALL_KINDS = _touch("('point', 'line', 'triangle', 'box')")


def placed(spark, sf):
    return vc.place(geoms(spark, sf), raster_meta(spark, sf), 64.0)


def _raster_query(name, kinds):
    @query(name, "raster_id:i layer_idx:i feature_id:l row:i col:i", sql(VEC_DEPS, "SELECT * FROM burned", **_touch(kinds)))
    def run(spark, sf):
        return vc.rn.pixels_of(vc.rasterize(placed(spark, sf).where(f"kind IN {kinds}"), by_feature=True))


_raster_query("rasterize_points", "('point')")
_raster_query("rasterize_lines", "('line')")
_raster_query("rasterize_polygons", "('triangle', 'box')")

OVER = {**LAYER_CTES, **ALL_KINDS, "top_layer": "SELECT raster_id, row, col, max(layer_idx) AS layer_idx FROM burned GROUP BY ALL"}
OVER_DEPS = "scene dims meta anchors verts classes labels13 user_classes layers"
_PAINT = """SELECT l.raster_id, l.row, l.col, coalesce(p.r, c.r) AS r, coalesce(p.g, c.g) AS g, coalesce(p.b, c.b) AS b, coalesce(13 + t.layer_idx + 1, l.label) AS burn
    FROM labels13 l JOIN classes c ON c.class_idx = l.label LEFT JOIN top_layer t USING (raster_id, row, col) LEFT JOIN coloured p ON p.layer_idx = t.layer_idx"""


def classified(spark, sf):
    return mt.apply_palette(labels13(spark, sf), classes(spark).selectExpr("class_idx AS idx", "r", "g", "b"))


@query("vector_overlay", "raster_id:i row:i col:i r:i g:i b:i burn:i", sql(OVER_DEPS, _PAINT, **OVER))
def vector_overlay(spark, sf):
    runs = vc.rasterize(placed(spark, sf))
    painted = vc.overlay(classified(spark, sf), runs, coloured(spark, sf), 13)
    return painted.withColumn("burn", F.coalesce("burn", "label"))


@query("overlay_stats", "raster_id:i layer_idx:i pixels:l shapes:l", sql(OVER_DEPS, """SELECT d.raster_id, l.layer_idx, count(DISTINCT b.row * 100000 + b.col) AS pixels,
    (SELECT count(*) FROM (SELECT feature_id, v.layer_idx FROM verts v, meta m WHERE m.raster_id = d.raster_id GROUP BY v.feature_id, v.layer_idx, m.c, m.f, m.width, m.height
      HAVING max(x) >= m.c AND min(x) <= m.c + m.width * 0.5 AND max(y) >= m.f - m.height * 0.5 AND min(y) <= m.f) q WHERE q.layer_idx = l.layer_idx) AS shapes
    FROM dims d CROSS JOIN layers l LEFT JOIN burned b ON b.raster_id = d.raster_id AND b.layer_idx = l.layer_idx GROUP BY d.raster_id, l.layer_idx""", **OVER))
def overlay_stats(spark, sf):
    p = placed(spark, sf)
    return vc.overlay_stats(vc.rasterize(p), p, raster_meta(spark, sf), layers(spark, sf))


@query("overlay_tiles", "tile:s row:i col:i r:i g:i b:i", sql(OVER_DEPS,
    f"SELECT raster_id || '/' || (row // 32) * 32 || '/' || (col // 32) * 32 AS tile, row % 32 AS row, col % 32 AS col, r, g, b FROM ({_PAINT})", **OVER))
def overlay_tiles(spark, sf):
    meta = raster_meta(spark, sf)
    tiles = grid.tile_windows(meta, 32, 0).join(meta.select("raster_id", "a", "c", "e", "f"), "raster_id").selectExpr(
        "concat_ws('/', raster_id, row, col) AS raster_id", "h AS height", "w AS width", "a", "c + col * a AS c", "e", "f + row * e AS f")
    px = classified(spark, sf).selectExpr(
        "concat_ws('/', raster_id, row div 32 * 32, col div 32 * 32) AS raster_id", "cast(row % 32 AS int) AS row", "cast(col % 32 AS int) AS col", "r", "g", "b")
    runs = vc.rasterize(vc.place(geoms(spark, sf), tiles, 16.0))
    return vc.overlay(px, runs, coloured(spark, sf), 13).withColumnRenamed("raster_id", "tile")
