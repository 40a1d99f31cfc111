"""Queries over sources, sinks, grids and tiles."""

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import grid
from ..oracle.base import CTES, names_in, sql
from ..session import attach, cut, scratch_path
from ..sources import rasters as rs, sidecars, vectors as vs
from .fixtures import classes, geoms, labels13, raster_meta, rasters, scene, sized
from .registry import query

HALF = "20037508.34::DOUBLE"


def catalogue_meta(spark, sf):
    """The raster catalogue with an affine transform."""
    return rasters(spark, sf).selectExpr(
        "raster_id", "path", "width", "height", "bands", "epsg",
        "CASE WHEN epsg = 3857 THEN 0.5D ELSE 0.5D / 1024 END AS a", "left AS c",
        "CASE WHEN epsg = 3857 THEN -0.5D ELSE -0.5D / 1024 END AS e", "top AS f",
    )


CATALOGUE = {"cat": """SELECT raster_id, path, width, height, bands, epsg, "left" AS c, top AS f,
    CASE WHEN epsg = 3857 THEN 0.5::DOUBLE ELSE 0.5::DOUBLE / 1024 END AS a,
    CASE WHEN epsg = 3857 THEN -0.5::DOUBLE ELSE -0.5::DOUBLE / 1024 END AS e FROM rasters""",
    "bounds": f"""SELECT *, c AS west0, f AS north0, c + width * a AS east0, f + height * e AS south0 FROM cat""",
    "wgs": f"""SELECT *, CASE WHEN epsg = 3857 THEN west0 / {HALF} * 180 ELSE west0 END AS west,
        CASE WHEN epsg = 3857 THEN east0 / {HALF} * 180 ELSE east0 END AS east,
        CASE WHEN epsg = 3857 THEN atan(exp(north0 / {HALF} * pi())) * 360 / pi() - 90 ELSE north0 END AS north,
        CASE WHEN epsg = 3857 THEN atan(exp(south0 / {HALF} * pi())) * 360 / pi() - 90 ELSE south0 END AS south FROM bounds"""}


@query("scan_images", "raster_id:i row:i col:i b1:i b2:i b3:i", sql("scene", "SELECT raster_id, row, col, b1, b2, b3 FROM scene"))
def scan_images(spark, sf):
    folder = scratch_path(spark, "images")
    rs.write_files(rs.bmp_tiles(scene(spark, sf), 32), folder.removeprefix("file:"))
    px = rs.scan_images(spark, folder)
    part = lambda n: f"cast(regexp_extract(path, 'r([0-9]+)_r([0-9]+)_c([0-9]+).bmp', {n}) AS int)"
    return px.selectExpr(f"{part(1)} AS raster_id", f"{part(2)} * 32 + row AS row", f"{part(3)} * 32 + col AS col", "b1", "b2", "b3")


@query("window_read", "raster_id:i row:i col:i b1:i b2:i b3:i", sql(
    "scene", "SELECT raster_id, row, col, b1, b2, b3 FROM scene WHERE row >= 3 AND row < 21 AND col >= 30 AND col < 62"))
def window_read(spark, sf):
    path = scratch_path(spark, "pixels")
    scene(spark, sf).write.partitionBy("raster_id").parquet(path)
    return rs.scan_pixels(spark, path, window=(3, 30, 18, 32)).select("raster_id", "row", "col", "b1", "b2", "b3")


@query("folder_scan", "path:s name:s relative_path:s", sql(
    "rasters", """SELECT path, split_part(path, '/', 4) AS name, split_part(path, '/', 3) || '/' || split_part(path, '/', 4) AS relative_path
    FROM rasters WHERE path NOT LIKE '%.txt'"""))
def folder_scan(spark, sf):
    return rs.scan_folder(rasters(spark, sf), "/in/")


@query("vector_scan", "layer_idx:i feature_id:l kind:s parts_n:i vertices:i minx:d6 maxy:d6", sql(
    "anchors verts", """SELECT layer_idx, feature_id, kind, count(DISTINCT part) AS parts_n, count(*) AS vertices,
    min(x) AS minx, max(y) AS maxy FROM verts GROUP BY layer_idx, feature_id, kind"""))
def vector_scan(spark, sf):
    path = scratch_path(spark, "vectors")
    geoms(spark, sf).write.json(path)
    return geo.with_bbox(vs.scan_vectors(spark, path)).selectExpr(
        "*", "size(parts) AS parts_n", "size(flatten(parts)) AS vertices"
    )


@query("raster_info", "raster_id:l south:d6 west:d6 north:d6 east:d6 crs:s width:i height:i", sql(
    "rasters", "SELECT raster_id, south, west, north, east, 'EPSG:' || epsg AS crs, width, height FROM wgs", **CATALOGUE))
def raster_info(spark, sf):
    return geo.wgs84_bounds(catalogue_meta(spark, sf)).selectExpr("*", "concat('EPSG:', epsg) AS crs")


@query("label_sink_roundtrip", "raster_id:i row:i col:i label:i", sql("scene classes labels13", "SELECT * FROM labels13"))
def label_sink_roundtrip(spark, sf):
    path = scratch_path(spark, "labels")
    rs.write_labels(labels13(spark, sf), path)
    return rs.scan_pixels(spark, path)


@query("txr_lines", "raster_id:l line_no:i text:s", sql("rasters", """SELECT raster_id, line_no, text FROM (
    SELECT raster_id, unnest(range(1, 10)) AS line_no, unnest(['csm=Geographic', 'datumId=4326', 'dcType=NONE', 'dcSelectorId=0',
    'EndMapTokens', printf('Top: %.12f', north), printf('Bottom: %.12f', south), printf('Left: %.12f', west),
    printf('Right: %.12f', east)]) AS text FROM wgs)""", **CATALOGUE))
def txr_lines(spark, sf):
    return sidecars.txr_lines(catalogue_meta(spark, sf))


_TXS = ", ".join(
    "'" + t.replace("{lib}", sidecars.LIBRARY).replace("{path}", "' || path || '").replace("{texels_y}", "' || ty || '")
    .replace("{texels_x}", "' || tx || '").replace("{top}", "' || printf('%.12f', f) || '")
    .replace("{right}", "' || printf('%.12f', c + width * a) || '").replace("{left}", "' || printf('%.12f', c) || '")
    .replace("{bottom}", "' || printf('%.12f', f + height * e) || '") + "'"
    for t in sidecars.TXS_LINES
)


@query("txs_lines", "raster_id:i line_no:i text:s", sql("scene dims meta", f"""SELECT raster_id, unnest(range(1, 39)) AS line_no, unnest([{_TXS}]) AS text
    FROM (SELECT *, '/out/scene_' || raster_id || '.tif' AS path, (2 ** ceil(log2(width)))::INT AS tx, (2 ** ceil(log2(height)))::INT AS ty FROM meta)"""))
def txs_lines(spark, sf):
    meta = raster_meta(spark, sf).selectExpr("*", "concat('/out/scene_', raster_id, '.tif') AS path").withColumn("epsg", F.lit(4326))
    return sidecars.txs_lines(meta)


def _present(spark, sf):
    return labels13(spark, sf).groupBy("raster_id", F.col("label").alias("class_idx")).count().join(
        F.broadcast(classes(spark)), "class_idx")


@query("material_xml_rows", "raster_id:i class_idx:i composite:s argb:s material:s weight:i thickness:i", sql(
    "scene classes labels13", """SELECT DISTINCT raster_id, class_idx, composite_name AS composite, '#ff' || lower(color[2:]) AS argb,
    name AS material, 100 AS weight, 1 AS thickness FROM labels13 JOIN classes ON class_idx = label"""))
def material_xml_rows(spark, sf):
    present = _present(spark, sf)
    rows = sidecars.material_rows(classes(spark))
    return present.select("raster_id", "class_idx").join(F.broadcast(rows), "class_idx")


@query("palette_reference", "raster_id:i class_id:s material:s material_type:s hex_color:s final_rgb:s pixels:l", sql(
    "scene classes labels13", """SELECT raster_id, id AS class_id, name AS material, material_type, color AS hex_color,
    r || ',' || g || ',' || b AS final_rgb, count(*) AS pixels FROM labels13 JOIN classes ON class_idx = label GROUP BY ALL"""))
def palette_reference(spark, sf):
    used = _present(spark, sf).selectExpr("raster_id", "id AS class_id", "count AS pixels")
    return used.join(F.broadcast(sidecars.palette_reference(classes(spark))), "class_id")


@query("output_names", "path:s step1:s step2:s whole:s tile_name:s", sql("rasters", """SELECT path,
    '/out/' || sub || '/' || stem || '_classified.tif' AS step1, '/out/' || sub || '/' || stem || '_with_vectors.tif' AS step2,
    '/out/' || sub || '/' || stem || '_full.tif' AS whole, stem || '_tile_r' || (raster_id % 4) * 512 || '_c' || (raster_id % 3) * 512 || '.tif' AS tile_name
    FROM (SELECT *, split_part(path, '/', 3) AS sub, regexp_replace(split_part(path, '/', 4), '[.][a-zA-Z]+$', '') AS stem FROM rasters)"""))
def output_names(spark, sf):
    files = rasters(spark, sf).selectExpr("path", "(raster_id % 4) * 512 AS tile_row", "(raster_id % 3) * 512 AS tile_col")
    for step, col in (("step1", "step1"), ("step2", "step2"), ("full", "whole")):
        files = rs.output_names(files, "/in", "/out", step).withColumnRenamed("output", col)
    return files


@query("pixel_world", "raster_id:i row:i col:i x:d6 y:d6", sql(
    "scene dims meta", "SELECT raster_id, row, col, c + col * a AS x, f + row * e AS y FROM scene JOIN meta USING (raster_id)"))
def pixel_world(spark, sf):
    return grid.pixel_to_world(attach(scene(spark, sf), raster_meta(spark, sf).select("raster_id", "a", "c", "e", "f"), ["raster_id"]))


@query("raster_bounds", 'raster_id:l left_x:d6 bottom_y:d6 right_x:d6 top_y:d6', sql(
    "rasters", "SELECT raster_id, west0 AS left_x, south0 AS bottom_y, east0 AS right_x, north0 AS top_y FROM bounds", **CATALOGUE))
def raster_bounds(spark, sf):
    return geo.raster_bounds(catalogue_meta(spark, sf)).selectExpr(
        "raster_id", "left AS left_x", "bottom AS bottom_y", "right AS right_x", "top AS top_y")


_LONLAT = """SELECT raster_id, "left" / 30 - 80 AS lon, top / 60 - 37 AS lat FROM rasters"""


@query("mercator_forward", "raster_id:l x:d4 y:d4", sql(
    "rasters", f"SELECT raster_id, lon * {HALF} / 180 AS x, ln(tan((90.0::DOUBLE + lat) * pi() / 360)) * {HALF} / pi() AS y FROM ll", ll=_LONLAT))
def mercator_forward(spark, sf):
    ll = rasters(spark, sf).selectExpr("raster_id", "left / 30 - 80 AS lon", "top / 60 - 37 AS lat")
    return ll.selectExpr("raster_id", f"{geo.mercator_x('lon')} AS x", f"{geo.mercator_y('lat')} AS y")


@query("mercator_inverse", "raster_id:l lon:d6 lat:d6", sql(
    "rasters", f"""SELECT raster_id, ("left" * 1000) / {HALF} * 180 AS lon,
    degrees(2 * atan(exp((top * 1000) / {HALF} * pi())) - pi() / 2) AS lat FROM rasters"""))
def mercator_inverse(spark, sf):
    return rasters(spark, sf).selectExpr(
        "raster_id", f"{geo.longitude('(left * 1000)')} AS lon", f"{geo.latitude('(top * 1000)')} AS lat")


@query("geom_to_mercator", "feature_id:l kind:s part:i pos:i x:d4 y:d4", sql(
    "anchors verts", f"""SELECT feature_id, kind, part, pos, (x / 1024) * {HALF} / 180 AS x,
    ln(tan((90.0::DOUBLE + y / 16384) * pi() / 360)) * {HALF} / pi() AS y FROM verts"""))
def geom_to_mercator(spark, sf):
    g = vs.drop_empty(geoms(spark, sf)).selectExpr(
        "feature_id", "kind", "transform(parts, p -> transform(p, v -> named_struct('x', v.x / 1024, 'y', v.y / 16384))) AS parts")
    g = g.selectExpr("feature_id", "kind", f"{geo.reproject_parts('parts', '4326', '3857')} AS parts")
    g = g.selectExpr("feature_id", "kind", "posexplode(parts) AS (part, ring)").selectExpr(
        "feature_id", "kind", "part + 1 AS part", "posexplode(ring) AS (pos, v)")
    return g.selectExpr("feature_id", "kind", "part", "pos + 1 AS pos", "v.x AS x", "v.y AS y")


@query("crs_normalize", "raster_id:l epsg:i", sql("rasters", """SELECT raster_id,
    CASE WHEN raster_id % 3 = 0 THEN 3857 ELSE epsg END AS epsg FROM rasters"""))
def crs_normalize(spark, sf):
    df = rasters(spark, sf).selectExpr("raster_id", "epsg AS e", """CASE raster_id % 3
        WHEN 0 THEN 'LOCAL_CS["WGS 84 / Pseudo-Mercator"]' WHEN 1 THEN 'LOCAL_CS["other"]' ELSE 'Pseudo-Mercator' END AS text""")
    return df.select("raster_id", geo.normalize_crs("text", "e").alias("epsg"))


@query("reproject_nearest", "raster_id:i row:i col:i label:i", sql(
    "scene classes labels13 dims meta", f"""SELECT g.raster_id, g.row, g.col, coalesce(l.label, 0) AS label FROM (
      SELECT raster_id, row, col,
        floor((ln(tan((90.0::DOUBLE + north - (row + 0.5) * (north - south) / height) * pi() / 360)) * {HALF} / pi() - f) / e) AS sr,
        floor(((west + (col + 0.5) * (east - west) / width) * {HALF} / 180 - c) / a) AS sc
      FROM (SELECT *, c / {HALF} * 180 AS west, (c + width * a) / {HALF} * 180 AS east,
              degrees(2 * atan(exp(f / {HALF} * pi())) - pi() / 2) AS north,
              degrees(2 * atan(exp((f + height * e) / {HALF} * pi())) - pi() / 2) AS south FROM meta) m
      JOIN (SELECT raster_id, row, col FROM scene) USING (raster_id)) g
    LEFT JOIN labels13 l ON l.raster_id = g.raster_id AND l.row = sr AND l.col = sc"""))
def reproject_nearest(spark, sf):
    return grid.reproject_nearest(labels13(spark, sf), raster_meta(spark, sf))


@query("pad_pow2_dims", "raster_id:l pad_height:i pad_width:i", sql(
    "rasters", "SELECT raster_id, min(p) FILTER (p >= height) AS pad_height, min(p) FILTER (p >= width) AS pad_width "
    "FROM rasters, (SELECT unnest([2 ** i for i in range(0, 16)])::INT AS p) GROUP BY raster_id"))
def pad_pow2_dims(spark, sf):
    return grid.pad_pow2(rasters(spark, sf))


@query("tile_windows", "raster_id:l row:i col:i h:i w:i", sql("rasters", """SELECT raster_id, row, col, least(128, height - row) AS h,
    least(128, width - col) AS w FROM (SELECT *, unnest(range(0, height, 112)) AS row FROM rasters) r,
    LATERAL (SELECT unnest(range(0, r.width, 112)) AS col)"""))
def tile_windows(spark, sf):
    return grid.tile_windows(rasters(spark, sf), 128, 16)


@query("rw_windows", "raster_id:l w_row:i w_col:i w_h:i w_w:i r_row:i r_col:i r_h:i r_w:i inner_row:i inner_col:i", sql("rasters", """
    SELECT *, r_bottom - r_row AS r_h, r_right - r_col AS r_w, w_row - r_row AS inner_row, w_col - r_col AS inner_col FROM (
    SELECT raster_id, w_row, w_col, least(230, height - w_row) AS w_h, least(230, width - w_col) AS w_w, greatest(w_row - 13, 0) AS r_row,
    greatest(w_col - 13, 0) AS r_col, least(w_row + 243, height) AS r_bottom, least(w_col + 243, width) AS r_right
    FROM (SELECT *, unnest(range(0, height, 230)) AS w_row FROM rasters) r, LATERAL (SELECT unnest(range(0, r.width, 230)) AS w_col))"""))
def rw_windows(spark, sf):
    return grid.read_write_windows(rasters(spark, sf), 256, 26)


@query("auto_tile_size", "raster_id:l tile_size:i", sql("rasters", """SELECT raster_id,
    least(greatest(128, floor(sqrt(greatest(16384, raster_id * 13)))), greatest(height, width)) AS tile_size FROM rasters"""))
def auto_tile_size(spark, sf):
    return grid.auto_tile_size(rasters(spark, sf), "raster_id * 13")


@query("tile_halo", "raster_id:i trow:i tcol:i row:i col:i inside:b", sql("scene dims px", """SELECT raster_id, trow, tcol, row, col,
    row // 32 = trow AND col // 32 = tcol AS inside FROM px, (SELECT unnest(range(0, 8)) AS trow), (SELECT unnest(range(0, 8)) AS tcol)
    WHERE row BETWEEN trow * 32 - 4 AND trow * 32 + 35 AND col BETWEEN tcol * 32 - 4 AND tcol * 32 + 35
      AND trow * 32 < height AND tcol * 32 < width"""))
def tile_halo(spark, sf):
    return grid.assign_tiles(sized(scene(spark, sf)), 32, 4).withColumnRenamed("inner", "inside")


@query("geom_tile_join", "layer_idx:i feature_id:l raster_id:i row:i col:i", sql("scene dims meta anchors verts", """
    SELECT layer_idx, feature_id, raster_id, row, col FROM (
      SELECT layer_idx, feature_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM verts GROUP BY ALL) g
    JOIN (SELECT raster_id, row, col, c + col * a AS tx0, c + (col + least(16, width - col)) * a AS tx1,
             f + (row + least(16, height - row)) * e AS ty0, f + row * e AS ty1
          FROM (SELECT *, unnest(range(0, height, 16)) AS row FROM meta) m, LATERAL (SELECT unnest(range(0, m.width, 16)) AS col)) t
    ON NOT (x1 < tx0 OR x0 > tx1 OR y1 < ty0 OR y0 > ty1)"""))
def geom_tile_join(spark, sf):
    meta = raster_meta(spark, sf)
    windows = grid.tile_windows(meta, 16, 0).join(meta.select("raster_id", "a", "c", "e", "f"), "raster_id").selectExpr(
        "raster_id", "row", "col", "c + col * a AS tminx", "c + (col + w) * a AS tmaxx", "f + (row + h) * e AS tminy", "f + row * e AS tmaxy")
    return grid.bounds_overlap(geoms(spark, sf), windows, 8.0)


@query("thumbnail", "raster_id:i row:i col:i b1:d6 b2:d6 b3:d6", sql("scene dims px", """SELECT raster_id, row * oh // height AS row, col * ow // width AS col,
    avg(b1) AS b1, avg(b2) AS b2, avg(b3) AS b3 FROM (SELECT * EXCLUDE (row, col), row, col,
      least(height, greatest(1, floor(height / (greatest(height, width) / 32.0::DOUBLE))))::INT AS oh,
      least(width, greatest(1, floor(width / (greatest(height, width) / 32.0::DOUBLE))))::INT AS ow FROM px)
    GROUP BY raster_id, row * oh // height, col * ow // width"""))
def thumbnail(spark, sf):
    return grid.thumbnail(sized(scene(spark, sf)), 32)


@query("preview_stretch", "raster_id:i row:i col:i b1:i b2:i b3:i alpha:i", sql("scene dims px", """
    SELECT raster_id, row, col, floor((b1 - lo) / (hi - lo)::DOUBLE * 255.0::DOUBLE) AS b1, floor((b2 - lo) / (hi - lo)::DOUBLE * 255.0::DOUBLE) AS b2,
      floor((b3 - lo) / (hi - lo)::DOUBLE * 255.0::DOUBLE) AS b3,
      CASE WHEN greatest(floor((b1 - lo) / (hi - lo)::DOUBLE * 255.0::DOUBLE), floor((b2 - lo) / (hi - lo)::DOUBLE * 255.0::DOUBLE),
        floor((b3 - lo) / (hi - lo)::DOUBLE * 255.0::DOUBLE)) = 0 THEN 0 ELSE 255 END AS alpha
    FROM (SELECT *, min(least(b1, b2, b3)) OVER (PARTITION BY raster_id) AS lo, max(greatest(b1, b2, b3)) OVER (PARTITION BY raster_id) AS hi FROM picked)""",
    picked="""SELECT s.raster_id, g.prow AS row, g.pcol AS col, b1, b2, b3 FROM (
        SELECT DISTINCT raster_id, height, width, row * oh // height AS prow, col * ow // width AS pcol, oh, ow FROM (
          SELECT *, floor(height * least(40.0::DOUBLE / width, 40.0::DOUBLE / height, 1))::INT AS oh,
             floor(width * least(40.0::DOUBLE / width, 40.0::DOUBLE / height, 1))::INT AS ow FROM px)) g
        JOIN scene s ON s.raster_id = g.raster_id AND s.row = floor((prow + 0.5::DOUBLE) * height / oh) AND s.col = floor((pcol + 0.5::DOUBLE) * width / ow)"""))
def preview_stretch(spark, sf):
    px = sized(scene(spark, sf))
    bands = ["b1", "b2", "b3"]
    stats = grid.preview_pick(px, 40, bands).groupBy("raster_id").agg(
        F.min(F.least(*bands)).alias("lo"), F.max(F.greatest(*bands)).alias("hi"))
    return grid.preview(px, cut(stats), 40, uint8=False)
