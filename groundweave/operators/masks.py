"""Feature masks from colour and shape: detectors, pre-filter, clean-up, merging."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..session import bounded, cut, where_once
from . import runs as rn
from .features import hsv8, gaussian_std
from .focal import KEYS
from .grid import read_tiles, thumbnail

BR8 = "cast((b1 + b2 + b3) div 3 AS int)"
# Colour ranges over 8-bit h, s, v and the bands.
BUILDING = ("(s < 40 AND v > 90 AND v < 215) OR ((h < 15 OR h > 170) AND s > 50 AND v > 80) OR (v > 210 AND s < 35) OR (s < 35 AND v > 120 AND v < 200)")
TREE = "h > 25 AND h < 90 AND s > 30 AND v > 25 AND v < 170"
FIELD = "(h > 25 AND h < 85 AND s > 20 AND v > 60 AND v < 240) OR (h > 18 AND h < 35 AND s > 25 AND v > 80)"
WATER_HSV = (
    "(h > 90 AND h < 135 AND s > 25 AND v > 20 AND v < 230) OR (h > 95 AND h < 140 AND s > 50 AND v > 15 AND v < 160) "
    "OR (h > 75 AND h < 100 AND s > 30 AND v > 60 AND v < 230) OR (h > 55 AND h < 95 AND s > 20 AND v > 25 AND v < 180 AND b3 > b2 * 3 div 10) "
    "OR (h > 70 AND h < 120 AND s > 15 AND v > 10 AND v < 90)")
WATER_RGB = (
    "(b3 > b1 + 8 AND b3 > b2 - 15 AND b3 > 30) OR (b3 > b1 AND b2 > b1 AND b2 + b3 > b1 * 2 + 30 AND b3 > 30) "
    "OR (br < 70 AND b3 > b1 + 2 AND b3 > 15) OR (b2 > 70 AND b3 > 60 AND b1 < b2 - 8 AND b1 < b3 + 10)")
WATER_SMOOTH = "std < 12 AND b3 > b1 + 5 AND b3 > 30 AND br > 10 AND br < 200"
WATER_AMBIGUOUS = (
    "std < 8 AND ((h > 8 AND h < 30 AND s > 15 AND s < 100 AND v > 30 AND v < 140) OR (s < 25 AND v > 50 AND v < 170 AND b3 > b1) "
    "OR (br > 30 AND br < 110 AND b3 >= b1 - 10 AND b3 > b2 - 20 AND s > 10))")
WATER = f"br > 5 AND (({WATER_HSV}) OR ({WATER_RGB}) OR ({WATER_SMOOTH}) OR ({WATER_AMBIGUOUS}))"

# Sub-masks per feature type (prompt, colour, threshold, detector).
FEATURES = [
    ("roads", "roads", "road, highway, asphalt path", (45, 45, 48), 0.05, None),
    ("buildings", "buildings", "building, house, roof, rooftop, structure", (180, 180, 180), 0.02, "buildings"),
    ("trees", "trees", "tree, trees, forest, woodland, grove", (34, 139, 34), 0.05, "trees"),
    ("fields", "fields_grass", "grass, lawn, field, meadow, pasture", (124, 252, 0), 0.05, "fields"),
    ("fields", "fields_agriculture", "crop, farmland, agriculture, cultivated field", (189, 183, 107), 0.05, "fields"),
    ("water", "water_bodies", "water, lake, pond, reservoir, pool", (28, 107, 160), 0.03, "water"),
    ("water", "water_channels", "river, stream, canal, waterway, channel", (28, 107, 160), 0.03, "water"),
    ("water", "water_other", "sea, ocean, fish pond, swimming pool", (28, 107, 160), 0.03, "water"),
]


def feature_config(spark: SparkSession) -> DataFrame:
    rows = [(t, s, p, *c, th, d, i) for i, (t, s, p, c, th, d) in enumerate(FEATURES)]
    return spark.createDataFrame(rows, "feature STRING, suffix STRING, prompt STRING, r INT, g INT, b INT, threshold DOUBLE, detector STRING, mask_order INT")


def _dims(px: DataFrame) -> DataFrame:
    return bounded(px.groupBy("raster_id").agg(F.first("height").alias("height"), F.first("width").alias("width")))


def contour_area(comps: DataFrame) -> DataFrame:
    """Area of the polygon through the border pixel centres of each (hole-free) component.

    Counts 2x2 blocks: four pixels give 1, three give one half. Per pair of touching runs
    in adjacent rows this is half the overlap of one run's pixel pairs with the other run.
    """
    a = comps.select("raster_id", "comp", "row", F.col("c0").alias("a0"), F.col("c1").alias("a1"))
    b = comps.select("raster_id", "comp", (F.col("row") - 1).alias("row"), "c0", "c1")
    over = lambda l0, l1, r0, r1: f"greatest(0, least({l1}, {r1}) - greatest({l0}, {r0}) + 1)"
    both = a.join(b, ["raster_id", "comp", "row"]).where("a0 <= c1 + 1 AND c0 <= a1 + 1")
    quads = both.groupBy("raster_id", "comp").agg(
        (F.sum(F.expr(f"{over('a0', 'a1 - 1', 'c0 - 1', 'c1')} + {over('a0 - 1', 'a1', 'c0', 'c1 - 1')}")) / 2).alias("contour_area"))
    return comps.select("raster_id", "comp").distinct().join(quads, ["raster_id", "comp"], "left").fillna(0.0, ["contour_area"])


HULL_ROWS = 512  # rows of a component in one partial hull


def convex_hull(points: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Corners of the convex hull in order (monotone chain)."""
    points = sorted(set(points))

    def half(ordered):
        kept: list[tuple[int, int]] = []
        for x, y in ordered:
            while len(kept) > 1 and (kept[-1][0] - kept[-2][0]) * (y - kept[-2][1]) - (kept[-1][1] - kept[-2][1]) * (x - kept[-2][0]) <= 0:
                kept.pop()
            kept.append((x, y))
        return kept

    return points if len(points) < 3 else half(points)[:-1] + half(points[::-1])[:-1]


def hull_area(comps: DataFrame) -> DataFrame:
    """Area of each component's convex hull, from the end pixels of its rows.

    Hulls of HULL_ROWS rows come first and the hull of their corners then, so a task holds a
    bounded part of a component, or the corners of its parts.
    """

    def corners(pdf: pd.DataFrame) -> pd.DataFrame:
        hull = convex_hull([*zip(pdf["c0"].tolist(), pdf["row"].tolist()), *zip(pdf["c1"].tolist(), pdf["row"].tolist())])
        return pd.DataFrame({"raster_id": pdf["raster_id"].iloc[0], "comp": pdf["comp"].iloc[0], "x": [x for x, _ in hull], "y": [y for _, y in hull]})

    def area(pdf: pd.DataFrame) -> pd.DataFrame:
        hull = convex_hull(list(zip(pdf["x"].tolist(), pdf["y"].tolist())))
        twice = sum(ax * by - bx * ay for (ax, ay), (bx, by) in zip(hull, hull[1:] + hull[:1]))
        return pd.DataFrame({"raster_id": [pdf["raster_id"].iloc[0]], "comp": [pdf["comp"].iloc[0]], "hull_area": [abs(twice) / 2]})

    ends = comps.groupBy("raster_id", "comp", "row").agg(F.min("c0").alias("c0"), F.max("c1").alias("c1"))
    keys = ", ".join(f"{c} {comps.schema[c].dataType.simpleString()}" for c in ("raster_id", "comp"))
    parts = ends.withColumn("part", F.expr(f"row div {HULL_ROWS}")).groupBy("raster_id", "comp", "part").applyInPandas(corners, f"{keys}, x int, y int")
    return parts.groupBy("raster_id", "comp").applyInPandas(area, f"{keys}, hull_area double")


def component_shape(comps: DataFrame) -> DataFrame:
    """Box, contour and hull area, solidity, extent and aspect of each component."""
    df = rn.metrics(comps).join(contour_area(comps), ["raster_id", "comp"]).join(hull_area(comps), ["raster_id", "comp"])
    return df.withColumns({
        "solidity": F.expr("CASE WHEN hull_area > 0 THEN contour_area / hull_area ELSE 0D END"),
        "extent": F.expr("contour_area / cast(bw * bh AS double)"),
    })


def _blobs(runs: DataFrame, dims: DataFrame) -> DataFrame:
    """Outer contours, filled: components (8-connected) of the mask without holes."""
    return cut(rn.components(rn.fill_holes(runs, dims), connectivity=8), "blobs")


def _pick(comps: DataFrame, chosen: DataFrame) -> DataFrame:
    return comps.join(chosen.select("raster_id", "comp"), ["raster_id", "comp"], "left_semi").drop("comp")


def _mask(px: DataFrame, where: str) -> DataFrame:
    return rn.runs_of(where_once(hsv8(px), ["h", "s", "v"], where))


def _large(comps: DataFrame, dims: DataFrame, least: int, share: float) -> DataFrame:
    return contour_area(comps).join(dims, "raster_id").where(f"contour_area >= greatest({least}, cast(height AS bigint) * width * {share}D)")


def detect_buildings(px: DataFrame) -> DataFrame:
    dims = _dims(px)
    clean = rn.closing(rn.opening(_mask(px, BUILDING), rn.ellipse(3), dims), rn.rect(9), dims)
    comps = _blobs(clean, dims)
    shape = component_shape(comps).join(dims, "raster_id").where(
        "contour_area >= greatest(300D, cast(height AS bigint) * width * 0.0015D) AND contour_area <= cast(height AS bigint) * width * 0.35D "
        "AND hull_area > 0 AND solidity >= 0.55D AND aspect <= 7D AND extent >= 0.35D")
    return _pick(comps, shape)


def detect_trees(px: DataFrame) -> DataFrame:
    dims = _dims(px)
    comps = _blobs(rn.closing(rn.opening(_mask(px, TREE), rn.ellipse(3), dims), rn.ellipse(11), dims), dims)
    return _pick(comps, _large(comps, dims, 400, 0.002))


def detect_fields(px: DataFrame) -> DataFrame:
    dims = _dims(px)
    comps = _blobs(rn.closing(rn.opening(_mask(px, FIELD), rn.ellipse(5), dims), rn.rect(15), dims), dims)
    return _pick(comps, _large(comps, dims, 800, 0.005))


def water_pixels(px: DataFrame) -> DataFrame:
    """Water-coloured pixels, with smoothness confirming the ambiguous colours."""
    std = gaussian_std(px, 11, ["b1", "b2", "b3"])
    df = hsv8(std.withColumn("std", F.round("std", 9))).withColumn("br", F.expr(BR8))
    return where_once(df, ["h", "s", "v", "b1", "b2", "b3", "br", "std"], WATER)


def detect_water(px: DataFrame) -> DataFrame:
    dims = _dims(px)
    valid = cut(rn.runs_of(px.where(f"{BR8} > 5")), "valid")
    m = rn.opening(rn.runs_of(water_pixels(px)), rn.ellipse(3), dims)
    m = cut(rn.intersect(rn.closing(m, rn.ellipse(21), dims), valid), "water")
    m = rn.intersect(rn.dilate(m, rn.ellipse(3), dims), valid)
    comps = _blobs(m, dims)
    sized = contour_area(comps).join(dims, "raster_id").withColumn("tile", F.expr("cast(height AS bigint) * width"))
    sized = cut(sized.where("contour_area >= greatest(200D, tile * 0.001D) AND contour_area <= tile * 0.95D"), "sized")
    small = sized.where("contour_area < tile * 0.01D").select("raster_id", "comp")
    means = rn.pixels_of(comps.join(small, ["raster_id", "comp"], "left_semi")).join(px.select(*KEYS, "b1", "b2", "b3"), KEYS).groupBy("raster_id", "comp").agg(
        *[F.avg(b).alias(b) for b in ("b1", "b2", "b3")])
    bad = means.where("(b1 > b3 + 30 AND b1 > b2 + 20) OR (b1 > 200 AND b2 > 200 AND b3 > 200)")
    return _pick(comps, sized.join(bad, ["raster_id", "comp"], "left_anti"))


DETECTORS = {"buildings": detect_buildings, "trees": detect_trees, "fields": detect_fields, "water": detect_water}


def detect_tiled(px: DataFrame, detector, size: int = 1024, overlap: int = 102) -> DataFrame:
    """Run a detector (pixels -> runs) on overlapping tiles and keep each tile's own part.

    A tile is just another raster id, so all tiles of all rasters are one job.
    """
    tiles = read_tiles(px, size, overlap)
    found = rn.pixels_of(detector(tiles))
    own = tiles.where("inner").select(*KEYS, "source_id", "source_row", "source_col")
    return found.join(own, KEYS).selectExpr("source_id AS raster_id", "source_row AS row", "source_col AS col")


def union_masks(one: DataFrame, other: DataFrame, dims: DataFrame) -> DataFrame:
    """Pixels of either mask; a raster of ``dims`` whose union is empty is one row without a pixel, marked ``empty``."""
    pixels = rn.pixels_of(rn.union(one, other)).select("raster_id", "row", "col")
    return dims.select("raster_id").distinct().join(pixels, "raster_id", "left").withColumn("empty", F.col("row").isNull())


def close_mask(runs: DataFrame, dims: DataFrame, size: int = 15) -> DataFrame:
    return rn.closing(runs, rn.ellipse(size), dims)


def extend_borders(runs: DataFrame, dims: DataFrame, border: int = 60, size: int = 20) -> DataFrame:
    """Mask widened only inside the border zone."""
    dims = bounded(dims)
    wide = rn.pixels_of(rn.dilate(runs, rn.ellipse(size), dims)).join(dims, "raster_id").withColumn(
        "b", F.expr(f"least({border}, least(height, width) div 6)"))
    zone = wide.where("b > 0 AND (row < b OR row >= height - b OR col < b OR col >= width - b)")
    return rn.union(runs, rn.runs_of(zone))


def extract_features(px: DataFrame, feature: str, closing: int = 15, extend: int = 0) -> DataFrame:
    """Pixels of every sub-mask of a type: detect per tile, close, extend; empty masks give no rows."""
    dims, out, done = _dims(px), None, {}
    for order, (kind, suffix, _, (r, g, b), _, detector) in enumerate(FEATURES):
        if kind != feature or detector is None:
            continue
        if detector not in done:
            runs = close_mask(rn.runs_of(detect_tiled(px, DETECTORS[detector])), dims, closing)
            if extend:
                runs = extend_borders(runs, dims, extend)
            done[detector] = cut(rn.pixels_of(runs), detector)
        part = done[detector].selectExpr(f"'{suffix}' AS suffix", f"{order} AS mask_order", *KEYS, f"{r} AS r", f"{g} AS g", f"{b} AS b")
        out = part if out is None else out.unionByName(part)
    return out


def colourise(px: DataFrame, mask: DataFrame, rgb: tuple[int, int, int]) -> DataFrame:
    hit = mask.select(*KEYS).withColumn("hit", F.lit(True))
    df = px.select(*KEYS).join(hit, KEYS, "left")
    return df.withColumns({c: F.expr(f"CASE WHEN hit THEN {v} ELSE 0 END") for c, v in zip("rgb", rgb)}).drop("hit")


def merge_masks(rgb: DataFrame, masks: DataFrame) -> DataFrame:
    """Masks painted in order, later ones win; ``masks`` has mask_order and r, g, b per pixel."""
    top = masks.groupBy(*KEYS).agg(F.max(F.struct("mask_order", F.col("r").alias("pr"), F.col("g").alias("pg"), F.col("b").alias("pb"))).alias("m")).select(*KEYS, "m.pr", "m.pg", "m.pb")
    return rgb.join(top, KEYS, "left").withColumns({c: F.coalesce(f"p{c}", c) for c in "rgb"}).drop("pr", "pg", "pb")


def merge_road_mask(rgb: DataFrame, mask: DataFrame) -> DataFrame:
    r, g, b = FEATURES[0][3]
    return merge_masks(rgb, mask.selectExpr(*KEYS, "0 AS mask_order", f"{r} AS r", f"{g} AS g", f"{b} AS b"))


# Signature pixels of the pre-filter over float bands, and the least share.
GRAYISH = "sat < 30 AND abs(b1 - b3) < 20 AND br > 30 AND br < 175"
PREFILTER = {
    "roads": (GRAYISH, 0.03),
    "buildings": ("(sat < 40 AND br > 40 AND br < 240) OR (b1 > b2 + 20 AND b1 > b3 + 35 AND br > 50 AND br < 230) OR (sat < 25 AND br > 160)", 0.01),
    "trees": ("b2 - greatest(b1, b3) > 8 AND br < 170", 0.03),
    "fields": ("(b2 > b1 + 5 AND b2 > b3 + 10 AND br > 40) OR ((b1 + b2) / 2 - b3 > 15 AND br > 40 AND br < 220 AND b2 > b3)", 0.05),
    "water": ("(b3 > b1 + 5 AND b3 > b2 - 15 AND b3 > 20) OR (b3 >= b1 AND br < 90 AND b3 > 15) OR (b2 > b1 AND b3 > b1 AND br < 150) OR br < 40", 0.005),
}


def _thumb(px: DataFrame, side: int) -> DataFrame:
    return thumbnail(px, side).withColumns({"br": F.expr("(b1 + b2 + b3) / 3"), "sat": F.expr("greatest(b1, b2, b3) - least(b1, b2, b3)")})


def road_linearity(px: DataFrame, side: int = 256, votes: int = 12, gap: int = 10) -> DataFrame:
    """Straight segments in the gray mask of the thumbnail: a full Hough vote at 1 degree steps.

    A line with enough votes is cut where successive pixels are more than ``gap`` apart;
    pieces at least max(8, 7 % of the shorter side) long count. One row per segment.
    """
    mask = _thumb(px, side).where(GRAYISH).select(*KEYS, "height", "width")
    lines = mask.selectExpr("*", "explode(sequence(0, 179)) AS theta").withColumns({
        "ct": F.expr("cos(radians(theta))"), "st": F.expr("sin(radians(theta))")}).selectExpr(
        "raster_id", "theta", "cast(round(round(col * ct + row * st, 9)) AS int) AS rho", "row * ct - col * st AS along", "least(height, width) AS side")
    strong = lines.groupBy("raster_id", "theta", "rho").count().where(f"count >= {votes}").select("raster_id", "theta", "rho")
    order = W.partitionBy("raster_id", "theta", "rho").orderBy("along")
    cutat = lines.join(strong, ["raster_id", "theta", "rho"], "left_semi").withColumn(
        "start", F.when(F.col("along") - F.lag("along").over(order) <= gap, 0).otherwise(1))
    pieces = cutat.withColumn("piece", F.sum("start").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return pieces.groupBy("raster_id", "theta", "rho", "piece").agg((F.max("along") - F.min("along")).alias("length"), F.first("side").alias("side")).where(
        "length >= greatest(8, cast(side * 0.07D AS int))").drop("side")


def should_extract(px: DataFrame, side: int = 256) -> DataFrame:
    """Per raster and feature type: whether to run the extraction, and the signature share."""
    thumb = cut(_thumb(px, side), "thumb").withColumn("lit", F.expr("b1 > 5 OR b2 > 5 OR b3 > 5"))
    # a raster without a lit cell keeps its row: it has too few valid pixels to be skipped
    share = thumb.groupBy("raster_id").agg(F.count_if("lit").alias("valid"), *[
        F.coalesce(F.avg(F.expr(f"CASE WHEN NOT lit THEN NULL WHEN {c} THEN 1D ELSE 0D END")), F.lit(0.0)).alias(k) for k, (c, _) in PREFILTER.items()])
    segments = road_linearity(px, side).groupBy("raster_id").agg(F.count("*").alias("segments"))
    df = share.join(segments, "raster_id", "left").fillna(0, ["segments"])
    rows = ", ".join(f"'{k}', {k}, {limit}D" for k, (_, limit) in PREFILTER.items())
    df = df.selectExpr("raster_id", "valid", "segments", f"stack({len(PREFILTER)}, {rows}) AS (feature, share, bound)")
    return df.withColumn("run", F.expr("valid < 100 OR (share > bound AND (feature <> 'roads' OR segments > 0))")).withColumn(
        "reason", F.expr("CASE WHEN valid < 100 THEN 'too few valid pixels' WHEN share <= bound THEN 'signature share too small' "
                         "WHEN feature = 'roads' AND segments = 0 THEN 'no linear structure' ELSE 'signature found' END"))
