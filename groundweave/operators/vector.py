"""Vector overlay: layer colours, CRS alignment, rasterization, painting.

Geometries are rows layer_idx, feature_id, kind, parts, epsg. Rasterization works in pixel
coordinates and yields row runs, so large polygons cost one row per scan line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.geo import HALF_WORLD, reproject_parts, with_bbox
from ..functions.palette import hex_channels
from ..session import attach, bounded, cut, each_of
from . import runs as rn
from .grid import bounds_overlap
from .materials import overlay_colours

FEATURE = ["raster_id", "layer_idx", "feature_id"]
KEYS = ["raster_id", "layer_idx"]
MAX_LAYERS = 1000  # layers of one request


def resolve_layer_colours(layers: DataFrame, given: DataFrame, preset: DataFrame) -> DataFrame:
    """Colour of every layer: given class id, given name, preset id, preset name, override, auto.

    ``given`` and ``preset`` are class tables with id, name, color (at most 30 rows each).
    """
    out = layers
    for n, (table, key, col) in enumerate([(given, "id", "class_id"), (given, "name", "name"), (preset, "id", "class_id"), (preset, "name", "name")]):
        # empty keys don't count, and of classes with one key the last does
        order = F.col("class_idx") if "class_idx" in table.columns else F.monotonically_increasing_id()
        good = table.where("color RLIKE '^#[0-9a-fA-F]{6}$'").where(f"coalesce({key}, '') <> ''").withColumn("_at", order).groupBy(F.col(key).alias(f"_k{n}")).agg(
            F.max_by("color", "_at").alias("color")).select(f"_k{n}", *[c.alias(f"_{ch}{n}") for ch, c in zip("rgb", hex_channels("color"))])
        out = out.join(bounded(good), F.col(col) == F.col(f"_k{n}"), "left").drop(f"_k{n}")
    used = given.where("color RLIKE '^#[0-9a-fA-F]{6}$'").select(F.lit(0).alias("_set"), *hex_channels("color"))
    numbered = layers.select("layer_idx").withColumns({
        "_set": F.lit(0), "layer_no": F.row_number().over(W.partitionBy(F.lit(0)).orderBy("layer_idx")) - 1})  # a request's layers
    auto = overlay_colours(used, numbered, ["_set"]).selectExpr("layer_idx", "r AS _ar", "g AS _ag", "b AS _ab")
    out = out.join(auto, "layer_idx", "left")
    pick = lambda ch: F.coalesce(*[f"_{ch}{n}" for n in range(4)], f"override_{ch}", f"_a{ch}")
    out = out.withColumns({ch: pick(ch) for ch in "rgb"})
    return out.drop(*[f"_{ch}{n}" for ch in "rgb" for n in range(4)], "_ar", "_ag", "_ab")


def align_crs(geoms: DataFrame, raster_epsg: str) -> DataFrame:
    """Parts in the raster's CRS; a layer without CRS is taken to be in it already."""
    return geoms.withColumn("parts", F.expr(reproject_parts("parts", f"coalesce(epsg, {raster_epsg})", raster_epsg))).withColumn("epsg", F.expr(raster_epsg))


def bounds_fallback(aligned: DataFrame, original: DataFrame, bounds: DataFrame) -> DataFrame:
    """Original coordinates for layers that miss a raster after alignment but hit it before.

    ``bounds`` has raster_id, left, bottom, right, top. Returns raster_id, layer_idx, use_original.
    """
    def box(df, p):
        b = with_bbox(df.where("size(flatten(parts)) > 0"), prefix=p)
        return b.groupBy("layer_idx").agg(*[getattr(F, f)(f"{p}{c}").alias(f"{p}{c}") for f, c in (("min", "minx"), ("min", "miny"), ("max", "maxx"), ("max", "maxy"))])
    hit = lambda p: f"NOT ({p}maxx < left OR {p}minx > right OR {p}maxy < bottom OR {p}miny > top)"
    boxes = box(aligned, "a_").join(box(original, "o_"), "layer_idx")
    pairs = each_of(bounds, boxes, MAX_LAYERS)
    return pairs.selectExpr("raster_id", "layer_idx", f"NOT ({hit('a_')}) AND ({hit('o_')}) AS use_original")


def place(geoms: DataFrame, meta: DataFrame, cell: float = 4096.0, extent: tuple[float, ...] | None = None) -> DataFrame:
    """Geometries on every raster whose bounds they meet, vertices in pixel units.

    Coordinates are taken to be in the rasters' CRS; place_aligned sees to that.

    ``meta`` has raster_id, width, height, a, c, e, f. The pairing is an equality join on
    grid cells, so neither side is broadcast.
    """
    windows = meta.selectExpr(
        "raster_id", "width", "height", "a", "c", "e", "f", "least(c, c + width * a) AS tminx", "greatest(c, c + width * a) AS tmaxx",
        "least(f, f + height * e) AS tminy", "greatest(f, f + height * e) AS tmaxy")
    return bounds_overlap(geoms, windows, cell, extent).selectExpr(
        *FEATURE, "kind", "width", "height",
        "transform(parts, p -> transform(p, v -> named_struct('x', (v.x - c) / a, 'y', (v.y - f) / e))) AS parts")


def place_aligned(geoms: DataFrame, meta: DataFrame, cell: float = 4096.0) -> DataFrame:
    """place() in the CRS of each raster, ``meta.epsg``.

    A layer that misses a raster after alignment but hits it as written keeps its written
    coordinates there. ``cell`` is in metres; rasters in degrees get a grid of that size in degrees.
    """
    degree = float(HALF_WORLD.rstrip("D")) / 180
    cases = {"4326": cell / degree, "3857": cell, "cast(NULL AS int)": cell}  # no CRS, or one that isn't covered: as written
    metas = meta.withColumn("_crs", F.expr("CASE WHEN epsg IN (4326, 3857) THEN cast(epsg AS string) ELSE 'cast(NULL AS int)' END"))
    out = place(geoms.limit(0), meta, cell)
    for (crs,) in metas.select("_crs").distinct().collect():  # at most 3 rows
        here = metas.where(F.col("_crs") == crs)
        aligned = align_crs(geoms, crs)
        out = out.unionByName(place(aligned, here, cases[crs]))
        bounds = here.selectExpr("raster_id", "least(c, c + width * a) AS left", "greatest(c, c + width * a) AS right", "least(f, f + height * e) AS bottom", "greatest(f, f + height * e) AS top")
        back = cut(bounds_fallback(aligned, geoms, bounds).where("use_original").join(bounds, "raster_id"), "fallback")
        extent = tuple(back.agg(F.min("left"), F.min("bottom"), F.max("right"), F.max("top")).first())
        if extent[0] is not None:
            written = geoms.join(back.select("layer_idx").distinct(), "layer_idx", "left_semi")
            rasters = here.join(back.select("raster_id").distinct(), "raster_id", "left_semi")
            out = out.unionByName(place(written, rasters, cases[crs], extent).join(back, KEYS, "left_semi"))
    return out


def _segments(placed: DataFrame) -> DataFrame:
    """One row per edge of every part."""
    edges = "flatten(transform(parts, p -> CASE WHEN size(p) < 2 THEN array(struct(p[0] AS s, p[0] AS t)) ELSE transform(sequence(1, size(p) - 1), i -> struct(p[i-1] AS s, p[i] AS t)) END))"
    return placed.selectExpr(*FEATURE, "kind", "width", "height", f"explode({edges}) AS e").selectExpr(
        *FEATURE, "kind", "width", "height", "e.s.x AS x0", "e.s.y AS y0", "e.t.x AS x1", "e.t.y AS y1")


def _touched(segments: DataFrame) -> DataFrame:
    """Per row, the run of cells that a segment passes through."""
    rows = segments.where("least(y0, y1) < height AND greatest(y0, y1) >= 0").selectExpr(
        "*", "explode(sequence(cast(greatest(0, floor(least(y0, y1))) AS int), cast(least(height - 1, floor(greatest(y0, y1))) AS int))) AS row")
    at = lambda y: f"(CASE WHEN y1 = y0 THEN x0 ELSE x0 + ({y} - y0) * (x1 - x0) / (y1 - y0) END)"
    top, bottom = "greatest(cast(row AS double), least(y0, y1))", "least(cast(row + 1 AS double), greatest(y0, y1))"
    ends = rows.selectExpr(
        *FEATURE, "row", "width",
        f"CASE WHEN y1 = y0 THEN least(x0, x1) ELSE least({at(top)}, {at(bottom)}) END AS xa",
        f"CASE WHEN y1 = y0 THEN greatest(x0, x1) ELSE greatest({at(top)}, {at(bottom)}) END AS xb")
    return ends.selectExpr(*FEATURE, "row", "cast(greatest(0, floor(xa)) AS int) AS c0", "cast(least(width - 1, floor(xb)) AS int) AS c1").where("c0 <= c1")


def _interior(segments: DataFrame) -> DataFrame:
    """Per row, the runs of cells whose centre lies inside (even-odd rule over all rings)."""
    lines = segments.where("y0 <> y1").selectExpr(
        "*", "cast(greatest(0, ceil(least(y0, y1) - 0.5D)) AS int) AS first", "cast(least(height - 1, ceil(greatest(y0, y1) - 0.5D) - 1) AS int) AS last"
    ).where("first <= last").selectExpr("*", "explode(sequence(first, last)) AS row")
    cross = lines.selectExpr(*FEATURE, "row", "width", "x0 + (row + 0.5D - y0) * (x1 - x0) / (y1 - y0) AS x")
    order = W.partitionBy(*FEATURE, "row").orderBy("x")
    pairs = cross.withColumns({"n": F.row_number().over(order), "next": F.lead("x").over(order)}).where("n % 2 = 1 AND next IS NOT NULL")
    return pairs.selectExpr(*FEATURE, "row", "cast(greatest(0, ceil(x - 0.5D)) AS int) AS c0", "cast(least(width - 1, ceil(next - 0.5D) - 1) AS int) AS c1").where("c0 <= c1")


def rasterize(placed: DataFrame, by_feature: bool = False) -> DataFrame:
    """Runs of all touched cells per raster and layer (and feature, if asked)."""
    seg = _segments(placed)
    area = "kind NOT IN ('point', 'line')"
    runs = _touched(seg).unionByName(_interior(seg.where(area)))
    keys = FEATURE if by_feature else KEYS
    return rn.sweep(runs.select(*keys, "row", "c0", "c1", F.lit(1).alias("weight")), 1, keys)


def burned_pixels(runs: DataFrame, n_classes: int) -> DataFrame:
    """Top layer per pixel: later layers win; burn value is n_classes + layer + 1."""
    return rn.pixels_of(runs).groupBy("raster_id", "row", "col").agg(F.max("layer_idx").alias("layer_idx")).withColumn(
        "burn", F.col("layer_idx") + F.lit(n_classes + 1))


def overlay(rgb: DataFrame, runs: DataFrame, colours: DataFrame, n_classes: int) -> DataFrame:
    """Classified colours with the layers painted over them (all three bands).

    ``colours`` has layer_idx, r, g, b for the layers of the request.
    """
    paint = attach(burned_pixels(runs, n_classes), colours.selectExpr("layer_idx", "r AS pr", "g AS pg", "b AS pb"), ["layer_idx"], "inner")
    out = rgb.join(paint, ["raster_id", "row", "col"], "left")
    return out.withColumns({x: F.coalesce(f"p{x}", x) for x in "rgb"}).drop("pr", "pg", "pb")


def overlay_labels(labels: DataFrame, runs: DataFrame, n_classes: int) -> DataFrame:
    """Single-band variant: the burn value replaces the label."""
    return labels.join(burned_pixels(runs, n_classes), ["raster_id", "row", "col"], "left").withColumn(
        "label", F.coalesce("burn", "label")).drop("burn", "layer_idx")


def overlay_stats(runs: DataFrame, placed: DataFrame, meta: DataFrame, layers: DataFrame) -> DataFrame:
    """Burned pixels and geometries in bounds of every raster and layer, zeros included."""
    burned = runs.groupBy(*KEYS).agg(F.sum(F.expr("cast(c1 - c0 + 1 AS bigint)")).alias("pixels"))
    shapes = placed.groupBy(*KEYS).agg(F.countDistinct("feature_id").alias("shapes"))
    every = each_of(meta.select("raster_id"), layers.select("layer_idx"), MAX_LAYERS)
    return every.join(burned, KEYS, "left").join(shapes, KEYS, "left").fillna(0, ["pixels", "shapes"])
