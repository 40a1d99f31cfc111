"""Tiling, resampling and grid alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.geo import latitude, longitude, mercator_x, mercator_y, next_pow2, with_bbox


def pixel_to_world(pixels: DataFrame) -> DataFrame:
    """World coordinates of the pixel corner; pixels carry the affine a, c, e, f."""
    return pixels.withColumns({"x": F.expr("c + col * a"), "y": F.expr("f + row * e")})


def tile_windows(meta: DataFrame, size: int, overlap: int) -> DataFrame:
    """Overlapping windows, clipped at the right and bottom edge."""
    step = max(1, size - max(0, overlap))
    return meta.selectExpr(
        "raster_id", "height", "width", f"explode(sequence(0, height - 1, {step})) AS row"
    ).selectExpr(
        "raster_id", "row", "height", "width", f"explode(sequence(0, width - 1, {step})) AS col"
    ).selectExpr(
        "raster_id", "row", "col", f"least({size}, height - row) AS h", f"least({size}, width - col) AS w"
    )


def read_write_windows(meta: DataFrame, size: int = 1024, overlap: int = 102) -> DataFrame:
    """Disjoint write windows inside read windows that reach half the overlap further."""
    step, half = size - overlap, overlap // 2
    return meta.selectExpr(
        "raster_id", "height", "width", f"explode(sequence(0, height - 1, {step})) AS w_row"
    ).selectExpr(
        "*", f"explode(sequence(0, width - 1, {step})) AS w_col"
    ).selectExpr(
        "raster_id", "w_row", "w_col",
        f"least({step}, height - w_row) AS w_h", f"least({step}, width - w_col) AS w_w",
        f"greatest(w_row - {half}, 0) AS r_row", f"greatest(w_col - {half}, 0) AS r_col",
        f"least(w_row + {step + half}, height) AS r_bottom", f"least(w_col + {step + half}, width) AS r_right",
    ).selectExpr(
        "raster_id", "w_row", "w_col", "w_h", "w_w", "r_row", "r_col", "r_bottom - r_row AS r_h",
        "r_right - r_col AS r_w", "w_row - r_row AS inner_row", "w_col - r_col AS inner_col",
    )


def read_tiles(pixels: DataFrame, size: int = 1024, overlap: int = 102) -> DataFrame:
    """Pixels copied into every read window that holds them, with tile-local positions.

    The window is computed from the pixel's own position, so no join is needed. The
    tile is part of ``raster_id``; ``inner`` marks the pixels of the write window.
    """
    step, half = size - overlap, overlap // 2
    def span(pos, length):
        first = f"greatest(0, cast(ceil(({pos} - {step + half} + 1) / {step}.0D) AS int))"
        last = f"least(cast(({length} - 1) div {step} AS int), cast(({pos} + {half}) div {step} AS int))"
        return f"sequence({first}, {last})"
    out = pixels.selectExpr("*", f"explode({span('row', 'height')}) AS trow")
    out = out.selectExpr("*", f"explode({span('col', 'width')}) AS tcol")
    out = out.selectExpr(
        "*", f"greatest(trow * {step} - {half}, 0) AS r0", f"greatest(tcol * {step} - {half}, 0) AS q0",
    )
    return out.withColumns({
        "inner": F.expr(f"row div {step} = trow AND col div {step} = tcol"),
        "source_id": F.col("raster_id"), "source_row": F.col("row"), "source_col": F.col("col"),
    }).withColumns({
        "raster_id": F.expr("concat_ws('/', source_id, trow, tcol)"),
        "row": F.expr("row - r0"), "col": F.expr("col - q0"),
        "height": F.expr(f"least(trow * {step} + {step + half}, height) - r0"),
        "width": F.expr(f"least(tcol * {step} + {step + half}, width) - q0"),
    }).drop("trow", "tcol", "r0", "q0")


def auto_tile_size(meta: DataFrame, max_pixels: str) -> DataFrame:
    return meta.withColumn("tile_size", F.expr(
        f"least(greatest(128, cast(floor(sqrt(greatest(16384, {max_pixels}))) AS int)), greatest(height, width))"
    ))


def assign_tiles(pixels: DataFrame, size: int, halo: int) -> DataFrame:
    """Every pixel in each tile whose window, widened by the halo, holds it."""
    def span(pos, length):
        return (
            f"sequence(cast(greatest(0, {pos} - {halo}) div {size} AS int), "
            f"cast(least({length} - 1, {pos} + {halo}) div {size} AS int))"
        )
    return pixels.selectExpr("*", f"explode({span('row', 'height')}) AS trow").selectExpr(
        "*", f"explode({span('col', 'width')}) AS tcol"
    ).withColumn("inner", F.expr(f"row div {size} = trow AND col div {size} = tcol"))


def bbox_cells(df: DataFrame, cell: float, prefix: str = "") -> DataFrame:
    """One row per grid cell that a bounding box meets."""
    return df.selectExpr(
        "*", f"explode(sequence(cast(floor({prefix}minx / {cell}D) AS bigint), cast(floor({prefix}maxx / {cell}D) AS bigint))) AS gx"
    ).selectExpr(
        "*", f"explode(sequence(cast(floor({prefix}miny / {cell}D) AS bigint), cast(floor({prefix}maxy / {cell}D) AS bigint))) AS gy"
    )


def bounds_overlap(geoms: DataFrame, windows: DataFrame, cell: float, extent: tuple[float, ...] | None = None) -> DataFrame:
    """Pairs of non-empty geometries and windows whose boxes meet.

    Both sides are put on a grid, so the join has an equality key; a pair is kept only
    in the first cell the two boxes share. Windows carry tminx, tminy, tmaxx, tmaxy. With an
    ``extent`` that holds all windows, boxes of geometries are cut to it first.
    """
    g = with_bbox(geoms.where("size(flatten(parts)) > 0"))
    if extent:
        x0, y0, x1, y1 = (f"{v!r}D" for v in extent)
        g = g.where(f"maxx >= {x0} AND minx <= {x1} AND maxy >= {y0} AND miny <= {y1}").withColumns({
            "minx": F.expr(f"greatest(minx, {x0})"), "miny": F.expr(f"greatest(miny, {y0})"), "maxx": F.expr(f"least(maxx, {x1})"), "maxy": F.expr(f"least(maxy, {y1})")})
    g = bbox_cells(g, cell)
    w = bbox_cells(windows, cell, "t")
    return g.join(w, ["gx", "gy"]).where(
        "maxx >= tminx AND minx <= tmaxx AND maxy >= tminy AND miny <= tmaxy"
    ).where(
        f"gx = cast(floor(greatest(minx, tminx) / {cell}D) AS bigint) AND gy = cast(floor(greatest(miny, tminy) / {cell}D) AS bigint)"
    ).drop("gx", "gy")


def thumbnail(pixels: DataFrame, max_side: int = 256, bands: list[str] = ("b1", "b2", "b3")) -> DataFrame:
    """Average-resampled copy whose longer side is ``max_side`` (or smaller rasters enlarged never)."""
    scale = f"(greatest(height, width) / {max_side}.0D)"
    df = pixels.withColumns({
        "out_h": F.expr(f"least(height, greatest(1, cast(height / {scale} AS int)))"),
        "out_w": F.expr(f"least(width, greatest(1, cast(width / {scale} AS int)))"),
    })
    return df.groupBy(
        "raster_id", F.expr("cast(row * out_h div height AS int)").alias("row"), F.expr("cast(col * out_w div width AS int)").alias("col")
    ).agg(*[F.avg(b).alias(b) for b in bands], F.max("out_h").alias("height"), F.max("out_w").alias("width"))


def preview(pixels: DataFrame, stats: DataFrame, max_dim: int, uint8: bool, bands: list[str] = ("b1", "b2", "b3")) -> DataFrame:
    """Nearest-picked preview; non-8-bit bands are stretched over their common range.

    ``stats`` has the raster's lo and hi over the picked bands; alpha is 0 where all bands are 0.
    """
    df = preview_pick(pixels, max_dim, bands).join(stats, "raster_id")
    value = lambda b: f"cast({b} AS double)" if uint8 else f"CASE WHEN hi > lo THEN ({b} - lo) / (hi - lo) * 255.0D ELSE 0D END"
    df = df.withColumns({b: F.expr(f"cast(floor(least(255D, greatest(0D, {value(b)}))) AS int)") for b in bands})
    return df.withColumn("alpha", F.expr(f"CASE WHEN {' AND '.join(b + ' = 0' for b in bands)} THEN 0 ELSE 255 END")).drop("lo", "hi")


def preview_pick(pixels: DataFrame, max_dim: int, bands: list[str]) -> DataFrame:
    """Nearest pixel of every preview cell (cell centre mapped back, floored)."""
    scale = f"least({max_dim}.0D / width, {max_dim}.0D / height, 1.0D)"
    df = pixels.withColumns({
        "out_h": F.expr(f"greatest(1, cast(height * {scale} AS int))"), "out_w": F.expr(f"greatest(1, cast(width * {scale} AS int))"),
    })
    centre = lambda i, n, out: f"cast(floor((2 * ({i}) + 1) * cast({n} AS bigint) / (2.0D * {out})) AS int)"
    df = df.selectExpr(
        "*", "cast(row * cast(out_h AS bigint) div height AS int) AS prow", "cast(col * cast(out_w AS bigint) div width AS int) AS pcol"
    )
    return df.where(f"row = {centre('prow', 'height', 'out_h')} AND col = {centre('pcol', 'width', 'out_w')}").selectExpr(
        "raster_id", "prow AS row", "pcol AS col", *bands
    )


def pad_pow2(meta: DataFrame) -> DataFrame:
    return meta.withColumns({"pad_height": F.expr(next_pow2("height")), "pad_width": F.expr(next_pow2("width"))})


def pad_cells(meta: DataFrame) -> DataFrame:
    """Cells that the padding adds at the right and bottom, with label 0."""
    padded = pad_pow2(meta)
    right = padded.where("pad_width > width").selectExpr(
        "raster_id", "explode(sequence(0, height - 1)) AS row", "width", "pad_width"
    ).selectExpr("raster_id", "row", "explode(sequence(width, pad_width - 1)) AS col")
    below = padded.where("pad_height > height").selectExpr(
        "raster_id", "explode(sequence(height, pad_height - 1)) AS row", "pad_width"
    ).selectExpr("raster_id", "row", "explode(sequence(0, pad_width - 1)) AS col")
    return right.unionByName(below).withColumn("label", F.lit(0))


def wgs84_grid(meta: DataFrame) -> DataFrame:
    """Destination grid for 3857 rasters: same cell counts over the geographic bounds."""
    return meta.selectExpr(
        "raster_id", "height", "width", "a", "c", "e", "f",
        f"{longitude('c')} AS west", f"{longitude('c + width * a')} AS east",
        f"{latitude('f')} AS north", f"{latitude('f + height * e')} AS south",
    )


def reproject_nearest(labels: DataFrame, meta: DataFrame) -> DataFrame:
    """Nearest-neighbour copy of label rasters (3857) on a 4326 grid.

    Every destination cell centre is mapped back to one source cell, then joined on it.
    """
    cells = wgs84_grid(meta).selectExpr("*", "explode(sequence(0, height - 1)) AS row").selectExpr(
        "*", "explode(sequence(0, width - 1)) AS col"
    ).selectExpr(
        "raster_id", "row", "col", "height", "width", "a", "c", "e", "f",
        "west + (col + 0.5D) * (east - west) / width AS lon", "north - (row + 0.5D) * (north - south) / height AS lat",
    ).selectExpr(
        "raster_id", "row", "col",
        f"cast(floor(({mercator_y('lat')} - f) / e) AS int) AS src_row", f"cast(floor(({mercator_x('lon')} - c) / a) AS int) AS src_col",
    )
    src = labels.selectExpr("raster_id", "row AS src_row", "col AS src_col", "label")
    return cells.join(src, ["raster_id", "src_row", "src_col"], "left").selectExpr(
        "raster_id", "row", "col", "coalesce(label, 0) AS label"
    )


def align_mask(target: DataFrame, mask: DataFrame, mask_meta: DataFrame, how: str = "inner") -> DataFrame:
    """Target pixels whose centre falls on a mask cell of another grid.

    Target carries the affine a, c, e, f; ``mask_meta`` has ma, mc, me, mf per raster.
    """
    df = target.join(mask_meta, "raster_id").withColumns({
        "m_row": F.expr("cast(floor((f + (row + 0.5D) * e - mf) / me) AS int)"),
        "m_col": F.expr("cast(floor((c + (col + 0.5D) * a - mc) / ma) AS int)"),
    })
    cells = mask.selectExpr("raster_id", "row AS m_row", "col AS m_col", "true AS hit")
    out = df.join(cells, ["raster_id", "m_row", "m_col"], "left" if how == "left" else "inner")
    return out.drop("ma", "mc", "me", "mf")
