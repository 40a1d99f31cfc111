"""Repeatable sampling: rows are ordered by a hash of their key, never by chance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import attach

BUCKETS = 4096
PIXEL_HASH = "md5(concat_ws('/', raster_id, row, col))"


def hash_int(text: str, modulus: str) -> str:
    """Integer below ``modulus`` from the first 8 hex digits of a text's digest."""
    return f"cast(conv(substring(md5({text}), 1, 8), 16, 10) AS bigint) % ({modulus})"


def first_by_hash(df: DataFrame, keys: list[str], digest: str, k: int) -> DataFrame:
    """The ``k`` rows per key with the smallest digests, exact for any key size.

    Rows are counted per leading digits of the digest; rows outside the few buckets needed
    to reach k are dropped before any shuffle, and ranks are taken within a bucket, so a
    hot key never gathers in one task.
    """
    df = df.withColumn("_h", F.expr(digest)).withColumn("_b", F.expr("cast(conv(substring(_h, 1, 3), 16, 10) AS int)"))
    counts = df.groupBy(*keys, "_b").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    needed = counts.select(*keys, "_b", before.alias("_before")).where(f"_before < {k}")
    ranked = attach(df, needed, [*keys, "_b"], "inner")
    rank = F.row_number().over(W.partitionBy(*keys, "_b").orderBy("_h"))
    return ranked.withColumn("_n", F.col("_before") + rank).where(f"_n <= {k}").drop("_h", "_b", "_before", "_n")


def sample_windows(dims: DataFrame, grid: int = 16, win: int = 256, extra: int = 64) -> DataFrame:
    """Evenly spaced windows plus hash-placed ones per raster."""
    d = dims.withColumn("win", F.expr(f"least({win}, height, width)"))
    at = lambda i, n: f"cast(floor({i} * cast(({n} - win) AS double) / {max(1, grid - 1)}) AS int)"
    even = d.selectExpr("raster_id", "win", "height", "width", f"explode(sequence(0, {grid - 1})) AS i").selectExpr(
        "*", f"explode(sequence(0, {grid - 1})) AS j"
    ).selectExpr("raster_id", "win", f"i * {grid} + j AS win_id", f"{at('i', 'height')} AS w_row", f"{at('j', 'width')} AS w_col")
    text = lambda tag: f"concat_ws('/', raster_id, '{tag}', i)"
    place = lambda tag, n: f"cast({hash_int(text(tag), f'greatest(1, {n} - win)')} AS int)"
    loose = d.selectExpr("raster_id", "win", "height", "width", f"explode(sequence(0, {extra - 1})) AS i").selectExpr(
        "raster_id", "win", f"{grid * grid} + i AS win_id", f"{place('r', 'height')} AS w_row", f"{place('c', 'width')} AS w_col")
    return even.unionByName(loose)


def grid_window_sample(pixels: DataFrame, dims: DataFrame, n: int, grid: int = 16, win: int = 256, extra: int = 64) -> DataFrame:
    """A fixed number of pixels from each window, trimmed to ``n`` per raster.

    Pixels meet windows on a grid of window-sized cells (at most four per window).
    """
    per_window = max(32, n // (grid * grid + extra))
    windows = sample_windows(dims, grid, win, extra).selectExpr(
        "*", "explode(sequence(cast(w_row div win AS int), cast((w_row + win - 1) div win AS int))) AS cr"
    ).selectExpr("*", "explode(sequence(cast(w_col div win AS int), cast((w_col + win - 1) div win AS int))) AS cc")
    cells = dims.selectExpr("raster_id", f"least({win}, height, width) AS cell")
    placed = attach(pixels, cells, ["raster_id"], "inner").selectExpr("*", "cast(row div cell AS int) AS cr", "cast(col div cell AS int) AS cc")
    inside = attach(placed, windows, ["raster_id", "cr", "cc"], "inner").where(
        "row BETWEEN w_row AND w_row + win - 1 AND col BETWEEN w_col AND w_col + win - 1"
    ).drop("cr", "cc", "cell", "win", "w_row", "w_col")
    # A window is bounded, so a plain rank is safe here.
    order = W.partitionBy("raster_id", "win_id").orderBy(F.expr("md5(concat_ws('/', win_id, row, col))"))
    taken = inside.withColumn("_r", F.row_number().over(order)).where(f"_r <= {per_window}").drop("_r")
    return first_by_hash(taken, ["raster_id"], "md5(concat_ws('/', 'trim', win_id, row, col))", n)


def multi_raster_sample(pixels: DataFrame, n_total: int | None, n_rasters: int) -> DataFrame:
    """An equal share per raster (at least 4096), trimmed to ``n_total`` overall; all pixels without ``n_total``."""
    if n_total is None:
        return pixels
    share = first_by_hash(pixels, ["raster_id"], PIXEL_HASH, max(4096, n_total // max(1, n_rasters)))
    return first_by_hash(share.withColumn("_all", F.lit(0)), ["_all"], PIXEL_HASH, n_total).drop("_all")


def sample_size(height: str, width: str) -> str:
    return f"cast(least(2000000, greatest(100000, cast(floor(0.001D * {height} * {width}) AS bigint))) AS bigint)"


def select_representative(rasters: DataFrame, max_rasters: int | None = None) -> DataFrame:
    """Spatially spread subset of a catalogue (raster_id, left, bottom, right, top).

    One raster per cell of an aspect-aware grid over the centroids, the nearest to the
    cell centre; the budget is filled up in hash order.
    """
    import math

    c = rasters.selectExpr("raster_id", "(left + right) / 2 AS cx", "(bottom + top) / 2 AS cy")
    lo = c.agg(F.count("*").alias("n"), F.min("cx").alias("x0"), F.max("cx").alias("x1"), F.min("cy").alias("y0"), F.max("cy").alias("y1")).first()
    budget = min(lo.n, max(8, math.ceil(math.sqrt(lo.n))) if max_rasters is None else max_rasters)
    if lo.n <= budget:
        return c.select("raster_id")
    dx, dy = (lo.x1 - lo.x0) or 1.0, (lo.y1 - lo.y0) or 1.0
    ny = max(1, round(math.sqrt(budget / (dx / dy))))
    nx = max(1, round(budget / ny))
    cell = c.selectExpr(
        "*", f"least(cast((cx - {lo.x0}D) / {dx / nx}D AS int), {nx - 1}) AS ix", f"least(cast((cy - {lo.y0}D) / {dy / ny}D AS int), {ny - 1}) AS iy",
    ).withColumn("d2", F.expr(
        f"pow(cx - ({lo.x0}D + (ix + 0.5D) * {dx / nx}D), 2) + pow(cy - ({lo.y0}D + (iy + 0.5D) * {dy / ny}D), 2)"))
    picked = cell.groupBy("ix", "iy").agg(F.min(F.struct("d2", "raster_id")).alias("m")).select("m.raster_id")
    missing = budget - picked.count()
    if missing <= 0:
        return picked
    rest = c.select("raster_id").join(picked, "raster_id", "left_anti")
    return picked.unionByName(rest.orderBy(F.expr("md5(cast(raster_id AS string))"), "raster_id").limit(missing))
