"""Neighbourhood operators: windows over tiles that carry a halo of neighbours.

A pixel goes to its own tile and, near a border, to the neighbouring tiles; beyond the
image edge it is mirrored or left out. One shuffle on (raster, tile) then serves
both the row and the column window, because each is clustered within a tile. A tile is
bounded, so a raster that holds most of the data is still spread over all tasks.

Inputs carry ``raster_id, row, col, height, width``; rasters are dense grids.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window as W, functions as F

TILE = 512
KEYS = ["raster_id", "row", "col"]


def _row():
    return W.partitionBy("raster_id", "trow", "tcol", "row").orderBy("col")


def _col():
    return W.partitionBy("raster_id", "trow", "tcol", "col").orderBy("row")


def _positions(pos: str, size: str, k: int, edge: str) -> str:
    """All coordinates, up to ``k`` outside the image, at which a pixel is seen."""
    if edge == "clip":
        return f"array({pos})"
    if edge == "reflect":  # d c b a | a b c d | d c b a
        period, images = f"(2*{size})", f"array({pos} + {{p}}*j, {{p}}*j - 1 - {pos})"
    elif edge == "reflect101":  # d c b | a b c d | c b a
        period, images = f"greatest(1, 2*({size}-1))", f"array({pos} + {{p}}*j, {{p}}*j - {pos})"
    else:
        raise ValueError(f"edge mode {edge!r}")
    turns = f"cast({k} div {period} + 1 AS int)"
    seen = f"flatten(transform(sequence(-{turns}, {turns}), j -> {images.format(p=period)}))"
    return f"array_distinct(filter({seen}, v -> v BETWEEN -{k} AND {size}-1+{k}))"


def _placements(pos: str, size: str, k: int, edge: str, tile: int) -> str:
    """Array of (tile, coordinate) pairs of a pixel along one axis."""
    inner = f"{pos} % {tile} BETWEEN {k} AND {tile - 1 - k} AND {pos} > {k} AND {pos} < {size}-1-{k}"
    tiles = (
        f"sequence(cast(greatest(0, v-{k}) div {tile} AS int), "
        f"cast(least({size}-1, v+{k}) div {tile} AS int))"
    )
    return (
        f"CASE WHEN {inner} THEN array(named_struct('t', cast({pos} div {tile} AS int), 'v', {pos})) "
        f"ELSE flatten(transform({_positions(pos, size, k, edge)}, "
        f"v -> transform({tiles}, t -> named_struct('t', t, 'v', v)))) END"
    )


def with_halo(pixels: DataFrame, k: int, values: list[str], edge: str, tile: int = TILE) -> DataFrame:
    """Replicate pixels into tiles with a ``k`` wide halo and shuffle once by tile."""
    tile = max(tile, 2 * k + 1)
    out = pixels.selectExpr(
        "raster_id", "row", "col", "height", "width", *values,
        f"explode({_placements('row', 'height', k, edge, tile)}) AS pr",
    )
    out = out.selectExpr("*", f"explode({_placements('col', 'width', k, edge, tile)}) AS pc")
    plain = [v.split(" AS ")[-1] for v in values]
    out = out.selectExpr(
        "raster_id", "pr.t AS trow", "pc.t AS tcol", "pr.v AS row", "pc.v AS col", "height", "width", *plain,
        f"pr.v BETWEEN pr.t*{tile} AND least(height, (pr.t+1)*{tile})-1 AS in_row",
        f"pc.v BETWEEN pc.t*{tile} AND least(width, (pc.t+1)*{tile})-1 AS in_col",
    )
    return out.repartition("raster_id", "trow", "tcol")


def _sliding(name: str, k: int, window) -> F:
    if k <= 3:
        return F.sum(name).over(window.rowsBetween(-k, k))
    # Longer windows: difference of running sums, constant work per row.
    return F.lead(f"cum_{name}", k).over(window) - F.coalesce(F.lag(f"cum_{name}", k + 1).over(window), F.lit(0))


def _pass(df: DataFrame, names: list[str], k: int, window) -> DataFrame:
    if k > 3:
        running = window.rowsBetween(W.unboundedPreceding, 0)
        df = df.withColumns({f"cum_{n}": F.sum(n).over(running) for n in names})
    df = df.withColumns({f"box_{n}": _sliding(n, k, window) for n in names})
    return df.drop(*names, *[f"cum_{n}" for n in names]).withColumnsRenamed({f"box_{n}": n for n in names})


def box_sums(pixels: DataFrame, sums: dict[str, str], size: int, carry: list[str] = (), tile: int = TILE) -> DataFrame:
    """Sums over a size x size box with mirrored borders, one column per entry of ``sums``."""
    k = size // 2
    carry = list(carry)
    df = with_halo(pixels, k, carry + [f"{e} AS {n}" for n, e in sums.items()], "reflect", tile)
    df = _pass(df, list(sums), k, _row()).where("in_col")
    df = _pass(df, list(sums), k, _col()).where("in_row")
    return df.select(*KEYS, "height", "width", *carry, *sums)


def disk_widths(r: int) -> dict[int, int]:
    """Half-width of a disk at each row offset."""
    return {dy: math.isqrt(r * r - dy * dy) for dy in range(-r, r + 1)}


def neighbours(pixels: DataFrame, value: str, widths: dict[int, int], carry: list[str] = (), tile: int = TILE) -> DataFrame:
    """Column ``near``: the values under a row-convex footprint, clipped at the image edge."""
    k = max(max(widths), max(widths.values()))
    carry = list(carry)
    df = with_halo(pixels, k, carry + [f"{value} AS v"], "clip", tile)
    df = df.withColumns(
        {f"near_{w}": F.collect_list("v").over(_row().rowsBetween(-w, w)) for w in set(widths.values())}
    ).where("in_col")
    rows = [
        F.coalesce(F.lag(f"near_{w}", -dy).over(_col()), F.expr("filter(array(v), x -> false)"))
        if dy else F.col(f"near_{w}")
        for dy, w in sorted(widths.items())
    ]
    df = df.withColumn("near", F.concat(*rows)).where("in_row")
    return df.select(*KEYS, "height", "width", *carry, "near")


def rank_median(pixels: DataFrame, value: str, r: int, out: str, carry: list[str] = (), tile: int = TILE) -> DataFrame:
    """Element number floor(n/2) of the sorted values in a disk."""
    df = neighbours(pixels, value, disk_widths(r), carry, tile)
    return df.withColumn(out, F.expr("sort_array(near)[cast(size(near) div 2 AS int)]")).drop("near")


def majority(pixels: DataFrame, value: str, r: int, out: str, carry: list[str] = (), tile: int = TILE) -> DataFrame:
    """Most frequent value in a disk, the smallest on ties (suits nominal labels)."""
    df = neighbours(pixels, value, disk_widths(r), carry, tile)
    ranked = "transform(array_distinct(near), v -> struct(-size(filter(near, u -> u = v)) AS n, v AS v))"
    return df.withColumn(out, F.expr(f"array_min({ranked}).v")).drop("near")


def entropy(pixels: DataFrame, value: str, r: int, out: str, carry: list[str] = (), tile: int = TILE) -> DataFrame:
    """Shannon entropy (bits) of the value histogram in a disk."""
    df = neighbours(pixels, value, disk_widths(r), carry, tile)
    # One pass over the sorted values: H = sum(c * (log2(n) - log2(c))) / n over run lengths c.
    closed = "s.h + s.c * (log2(size(near)) - log2(s.c))"
    step = (
        "CASE WHEN s.v = x THEN named_struct('v', x, 'c', s.c + 1D, 'h', s.h) "
        f"ELSE named_struct('v', x, 'c', 1D, 'h', {closed}) END"
    )
    start = "named_struct('v', array_min(near), 'c', 0D, 'h', 0D)"
    bits = f"aggregate(sort_array(near), {start}, (s, x) -> {step}, s -> {closed}) / size(near)"
    return df.withColumn(out, F.expr(bits)).drop("near")


def gradient(pixels: DataFrame, value: str, carry: list[str] = (), tile: int = TILE) -> DataFrame:
    """Columns gy, gx: central differences, one-sided at the image edge."""
    carry = list(carry)
    df = with_halo(pixels, 1, carry + [f"{value} AS v"], "clip", tile)
    for name, window in (("gx", _row()), ("gy", _col())):
        before, after = F.lag("v").over(window), F.lead("v").over(window)
        df = df.withColumn(
            name,
            F.when(before.isNull() & after.isNull(), F.lit(0.0))
            .when(before.isNull(), after - F.col("v"))
            .when(after.isNull(), F.col("v") - before)
            .otherwise((after - before) / 2),
        )
    return df.where("in_row AND in_col").select(*KEYS, "height", "width", *carry, "gy", "gx")


def gaussian_kernel(size: int) -> list[float]:
    sigma = 0.3 * ((size - 1) / 2 - 1) + 0.8
    raw = [math.exp(-((i - size // 2) ** 2) / (2 * sigma * sigma)) for i in range(size)]
    return [w / sum(raw) for w in raw]


def gaussian(pixels: DataFrame, values: dict[str, str], size: int, carry: list[str] = (), tile: int = TILE) -> DataFrame:
    """Gaussian blur, mirrored without repeating the edge pixel."""
    k, kernel, carry = size // 2, gaussian_kernel(size), list(carry)
    df = with_halo(pixels, k, carry + [f"{e} AS {n}" for n, e in values.items()], "reflect101", tile)
    for window, keep in ((_row(), "in_col"), (_col(), "in_row")):
        df = df.withColumns({
            f"blur_{n}": sum(
                ((F.lag(n, k - i).over(window) if i != k else F.col(n)) * F.lit(w) for i, w in enumerate(kernel)),
                F.lit(0.0),
            )
            for n in values
        }).where(keep)
        df = df.drop(*values).withColumnsRenamed({f"blur_{n}": n for n in values})
    return df.select(*KEYS, "height", "width", *carry, *values)
