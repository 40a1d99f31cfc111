"""Run-length masks: set algebra, morphology, components, nearest sources.

A mask is a table of runs ``keys..., row, c0, c1`` (maximal, disjoint within a row). The
keys start with ``raster_id`` and may name more columns (a feature, a component). Work per
row is bounded by the raster's width.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import attach, bounded, by_sort, cut

KEYS = ["raster_id"]


def runs_of(pixels: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Maximal runs of a set of pixels."""
    order = W.partitionBy(*keys, "row").orderBy("col")
    island = pixels.select(*keys, "row", "col", (F.col("col") - F.row_number().over(order)).alias("island"))
    return island.groupBy(*keys, "row", "island").agg(F.min("col").alias("c0"), F.max("col").alias("c1")).drop("island")


def pixels_of(runs: DataFrame) -> DataFrame:
    return runs.withColumn("col", F.explode(F.sequence("c0", "c1"))).drop("c0", "c1")


def sweep(weighted: DataFrame, level: int | str, keys: list[str] = KEYS) -> DataFrame:
    """Runs where the weights of the covering intervals add up to at least ``level``.

    ``weighted`` has keys, row, c0, c1, weight. Interval ends are added up per position
    before the running sum, so overlapping copies cost nothing further.
    """
    ends = weighted.selectExpr(*keys, "row", "explode(array(struct(c0 AS pos, weight AS w), struct(c1 + 1 AS pos, -weight AS w))) AS e")
    ends = ends.repartition(*keys, "row").groupBy(*keys, "row", F.col("e.pos").alias("pos")).agg(F.sum("e.w").alias("w")).where("w <> 0")
    order = W.partitionBy(*keys, "row").orderBy("pos")
    cover = ends.withColumn("inside", F.sum("w").over(order.rowsBetween(W.unboundedPreceding, 0)) >= F.expr(str(level)))
    flips = cover.withColumn("was", F.coalesce(F.lag("inside").over(order), F.lit(False))).where("inside <> was")
    runs = flips.withColumn("stop", F.lead("pos").over(order)).where("inside")
    return runs.selectExpr(*keys, "row", "cast(pos AS int) AS c0", "cast(stop - 1 AS int) AS c1")


def _weighted(runs: DataFrame, weight: int, keys: list[str]) -> DataFrame:
    return runs.select(*keys, "row", "c0", "c1", F.lit(weight).alias("weight"))


def union(a: DataFrame, b: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return sweep(_weighted(a, 1, keys).unionByName(_weighted(b, 1, keys)), 1, keys)


def intersect(a: DataFrame, b: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return sweep(_weighted(a, 1, keys).unionByName(_weighted(b, 1, keys)), 2, keys)


def subtract(a: DataFrame, b: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return sweep(_weighted(a, 1, keys).unionByName(_weighted(b, -2, keys)), 1, keys)


def complement(runs: DataFrame, dims: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Background runs; ``dims`` gives keys, height, width of every raster in question."""
    full = dims.selectExpr(*keys, "explode(sequence(0, height - 1)) AS row", "0 AS c0", "width - 1 AS c1")
    return subtract(full, runs, keys)


# Footprints as half-widths per row offset.
def diamond(r: int) -> dict[int, tuple[int, int]]:
    """``r`` iterations of the 4-neighbour cross."""
    return {dy: (r - abs(dy), r - abs(dy)) for dy in range(-r, r + 1)}


def disk(r: int) -> dict[int, tuple[int, int]]:
    return {dy: (math.isqrt(r * r - dy * dy),) * 2 for dy in range(-r, r + 1)}


def rect(size: int) -> dict[int, tuple[int, int]]:
    k = size // 2
    return {dy: (k, size - 1 - k) for dy in range(-k, size - k)}


def ellipse(size: int) -> dict[int, tuple[int, int]]:
    """Elliptical structuring element of the image libraries (anchor at size div 2)."""
    k = c = size // 2
    out = {}
    for i in range(size):
        dy = i - k
        if abs(dy) <= k:
            dx = round(c * math.sqrt((k * k - dy * dy) / (k * k))) if k else 0
            out[dy] = (min(dx, k), min(dx, size - 1 - k))
    return out


def _copies(runs: DataFrame, footprint) -> DataFrame:
    """One copy of every run per footprint row."""
    rows = ", ".join(f"struct({dy} AS dy, {l} AS l, {r} AS r)" for dy, (l, r) in footprint.items())
    return runs.withColumn("s", F.explode(F.expr(f"array({rows})")))


def dilate(runs: DataFrame, footprint, dims: DataFrame | None = None, keys: list[str] = KEYS) -> DataFrame:
    """Cells from which the footprint reaches a mask cell, inside the image.

    ``runs`` carries height and width, or ``dims`` is joined for them.
    """
    df = runs if "height" in runs.columns else attach(runs, dims, ["raster_id"])
    moved = _copies(df, footprint).selectExpr(
        *keys, "row - s.dy AS row", "greatest(0, c0 - s.r) AS c0", "least(width - 1, c1 + s.l) AS c1", "1 AS weight", "height"
    ).where("row >= 0 AND row < height AND c0 <= c1").drop("height")
    return sweep(moved, 1, keys)


def erode(runs: DataFrame, footprint, dims: DataFrame | None = None, outside: bool = False, keys: list[str] = KEYS) -> DataFrame:
    """Cells whose whole footprint lies in the mask; ``outside`` is the value beyond the image."""
    df = runs if "height" in runs.columns else attach(runs, dims, ["raster_id"])
    if outside:
        lo, hi = "CASE WHEN c0 = 0 THEN 0 ELSE c0 + s.l END", "CASE WHEN c1 = width - 1 THEN width - 1 ELSE c1 - s.r END"
    else:
        lo, hi = "c0 + s.l", "c1 - s.r"
    moved = _copies(df, footprint).selectExpr(
        *keys, "row - s.dy AS row", f"{lo} AS c0", f"{hi} AS c1", "1 AS weight", "height"
    ).where("row >= 0 AND row < height AND c0 <= c1")
    if not outside:
        return sweep(moved.drop("height"), len(footprint), keys)
    # Rows of the footprint beyond the image count as covered: add their number up front.
    top, bottom = -min(footprint), max(footprint)
    beyond = f"greatest(0, {top} - row) + greatest(0, row + {bottom} - (height - 1))"
    capped = moved.groupBy(*keys, "row").agg(F.max("height").alias("height"), F.min("c0").alias("c0"), F.max("c1").alias("c1")).selectExpr(
        *keys, "row", "c0", "c1", f"{beyond} AS weight").where("weight > 0")
    return sweep(moved.drop("height").unionByName(capped), len(footprint), keys)


def opening(runs, footprint, dims, outside=True, keys=KEYS):
    dims = bounded(dims)
    return dilate(erode(runs, footprint, dims, outside, keys), footprint, dims, keys)


def closing(runs, footprint, dims, outside=True, keys=KEYS):
    dims = bounded(dims)
    return erode(dilate(runs, footprint, dims, keys), footprint, dims, outside, keys)


TILE = 512


def _local_components(keys: list[str], reach: int):
    """Smallest run id per component inside one bounded tile (union-find over its runs)."""

    def label(pdf):
        import numpy as np

        pdf = pdf.sort_values(["row", "c0"], ignore_index=True)
        row, c0, c1 = pdf["row"].to_numpy(), pdf["c0"].to_numpy(), pdf["c1"].to_numpy()
        parent = np.arange(len(pdf))

        def root(i):
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        starts = np.searchsorted(row, row - 1, "left")
        ends = np.searchsorted(row, row - 1, "right")
        for i in range(len(pdf)):
            first = starts[i] + np.searchsorted(c1[starts[i]:ends[i]], c0[i] - reach, "left")
            for j in range(first, ends[i]):
                if c0[j] > c1[i] + reach:
                    break
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
        roots = np.array([root(i) for i in range(len(pdf))], dtype=np.int64)
        pdf["local"] = pdf["id"].to_numpy()[roots] if len(pdf) else []
        return pdf

    return label


def _contract(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Component (smallest node) of every node by large-star / small-star rounds.

    Each round is written to the shared folder, so a lost executor repeats one round.
    """
    pair = lambda a, b: F.struct(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    edges = cut(edges.select(*keys, "u", "v").distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(*keys, "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, [*keys, "u"]).where("v > u").select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        ordered = large.select(*keys, pair("u", "v").alias("e")).select(*keys, "e.u", "e.v")
        low = ordered.groupBy(*keys, "u").agg(F.min("v").alias("m"))
        small = ordered.join(low, [*keys, "u"]).selectExpr(
            *keys, "explode(array(struct(u AS u, m AS v), struct(v AS u, m AS v))) AS e").select(*keys, "e.u", "e.v").where("u <> v").distinct()
        small = cut(small, "edges")
        changed = small.join(edges, [*keys, "u", "v"], "left_anti").limit(1).count() + edges.join(small, [*keys, "u", "v"], "left_anti").limit(1).count()
        edges = small
        if not changed:
            return edges.select(*keys, F.col("u").alias("local"), F.col("v").alias("comp"))


def components(runs: DataFrame, keys: list[str] = KEYS, connectivity: int = 4, tile: int = TILE) -> DataFrame:
    """Connected components: every run (split at tile borders) with its component ``comp``.

    Runs are labelled inside bounded tiles, then only the pairs that touch across tile
    borders are contracted. ``comp`` is row * 2^31 + col of the component's first run.
    """
    reach = 0 if connectivity == 4 else 1
    pieces = runs.selectExpr(*keys, "row", "c0", "c1", f"explode(sequence(cast(c0 div {tile} AS int), cast(c1 div {tile} AS int))) AS tcol").selectExpr(
        *keys, "row", f"greatest(c0, tcol * {tile}) AS c0", f"least(c1, tcol * {tile} + {tile - 1}) AS c1",
        f"cast(row div {tile} AS int) AS trow", "tcol",
    ).withColumn("id", F.expr("cast(row AS bigint) * 2147483648 + c0"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", local BIGINT"
    local = cut(pieces.groupBy(*keys, "trow", "tcol").applyInPandas(_local_components(keys, reach), schema), "tiles")
    side = lambda cond: local.where(cond).select(*keys, "row", "c0", "c1", "local", "trow", "tcol")
    right_of = lambda df: df.selectExpr(*keys, "row AS row2", "c0 AS d0", "c1 AS d1", "local AS v", "trow AS trow2", "tcol AS tcol2")
    touching = f"abs(row - row2) <= 1 AND c0 <= d1 + {reach} AND d0 <= c1 + {reach}"
    # Vertical neighbours across a tile row, one bucket per tile column they share.
    lower = right_of(side(f"row % {tile} = 0 AND row > 0")).withColumns({"br": F.expr("row2 - 1"), "bc": F.expr("tcol2")})
    upper = side(f"row % {tile} = {tile - 1}").withColumns({"br": F.col("row"), "bc": F.col("tcol")})
    pairs = upper.join(lower, [*keys, "br", "bc"]).where(touching)
    # Neighbours across a tile column, in the same row (and diagonal ones if asked).
    left = side(f"c1 % {tile} = {tile - 1}").withColumns({"bc": F.expr("tcol + 1")})
    spread = "array(0)" if connectivity == 4 else "array(-1, 0, 1)"
    left = left.withColumn("br", F.explode(F.expr(f"transform({spread}, d -> row + d)")))
    right = right_of(side(f"c0 % {tile} = 0 AND c0 > 0")).withColumns({"br": F.col("row2"), "bc": F.col("tcol2")})
    across = left.join(right, [*keys, "br", "bc"]).where(f"d0 = c1 + 1 AND abs(row - row2) <= {reach}")
    edges = pairs.select(*keys, F.col("local").alias("u"), "v").unionByName(across.select(*keys, F.col("local").alias("u"), "v")).where("u <> v")
    out = local.select(*keys, "row", "c0", "c1", "local")
    if edges.isEmpty():
        return out.withColumnRenamed("local", "comp")
    merged = _contract(edges, keys)
    return out.join(merged, [*keys, "local"], "left").select(*keys, "row", "c0", "c1", F.coalesce("comp", "local").alias("comp"))


def metrics(comps: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Area, bounding box, aspect and fill of every component."""
    return comps.groupBy(*keys, "comp").agg(
        F.sum(F.expr("cast(c1 - c0 + 1 AS bigint)")).alias("area"),
        F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("c0").alias("q0"), F.max("c1").alias("q1"),
    ).withColumns({"bh": F.expr("r1 - r0 + 1"), "bw": F.expr("q1 - q0 + 1")}).withColumns({
        "aspect": F.expr("greatest(bh, bw) / cast(least(bh, bw) AS double)"), "fill": F.expr("area / cast(bh * bw AS double)")})


def ring(comps: DataFrame, iterations: int, dims: DataFrame) -> DataFrame:
    """Runs around each component: its dilation without itself (raster_id, comp, row, c0, c1)."""
    keys = ["raster_id", "comp"]
    own = comps.select(*keys, "row", "c0", "c1")
    return subtract(dilate(own, diamond(iterations), dims, keys), own, keys)


def ring_stats(comps: DataFrame, labels: DataFrame, iterations: int, dims: DataFrame) -> DataFrame:
    """Label histogram of each component's ring: raster_id, comp, label, n."""
    cells = pixels_of(ring(comps, iterations, dims))
    return cells.join(by_sort(labels.select("raster_id", "row", "col", "label").where("label > 0")), ["raster_id", "row", "col"]).groupBy(
        "raster_id", "comp", "label").agg(F.count("*").alias("n"))


def fill_holes(runs: DataFrame, dims: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Mask with every background component filled that does not touch the image border."""
    back = components(complement(runs, dims, keys), keys, 4)
    sized = back.join(dims.select(*keys, "height", "width"), keys)
    open_ = F.max(F.expr("row = 0 OR row = height - 1 OR c0 = 0 OR c1 = width - 1"))
    holes = sized.groupBy(*keys, "comp").agg(open_.alias("open")).where("NOT open")
    return union(runs, back.join(holes, [*keys, "comp"], "left_semi"), keys)


ROWS = 8  # rows of a raster in one group of the row pass


def lower_envelope(columns: list[int], source_rows: list[int], row: int, height: int, width: int) -> tuple[list[int], list[int]]:
    """Which column's source is nearest from where on along a row: (first position, column index), ascending.

    Each column's nearest source is a parabola over the row. Costs order by squared distance, then
    source row, then source column, in one integer, so no two are equal.
    """
    unit = (height + 1) * (width + 1)
    starts, kept, bases = [], [], []
    for i, (c, r) in enumerate(zip(columns, source_rows)):
        base = unit * ((row - r) * (row - r) + c * c) + r * (width + 1) + c
        while kept:
            start = (base - bases[-1]) // (2 * unit * (c - columns[kept[-1]])) + 1  # from here on this one is nearer
            if start > starts[-1]:
                break
            starts.pop(), kept.pop(), bases.pop()
        starts.append(start if kept else -1)
        kept.append(i)
        bases.append(base)
    return starts, kept


def nearest_source(targets: DataFrame, pixels: DataFrame, source: str) -> DataFrame:
    """Nearest source pixel of every target: adds src_row, src_col (null when there is none).

    Minimises (squared distance, source row, source column), by a separable exact distance
    transform: the nearest source of each column by running last and first sources, then
    the lower envelope of the columns' parabolas along each row that has targets. Rows are
    as many as the cells of such rows, whatever the distances, and a raster without
    targets or sources is left out at once. ``pixels`` is the dense raster (raster_id, row,
    col, height, width) and ``source`` a condition over it.
    """
    todo = cut(targets.select("raster_id", "row", "col").distinct(), "targets")
    flagged = pixels.selectExpr("raster_id", "row", "col", "height", "width", f"({source}) AS src")
    has = flagged.where("src").select("raster_id").distinct().join(todo.select("raster_id").distinct(), "raster_id")
    rows = todo.select("raster_id", "row").distinct().withColumn("wanted", F.lit(True))
    cells = attach(attach(flagged, has, ["raster_id"], "inner"), rows, ["raster_id", "row"]).where("src OR wanted")
    column = W.partitionBy("raster_id", "col").orderBy("row")  # a raster's height at most
    seen = cells.withColumn("s", F.expr("CASE WHEN src THEN row END")).withColumns({
        "up": F.last("s", True).over(column.rowsBetween(W.unboundedPreceding, 0)),
        "down": F.first("s", True).over(column.rowsBetween(0, W.unboundedFollowing)),
    }).where("wanted AND (up IS NOT NULL OR down IS NOT NULL)").selectExpr(
        "raster_id", "row", "col", "height", "width", "CASE WHEN down IS NULL OR row - up <= down - row THEN up ELSE down END AS src_row", "false AS target")
    asking = attach(todo, has, ["raster_id"], "inner").selectExpr("raster_id", "row", "col", "0 AS height", "0 AS width", "cast(null AS int) AS src_row", "true AS target")

    def along(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row, part in pdf.groupby("row"):
            given, wanted = part[~part["target"]].sort_values("col"), part[part["target"]]
            if given.empty or wanted.empty:
                continue
            columns, found = given["col"].tolist(), given["src_row"].astype("int64").tolist()
            starts, kept = lower_envelope(columns, found, int(row), int(given["height"].iloc[0]), int(given["width"].iloc[0]))
            at = wanted["col"].to_numpy()
            best = [kept[i] for i in (np.searchsorted(starts, at, side="right") - 1).tolist()]
            out.append(pd.DataFrame({"raster_id": part["raster_id"].iloc[0], "row": row, "col": at, "src_row": [found[i] for i in best], "src_col": [columns[i] for i in best]}))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in ("raster_id", "row", "col", "src_row", "src_col")})

    keyed = seen.unionByName(asking).withColumn("block", F.expr(f"row div {ROWS}"))
    done = keyed.groupBy("raster_id", "block").applyInPandas(along, f"raster_id {pixels.schema['raster_id'].dataType.simpleString()}, row int, col int, src_row int, src_col int")
    return targets.join(by_sort(cut(done, "nearest")), ["raster_id", "row", "col"], "left")
