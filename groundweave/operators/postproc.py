"""Clean-up of label rasters: smoothing, shadows, small patches, road objects.

Pixels carry raster_id, row, col, height, width, label and, where colours matter, bands.
Every function returns raster_id, row, col, label of all pixels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.palette import BUILDING_NAMES, PROTECTED_WORDS, ROAD_NAMES
from ..session import attach, bounded, by_sort, cut
from . import runs as rn
from .features import NDVI, SATURATION
from .focal import KEYS, box_sums, majority, rank_median

BRIGHT = "((b1 + b2 + b3) / 3.0D)"
STRUCTURE = f"({BRIGHT} > 150 OR {NDVI} > 0.3D)"


class Labels:
    """Label ids of the class groups the rules speak of (a class list has at most 30 entries)."""

    def __init__(self, classes: DataFrame):
        names = {r["name"]: r["class_idx"] for r in classes.select("name", "class_idx").collect()}
        of = lambda wanted: sorted(names[n] for n in wanted if n in names)
        self.building, self.road = of(BUILDING_NAMES), of(ROAD_NAMES)
        self.asphalt = names.get("BM_ASPHALT")
        self.water = of(["BM_WATER"])
        self.protected = sorted(i for n, i in names.items() if any(w in n for w in PROTECTED_WORDS))


def in_ids(ids: list[int], col: str = "label") -> str:
    return f"{col} IN ({', '.join(map(str, ids))})" if ids else "false"


def raster_dims(px: DataFrame) -> DataFrame:
    return bounded(px.groupBy("raster_id").agg(F.first("height").alias("height"), F.first("width").alias("width")))


def repaint(px: DataFrame, changes: DataFrame) -> DataFrame:
    """Labels with the changed pixels (raster_id, row, col, new) replaced."""
    return px.select(*KEYS, "label").join(by_sort(changes.select(*KEYS, "new")), KEYS, "left").select(*KEYS, F.coalesce("new", "label").alias("label"))


def smooth(px: DataFrame, smoothing: str) -> DataFrame:
    """``median_1`` .. ``median_5``: rank median over a disk; ``mode_r``: majority; anything else: unchanged."""
    kind, _, radius = smoothing.partition("_")
    if kind not in ("median", "mode") or not radius.isdigit() or int(radius) < 1:
        return px.select(*KEYS, "label")
    step = rank_median if kind == "median" else majority
    return step(px, "label", int(radius), "label").select(*KEYS, "label")


def shadow_balance(px: DataFrame, window: int = 61, ratio: float = 0.62, strength: float = 0.80, min_px: int = 120, bands: int = 2) -> DataFrame:
    """Locally brightened shadow pixels; as many bands are corrected as asked (2 or 3)."""
    names, n = ["b1", "b2", "b3"], window * window
    carry = names + [b for b in px.columns if b == "b4"]
    dims = raster_dims(px)
    local = box_sums(px, {"s": "cast(b1 + b2 + b3 AS bigint)"}, window, carry)
    dark = cut(local.where(f"{BRIGHT} < {ratio}D * (s / {3 * n}.0D) AND {SATURATION} < 0.25D AND {BRIGHT} > 5").select(*KEYS), "dark")
    comps = rn.components(rn.runs_of(dark))
    big = comps.join(rn.metrics(comps).where(f"area >= {min_px}").select("raster_id", "comp"), ["raster_id", "comp"], "left_semi")
    shadow = rn.pixels_of(big.drop("comp")).withColumn("shadow", F.lit(1))
    flagged = px.select(*KEYS, "height", "width", *carry).join(by_sort(shadow), KEYS, "left").fillna(0, ["shadow"])
    fixed = names[:bands]
    sums = {"w": "1 - shadow", **{f"m_{b}": f"CASE WHEN shadow = 1 THEN 0 ELSE {b} END" for b in fixed}}
    out = box_sums(flagged, sums, window, [*carry, "shadow"])
    for b in fixed:
        gain = f"least(4D, greatest(0.5D, (m_{b} / {n}.0D) / greatest(w / {n}.0D, 1e-6D) / greatest(cast({b} AS double), 0.01D)))"
        value = f"{strength}D * ({b} * {gain}) + {1.0 - strength!r}D * {b}"
        out = out.withColumn(b, F.expr(f"CASE WHEN shadow = 1 THEN cast(floor(least(255D, greatest(0D, {value}))) AS int) ELSE {b} END"))
    return out.select(*KEYS, *carry)


def shadow_candidates(px: DataFrame, classes: DataFrame, radius: int = 5, brightness: int = 100) -> DataFrame:
    """Runs of likely cast shadows near structures, without small compact context blobs."""
    ids, dims = Labels(classes), raster_dims(px)
    structures = rn.runs_of(px.where(STRUCTURE))
    near = rn.dilate(structures, rn.diamond(radius), dims)
    local = box_sums(px, {"s": "cast(b1 + b2 + b3 AS bigint)"}, 11, ["b1", "b2", "b3", "b4", "label"])
    dark = local.where(f"{BRIGHT} < least({brightness}, s / 363.0D * 0.72D) AND {SATURATION} < 0.20D AND NOT {STRUCTURE}")
    dark = dark.where(f"NOT ({in_ids(ids.water)})")
    cand = cut(rn.intersect(rn.runs_of(dark), near), "shadow")
    context = sorted(set(ids.building + ids.road))
    if not context:
        return cand
    comps = rn.components(cand)
    small = comps.join(
        rn.metrics(comps).where("area BETWEEN 4 AND 160 AND aspect <= 5.0D AND fill >= 0.20D").select("raster_id", "comp", "area"), ["raster_id", "comp"])
    small = cut(small, "blobs")
    around = rn.pixels_of(rn.dilate(rn.runs_of(px.where(in_ids(context))), rn.diamond(3), dims))
    hits = rn.pixels_of(small.select("raster_id", "comp", "area", "row", "c0", "c1")).join(around, KEYS, "left_semi").groupBy("raster_id", "comp").agg(
        F.count("*").alias("hits"), F.first("area").alias("area")).where("hits >= 0.75D * area")
    inside = small.join(hits.select("raster_id", "comp"), ["raster_id", "comp"], "left_semi")
    share = rn.ring_stats(inside, px, 2, dims).groupBy("raster_id", "comp").agg(
        F.sum("n").alias("all"), F.sum(F.expr(f"CASE WHEN {in_ids(context)} THEN n ELSE 0 END")).alias("ctx")).where("ctx >= 0.5D * all")
    blobs = inside.join(share, ["raster_id", "comp"], "left_semi")
    return rn.subtract(cand, blobs)


def _take_nearest(px: DataFrame, targets: DataFrame, source: str) -> DataFrame:
    """New label of every target: that of its nearest source pixel."""
    near = rn.nearest_source(targets, px, source).where("src_row IS NOT NULL")
    src = px.selectExpr("raster_id", "row AS src_row", "col AS src_col", "label AS new")
    return near.join(by_sort(src), ["raster_id", "src_row", "src_col"]).select(*KEYS, "new")


def shadow_infer(px: DataFrame, candidates: DataFrame, classes: DataFrame) -> DataFrame:
    """Candidates take the nearest solid material; without any in the raster, the nearest label."""
    ids = Labels(classes)
    cells = cut(rn.pixels_of(candidates).select(*KEYS), "cand")
    flagged = px.select(*KEYS, "height", "width", "label").join(by_sort(cells.withColumn("cand", F.lit(True))), KEYS, "left")
    flagged = cut(flagged.withColumn("solid", F.expr(f"cand IS NULL AND label > 0 AND NOT ({in_ids(ids.protected)})")), "flagged")
    solid = flagged.groupBy("raster_id").agg(F.max("solid").alias("any_solid"))
    flagged = attach(flagged, solid, ["raster_id"])
    return repaint(px, _take_nearest(flagged, cells, "solid OR (NOT any_solid AND label > 0)"))


def road_opening(px: DataFrame, classes: DataFrame, radius: int = 2) -> DataFrame:
    """Thin road pieces take the nearest non-road label; rasters with under 10 road pixels stay."""
    road, dims = in_ids(Labels(classes).road), raster_dims(px)
    enough = px.where(road).groupBy("raster_id").count().where("count >= 10").select("raster_id")
    runs = cut(rn.runs_of(px.where(road).join(enough, "raster_id", "left_semi")), "road")
    removed = rn.pixels_of(rn.subtract(runs, rn.opening(runs, rn.disk(radius), dims)))
    return repaint(px, _take_nearest(px, removed, f"NOT ({road})"))


def absorb_small_patches(px: DataFrame, classes: DataFrame, max_px: int = 80, connectivity_on: str = "any_label") -> DataFrame:
    """Small patches take the nearest kept label, unless their majority class is protected.

    ``any_label``: patches of labelled pixels; ``same_label``: patches of one label.
    """
    keys = ["raster_id"] if connectivity_on == "any_label" else ["raster_id", "label"]
    comps = rn.components(rn.runs_of(px.where("label > 0"), keys), keys)
    small = cut(rn.pixels_of(comps.join(rn.metrics(comps, keys).where(f"area <= {max_px}").select(*keys, "comp"), [*keys, "comp"], "left_semi")), "small")
    counts = small.drop("label").join(by_sort(px.select(*KEYS, "label")), KEYS).groupBy("raster_id", "comp", "label").count() if keys == ["raster_id"] \
        else small.groupBy("raster_id", "comp", "label").count()
    major = counts.groupBy("raster_id", "comp").agg(F.min(F.expr("struct(-count AS n, label AS label)")).alias("m")).select("raster_id", "comp", "m.label")
    gone = major.where(f"NOT ({in_ids(Labels(classes).protected)})").select("raster_id", "comp")
    cells = cut(small.join(gone, ["raster_id", "comp"], "left_semi").select(*KEYS), "absorb")
    flagged = px.select(*KEYS, "height", "width", "label").join(by_sort(cells.withColumn("gone", F.lit(True))), KEYS, "left")
    return repaint(px, _take_nearest(cut(flagged, "flagged"), cells, "gone IS NULL AND label > 0"))


def _cap(px: DataFrame, current: DataFrame, candidates: DataFrame, shape: str, iterations: int, group: list[int], share: float, dims: DataFrame) -> DataFrame:
    """Blobs of the given shape, ringed by a class group, take the ring's main class of it."""
    comps = rn.components(rn.runs_of(candidates.select(*KEYS)))
    comps = cut(comps.join(rn.metrics(comps).where(shape).select("raster_id", "comp"), ["raster_id", "comp"], "left_semi"), "blobs")
    stats = rn.ring_stats(comps, current, iterations, dims)
    member = in_ids(group)
    target = stats.groupBy("raster_id", "comp").agg(
        F.sum("n").alias("all"), F.sum(F.expr(f"CASE WHEN {member} THEN n ELSE 0 END")).alias("hit"),
        F.min(F.expr(f"CASE WHEN {member} THEN struct(-n AS n, label AS label) END")).alias("m"),
    ).where(f"hit >= {share}D * all AND m IS NOT NULL").selectExpr("raster_id", "comp", "m.label AS new")
    return repaint(current, rn.pixels_of(comps.join(target, ["raster_id", "comp"])))


def _context(px: DataFrame, dims: DataFrame, ids: list[int], reach: int, carry: list[str]) -> DataFrame:
    """Pixels within ``reach`` of a class group, with the 15-wide mean brightness ``mean``."""
    near = rn.pixels_of(rn.dilate(rn.runs_of(px.where(in_ids(ids))), rn.diamond(reach), dims))
    local = box_sums(px, {"s": "cast(b1 + b2 + b3 AS bigint)"}, 15, carry).withColumn("mean", F.expr("s / 675.0D"))
    return local.join(near, KEYS, "left_semi")


_CARRY = ["b1", "b2", "b3", "label"]


def cap_windows(px, classes, current=None, min_px=4, max_px=150) -> DataFrame:
    """Dark compact blobs near buildings become the surrounding building class."""
    ids, dims = Labels(classes), raster_dims(px)
    cand = _context(px, dims, ids.building, 4, _CARRY).where(
        f"{BRIGHT} < mean * 0.68D AND NOT ({in_ids(ids.building)}) AND NOT ({in_ids(ids.protected)})")
    shape = f"area BETWEEN {min_px} AND {max_px} AND aspect <= 4.5D AND fill >= 0.25D"
    return _cap(px, current or px, cand, shape, 2, ids.building, 0.50, dims)


def cap_road_features(px, classes, current=None, min_px=4, max_px=250) -> DataFrame:
    """Bright or contrasting blobs on roads become the surrounding road class."""
    ids, dims = Labels(classes), raster_dims(px)
    mean = px.where(in_ids(ids.road)).groupBy("raster_id").agg(F.avg(F.expr(BRIGHT)).alias("road_mean"))
    near = attach(_context(px, dims, ids.road, 2, _CARRY), mean, ["raster_id"])
    cand = near.where(
        f"({BRIGHT} > road_mean * 1.30D OR (abs({BRIGHT} - mean) > mean * 0.22D AND NOT ({in_ids(ids.road)}))) "
        f"AND NOT ({in_ids(ids.protected)}) AND NOT ({in_ids(ids.building)})")
    return _cap(px, current or px, cand, f"area BETWEEN {min_px} AND {max_px}", 2, ids.road, 0.55, dims)


def cap_facades(px, classes, current=None, min_px=150, max_px=600) -> DataFrame:
    """Medium dark strips next to buildings become the surrounding building class."""
    ids, dims = Labels(classes), raster_dims(px)
    cand = _context(px, dims, ids.building, 4, _CARRY).where(
        f"{BRIGHT} < mean * 0.75D AND NOT ({in_ids(sorted(set(ids.building + ids.road)))}) AND NOT ({in_ids(ids.protected)})")
    return _cap(px, current or px, cand, f"area BETWEEN {min_px} AND {max_px} AND aspect >= 1.8D", 3, ids.building, 0.45, dims)


def cap_contextual_features(px: DataFrame, classes: DataFrame) -> DataFrame:
    """Windows, then road features, then facades; masks come from the given labels."""
    current = cut(cap_windows(px, classes), "windows")
    current = cut(cap_road_features(px, classes, current), "road")
    return cap_facades(px, classes, current)


def object_limits(metres: float) -> tuple[int, int, int]:
    """Least and largest object size and largest gap, in pixels."""
    area = max(metres, 0.01) ** 2
    return max(2, int(0.30 / area)), max(20, int(18.0 / area)), max(4, int(1.5 / area))


def enclose_objects(px: DataFrame, classes: DataFrame, metres: float = 0.5, ring: int = 3, share: float = 0.70) -> DataFrame:
    """Small objects enclosed by asphalt become asphalt.

    The ring must be mostly asphalt (or road) and touch one or two asphalt bodies inside
    the object's padded box.
    """
    ids, dims = Labels(classes), raster_dims(px)
    if ids.asphalt is None:
        return px.select(*KEYS, "label")
    low, high, _ = object_limits(metres)
    blocked = in_ids(sorted(set(ids.road + ids.protected)))
    comps = rn.components(rn.runs_of(px.where(f"label > 0 AND NOT ({blocked})")))
    box = cut(rn.metrics(comps).where(f"area BETWEEN {low} AND {high}"), "objects")
    comps = cut(comps.join(box.select("raster_id", "comp"), ["raster_id", "comp"], "left_semi"), "objects")
    cells = rn.pixels_of(rn.ring(comps, ring, dims)).join(by_sort(px.select(*KEYS, "label").where("label > 0")), KEYS)
    cells = cut(cells, "ring")
    enclosed = cells.groupBy("raster_id", "comp").agg(
        F.count("*").alias("all"), F.sum(F.expr(f"CASE WHEN label = {ids.asphalt} THEN 1 ELSE 0 END")).alias("a"),
        F.sum(F.expr(f"CASE WHEN {in_ids(ids.road)} THEN 1 ELSE 0 END")).alias("r")).where(f"a >= {share}D * all OR r >= 0.85D * all")
    # Asphalt runs inside each remaining object's padded box, labelled per object.
    pad = ring + 1
    frame = box.join(enclosed.select("raster_id", "comp"), ["raster_id", "comp"], "left_semi").selectExpr(
        "raster_id", "comp", f"q0 - {pad} AS left", f"q1 + {pad} AS right", f"explode(sequence(r0 - {pad}, r1 + {pad})) AS row")
    asphalt = rn.runs_of(px.where(f"label = {ids.asphalt}"))
    local = asphalt.join(frame, ["raster_id", "row"]).where("c1 >= left AND c0 <= right").selectExpr(
        "raster_id", "comp AS object", "row", "greatest(c0, left) AS c0", "least(c1, right) AS c1")
    bodies = rn.pixels_of(rn.components(local, ["raster_id", "object"]))
    touched = bodies.join(cells.select("raster_id", F.col("comp").alias("object"), "row", "col"), ["raster_id", "object", "row", "col"]).groupBy(
        "raster_id", "object").agg(F.count_distinct("comp").alias("n")).where("n BETWEEN 1 AND 2").selectExpr("raster_id", "object AS comp")
    return repaint(px, rn.pixels_of(comps.join(touched, ["raster_id", "comp"], "left_semi")).withColumn("new", F.lit(ids.asphalt)))


def infill_gaps(px: DataFrame, classes: DataFrame, metres: float = 0.5) -> DataFrame:
    """Small gaps that closing the asphalt mask (2 iterations) would fill become asphalt."""
    ids, dims = Labels(classes), raster_dims(px)
    if ids.asphalt is None:
        return px.select(*KEYS, "label")
    asphalt = cut(rn.runs_of(px.where(f"label = {ids.asphalt}")), "asphalt")
    closed = rn.closing(asphalt, rn.diamond(2), dims, outside=False)
    keep = rn.runs_of(px.where(in_ids(ids.protected)))
    comps = rn.components(rn.subtract(rn.subtract(closed, asphalt), keep))
    gaps = comps.join(rn.metrics(comps).where(f"area <= {object_limits(metres)[2]}").select("raster_id", "comp"), ["raster_id", "comp"], "left_semi")
    return repaint(px, rn.pixels_of(gaps).withColumn("new", F.lit(ids.asphalt)))


def remove_road_objects(px: DataFrame, classes: DataFrame, metres: float = 0.5) -> DataFrame:
    """Objects, then gaps; adds ``changed``."""
    size = px.select(*KEYS, "height", "width")
    first = cut(size.join(enclose_objects(px, classes, metres), KEYS), "objects")
    out = infill_gaps(first, classes, metres)
    return out.join(px.select(*KEYS, F.col("label").alias("before")), KEYS).withColumn("changed", F.expr("label <> before")).drop("before")


def material_area(labels: DataFrame, classes: DataFrame, meta: DataFrame) -> DataFrame:
    """Pixels and square metres per raster and material."""
    counts = labels.groupBy("raster_id", F.col("label").alias("class_idx")).agg(F.count("*").alias("pixels"))
    named = counts.join(F.broadcast(classes.select("class_idx", "name", "material_type")), "class_idx")
    return named.join(meta.select("raster_id", "a", "e"), "raster_id").selectExpr(
        "raster_id", "name AS material", "material_type", "pixels", "pixels * abs(a * e) AS square_m")


def area_rollup(areas: DataFrame) -> DataFrame:
    """Sub-totals per raster and material type."""
    return areas.rollup("raster_id", "material_type", "material").agg(F.sum("pixels").alias("pixels"), F.sum("square_m").alias("square_m"))
