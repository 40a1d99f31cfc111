"""Per-pixel features: projections over bands, and the feature table built from flags."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.stats import percentile, small_domain_percentile
from ..session import attach, cut
from .focal import KEYS, box_sums, entropy, gaussian, gradient

EPS = "1e-6D"
GRAY = "((b1 + b2 + b3) / 3.0D)"
NDVI = f"((b4 - b3) / (b4 + b3 + {EPS}))"
NDWI = f"((b2 - b4) / (b2 + b4 + {EPS}))"
EXG = "(2.0D * b2 - b1 - b3)"
LUMA = "(0.299D * b1 + 0.587D * b2 + 0.114D * b3)"
SATURATION = f"((greatest(b1, b2, b3) - least(b1, b2, b3)) / (greatest(b1, b2, b3) + {EPS}))"
_VARI_DEN = "cast(b2 + b1 - b3 AS double)"
VARI = f"greatest(-1D, least(1D, (b2 - b1) / (CASE WHEN abs({_VARI_DEN}) < {EPS} THEN {EPS} ELSE {_VARI_DEN} END)))"
# Gray of the detectors, in the fixed-point form of 8-bit image libraries.
GRAY8 = "cast((b1 * 4899 + b2 * 9617 + b3 * 1868 + 8192) div 16384 AS int)"


def spectral_mean(pixels: DataFrame, bands: list[str], size: int = 3, carry: list[str] = ()) -> DataFrame:
    df = box_sums(pixels, {f"mean_{b}": b for b in bands}, size, carry)
    return df.withColumns({f"mean_{b}": F.col(f"mean_{b}") / F.lit(size * size) for b in bands})


def std_from_sums(s1: str, s2: str, n: int, scale: int = 1) -> str:
    """Population deviation from a sum and a sum of squares of ``scale`` times the value."""
    return f"sqrt(greatest(0D, ({n} * {s2} - {s1} * {s1}) / ({scale * scale}.0D * {n * n})))"


def texture_std(pixels: DataFrame, size: int = 3, carry: list[str] = ()) -> DataFrame:
    """Deviation of gray in a box; integer bands keep the sums exact."""
    total = "cast(b1 + b2 + b3 AS bigint)"
    df = box_sums(pixels, {"s1": total, "s2": f"{total} * {total}"}, size, carry)
    return df.withColumn("texture", F.expr(std_from_sums("s1", "s2", size * size, 3))).drop("s1", "s2")


def local_entropy(pixels: DataFrame, carry: list[str] = (), decimate_above: int | None = None) -> DataFrame:
    """Entropy of gray stretched to 8 bits, over a disk of radius 2.

    With ``decimate_above``, rasters of more pixels are sampled 2x first and the values repeated.
    """
    stretch = attach(
        pixels,
        pixels.groupBy("raster_id").agg(F.min(F.expr(GRAY)).alias("lo"), F.max(F.expr(GRAY)).alias("hi")),
        ["raster_id"],
    ).withColumns({
        "gray8": F.expr(f"CASE WHEN hi > lo THEN cast(floor(({GRAY} - lo) / (hi - lo) * 255.0D) AS int) ELSE 0 END"),
        "step": F.expr(f"CASE WHEN cast(height AS bigint) * width > {decimate_above} THEN 2 ELSE 1 END" if decimate_above else "1"),
    })
    coarse = stretch.where("row % step = 0 AND col % step = 0").selectExpr(
        "raster_id", "cast(row div step AS int) AS row", "cast(col div step AS int) AS col",
        "cast((height + step - 1) div step AS int) AS height", "cast((width + step - 1) div step AS int) AS width",
        "height AS full_height", "width AS full_width", "step", "gray8",
    )
    out = entropy(coarse, "gray8", 2, "entropy", ["full_height", "full_width", "step"])
    out = out.selectExpr(
        "raster_id", "entropy", "col", "full_height", "full_width", "step",
        "explode(sequence(row * step, least(full_height, (row + 1) * step) - 1)) AS full_row",
    ).selectExpr(
        "raster_id", "full_row AS row", "entropy",
        "explode(sequence(col * step, least(full_width, (col + 1) * step) - 1)) AS col",
    )
    return pixels.select(*KEYS, *carry).join(out, KEYS)


DEFAULT_FLAGS = {"spectral": True, "texture": True, "indices": True, "color_indices": True, "entropy": False}


def feature_columns(flags: dict[str, bool], bands: list[str]) -> list[str]:
    """Ordered feature names for the given flags."""
    rgb = len(bands) >= 3
    out = []
    if flags.get("spectral"):
        out += [f"f_{b}" for b in bands]
    if flags.get("texture"):
        out.append("f_texture")
    if flags.get("indices") and len(bands) >= 4:
        out.append("f_ndvi")
    if flags.get("color_indices") and rgb:
        out += ["f_vari", "f_saturation"]
    if flags.get("entropy"):
        out.append("f_entropy")
    return out or ["f_raw"]


def feature_table(pixels: DataFrame, flags: dict[str, bool], bands: list[str], carry: list[str] = ()) -> DataFrame:
    """Feature columns of every pixel; all box sums share one shuffle."""
    names = feature_columns(flags, bands)
    carry = list(carry)
    keep = [c for c in dict.fromkeys(["b1", *bands, *carry])]
    sums = {f"s_{b}": b for b in bands if f"f_{b}" in names}
    if "f_texture" in names:
        gray = "cast(b1 + b2 + b3 AS bigint)" if len(bands) >= 3 else "cast(b1 AS bigint)"
        sums |= {"t1": gray, "t2": f"{gray} * {gray}"}
    df = box_sums(pixels, sums, 3, keep) if sums else pixels.select(*KEYS, "height", "width", *keep)
    exprs = {f"f_{b}": f"s_{b} / 9.0D" for b in bands} | {
        "f_texture": std_from_sums("t1", "t2", 9, 3 if len(bands) >= 3 else 1),
        "f_ndvi": NDVI, "f_vari": VARI, "f_saturation": SATURATION, "f_raw": "cast(b1 AS double)",
    }
    df = df.withColumns({n: F.expr(exprs[n]) for n in names if n != "f_entropy"})
    if "f_entropy" in names:
        df = df.join(local_entropy(pixels).withColumnRenamed("entropy", "f_entropy"), KEYS)
    return df.select(*KEYS, "height", "width", *carry, *names)


def p98(pixels: DataFrame, keys: list[str] = ("raster_id",), bands: list[str] = ("b1", "b2", "b3")) -> DataFrame:
    """98th percentile over all RGB values per key, at least 1."""
    values = pixels.selectExpr(*keys, f"explode(array({', '.join(bands)})) AS v")
    return small_domain_percentile(values, list(keys), "v", 0.98, "p").selectExpr(
        *keys, "greatest(p, 1.0D) AS scale"
    )


def scaled(band: str) -> str:
    return f"least(1D, greatest(0D, {band} / scale))"


def p98_scale(pixels: DataFrame, bands: list[str] = ("b1", "b2", "b3")) -> DataFrame:
    """Bands divided by the raster's P98 and clipped to 0..1, as s1, s2 ..."""
    df = attach(pixels, p98(pixels), ["raster_id"])
    return df.withColumns({f"s{b[1:]}": F.expr(scaled(b)) for b in bands})


def gradient_edges(pixels: DataFrame, luma: str, carry: list[str] = (), level: float = 0.30) -> DataFrame:
    """Gradient magnitude over its P95, clipped, and the edge flag."""
    df = gradient(pixels, luma, carry).withColumn("magnitude", F.expr("sqrt(gx * gx + gy * gy)"))
    scale = percentile(df, ["raster_id"], "magnitude", 0.95, "p95").selectExpr("raster_id", "greatest(p95, 1e-6D) AS p95")
    return attach(df, scale, ["raster_id"]).withColumn(
        "strength", F.expr("least(1D, magnitude / p95)")
    ).withColumn("edge", F.expr(f"strength > {level}")).drop("gx", "gy", "p95")


def hsv8(pixels: DataFrame) -> DataFrame:
    """8-bit hue (0..179), saturation and value of integer RGB."""
    df = pixels.withColumns({"v": F.greatest("b1", "b2", "b3"), "lo": F.least("b1", "b2", "b3")})
    return df.withColumns({
        "h": F.expr(
            "CASE WHEN v = lo THEN 0 ELSE cast(rint(pmod(CASE "
            "WHEN v = b1 THEN 60.0D * (b2 - b3) / (v - lo) "
            "WHEN v = b2 THEN 120.0D + 60.0D * (b3 - b1) / (v - lo) "
            "ELSE 240.0D + 60.0D * (b1 - b2) / (v - lo) END, 360.0D) / 2) AS int) % 180 END"
        ),
        "s": F.expr("CASE WHEN v = 0 THEN 0 ELSE cast(rint((v - lo) * 255.0D / v) AS int) END"),
    }).drop("lo")


def gaussian_std(pixels: DataFrame, size: int = 11, carry: list[str] = ()) -> DataFrame:
    df = gaussian(pixels, {"m1": f"cast({GRAY8} AS double)", "m2": f"cast({GRAY8} * {GRAY8} AS double)"}, size, carry)
    return df.withColumn("std", F.expr("sqrt(greatest(m2 - m1 * m1, 0D))")).drop("m1", "m2")


def segment_features(pixels: DataFrame, segment: str = "segment", bands: list[str] = ("b1", "b2", "b3", "b4")) -> DataFrame:
    """Per-segment band means, gray deviation and mean NDVI."""
    return pixels.groupBy("raster_id", segment).agg(
        *[F.avg(b).alias(f"mean_{b}") for b in bands],
        F.stddev_pop(F.expr("b1 + b2 + b3")).alias("gray_std3"),
        F.avg(F.expr(NDVI)).alias("ndvi"),
    ).withColumn("gray_std", F.col("gray_std3") / 3).drop("gray_std3")


def superpixels(pixels: DataFrame, bands: list[str] = ("b1", "b2", "b3"), n_segments: int | None = None,
                compactness: float = 0.01, rounds: int = 10) -> DataFrame:
    """Segment number of every pixel: k-means in colour and position around grid seeds.

    A pixel may join the seeds of its own grid cell and the eight around it. The few
    centres are copied to their neighbour cells and packed per cell, so a pixel meets them
    in one equality join and no pair becomes a row.
    """
    bands = list(bands)
    target = str(n_segments) if n_segments else "greatest(5000, cast(height AS bigint) * width div 200)"
    px = pixels.selectExpr(
        *KEYS, *[f"cast({b} AS double) AS {b}" for b in bands],
        f"cast(greatest(1, floor(sqrt(cast(height AS double) * width / ({target})))) AS int) AS step",
        "height", "width",
    ).selectExpr("*", "cast(row div step AS int) AS gr", "cast(col div step AS int) AS gc",
                 "cast((width + step - 1) div step AS int) AS across")
    px = cut(px, "cells")
    dims_of = ["raster_id", "cell"]

    def centres(labelled):
        means = [F.avg(c).alias(c) for c in ("row", "col", *bands)]
        return labelled.groupBy("raster_id", "segment").agg(*means, F.max("step").alias("step"), F.max("across").alias("across"))

    labelled = px.withColumn("segment", F.expr("gr * across + gc"))
    for _ in range(rounds):
        c = centres(labelled).withColumn("c", F.struct("segment", "row", "col", *bands))
        near = c.selectExpr("raster_id", "c", "across", "cast(segment div across AS int) AS r", "cast(segment % across AS int) AS q",
                            "explode(array(-1, 0, 1)) AS dr").selectExpr("*", "explode(array(-1, 0, 1)) AS dc").where(
            "q + dc BETWEEN 0 AND across - 1 AND r + dr >= 0")
        packed = near.groupBy("raster_id", F.expr("(r + dr) * across + q + dc").alias("cell")).agg(F.collect_list("c").alias("cs"))  # at most 9
        colour = " + ".join(f"(c.{b} - {b}) * (c.{b} - {b})" for b in bands)
        dist = f"((c.row - row) * (c.row - row) + (c.col - col) * (c.col - col)) / cast(step * step AS double) + ({colour}) / {compactness * compactness!r}D"
        best = f"array_min(transform(cs, c -> struct({dist} AS d, c.segment AS s))).s"
        labelled = cut(px.withColumn("cell", F.expr("gr * across + gc")).join(packed, dims_of).withColumn("segment", F.expr(best)).drop("cell", "cs"), "segments")
    return labelled.select(*KEYS, "segment")
