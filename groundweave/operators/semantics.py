"""Semantic pixel masks and the 15 scores per cluster."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from ..session import attach, cut
from . import runs as rn
from .features import gradient_edges, p98, scaled
from .materials import SCORES

# Pixel classes over P98-scaled s1, s2, s3 (and s4).
MX, MN = "greatest(s1, s2, s3)", "least(s1, s2, s3)"
DERIVED = {
    "sat": f"({MX} - {MN}) / ({MX} + 1e-6D)",
    "exg": "2D * s2 - s1 - s3",
    "vari": "(s2 - s1) / (s2 + s1 - s3 + 1e-6D)",
    "mx": MX,
}
BASE_MASKS = {
    "m_achromatic": "sat < 0.15D",
    "m_dark_road": "sat < 0.20D AND mx > 0.10D AND mx < 0.60D AND exg < 0.06D",
    "m_gray": "sat < 0.16D AND mx > 0.12D AND mx < 0.86D",
}
MASKS = {
    "m_veg": "(exg > 0.06D AND s2 > s1 * 1.05D AND s2 > s3 * 1.03D AND sat > 0.10D AND mx > 0.10D AND NOT m_achromatic AND NOT m_dark_road) "
             "OR (s2 >= mx - 0.005D AND sat > 0.16D AND mx > 0.08D AND exg > 0.03D AND s2 > s3 AND NOT m_achromatic) "
             "OR (vari > 0.08D AND sat > 0.14D AND mx > 0.10D AND s2 >= s1 AND NOT m_achromatic AND NOT m_dark_road)",
    "m_dry": "s1 > s2 * 1.04D AND s1 > s3 * 1.10D AND s3 < s2 * 1.12D AND sat < 0.30D AND mx > 0.20D AND exg < 0.04D",
    "m_sand": "(s1 > s2 * 1.05D AND s1 > s3 * 1.18D AND s2 >= s3 AND sat < 0.36D AND mx > 0.32D AND exg < 0.01D) "
              "OR (s1 >= s2 AND s1 > s3 * 1.12D AND s2 >= s3 AND sat < 0.15D AND mx > 0.52D AND exg < -0.01D)",
    "m_dry_grass": "s1 > s3 * 1.08D AND s2 > s3 * 1.05D AND s1 < s2 * 1.18D AND sat > 0.07D AND mx > 0.18D AND exg > -0.05D AND exg < 0.12D",
    "m_lush": "s2 >= mx - 0.005D AND exg > 0.08D AND sat > 0.14D AND mx > 0.18D AND s1 < s2 * 1.05D",
    "m_dark_gray": "m_gray AND mx < 0.46D",
    "m_achro_road": "(m_achromatic OR m_dark_road) AND mx > 0.10D AND mx < 0.80D",
    "m_warm": "s1 > s3 * 1.12D AND s1 >= s2 * 0.90D AND sat > 0.04D AND mx > 0.15D AND exg < 0.06D",
    "m_blue_dom": "s3 > s2 + 0.03D AND s3 > s1 + 0.03D AND mx > 0.08D",
}
WATER4 = "(s2 - s4) / (s2 + s4 + 1e-6D) > 0.05D AND sat < 0.30D AND mx > 0.06D"
WATER3 = ("(s3 - greatest(s1, s2) > 0.03D AND sat < 0.35D AND s3 > 0.10D AND s1 < 0.55D) OR (mx < 0.28D AND sat < 0.22D AND s3 >= s1 AND s3 >= s2) "
          "OR (s3 >= mx - 0.005D AND sat > 0.06D AND mx > 0.10D AND s1 < 0.55D)")
MASK_NAMES = [*BASE_MASKS, *MASKS, "m_water", "m_edge"]


def stride_sample(pixels: DataFrame, budget: int) -> DataFrame:
    """Every s-th row and column, re-indexed, with s such that about ``budget`` pixels of a raster are left."""
    df = pixels.withColumn("_s", F.expr(f"cast(greatest(1, floor(sqrt(cast(height AS double) * width / {budget}))) AS int)"))
    df = df.where("row % _s = 0 AND col % _s = 0")
    up = lambda n: F.expr(f"cast(({n} + _s - 1) div _s AS int)")
    return df.withColumns({
        "row": F.expr("cast(row div _s AS int)"), "col": F.expr("cast(col div _s AS int)"), "height": up("height"), "width": up("width"),
    }).drop("_s")


def semantic_masks(pixels: DataFrame, carry: list[str] = (), four_bands: bool = True) -> DataFrame:
    """The pixel classes of every pixel, as boolean columns."""
    bands = ["b1", "b2", "b3"] + (["b4"] if four_bands else [])
    df = attach(pixels, p98(pixels), ["raster_id"])
    df = df.withColumns({f"s{b[1:]}": F.expr(scaled(b)) for b in bands})
    s = [f"s{b[1:]}" for b in bands]
    df = gradient_edges(df, "0.299D * s1 + 0.587D * s2 + 0.114D * s3", [*carry, *s]).withColumnRenamed("edge", "m_edge")
    df = df.withColumns({n: F.expr(e) for n, e in DERIVED.items()}).withColumns({n: F.expr(e) for n, e in BASE_MASKS.items()})
    df = df.withColumns({n: F.expr(e) for n, e in MASKS.items()} | {"m_water": F.expr(WATER4 if four_bands else WATER3)})
    return df.select("raster_id", "row", "col", "height", "width", *carry, *MASK_NAMES)


def _cluster_runs(labels: DataFrame) -> DataFrame:
    return rn.components(rn.runs_of(labels.where("label > 0"), ["raster_id", "label"]), ["raster_id", "label"])


def continuity_scores(labels: DataFrame) -> DataFrame:
    """Elongated (road-like) and compact (water-like) continuity per raster and label."""
    m = rn.metrics(_cluster_runs(labels), ["raster_id", "label"])
    sums = m.groupBy("raster_id", "label").agg(
        F.sum("area").alias("total"),
        F.sum(F.expr("CASE WHEN area >= 28 AND aspect >= 3.0D AND fill <= 0.78D THEN area ELSE 0 END")).alias("elongated"),
        F.max(F.expr("CASE WHEN area >= 40 THEN area ELSE 0 END")).alias("main"),
        F.sum(F.expr("CASE WHEN area >= 40 AND fill >= 0.38D AND aspect <= 3.5D THEN area ELSE 0 END")).alias("compact"),
    )
    return sums.selectExpr(
        "raster_id", "label",
        "CASE WHEN total < 80 THEN 0D ELSE least(1D, elongated / cast(total AS double) * 1.4D) END AS cont",
        "CASE WHEN total < 120 THEN 0D ELSE least(1D, 0.55D * (main / cast(total AS double)) + 0.45D * (compact / cast(total AS double))) END AS water_cont",
    )


def _clip(expr: str) -> str:
    return f"least(1D, greatest(0D, {expr}))"


# Scores from mask fractions (f_*) and continuities, in order.
SCORE_FORMULAS = [
    ("road", "greatest(0.30D * f_gray + 0.30D * f_achro_road + 0.40D * cont, CASE WHEN f_gray >= 0.55D THEN 0.65D * f_gray ELSE 0D END, "
             "CASE WHEN f_achro_road >= 0.40D THEN 0.80D * f_achro_road ELSE 0D END)"),
    ("asphalt", "(0.25D * f_gray + 0.25D * f_dark_gray + 0.25D * f_achro_road + 0.25D * road) "
                "* (1D - 1.40D * greatest(0D, f_veg - 0.60D * f_gray - 0.40D * f_achro_road)) * (1D - 0.60D * f_sand)"),
    ("line", "0.65D * f_edge + 0.35D * cont"),
    ("water", "0.45D * f_water + 0.55D * water_cont"),
    ("dry", "0.70D * f_dry + 0.30D * f_warm * (1D - water) - 0.40D * f_gray"),
    ("sand", "(0.65D * f_sand + 0.35D * f_dry) * (1D - 0.90D * f_lush) * (1D - 0.75D * f_veg) * (1D - 0.75D * water) * (1D - 0.40D * road) "
             "* (1D - 0.45D * greatest(0D, f_dry_grass - f_sand))"),
    ("grass", "f_lush * (1D - 0.70D * f_sand) * (1D - 0.60D * f_dry)"),
    ("water_conf", "least(1D, water * 1.20D) * (CASE WHEN f_water >= 0.22D OR water_cont >= 0.40D THEN 1D ELSE 0.45D END) * (1D - 0.65D * road) "
                   "* (1D - 0.60D * asphalt) * (1D - 0.45D * line) * (CASE WHEN f_warm >= 0.20D THEN greatest(0D, 1D - 1.8D * f_warm) ELSE 1D END)"),
    ("veg", "f_veg * (1D - 0.40D * road) * (1D - 0.65D * water) * (1D - 0.50D * dry) "
            "* (1D - least(1D, 0.90D * f_gray + 0.50D * f_dark_gray + 1.20D * f_achro_road))"),
]


def semantic_scores(pixels: DataFrame, k: int, four_bands: bool = True, budget: int | None = None) -> DataFrame:
    """The 15 scores of every cluster 1..k per raster; an empty cluster scores 0.

    ``pixels`` has bands, label, height and width. All pixels count; with ``budget`` rasters are
    stride-sampled to about that many.
    """
    sampled = stride_sample(pixels, budget) if budget else pixels
    masks = semantic_masks(sampled, ["label"], four_bands).where("label > 0")
    shares = masks.groupBy("raster_id", "label").agg(
        F.count("*").alias("px"), *[F.avg(F.col(m).cast("double")).alias(f"f{m[1:]}") for m in MASK_NAMES])
    shares = cut(shares, "shares")
    df = shares.join(continuity_scores(sampled), ["raster_id", "label"])
    total = shares.groupBy("raster_id").agg(F.sum("px").alias("total"))
    df = df.join(total, "raster_id")
    for name, formula in SCORE_FORMULAS:
        df = df.withColumn(name, F.expr(_clip(formula)))
    df = df.selectExpr("raster_id", "label", "px", *[n for n, _ in SCORE_FORMULAS], "f_gray AS gray", "f_dark_gray AS dark_gray",
                       "f_achro_road AS achro", "f_warm AS warm", "px / cast(total AS double) AS size", "f_blue_dom AS blue_dom")
    every = pixels.select("raster_id").distinct().selectExpr("raster_id", f"explode(sequence(1, {k})) AS label")
    return every.join(df, ["raster_id", "label"], "left").fillna(0.0, SCORES).fillna(0, ["px"]).select(
        "raster_id", F.col("label").alias("cluster"), "px", *SCORES)


def avg_semantics(scores: DataFrame) -> DataFrame:
    """Pixel-weighted mean of the scores over rasters; ``pixels`` is the full count per cluster."""
    return scores.groupBy("cluster").agg(
        F.sum("pixels").alias("pixels"),
        *[F.coalesce(F.sum(F.col(s) * F.col("pixels")) / F.nullif(F.sum("pixels"), F.lit(0)), F.lit(0.0)).alias(s) for s in SCORES])


def scene_prior(pixels: DataFrame, classes: DataFrame, metres: str, radius_m: float = 90.0, grid: int = 4, stride: tuple[int, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """Open weight per raster from regular zones, and the blended material priors.

    ``metres`` is the ground size of a pixel (SQL). Small rasters are one zone. All pixels of a
    zone count; ``stride`` thins zones and small rasters to about so many pixels. Returns
    (weights: raster_id, zones, open_weight ..., priors: model_id, material, prior).
    """
    from .materials import blended_priors, open_fractions
    from ..functions.stats import small_domain_percentile

    df = pixels.withColumn("radius", F.expr(f"cast(greatest(20, least(140, floor({radius_m}D / greatest(0.01D, {metres})))) AS int)"))
    df = df.withColumn("tiny", F.expr("height < 2 * radius + 1 OR width < 2 * radius + 1"))
    # Zone centres are evenly spaced; a pixel lies in the zones whose square holds it.
    centre = lambda n: f"transform(sequence(0, {grid - 1}), i -> cast(floor(radius + i * cast({n} - 2 * radius - 1 AS double) / {grid - 1}) AS int))"
    hit = lambda p, n: f"filter(transform({centre(n)}, (c, i) -> struct(i AS i, c - radius AS at)), z -> {p} BETWEEN z.at AND z.at + 2 * radius)"
    zoned = df.where("NOT tiny").selectExpr("*", f"explode({hit('row', 'height')}) AS zr").selectExpr(
        "*", f"explode({hit('col', 'width')}) AS zc",
        f"cast(greatest(1, floor(sqrt((2 * radius + 1) * (2 * radius + 1) / {stride[0]}.0D))) AS int) AS s" if stride else "1 AS s",
    ).where("(row - zr.at) % s = 0 AND (col - zc.at) % s = 0").selectExpr("raster_id", f"zr.i * {grid} + zc.i AS zone", "b1", "b2", "b3")
    whole = df.where("tiny").withColumn("s", F.expr(f"cast(greatest(1, floor(sqrt(cast(height AS double) * width / {stride[1]}.0D))) AS int)" if stride else "1")).where(
        "row % s = 0 AND col % s = 0").selectExpr("raster_id", "0 AS zone", "b1", "b2", "b3")
    zones = zoned.unionByName(whole)
    key = ["raster_id", "zone"]
    scale = small_domain_percentile(zones.selectExpr(*key, "explode(array(b1, b2, b3)) AS v"), key, "v", 0.98, "p").selectExpr(
        *key, "greatest(p, 1.0D) AS scale")
    lit = attach(zones, scale, key).withColumns({f"s{i}": F.expr(scaled(f"b{i}")) for i in (1, 2, 3)})
    per_zone = open_fractions(lit, key)
    weights = per_zone.groupBy("raster_id").agg(
        F.count("*").alias("zones"), *[F.avg(c).alias(c) for c in ("open_weight", "veg", "soil", "gray")])
    weights = cut(weights, "prior")
    return weights, blended_priors(weights.withColumnRenamed("raster_id", "model_id"), classes)
