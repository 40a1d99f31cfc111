"""Cluster-to-material mapping: costs, penalties, assignment, guard rails.

Everything is keyed by ``model_id``, so that many rasters or models are mapped in one
job. A model has at most 30 clusters and 13 materials; tables of that size are
broadcast, pixels never take part.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import rules
from ..session import each_of
from ..functions.palette import (
    OVERLAY_CANDIDATES, OVERLAY_FALLBACK, PRIOR_DEFAULT, PRIOR_OPEN, PRIOR_URBAN, preset_classes, sql_list,
)

SCORES = ["veg", "road", "water", "asphalt", "line", "water_conf", "dry", "sand", "grass",
          "gray", "dark_gray", "achro", "warm", "size", "blue_dom"]
# Blend weights of prevalence and of semantics; largest squared RGB distance.
PREVALENCE_WEIGHT, SEMANTIC_WEIGHT, MAX_RGB_D2 = 0.28, 0.55, 195075.0
CLUSTERS = 5_000  # clusters in a task
ASPHALT_ANCHORS = [(44, 44, 56), (52, 55, 72), (91, 91, 101), (91, 90, 96)]
ANCHORS = {"asphalt": (45, 45, 48), "vegetation": (34, 139, 34), "land_grass": (124, 252, 0), "dry_grass": (189, 183, 107)}


def d2(rgb) -> str:
    r, g, b = rgb
    return f"((r-{r})*(r-{r}) + (g-{g})*(g-{g}) + (b-{b})*(b-{b}))"


def with_materials(clusters: DataFrame, classes: DataFrame) -> DataFrame:
    """Every cluster next to every material (a fixed-size class table).

    The rules cost far more than reading their few bytes, so the clusters are dealt by model into
    tasks of about CLUSTERS rows first; all steps up to the mapping then stay in these tasks.
    """
    clusters = clusters.repartition(max(1, math.ceil(clusters.count() / CLUSTERS)), "model_id")
    m = classes.selectExpr("class_idx AS material_idx", "name AS material", "r AS mr", "g AS mg", "b AS mb")
    return each_of(clusters, m)


def _in_lambda(body: str, names: list[str]) -> str:
    """``body`` over a row's columns, evaluated inside one lambda: it has too many branches for a generated method."""
    body = re.sub(r"\b(" + "|".join(names) + r")\b(?!')", r"x.\1", body)
    packed = ", ".join(f"'{n}', {n}" for n in names)
    return f"transform(array(named_struct({packed})), x -> {body})[0]"


def colour_cost(pairs: DataFrame) -> DataFrame:
    """Squared RGB distance with additive biases, floored at 0 after every discount."""
    veg, road = sql_list(rules.SETS["veg"]), sql_list(rules.SETS["roads"] + ["BM_ROCK"])
    is_ = lambda name: f"material = '{name}'"
    in_ = lambda names: f"material IN {names}"
    df = pairs.withColumns({
        "mx": F.greatest("r", "g", "b"), "mn": F.least("r", "g", "b"),
        "anchor_d2": F.expr("least(" + ", ".join(d2(a) for a in ASPHALT_ANCHORS) + ")"),
        **{f"d2_{k}": F.expr(d2(a)) for k, a in ANCHORS.items()},
    }).withColumns({
        "near_anchor": F.expr(f"anchor_d2 <= {34 * 34}"),
        "csat": F.expr("(mx - mn) / cast(greatest(mx, 1) AS double)"),
        "green": F.expr("greatest(0D, 1D - least(d2_vegetation, d2_land_grass, d2_dry_grass) / 25000D)"),
        "green_dom": F.expr("g > r * 1.12D AND g > b * 1.15D AND g > 30"),
        "is_warm": F.expr("r > b * 1.18D AND mx > 40"),
        "bright": F.expr("(r + g + b) / 3D"),
    }).withColumns({
        "neutral": F.expr("greatest(0D, 1D - csat / 0.28D)"),
        "is_gray": F.expr("csat < 0.18D AND mx BETWEEN 20 AND 210"),
        "base": F.expr("cast((r-mr)*(r-mr) + (g-mg)*(g-mg) + (b-mb)*(b-mb) AS double)"),
    })
    # Fixed values, in order: where, what is added (a negative value is a discount floored at 0).
    steps = [
        (in_(veg), "2000 + neutral * neutral * 18000"),
        (f"{in_(veg)} AND green > 0", "-(green * 30000)"),
        (f"{in_(veg)} AND green_dom", "-35000"),
        (f"{in_(veg)} AND near_anchor AND neutral >= 0.45D", "50000"),
        (f"{in_(veg)} AND d2_asphalt < d2_vegetation AND neutral >= 0.40D", "60000"),
        ("material IN ('BM_VEGETATION', 'BM_FOLIAGE') AND neutral >= 0.55D", "50000"),
        (f"{is_('BM_LAND_GRASS')} AND d2_asphalt < d2_land_grass AND neutral >= 0.45D", "40000"),
        (f"{is_('BM_LAND_DRY_GRASS')} AND d2_asphalt < d2_dry_grass AND neutral >= 0.45D", "40000"),
        (is_("BM_WATER"), "8000 + CASE WHEN is_gray THEN 30000 WHEN neutral >= 0.30D THEN 18000 ELSE 0 END"),
        (f"{is_('BM_WATER')} AND near_anchor", "40000"),
        ("material IN ('BM_METAL', 'BM_METAL_STEEL')", "30000"),
        (in_(road), "-(neutral * neutral * 12000)"),
        (f"{in_(road)} AND near_anchor AND neutral >= 0.45D", "-20000"),
        (f"{is_('BM_ASPHALT')} AND d2_asphalt < d2_vegetation AND neutral >= 0.35D", "-25000"),
        (f"{is_('BM_ASPHALT')} AND neutral >= 0.25D AND bright > 120", "(bright - 120) * 120"),
        (f"{is_('BM_CONCRETE')} AND neutral >= 0.25D AND bright < 100", "(100 - bright) * 100"),
        (f"{in_(road)} AND is_warm", "15000"),
        (f"{in_(road)} AND green >= 0.15D", "green * 18000"),
        (f"{in_(road)} AND green_dom", "25000"),
        ("is_gray AND material IN ('BM_SOIL', 'BM_SAND')", "20000"),
        (f"near_anchor AND {is_('BM_LAND_GRASS')} AND neutral >= 0.50D", "40000"),
    ]
    # One expression that names the last value once a step; as the rules below it is evaluated inside one lambda.
    value = "base"
    for where, add in steps:
        value = f"({value} + CASE WHEN {where} THEN {add} ELSE 0D END)"
        if add.startswith("-"):
            value = f"greatest(CASE WHEN {where} THEN 0D END, {value})"
    df = df.withColumn("base", F.expr(_in_lambda(value, [
        "material", "base", "neutral", "green", "green_dom", "near_anchor", "is_gray", "is_warm", "bright", *[f"d2_{k}" for k in ANCHORS]])))
    return df.withColumnRenamed("base", "cost").drop(
        "mx", "mn", "anchor_d2", *[f"d2_{k}" for k in ANCHORS], "near_anchor", "csat", "green", "green_dom", "is_warm",
        "bright", "neutral", "is_gray")


def _sql_map(values: dict[str, float]) -> str:
    return "map(" + ", ".join(f"'{k}', {v!r}D" for k, v in values.items()) + ")"


def prevalence_blend(costs: DataFrame, priors: DataFrame | None = None) -> DataFrame:
    """Blend the cost with |cluster share - prior|; needs ``pixels`` per cluster.

    ``priors`` (model_id, material, prior) replaces the urban default. Adds ``freq``.
    """
    model, cluster = W.partitionBy("model_id"), W.partitionBy("model_id", "cluster")
    if priors is None:
        costs = costs.withColumn("prior", F.expr(f"coalesce({_sql_map(PRIOR_URBAN)}[material], {PRIOR_DEFAULT}D)"))
    else:
        costs = costs.join(priors, ["model_id", "material"], "left").withColumn("prior", F.coalesce("prior", F.lit(PRIOR_DEFAULT)))
    # A model's distinct (cluster, pixels) are at most 30, so they stand in its rows; rows without keys have no share.
    df = costs.where("model_id IS NOT NULL").withColumn("_shares", F.collect_set(F.struct("cluster", "pixels")).over(model))
    df = df.withColumn("_share", F.explode(F.expr("filter(_shares, s -> s.cluster = cluster)")))
    df = df.withColumn("freq", F.expr("_share.pixels / aggregate(_shares, _share.pixels - _share.pixels, (n, s) -> n + coalesce(s.pixels, 0))")).drop("_shares", "_share")
    df = df.withColumn("prior", F.col("prior") / F.sum("prior").over(cluster))
    return df.withColumn("cost", F.expr(
        f"{1.0 - PREVALENCE_WEIGHT!r}D * (cost / {MAX_RGB_D2}D) + {PREVALENCE_WEIGHT}D * abs(freq - prior)")).drop("prior")


def semantic_penalty(pairs: DataFrame) -> DataFrame:
    """Weighted distance to each material's target scores plus the rule table's deltas."""
    names = [*SCORES, "freq", "material"]
    arms = []
    for material in rules.ALL:
        chains = [tiers for members, tiers in rules.RULES if material in members]
        terms = [
            "CASE " + " ".join(f"WHEN {cond} THEN {delta!r}D{' * damping' if damped else ''}" for cond, delta, damped in tiers) + " ELSE 0D END"
            for tiers in chains
        ]
        arms.append(f"WHEN '{material}' THEN {' + '.join(terms) or '0D'}")
    damping = "(CASE " + " ".join(f"WHEN veg >= {lim}D THEN {f}D" for lim, f in rules.DAMPING) + " ELSE 1D END)"
    body = f"CASE material {' '.join(arms)} ELSE 0D END".replace("damping", damping)
    deltas = _in_lambda(body, names)
    axes = " + ".join(
        f"{w}D * abs({axis} - coalesce({_sql_map(targets)}[material], 0D))" for axis, w, targets in rules.AXES)
    return pairs.withColumn("penalty", F.expr(f"{axes} + {deltas}"))


def blend(costs: DataFrame) -> DataFrame:
    """Cost over the model's largest, blended with the penalty."""
    top = F.max("cost").over(W.partitionBy("model_id"))
    share = F.col("cost") / F.when(top > 0, top).otherwise(1.0)
    return costs.withColumn("cost", F.lit(1.0 - SEMANTIC_WEIGHT) * share + F.lit(SEMANTIC_WEIGHT) * F.col("penalty"))


def cluster_material(costs: DataFrame) -> DataFrame:
    """Cheapest material of each cluster, the first on ties; materials may repeat."""
    best = costs.groupBy("model_id", "cluster").agg(F.min(F.struct("cost", "material_idx", "material")).alias("m"))
    return best.select("model_id", "cluster", "m.material_idx", "m.material")


def enforce_diversity(costs: DataFrame) -> DataFrame:
    """Hand missing materials to the cheapest cluster of a repeated material.

    Runs while fewer than max(2, min(k, m) div 2) materials are in use. A model is at most
    30 x 13 costs, so it is folded as one row of arrays.
    """
    per_cluster = costs.groupBy("model_id", "cluster").agg(
        F.array_sort(F.collect_list(F.struct("material_idx", "cost", "material"))).alias("ms"),
        F.min(F.struct("cost", "material_idx")).alias("m"))
    model = per_cluster.groupBy("model_id").agg(F.array_sort(F.collect_list(
        F.struct("cluster", F.expr("m.material_idx AS j"), F.expr("transform(ms, x -> x.cost) AS costs")))).alias("cs"),
        F.first("ms").alias("ms"))
    # The fold reads the arrays from one struct: named by themselves their expressions would be evaluated anew at every use.
    given = ("named_struct('cur', transform(cs, c -> c.j), 'costs', transform(cs, c -> c.costs), 'ids', transform(ms, x -> x.material_idx), "
             "'wanted', greatest(2, least(size(cs), size(ms)) div 2))")
    step = (
        "CASE WHEN size(array_distinct(cur)) >= m.wanted THEN cur ELSE transform(array("
        "filter(sequence(0, size(cur) - 1), i -> size(filter(cur, x -> x = cur[i])) > 1)), donors -> CASE WHEN size(donors) = 0 THEN cur ELSE "
        "transform(array(array_min(transform(donors, i -> named_struct('c', m.costs[i][array_position(m.ids, j) - 1], 'i', i))).i), "
        "best -> transform(cur, (x, i) -> CASE WHEN i = best THEN j ELSE x END))[0] END)[0] END"
    )
    folded = model.selectExpr(
        "model_id", "transform(cs, c -> c.cluster) AS clusters", "transform(ms, x -> x.material) AS names", "transform(ms, x -> x.material_idx) AS ids",
        f"transform(array({given}), m -> aggregate(filter(m.ids, j -> NOT array_contains(m.cur, j)), m.cur, (cur, j) -> {step}))[0] AS cur")
    return folded.selectExpr("model_id", "names", "ids", "explode(arrays_zip(clusters, cur)) AS z").selectExpr(
        "model_id", "z.clusters AS cluster", "z.cur AS material_idx", "names[array_position(ids, z.cur) - 1] AS material")


def guardrails(clusters: DataFrame, classes: DataFrame) -> DataFrame:
    """Ordered remaps of severe confusions; ``clusters`` has material, r, g, b and the scores."""
    present = {r["name"]: (r["class_idx"], r["r"], r["g"], r["b"]) for r in classes.orderBy("class_idx").collect()}  # <= 30 classes

    def nearest(names):
        found = [(n, present[n]) for n in present if n in names]
        if not found:
            return None
        return "array_min(array(" + ", ".join(
            f"named_struct('d', {d2(rgb)}, 'i', {i}, 'n', '{n}')" for n, (i, *rgb) in found) + ")).n"

    def only(*names):
        return next((f"'{n}'" for n in names if n in present), None)

    veg, lush, road = rules.SETS["veg"], rules.SETS["lush"], rules.SETS["roads"]
    veg_soil = sql_list(veg + ["BM_SOIL"])
    ground = nearest(["BM_ASPHALT", "BM_CONCRETE", "BM_PAINT_ASPHALT", "BM_SOIL", "BM_ROCK"]) or nearest([n for n in present if n != "BM_WATER"])
    # Fixed values, in order: current material and scores -> new material (None: no such class).
    steps = [
        ("m = 'BM_WATER' AND (road >= 0.40D OR asphalt >= 0.38D)", nearest(road)),
        (f"m IN {veg_soil} AND water_like", only("BM_WATER")),
        (f"m IN {sql_list(lush)} AND dry >= 0.60D AND veg < 0.22D", nearest(["BM_LAND_DRY_GRASS", "BM_SOIL", "BM_ROCK"])),
        ("m = 'BM_LAND_DRY_GRASS' AND sand >= 0.50D AND sand > dry + 0.12D AND veg < 0.22D AND grass < 0.15D", only("BM_SAND")),
        ("m = 'BM_LAND_GRASS' AND sand >= 0.45D AND grass < 0.12D AND veg < 0.20D", only("BM_SAND")),
        ("m = 'BM_SAND' AND NOT (grass >= 0.25D AND veg >= 0.20D) AND veg >= 0.30D AND dry > sand", only("BM_LAND_DRY_GRASS")),
        ("m = 'BM_SAND' AND grass >= 0.25D AND veg >= 0.20D", only("BM_LAND_GRASS", "BM_LAND_DRY_GRASS")),
        ("m = 'BM_WATER' AND NOT water_like", ground),
        (f"m IN {veg_soil} AND road_like >= 0.55D", nearest(road)),
        ("m IN ('BM_ASPHALT', 'BM_PAINT_ASPHALT') AND veg >= 0.35D AND grass >= 0.12D", nearest(veg)),
        ("m = 'BM_SAND' AND asphalt >= 0.35D AND dark_gray >= 0.25D AND sand < 0.40D", only("BM_ASPHALT")),
        ("m = 'BM_ASPHALT' AND sand >= 0.50D AND asphalt < 0.25D", only("BM_SAND")),
        (f"m IN {sql_list(veg)} AND (water_like OR water_conf >= 0.30D)", only("BM_WATER")),
    ]
    # The steps run as one fold over the current material: each step sees the last one's
    # result without the optimizer copying the whole chain into every use. Step 0 stops
    # the fold: a remapped road cluster takes no further rule.
    arms = " ".join(
        f"WHEN {n} THEN CASE WHEN {where} THEN named_struct('m', {target}, 'stop', {'true' if n == 0 else 'false'}) ELSE s END"
        for n, (where, target) in enumerate(steps) if target is not None)
    road_like = "greatest(road, asphalt, line)"
    water_like = f"(water_conf >= 0.28D OR (water >= 0.45D AND {road_like} < 0.35D AND veg < 0.45D))"
    arms = arms.replace("water_like", water_like).replace("road_like", road_like)
    arms = re.sub(r"(WHEN|AND) m (=|IN)", r"\1 s.m \2", arms)
    fold = (f"aggregate(sequence(0, {len(steps) - 1}), named_struct('m', material, 'stop', false), "
            f"(s, n) -> CASE WHEN s.stop THEN s ELSE CASE n {arms} ELSE s END END).m")
    return clusters.withColumn("material", F.expr(fold))


def map_clusters(clusters: DataFrame, classes: DataFrame, priors: DataFrame | None = None) -> DataFrame:
    """Full mapping: model_id, cluster, material_idx, material, colour."""
    pairs = semantic_penalty(prevalence_blend(colour_cost(with_materials(clusters, classes)), priors))
    assigned = enforce_diversity(blend(pairs)).drop("material_idx")
    safe = guardrails(clusters.join(assigned, ["model_id", "cluster"]), classes).select("model_id", "cluster", "material")
    names = classes.selectExpr("name AS material", "class_idx AS material_idx", "color AS color_hex", "r", "g", "b")
    return safe.join(F.broadcast(names), "material")


def greedy_colours(clusters: DataFrame, classes: DataFrame) -> DataFrame:
    """Each cluster in order takes the nearest unused material, any one when all are used."""
    mats = "array(" + ", ".join(
        f"named_struct('i', {r['class_idx']}, 'r', {r['r']}, 'g', {r['g']}, 'b', {r['b']})" for r in classes.orderBy("class_idx").collect()) + ")"
    model = clusters.groupBy("model_id").agg(F.array_sort(F.collect_list(F.struct("cluster", "r", "g", "b"))).alias("cs"))  # <= 30
    free = f"filter({mats}, m -> size(acc) >= size({mats}) OR NOT array_contains(acc, m.i))"
    d = "(c.r-m.r)*(c.r-m.r) + (c.g-m.g)*(c.g-m.g) + (c.b-m.b)*(c.b-m.b)"
    best = f"array_min(transform({free}, m -> named_struct('d', {d}, 'i', m.i))).i"
    return model.selectExpr(
        "model_id", "transform(cs, c -> c.cluster) AS cluster",
        f"aggregate(cs, cast(array() AS array<int>), (acc, c) -> array_append(acc, {best})) AS material_idx",
    ).selectExpr("model_id", "explode(arrays_zip(cluster, material_idx)) AS z").selectExpr("model_id", "z.cluster AS cluster", "z.material_idx AS material_idx")


def open_weight(veg: str, soil: str, gray: str) -> str:
    return f"least(1D, greatest(0D, 0.5D + 1.1D * ({veg} + 0.65D * {soil} - 0.9D * {gray})))"


def open_fractions(df: DataFrame, keys: list[str]) -> DataFrame:
    """Vegetation, soil and gray shares over P98-scaled s1, s2, s3, and the open weight."""
    mx, mn = "greatest(s1, s2, s3)", "least(s1, s2, s3)"
    sat = f"(({mx} - {mn}) / ({mx} + 1e-6D))"
    share = lambda cond: F.avg(F.expr(f"CASE WHEN {cond} THEN 1D ELSE 0D END"))
    return df.groupBy(*keys).agg(
        share("2D * s2 - s1 - s3 > 0.08D AND s2 > 0.22D").alias("veg"),
        share(f"s1 > s2 AND s2 > s3 AND {sat} > 0.07D AND {mx} > 0.18D").alias("soil"),
        share(f"{sat} < 0.12D AND {mx} > 0.15D AND {mx} < 0.85D").alias("gray"),
    ).withColumn("open_weight", F.expr(open_weight("veg", "soil", "gray")))


def blended_priors(weights: DataFrame, classes: DataFrame) -> DataFrame:
    """Urban and open priors mixed by the open weight and normalised per model."""
    mixed = each_of(weights, classes.selectExpr("name AS material")).withColumn("prior", F.expr(
        f"(1D - open_weight) * coalesce({_sql_map(PRIOR_URBAN)}[material], {PRIOR_DEFAULT}D) "
        f"+ open_weight * coalesce({_sql_map(PRIOR_OPEN)}[material], {PRIOR_DEFAULT}D)"))
    total = F.sum("prior").over(W.partitionBy("model_id"))
    return mixed.select("model_id", "material", (F.col("prior") / total).alias("prior"))


def apply_palette(labels: DataFrame, colours: DataFrame) -> DataFrame:
    """Label to RGB: 0 is black, labels beyond the table take its last colour.

    ``colours`` has idx (1-based), r, g, b; at most a few dozen rows.
    """
    top = colours.agg(F.max("idx")).first()[0] or 0
    table = F.broadcast(colours.selectExpr("idx AS _i", "r", "g", "b"))
    df = labels.withColumn("_i", F.expr(f"least({top}, greatest(0, label))"))
    return df.join(table, "_i", "left").drop("_i").fillna(0, ["r", "g", "b"])


def rgb_to_label(rgb: DataFrame, classes: DataFrame) -> DataFrame:
    """Exact colour to class index, 0 when no class has it."""
    key = "r * 65536 + g * 256 + b"
    table = F.broadcast(classes.groupBy(F.expr(key).alias("_k")).agg(F.max("class_idx").alias("label")))
    return rgb.drop("label").withColumn("_k", F.expr(key)).join(table, "_k", "left").drop("_k").fillna(0, ["label"])


def cluster_rgb(pixels: DataFrame, k: int, keys: list[str] = ("raster_id",)) -> DataFrame:
    """Truncated mean colour per cluster 1..k; an empty cluster is mid gray."""
    means = pixels.groupBy(*keys, "label").agg(*[F.floor(F.avg(b)).cast("int").alias(c) for b, c in zip(("b1", "b2", "b3"), "rgb")])
    every = pixels.select(*keys).distinct().selectExpr(*keys, f"explode(sequence(1, {k})) AS label")
    return every.join(means, [*keys, "label"], "left").fillna(128, ["r", "g", "b"])


def color_table(clusters: DataFrame, classes: DataFrame) -> DataFrame:
    """Class colour of each cluster, or the cluster's own mean where no class is given."""
    c = classes.selectExpr("class_idx AS label", "r AS cr", "g AS cg", "b AS cb")
    return clusters.join(F.broadcast(c), "label", "left").withColumns(
        {x: F.coalesce(f"c{x}", x) for x in "rgb"}).drop("cr", "cg", "cb")


def is_preset(class_sets: DataFrame, key: str) -> DataFrame:
    """Whether all class names of a set belong to the preset."""
    preset = F.broadcast(preset_classes(class_sets.sparkSession).selectExpr("name", "true AS known"))
    return class_sets.join(preset, "name", "left").groupBy(key).agg(F.every(F.coalesce("known", F.lit(False))).alias("preset"))


def overlay_colours(class_sets: DataFrame, layers: DataFrame, keys: list[str]) -> DataFrame:
    """Auto colour of the n-th layer per key: first candidates far from every class colour.

    Eligible candidates come first in order, then the others; beyond ten, yellow.
    """
    spark = class_sets.sparkSession
    cand = spark.createDataFrame([(i, *c) for i, c in enumerate(OVERLAY_CANDIDATES)], "pos INT, cr INT, cg INT, cb INT")
    near = each_of(class_sets, cand).groupBy(*keys, "pos", "cr", "cg", "cb").agg(
        F.min(F.expr("(r-cr)*(r-cr) + (g-cg)*(g-cg) + (b-cb)*(b-cb)")).alias("d2"))
    order = W.partitionBy(*keys).orderBy(F.expr("CASE WHEN sqrt(d2) > 80 THEN 0 ELSE 1 END"), "pos")
    ranked = near.withColumn("layer_no", F.row_number().over(order) - 1)
    out = layers.join(ranked, [*keys, "layer_no"], "left")
    return out.select(*layers.columns, *[F.coalesce(f"c{x}", F.lit(v)).alias(x) for x, v in zip("rgb", OVERLAY_FALLBACK)])
