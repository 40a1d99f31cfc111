"""Queries over palettes, semantics and the cluster-to-material mapping."""

from pyspark.sql import functions as F

from ..functions import palette as pal, rules
from ..operators import clustering as cl, materials as mt, sampling as sp, semantics as sem
from ..oracle.base import CTES, boxes, components, names_in, sql
from ..session import bounded
from .fixtures import SCORES, classes, clusters, labelled, layers, raster_meta, scene, sized, table, user_classes
from .q_clustering import BANDS, SHARED, shared_model
from .q_features import EDGE_CTES, P98_CTE
from .registry import query

_NAMES = "[" + ", ".join(f"'{n}'" for n, _, _ in pal.PRESET) + ", 'BM_OTHER']"


@query("material_type", "part_id:l name:s kind:s", f"""SELECT part_id, name, coalesce(material_type, 'OTHER') AS kind FROM
    (SELECT p_partkey AS part_id, ({_NAMES})[1 + p_partkey % 14] AS name FROM part) LEFT JOIN (WITH c AS ({CTES['classes']}) SELECT * FROM c) USING (name)""")
def material_type(spark, sf):
    names = "array" + _NAMES.replace("[", "(").replace("]", ")")
    return table(spark, sf, "part").selectExpr("p_partkey AS part_id", f"{names}[cast(p_partkey % 14 AS int)] AS name").withColumn("kind", pal.material_type("name"))


_HEX = "CASE p_partkey % 9 WHEN 0 THEN 'red' WHEN 1 THEN '#12345' WHEN 2 THEN '#12G456' ELSE {} END"


@query("hex_rgb", "part_id:l code:s r:i g:i b:i", f"""SELECT p_partkey AS part_id, code, CASE WHEN ok THEN ('0x' || code[2:3])::INT ELSE 255 END AS r,
    CASE WHEN ok THEN ('0x' || code[4:5])::INT ELSE 255 END AS g, CASE WHEN ok THEN ('0x' || code[6:7])::INT ELSE 255 END AS b
    FROM (SELECT p_partkey, {_HEX.format("'#' || printf('%06X', (p_partkey * 7919) % 16777216)")} AS code, p_partkey % 9 > 2 AS ok FROM part)""")
def hex_rgb(spark, sf):
    code = _HEX.format("concat('#', lpad(hex((p_partkey * 7919) % 16777216), 6, '0'))")
    df = table(spark, sf, "part").selectExpr("p_partkey AS part_id", f"{code} AS code")
    return df.select("part_id", "code", *pal.hex_channels("code"))


def _palette_sql(col, base, snap):
    ch = "CASE sector " + "{} END"
    orders = {"r": "val q p p t val", "g": "t val val q p p", "b": "p p t val val q"}
    code = " || ".join(
        "printf('%02x', " + snap + "(255 * (CASE sector " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(o.split())) + " END))::INT)" for o in orders.values())
    return f"CASE WHEN i < 30 THEN ([{', '.join(chr(39) + c + chr(39) for c in base)}])[i + 1] ELSE '#' || {code} END AS {col}"


@query("palette_n", "idx:l cli:s form:s web:s", f"""SELECT i AS idx, {_palette_sql('cli', pal.PALETTE_CLI, 'floor')}, {_palette_sql('form', pal.PALETTE_FORM, 'floor')},
    {_palette_sql('web', pal.PALETTE_FORM, 'round')} FROM (SELECT *, val * (1.0::DOUBLE - sat) AS p, val * (1.0::DOUBLE - sat * f) AS q, val * (1.0::DOUBLE - sat * (1.0::DOUBLE - f)) AS t
    FROM (SELECT *, floor(h)::INT AS sector, h - floor(h) AS f FROM (SELECT p_partkey AS i, ((p_partkey * 0.618033988749895::DOUBLE) % 1.0::DOUBLE) * 6.0::DOUBLE AS h,
      CASE WHEN p_partkey % 2 = 0 THEN 0.9::DOUBLE ELSE 0.7::DOUBLE END AS sat, CASE WHEN (p_partkey // 2) % 2 = 0 THEN 0.95::DOUBLE ELSE 0.75::DOUBLE END AS val FROM part)))""")
def palette_n(spark, sf):
    df = table(spark, sf, "part").selectExpr("p_partkey AS idx")
    return df.select("idx", *[pal.palette_color("idx", v).alias(v) for v in ("cli", "form", "web")])


@query("is_preset", "set_id:l preset:b", f"""SELECT set_id, bool_and(name IN {names_in(n for n, _, _ in pal.PRESET)}) AS preset FROM
    (SELECT p_partkey // 5 AS set_id, ({_NAMES})[1 + (p_partkey * 3) % 14] AS name FROM part) GROUP BY set_id""")
def is_preset(spark, sf):
    names = "array" + _NAMES.replace("[", "(").replace("]", ")")
    sets = table(spark, sf, "part").selectExpr("p_partkey div 5 AS set_id", f"{names}[cast((p_partkey * 3) % 14 AS int)] AS name")
    return mt.is_preset(sets, "set_id")


_SC = "s.raster_id, s.row, s.col, least(1, s.b1 / scale) AS s1, least(1, s.b2 / scale) AS s2, least(1, s.b3 / scale) AS s3, least(1, s.b4 / scale) AS s4"
_OPEN = """avg(CASE WHEN 2 * s2 - s1 - s3 > 0.08 AND s2 > 0.22 THEN 1.0 ELSE 0 END) AS veg,
    avg(CASE WHEN s1 > s2 AND s2 > s3 AND (mx - mn) / (mx + 1e-6) > 0.07 AND mx > 0.18 THEN 1.0 ELSE 0 END) AS soil,
    avg(CASE WHEN (mx - mn) / (mx + 1e-6) < 0.12 AND mx > 0.15 AND mx < 0.85 THEN 1.0 ELSE 0 END) AS gray"""
_WEIGHT = "greatest(0, least(1, 0.5 + 1.1::DOUBLE * (veg + 0.65::DOUBLE * soil - 0.9::DOUBLE * gray)))"


@query("open_weight", "raster_id:i veg:d6 soil:d6 gray:d6 open_weight:d6", sql("scene", f"SELECT *, {_WEIGHT} AS open_weight FROM (SELECT raster_id, {_OPEN} FROM sc GROUP BY raster_id)",
    p98=P98_CTE, sc=f"SELECT *, greatest(s1, s2, s3) AS mx, least(s1, s2, s3) AS mn FROM (SELECT {_SC} FROM scene s JOIN p98 USING (raster_id))"))
def open_weight(spark, sf):
    from ..operators.features import p98_scale
    return mt.open_fractions(p98_scale(scene(spark, sf)), ["raster_id"])


_URBAN = "(VALUES " + ", ".join(f"('{m}', {u}::DOUBLE, {pal.PRIOR_OPEN[m]}::DOUBLE)" for m, u in pal.PRIOR_URBAN.items()) + ") AS v(name, u, o)"
_ZONES = """SELECT s.raster_id, zr * 4 + zc AS zone, s.b1, s.b2, s.b3 FROM px s, (SELECT unnest(range(4)) AS zr), (SELECT unnest(range(4)) AS zc)
    WHERE height >= 41 AND width >= 41 AND s.row BETWEEN floor(20 + zr * (height - 41)::DOUBLE / 3) - 20 AND floor(20 + zr * (height - 41)::DOUBLE / 3) + 20
      AND s.col BETWEEN floor(20 + zc * (width - 41)::DOUBLE / 3) - 20 AND floor(20 + zc * (width - 41)::DOUBLE / 3) + 20
    UNION ALL SELECT raster_id, 0, b1, b2, b3 FROM px WHERE height < 41 OR width < 41"""


@query("scene_prior", "raster_id:i zones:i open_weight:d6 material:s prior:d6", sql("scene dims px", f"""
    SELECT raster_id, zones, open_weight, name AS material, m / sum(m) OVER (PARTITION BY raster_id) AS prior FROM
    (SELECT *, (1 - open_weight) * u + open_weight * o AS m FROM w, {_URBAN})""",
    zo=_ZONES, zs="SELECT raster_id, zone, greatest(1, quantile_cont(v, 0.98)) AS scale FROM (SELECT raster_id, zone, unnest([b1, b2, b3])::DOUBLE AS v FROM zo) GROUP BY ALL",
    sc="SELECT *, greatest(s1, s2, s3) AS mx, least(s1, s2, s3) AS mn FROM (SELECT raster_id, zone, least(1, b1 / scale) AS s1, least(1, b2 / scale) AS s2, least(1, b3 / scale) AS s3 FROM zo JOIN zs USING (raster_id, zone))",
    w=f"SELECT raster_id, count(*) AS zones, avg({_WEIGHT}) AS open_weight FROM (SELECT raster_id, zone, {_OPEN} FROM sc GROUP BY raster_id, zone) GROUP BY raster_id"))
def scene_prior(spark, sf):
    weights, priors = sem.scene_prior(sized(scene(spark, sf)), classes(spark), "4.5D")
    return weights.join(priors.withColumnRenamed("model_id", "raster_id"), "raster_id")


ZONE_LAB = {"zl": "SELECT *, zone + 1 AS label FROM px"}


def zone_labelled(spark, sf):
    return sized(scene(spark, sf)).withColumn("label", F.expr("zone + 1"))


@query("cluster_rgb", "raster_id:i label:i r:i g:i b:i", sql("scene dims px", """SELECT raster_id, label, coalesce(r, 128) AS r, coalesce(g, 128) AS g, coalesce(b, 128) AS b
    FROM (SELECT raster_id, unnest(range(1, 10)) AS label FROM dims) LEFT JOIN (SELECT raster_id, label, floor(avg(b1)) AS r, floor(avg(b2)) AS g, floor(avg(b3)) AS b
    FROM zl GROUP BY ALL) USING (raster_id, label)""", **ZONE_LAB))
def cluster_rgb(spark, sf):
    return mt.cluster_rgb(zone_labelled(spark, sf), 9)


@query("cluster_counts", "raster_id:i label:i n:l", sql("scene dims px", "SELECT raster_id, label, count(*) AS n FROM zl GROUP BY ALL", **ZONE_LAB))
def cluster_counts(spark, sf):
    return zone_labelled(spark, sf).groupBy("raster_id", "label").agg(F.count("*").alias("n"))


def _duck(expr):
    import re
    return re.sub(r"(\d)D\b", r"\1::DOUBLE", expr)


def _in_order(exprs):
    return ", ".join(f"({_duck(e)}) AS {n}" for n, e in exprs.items())


MASK_CTES = {**EDGE_CTES,
    "sc": f"SELECT {_SC}, s.zone + 1 AS label FROM scene s JOIN p98 USING (raster_id)",
    "dv": f"SELECT *, {_in_order(sem.DERIVED)} FROM sc",
    "bm": f"SELECT *, {_in_order(sem.BASE_MASKS)} FROM dv",
    "masks": f"SELECT bm.*, {_in_order(sem.MASKS)}, ({_duck(sem.WATER4)}) AS m_water, edges.edge AS m_edge FROM bm JOIN edges USING (raster_id, row, col)"}


@query("semantic_masks", "raster_id:i row:i col:i " + " ".join(f"{m}:b" for m in sem.MASK_NAMES), sql("scene dims px", "SELECT * FROM masks", **MASK_CTES))
def semantic_masks(spark, sf):
    return sem.semantic_masks(sized(scene(spark, sf)))


CONT_CTES = {**components("zm", 4, "label"), "zm_box": boxes("zm", "label"),
    "cont": """SELECT raster_id, label, CASE WHEN total < 80 THEN 0 ELSE least(1, el / total * 1.4::DOUBLE) END AS cont,
        CASE WHEN total < 120 THEN 0 ELSE least(1, 0.55::DOUBLE * mn / total + 0.45::DOUBLE * cp / total) END AS water_cont FROM (
        SELECT raster_id, label, sum(area)::DOUBLE AS total,
          coalesce(sum(area) FILTER (WHERE area >= 28 AND greatest(bh, bw) >= 3 * least(bh, bw) AND area <= 0.78 * bh * bw), 0) AS el,
          coalesce(max(area) FILTER (WHERE area >= 40), 0) AS mn,
          coalesce(sum(area) FILTER (WHERE area >= 40 AND area >= 0.38 * bh * bw AND greatest(bh, bw) <= 3.5 * least(bh, bw)), 0) AS cp
        FROM zm_box GROUP BY raster_id, label)"""}
_ZM = {"zm": "SELECT raster_id, label, row, col FROM zl"}


@query("elongated_score", "raster_id:i label:i cont:d6", sql("scene dims px", "SELECT raster_id, label, cont FROM cont", **ZONE_LAB, **_ZM, **CONT_CTES))
def elongated_score(spark, sf):
    return sem.continuity_scores(zone_labelled(spark, sf))


@query("waterbody_score", "raster_id:i label:i water_cont:d6", sql("scene dims px", "SELECT raster_id, label, water_cont FROM cont", **ZONE_LAB, **_ZM, **CONT_CTES))
def waterbody_score(spark, sf):
    return sem.continuity_scores(zone_labelled(spark, sf))


def _score_chain(src, fractions, prefix):
    out, last = {f"{prefix}0": f"SELECT * FROM {src}"}, f"{prefix}0"
    for i, (name, formula) in enumerate(sem.SCORE_FORMULAS, start=1):
        out[f"{prefix}{i}"] = f"SELECT *, greatest(0, least(1, {_duck(formula)})) AS {name} FROM {last}"
        last = f"{prefix}{i}"
    return out, last


_CHAIN, _LAST = _score_chain("frac", None, "sf")
SCORE_CTES = {**ZONE_LAB, **_ZM, **CONT_CTES, **MASK_CTES,
    "frac": "SELECT m.*, cont, water_cont, px / sum(px) OVER (PARTITION BY m.raster_id)::DOUBLE AS size FROM (SELECT raster_id, label, count(*) AS px, "
            + ", ".join(f"avg(CASE WHEN {m} THEN 1.0 ELSE 0 END) AS f{m[1:]}" for m in sem.MASK_NAMES) + " FROM masks GROUP BY ALL) m JOIN cont USING (raster_id, label)",
    **_CHAIN,
    "scores": f"SELECT *, f_gray AS gray, f_dark_gray AS dark_gray, f_achro_road AS achro, f_warm AS warm, f_blue_dom AS blue_dom FROM {_LAST}"}
_ZERO = ", ".join(f"coalesce({s}, 0) AS {s}" for s in SCORES)


@query("semantic_scores", "raster_id:i cluster:i px:l " + " ".join(f"{s}:d6" for s in SCORES), sql("scene dims px", f"""
    SELECT raster_id, cluster, coalesce(px, 0) AS px, {_ZERO} FROM (SELECT raster_id, unnest(range(1, 9)) AS cluster FROM dims) e
    LEFT JOIN scores s USING (raster_id) WHERE s.label = cluster
    UNION ALL SELECT raster_id, cluster, 0, {', '.join('0' for _ in SCORES)} FROM (SELECT raster_id, unnest(range(1, 9)) AS cluster FROM dims) e
      WHERE NOT EXISTS (SELECT 1 FROM scores s WHERE s.raster_id = e.raster_id AND s.label = cluster)""", **SCORE_CTES))
def semantic_scores(spark, sf):
    return sem.semantic_scores(zone_labelled(spark, sf), 8)


@query("avg_semantics", "cluster:i pixels:l " + " ".join(f"{s}:d6" for s in SCORES), sql("scene dims px", f"""SELECT label AS cluster, sum(px) AS pixels,
    {', '.join(f'sum({s} * px) / sum(px) AS {s}' for s in SCORES)} FROM scores GROUP BY label""", **SCORE_CTES))
def avg_semantics(spark, sf):
    return sem.avg_semantics(sem.semantic_scores(zone_labelled(spark, sf), 7).withColumn("pixels", F.col("px")))


# --- mapping over the model fixture -------------------------------------------------

def _d2(a, rgb):
    return "(" + " + ".join(f"({a}{c}-({v}))*({a}{c}-({v}))" for c, v in zip("rgb", rgb)) + ")"


_VEG, _ROAD = names_in(rules.SETS["veg"]), names_in(rules.SETS["roads"] + ["BM_ROCK"])
# The biases in one pass per floor: f0 .. f5 are the values between two floors.
COST_CTES = {
    "pairs": "SELECT k.*, c.class_idx AS material_idx, c.name AS material, c.r AS mr, c.g AS mg, c.b AS mb FROM clusters k, classes c",
    "cs": f"""SELECT *, greatest(r, g, b) AS mx, 1::DOUBLE * (greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b, 1) AS csat,
        least({', '.join(_d2('', a) for a in mt.ASPHALT_ANCHORS)}) <= 1156 AS na, {_d2('', (45, 45, 48))} AS da, {_d2('', (34, 139, 34))} AS dv,
        {_d2('', (124, 252, 0))} AS dl, {_d2('', (189, 183, 107))} AS dd, {_d2('', ('mr', 'mg', 'mb'))} AS dm,
        g > r * 1.12 AND g > b * 1.15 AND g > 30 AS gd, r > b * 1.18 AND greatest(r, g, b) > 40 AS wm, (r + g + b) / 3.0::DOUBLE AS br,
        material IN {_VEG} AS v, material IN {_ROAD} AS rd FROM pairs""",
    "ct": "SELECT *, greatest(0, 1 - csat / 0.28::DOUBLE) AS nt, greatest(0, 1 - least(dv, dl, dd) / 25000.0::DOUBLE) AS gp, csat < 0.18 AND mx BETWEEN 20 AND 210 AS gray_c FROM cs",
    "v1": """SELECT *, CASE WHEN v THEN CASE WHEN gp > 0 THEN greatest(0, dm + 2000 + nt * nt * 18000 - gp * 30000) ELSE dm + 2000 + nt * nt * 18000 END
        WHEN material = 'BM_WATER' THEN dm + 8000 + (CASE WHEN gray_c THEN 30000 WHEN nt >= 0.30 THEN 18000 ELSE 0 END) + (CASE WHEN na THEN 40000 ELSE 0 END)
        WHEN material IN ('BM_METAL', 'BM_METAL_STEEL') THEN dm + 30000 ELSE dm END AS c1 FROM ct""",
    "v2": """SELECT *, CASE WHEN v AND gd THEN greatest(0, c1 - 35000) ELSE c1 END + CASE WHEN v AND na AND nt >= 0.45 THEN 50000 ELSE 0 END
        + CASE WHEN v AND da < dv AND nt >= 0.40 THEN 60000 ELSE 0 END + CASE WHEN material IN ('BM_VEGETATION', 'BM_FOLIAGE') AND nt >= 0.55 THEN 50000 ELSE 0 END
        + CASE WHEN material = 'BM_LAND_GRASS' AND da < dl AND nt >= 0.45 THEN 40000 ELSE 0 END
        + CASE WHEN material = 'BM_LAND_DRY_GRASS' AND da < dd AND nt >= 0.45 THEN 40000 ELSE 0 END AS c2 FROM v1""",
    "v3": "SELECT *, CASE WHEN rd THEN greatest(0, c2 - nt * nt * 12000) ELSE c2 END AS c3 FROM v2",
    "v4": "SELECT *, CASE WHEN rd AND na AND nt >= 0.45 THEN greatest(0, c3 - 20000) ELSE c3 END AS c4 FROM v3",
    "v5": "SELECT *, CASE WHEN material = 'BM_ASPHALT' AND da < dv AND nt >= 0.35 THEN greatest(0, c4 - 25000) ELSE c4 END AS c5 FROM v4",
    "costs": """SELECT *, c5 + CASE WHEN material = 'BM_ASPHALT' AND nt >= 0.25 AND br > 120 THEN (br - 120) * 120 ELSE 0 END
        + CASE WHEN material = 'BM_CONCRETE' AND nt >= 0.25 AND br < 100 THEN (100 - br) * 100 ELSE 0 END
        + CASE WHEN rd AND wm THEN 15000 ELSE 0 END + CASE WHEN rd AND gp >= 0.15 THEN gp * 18000 ELSE 0 END + CASE WHEN rd AND gd THEN 25000 ELSE 0 END
        + CASE WHEN gray_c AND material IN ('BM_SOIL', 'BM_SAND') THEN 20000 ELSE 0 END
        + CASE WHEN na AND material = 'BM_LAND_GRASS' AND nt >= 0.50 THEN 40000 ELSE 0 END AS cost FROM v5""",
}
_PAIR = "model_id:l cluster:i material:s "
# Without a bound on rounding, costs near 1e5 are compared to 4 places.


@query("colour_cost", _PAIR + "cost:d4", sql("clusters classes", "SELECT model_id, cluster, material, cost FROM costs", **COST_CTES))
def colour_cost(spark, sf):
    return mt.colour_cost(mt.with_materials(clusters(spark, sf), classes(spark)))


PREV_CTES = COST_CTES | {"prev": f"""SELECT * EXCLUDE (cost), 0.72::DOUBLE * (cost / 195075.0::DOUBLE) + 0.28::DOUBLE * abs(freq - u / sum(u) OVER (PARTITION BY model_id, cluster)) AS cost
    FROM (SELECT c.*, pixels / (sum(pixels) OVER (PARTITION BY model_id, material))::DOUBLE AS freq, u FROM costs c JOIN {_URBAN} ON name = material)"""}


@query("prevalence_cost", _PAIR + "freq:d6 cost:d6", sql("clusters classes", "SELECT model_id, cluster, material, freq, cost FROM prev", **PREV_CTES))
def prevalence_cost(spark, sf):
    return mt.prevalence_blend(mt.colour_cost(mt.with_materials(clusters(spark, sf), classes(spark))))


def _penalty_sql():
    axes = " + ".join(
        f"{w}::DOUBLE * abs({a} - (CASE material " + " ".join(f"WHEN '{m}' THEN {t}" for m, t in targets.items()) + " ELSE 0 END))" for a, w, targets in rules.AXES)
    damp = "(CASE " + " ".join(f"WHEN veg >= {lim} THEN {f}::DOUBLE" for lim, f in rules.DAMPING) + " ELSE 1 END)"
    terms = [axes]
    for names, tiers in rules.RULES:
        inner = " ".join(f"WHEN {c} THEN {d}{' * ' + damp if damped else ''}" for c, d, damped in tiers)
        terms.append(f"CASE WHEN material IN {names_in(names)} THEN (CASE {inner} ELSE 0 END) ELSE 0 END")
    return " + ".join(terms)


PEN_CTES = PREV_CTES | {"pen": f"SELECT *, {_penalty_sql()} AS penalty FROM prev"}


@query("semantic_penalty", _PAIR + "penalty:d6", sql("clusters classes", "SELECT model_id, cluster, material, penalty FROM pen", **PEN_CTES))
def semantic_penalty(spark, sf):
    return mt.semantic_penalty(mt.prevalence_blend(mt.colour_cost(mt.with_materials(clusters(spark, sf), classes(spark)))))


BLEND_CTES = PEN_CTES | {
    "bl": "SELECT * EXCLUDE (cost), 0.45::DOUBLE * (cost / max(cost) OVER (PARTITION BY model_id)) + 0.55::DOUBLE * penalty AS cost FROM pen",
    "pick": "SELECT * FROM bl QUALIFY row_number() OVER (PARTITION BY model_id, cluster ORDER BY cost, material_idx) = 1",
}


def blended(spark, sf):
    pairs = mt.with_materials(clusters(spark, sf), classes(spark))
    return mt.blend(mt.semantic_penalty(mt.prevalence_blend(mt.colour_cost(pairs))))


@query("cluster_material", _PAIR, sql("clusters classes", "SELECT model_id, cluster, material FROM pick", **BLEND_CTES))
def cluster_material(spark, sf):
    return mt.cluster_material(blended(spark, sf))


# One recursion step per material: state rows are (model, step, cluster, current material).
DIV_CTES = BLEND_CTES | {
    "cost_lists": "SELECT model_id, cluster, list(cost ORDER BY material_idx) AS cl FROM bl GROUP BY ALL",
    "start": """SELECT model_id, list(p.cluster ORDER BY p.cluster) AS ks, list(p.material_idx ORDER BY p.cluster) AS cur, list(cl ORDER BY p.cluster) AS cls,
        greatest(2, least(count(*), 13) // 2) AS wanted FROM pick p JOIN cost_lists USING (model_id, cluster) GROUP BY model_id""",
    "st": """SELECT model_id, 0 AS j, ks, cur AS first_cur, cur, cls, wanted FROM start UNION ALL
        SELECT model_id, j + 1, ks, first_cur, CASE WHEN list_contains(first_cur, j + 1) OR len(list_distinct(cur)) >= wanted OR len(list_distinct(cur)) = len(cur) THEN cur ELSE
          list_transform(range(1, len(cur) + 1), lambda i: CASE WHEN i = list_min(list_transform(list_filter(range(1, len(cur) + 1),
            lambda q: len(list_filter(cur, lambda z: z = cur[q])) > 1), lambda q: {'c': cls[q][j + 1], 'i': q})).i THEN j + 1 ELSE cur[i] END) END, cls, wanted
        FROM st WHERE j < 13""",
    "div": "SELECT model_id, unnest(ks) AS cluster, unnest(cur) AS material_idx FROM st WHERE j = 13",
}


@query("diversity", _PAIR, sql("clusters classes", "SELECT model_id, cluster, name AS material FROM div JOIN classes ON class_idx = material_idx", **DIV_CTES))
def diversity(spark, sf):
    return mt.enforce_diversity(blended(spark, sf))


def _nearest_sql(names):
    rows = [r for r in pal.preset_rows() if r[2] in names]
    return "list_min([" + ", ".join(f"{{'d': {_d2('', r[4:7])}, 'i': {r[0]}, 'n': '{r[2]}'}}" for r in rows) + "]).n"


def _rails():
    road, veg = rules.SETS["roads"], rules.SETS["veg"]
    vs = names_in(veg + ["BM_SOIL"])
    wl = "(water_conf >= 0.28 OR (water >= 0.45 AND greatest(road, asphalt, line) < 0.35 AND veg < 0.45))"
    steps = [
        ("m = 'BM_WATER' AND (road >= 0.40 OR asphalt >= 0.38)", _nearest_sql(road)),
        (f"m IN {vs} AND {wl}", "'BM_WATER'"),
        (f"m IN {names_in(rules.SETS['lush'])} AND dry >= 0.60 AND veg < 0.22", _nearest_sql(["BM_LAND_DRY_GRASS", "BM_SOIL", "BM_ROCK"])),
        ("m = 'BM_LAND_DRY_GRASS' AND sand >= 0.50 AND sand > dry + 0.12::DOUBLE AND veg < 0.22 AND grass < 0.15", "'BM_SAND'"),
        ("m = 'BM_LAND_GRASS' AND sand >= 0.45 AND grass < 0.12 AND veg < 0.20", "'BM_SAND'"),
        ("m = 'BM_SAND' AND ((grass >= 0.25 AND veg >= 0.20) OR (veg >= 0.30 AND dry > sand))",
         "CASE WHEN grass >= 0.25 AND veg >= 0.20 THEN 'BM_LAND_GRASS' ELSE 'BM_LAND_DRY_GRASS' END"),
        (f"m = 'BM_WATER' AND NOT {wl}", _nearest_sql(["BM_ASPHALT", "BM_CONCRETE", "BM_PAINT_ASPHALT", "BM_SOIL", "BM_ROCK"])),
        (f"m IN {vs} AND greatest(road, asphalt, line) >= 0.55", _nearest_sql(road)),
        ("m IN ('BM_ASPHALT', 'BM_PAINT_ASPHALT') AND veg >= 0.35 AND grass >= 0.12", _nearest_sql(veg)),
        ("m = 'BM_SAND' AND asphalt >= 0.35 AND dark_gray >= 0.25 AND sand < 0.40", "'BM_ASPHALT'"),
        ("m = 'BM_ASPHALT' AND sand >= 0.50 AND asphalt < 0.25", "'BM_SAND'"),
        (f"m IN {names_in(veg)} AND ({wl} OR water_conf >= 0.30)", "'BM_WATER'"),
    ]
    out, last = {}, "rail_in"
    for i, (cond, to) in enumerate(steps):
        guard = "" if i == 0 else "NOT stop AND "
        out[f"g{i}"] = (f"SELECT * EXCLUDE (m{', stop' if i else ''}), {'(' + cond + ')' if i == 0 else 'stop'} AS stop, "
                        f"CASE WHEN {guard}{cond} THEN {to} ELSE m END AS m FROM {last}")
        last = f"g{i}"
    return out, last


_RAILS, _RAIL_LAST = _rails()
RAIL_CTES = {"rail_in": "SELECT k.*, c.name AS m FROM div d JOIN clusters k USING (model_id, cluster) JOIN classes c ON class_idx = material_idx"} | _RAILS


@query("guardrails", _PAIR, sql("clusters classes", f"SELECT model_id, cluster, m AS material FROM {_RAIL_LAST}", **{
    "rail_in": "SELECT k.*, c.name AS m FROM clusters k JOIN classes c ON class_idx = 1 + (model_id + cluster * 5) % 13"} | _RAILS))
def guardrails(spark, sf):
    names = F.broadcast(classes(spark).selectExpr("class_idx AS _i", "name AS material"))
    given = clusters(spark, sf).withColumn("_i", F.expr("cast(1 + (model_id + cluster * 5) % 13 AS int)")).join(names, "_i")
    return mt.guardrails(given, classes(spark))


@query("greedy_colours", "model_id:l cluster:i material_idx:i", sql("clusters classes", """SELECT model_id, unnest(ks) AS cluster, unnest(acc) AS material_idx FROM gs WHERE n = len(ks)""",
    dist="SELECT model_id, cluster, class_idx AS i, (k.r-c.r)*(k.r-c.r) + (k.g-c.g)*(k.g-c.g) + (k.b-c.b)*(k.b-c.b) AS d FROM clusters k, classes c",
    ord="SELECT model_id, cluster, list(i ORDER BY d, i) AS pref FROM dist GROUP BY ALL",
    gm="SELECT model_id, list(cluster ORDER BY cluster) AS ks, list(pref ORDER BY cluster) AS prefs FROM ord GROUP BY model_id",
    gs="""SELECT model_id, 0 AS n, []::INT[] AS acc, ks, prefs FROM gm UNION ALL
        SELECT model_id, n + 1, list_append(acc, coalesce(list_filter(prefs[n + 1], lambda i: NOT list_contains(acc, i))[1], prefs[n + 1][1])), ks, prefs FROM gs WHERE n < len(ks)"""))
def greedy_colours(spark, sf):
    return mt.greedy_colours(clusters(spark, sf), classes(spark))


@query("color_table", "raster_id:i label:i r:i g:i b:i", sql("scene dims px user_classes", """SELECT raster_id, label,
    CASE WHEN label <= 5 THEN ('0x' || color[2:3])::INT ELSE coalesce(r, 128) END AS r, CASE WHEN label <= 5 THEN ('0x' || color[4:5])::INT ELSE coalesce(g, 128) END AS g,
    CASE WHEN label <= 5 THEN ('0x' || color[6:7])::INT ELSE coalesce(b, 128) END AS b
    FROM (SELECT raster_id, unnest(range(1, 9)) AS label FROM dims) LEFT JOIN (SELECT raster_id, label, floor(avg(b1))::INT AS r, floor(avg(b2))::INT AS g, floor(avg(b3))::INT AS b
    FROM zl GROUP BY ALL) USING (raster_id, label) LEFT JOIN user_classes ON class_idx = label""", **ZONE_LAB))
def color_table(spark, sf):
    given = user_classes(spark, sf).select("class_idx", *pal.hex_channels("color"))
    return mt.color_table(mt.cluster_rgb(zone_labelled(spark, sf), 8), given)


@query("apply_palette", "raster_id:i row:i col:i r:i g:i b:i", sql("scene classes", """SELECT raster_id, row, col, coalesce(c.r, 0) AS r, coalesce(c.g, 0) AS g, coalesce(c.b, 0) AS b
    FROM scene LEFT JOIN classes c ON class_idx = least(13, zone * 3)"""))
def apply_palette(spark, sf):
    labels = scene(spark, sf).selectExpr("raster_id", "row", "col", "zone * 3 AS label")
    return mt.apply_palette(labels, classes(spark).selectExpr("class_idx AS idx", "r", "g", "b"))


@query("rgb_to_label", "raster_id:i row:i col:i label:i", sql("scene classes", """SELECT raster_id, row, col, coalesce(class_idx, 0) AS label FROM (
    SELECT s.*, coalesce(c.r, 0) + CASE WHEN col % 9 = 0 THEN 1 ELSE 0 END AS pr, coalesce(c.g, 0) AS pg, coalesce(c.b, 0) AS pb FROM scene s LEFT JOIN classes c ON c.class_idx = least(13, zone * 3)) p
    LEFT JOIN classes q ON q.r = pr AND q.g = pg AND q.b = pb"""))
def rgb_to_label(spark, sf):
    rgb = apply_palette(spark, sf).withColumn("r", F.expr("r + CASE WHEN col % 9 = 0 THEN 1 ELSE 0 END"))
    return mt.rgb_to_label(rgb, classes(spark))


@query("class_index", "set_id:l id:s idx:i", """SELECT p_partkey // 13 AS set_id, 'class-' || p_partkey AS id, row_number() OVER (PARTITION BY p_partkey // 13 ORDER BY p_partkey) AS idx FROM part""")
def class_index(spark, sf):
    from pyspark.sql import Window as W
    df = table(spark, sf, "part").selectExpr("p_partkey div 13 AS set_id", "concat('class-', p_partkey) AS id", "p_partkey AS pos")
    return df.withColumn("idx", F.row_number().over(W.partitionBy("set_id").orderBy("pos")))
