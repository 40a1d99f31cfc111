"""Queries over models of single rasters: training, scores over k, recommended k, own mappings."""

from pyspark.sql import functions as F

from ..operators import clustering as cl, features as ft, grouped as gr
from ..oracle.base import sql
from . import pipeline as pl
from .fixtures import SCORES, classes, scene, sized
from .q_materials import DIV_CTES, MASK_CTES, SCORE_CTES, _OPEN, _RAILS, _RAIL_LAST, _URBAN, _WEIGHT, _ZONES
from .q_pipeline import BANDS, FEATS, PIPE, PX
from .registry import query

K, ROUNDS = 7, 4  # fixed numbers, as the SQL unrolls them
LO, HI, SWEEP_ROUNDS = 2, 10, 3


def _d2(a, b):
    return " + ".join(f"({a}.{f}-{b}.{f})*({a}.{f}-{b}.{f})" for f in FEATS)


def _near(points, centers):
    return f"""SELECT p.*, c.k, c.c AS label, {_d2('p', 'c')} AS away FROM {points} p JOIN {centers} c USING (raster_id)
        QUALIFY row_number() OVER (PARTITION BY p.raster_id, p.row, p.col, c.k ORDER BY {_d2('p', 'c')}, c.c) = 1"""


def _next(prev, lab):
    return "SELECT c.raster_id, c.k, c.c, " + ", ".join(f"coalesce(avg(l.{f}), any_value(c.{f})) AS {f}" for f in FEATS) + (
        f" FROM {prev} c LEFT JOIN {lab} l ON l.raster_id = c.raster_id AND l.k = c.k AND l.label = c.c GROUP BY ALL".replace("GROUP BY ALL", "GROUP BY c.raster_id, c.k, c.c"))


def _trained(ks, rounds):
    std = ", ".join(f"({f} - m_{f}) / s_{f} AS {f}" for f in FEATS)
    return {
        "bs": PIPE["bs"], "ff": PIPE["ff"],
        "stt": "SELECT raster_id, " + ", ".join(f"avg({f}) AS m_{f}, coalesce(nullif(stddev_pop({f}), 0), 1) AS s_{f}" for f in FEATS) + " FROM ff GROUP BY raster_id",
        "train": f"SELECT raster_id, row, col, h, {std} FROM ff JOIN stt USING (raster_id)",
        "k0": f"""SELECT raster_id, k, c, {', '.join(FEATS)} FROM (SELECT *, row_number() OVER (PARTITION BY raster_id ORDER BY h) AS c FROM train), (SELECT unnest({list(ks)}) AS k) WHERE c <= k""",
        **{name: text for i in range(rounds) for name, text in ((f"t{i}", _near("train", f"k{i}")), (f"k{i + 1}", _next(f"k{i}", f"t{i}")))},
        "lab7": _near("train", f"k{rounds}"),
    }


def feature_rows(spark, sf):
    return ft.feature_table(sized(scene(spark, sf)), pl.DEFAULT_FLAGS, BANDS).select("raster_id", "row", "col", *FEATS)


_MEASURED = _trained(range(LO, HI + 1), SWEEP_ROUNDS) | {
    "cent": "SELECT raster_id, k, label, count(*) AS n, " + ", ".join(f"avg({f}) AS {f}" for f in FEATS) + f", avg({' + '.join(f'{f}*{f}' for f in FEATS)}) AS sq FROM lab7 GROUP BY raster_id, k, label",
    # mean squared distance of a row to the rows of a cluster: to its mean, and the cluster's variance
    "dist": f"""SELECT l.raster_id, l.k, l.row, l.col, l.label, c.label AS other, c.n, ({_d2('l', 'c')}) + c.sq - ({' + '.join(f'c.{f}*c.{f}' for f in FEATS)}) AS d
        FROM lab7 l JOIN cent c ON c.raster_id = l.raster_id AND c.k = l.k""",
    "ab": """SELECT raster_id, k, row, col, max(n) FILTER (WHERE label = other) AS size, max(d * n / greatest(n - 1, 1)) FILTER (WHERE label = other) AS a, min(d) FILTER (WHERE label <> other) AS b
        FROM dist GROUP BY raster_id, k, row, col""",
    "sil": "SELECT raster_id, k, avg(CASE WHEN size > 1 AND b IS NOT NULL AND greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0 END) AS silhouette FROM ab GROUP BY raster_id, k",
    "whole": "SELECT raster_id, k, " + ", ".join(f"avg({f}) AS {f}" for f in FEATS) + ", count(*) AS n, sum(away) AS inertia FROM lab7 GROUP BY raster_id, k",
    "bet": f"SELECT c.raster_id, c.k, sum(c.n * ({_d2('c', 'w')})) AS b, count(*) AS used FROM cent c JOIN whole w ON w.raster_id = c.raster_id AND w.k = c.k GROUP BY c.raster_id, c.k",
    "wit": f"SELECT l.raster_id, l.k, sum({_d2('l', 'c')}) AS w FROM lab7 l JOIN cent c ON c.raster_id = l.raster_id AND c.k = l.k AND c.label = l.label GROUP BY l.raster_id, l.k",
    "spr": f"SELECT l.raster_id, l.k, l.label, avg(sqrt({_d2('l', 'c')})) AS s FROM lab7 l JOIN cent c ON c.raster_id = l.raster_id AND c.k = l.k AND c.label = l.label GROUP BY l.raster_id, l.k, l.label",
    "dbs": f"""SELECT raster_id, k, avg(w) AS db FROM (SELECT i.raster_id, i.k, i.label, max((si.s + sj.s) / sqrt({_d2('i', 'j')})) AS w FROM cent i JOIN cent j ON i.raster_id = j.raster_id AND i.k = j.k AND i.label <> j.label
        JOIN spr si ON si.raster_id = i.raster_id AND si.k = i.k AND si.label = i.label JOIN spr sj ON sj.raster_id = j.raster_id AND sj.k = j.k AND sj.label = j.label GROUP BY i.raster_id, i.k, i.label) GROUP BY raster_id, k""",
    "measured": """SELECT raster_id, k, silhouette, (b / (used - 1)) / (w / (n - used)) AS ch, db, inertia FROM whole JOIN sil USING (raster_id, k) JOIN bet USING (raster_id, k)
        JOIN wit USING (raster_id, k) JOIN dbs USING (raster_id, k)""",
    "curved": """SELECT *, greatest(0, coalesce(ln(lag(inertia) OVER w) - 2 * ln(inertia) + ln(lead(inertia) OVER w), 0)) AS curvature FROM measured WINDOW w AS (PARTITION BY raster_id ORDER BY k)""",
    "chosen": """SELECT raster_id, min(k) AS k FROM (SELECT *, max(score) OVER (PARTITION BY raster_id) AS best FROM (
    SELECT raster_id, k, 0.45 * coalesce((silhouette - min(silhouette) OVER w) / nullif(max(silhouette) OVER w - min(silhouette) OVER w, 0), 0.5)
      + 0.25 * coalesce((ch - min(ch) OVER w) / nullif(max(ch) OVER w - min(ch) OVER w, 0), 0.5)
      + 0.20 * coalesce((max(db) OVER w - db) / nullif(max(db) OVER w - min(db) OVER w, 0), 0.5)
      + 0.10 * coalesce((curvature - min(curvature) OVER w) / nullif(max(curvature) OVER w - min(curvature) OVER w, 0), 0.5)
      - 0.05 * (k - min(k) OVER w)::DOUBLE / greatest(1, max(k) OVER w - min(k) OVER w) AS score FROM curved WINDOW w AS (PARTITION BY raster_id))) WHERE best - score <= 0.03 GROUP BY raster_id""",
}


@query("sweep_scores", "raster_id:i k:i silhouette:d5 ch:d2 db:d5 inertia:d3", sql("scene dims px", "SELECT * FROM measured", **_MEASURED))
def sweep_scores(spark, sf):
    return gr.score_each(feature_rows(spark, sf), FEATS, list(range(LO, HI + 1)), SWEEP_ROUNDS, 0.0)


@query("recommend_k", "raster_id:i k:i", sql("scene dims px", "SELECT * FROM chosen", **_MEASURED))
def recommend_k(spark, sf):
    return gr.recommend_each(feature_rows(spark, sf), FEATS, LO, HI, SWEEP_ROUNDS)


@query("folder_median_k", "k:i", sql("scene dims px", "SELECT round_even(quantile_cont(k, 0.5), 0) AS k FROM chosen", **_MEASURED))
def folder_median_k(spark, sf):
    return cl.folder_median_k(recommend_k(spark, sf))


@query("kmeans_each", "raster_id:i c:i " + " ".join(f"{f}:d5" for f in FEATS), sql("scene dims px", f"SELECT raster_id, c, {', '.join(FEATS)} FROM k{ROUNDS}", **_trained([K], ROUNDS)))
def kmeans_each(spark, sf):
    scaled = gr.scale_each(feature_rows(spark, sf), FEATS)[0]
    models = gr.fit_each(gr.pack_blocks(scaled, FEATS), gr.start_models(scaled, FEATS, [K]), len(FEATS), ROUNDS, 0.0)
    d = len(FEATS)
    each = models.selectExpr("raster_id", "centers", "explode(sequence(1, k)) AS c")
    return each.select("raster_id", "c", *[F.expr(f"centers[(c - 1) * {d} + {i}]").alias(f) for i, f in enumerate(FEATS)])


_EACH = _trained([K], ROUNDS) | {
    "zl": "SELECT px.* EXCLUDE (zone), label FROM px JOIN lab7 USING (raster_id, row, col)",
    **{k: v for k, v in SCORE_CTES.items() if k != "zl"},
    "sc": MASK_CTES["sc"].replace("s.zone + 1 AS label", "l7.label").replace("FROM scene s JOIN", "FROM scene s JOIN lab7 l7 USING (raster_id, row, col) JOIN"),
    "mean_rgb": "SELECT raster_id, label, floor(avg(b1))::INT AS r, floor(avg(b2))::INT AS g, floor(avg(b3))::INT AS b FROM zl GROUP BY raster_id, label",
    "clusters": "SELECT e.raster_id AS model_id, e.cluster, coalesce(m.r, 128) AS r, coalesce(m.g, 128) AS g, coalesce(m.b, 128) AS b, coalesce(px, 0) AS pixels, " + ", ".join(f"coalesce(s.{s}, 0) AS {s}" for s in SCORES)
        + f""" FROM (SELECT raster_id, unnest(range(1, {K + 1})) AS cluster FROM dims) e LEFT JOIN scores s ON s.raster_id = e.raster_id AND s.label = e.cluster
        LEFT JOIN mean_rgb m ON m.raster_id = e.raster_id AND m.label = e.cluster""",
    "zo": _ZONES, "zs": "SELECT raster_id, zone, greatest(1, quantile_cont(v, 0.98)) AS scale FROM (SELECT raster_id, zone, unnest([b1, b2, b3])::DOUBLE AS v FROM zo) GROUP BY ALL",
    "zsc": "SELECT *, greatest(s1, s2, s3) AS mx, least(s1, s2, s3) AS mn FROM (SELECT raster_id, zone, least(1, b1 / scale) AS s1, least(1, b2 / scale) AS s2, least(1, b3 / scale) AS s3 FROM zo JOIN zs USING (raster_id, zone))",
    "zw": f"SELECT raster_id, avg({_WEIGHT}) AS open_weight FROM (SELECT raster_id, zone, {_OPEN} FROM zsc GROUP BY raster_id, zone) GROUP BY raster_id",
    "prior": f"SELECT raster_id AS prior_id, name, (1 - open_weight) * u + open_weight * o AS u FROM zw, {_URBAN}",
    **DIV_CTES,
    "prev": DIV_CTES["prev"].replace(f"JOIN {_URBAN} ON name = material", "JOIN prior v ON v.prior_id = c.model_id AND name = material"),
    "rail_in": "SELECT k.*, c.name AS m FROM div d JOIN clusters k USING (model_id, cluster) JOIN classes c ON class_idx = material_idx", **_RAILS,
    "mapped": f"SELECT model_id, cluster, c.name AS material, c.r, c.g, c.b FROM {_RAIL_LAST} x JOIN classes c ON c.name = x.m",
}


@query("classify_each", PX + "label:i material:s r:i g:i b:i", sql("scene dims px classes", """SELECT l.raster_id, l.row, l.col, label, material, mapped.r, mapped.g, mapped.b
    FROM lab7 l JOIN mapped ON cluster = label AND model_id = l.raster_id""", **_EACH))
def classify_each(spark, sf):
    return pl.classify_each(sized(scene(spark, sf)), classes(spark), BANDS, K, iterations=ROUNDS, tol=0.0)[0]


@query("own_color_tables", "raster_id:i cluster:i material:s r:i g:i b:i", sql("scene dims px classes", "SELECT model_id AS raster_id, cluster, material, r, g, b FROM mapped", **_EACH))
def own_color_tables(spark, sf):
    return pl.classify_each(sized(scene(spark, sf)), classes(spark), BANDS, K, iterations=ROUNDS, tol=0.0)[2].withColumnRenamed("model_id", "raster_id")
