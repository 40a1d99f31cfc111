"""Queries over whole pipelines, batches and streams."""

from pyspark.sql import functions as F

from ..functions import palette as pal
from ..oracle.base import CTES, box, components, boxes, sql
from ..session import scratch_path
from ..streaming import arrivals
from . import pipeline as pl
from .fixtures import SCORES, classes, mixed_geoms, pixel_table, progress, raster_meta, scene, table, user_classes
from .q_clustering import _move
from .q_materials import CONT_CTES, DIV_CTES, MASK_CTES, SCORE_CTES, _RAILS, _RAIL_LAST, _ZM
from .q_postproc import around
from .q_vectors import ALL_KINDS, LAYER_CTES, coloured
from .registry import query

PX = "raster_id:i row:i col:i "
BANDS = ["b1", "b2", "b3", "b4"]
K = 7
ITERATIONS = 4  # a fixed number, as the SQL unrolls them
FEATS = ["f_b1", "f_b2", "f_b3", "f_b4", "f_ndvi"]


def _run(spark, sf, smoothing="none"):
    return pl.classify(scene(spark, sf), classes(spark), BANDS, k=K, smoothing=smoothing, iterations=ITERATIONS)


def _near(points, centers):
    d = " + ".join(f"(p.{f}-c.{f})*(p.{f}-c.{f})" for f in FEATS)
    return f"SELECT p.*, c.k AS label FROM {points} p JOIN {centers} c ON true QUALIFY row_number() OVER (PARTITION BY p.raster_id, p.row, p.col ORDER BY {d}, c.k) = 1"


def _next(prev, lab):
    return "SELECT c.k, " + ", ".join(f"coalesce(avg(l.{f}), any_value(c.{f})) AS {f}" for f in FEATS) + f" FROM {prev} c LEFT JOIN {lab} l ON l.label = c.k GROUP BY c.k"


_STD = ", ".join(f"({f} - m_{f}) / s_{f} AS {f}" for f in FEATS)
_SCORE_PART = {k: v for k, v in SCORE_CTES.items() if k != "zl"}
PIPE = {
    "bs": box("px", {f"m{i}": f"q.b{i}" for i in range(1, 5)}, 3),
    "ff": "SELECT raster_id, row, col, m1/9 AS f_b1, m2/9 AS f_b2, m3/9 AS f_b3, m4/9 AS f_b4, (b4 - b3) / (b4 + b3 + 1e-6) AS f_ndvi, md5(concat_ws('/', raster_id, row, col)) AS h FROM bs JOIN px USING (raster_id, row, col)",
    "sample": "SELECT * FROM ff",
    "stt": "SELECT " + ", ".join(f"avg({f}) AS m_{f}, coalesce(nullif(stddev_pop({f}), 0), 1) AS s_{f}" for f in FEATS) + " FROM sample",
    "train": f"SELECT raster_id, row, col, h, {_STD} FROM sample, stt",
    "k0": f"SELECT row_number() OVER (ORDER BY h) AS k, {', '.join(FEATS)} FROM train QUALIFY row_number() OVER (ORDER BY h) <= {K}",
    **{name: text for i in range(ITERATIONS) for name, text in ((f"t{i}", _near("train", f"k{i}")), (f"k{i + 1}", _next(f"k{i}", f"t{i}")))},
    "alls": f"SELECT raster_id, row, col, {_STD} FROM ff, stt", "lab7": _near("alls", f"k{ITERATIONS}"),
    "zl": "SELECT px.* EXCLUDE (zone), label FROM px JOIN lab7 USING (raster_id, row, col)",
    **_SCORE_PART,
}
# The mask step labels pixels by zone; here it takes the cluster labels.
PIPE["sc"] = MASK_CTES["sc"].replace("s.zone + 1 AS label", "l7.label").replace("FROM scene s JOIN", "FROM scene s JOIN lab7 l7 USING (raster_id, row, col) JOIN")
PIPE |= {
    "crgb": """SELECT k AS cluster, greatest(0, least(255, round_even(f_b1 * s_f_b1 + m_f_b1, 0)))::INT AS r, greatest(0, least(255, round_even(f_b2 * s_f_b2 + m_f_b2, 0)))::INT AS g,
        greatest(0, least(255, round_even(f_b3 * s_f_b3 + m_f_b3, 0)))::INT AS b FROM k%d, stt""" % ITERATIONS,
    "avgs": "SELECT label AS cluster, sum(px) AS pixels, " + ", ".join(f"sum({s} * px) / sum(px) AS {s}" for s in SCORES) + " FROM scores GROUP BY label",
    "clusters": "SELECT 0 AS model_id, crgb.cluster, r, g, b, coalesce(pixels, 0) AS pixels, " + ", ".join(f"coalesce({s}, 0) AS {s}" for s in SCORES) + " FROM crgb LEFT JOIN avgs USING (cluster)",
    **DIV_CTES,
    "rail_in": "SELECT k.*, c.name AS m FROM div d JOIN clusters k USING (model_id, cluster) JOIN classes c ON class_idx = material_idx", **_RAILS,
    "mapped": f"SELECT cluster, class_idx AS material_idx, c.name AS material, c.r, c.g, c.b FROM {_RAIL_LAST} x JOIN classes c ON c.name = x.m",
}
DEPS = "scene dims px classes"
_CLASSIFIED = "SELECT raster_id, row, col, label, material, mapped.r, mapped.g, mapped.b FROM lab7 JOIN mapped ON cluster = label"


@query("classify_scene", PX + "label:i material:s r:i g:i b:i", sql(DEPS, _CLASSIFIED, **PIPE))
def classify_scene(spark, sf):
    return _run(spark, sf)[0]


@query("classify_custom", PX + "label:i material:s r:i g:i b:i", sql(DEPS + " user_classes", """SELECT l.raster_id, l.row, l.col, label, u.name AS material,
    coalesce(('0x' || u.color[2:3])::INT, m.r) AS r, coalesce(('0x' || u.color[4:5])::INT, m.g) AS g, coalesce(('0x' || u.color[6:7])::INT, m.b) AS b
    FROM lab7 l LEFT JOIN (SELECT label, floor(avg(b1))::INT AS r, floor(avg(b2))::INT AS g, floor(avg(b3))::INT AS b FROM lab7 JOIN px USING (raster_id, row, col) GROUP BY label) m USING (label)
    LEFT JOIN user_classes u ON class_idx = label""", **PIPE))
def classify_custom(spark, sf):
    return pl.classify(scene(spark, sf), user_classes(spark, sf), BANDS, k=K, iterations=ITERATIONS)[0]


@query("shared_color_table", "cluster:i material:s r:i g:i b:i", sql(DEPS, "SELECT cluster, material, r, g, b FROM mapped", **PIPE))
def shared_color_table(spark, sf):
    return _run(spark, sf)[2]


FULL = {**PIPE, **LAYER_CTES, **ALL_KINDS, "top_layer": "SELECT raster_id, row, col, max(layer_idx) AS layer_idx FROM burned GROUP BY ALL",
    "cls": _CLASSIFIED}


@query("classify_full", PX + "r:i g:i b:i", sql(DEPS + " meta anchors verts user_classes layers", """SELECT c.raster_id, c.row, c.col, coalesce(p.r, c.r) AS r, coalesce(p.g, c.g) AS g, coalesce(p.b, c.b) AS b
    FROM cls c LEFT JOIN top_layer t USING (raster_id, row, col) LEFT JOIN coloured p ON p.layer_idx = t.layer_idx""", **FULL))
def classify_full(spark, sf):
    done = _run(spark, sf)[0]
    return pl.overlay(done, mixed_geoms(spark, sf), raster_meta(spark, sf), coloured(spark, sf), 13, 64.0)


BATCH = {**PIPE,
    "sm": f"""SELECT p.raster_id, p.row, p.col, list_sort(list(q.label))[count(*) // 2 + 1] AS label FROM lab7 p, {around(1, 'dy')}, {around(1, 'dx')}
        JOIN lab7 q ON q.raster_id = p.raster_id AND q.row = p.row + dy AND q.col = p.col + dx WHERE dy*dy + dx*dx <= 1 GROUP BY p.raster_id, p.row, p.col""",
    "req": "SELECT raster_id + o AS raster_id, '/out/scene_' || (raster_id + o) || '_classified.tif' AS output FROM dims, (SELECT unnest([0, 100000]) AS o)",
    "res": """SELECT req.raster_id, material, output, count(sm.row) AS pixels FROM req LEFT JOIN sm USING (raster_id) LEFT JOIN mapped ON cluster = label GROUP BY ALL"""}


def requested(spark, sf):
    meta = raster_meta(spark, sf).select("raster_id")
    both = meta.selectExpr("explode(array(raster_id, raster_id + 100000)) AS raster_id")
    return both.selectExpr("raster_id", "concat('/out/scene_', raster_id, '_classified.tif') AS output")


def batch(spark, sf):
    layers = mixed_geoms(spark, sf), raster_meta(spark, sf), coloured(spark, sf)
    return pl.classify_batch(requested(spark, sf), scene(spark, sf), classes(spark), BANDS, layers, 64.0, k=K, smoothing="median_1", iterations=ITERATIONS)


@query("classify_batch", "raster_id:i material:s pixels:l status:s message:s", sql(DEPS, """SELECT raster_id, material, pixels, CASE WHEN material IS NULL THEN 'error' ELSE 'ok' END AS status,
    CASE WHEN material IS NULL THEN 'raster not found' END AS message FROM res""", **BATCH))
def classify_batch(spark, sf):
    results, done, _ = batch(spark, sf)
    per = done.groupBy("raster_id", "material").agg(F.count("*").alias("n"))
    return results.drop("pixels").join(per, "raster_id", "left").withColumn("pixels", F.coalesce("n", F.lit(0)))


@query("classify_batch_overlay", PX + "r:i g:i b:i output:s", sql(DEPS + " meta anchors verts user_classes layers", """SELECT s.raster_id, s.row, s.col, coalesce(p.r, m.r) AS r, coalesce(p.g, m.g) AS g, coalesce(p.b, m.b) AS b,
    '/out/with_vectors/scene_' || s.raster_id || '_with_vectors.tif' AS output
    FROM sm s JOIN mapped m ON m.cluster = s.label LEFT JOIN top_layer t USING (raster_id, row, col) LEFT JOIN coloured p ON p.layer_idx = t.layer_idx""", **(FULL | BATCH)))
def classify_batch_overlay(spark, sf):
    results, done, _ = batch(spark, sf)
    return done.join(results.select("raster_id", "output"), "raster_id")


@query("batch_summary", "grp:i n:l ok:l status:s message:s first_output:s outputs:s failed:s", sql("scene dims", """SELECT raster_id % 2 AS grp, count(*) AS n, count(*) FILTER (WHERE ok) AS ok,
    CASE WHEN bool_or(ok) THEN 'ok' ELSE 'error' END AS status, 'Batch complete: ' || count(*) FILTER (WHERE ok) || '/' || count(*) || ' succeeded' AS message,
    min(output) FILTER (WHERE ok) AS first_output, string_agg(output, '|' ORDER BY output) FILTER (WHERE ok) AS outputs,
    string_agg(raster_id || ': raster not found', '|' ORDER BY raster_id) FILTER (WHERE NOT ok) AS failed FROM (SELECT raster_id + o AS raster_id, o = 0 AS ok, '/out/scene_' || (raster_id + o) || '_classified.tif' AS output FROM dims, (SELECT unnest([0, 100000]) AS o)) GROUP BY raster_id % 2"""))
def batch_summary(spark, sf):
    results = pl.batch_results(requested(spark, sf), scene(spark, sf)).withColumn("grp", F.expr("cast(raster_id % 2 AS int)"))
    return pl.batch_summary(results, ["grp"]).withColumns({
        "outputs": F.array_join("output_paths", "|"), "failed": F.array_join(F.expr("transform(errors, e -> concat(e.raster_id, ': ', e.message))"), "|")})


@query("stage_table", "task_id:l stage:s seconds:d3 time_text:s share_text:s", sql("", """SELECT task_id, stage, seconds, CASE WHEN seconds < 0.01 THEN '<0.01s' WHEN seconds < 60 THEN printf('%.2fs', seconds)
    ELSE printf('%dm %.1fs', floor(seconds / 60)::BIGINT, seconds - 60 * floor(seconds / 60)) END AS time_text, printf('%.1f%%', CASE WHEN total > 0 THEN seconds / total * 100 ELSE 0 END) AS share_text FROM (
    SELECT task_id, stage, seconds, sum(seconds) OVER (PARTITION BY task_id) AS total FROM st UNION ALL SELECT task_id, 'TOTAL', sum(seconds), sum(seconds) FROM st GROUP BY task_id)""",
    st="SELECT user_id % 20 AS task_id, event_type AS stage, sum(event_id % 5)::DOUBLE * 0.125 AS seconds FROM events GROUP BY ALL"))
def stage_table(spark, sf):
    stages = table(spark, sf, "events").selectExpr("user_id % 20 AS task_id", "event_type AS stage", "(event_id % 5) * 0.125D AS seconds")
    return pl.stage_table(stages, ["task_id"])


_W = "CASE phase " + " ".join(f"WHEN '{p}' THEN {w}" for p, w in pl.PHASE_WEIGHTS.items()) + f" ELSE {pl.DEFAULT_PHASE_WEIGHT} END"


@query("progress_rollup", "task_id:l seq:l phase:s percent:d6", sql("progress", """SELECT task_id, seq, phase, least(99, (coalesce(sum(gain) OVER (PARTITION BY task_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING), 0) + w * done / 100.0::DOUBLE) / 100.0::DOUBLE * 100) AS percent
    FROM (SELECT *, CASE WHEN lag(phase) OVER (PARTITION BY task_id ORDER BY ts, seq) <> phase THEN lag(w) OVER (PARTITION BY task_id ORDER BY ts, seq) ELSE 0 END AS gain
      FROM (SELECT *, """ + _W + """ AS w FROM progress))"""))
def progress_rollup(spark, sf):
    return pl.progress_rollup(progress(spark, sf))


@query("stream_progress", "task_id:l percent:d6", sql("progress", f"""SELECT task_id, least(99, sum(w * share) / 100 * 100) AS percent FROM (
    SELECT task_id, phase, {_W} AS w, max(done / 100.0::DOUBLE) AS share FROM progress GROUP BY task_id, phase) GROUP BY task_id"""))
def stream_progress(spark, sf):
    folder, out, state = (scratch_path(spark, n) for n in ("events", "progress", "state"))
    events = progress(spark, sf)
    events.write.parquet(folder)
    arrivals.progress_stream(spark, folder, events.schema, out, state, files=2)
    return arrivals.latest(spark, out)


@query("stream_classify", PX + "label:i material:s r:i g:i b:i", sql(DEPS, _CLASSIFIED, **PIPE))
def stream_classify(spark, sf):
    px = pixel_table(spark, sf).drop("label", "zone")
    _, model, mapping = _run(spark, sf)
    folder, out, state = (scratch_path(spark, n) for n in ("incoming", "classified", "state"))
    px.repartition(3, F.expr("xxhash64(raster_id, row, col)")).write.parquet(folder)  # every raster is split over all files
    arrivals.classify_arrivals(spark, folder, px.schema, out, state, model, mapping, classes(spark), BANDS, files=1)
    return spark.read.parquet(out)
