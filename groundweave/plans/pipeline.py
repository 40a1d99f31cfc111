"""End-to-end plans: train, classify, overlay, batch results.

``raster_id`` is just a grouping key, so one raster and a folder of rasters are the same
job. Actions are the fit, small per-cluster tables, and the final write.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..operators import clustering as cl, features as ft, grouped as gr, materials as mt, postproc as pp, sampling as sp, semantics as sem, vector as vc
from ..functions.palette import hex_channels
from ..session import attach, bounded, cut

DEFAULT_FLAGS = {"spectral": True, "texture": False, "indices": True, "color_indices": False, "entropy": False}


@dataclass
class Model:
    """Standardiser and centres shared by all rasters of a job."""

    features: list[str]
    stats: dict[str, float]
    centers: list[list[float]]

    def assign(self, table: DataFrame) -> DataFrame:
        return cl.assign_nearest(cl.standardize(table, self.features, self.stats), self.features, self.centers)

    def save(self, spark, path: str) -> None:
        """Keep the model as a small Parquet table (one row per centre)."""
        rows = [(i + 1, self.features, c, [self.stats[f"mean_{f}"] for f in self.features], [self.stats[f"scale_{f}"] for f in self.features])
                for i, c in enumerate(self.centers)]
        spark.createDataFrame(rows, "cluster INT, feature ARRAY<STRING>, center ARRAY<DOUBLE>, mean ARRAY<DOUBLE>, scale ARRAY<DOUBLE>").coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark, path: str) -> "Model":
        rows = spark.read.parquet(path).orderBy("cluster").collect()  # k rows
        feats = list(rows[0].feature)
        stats = {f"mean_{f}": v for f, v in zip(feats, rows[0].mean)} | {f"scale_{f}": v for f, v in zip(feats, rows[0].scale)}
        return Model(feats, stats, [list(r.center) for r in rows])


def train(table: DataFrame, features: list[str], k: int, n_total: int | None = None, n_rasters: int = 1, iterations: int = 80, library: bool = False) -> Model:
    """Standardise and cluster all rows (a sample of ``n_total`` on request); the start is the first rows by hash."""
    sample = cut(sp.multi_raster_sample(table.select("raster_id", "row", "col", *features), n_total, n_rasters), "sample")
    stats = cl.scaler_stats(sample, features).first().asDict()
    rows = cl.standardize(sample, features, stats)
    if library:
        return Model(features, stats, cl.fit_kmeans(rows, features, k))
    init = rows.orderBy(F.expr(sp.PIXEL_HASH)).limit(k).collect()  # k rows
    return Model(features, stats, cl.lloyd(rows, features, [[r[f] for f in features] for r in init], iterations))


def shared_mapping(labelled: DataFrame, model: Model, classes: DataFrame) -> DataFrame:
    """One cluster-to-material mapping for the job, from pixel-weighted semantics."""
    spark, k = labelled.sparkSession, len(model.centers)
    scores = sem.semantic_scores(labelled, k)
    counts = labelled.groupBy("raster_id", F.col("label").alias("cluster")).agg(F.count("*").alias("pixels"))
    mean = sem.avg_semantics(scores.join(counts, ["raster_id", "cluster"], "left").fillna(0, ["pixels"]))
    rgb = [(i + 1, *c) for i, c in enumerate(cl.centers_to_rgb(model.centers, model.stats, model.features))]
    colours = spark.createDataFrame(rgb, "cluster INT, r INT, g INT, b INT")
    table = cut(mean.join(F.broadcast(colours), "cluster").withColumn("model_id", F.lit(0)), "clusters")  # k rows
    return cut(mt.map_clusters(table, classes), "mapping")


def class_mapping(labelled: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """Custom classes: cluster i has the colour of class i; further clusters have their own mean colour."""
    means = mt.cluster_rgb(labelled.withColumn("model_id", F.lit(0)), k, ["model_id"])  # k rows
    given = classes.select("class_idx", "name", *hex_channels("color"))
    named = mt.color_table(means, given).join(F.broadcast(given.selectExpr("class_idx AS label", "name")), "label", "left")
    return cut(named.selectExpr("label AS cluster", "label AS material_idx", "name AS material", "r", "g", "b"), "mapping")


def classify(pixels: DataFrame, classes: DataFrame, bands: list[str], k: int | None = None, flags: dict | None = None, smoothing: str = "none",
             model: Model | None = None, mapping: DataFrame | None = None, n_total: int | None = None, iterations: int = 80) -> tuple[DataFrame, Model, DataFrame]:
    """Classified pixels (cluster ``label``, ``material_idx``, r, g, b), the model and the mapping.

    Classes of the preset are mapped by colour, prevalence and semantics; with any other
    name among them cluster i is class i.
    """
    flags = flags or DEFAULT_FLAGS
    names = ft.feature_columns(flags, bands)
    table = cut(ft.feature_table(pixels, flags, bands, [b for b in bands]), "features")
    if model is None:
        n_rasters = table.select("raster_id").distinct().count()
        model = train(table, names, k or classes.count(), n_total, n_rasters, iterations)
    labelled = cut(model.assign(table).select("raster_id", "row", "col", "height", "width", *bands, "label"), "labels")
    if mapping is None:
        preset = mt.is_preset(classes.select(F.lit(0).alias("_set"), "name"), "_set").first()
        if preset and preset["preset"]:
            mapping = shared_mapping(labelled, model, classes)
        else:
            mapping = class_mapping(labelled, classes, len(model.centers))
    smooth = pp.smooth(labelled, smoothing)
    lookup = F.broadcast(mapping.selectExpr("cluster AS label", "material_idx", "material", "r", "g", "b"))  # k rows
    return smooth.join(lookup, "label", "left").fillna(0, ["material_idx", "r", "g", "b"]), model, mapping


def own_mapping(labelled: DataFrame, classes: DataFrame, k: int, metres: str = "4.5D") -> DataFrame:
    """A cluster-to-material mapping for each raster: its own mean colours, counts, scores and scene prior."""
    colours = mt.cluster_rgb(labelled, k)
    scores = sem.semantic_scores(labelled, k)
    counts = labelled.groupBy("raster_id", "label").agg(F.count("*").alias("pixels"))
    table = scores.join(colours.withColumnRenamed("label", "cluster"), ["raster_id", "cluster"]).join(
        counts.withColumnRenamed("label", "cluster"), ["raster_id", "cluster"], "left").fillna(0, ["pixels"])
    table = cut(table.withColumnRenamed("raster_id", "model_id"), "clusters")  # k rows per raster
    _, priors = sem.scene_prior(labelled, classes, metres)
    return cut(mt.map_clusters(table, classes, priors), "mapping")


def classify_each(pixels: DataFrame, classes: DataFrame, bands: list[str], k: int | None = None, flags: dict | None = None, smoothing: str = "none",
                  iterations: int = 80, tol: float = gr.TOLERANCE, metres: str = "4.5D") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every raster by a model and a mapping of its own: classified pixels, models and mappings.

    All rasters are one job. Preset classes are mapped by the raster's own cluster colours, shares,
    semantics and scene prior (``metres`` is the ground size of a pixel, as SQL).
    """
    flags, k = flags or DEFAULT_FLAGS, k or classes.count()
    names = ft.feature_columns(flags, bands)
    table = cut(ft.feature_table(pixels, flags, bands, [b for b in bands]), "features")
    scaled = cut(gr.scale_each(table, names, ["height", "width", *bands])[0], "scaled")
    models = gr.fit_each(gr.pack_blocks(scaled, names), gr.start_models(scaled, names, [k]), len(names), iterations, tol)
    labelled = cut(gr.label_each(scaled, names, models, k).select("raster_id", "row", "col", "height", "width", *bands, "label"), "labels")
    mapping = own_mapping(labelled, classes, k, metres)
    smooth = pp.smooth(labelled, smoothing)
    lookup = mapping.selectExpr("model_id AS raster_id", "cluster AS label", "material_idx", "material", "r", "g", "b")
    return attach(smooth, lookup, ["raster_id", "label"]).fillna(0, ["material_idx", "r", "g", "b"]), models, mapping


# Path of an output with vector layers, from the path of the classified one.
VECTOR_OUTPUT = r"regexp_replace(output, r'^(.*/)?([^/]*?)(?:_classified)?(\.[^./]*)?$', '$1with_vectors/$2_with_vectors$3')"


def overlay(classified: DataFrame, geoms: DataFrame, meta: DataFrame, colours: DataFrame, n_classes: int, cell: float = 4096.0) -> DataFrame:
    """Vector layers, moved to the CRS of each raster, painted over classified pixels, later layers on top."""
    return vc.overlay(classified, vc.rasterize(vc.place_aligned(geoms, meta, cell)), colours, n_classes)


def classify_batch(requests: DataFrame, pixels: DataFrame, classes: DataFrame, bands: list[str], layers: tuple[DataFrame, DataFrame, DataFrame] | None = None,
                   cell: float = 4096.0, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A shared model, all rasters, then all overlays: results per request, painted pixels and the mapping.

    ``layers`` are geometries, raster_meta and layer colours; outputs with them lie in a folder of their own.
    """
    done, _, mapping = classify(pixels.join(bounded(requests.select("raster_id").distinct()), "raster_id", "left_semi"), classes, bands, **options)
    done = cut(done, "batch")
    results = batch_results(requests, done)
    if layers:
        done = cut(overlay(done, *layers, classes.count(), cell), "batch-overlay")
        results = results.withColumn("output", F.when(F.col("status") == "ok", F.expr(VECTOR_OUTPUT)).otherwise(F.col("output")))
    return results, done, mapping


def batch_results(requests: DataFrame, outputs: DataFrame) -> DataFrame:
    """Status per requested raster: missing inputs become error rows, the others go on."""
    done = outputs.groupBy("raster_id").agg(F.count("*").alias("pixels"))
    return requests.join(done, "raster_id", "left").selectExpr(
        "raster_id", "CASE WHEN pixels IS NULL THEN 'error' ELSE 'ok' END AS status",
        "CASE WHEN pixels IS NULL THEN 'raster not found' END AS message", "coalesce(pixels, 0) AS pixels", "output")


def batch_summary(results: DataFrame, keys: list[str]) -> DataFrame:
    """ok / n, message, status, sorted output paths and errors of a batch."""
    s = results.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col("status") == "ok").alias("ok"), F.min(F.when(F.col("status") == "ok", F.col("output"))).alias("first_output"),
                                   F.sort_array(F.collect_list(F.when(F.col("status") == "ok", F.col("output")))).alias("output_paths"),
                                   F.sort_array(F.collect_list(F.when(F.col("status") != "ok", F.struct("raster_id", "message")))).alias("errors"))
    return s.selectExpr(*keys, "n", "ok", "CASE WHEN ok > 0 THEN 'ok' ELSE 'error' END AS status", "concat('Batch complete: ', ok, '/', n, ' succeeded') AS message", "first_output", "output_paths", "errors")


def duration_text(seconds: str) -> str:
    """Readable duration: below 0.01 s, below a minute, or minutes and seconds."""
    return (f"CASE WHEN {seconds} < 0.01D THEN '<0.01s' WHEN {seconds} < 60 THEN format_string('%.2fs', bround({seconds}, 2)) "
            f"ELSE format_string('%dm %.1fs', cast(floor({seconds} / 60) AS bigint), bround({seconds} - 60 * floor({seconds} / 60), 1)) END")


def stage_table(stages: DataFrame, keys: list[str]) -> DataFrame:
    """Duration text and share of every stage, and a TOTAL row per key."""
    per = stages.groupBy(*keys, "stage").agg(F.sum("seconds").alias("seconds"))
    total = per.groupBy(*keys).agg(F.sum("seconds").alias("total"))
    rows = per.join(total, keys).unionByName(total.selectExpr(*keys, "'TOTAL' AS stage", "total AS seconds", "total"))
    return rows.selectExpr(*keys, "stage", "seconds", f"{duration_text('seconds')} AS time_text",
                           "format_string('%.1f%%', bround(CASE WHEN total > 0 THEN seconds / total * 100 WHEN stage = 'TOTAL' THEN 100D ELSE 0D END, 1)) AS share_text")


# Weight of each phase, the default weight, and the total per pipeline.
PHASE_WEIGHTS = {
    "Loading raster": 5, "Feature extraction": 35, "KMeans clustering": 20, "Pixel assignment": 15, "Classifying tiles": 35, "Saving output": 15,
    "Loading classified raster": 5, "Converting to label raster": 10, "Saving result": 15, "Training shared model": 15, "Classifying": 5,
    "Loading SAM 3 model": 10, "Extracting roads": 70, "Morphological closing": 10, "Merging road mask": 80,
}
DEFAULT_PHASE_WEIGHT = 5
PIPELINE_TOTALS = {"step1": 100, "full": 180, "mea": 180, "step2": 80, "road_extract": 100, "road_merge": 100}
WEIGHT = "coalesce(map(" + ", ".join(f"'{p}', {w}" for p, w in PHASE_WEIGHTS.items()) + f")[phase], {DEFAULT_PHASE_WEIGHT})"


def progress_rollup(events: DataFrame, pipeline: str = "step1", slot: str = "date_trunc('hour', ts)") -> DataFrame:
    """Weighted percent at every event: a phase is complete when another one begins.

    Sums run within a task's time slot and then over its slots, so a task with most of
    the events is still spread over many tasks.
    """
    from pyspark.sql import Window as W

    df = events.withColumns({"w": F.expr(WEIGHT), "slot": F.expr(slot)})
    inner = W.partitionBy("task_id", "slot").orderBy("ts", "seq")
    df = df.withColumns({"prev": F.lag("phase").over(inner), "prev_w": F.lag("w").over(inner)})
    df = df.withColumn("gain", F.when(F.col("prev") != F.col("phase"), F.col("prev_w")).otherwise(0)).withColumn(
        "inside", F.sum("gain").over(inner.rowsBetween(W.unboundedPreceding, 0)))
    at = F.struct("ts", "seq")
    slots = df.groupBy("task_id", "slot").agg(F.sum("gain").alias("slot_gain"), F.min_by("phase", at).alias("first"), F.max_by("phase", at).alias("last"), F.max_by("w", at).alias("last_w"))
    order = W.partitionBy("task_id").orderBy("slot")
    slots = slots.withColumn("enter", F.when(F.lag("last").over(order) != F.col("first"), F.lag("last_w").over(order)).otherwise(0))
    slots = slots.withColumn("before", F.sum(F.col("slot_gain") + F.col("enter")).over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("slot_gain"))
    df = df.join(slots.select("task_id", "slot", "before"), ["task_id", "slot"])
    share = "CASE WHEN total > 0 THEN done / cast(total AS double) ELSE 0D END"
    return df.selectExpr("task_id", "seq", "phase", f"least(99D, (before + inside + w * {share}) / {PIPELINE_TOTALS[pipeline]}D * 100D) AS percent")


def progress_latest(events: DataFrame, pipeline: str = "step1") -> DataFrame:
    """Percent per task from the furthest point of each phase (the form kept on a stream)."""
    per_phase = events.groupBy("task_id", "phase").agg(F.max(F.expr("CASE WHEN total > 0 THEN done / cast(total AS double) ELSE 0D END")).alias("share"))
    return progress_from_phases(per_phase, pipeline)


def progress_from_phases(per_phase: DataFrame, pipeline: str = "step1") -> DataFrame:
    return per_phase.groupBy("task_id").agg(F.sum(F.expr(f"{WEIGHT} * share")).alias("w")).selectExpr(
        "task_id", f"least(99D, w / {PIPELINE_TOTALS[pipeline]}D * 100D) AS percent")
