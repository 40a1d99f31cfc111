"""Rasters and progress events that arrive as streams of files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans import pipeline
from ..session import bounded, cut

HELD = 64  # parts of the pixels that a batch brings


def _versions(spark: SparkSession, folder: str, schema: str, upto: int | None = None) -> DataFrame:
    """Rows of folder/batch=0, 1, ... (up to a batch), with the column batch; none if there is no folder yet."""
    try:
        found = spark.read.schema(f"{schema}, batch BIGINT").parquet(folder)
    except AnalysisException:
        return spark.createDataFrame([], f"{schema}, batch BIGINT")
    return found if upto is None else found.where(F.col("batch") <= upto)


def whole_rasters(batch: DataFrame, batch_id: int, state: str) -> DataFrame:
    """The pixels of every raster that this batch completes, with those that earlier batches brought.

    State is three tables of one folder a batch, so a repeated batch overwrites only what it
    wrote: ``held`` (pixels in HELD parts by a hash of the raster, ordered by raster), ``seen`` (rows
    per raster) and ``done``. The files of a batch are as many as its parts, however many rasters it
    brings, and only parts of rasters whose rows could suffice are read again. A pixel that comes twice counts once; rows of a raster
    that is done already are held but not classified again.
    """
    spark, schema = batch.sparkSession, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in batch.schema.fields)
    part = F.pmod(F.xxhash64("raster_id"), F.lit(HELD)).cast("int")
    batch.withColumn("part", part).repartition(HELD, "part").sortWithinPartitions("part", "raster_id").write.mode("overwrite").partitionBy("part").parquet(f"{state}/held/batch={batch_id}")
    arrived = batch.groupBy("raster_id").agg(F.count("*").alias("n"), F.max(F.expr("cast(height AS bigint) * width")).alias("need"))
    arrived.write.mode("overwrite").parquet(f"{state}/seen/batch={batch_id}")
    seen = _versions(spark, f"{state}/seen", "raster_id INT, n BIGINT, need BIGINT", batch_id)
    done = _versions(spark, f"{state}/done", "raster_id INT", batch_id - 1)
    touched = seen.where(F.col("batch") == batch_id).select("raster_id")
    enough = seen.join(bounded(touched), "raster_id", "left_semi").groupBy("raster_id").agg(F.sum("n").alias("n"), F.max("need").alias("need")).where("n >= need")
    enough = bounded(enough.join(done, "raster_id", "left_anti").select("raster_id", "need"))
    parts = [r["part"] for r in enough.select(part.alias("part")).distinct().collect()]  # HELD at most
    held = _versions(spark, f"{state}/held", f"{schema}, part INT", batch_id).where(F.col("part").isin(parts)).drop("part").join(enough, "raster_id")
    once = cut(held.dropDuplicates(["raster_id", "row", "col"]), "arrived")
    full = bounded(once.groupBy("raster_id", "need").agg(F.count("*").alias("n")).where("n >= need").select("raster_id"))
    full.write.mode("overwrite").parquet(f"{state}/done/batch={batch_id}")
    return once.join(full, "raster_id", "left_semi").select(batch.columns)


def classify_arrivals(spark: SparkSession, folder: str, schema, out: str, checkpoint: str, model: pipeline.Model, mapping: DataFrame,
                      classes: DataFrame, bands: list[str], flags: dict | None = None, smoothing: str = "none", files: int | None = None) -> None:
    """Classify pixel files landing in ``folder`` with an existing model, then stop.

    Neighbourhood features need whole rasters: pixels are held until height * width of a raster are
    there, over as many batches as it takes, and the raster is classified in the batch that
    completes it. A batch's output folder is named after its id and overwritten, so a repeated
    batch leaves no copies. ``files`` bounds the files of a batch.
    """

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        whole = whole_rasters(batch, batch_id, f"{checkpoint}/rasters")
        done, _, _ = pipeline.classify(whole, classes, bands, flags=flags, smoothing=smoothing, model=model, mapping=mapping)
        done.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    reader = spark.readStream.schema(schema).option("recursiveFileLookup", True)
    stream = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(folder)
    stream.writeStream.foreachBatch(one_batch).option("checkpointLocation", f"{checkpoint}/stream").trigger(availableNow=True).start().awaitTermination()


def progress_stream(spark: SparkSession, folder: str, schema, out: str, checkpoint: str, late: str = "30 days", pipeline_name: str = "step1", files: int | None = None):
    """Percent per task, updated with every batch and merged into a keyed table; returns the ended query.

    A task's state is the furthest point of each of its phases. It goes when the watermark
    (``late`` behind the newest event) has passed the task's last event; its last percent
    stays in the table. Events older than the watermark are dropped, repeated ones change nothing. The
    table is written whole to out/batch=N, so readers never see a half-written one; see ``latest``.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    reader = spark.readStream.schema(schema)
    stream = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(folder)
    events = stream.withWatermark("ts", late).selectExpr(
        "task_id", "phase", "ts", "CASE WHEN total > 0 THEN done / cast(total AS double) ELSE 0D END AS share")

    def furthest(key, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        phases, shares, last = state.get if state.exists else ([], [], 0)
        held = dict(zip(phases, shares))
        for pdf in batches:
            for phase, share in pdf.groupby("phase")["share"].max().items():
                held[phase] = max(held.get(phase, 0.0), float(share))
            last = max(last, int(pdf["ts"].max().timestamp() * 1000))
        state.update((list(held), list(held.values()), last))
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"task_id": key[0], "phase": list(held), "share": list(held.values())})

    kind = events.schema["task_id"].dataType.simpleString()
    phases = events.groupBy("task_id").applyInPandasWithState(
        furthest, f"task_id {kind}, phase string, share double", "phases array<string>, shares array<double>, last long", "update", GroupStateTimeout.EventTimeTimeout)

    def merge(batch: DataFrame, batch_id: int) -> None:
        new = cut(pipeline.progress_from_phases(batch, pipeline_name), "progress")
        before = latest(spark, out, f"task_id {kind}, percent DOUBLE", batch_id - 1)
        new.unionByName(before.join(new, "task_id", "left_anti")).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    query = phases.writeStream.outputMode("update").foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def latest(spark: SparkSession, out: str, schema: str = "task_id BIGINT, percent DOUBLE", upto: int | None = None) -> DataFrame:
    """The newest version of a table that a stream writes whole with every batch."""
    found = _versions(spark, out, schema, upto)
    newest = found.agg(F.max("batch")).first()[0]
    return found.where(F.col("batch") == (-1 if newest is None else newest)).drop("batch")
