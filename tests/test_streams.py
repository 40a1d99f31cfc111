"""Streams against the same work as one batch."""

import datetime

import pytest
from pyspark.sql import functions as F

from groundweave.plans import fixtures as fx, pipeline as pl
from groundweave.streaming import arrivals

SCHEMA = "task_id BIGINT, phase STRING, done INT, total INT, ts TIMESTAMP"


def at(minutes):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minutes)


def test_a_raster_split_over_three_batches_equals_the_batch(spark, raster, tmp_path):
    import numpy as np

    rng = np.random.default_rng(1)
    px = raster(b1=rng.integers(0, 255, (12, 9)), b2=rng.integers(0, 255, (12, 9)), b3=rng.integers(0, 255, (12, 9)), b4=rng.integers(0, 255, (12, 9)))
    other = px.withColumn("raster_id", F.lit(5))
    bands, flags = ["b1", "b2", "b3", "b4"], {"spectral": True}
    want, model, mapping = pl.classify(px.unionByName(other), fx.classes(spark), bands, k=3, flags=flags, iterations=2)
    files = [px.where("row < 4"), px.where("row BETWEEN 3 AND 8").unionByName(other), px.where("row >= 8"), other.where("row = 0")]  # rows twice; one after the end
    for n, part in enumerate(files):
        part.coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
        arrivals.classify_arrivals(spark, f"{tmp_path}/in", px.schema, f"{tmp_path}/out", f"{tmp_path}/state", model, mapping, fx.classes(spark), bands, flags=flags)
        got = spark.read.parquet(f"{tmp_path}/out")
        assert {r["raster_id"] for r in got.select("raster_id").distinct().collect()} == [set(), {5}, {0, 5}, {0, 5}][n]
    rows = lambda df: sorted(tuple(r) for r in df.select("raster_id", "row", "col", "label", "material", "r", "g", "b").collect())
    assert rows(got) == rows(want)


def test_repeating_a_batch_changes_nothing(spark, raster, tmp_path):
    px = raster(b1=[[1, 2], [3, 4]])
    one, two = px.where("row = 0"), px.where("row = 1")
    assert arrivals.whole_rasters(one, 0, str(tmp_path)).count() == 0
    assert arrivals.whole_rasters(two, 1, str(tmp_path)).count() == 4
    assert arrivals.whole_rasters(two, 1, str(tmp_path)).count() == 4
    assert arrivals.whole_rasters(px, 2, str(tmp_path)).count() == 0  # done already


@pytest.fixture
def stream(spark, tmp_path):
    def send(n, events, late="1 hour"):
        spark.createDataFrame(events, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
        schema = spark.createDataFrame([], SCHEMA).schema
        query = arrivals.progress_stream(spark, f"{tmp_path}/in/*", schema, f"{tmp_path}/out", f"{tmp_path}/state", late)
        percent = {r["task_id"]: round(r["percent"], 6) for r in arrivals.latest(spark, f"{tmp_path}/out").collect()}
        return percent, [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress][-1]

    return send


def test_progress_is_merged_late_events_dropped_and_state_shrinks(stream):
    first = [(1, "Loading raster", 5, 10, at(0)), (1, "Feature extraction", 1, 2, at(1)), (2, "Loading raster", 10, 10, at(2))]
    percent, held = stream(0, first)
    assert percent == {1: 2.5 + 17.5, 2: 5.0} and held == 2
    percent, held = stream(1, [*first, (1, "Loading raster", 2, 10, at(3)), (3, "Saving output", 1, 1, at(4))])  # repeated and falling behind
    assert percent == {1: 20.0, 2: 5.0, 3: 15.0}
    percent, _ = stream(2, [(3, "Loading raster", 10, 10, at(500))])
    assert percent == {1: 20.0, 2: 5.0, 3: 20.0}
    percent, held = stream(3, [(1, "Saving output", 1, 1, at(5)), (3, "Loading raster", 10, 10, at(501))])  # the first is late by hours
    assert percent == {1: 20.0, 2: 5.0, 3: 20.0}
    assert held == 1  # tasks 1 and 2 are gone


def test_held_files_dont_grow_with_the_rasters(spark, tmp_path):
    px = spark.range(600).selectExpr("cast(id % 300 AS int) AS raster_id", "0 AS row", "cast(id div 300 AS int) AS col", "1 AS height", "2 AS width").repartition(4)
    assert arrivals.whole_rasters(px.where("col = 0"), 0, str(tmp_path)).count() == 0
    assert len(list(tmp_path.glob("held/batch=0/**/*.parquet"))) <= 64
    assert arrivals.whole_rasters(px.where("col = 1"), 1, str(tmp_path)).distinct().count() == 600
