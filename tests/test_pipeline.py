import pytest
from pyspark.sql import functions as F

from groundweave.functions.palette import preset_classes
from groundweave import session
from groundweave.operators import postproc as pp, runs as rn
from groundweave.plans import fixtures as fx, pipeline as pl

BANDS = ["b1", "b2", "b3", "b4"]


@pytest.fixture(scope="module")
def classified(spark, sf):
    return pl.classify(fx.scene(spark, sf), preset_classes(spark), BANDS, k=4, n_total=1000, iterations=3)


def test_every_pixel_gets_a_material(spark, sf, classified):
    done, model, mapping = classified
    assert done.count() == fx.scene(spark, sf).count() and done.where("material IS NULL").count() == 0
    assert len(model.centers) == mapping.count() == 4


def test_saved_model_gives_the_same_labels(spark, sf, classified, tmp_path):
    done, model, mapping = classified
    model.save(spark, str(tmp_path / "m"))
    again, _, _ = pl.classify(fx.scene(spark, sf), preset_classes(spark), BANDS, model=pl.Model.load(spark, str(tmp_path / "m")), mapping=mapping)
    assert again.select("raster_id", "row", "col", "label").exceptAll(done.select("raster_id", "row", "col", "label")).count() == 0


def test_unknown_smoothing_leaves_labels(spark, sf):
    px = fx.labelled(spark, sf)
    for option in ("none", "median_x", "median_0", ""):
        assert pp.smooth(px, option).exceptAll(px.select("raster_id", "row", "col", "label")).count() == 0


def test_failed_rasters_do_not_stop_the_batch(spark):
    req = spark.createDataFrame([(1, "a"), (2, "b")], "raster_id INT, output STRING")
    out = spark.createDataFrame([(1, 0, 0)], "raster_id INT, row INT, col INT")
    res = pl.batch_results(req, out)
    assert {(r.raster_id, r.status) for r in res.collect()} == {(1, "ok"), (2, "error")}
    s = pl.batch_summary(res.withColumn("g", F.lit(0)), ["g"]).first()
    assert (s.status, s.message, s.first_output) == ("ok", "Batch complete: 1/2 succeeded", "a")


def test_area_is_invariant_under_label_order(spark, sf):
    labels, meta = fx.labels13(spark, sf), fx.raster_meta(spark, sf)
    a = pp.material_area(labels, preset_classes(spark), meta)
    assert a.agg(F.sum("pixels")).first()[0] == labels.count()
    assert pp.area_rollup(a).where("raster_id IS NULL").first()["pixels"] == labels.count()


def test_contextual_caps_run_in_order(spark, sf):
    px = fx.labelled(spark, sf)
    out = pp.cap_contextual_features(px, preset_classes(spark))
    assert out.count() == px.count()


def test_same_label_patches(spark, raster):
    grid = [[10] * 9 for _ in range(9)]
    grid[4][4] = 1
    out = pp.absorb_small_patches(raster(label=grid), preset_classes(spark), max_px=5, connectivity_on="same_label")
    assert out.where("label <> 10").count() == 0


def test_car_inside_asphalt_becomes_asphalt(spark, raster):
    grid = [[1] * 16 for _ in range(12)]
    for y in (5, 6):
        for x in range(6, 10):
            grid[y][x] = 11
    px = raster(label=grid)
    out = pp.remove_road_objects(px, preset_classes(spark), 0.5)
    assert out.where("changed").count() == 8 and out.where("label <> 1").count() == 0


def test_progress_across_slots_equals_one_slot(spark, sf):
    events = fx.progress(spark, sf)
    many = pl.progress_rollup(events)
    one = pl.progress_rollup(events, slot="timestamp '2000-01-01'")
    diff = many.join(one.withColumnRenamed("percent", "p2"), ["task_id", "seq", "phase"]).where("abs(percent - p2) > 1e-9")
    assert many.count() == events.count() and diff.count() == 0


def test_core_plans_have_no_python_and_no_cross_join(spark, sf):
    px = fx.scene(spark, sf)
    from groundweave.operators import features as ft, semantics as sem
    for df in (ft.spectral_mean(px, BANDS), ft.feature_table(px, pl.DEFAULT_FLAGS, BANDS), sem.semantic_masks(px), pp.smooth(fx.labelled(spark, sf), "median_1")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


def test_box_mean_uses_one_shuffle(spark, sf):
    from groundweave.operators import features as ft
    plan = ft.feature_table(fx.scene(spark, sf), pl.DEFAULT_FLAGS, BANDS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def _painted(spark, geoms, epsg, step, c, f):
    """Cells (row, col) that a layer paints on a raster of 8 x 8 cells."""
    px = spark.createDataFrame([(1, r, c, 0, 0, 0) for r in range(8) for c in range(8)], "raster_id INT, row INT, col INT, r INT, g INT, b INT")
    meta = spark.createDataFrame([(1, 8, 8, epsg, step, c, -step, f)], "raster_id INT, width INT, height INT, epsg INT, a DOUBLE, c DOUBLE, e DOUBLE, f DOUBLE")
    colours = spark.createDataFrame([(0, 9, 9, 9)], "layer_idx INT, r INT, g INT, b INT")
    geoms = spark.createDataFrame(geoms, "layer_idx INT, feature_id LONG, kind STRING, parts ARRAY<ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>>, epsg INT")
    return {(x["row"], x["col"]) for x in pl.overlay(px, geoms, meta, colours, 13).where("r = 9").collect()}


def test_layers_are_moved_to_the_crs_of_a_raster(spark):
    point = lambda x, y, epsg: [(0, 1, "point", [[(x, y)]], epsg)]
    # longitude 9 and latitude 45 in metres
    x, y = 1001875.417, 5621521.486193767
    assert _painted(spark, point(9.0, 45.0, 4326), 3857, 1.0, x - 2.5, y + 5.5) == {(5, 2)}
    assert _painted(spark, point(x, y, 3857), 4326, 0.01, 9.0 - 0.025, 45.0 + 0.055) == {(5, 2)}
    assert _painted(spark, point(9.0, 45.0, None), 4326, 0.01, 9.0 - 0.025, 45.0 + 0.055) == {(5, 2)}
    assert _painted(spark, point(9.0, 45.0, 4326), None, 0.01, 9.0 - 0.025, 45.0 + 0.055) == {(5, 2)}
    # labelled 4326 but drawn in the raster's metres: misses it after alignment, hits it as written
    assert _painted(spark, point(102.5, 44.5, 4326), 3857, 1.0, 100.0, 50.0) == {(5, 2)}
    # a large shape as written is cut to the raster before it is put on a grid
    square = [(0, 1, "polygon", [[(-1e6, -1e6), (1e6, -1e6), (1e6, 1e6), (-1e6, 1e6), (-1e6, -1e6)]], 3857)]
    assert len(_painted(spark, square, 4326, 0.01, 20.0, 50.0)) == 64


def test_batch_paints_every_output(spark, sf):
    from groundweave.plans import q_pipeline as qp
    results, done, mapping = qp.batch(spark, sf)
    assert done.where("burn IS NOT NULL").select("raster_id").distinct().count() > 0 and mapping.count() == qp.K
    s = pl.batch_summary(results.withColumn("g", F.lit(0)), ["g"]).first()
    n = fx.dims(fx.scene(spark, sf)).count()
    assert len(s.output_paths) == s.ok == n and all(p.startswith("/out/with_vectors/scene_") and p.endswith("_with_vectors.tif") for p in s.output_paths)
    assert [e.message for e in s.errors] == ["raster not found"] * n


def test_pixel_tables_are_not_broadcast(spark, raster, tmp_path):
    """Their files are small, their rows are not."""
    grid = [[1 + (r // 3 + c // 4) % 3 if r % 3 and c % 4 else 0 for c in range(30)] for r in range(20)]
    raster(label=grid).write.parquet(f"{tmp_path}/px")
    px = spark.read.parquet(f"{tmp_path}/px")
    out = pp.absorb_small_patches(px, preset_classes(spark), max_px=3)
    targets = px.where("label = 0")
    near = rn.nearest_source(targets, px, "label > 0")
    for found in (out, near, pp.repaint(px, px.where("label = 0").selectExpr("*", "1 AS new"))):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert out.count() == 600 and near.count() == targets.count()


def test_bound_of_small_sides(spark, monkeypatch):
    """Past the bound of rows a per-key table isn't broadcast, however small its files."""
    many = spark.range(50).selectExpr("id AS raster_id", "1 AS v")
    big = spark.range(1000).selectExpr("id AS raster_id")
    plan = lambda: session.attach(big, many.select("*"), ["raster_id"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan()
    monkeypatch.setattr(session, "MAX_BROADCAST_ROWS", 10)
    assert "BroadcastHashJoin" not in plan()
