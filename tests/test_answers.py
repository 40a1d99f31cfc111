"""Answers that were wrong once."""

from pyspark.sql import functions as F

from groundweave import session
from groundweave.functions.palette import preset_classes
from groundweave.operators import clustering as cl, masks as mk, semantics as sem, vector as vc
from groundweave.plans import pipeline as pl
from groundweave.sources.vectors import scan_geojson


def test_points_of_a_multipoint_are_not_joined(spark, tmp_path):
    path = tmp_path / "points.json"
    path.write_text('{"type": "Feature", "properties": {"id": 3}, "geometry": {"type": "MultiPoint", "coordinates": [[1.5, 1.5], [6.5, 1.5]]}}\n')
    geoms = scan_geojson(spark, str(path), epsg=3857)
    meta = spark.createDataFrame([(0, 10, 5, 1.0, 0.0, 0.0, 1.0)], "raster_id INT, width INT, height INT, a DOUBLE, c DOUBLE, f DOUBLE, e DOUBLE")
    placed = vc.place(geoms, meta)
    runs = vc.rasterize(placed)
    assert sorted((r["row"], r["c0"], r["c1"]) for r in runs.collect()) == [(1, 1, 1), (1, 6, 6)]


def test_the_last_of_equal_class_names_counts(spark):
    layers = spark.createDataFrame([(0, "a", "roof", None, None, None, None), (1, "b", "", "", None, None, None)], "layer_idx INT, id STRING, name STRING, class_id STRING, override_r INT, override_g INT, override_b INT")
    given = spark.createDataFrame([(1, "c1", "roof", "#010203"), (2, "c2", "roof", "#040506"), (3, "", "", "#070809")], "class_idx INT, id STRING, name STRING, color STRING")
    got = {r["layer_idx"]: (r["r"], r["g"], r["b"]) for r in vc.resolve_layer_colours(layers, given, preset_classes(spark)).collect()}
    assert got[0] == (4, 5, 6) and len(got) == 2 and got[1] != (7, 8, 9)


def test_dark_rasters_keep_their_row(spark, raster):
    dark = [[0] * 20 for _ in range(20)]
    got = mk.should_extract(raster(b1=dark, b2=dark, b3=dark)).collect()
    assert got and all(r["run"] and r["valid"] == 0 for r in got)


def test_total_of_nothing_is_whole(spark):
    rows = spark.createDataFrame([(1, "load", 0.0)], "job INT, stage STRING, seconds DOUBLE")
    got = {r["stage"]: r["share_text"] for r in pl.stage_table(rows, ["job"]).collect()}
    assert got == {"load": "0.0%", "TOTAL": "100.0%"}


def test_silhouette_in_blocks(spark):
    rows = spark.createDataFrame([(float(i % 7), float(i // 7), i % 3) for i in range(60)], "x DOUBLE, y DOUBLE, label INT")
    whole, parts = (cl.silhouette(rows, ["x", "y"], block=b).first()[0] for b in (4096, 9))
    assert abs(whole - parts) < 1e-12


def test_scores_use_all_pixels_unless_asked(spark, raster):
    n = 40
    bands = {f"b{k}": [[(r * 7 + c * k * 13) % 256 for c in range(n)] for r in range(n)] for k in (1, 2, 3, 4)}
    px = raster(**bands).withColumn("label", (F.col("col") % 2 + 1).cast("int"))
    counted = lambda **kw: sum(r["px"] for r in sem.semantic_scores(px, 2, **kw).collect())
    assert counted() == n * n and counted(budget=400) == 400


def test_no_shared_folder_off_one_machine(spark, monkeypatch):
    class Context:
        master = "spark://far:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("C", (), {"get": staticmethod(lambda key, default=None: default)})

    try:
        session.scratch_dir(Session())
    except ValueError as error:
        assert "spark.checkpoint.dir" in str(error)
    else:
        raise AssertionError


def test_silhouette_sends_a_row_to_as_many_tasks_at_any_size(spark, monkeypatch):
    import re

    import numpy as np

    monkeypatch.setattr(cl, "STRIPS", 3, raising=False)
    data = [(float(i * 7 % 23), float(i * 5 % 11), (1, 4, 9, None)[i % 4]) for i in range(90)]
    found = cl.silhouette(spark.createDataFrame(data, "x DOUBLE, y DOUBLE, label INT"), ["x", "y"], block=9)
    points, labels, widths = np.array([d[:2] for d in data]), [d[2] for d in data], []
    far = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1))
    for i, own in enumerate(labels):
        members = {k: [j for j, l in enumerate(labels) if l == k] for k in (1, 4, 9)}
        a = far[i, members[own]].sum() / (len(members[own]) - 1) if own else 0
        b = min(far[i, m].mean() for k, m in members.items() if k != own)
        widths.append((b - a) / max(a, b) if own else 0.0)  # rows without a cluster count as 0
    assert abs(found.first()[0] - np.mean(widths)) < 1e-12
    dealt = re.findall(r"explode\(sequence\(0, (\d+)", found._jdf.queryExecution().analyzed().toString())
    assert dealt and set(dealt) == {"2"}


def test_silhouette_measures_a_pair_once(spark, monkeypatch):
    """Pairs of strips are tasks, not both orders of them; close points far from the others keep their digits."""
    import re

    import numpy as np

    monkeypatch.setattr(cl, "STRIPS", 4)
    rng = np.random.default_rng(1)
    at = np.array([[0, 0, 0], [1e6, 0, 0], [1e6, 1e-3, 0]])
    labels = [i % 3 for i in range(60)] + [5, None]
    data = np.vstack([at[np.arange(60) % 3] + rng.normal(size=(60, 3)) * 1e-3, [[1e6, 0, 7]], [[3, 4, 5]]])
    data[3], data[6] = data[0], data[0]
    rows = spark.createDataFrame([(*map(float, x), k) for x, k in zip(data, labels)], "x DOUBLE, y DOUBLE, z DOUBLE, label INT")
    found = cl.silhouette(rows, ["x", "y", "z"], block=7)
    far, widths = np.sqrt(((data[:, None] - data[None]) ** 2).sum(-1)), []
    for i, own in enumerate(labels):
        members = {k: [j for j, l in enumerate(labels) if l == k] for k in (0, 1, 2, 5)}
        if own is None or len(members[own]) == 1:
            widths.append(0.0)
            continue
        a, b = far[i, members[own]].sum() / (len(members[own]) - 1), min(far[i, m].mean() for k, m in members.items() if k != own)
        widths.append((b - a) / max(a, b))
    assert abs(found.first()[0] - np.mean(widths)) < 1e-9
    dealt = re.findall(r"RepartitionByExpression \[\w+\(_cell#\d+\)\], (\d+)", found._jdf.queryExecution().analyzed().toString())
    assert dealt == ["10"]
    with_x = lambda x: rows.where("label < 2").unionByName(rows.limit(1).withColumn("x", F.lit(x).cast("double")))
    odd = [cl.silhouette(with_x(x), ["x", "y", "z"], block=7).first()[0] for x in (None, "NaN", "Infinity")]
    assert odd[:2] == [0.0, 0.0] and np.isnan(odd[2])
