import pytest
import json
import os

from pyspark.sql import functions as F

from groundweave.functions import geo
from groundweave.functions.palette import preset_classes
from groundweave.operators import vector as vc
from groundweave.plans import fixtures as fx
from groundweave.sources import rasters as rs, sidecars, vectors as vs


def test_image_round_trip(spark, sf, tmp_path):
    px = fx.scene(spark, sf)
    rs.write_files(rs.bmp_tiles(px, 64), str(tmp_path / "img"))
    got = rs.scan_images(spark, str(tmp_path / "img"))
    assert got.count() == px.count()
    assert got.agg(F.sum("b1"), F.sum("b2"), F.sum("b3")).first() == px.agg(F.sum("b1"), F.sum("b2"), F.sum("b3")).first()


def test_window_read_pushes_filters_and_prunes_columns(spark, sf, tmp_path):
    path = str(tmp_path / "px")
    fx.scene(spark, sf).write.partitionBy("raster_id").parquet(path)
    df = rs.scan_pixels(spark, path, raster_ids=[0], window=(2, 3, 4, 5)).select("row", "col", "b1")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(row,2)" in plan and "PartitionFilters: [isnotnull(raster_id" in plan and "b2" not in plan
    assert df.count() == 20


def test_label_sink_keeps_every_pixel(spark, sf, tmp_path):
    labels = fx.labels13(spark, sf)
    rs.write_labels(labels, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.exceptAll(labels.select(back.columns)).count() == 0 and back.count() == labels.count()


def test_folder_listing(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("a.TIF", "sub/b.jpg", "c.txt"):
        (tmp_path / name).write_bytes(b"x")
    files = rs.list_files(spark, str(tmp_path))
    got = rs.scan_folder(files, f"file:{tmp_path}/")
    assert sorted(r["relative_path"] for r in got.collect()) == ["a.TIF", "sub/b.jpg"]


def test_sidecar_files(spark, tmp_path):
    classes = preset_classes(spark)
    sidecars.write_material_xml(classes, str(tmp_path / "xml"))
    text = "".join(open(tmp_path / "xml" / f).read() for f in os.listdir(tmp_path / "xml") if f.startswith("part"))
    assert '<Composite_Material index="1">' in text and "<Color>#ff2d2d30</Color>" in text and "<Weight>100</Weight>" in text
    sidecars.write_palette_reference(classes, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).where("material = 'BM_SAND'").first()["final_rgb"] == "237,201,175"
    meta = spark.createDataFrame([(7, "/o/a.tif", 300, 200, 4326, 0.5, 10.0, -0.5, 50.0)], "raster_id INT, path STRING, width INT, height INT, epsg INT, a DOUBLE, c DOUBLE, e DOUBLE, f DOUBLE")
    sidecars.write_lines(sidecars.txr_lines(meta), str(tmp_path / "txr"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "txr")).collect()]
    assert lines[0] == "csm=Geographic" and lines[5] == "Top: 50.000000000000" and len(lines) == 9
    txs = [r.text for r in sidecars.txs_lines(meta).orderBy("line_no").collect()]
    assert len(txs) == 38 and 'Set $thisRecord "Number of Texels X" 512' in txs


def test_geojson_kinds(spark, tmp_path):
    shapes = [
        {"type": "Point", "coordinates": [1.0, 2.0]},
        {"type": "LineString", "coordinates": [[0, 0], [1, 1]]},
        {"type": "Polygon", "coordinates": [[[0, 0], [4, 0], [4, 4], [0, 0]], [[1, 1], [2, 1], [2, 2], [1, 1]]]},
        {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [1, 1], [0, 0]]], [[[5, 5], [6, 5], [6, 6], [5, 5]]]]},
        {"type": "MultiPoint", "coordinates": []},
    ]
    path = tmp_path / "v.json"
    path.write_text("\n".join(json.dumps({"type": "Feature", "properties": {"id": i}, "geometry": s}) for i, s in enumerate(shapes)))
    rows = vs.scan_geojson(spark, str(path)).collect()
    assert sorted((r.feature_id, r.kind, len(r.parts)) for r in rows) == [(0, "point", 1), (1, "line", 1), (2, "polygon", 2), (3, "polygon", 1), (3, "polygon", 1)]


@pytest.mark.parametrize("lines, indent", [(True, None), (False, None), (False, 2)])
def test_feature_collections(spark, tmp_path, lines, indent):
    point = lambda x: {"type": "Point", "coordinates": [x, 1.5]}
    whole = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "id": 7, "properties": {"name": "a"}, "geometry": point(1)}, {"type": "Feature", "id": "x", "properties": {"id": 8}, "geometry": point(2)},
        {"type": "Feature", "properties": None, "geometry": point(3)}, {"type": "Feature", "id": 9, "properties": {}, "geometry": None}]}
    (tmp_path / "a.json").write_text(json.dumps(whole, indent=indent) + "\n")
    (tmp_path / "b.json").write_text(json.dumps({"type": "Feature", "properties": {"id": 4}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}}, indent=indent))
    (tmp_path / "c.json").write_text(json.dumps({"type": "FeatureCollection", "features": []}, indent=indent))
    got = {(r.feature_id, r.kind, r.parts[0][0].x) for r in vs.scan_geojson(spark, str(tmp_path), lines=lines).collect()}
    assert got == {(7, "point", 1.0), (8, "point", 2.0), (None, "point", 3.0), (4, "polygon", 0.0)}


def test_next_pow2(spark):
    df = spark.range(1, 70).selectExpr("id AS n", f"{geo.next_pow2('cast(id AS int)')} AS p")
    assert all(r.p == 1 << (r.n - 1).bit_length() for r in df.collect())


def test_mercator_round_trip(spark):
    df = spark.range(-80, 81, 7).selectExpr("id AS lat", f"{geo.latitude(geo.mercator_y('id'))} AS back")
    assert all(abs(r.lat - r.back) < 1e-9 for r in df.collect())


def test_polygon_with_hole_and_line(spark):
    meta = spark.createDataFrame([(0, 10, 8, 1.0, 0.0, -1.0, 8.0)], "raster_id INT, width INT, height INT, a DOUBLE, c DOUBLE, e DOUBLE, f DOUBLE")
    ring = lambda lo, hi: [(lo, 8 - lo), (hi, 8 - lo), (hi, 8 - hi), (lo, 8 - hi), (lo, 8 - lo)]
    rows = [(0, 1, "polygon", [ring(1.25, 6.75), ring(2.6, 5.4)], 3857), (1, 2, "line", [[(0.5, 7.5), (9.5, 7.5)]], 3857), (1, 3, "point", [[(99.0, 99.0)]], 3857)]
    runs = vc.rasterize(vc.place(spark.createDataFrame(rows, vs.GEOM_SCHEMA), meta))
    got = {(r.layer_idx, r.row, r.col) for r in vc.rn.pixels_of(runs).collect()}
    box = {(0, y, x) for y in range(1, 7) for x in range(1, 7)} - {(0, y, x) for y in (3, 4) for x in (3, 4)}
    assert got == box | {(1, 0, x) for x in range(10)}
