"""Vector layers: GeoJSON lines in, geometry tables out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

POINTS = "ARRAY<ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>>"
GEOM_SCHEMA = f"layer_idx INT, feature_id BIGINT, kind STRING, parts {POINTS}, epsg INT"
_GEOMETRY = "STRUCT<type: STRING, coordinates: STRING>"
_GEOJSON = f"type STRING, id STRING, properties STRING, geometry {_GEOMETRY}, features ARRAY<STRUCT<id: STRING, properties: STRING, geometry: {_GEOMETRY}>>"


def scan_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Geometry rows written as JSON lines; empty geometries are dropped."""
    return drop_empty(spark.read.schema(GEOM_SCHEMA).json(path))


def drop_empty(geoms: DataFrame) -> DataFrame:
    return geoms.where("parts IS NOT NULL AND size(flatten(parts)) > 0")


def scan_geojson(spark: SparkSession, path: str, layer_idx: int = 0, epsg: int = 4326, lines: bool = True) -> DataFrame:
    """GeoJSON features and feature collections; multi-part kinds give one row per part set.

    ``lines``: every line is a feature or a collection, so that a file is read by many tasks;
    without it every file is one of either, over as many lines as it likes, and its features
    are spread over tasks once read. The id is that of the properties, else the feature's own.
    """
    read = spark.read.schema(_GEOJSON).option("multiLine", not lines).json(path)
    every = read.selectExpr("explode(CASE WHEN type = 'FeatureCollection' THEN features ELSE array(named_struct('id', id, 'properties', properties, 'geometry', geometry)) END) AS f").select("f.*")
    raw = (every if lines else every.repartition(spark.sparkContext.defaultParallelism)).where("geometry IS NOT NULL").select(
        F.coalesce(F.get_json_object("properties", "$.id"), "id").try_cast("bigint").alias("feature_id"),
        "geometry.type", "geometry.coordinates",
    )
    depth = {"Point": 0, "MultiPoint": 1, "LineString": 1, "MultiLineString": 2, "Polygon": 2, "MultiPolygon": 3}
    kinds = {"Point": "point", "MultiPoint": "point", "LineString": "line", "MultiLineString": "line",
             "Polygon": "polygon", "MultiPolygon": "polygon"}
    vertex = "named_struct('x', {0}[0], 'y', {0}[1])"
    out = None
    for kind, d in depth.items():
        parsed = f"from_json(coordinates, '{'ARRAY<' * (d + 1)}DOUBLE{'>' * (d + 1)}')"
        line = "transform({0}, v -> " + vertex.format("v") + ")"
        if d == 0:
            parts = [f"array(array({vertex.format(parsed)}))"]
        elif kind == "MultiPoint":  # a part for each point, or edges would join them
            parts = [f"transform({parsed}, v -> array({vertex.format('v')}))"]
        elif d == 1:
            parts = [f"array({line.format(parsed)})"]
        elif d == 2:
            parts = [f"transform({parsed}, p -> {line.format('p')})"]
        else:
            parts = [f"explode(transform({parsed}, g -> transform(g, p -> {line.format('p')})))"]
        rows = raw.where(F.col("type") == kind).selectExpr(
            f"{layer_idx} AS layer_idx", "feature_id", f"'{kinds[kind]}' AS kind", f"{parts[0]} AS parts", f"{epsg} AS epsg"
        )
        out = rows if out is None else out.unionByName(rows)
    return drop_empty(out)
