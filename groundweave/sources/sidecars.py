"""Text, XML and CSV files that go with a classified raster."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.geo import next_pow2, wgs84_bounds

# Lines of the bounding-box sidecar; braces are filled per raster.
TXR_LINES = [
    "csm=Geographic", "datumId=4326", "dcType=NONE", "dcSelectorId=0", "EndMapTokens",
    "Top: {top}", "Bottom: {bottom}", "Left: {left}", "Right: {right}",
]
LIBRARY = "Source Data Library;Geospecific Imagery;Year-Round"
# Lines of the batch-load script for one image.
TXS_LINES = [
    'Delete "{lib};{path} (backup)"',
    'Rename "{lib};{path}" "{path} (backup)"',
    'Create "GeoSpecific" "{lib}" "{path}"',
    'SetEnv thisRecord "{lib};{path}"',
    'Set $thisRecord "Zero Y" ""',
    'Set $thisRecord "Zero X" ""',
    'Set $thisRecord "Use 4th Channel as Alpha" "no"',
    'Set $thisRecord "Transparency" ""',
    'Set $thisRecord "Timestamp" ""',
    'Set $thisRecord "Origin Y" ""',
    'Set $thisRecord "Origin X" ""',
    'Set $thisRecord "Number of Texels Y" {texels_y}',
    'Set $thisRecord "Number of Texels X" {texels_x}',
    'Set $thisRecord "Notes" ""',
    'Set $thisRecord "Misc3" ""',
    'Set $thisRecord "Misc2" ""',
    'Set $thisRecord "Misc1" ""',
    'Set $thisRecord "Meters per Texels Y" ""',
    'Set $thisRecord "Meters per Texels X" ""',
    'Set $thisRecord "MaterialClassification" ""',
    'Set $thisRecord "Map Selection" ""',
    'Set $thisRecord "Map Model" "Geographic"',
    'Set $thisRecord "Map Datum" "WGS84"',
    'Set $thisRecord "Local Top" {top}',
    'Set $thisRecord "Local Right" {right}',
    'Set $thisRecord "Local Left" {left}',
    'Set $thisRecord "Local Bottom" {bottom}',
    'Set $thisRecord "Gamma" 1.800000000000',
    'Set $thisRecord "File Type" ""',
    'Set $thisRecord "File Name" "{path}"',
    'Set $thisRecord "Enter Date" ""',
    'Set $thisRecord "Data Interpretation" "GeoSpecific Format"',
    'Set $thisRecord "Custom Definition 2" ""',
    'Set $thisRecord "Custom Definition" ""',
    'Set $thisRecord "Conv_ Usage" "use default"',
    'Set $thisRecord "Conv_ Selection" ""',
    'Set $thisRecord "Conv_ Family" ""',
    'Set $thisRecord "Auto Load" ""',
]


def _filled(meta: DataFrame, lines: list[str], key: str) -> DataFrame:
    """One row per raster and template line, placeholders replaced."""
    df = wgs84_bounds(meta).withColumns({
        "texels_y": F.expr(f"cast({next_pow2('height')} AS string)"),
        "texels_x": F.expr(f"cast({next_pow2('width')} AS string)"),
        **{new: F.format_string("%.12f", F.col(old)) for new, old in
           (("t_top", "north"), ("t_bottom", "south"), ("t_left", "west"), ("t_right", "east"))},
    })
    template = F.array(*[F.lit(t.replace("{lib}", LIBRARY)) for t in lines])
    df = df.select("*", F.posexplode(template).alias("line_no", "text"))
    fills = {"{top}": "t_top", "{bottom}": "t_bottom", "{left}": "t_left", "{right}": "t_right",
             "{texels_y}": "texels_y", "{texels_x}": "texels_x"}
    if "path" in meta.columns:
        fills["{path}"] = "path"
    text = F.col("text")
    for mark, col in fills.items():
        text = F.replace(text, F.lit(mark), F.col(col))
    return df.select(key, (F.col("line_no") + 1).alias("line_no"), text.alias("text"))


def txr_lines(meta: DataFrame, key: str = "raster_id") -> DataFrame:
    return _filled(meta, TXR_LINES, key)


def txs_lines(meta: DataFrame, key: str = "raster_id") -> DataFrame:
    return _filled(meta, TXS_LINES, key)


def write_lines(lines: DataFrame, path: str, key: str = "raster_id") -> None:
    """One text file per key, lines in order."""
    lines.repartition(key).sortWithinPartitions(key, "line_no").select(key, F.col("text").alias("value")).write.mode(
        "overwrite").partitionBy(key).text(path)


def material_rows(classes: DataFrame) -> DataFrame:
    """Rows of the composite-material table: display name, ARGB colour, substrate."""
    return classes.selectExpr(
        "class_idx", "coalesce(composite_name, replace(name, 'BM_', '')) AS composite",
        "CASE WHEN color LIKE '#%' AND length(color) = 7 THEN concat('#ff', lower(substring(color, 2))) ELSE '#ff000000' END AS argb",
        "name AS material", "100 AS weight", "1 AS thickness",
    )


def write_material_xml(classes: DataFrame, path: str) -> None:
    material_rows(classes).selectExpr(
        "class_idx AS _index", "composite AS Name", "argb AS Color",
        "named_struct('Thickness', thickness, 'Material', named_struct('Name', material, 'Weight', weight)) AS Primary_Substrate",
    ).coalesce(1).write.mode("overwrite").format("xml").options(
        rootTag="Composite_Material_Table", rowTag="Composite_Material").save(path)


def palette_reference(classes: DataFrame) -> DataFrame:
    return classes.selectExpr(
        "id AS class_id", "name AS material", "material_type", "color AS hex_color", "concat_ws(',', r, g, b) AS final_rgb"
    )


def write_palette_reference(classes: DataFrame, path: str) -> None:
    palette_reference(classes).coalesce(1).write.mode("overwrite").option("header", True).csv(path)
