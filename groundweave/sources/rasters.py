"""Raster sources and sinks: images, pixel tables, listings, label tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# Raster file extensions of the folder scan and of the batch command.
RASTER_EXTENSIONS = [".tif", ".tiff", ".jpg", ".jpeg", ".png", ".img", ".bmp", ".jp2", ".ecw", ".sid"]
BATCH_EXTENSIONS = [".tif", ".tiff", ".jpg", ".jpeg"]
TILE_ROWS = 512


def scan_images(spark: SparkSession, path: str) -> DataFrame:
    """Pixels of every image below ``path``; bytes are read row by row in the JVM."""
    images = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(path)
    rows = images.selectExpr(
        "image.origin AS path", "image.width AS width", "image.height AS height", "image.nChannels AS n", "image.data AS data",
    ).selectExpr("path", "width", "height", "n", "data", "explode(sequence(0, height - 1)) AS row")
    # One short slice per image row, so that a pixel does not copy the whole image.
    rows = rows.selectExpr("path", "width", "height", "n", "row", "substring(data, row * width * n + 1, width * n) AS line")
    pixels = rows.selectExpr("*", "explode(sequence(0, width - 1)) AS col")
    byte = lambda k: f"cast(conv(hex(substring(line, col * n + {k}, 1)), 16, 10) AS int)"
    gray_or = lambda k: f"CASE WHEN n >= 3 THEN {byte(k)} ELSE {byte(1)} END"
    return pixels.selectExpr(
        "path", "row", "col", "height", "width", f"{gray_or(3)} AS b1", f"{gray_or(2)} AS b2", f"{gray_or(1)} AS b3"
    )


def scan_pixels(spark: SparkSession, path: str, raster_ids=None, window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Windowed read of a pixel table; (row, col, h, w) becomes pushed-down range filters."""
    df = spark.read.parquet(path)
    if raster_ids is not None:
        df = df.where(F.col("raster_id").isin(list(raster_ids)))
    return df if window is None else crop(df, window)


def crop(df: DataFrame, window: tuple[int, int, int, int]) -> DataFrame:
    row, col, h, w = window
    return df.where(F.col("row").between(row, row + h - 1) & F.col("col").between(col, col + w - 1))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Paths below a folder; file contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")


def scan_folder(files: DataFrame, root: str, extensions=RASTER_EXTENSIONS) -> DataFrame:
    """Name and path relative to ``root`` of the files with one of the extensions."""
    ext = F.lower(F.regexp_extract("path", r"(\.[^./?]+)$", 1))
    inside = F.col("path").startswith(root)
    return files.where(ext.isin(list(extensions)) & inside).select(
        "path",
        F.regexp_extract("path", r"([^/]+)$", 1).alias("name"),
        F.expr(f"substring(path, {len(root) + 1})").alias("relative_path"),
    )


def write_labels(labels: DataFrame, path: str, tiles: bool = True) -> None:
    """Label raster as Parquet: one folder per raster, files clustered by row block.

    The block is part of the range key, so that a large raster is written by many tasks.
    """
    labels.repartitionByRange("raster_id", F.expr(f"row div {TILE_ROWS}"), F.expr(f"col div {TILE_ROWS}")).sortWithinPartitions(
        "raster_id", "row", "col"
    ).write.mode("overwrite").partitionBy("raster_id").parquet(path)


def output_names(files: DataFrame, root: str, out_dir: str, step: str, tile=None) -> DataFrame:
    """Output path per input: mirrored sub-folder, stem, step suffix, .tif."""
    # File name suffix of each pipeline step.
    suffix = {"step1": "_classified", "step2": "_with_vectors"}.get(step, "_full")
    rel = F.regexp_replace("path", f"^{root}", "")
    folder = F.regexp_extract(rel, r"^(.*/)?[^/]*$", 1)
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"\.[^.]*$", "")
    return files.withColumns({
        "output": F.concat(F.lit(out_dir), folder, stem, F.lit(suffix + ".tif")),
        "tile_name": F.concat(stem, F.lit("_tile_r"), F.col("tile_row"), F.lit("_c"), F.col("tile_col"), F.lit(".tif"))
        if "tile_row" in files.columns else F.lit(None).cast("string"),
    })


def bmp_tiles(pixels: DataFrame, tile: int = 256) -> DataFrame:
    """Encode bounded tiles of RGB pixels as uncompressed bitmap files (bytes per tile)."""

    def encode(key, pdf):
        import struct

        import numpy as np
        import pandas as pd

        h, w = int(pdf["row"].max()) + 1, int(pdf["col"].max()) + 1
        stride = (w * 3 + 3) // 4 * 4
        image = np.zeros((h, stride), dtype=np.uint8)
        rows, cols = h - 1 - pdf["row"].to_numpy(), pdf["col"].to_numpy() * 3
        for shift, band in enumerate(("b3", "b2", "b1")):
            image[rows, cols + shift] = pdf[band].to_numpy()
        size = h * stride
        head = struct.pack("<2sIHHI", b"BM", 54 + size, 0, 0, 54)
        info = struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, size, 2835, 2835, 0, 0)
        return pd.DataFrame({"name": [f"r{key[0]}_r{key[1]}_c{key[2]}.bmp"], "content": [head + info + image.tobytes()]})

    placed = pixels.selectExpr(
        "raster_id", f"cast(row div {tile} AS int) AS trow", f"cast(col div {tile} AS int) AS tcol",
        f"cast(row % {tile} AS int) AS row", f"cast(col % {tile} AS int) AS col", "b1", "b2", "b3",
    )
    return placed.groupBy("raster_id", "trow", "tcol").applyInPandas(encode, "name STRING, content BINARY")


def write_files(contents: DataFrame, folder: str) -> None:
    """Write one file per row (name, content) into a shared folder, from the tasks."""

    def save(batches):
        import os

        for pdf in batches:
            for name, content in zip(pdf["name"], pdf["content"]):
                partial = os.path.join(folder, f".{name}.part")
                with open(partial, "wb") as out:
                    out.write(content)
                os.replace(partial, os.path.join(folder, name))
            yield pdf[["name"]]

    import os

    os.makedirs(folder, exist_ok=True)
    contents.mapInPandas(save, "name STRING").write.format("noop").mode("overwrite").save()
