"""Session helpers: scratch tables in the shared folder and size-checked joins."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

# A side with at most this many rows is broadcast; a larger one is shuffled and
# AQE splits its hot keys.
MAX_BROADCAST_ROWS = 200_000


def new_session(app: str = "groundweave", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators are planned for."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir.

    Only a session on one machine may go without it; then a temporary folder is made.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="groundweave-")
        context.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark).rstrip('/')}/groundweave/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str = "step", compression: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage, survives lost executors, and gives the optimizer the true
    size of an intermediate table.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def by_sort(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the pixels: joined by sorting, never broadcast.

    The files of a pixel table are far smaller than its rows in memory, and the optimizer
    sees the files: it would broadcast tables of millions of rows.
    """
    return df.hint("merge")


def bounded(small: DataFrame) -> DataFrame:
    """A materialised per-key table, hinted for broadcast only within the row bound."""
    if getattr(small, "_checked_size", False):
        return small
    small = cut(small, "keyed")
    few = small.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS
    small = F.broadcast(small) if few else by_sort(small)
    small._checked_size = True
    return small


def attach(big: DataFrame, small: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Join per-key values to a pixel-sized table.

    Within the bound the small side is broadcast, so the pixels are not shuffled; beyond
    it the join is left to AQE, which splits a hot key's partition.
    """
    return big.join(bounded(small), on, how)


def each_of(df: DataFrame, table: DataFrame, limit: int = 64) -> DataFrame:
    """Every row of ``df`` with every row of a tiny fixed table (classes, candidates).

    The table is checked to have at most ``limit`` rows and becomes a literal array, so
    no join is planned.
    """
    rows = table.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"expected at most {limit} rows")
    structs = [F.struct(*[F.lit(r[f.name]).cast(f.dataType).alias(f.name) for f in table.schema]) for r in rows]
    return df.withColumn("_each", F.explode(F.array(*structs))).select("*", "_each.*").drop("_each")


def where_once(df: DataFrame, fields: list[str], condition: str) -> DataFrame:
    """Filter on a condition that uses derived columns many times.

    A plain filter is pushed below the projection with every use replaced by the column's
    whole expression; here each field is evaluated once per row.
    """
    bound = re.sub(r"\b(" + "|".join(fields) + r")\b", r"x.\1", condition)
    packed = ", ".join(f"'{f}', {f}" for f in fields)
    return df.where(f"exists(array(named_struct({packed})), x -> {bound})")
