"""Histogram sort into shards of equal bytes.

The key of a row is a 62-bit hash of its text, then its doc_id, so equal texts are
neighbours. Exact bytes below candidate boundaries are counted over all partitions; the
brackets around the wanted splitters are refined until every splitter is within the
tolerance or cannot move, and then the rows are exchanged once.

A splitter stays between two groups of equal texts where the tolerance allows it; a group
that is too large for that is cut at a doc_id. Rows that agree in text and doc_id are
never parted. Null text has no bytes and is a group of its own; a null doc_id sorts first.
An empty table gives an empty result. Input columns are kept; those named like an added
column are replaced.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from groundweave.llm.registry import query, table
from groundweave.session import cut

KEY_BITS = 62
FIRST_BITS = 12  # probes of the first round: 4,096 over the whole key space
NEXT_BITS = 8  # probes of a later round: 256 inside each open bracket
LOWEST = -(2**63)


def _key() -> Column:
    return F.shiftrightunsigned(F.xxhash64("text"), 64 - KEY_BITS)


def _number(value: int) -> Column:
    return F.lit(Decimal(value)).cast(T.DecimalType(20, 0))


def _size() -> Column:
    return F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1


def _histogram(rows: DataFrame, at: Column, brackets: list[tuple[int, int, Column]], width: int) -> list[list[tuple[int, int]]]:
    """For each of the disjoint brackets (lo, hi, condition): [(probe interval, its bytes)]."""
    inside, interval = F.lit(None).cast("int"), F.lit(None).cast("long")
    for i, (lo, hi, where) in enumerate(brackets):
        hit = where & (at >= _number(lo)) & (at < _number(hi))
        inside = F.when(hit, F.lit(i)).otherwise(inside)
        interval = F.when(hit, F.call_function("div", at - _number(lo), _number(width))).otherwise(interval)
    found = rows.select(inside.alias("b"), interval.alias("i"), "size").where("b IS NOT NULL").groupBy("b", "i").agg(F.sum("size").alias("bytes"))
    out: list[list[tuple[int, int]]] = [[] for _ in brackets]
    for r in found.collect():  # at most brackets * probes rows
        out[r["b"]].append((r["i"], r["bytes"]))
    return [sorted(v) for v in out]


def _search(rows: DataFrame, at: Column, opened: dict[int, tuple[int, int, int, Column]], targets: list[int], tolerance: float, bits: int) -> dict[int, tuple[int, int, int]]:
    """Refine brackets {splitter: (lo, hi, bytes below lo, condition of their rows)}.

    Splitters of one bracket share its condition object, and brackets don't overlap.

    Returns {splitter: (boundary, bytes below it, bytes of the unit that starts there)}; the
    last is over 0 where the wanted place lies inside a unit that a boundary cannot enter.
    """
    done: dict[int, tuple[int, int, int]] = {}
    while opened:
        span = max(hi - lo for lo, hi, _, _ in opened.values())
        width = max(1, -(-span // (1 << bits)))
        distinct = {(lo, hi, id(where)): (lo, hi, where) for lo, hi, _, where in opened.values()}
        counts = dict(zip(distinct, _histogram(rows, at, list(distinct.values()), width)))
        following = {}
        for s, (lo, hi, below, where) in opened.items():
            start, size = lo, 0
            for interval, size in counts[lo, hi, id(where)]:
                start = lo + interval * width
                if below + size > targets[s]:
                    break
                below, start, size = below + size, start + width, 0
            end = min(hi, start + width)
            if abs(targets[s] - below) <= tolerance:
                done[s] = (start, below, 0)
            elif abs(below + size - targets[s]) <= tolerance:
                done[s] = (end, below + size, 0)
            elif width == 1 or size == 0:
                done[s] = (start, below, size)
            else:
                following[s] = (start, end, below, where)
        opened, bits = following, NEXT_BITS
    return done


def splitters(rows: DataFrame, shards: int, tolerance: float = 0.001) -> list[tuple[int, int]]:
    """The shards - 1 boundaries (key, doc_id): a shard takes rows at or above its lower one.

    rows: key, id, size. tolerance: share of a shard's bytes that a boundary may be off.
    """
    total = rows.agg(F.sum("size")).first()[0] or 0
    targets = [total * (i + 1) // shards for i in range(shards - 1)]
    slack = total / shards * tolerance
    number = T.DecimalType(20, 0)
    everywhere = F.lit(True)
    by_key = _search(rows, F.col("key").cast(number), {i: (0, 1 << KEY_BITS, 0, everywhere) for i in range(shards - 1)}, targets, slack, FIRST_BITS)
    out, inner, same = {}, {}, {}
    for s, (key, below, size) in by_key.items():
        out[s] = (key, LOWEST)
        if size:  # one group of equal texts around the wanted place
            inner[s] = (LOWEST, 2**63, below, same.setdefault(key, F.col("key") == key))
    for s, (doc, below, size) in _search(rows, F.col("id").cast(number), inner, targets, slack, FIRST_BITS).items():
        nearer = doc if targets[s] - below <= below + size - targets[s] else doc + 1
        key = by_key[s][0]
        out[s] = (key, nearer) if nearer < 2**63 else (key + 1, LOWEST)
    return [out[s] for s in range(shards - 1)]


def shard_documents(docs: DataFrame, shards: int = 8, tolerance: float = 0.001) -> DataFrame:
    """docs with size, law, shard, slot and grown_shard; shards hold nearly equal bytes.

    Inside a shard rows are ordered by range of keys, then key and doc_id; slot counts
    them from 0. A range with over twice its share of rows is dealt over several tasks by
    a hash of the doc_id, so that a large group of equal texts is not ordered in one task.
    """
    docs = docs.drop("size", "law", "shard", "slot", "grown_shard")
    identity = F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST).cast("long"))
    slim = cut(docs.select(_key().alias("key"), identity.alias("id"), _size().alias("size")), "shard-keys")
    shard = F.lit(0)
    for key, doc in splitters(slim, shards, tolerance):
        above = (F.col("key") > key) | ((F.col("key") == key) & (F.col("id") >= doc))
        shard = shard + above.cast("int")
    ranged = F.shiftright("key", KEY_BITS - FIRST_BITS).cast("int")
    counts = slim.groupBy(shard.alias("shard"), ranged.alias("range")).agg(F.count("*").alias("n")).collect()  # at most 4,096 + shards rows
    share = max(1, sum(r["n"] for r in counts) // (1 << FIRST_BITS))
    # a range that is too full: (shard, range) -> parts
    parts = {(r["shard"], r["range"]): -(-r["n"] // (2 * share)) for r in counts if r["n"] > max(2 * share, 64)}
    spark = docs.sparkSession
    full = spark.createDataFrame([(s, r, p) for (s, r), p in parts.items()], "shard INT, range INT, parts INT")

    def dealt(df: DataFrame) -> DataFrame:
        df = df.withColumns({"shard": shard, "range": ranged}).join(F.broadcast(full), ["shard", "range"], "left")
        return df.withColumn("part", F.coalesce(F.pmod(F.xxhash64("id"), F.col("parts")), F.lit(0)).cast("int")).drop("parts")

    base, offsets, last = 0, [], None
    for r in sorted(dealt(slim).groupBy("shard", "range", "part").count().collect(), key=lambda r: (r["shard"], r["range"], r["part"])):
        base = base if r["shard"] == last else 0
        offsets.append((r["shard"], r["range"], r["part"], base))
        base, last = base + r["count"], r["shard"]
    starts = spark.createDataFrame(offsets, "shard INT, range INT, part INT, base LONG")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), _key().alias("key"), identity.alias("id"), _size().alias("size"))
    place = F.row_number().over(Window.partitionBy("shard", "range", "part").orderBy("key", "id", "size")) - 1
    return (
        dealt(packed).withColumn("place", place).join(F.broadcast(starts), ["shard", "range", "part"])
        .select("doc.*", "size", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("place")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )


@query("op7_shards")
def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32")
    return shard_documents(docs.select("doc_id", "text", crc)).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
