"""Exact per-key percentiles that never gather a key's rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import attach, bounded, cut


def small_domain_percentile(df: DataFrame, keys: list[str], value: str, p: float, out: str) -> DataFrame:
    """Percentile of a value with few distinct values (8-bit bands).

    Values are counted first (map-side combined), so the percentile sees at most one
    row per distinct value.
    """
    counts = df.groupBy(*keys, value).count()
    return counts.groupBy(*keys).agg(F.percentile(value, F.lit(p), F.col("count")).alias(out))


SPLITS = 512  # quantiles that a sketch is asked for


def percentile(df: DataFrame, keys: list[str], value: str, p: float, out: str, small: int = 16_384) -> DataFrame:
    """Linear-interpolated percentile of a continuous value, exact for any key size and any spread.

    Each pass sketches the rows of a key's bracket and takes the quantiles on either side of the
    wanted rank as the next bracket, whose rows are then counted: the rank lies among the
    rows equal to one of its ends, which settles it, or strictly between them. A pass leaves a
    few of SPLITS parts of the rows, however they are spread; at most ``small`` rows are sorted in
    the end. A task sends one sketch a key, so neither a hot key nor a hot value gathers.
    Null, infinite and NaN values don't count; a key without others has no row.
    """
    if not keys:
        return percentile(df.withColumn("_all", F.lit(0)), ["_all"], value, p, out, small).drop("_all")
    rows = cut(df.where(F.abs(F.col(value)) < float("inf")).select(*keys, F.col(value).cast("double").alias("v")), "values")
    first = rows.groupBy(*keys).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"))
    brackets = bounded(first.selectExpr(*keys, "lo", "hi", "n", "0L AS below", f"(n - 1) * {p!r}D AS rank"))
    still = f"lo < hi AND n > {small}"
    while not brackets.where(still).isEmpty():
        wide = brackets.where(still)
        inside = attach(rows, wide.select(*keys, "lo", "hi"), keys, "inner").where("v BETWEEN lo AND hi")
        grid = F.array(*[F.lit(i / SPLITS) for i in range(SPLITS + 1)])
        sketch = inside.groupBy(*keys).agg(F.percentile_approx("v", grid, F.lit(40 * SPLITS)).alias("s"))
        at = f"cast(floor((floor(rank) - below) / (n - 1) * {SPLITS}) AS int)"
        ends = attach(wide, sketch, keys, "inner").selectExpr(*keys, "lo", "hi", f"s[greatest({at} - 1, 0)] AS a", f"s[least({at} + 2, {SPLITS})] AS b")
        counts = attach(rows, ends, keys, "inner").where("v BETWEEN lo AND hi").groupBy(*keys, "a", "b").agg(
            F.count_if(F.expr("v < a")).alias("n0"), F.count_if(F.expr("v = a")).alias("n1"), F.count_if(F.expr("v > a AND v < b")).alias("n2"),
            F.count_if(F.expr("v = b AND b > a")).alias("n3"), *[f(F.expr(f"CASE WHEN {w} THEN v END")).alias(c) for f, w, c in (
                (F.max, "v < a", "before"), (F.min, "v > a AND v < b", "least"), (F.max, "v > a AND v < b", "most"), (F.min, "v > b", "after"))])
        part = lambda lo, hi, n, below: f"named_struct('lo', {lo}, 'hi', {hi}, 'n', {n}, 'below', {below})"
        narrowed = attach(wide, counts, keys, "inner").withColumn("t", F.expr("cast(floor(rank) AS bigint) - below - n0")).selectExpr(*keys, "rank", f"""CASE
            WHEN t < 0 THEN {part('lo', 'before', 'n0', 'below')}
            WHEN t < n1 THEN {part('a', 'a', 'n1', 'below + n0')}
            WHEN t < n1 + n2 THEN {part('least', 'most', 'n2', 'below + n0 + n1')}
            WHEN t < n1 + n2 + n3 THEN {part('b', 'b', 'n3', 'below + n0 + n1 + n2')}
            ELSE {part('after', 'hi', 'n - n0 - n1 - n2 - n3', 'below + n0 + n1 + n2 + n3')} END AS x""")
        brackets = bounded(narrowed.select(*keys, "x.*", "rank").unionByName(brackets.where(f"NOT ({still})")))
    found = attach(rows, brackets, keys, "inner").groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.expr(f"CASE WHEN n <= {small} AND lo < hi AND v BETWEEN lo AND hi THEN v END"))).alias("vs"),  # small rows at most
        F.min(F.expr("CASE WHEN v > hi THEN v END")).alias("next"), *[F.first(c).alias(c) for c in ("lo", "n", "below", "rank")])
    at = lambda r: f"CASE WHEN {r} - below >= n THEN next WHEN size(vs) = 0 THEN lo ELSE vs[cast({r} - below AS int)] END"
    ends = found.selectExpr(*keys, "rank", f"{at('floor(rank)')} AS a", f"{at('ceil(rank)')} AS b")
    return ends.select(*keys, F.expr(f"a + (b - a) * (rank - floor(rank)) AS {out}"))
