"""Standardising, k-means and cluster quality measures.

Feature rows are wide double columns. Centres (k <= 30 of them) are driver-side
literals between iterations, as in any k-means driver; rows stay distributed.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import cut

CHUNK = 4
STRIPS, STRIP = 8, 500_000  # strips that the silhouette deals its rows into; most rows in one
CLOSE = 1e-4  # below this share of two points' squared norms their squared distance is taken from the differences


def scaler_stats(df: DataFrame, feats: list[str], keys: list[str] = ()) -> DataFrame:
    """Mean and population deviation per feature; a zero deviation becomes 1."""
    aggs = []
    for f in feats:
        sd = F.stddev_pop(f)
        aggs += [F.avg(f).alias(f"mean_{f}"), F.coalesce(F.nullif(sd, F.lit(0.0)), F.lit(1.0)).alias(f"scale_{f}")]
    return df.groupBy(*keys).agg(*aggs)


def standardize(df: DataFrame, feats: list[str], stats) -> DataFrame:
    """(x - mean) / scale with one collected row of statistics."""
    return df.withColumns({f: (F.col(f) - F.lit(stats[f"mean_{f}"])) / F.lit(stats[f"scale_{f}"]) for f in feats})


def finite_rows(df: DataFrame, feats: list[str]) -> DataFrame:
    ok = [f"({f} IS NOT NULL AND NOT isnan({f}) AND abs({f}) < double('Infinity'))" for f in feats]
    return df.where(" AND ".join(ok))


def assign_nearest(df: DataFrame, feats: list[str], centers: list[list[float]], out: str = "label") -> DataFrame:
    """1-based index of the nearest centre, the first on ties.

    The row's own norm is the same for every centre, so |c|^2 - 2 x.c decides. Centres
    are compared a few at a time, which keeps each generated method small enough to be
    compiled by the JVM.
    """
    def score(c):
        return " + ".join([f"{math.fsum(v * v for v in c)!r}D"] + [f"({-2.0 * v!r}D) * {f}" for v, f in zip(c, feats)])

    for start in range(0, len(centers), CHUNK):
        batch = ", ".join(
            f"struct({score(c)} AS d, {start + i + 1} AS k)" for i, c in enumerate(centers[start:start + CHUNK]))
        best = f"least({batch})" if len(centers) - start > 1 else batch
        if start == 0:
            df = df.withColumn("_best", F.expr(best))
        else:
            df = df.withColumn("_next", F.expr(best)).withColumn(
                "_best", F.expr("CASE WHEN _next.d < _best.d THEN _next ELSE _best END")).drop("_next")
    return df.withColumn(out, F.col("_best.k")).drop("_best")


def squared_distance(feats: list[str], centers: list[list[float]], label: str = "label") -> str:
    cs = "array(" + ", ".join("array(" + ", ".join(f"{v!r}D" for v in c) + ")" for c in centers) + ")"
    xs = "array(" + ", ".join(feats) + ")"
    return f"aggregate(zip_with({xs}, {cs}[{label} - 1], (a, b) -> (a - b) * (a - b)), 0D, (s, d) -> s + d)"


def inertia(df: DataFrame, feats: list[str], centers: list[list[float]]) -> DataFrame:
    return df.agg(F.sum(F.expr(squared_distance(feats, centers))).alias("inertia"))


def lloyd(df: DataFrame, feats: list[str], centers: list[list[float]], iterations: int = 80, tol: float = 1e-4) -> list[list[float]]:
    """Lloyd iterations; an empty cluster keeps its centre; stops when centres rest."""
    for _ in range(iterations):
        means = assign_nearest(df, feats, centers).groupBy("label").agg(*[F.avg(f).alias(f) for f in feats]).collect()
        moved = {r["label"]: [r[f] for f in feats] for r in means}
        new = [moved.get(i + 1, c) for i, c in enumerate(centers)]
        shift = math.sqrt(sum((a - b) ** 2 for o, n in zip(centers, new) for a, b in zip(o, n)))
        centers = new
        if shift < tol:
            break
    return centers


def fit_kmeans(df: DataFrame, feats: list[str], k: int, seed: int = 42, full: bool = False) -> list[list[float]]:
    """Library k-means: 80 iterations for training samples, 300 for full fits."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=feats, outputCol="v").transform(df).select("v")
    model = KMeans(featuresCol="v", k=k, seed=seed, maxIter=300 if full else 80).fit(rows)
    return [list(map(float, c)) for c in model.clusterCenters()]


def centers_to_rgb(centers: list[list[float]], stats, feats: list[str]) -> list[tuple[int, int, int]]:
    """First three feature columns, un-standardised, rounded half-even and clipped.

    Only right where the spectral features come first.
    """
    return [
        tuple(min(255, max(0, round(v * stats[f"scale_{f}"] + stats[f"mean_{f}"]))) for v, f in zip(c[:3], feats[:3]))
        for c in centers
    ]


def training_budget(df: DataFrame, feats: list[str], n_pixels: int, n_clusters: int, lo: int = 20_000, hi: int = 120_000, key: list[str] | None = None, presample: int | None = None) -> int:
    """Training rows from the eigenvalue entropy of standardised features.

    The correlations are taken over all rows, or over about ``presample`` rows by hash of
    the row's ``key`` columns.
    """
    import numpy as np
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.stat import Correlation

    if n_pixels <= lo or len(feats) <= 1:
        return min(n_pixels, 100_000)
    sample = df.where(f"pmod(xxhash64({', '.join(key)}), 1000000) < {math.ceil(1e6 * presample / n_pixels)}") if presample else df
    rows = VectorAssembler(inputCols=feats, outputCol="v").transform(sample)
    corr = np.nan_to_num(Correlation.corr(rows, "v").first()[0].toArray())
    share = np.clip(np.linalg.eigvalsh(corr) / max(np.trace(corr), 1e-12), 1e-12, None)
    entropy = -float(np.sum(share * np.log(share))) / math.log(len(feats))
    frac = 0.6 * (1.0 - entropy) + 0.4 * min(1.0, n_clusters / 15.0)
    return min(n_pixels, int(min(hi, max(lo, lo + frac * (hi - lo)))))


def silhouette(df: DataFrame, feats: list[str], label: str = "label", sample: int | None = None, block: int = 2048) -> DataFrame:
    """Mean silhouette (Euclidean) over all rows, or over ``sample`` rows taken by hash of the row.

    Rows are dealt into strips, and a task takes a pair of strips and sums the distances per cluster
    in both directions, so each pair is measured once and is never a row. A row goes to as many
    tasks as there are strips, and their number is the same for all sizes up to STRIPS * STRIP rows; within a task
    at most 128 rows are compared with ``block`` others at a time, as one product of matrices, and pairs
    so close that it loses digits once more by their differences. The work grows with the square of the rows; the form
    of squared distances, which ``grouped.measure_each`` gives, is linear in them.
    """
    import numpy as np
    import pyarrow as pa

    from .sampling import first_by_hash

    points = F.array(*[F.col(f).cast("double") for f in feats]).alias("_x")
    rows = cut(df.select(points, F.col(label).cast("long").alias("_label")).withColumn("_row", F.monotonically_increasing_id()), "silhouette")
    if sample:
        rows = cut(first_by_hash(rows.withColumn("_all", F.lit(0)), ["_all"], "md5(cast(_row AS string))", sample).drop("_all"), "silhouette")
    counted = {r["_label"]: r["count"] for r in rows.groupBy("_label").count().collect()}  # a row for each cluster
    total = sum(counted.values())
    clusters = sorted(k for k in counted if k is not None) or [0]  # rows without a cluster belong to none
    width = max(64, len(feats), len(clusters)) / 64  # numbers that a task holds for a row
    strips = max(1, min(STRIPS, math.ceil(total / block)), math.ceil(total * width / STRIP))
    ids, sizes = (f"array({', '.join(map(str, values))})" for values in ([f"{k}L" for k in clusters], [counted.get(k, 0) for k in clusters]))
    rows = rows.withColumns({"_own": F.expr(f"cast(coalesce(array_position({ids}, _label), 0) AS int) - 1"), "_mine": F.pmod(F.xxhash64("_row"), F.lit(strips)).cast("int")})
    rows = rows.drop("_label").withColumn("_strip", F.explode(F.sequence(F.lit(0), F.lit(strips - 1))))
    # pairs of a strip with itself have half the work and come last
    pairs = strips * (strips - 1) // 2
    rows = rows.withColumns({"_second": F.expr("_mine > _strip"), "_cell": F.expr(
        f"cast(IF(_mine = _strip, {pairs} + _mine, greatest(_mine, _strip) * (greatest(_mine, _strip) - 1) div 2 + least(_mine, _strip)) AS int)")})

    def side(parts):
        row, own, x = (np.concatenate(values) for values in zip(*parts))
        order = np.argsort(own, kind="stable")  # a block has few clusters
        return row[order], own[order], x[order]

    def members(own):
        codes = np.unique(own[own >= 0])
        return codes, (own[:, None] == codes).astype(float)

    def measure(left, right):
        """Distances of two blocks of points, a few rows at a time."""
        near, far = (np.einsum("ij,ij->i", x, x) for x in (left, right))
        a = np.column_stack([-2 * left, near, np.ones(len(left))])
        b = np.column_stack([right, np.ones(len(right)), far]).T
        room = np.empty((128, len(right)))
        for start in range(0, len(left), 128):
            norms = near[start:start + 128]
            squares = np.matmul(a[start:start + 128], b, out=room[:len(norms)])
            least = CLOSE * (norms.max() + far.max())
            if not squares.min() >= least:
                close = np.flatnonzero(~(squares >= least))
                for at in range(0, len(close), 16384):
                    i, j = np.divmod(close[at:at + 16384], len(right))
                    lossy = ~(squares[i, j] >= CLOSE * (norms[i] + far[j]))
                    i, j = i[lossy], j[lossy]
                    squares[i, j] = ((left[start + i] - right[j]) ** 2).sum(1)
            yield start, np.sqrt(squares, out=squares)

    def sums_of(own, x, others, points, same):
        """Sums of the distances from each point to each cluster of the other strip, both ways."""
        there, back = np.zeros((len(x), len(clusters))), np.zeros((len(points), len(clusters)))
        for i in range(0, len(x), block):
            mine, belongs = members(own[i:i + block])
            for j in range(i if same else 0, len(points), block):
                theirs, belong = members(others[j:j + block])
                sums = np.zeros((len(mine), len(belong)))
                for start, far in measure(x[i:i + block], points[j:j + block]):
                    there[i + start:i + start + len(far), theirs] += far @ belong
                    sums += belongs[start:start + len(far)].T @ far
                if not (same and i == j):
                    back[j:j + block, mine] += sums.T
        return (there + back, None) if same else (there, back)

    def distances(batches):
        held: dict[tuple, list] = {}
        for batch in batches:
            cell, second, row, own = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_cell", "_second", "_row", "_own"))
            x = batch.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(len(row), len(feats))
            for key in set(zip(cell.tolist(), second.tolist())):
                at = (cell == key[0]) & (second == key[1])
                held.setdefault(key, []).append((row[at], own[at], x[at]))
        for cell in {c for c, _ in held}:
            sides = [side(held.pop((cell, second))) for second in (False, True) if (cell, second) in held]
            if cell < pairs and len(sides) < 2:
                continue
            (row, own, x), (_, others, points) = sides[0], sides[-1]
            with np.errstate(all="ignore"):
                centre = x.mean(axis=0)
                found = sums_of(own, x - centre, others, points - centre, cell >= pairs)
            # a point without a place has no distances, and no other has sums with it; one in the infinite is as far from all
            lost = [~np.isfinite(s[2]).all(axis=1) for s in sides]
            for k, totals in enumerate(t for t in found if t is not None):
                if lost[-1 - k].any():
                    codes, places = (values[lost[-1 - k]] for values in sides[-1 - k][1:])
                    totals[:] = np.nan
                    if codes[0] >= 0 and (codes == codes[0]).all() and not np.isnan(places).any():
                        totals[:, codes[0]] = np.inf
                totals[lost[k]] = np.nan
                for at in range(0, len(totals), 4096):
                    part = totals[at:at + 4096]
                    lists = pa.ListArray.from_arrays(np.arange(len(part) + 1, dtype=np.int32) * len(clusters), pa.array(part.ravel(), from_pandas=True))
                    yield pa.RecordBatch.from_arrays([pa.array(sides[k][0][at:at + 4096]), pa.array(sides[k][1][at:at + 4096]), lists], ["_row", "own", "totals"])

    sums = rows.select("_cell", "_second", "_row", "_own", "_x").repartitionById(pairs + strips, "_cell").mapInArrow(distances, "_row bigint, own int, totals array<double>")
    per = sums.groupBy("_row").agg(F.first("own").alias("own"), F.expr(
        f"aggregate(collect_list(totals), array_repeat(0D, {len(clusters)}), (s, t) -> zip_with(s, t, (x, y) -> x + y))").alias("totals"))
    widths = per.withColumn("sizes", F.expr(sizes)).selectExpr(
        "CASE WHEN own >= 0 THEN sizes[own] END AS size", "CASE WHEN own >= 0 THEN totals[own] / greatest(sizes[own] - 1, 1) END AS a",
        "array_min(transform(filter(sequence(0, size(totals) - 1), k -> k <> own), k -> totals[k] / sizes[k])) AS b")
    return widths.agg(F.avg(F.expr("CASE WHEN size > 1 AND greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0D END")).alias("silhouette"))


def _moments(df: DataFrame, feats: list[str], label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n"), *[F.avg(f).alias(f"c_{f}") for f in feats],
                                 *[F.var_pop(f).alias(f"v_{f}") for f in feats])


def calinski_harabasz(df: DataFrame, feats: list[str], label: str = "label") -> DataFrame:
    """Between-cluster over within-cluster dispersion, from per-cluster moments only."""
    m = _moments(df, feats, label)
    total = W.partitionBy(F.lit(0))  # one row per cluster
    m = m.withColumns({f"g_{f}": F.sum(F.col(f"c_{f}") * F.col("n")).over(total) / F.sum("n").over(total) for f in feats})
    between = "n * (" + " + ".join(f"pow(c_{f} - g_{f}, 2)" for f in feats) + ")"
    within = "n * (" + " + ".join(f"v_{f}" for f in feats) + ")"
    return m.agg(F.sum(F.expr(between)).alias("b"), F.sum(F.expr(within)).alias("w"), F.sum("n").alias("n"), F.count("*").alias("k")).selectExpr(
        "CASE WHEN w = 0 THEN 1D ELSE (b / (k - 1)) / (w / (n - k)) END AS calinski_harabasz")


def davies_bouldin(df: DataFrame, feats: list[str], label: str = "label") -> DataFrame:
    """Mean over clusters of the worst (s_i + s_j) / d_ij."""
    centers = F.broadcast(df.groupBy(label).agg(*[F.avg(f).alias(f"c_{f}") for f in feats]))  # k rows
    away = "sqrt(" + " + ".join(f"pow({f} - c_{f}, 2)" for f in feats) + ")"
    spread = df.join(centers, label).groupBy(label).agg(F.avg(F.expr(away)).alias("s"), *[F.first(f"c_{f}").alias(f"c_{f}") for f in feats])
    packed = spread.agg(F.collect_list(F.struct("*")).alias("cs"))  # k structs
    d = lambda a, b: "sqrt(" + " + ".join(f"pow({a}.c_{f} - {b}.c_{f}, 2)" for f in feats) + ")"
    worst = f"array_max(transform(filter(cs, j -> j.{label} <> i.{label}), j -> (i.s + j.s) / {d('i', 'j')}))"
    return packed.selectExpr(f"explode(transform(cs, i -> {worst})) AS worst").agg(F.avg("worst").alias("davies_bouldin"))


def elbow_curvature(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Positive bend of log-inertia over k; 0 at both ends."""
    w = W.partitionBy(*keys).orderBy("k")
    df = scores.withColumn("_l", F.expr("ln(greatest(inertia, 1e-9D))"))
    bend = (F.lag("_l").over(w) - F.col("_l")) - (F.col("_l") - F.lead("_l").over(w))
    return df.withColumn("curvature", F.greatest(F.lit(0.0), F.coalesce(bend, F.lit(0.0)))).drop("_l")


def recommend_k(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Weighted consensus of normalised scores; the smallest k within 0.03 of the best.

    One row per key and k comes in (k in a short range), one row per key goes out.
    """
    df = elbow_curvature(scores, keys)
    w = W.partitionBy(*keys)

    def norm(c):
        lo, hi = F.min(c).over(w), F.max(c).over(w)
        return F.when(hi > lo, (F.col(c) - lo) / (hi - lo)).otherwise(0.5)

    def inverse(c):
        lo, hi = F.min(c).over(w), F.max(c).over(w)
        return F.when(hi > lo, 1 - (F.col(c) - lo) / (hi - lo)).otherwise(0.5)

    lo, hi = F.min("k").over(w), F.max("k").over(w)
    df = df.withColumn("combined", 0.45 * norm("silhouette") + 0.25 * norm("ch") + 0.20 * inverse("db")
                       + 0.10 * norm("curvature") - 0.05 * (F.col("k") - lo) / F.greatest(F.lit(1), hi - lo))
    close = df.withColumn("best", F.max("combined").over(w)).where("best - combined <= 0.03")
    return close.groupBy(*keys).agg(F.min("k").alias("k"))


def recommend_for(df: DataFrame, feats: list[str], lo: int = 2, hi: int = 10, max_samples: int | None = None) -> int:
    """Fit k = lo..hi on one raster's standardised features and recommend a k.

    All rows are used; ``max_samples`` takes that many by hash of raster_id, row and col.
    """
    from .sampling import PIXEL_HASH, first_by_hash

    taken = first_by_hash(df.withColumn("_all", F.lit(0)), ["_all"], PIXEL_HASH, max_samples).drop("_all") if max_samples else df
    rows = finite_rows(taken, feats)
    n = rows.count()
    if n < 50:
        return max(lo, 3)
    x = standardize(rows, feats, scaler_stats(rows, feats).first()).cache()
    out = []
    for k in range(lo, min(hi, max(lo, n - 1)) + 1):
        centers = fit_kmeans(x, feats, k, full=True)
        labelled = assign_nearest(x, feats, centers)
        out.append((k, silhouette(labelled, feats).first()[0], calinski_harabasz(labelled, feats).first()[0],
                    davies_bouldin(labelled, feats).first()[0], inertia(labelled, feats, centers).first()[0]))
    x.unpersist()
    scores = df.sparkSession.createDataFrame(out, "k INT, silhouette DOUBLE, ch DOUBLE, db DOUBLE, inertia DOUBLE").withColumn("_m", F.lit(0))
    return recommend_k(scores, ["_m"]).first()["k"]


def folder_median_k(per_raster: DataFrame, quick: int | None = None) -> DataFrame:
    """Rounded median of per-image k; ``quick`` takes so many evenly spaced files of the list.

    ``per_raster`` has ``pos`` (0-based position in the sorted listing) and k.
    """
    df = per_raster
    if quick:
        n = per_raster.agg(F.count("*").alias("n")).first()["n"]
        if n > quick:
            df = df.where(F.col("pos").isin([int(i * (n - 1) / (quick - 1)) for i in range(quick)]))
    return df.agg(F.bround(F.percentile("k", F.lit(0.5))).cast("int").alias("k"))
