"""k-means of many rasters at once, for one or several k each.

Scaler, centres and scores are tables keyed by raster_id (and k); all rasters are trained by
the same jobs, and nothing of a raster reaches the driver. Standardised rows are packed once,
where they lie, into blocks of one raster; an iteration joins the small models to the blocks,
adds up each cluster's rows inside the task and shuffles one row per (task, model, cluster). A
raster with most of the rows is many blocks and so many tasks.

A model is (raster_id, k, centers ARRAY<DOUBLE>, done): k centres one after another, the start
being the raster's first rows by hash. A raster with fewer than k rows has no model for k.
Nearest centres are the first on ties; an empty cluster keeps its centre.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import attach, bounded, cut
from . import clustering as cl, sampling as sp

TOLERANCE = 1e-4
HELD = 4096  # sums of (model, cluster) that a task keeps before it passes them on


def scale_each(table: DataFrame, feats: list[str], carry: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Rows standardised by their own raster's mean and deviation, and these statistics per raster."""
    stats = cut(cl.scaler_stats(table, feats, ["raster_id"]), "scalers")
    scaled = attach(table, stats, ["raster_id"], "inner")
    return scaled.select("raster_id", "row", "col", *carry, *[((F.col(f) - F.col(f"mean_{f}")) / F.col(f"scale_{f}")).alias(f) for f in feats]), stats


def pack_blocks(rows: DataFrame, feats: list[str]) -> DataFrame:
    """(raster_id, rows BINARY): the features of the rows of one raster in one batch, as float64."""

    def pack(batches):
        for pdf in batches:
            x = np.ascontiguousarray(pdf[feats].to_numpy(dtype="<f8"))
            found = [(raster, x[at].tobytes()) for raster, at in pdf.groupby("raster_id").indices.items()]
            yield pd.DataFrame(found, columns=["raster_id", "rows"])

    return cut(rows.select("raster_id", *feats).mapInPandas(pack, "raster_id int, rows binary"), "blocks")


def start_models(rows: DataFrame, feats: list[str], ks: list[int]) -> DataFrame:
    """Models whose centres are each raster's first rows by hash."""
    first = sp.first_by_hash(rows, ["raster_id"], sp.PIXEL_HASH, max(ks))
    lists = first.groupBy("raster_id").agg(F.array_sort(F.collect_list(F.struct(F.expr(sp.PIXEL_HASH).alias("h"), F.array(*feats).alias("x")))).alias("xs"))  # max(ks) rows
    each = lists.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).where("size(xs) >= k")
    return each.selectExpr("raster_id", "k", "flatten(transform(slice(xs, 1, k), s -> s.x)) AS centers", "false AS done")


def _nearest(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest centre and the squared distance to it."""
    d = ((x[:, None, :] - centers[None]) ** 2).sum(axis=2) if len(x) * centers.size <= 1 << 20 else np.stack([((x - c) ** 2).sum(axis=1) for c in centers], axis=1)
    label = d.argmin(axis=1)
    return label, d[np.arange(len(x)), label]


def _each_model(batches, d: int, width: int, values):
    """Sums over the rows of blocks: ``values(x, model)`` gives a (k, width) array for each model.

    Yields (raster_id, k, cluster, v), v being the sums of a cluster, added up over the task's blocks.
    """
    held: dict[tuple[int, int], np.ndarray] = {}

    def out():
        rows = [(raster, k, c + 1, v.tolist()) for (raster, k), sums in held.items() for c, v in enumerate(sums)]
        return pd.DataFrame(rows, columns=["raster_id", "k", "cluster", "v"])

    for pdf in batches:
        for raster, raw, models in zip(pdf["raster_id"], pdf["rows"], pdf["models"]):
            x = np.frombuffer(raw, "<f8").reshape(-1, d)
            for m in models:
                key, sums = (raster, m["k"]), values(x, m)
                held[key] = held[key] + sums if key in held else sums
        if sum(len(s) for s in held.values()) > HELD:
            yield out()
            held.clear()
    yield out()


def _summed(blocks: DataFrame, models: DataFrame, d: int, width: int, values) -> DataFrame:
    """(raster_id, k, cluster, v0, v1, ...): ``values`` added up over all blocks of a model."""
    per_raster = models.groupBy("raster_id").agg(F.collect_list(F.struct(*[c for c in models.columns if c != "raster_id"])).alias("models"))  # one row per k
    joined = attach(blocks, per_raster, ["raster_id"], "inner")
    parts = joined.select("raster_id", "rows", "models").mapInPandas(lambda b: _each_model(b, d, width, values), "raster_id int, k int, cluster int, v array<double>")
    return parts.groupBy("raster_id", "k", "cluster").agg(*[F.sum(F.get("v", F.lit(i))).alias(f"v{i}") for i in range(width)])


def _add_at(label: np.ndarray, k: int, columns: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.bincount(label, weights=c, minlength=k) for c in columns], axis=1)


def fit_each(blocks: DataFrame, models: DataFrame, d: int, iterations: int = 80, tol: float = TOLERANCE) -> DataFrame:
    """Lloyd iterations of all models together, until each one's centres rest."""

    def values(x, m):
        k = m["k"]
        label, _ = _nearest(x, np.array(m["centers"]).reshape(k, d))
        return _add_at(label, k, [np.ones(len(x)), *x.T])

    models = cut(models, "models")
    for _ in range(iterations):
        moving = models.where("NOT done")
        sums = _summed(blocks, moving, d, d + 1, values)
        mean = F.struct("cluster", F.expr(f"CASE WHEN v0 > 0 THEN array({', '.join(f'v{i + 1} / v0' for i in range(d))}) END AS x"))
        found = sums.groupBy("raster_id", "k").agg(F.array_sort(F.collect_list(mean)).alias("means"))  # k rows
        moved = attach(moving, found, ["raster_id", "k"]).selectExpr(
            "raster_id", "k", "centers AS old", f"flatten(transform(sequence(1, k), c -> coalesce(means[c - 1].x, slice(centers, (c - 1) * {d} + 1, {d})))) AS centers")
        shift = "sqrt(aggregate(zip_with(old, centers, (a, b) -> (a - b) * (a - b)), 0D, (s, v) -> s + v))"
        models = cut(moved.selectExpr("raster_id", "k", "centers", f"{shift} < {tol!r}D AS done").unionByName(models.where("done")), "models")
        if models.where("NOT done").isEmpty():
            break
    return models


def measure_each(blocks: DataFrame, models: DataFrame, d: int) -> DataFrame:
    """raster_id, k, silhouette, ch, db, inertia of every model, each from sums over its clusters.

    The silhouette is that of squared Euclidean distances: a point's mean squared distance to a
    cluster follows from the cluster's size, mean and mean square, so the work is rows x k.
    A cluster of one scores 0, as does every row of a model with one cluster in use.
    """

    def moments(x, m):
        k = m["k"]
        label, nearest = _nearest(x, np.array(m["centers"]).reshape(k, d))
        return _add_at(label, k, [np.ones(len(x)), *x.T, (x * x).sum(axis=1), nearest])

    models = models.select("raster_id", "k", "centers")
    known = _summed(blocks, models, d, d + 3, moments)
    cluster = F.struct("cluster", *[f"v{i}" for i in range(d + 3)])
    known = cut(attach(models, known.groupBy("raster_id", "k").agg(F.array_sort(F.collect_list(cluster)).alias("clusters")), ["raster_id", "k"], "inner").selectExpr(  # k rows
        "raster_id", "k", "centers", f"flatten(transform(clusters, c -> array({', '.join(f'c.v{i}' for i in range(d + 2))}))) AS sums", f"aggregate(clusters, 0D, (s, c) -> s + c.v{d + 2}) AS inertia"), "moments")

    def spread(x, m):
        k, sums = m["k"], np.array(m["sums"]).reshape(m["k"], d + 2)
        label, _ = _nearest(x, np.array(m["centers"]).reshape(k, d))
        n, used = sums[:, 0], sums[:, 0] > 0
        mean = sums[:, 1:-1] / np.maximum(n, 1)[:, None]
        away = np.sqrt(((x - mean[label]) ** 2).sum(axis=1))
        # total squared distance of each row to the rows of each cluster
        total = np.maximum((x * x).sum(axis=1)[:, None] * n - 2 * (x @ sums[:, 1:-1].T) + sums[:, -1], 0.0)
        at = np.arange(len(x))
        own = total[at, label] / np.maximum(n[label] - 1, 1)
        others = np.where(used, total / np.maximum(n, 1), np.inf)
        others[at, label] = np.inf
        other = others.min(axis=1)
        top = np.maximum(own, other)
        good = (n[label] > 1) & np.isfinite(other) & (top > 0)
        score = np.where(good, (np.where(good, other, 0.0) - own) / np.where(good, top, 1.0), 0.0)
        return _add_at(label, k, [away, score])

    apart = _summed(blocks, known.select("raster_id", "k", "centers", "sums"), d, 2, spread)
    apart = apart.groupBy("raster_id", "k").agg(F.array_sort(F.collect_list(F.struct("cluster", "v0", "v1"))).alias("c"))  # k rows
    both = attach(known, apart, ["raster_id", "k"], "inner")
    n_of = f"transform(sequence(0, k - 1), i -> sums[i * {d + 2}])"
    mean_of = f"transform(sequence(0, k - 1), i -> transform(slice(sums, i * {d + 2} + 2, {d}), v -> v / greatest(sums[i * {d + 2}], 1D)))"
    df = both.selectExpr("raster_id", "k", "inertia", "sums", f"{n_of} AS ns", f"{mean_of} AS means", "transform(c, z -> z.v0) AS away", "aggregate(c, 0D, (s, z) -> s + z.v1) AS silhouettes")
    sq = lambda a, b: f"aggregate(zip_with({a}, {b}, (p, q) -> (p - q) * (p - q)), 0D, (s, v) -> s + v)"
    add = lambda e: f"aggregate({e}, 0D, (s, v) -> s + v)"
    df = df.selectExpr(
        "*", f"{add('ns')} AS n", "filter(sequence(0, k - 1), i -> ns[i] > 0) AS used",
        f"transform(sequence(1, {d}), j -> aggregate(sequence(0, k - 1), 0D, (s, i) -> s + sums[i * {d + 2} + j]) / {add('ns')}) AS middle",
        f"aggregate(sequence(0, k - 1), 0D, (s, i) -> s + sums[i * {d + 2} + {d + 1}]) AS squares",
        "transform(sequence(0, k - 1), i -> away[i] / greatest(ns[i], 1D)) AS s")
    df = df.selectExpr(
        "*", f"aggregate(used, 0D, (t, i) -> t + ns[i] * {sq('means[i]', 'middle')}) AS between",
        f"squares - aggregate(used, 0D, (t, i) -> t + ns[i] * aggregate(means[i], 0D, (u, v) -> u + v * v)) AS within",
        f"transform(used, i -> array_max(transform(filter(used, j -> j <> i), j -> (s[i] + s[j]) / sqrt({sq('means[i]', 'means[j]')})))) AS worst")
    return df.selectExpr(
        "raster_id", "k", "silhouettes / n AS silhouette",
        "CASE WHEN size(used) < 2 OR n <= size(used) THEN 0D WHEN within <= 0 THEN 1D ELSE (between / (size(used) - 1)) / (within / (n - size(used))) END AS ch",
        f"CASE WHEN size(used) < 2 THEN 0D ELSE {add('worst')} / size(used) END AS db", "inertia")


def recommend_each(table: DataFrame, feats: list[str], lo: int = 2, hi: int = 10, iterations: int = 80, least: int = 50) -> DataFrame:
    """raster_id and the recommended k of every raster, from one sweep over k = lo..hi for all of them.

    Only finite rows count; a raster with fewer than ``least`` of them gets max(lo, 3).
    """
    rows = cl.finite_rows(table, feats)
    counts = cut(table.select("raster_id").distinct().join(rows.groupBy("raster_id").agg(F.count("*").alias("n")), "raster_id", "left").fillna(0, ["n"]), "counts")
    enough = attach(rows, counts.where(f"n >= {least}").select("raster_id"), ["raster_id"], "inner")
    scores = score_each(enough, feats, list(range(lo, hi + 1)), iterations)
    best = cl.recommend_k(scores, ["raster_id"])
    return counts.join(bounded(best), "raster_id", "left").selectExpr("raster_id", f"coalesce(k, {max(lo, 3)}) AS k")


def score_each(rows: DataFrame, feats: list[str], ks: list[int], iterations: int = 80, tol: float = TOLERANCE) -> DataFrame:
    """Scores of every (raster, k), k below the raster's rows."""
    scaled, _ = scale_each(rows, feats)
    scaled = cut(scaled, "scaled")
    blocks = pack_blocks(scaled, feats)
    models = fit_each(blocks, start_models(scaled, feats, ks), len(feats), iterations, tol)
    return cut(measure_each(blocks, models, len(feats)), "scores")


def label_each(rows: DataFrame, feats: list[str], models: DataFrame, k: int) -> DataFrame:
    """1-based nearest centre of each standardised row under its raster's model of k centres.

    The centres are columns of a row per raster, so that the comparison stays inside
    generated code and is compiled once for all rasters.
    """
    d = len(feats)
    wide = models.where(F.col("k") == k).select(
        "raster_id", *[F.get("centers", F.lit(c * d + i)).alias(f"_c{c}_{i}") for c in range(k) for i in range(d)])
    df = attach(rows, wide, ["raster_id"], "inner")
    away = lambda c: " + ".join(f"({f} - _c{c}_{i}) * ({f} - _c{c}_{i})" for i, f in enumerate(feats))
    for at in range(0, k, cl.CHUNK):
        batch = ", ".join(f"struct({away(c)} AS d, {c + 1} AS k)" for c in range(at, min(k, at + cl.CHUNK)))
        best = f"least({batch})" if k - at > 1 else batch
        df = df.withColumn("_best" if not at else "_next", F.expr(best))
        if at:
            df = df.withColumn("_best", F.expr("CASE WHEN _next.d < _best.d THEN _next ELSE _best END")).drop("_next")
    return df.withColumn("label", F.col("_best.k")).drop("_best", *[c for c in wide.columns if c != "raster_id"])
