"""k-means of many rasters at once, against plain loops."""

import math

import numpy as np
import pytest

from groundweave.operators import clustering as cl, grouped as gr

F2 = ["x", "y"]


def table_of(spark, rasters):
    rows = [(r, i // 10, i % 10, float(a), float(b)) for r, points in rasters.items() for i, (a, b) in enumerate(points)]
    return spark.createDataFrame(rows, "raster_id INT, row INT, col INT, x DOUBLE, y DOUBLE")


def blobs(seed, centres, n=40, width=0.3):
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.normal(c, width, (n, 2)) for c in centres])


def plain_lloyd(x, start, rounds):
    c = np.array(start, dtype=float)
    for _ in range(rounds):
        label = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
        new = np.array([x[label == i].mean(axis=0) if (label == i).any() else c[i] for i in range(len(c))])
        if np.sqrt(((new - c) ** 2).sum()) < 1e-4:
            return new
        c = new
    return c


def plain_scores(x, label):
    """Silhouette of squared distances over all pairs, CH, DB, by their definitions."""
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    used, s = sorted(set(label.tolist())), []
    for i in range(len(x)):
        own = (label == label[i]) & (np.arange(len(x)) != i)
        if not own.any() or len(used) < 2:
            s.append(0.0)
            continue
        a, b = d[i][own].mean(), min(d[i][label == c].mean() for c in used if c != label[i])
        s.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    means = {c: x[label == c].mean(axis=0) for c in used}
    between = sum((label == c).sum() * ((means[c] - x.mean(axis=0)) ** 2).sum() for c in used)
    within = sum(((x[label == c] - means[c]) ** 2).sum() for c in used)
    away = {c: np.sqrt(((x[label == c] - means[c]) ** 2).sum(axis=1)).mean() for c in used}
    db = np.mean([max((away[a] + away[b]) / math.dist(means[a], means[b]) for b in used if b != a) for a in used])
    return float(np.mean(s)), between / (len(used) - 1) / (within / (len(x) - len(used))), float(db), within


@pytest.fixture(scope="module")
def rasters():
    return {1: blobs(1, [(0, 0), (5, 5), (0, 6)]), 2: blobs(2, [(1, 1), (8, 0)], 70), 7: blobs(3, [(0, 0), (9, 9), (0, 9), (9, 0)], 15, 0.5)}


def test_scores_of_every_raster_and_k(spark, rasters):
    table = table_of(spark, rasters)
    scaled, _ = gr.scale_each(table, F2)
    x_of, order = {}, {}
    for r in scaled.selectExpr("*", "md5(concat_ws('/', raster_id, row, col)) AS h").orderBy("raster_id", "row", "col").collect():
        x_of.setdefault(r["raster_id"], []).append((r["x"], r["y"]))
        order.setdefault(r["raster_id"], []).append(r["h"])
    got = {(r["raster_id"], r["k"]): r for r in gr.score_each(table, F2, [2, 3, 4], iterations=9).collect()}
    assert len(got) == 9
    for raster, x in x_of.items():
        x = np.array(x)
        np.testing.assert_allclose(x.mean(axis=0), 0, atol=1e-9)
        first = np.argsort(order[raster])
        for k in (2, 3, 4):
            centers = plain_lloyd(x, x[first[:k]], 9)
            label = ((x[:, None] - centers[None]) ** 2).sum(axis=2).argmin(axis=1)
            want = plain_scores(x, label)
            r = got[raster, k]
            np.testing.assert_allclose([r["silhouette"], r["ch"], r["db"], r["inertia"]], want, rtol=1e-3)


def test_recommended_k_follows_the_blobs(spark, rasters):
    table = table_of(spark, rasters | {9: blobs(4, [(0, 0)], 20), 10: np.full((60, 2), np.nan)})
    got = {r["raster_id"]: r["k"] for r in gr.recommend_each(table, F2, 2, 5, 9).collect()}
    assert got[2] == 2 and got[1] == 3 and got[9] == 3 and got[10] == 3
    assert cl.folder_median_k(gr.recommend_each(table, F2, 2, 5, 9)).first()["k"] in (2, 3)


def test_equal_rows_few_rows_and_no_rows(spark):
    table = table_of(spark, {1: np.ones((55, 2)), 2: blobs(5, [(0, 0)], 3)})
    scores = {(r["raster_id"], r["k"]): r for r in gr.score_each(table, F2, [2, 5]).collect()}
    assert set(scores) == {(1, 2), (1, 5), (2, 2)}  # three rows have no five centres
    assert scores[1, 2]["silhouette"] == 0 and scores[1, 2]["inertia"] == 0
    assert gr.score_each(table.where("false"), F2, [2]).collect() == []
    assert gr.recommend_each(table.where("false"), F2).collect() == []


def test_labels_take_the_first_of_equal_centres(spark):
    rows = table_of(spark, {1: [(0, 0), (2, 0), (1, 0)], 2: [(9, 9), (0, 0), (5, 5)]})
    models = spark.createDataFrame([(1, 2, [0.0, 0.0, 2.0, 0.0]), (2, 2, [0.0, 0.0, 9.0, 9.0])], "raster_id INT, k INT, centers ARRAY<DOUBLE>")
    got = {(r["raster_id"], r["col"]): r["label"] for r in gr.label_each(rows, F2, models, 2).collect()}
    assert got == {(1, 0): 1, (1, 1): 2, (1, 2): 1, (2, 0): 2, (2, 1): 1, (2, 2): 2}


def test_small_memory_of_sums(spark, rasters, monkeypatch):
    table = table_of(spark, rasters).repartition(7)
    before = sorted((r["raster_id"], r["k"], round(r["inertia"], 8)) for r in gr.score_each(table, F2, [2, 3], 3).collect())
    monkeypatch.setattr(gr, "HELD", 1)
    assert before == sorted((r["raster_id"], r["k"], round(r["inertia"], 8)) for r in gr.score_each(table, F2, [2, 3], 3).collect())
