import numpy as np
import pytest

from groundweave.functions import stats
from groundweave.operators import features as ft, focal

RNG = np.random.default_rng(7)


def grid(df, col, shape):
    out = np.full(shape, np.nan)
    for r in df.select("row", "col", col).collect():
        out[r[0], r[1]] = r[2]
    return out


@pytest.mark.parametrize("size,shape,tile", [(3, (5, 7), 512), (3, (20, 33), 8), (11, (20, 33), 16), (61, (4, 9), 512)])
def test_box_sums_match_symmetric_padding(raster, size, shape, tile):
    a = RNG.integers(0, 256, shape)
    got = grid(focal.box_sums(raster(v=a), {"s": "v"}, size, tile=tile), "s", shape)
    k = size // 2
    padded = np.pad(a, k, mode="symmetric")
    want = np.array([[padded[r:r + size, c:c + size].sum() for c in range(shape[1])] for r in range(shape[0])])
    assert (got == want).all()


@pytest.mark.parametrize("r,tile", [(1, 512), (2, 9), (5, 512)])
def test_rank_median_is_clipped_at_the_edge(raster, r, tile):
    a = RNG.integers(1, 14, (12, 17))
    got = grid(focal.rank_median(raster(v=a), "v", r, "m", tile=tile), "m", a.shape)
    for y in range(12):
        for x in range(17):
            near = sorted(a[v, u] for v in range(12) for u in range(17) if (v - y) ** 2 + (u - x) ** 2 <= r * r)
            assert got[y, x] == near[len(near) // 2]


def test_majority_takes_smallest_on_ties(raster):
    a = np.array([[2, 1], [1, 2]])
    got = grid(focal.majority(raster(v=a), "v", 1, "m"), "m", a.shape)
    assert got.tolist() == [[1, 1], [1, 1]] or got[0, 0] == 1


def test_gradient_matches_numpy(raster):
    a = RNG.integers(0, 255, (9, 11))
    df = focal.gradient(raster(v=a), "cast(v AS double)", tile=4)
    gy, gx = np.gradient(a.astype(float))
    assert np.allclose(grid(df, "gy", a.shape), gy) and np.allclose(grid(df, "gx", a.shape), gx)


def test_gaussian_mirrors_without_repeating_the_edge(raster):
    a = RNG.integers(0, 255, (8, 13))
    k = np.array(focal.gaussian_kernel(11))
    padded = np.pad(a.astype(float), 5, mode="reflect")
    want = np.array([[(padded[r:r + 11, c:c + 11] * np.outer(k, k)).sum() for c in range(13)] for r in range(8)])
    assert np.allclose(grid(focal.gaussian(raster(v=a), {"g": "cast(v AS double)"}, 11), "g", a.shape), want)


def test_entropy_of_flat_and_two_valued_areas(raster):
    flat = focal.entropy(raster(v=np.full((6, 6), 9)), "v", 2, "e")
    assert flat.where("e <> 0").count() == 0


def test_exact_percentile_for_any_distribution(spark):
    values = np.concatenate([RNG.normal(size=500), np.full(700, 0.25), RNG.normal(size=40) * 100])
    rows = [(0, float(v)) for v in values] + [(1, 3.0)]
    df = spark.createDataFrame(rows, "k INT, v DOUBLE")
    for p in (0.5, 0.95, 0.98):
        got = {r["k"]: r["q"] for r in stats.percentile(df, ["k"], "v", p, "q", small=16).collect()}
        assert got[0] == pytest.approx(np.percentile(values, p * 100)) and got[1] == 3.0


def test_p98_counts_values_first(spark):
    rows = [(0, int(v), int(v) // 2, 3) for v in RNG.integers(0, 256, 400)]
    df = spark.createDataFrame(rows, "raster_id INT, b1 INT, b2 INT, b3 INT")
    want = np.percentile([v for r in rows for v in r[1:]], 98)
    assert ft.p98(df).first()["scale"] == pytest.approx(want)


def test_hsv_primary_colours(spark):
    df = spark.createDataFrame([(255, 0, 0), (0, 255, 0), (0, 0, 255), (0, 0, 0), (200, 200, 200)], "b1 INT, b2 INT, b3 INT")
    assert [(r.h, r.s, r.v) for r in ft.hsv8(df).collect()] == [(0, 255, 255), (60, 255, 255), (120, 255, 255), (0, 0, 0), (0, 0, 200)]


def test_feature_fallback_is_band_one(raster):
    df = ft.feature_table(raster(b1=[[4, 5]], b2=[[1, 1]], b3=[[1, 1]]), {}, ["b1", "b2", "b3"])
    assert sorted(r.f_raw for r in df.collect()) == [4.0, 5.0]


def test_superpixels_follow_colour_borders(raster):
    a = np.zeros((16, 16), int)
    a[:, 7:] = 200
    px = raster(b1=a, b2=a, b3=a)
    seg = grid(ft.superpixels(px, n_segments=4, rounds=3), "segment", a.shape)
    assert not set(seg[:, :7].ravel()) & set(seg[:, 7:].ravel())
