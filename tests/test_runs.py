import numpy as np
import pytest

from groundweave.operators import masks as mk, runs as rn

RNG = np.random.default_rng(3)


def mask_runs(raster, m):
    px = raster(m=m.astype(int))
    dims = px.groupBy("raster_id", "height", "width").count().drop("count")
    return px, rn.runs_of(px.where("m = 1")), dims


def cells(runs):
    return {(r["row"], r["col"]) for r in rn.pixels_of(runs).select("row", "col").collect()}


def brute(m, footprint, how, outside=False):
    h, w = m.shape
    offsets = [(dy, dx) for dy, (l, r) in footprint.items() for dx in range(-l, r + 1)]
    inside = lambda y, x: 0 <= y < h and 0 <= x < w
    test = any if how == "dilate" else all
    default = False if how == "dilate" else outside
    return {(y, x) for y in range(h) for x in range(w)
            if test(m[y + dy, x + dx] if inside(y + dy, x + dx) else default for dy, dx in offsets)}


def flood(m, conn):
    h, w = m.shape
    steps = [(0, 1), (1, 0), (0, -1), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if conn == 8 else [])
    label, n = np.zeros(m.shape, int), 0
    for y in range(h):
        for x in range(w):
            if m[y, x] and not label[y, x]:
                n += 1
                stack = [(y, x)]
                label[y, x] = n
                while stack:
                    a, b = stack.pop()
                    for dy, dx in steps:
                        v, u = a + dy, b + dx
                        if 0 <= v < h and 0 <= u < w and m[v, u] and not label[v, u]:
                            label[v, u] = n
                            stack.append((v, u))
    return label


@pytest.mark.parametrize("footprint", [rn.diamond(2), rn.disk(2), rn.rect(3), rn.ellipse(5), rn.ellipse(4)])
def test_morphology_matches_brute_force(raster, footprint):
    m = RNG.random((9, 12)) < 0.6
    _, runs, dims = mask_runs(raster, m)
    assert cells(rn.dilate(runs, footprint, dims)) == brute(m, footprint, "dilate")
    for outside in (True, False):
        assert cells(rn.erode(runs, footprint, dims, outside)) == brute(m, footprint, "erode", outside)


def test_opening_within_mask_within_closing(raster):
    m = RNG.random((12, 15)) < 0.7
    _, runs, dims = mask_runs(raster, m)
    own = cells(runs)
    assert cells(rn.opening(runs, rn.disk(1), dims)) <= own <= cells(rn.closing(runs, rn.disk(1), dims))


def test_set_algebra(raster):
    a, b = RNG.random((6, 9)) < 0.5, RNG.random((6, 9)) < 0.5
    _, ra, dims = mask_runs(raster, a)
    _, rb, _ = mask_runs(raster, b)
    of = lambda m: set(zip(*map(lambda v: v.tolist(), np.nonzero(m))))
    assert cells(rn.union(ra, rb)) == of(a | b)
    assert cells(rn.intersect(ra, rb)) == of(a & b)
    assert cells(rn.subtract(ra, rb)) == of(a & ~b)
    assert cells(rn.complement(ra, dims)) == of(~a)


SNAKE = np.zeros((17, 17), bool)
SNAKE[::2] = True
SNAKE[1::4, -1] = True
SNAKE[3::4, 0] = True


@pytest.mark.parametrize("conn,tile,kind", [(4, 512, "random"), (4, 5, "random"), (8, 4, "random"), (4, 4, "snake")])
def test_components_match_flood_fill(raster, conn, tile, kind):
    m = SNAKE if kind == "snake" else RNG.random((21, 26)) < 0.55
    _, runs, _ = mask_runs(raster, m)
    got = {(r["row"], r["col"]): r["comp"] for r in rn.pixels_of(rn.components(runs, connectivity=conn, tile=tile)).collect()}
    want = flood(m, conn)
    pairs = {(got[y, x], want[y, x]) for y, x in got}
    assert len(got) == m.sum() and len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})
    for comp in {c for c in got.values()}:  # the id names the first pixel
        assert divmod(comp, 2 ** 31) == min(k for k, v in got.items() if v == comp)


def test_fill_holes_leaves_open_bays(raster):
    m = np.ones((6, 8), bool)
    m[2:4, 2:4] = False
    m[4:, 6] = False
    _, runs, dims = mask_runs(raster, m)
    assert cells(rn.fill_holes(runs, dims)) == cells(runs) | {(2, 2), (2, 3), (3, 2), (3, 3)}


@pytest.mark.parametrize("seed", [None, 1, 2, 3])
def test_nearest_source_with_ties_and_far_targets(raster, seed):
    m = np.zeros((13, 22), int)
    if seed is None:
        m[2, 1] = m[9, 3] = m[5, 5] = m[2, 5] = 1
    else:
        m = (np.random.default_rng(seed).random((13, 22)) < seed * 0.03).astype(int)
    px = raster(m=m).unionByName(raster(7, m=np.zeros((2, 3), int)))  # the second has no sources
    got = {(r["raster_id"], r["row"], r["col"]): (r["src_row"], r["src_col"])
           for r in rn.nearest_source(px.where("m = 0").select("raster_id", "row", "col"), px, "m = 1").collect()}
    sources = [(y, x) for y, x in zip(*np.nonzero(m))]
    assert len(got) == 13 * 22 - len(sources) + 6
    for (raster_id, y, x), src in got.items():
        assert src == ((None, None) if raster_id == 7 else min(sources, key=lambda s: ((s[0] - y) ** 2 + (s[1] - x) ** 2, s)))


def test_lower_envelope_takes_the_cheapest_everywhere():
    rng = np.random.default_rng(4)
    for _ in range(200):
        width = int(rng.integers(1, 30))
        columns = sorted(rng.choice(width, int(rng.integers(1, width + 1)), replace=False).tolist())
        found, row = rng.integers(0, 12, len(columns)).tolist(), int(rng.integers(0, 12))
        starts, kept = rn.lower_envelope(columns, found, row, 12, width)
        for x in range(width):
            best = kept[int(np.searchsorted(starts, x, side="right")) - 1]
            assert best == min(range(len(columns)), key=lambda i: ((columns[i] - x) ** 2 + (found[i] - row) ** 2, found[i], columns[i]))


def test_nearest_source_without_sources(raster):
    px = raster(m=np.zeros((3, 4), int))
    out = rn.nearest_source(px.select("raster_id", "row", "col"), px, "m = 1")
    assert out.where("src_row IS NOT NULL").count() == 0 and out.count() == 12


def test_contour_and_hull_area(raster):
    shapes = np.zeros((12, 20), bool)
    shapes[1:5, 1:7] = True                      # box: 3 x 5
    shapes[7, 1:9] = True                        # line: no area
    for i in range(5):
        shapes[6 + i, 11:12 + i] = True          # triangle
    _, runs, _ = mask_runs(raster, shapes)
    rows = {r["area"]: r for r in mk.component_shape(rn.components(runs, connectivity=8)).collect()}
    assert (rows[24]["contour_area"], rows[24]["hull_area"], rows[24]["solidity"]) == (15.0, 15.0, 1.0)
    assert (rows[8]["contour_area"], rows[8]["hull_area"], rows[8]["solidity"]) == (0.0, 0.0, 0.0)
    assert (rows[15]["contour_area"], rows[15]["hull_area"]) == (8.0, 8.0)


def test_hull_of_random_blobs_matches_monotone_chain(raster):
    m = RNG.random((14, 14)) < 0.6
    _, runs, _ = mask_runs(raster, m)
    got = {r["comp"]: r["hull_area"] for r in mk.hull_area(rn.components(runs, connectivity=8)).collect()}
    label = flood(m, 8)
    for n in range(1, label.max() + 1):
        pts = sorted((int(x), int(y)) for y, x in zip(*np.nonzero(label == n)))
        def half(points):
            out = []
            for p in points:
                while len(out) >= 2 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                    out.pop()
                out.append(p)
            return out
        hull = half(pts)[:-1] + half(pts[::-1])[:-1]
        area = abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(hull, hull[1:] + hull[:1]))) / 2
        first = min((y, x) for x, y in pts)
        assert got[first[0] * 2 ** 31 + first[1]] == area


def test_detector_tiles_keep_each_pixel_once(raster):
    m = np.ones((9, 23), int)
    px = raster(b1=m * 10, b2=m * 200, b3=m * 10)
    found = mk.detect_tiled(px, lambda t: rn.runs_of(t.where("b2 > 100")), size=8, overlap=2)
    assert found.count() == found.distinct().count() == 9 * 23


def test_hull_of_tall_and_random_components(raster, monkeypatch):
    rng = np.random.default_rng(2)
    m = rng.random((40, 30)) < 0.62
    px = raster(m=m.astype(int))
    comps = rn.components(rn.runs_of(px.where("m = 1")), connectivity=8)
    members = {}
    for r in comps.collect():
        members.setdefault(r["comp"], []).extend((x, r["row"]) for x in range(r["c0"], r["c1"] + 1))

    def area(points):
        """By support lines: the directed pairs that have no point on their right."""
        points, total = sorted(set(points)), 0
        for p in points:
            for q in points:
                turns = [(q[0] - p[0]) * (o[1] - p[1]) - (q[1] - p[1]) * (o[0] - p[0]) for o in points]
                if p != q and min(turns) >= 0 and all(t or min(p, q) <= o <= max(p, q) for t, o in zip(turns, points)):
                    total += p[0] * q[1] - q[0] * p[1]
        return total / 2

    for rows in (512, 3):
        monkeypatch.setattr(mk, "HULL_ROWS", rows)
        got = {r["comp"]: r["hull_area"] for r in mk.hull_area(comps).collect()}
        assert got == {c: area(p) for c, p in members.items() if len(p) < 60} | {c: got[c] for c, p in members.items() if len(p) >= 60}
        largest = max(members, key=lambda c: len(members[c]))
        assert got[largest] == area([p for p in members[largest] if (p[0] - 1, p[1]) not in members[largest] or (p[0] + 1, p[1]) not in members[largest]])
