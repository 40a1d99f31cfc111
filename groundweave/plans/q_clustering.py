"""Queries over sampling, standardising and clustering."""

from pyspark.sql import functions as F

from ..operators import clustering as cl, sampling as sp
from ..oracle.base import sql
from .fixtures import dims, rasters, scene, sized, table, vectors
from .registry import query

N = 64
X = [f"x{i}" for i in range(1, N + 1)]
XSPEC = " ".join(f"{x}:d6" for x in X)
K = 4


def wide(spark, sf):
    return vectors(spark, sf, N).selectExpr("vec_id", "label AS kind", *[f"x[{i}] AS x{i + 1}" for i in range(N)])


def first_vectors(df, k=K):
    return [[r[x] for x in X] for r in df.where(f"vec_id < {k}").orderBy("vec_id").collect()]


WIDE = {"wide": "SELECT vec_id, label AS kind, " + ", ".join(f"x[{i}] AS x{i}" for i in range(1, N + 1)) + " FROM vec"}


def d2(a, b):
    return " + ".join(f"({a}.{x}-{b}.{x})*({a}.{x}-{b}.{x})" for x in X)


def assigned(points, centers):
    return f"""SELECT p.*, c.k AS label FROM {points} p JOIN {centers} c ON true
        QUALIFY row_number() OVER (PARTITION BY p.vec_id ORDER BY {d2('p', 'c')}, c.k) = 1"""


INIT = {"c0": f"SELECT vec_id + 1 AS k, {', '.join(X)} FROM wide WHERE vec_id < {K}"}
LABELLED = WIDE | INIT | {"lab0": assigned("wide", "c0")}


@query("grid_sample", "raster_id:i win_id:i row:i col:i", sql("scene dims", """
    SELECT raster_id, win_id, row, col FROM taken QUALIFY row_number() OVER (PARTITION BY raster_id
        ORDER BY md5(concat_ws('/', 'trim', win_id, row, col))) <= 500""",
    wins="""SELECT raster_id, win, i * 3 + j AS win_id, floor(i * (height - win)::DOUBLE / 2) AS w_row, floor(j * (width - win)::DOUBLE / 2) AS w_col
        FROM (SELECT *, least(16, height, width) AS win FROM dims), (SELECT unnest(range(3)) AS i), (SELECT unnest(range(3)) AS j)
        UNION ALL SELECT raster_id, win, 9 + i, ('0x' || substr(md5(concat_ws('/', raster_id, 'r', i)), 1, 8))::BIGINT % greatest(1, height - win),
        ('0x' || substr(md5(concat_ws('/', raster_id, 'c', i)), 1, 8))::BIGINT % greatest(1, width - win)
        FROM (SELECT *, least(16, height, width) AS win FROM dims), (SELECT unnest(range(4)) AS i)""",
    taken="""SELECT s.raster_id, win_id, s.row, s.col FROM scene s JOIN wins w ON s.raster_id = w.raster_id AND s.row >= w_row AND s.row < w_row + win
        AND s.col >= w_col AND s.col < w_col + win
        QUALIFY row_number() OVER (PARTITION BY s.raster_id, win_id ORDER BY md5(concat_ws('/', win_id, s.row, s.col))) <= 38"""))
def grid_sample(spark, sf):
    px = scene(spark, sf).select("raster_id", "row", "col")
    return sp.grid_window_sample(px, dims(px), 500, grid=3, win=16, extra=4)


@query("multi_sample", "raster_id:i row:i col:i", sql("scene", """SELECT raster_id, row, col FROM (
    SELECT *, md5(concat_ws('/', raster_id, row, col)) AS h FROM scene QUALIFY row_number() OVER (PARTITION BY raster_id
      ORDER BY md5(concat_ws('/', raster_id, row, col))) <= greatest(4096, 6000 // (SELECT count(DISTINCT raster_id) FROM scene)))
    QUALIFY row_number() OVER (ORDER BY h) <= 6000"""))
def multi_sample(spark, sf):
    px = scene(spark, sf)
    return sp.multi_raster_sample(px, 6000, dims(px).count())


@query("sample_size", "raster_id:l n:l", sql("rasters", """SELECT raster_id,
    greatest(100000, least(2000000, floor(0.001::DOUBLE * (height * 100) * (width * 100)))) AS n FROM rasters"""))
def sample_size(spark, sf):
    return rasters(spark, sf).selectExpr("raster_id", f"{sp.sample_size('(height * 100)', '(width * 100)')} AS n")


_STATS = "SELECT " + ", ".join(
    f"avg({x}) AS mean_{x}, coalesce(nullif(stddev_pop({x}), 0), 1) AS scale_{x}" for x in X) + " FROM wide"


@query("scaler_stats", " ".join(f"mean_{x}:d6 scale_{x}:d6" for x in X), sql("vec", _STATS, **WIDE))
def scaler_stats(spark, sf):
    return cl.scaler_stats(wide(spark, sf), X)


@query("standardize", "vec_id:l " + XSPEC, sql(
    "vec", "SELECT vec_id, " + ", ".join(f"({x} - mean_{x}) / scale_{x} AS {x}" for x in X) + " FROM wide, stats", **WIDE, stats=_STATS))
def standardize(spark, sf):
    df = wide(spark, sf)
    return cl.standardize(df, X, cl.scaler_stats(df, X).first())


def _update(prev, out):
    return (f"SELECT c.k, " + ", ".join(f"coalesce(avg(l.{x}), any_value(c.{x})) AS {x}" for x in X)
            + f" FROM {prev} c LEFT JOIN {out} l ON l.label = c.k GROUP BY c.k")


LLOYD = WIDE | INIT
for _i in range(3):
    LLOYD = LLOYD | {f"lab{_i}": assigned("wide", f"c{_i}"), f"c{_i + 1}": _update(f"c{_i}", f"lab{_i}")}


@query("lloyd_3", "k:i " + XSPEC, sql("vec", "SELECT * FROM c3", **LLOYD))
def lloyd_3(spark, sf):
    df = wide(spark, sf)
    centers = cl.lloyd(df, X, first_vectors(df), iterations=3, tol=0.0)
    return spark.createDataFrame([(i + 1, *c) for i, c in enumerate(centers)], "k INT, " + ", ".join(f"{x} DOUBLE" for x in X))


@query("kmeans_fit", "k:i " + XSPEC)
def kmeans_fit(spark, sf):
    centers = cl.fit_kmeans(wide(spark, sf), X, K)
    return spark.createDataFrame([(i + 1, *c) for i, c in enumerate(centers)], "k INT, " + ", ".join(f"{x} DOUBLE" for x in X))


def labelled_vectors(spark, sf):
    df = wide(spark, sf)
    centers = first_vectors(df)
    return cl.assign_nearest(df, X, centers), centers


@query("assign_nearest", "vec_id:l label:i", sql("vec", "SELECT vec_id, label FROM lab0", **LABELLED))
def assign_nearest(spark, sf):
    return labelled_vectors(spark, sf)[0]


@query("inertia", "inertia:d6", sql("vec", f"SELECT sum({d2('l', 'c')}) AS inertia FROM lab0 l JOIN c0 c ON c.k = l.label", **LABELLED))
def inertia(spark, sf):
    df, centers = labelled_vectors(spark, sf)
    return cl.inertia(df, X, centers)


@query("centers_rgb", "k:i r:i g:i b:i", sql("vec", """SELECT k, greatest(0, least(255, round_even(x1 * s1 + m1, 0))) AS r,
    greatest(0, least(255, round_even(x2 * s2 + m2, 0))) AS g, greatest(0, least(255, round_even(x3 * s3 + m3, 0))) AS b
    FROM c0, (SELECT stddev_pop(x1) * 900 AS s1, avg(x1) * 900 + 100 AS m1, stddev_pop(x2) * 900 AS s2, avg(x2) * 900 + 100 AS m2,
    stddev_pop(x3) * 900 AS s3, avg(x3) * 900 + 100 AS m3 FROM wide)""", **WIDE, c0="SELECT vec_id + 1 AS k, x1 * 9 AS x1, x2 * 9 AS x2, x3 * 9 AS x3 FROM wide"))
def centers_rgb(spark, sf):
    df = wide(spark, sf)
    s = cl.scaler_stats(df, X[:3]).first().asDict()
    stats = {**{f"scale_{x}": s[f"scale_{x}"] * 900 for x in X[:3]}, **{f"mean_{x}": s[f"mean_{x}"] * 900 + 100 for x in X[:3]}}
    channel = lambda x: f"cast(greatest(0D, least(255D, bround({x} * 9 * {stats[f'scale_{x}']!r}D + {stats[f'mean_{x}']!r}D))) AS int)"
    return df.selectExpr("cast(vec_id + 1 AS int) AS k", *[f"{channel(x)} AS {c}" for x, c in zip(X, "rgb")])


@query("silhouette", "silhouette:d6", sql("vec", """SELECT avg(CASE WHEN n = 1 OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END) AS silhouette
    FROM (SELECT vec_id, max(n) FILTER (WHERE own) AS n, max(total / greatest(n - 1, 1)) FILTER (WHERE own) AS a, min(total / n) FILTER (WHERE NOT own) AS b FROM per GROUP BY vec_id)""",
    **LABELLED, per=f"""SELECT p.vec_id, q.label = p.label AS own, count(*) AS n, sum(sqrt({d2('p', 'q')})) AS total
    FROM lab0 p, lab0 q GROUP BY p.vec_id, p.label, q.label"""))
def silhouette(spark, sf):
    return cl.silhouette(labelled_vectors(spark, sf)[0], X)


_CENT = "SELECT label, count(*) AS n, " + ", ".join(f"avg({x}) AS {x}" for x in X) + " FROM lab0 GROUP BY label"
_MEAN = "SELECT " + ", ".join(f"avg({x}) AS {x}" for x in X) + " FROM lab0"


@query("calinski_harabasz", "calinski_harabasz:d6", sql("vec", f"""SELECT (b / (k - 1)) / (w / (n - k)) AS calinski_harabasz FROM
    (SELECT sum(c.n * ({d2('c', 'm')})) AS b, count(*) AS k, sum(c.n) AS n FROM cent c, mean m),
    (SELECT sum({d2('l', 'c')}) AS w FROM lab0 l JOIN cent c USING (label))""", **LABELLED, cent=_CENT, mean=_MEAN))
def calinski_harabasz(spark, sf):
    return cl.calinski_harabasz(labelled_vectors(spark, sf)[0], X)


@query("davies_bouldin", "davies_bouldin:d6", sql("vec", f"""SELECT avg(w) AS davies_bouldin FROM (
    SELECT i.label, max((i.s + j.s) / sqrt({d2('i', 'j')})) AS w FROM spread i JOIN spread j ON i.label <> j.label GROUP BY i.label)""",
    **LABELLED, cent=_CENT, spread=f"SELECT c.*, s FROM cent c JOIN (SELECT l.label, avg(sqrt({d2('l', 'c')})) AS s FROM lab0 l JOIN cent c USING (label) GROUP BY l.label) USING (label)"))
def davies_bouldin(spark, sf):
    return cl.davies_bouldin(labelled_vectors(spark, sf)[0], X)


SCORE_SQL = """SELECT user_id % 7 AS model_id, 2 + event_id % 9 AS k, (sum(event_id) % 997) / 1000.0{d} AS silhouette,
    CAST(sum(user_id * 13) % 499 AS DOUBLE) AS ch, 1 + (sum(event_id) % 17) / 10.0{d} AS db, CAST(1 + sum(event_id * 3) % 5000 AS DOUBLE) AS inertia
    FROM {t} GROUP BY user_id % 7, 2 + event_id % 9"""


def score_table(spark, sf):
    return spark.sql(SCORE_SQL.format(d="D", t="{events}"), events=table(spark, sf, "events"))


_SCORES = {"scores": SCORE_SQL.format(d="::DOUBLE", t="events"), "curved": """SELECT *, greatest(0, coalesce(
    ln(lag(inertia) OVER w) - 2 * ln(inertia) + ln(lead(inertia) OVER w), 0)) AS curvature FROM scores WINDOW w AS (PARTITION BY model_id ORDER BY k)"""}


@query("elbow_curvature", "model_id:l k:i curvature:d6", sql("", "SELECT model_id, k, curvature FROM curved", **_SCORES))
def elbow_curvature(spark, sf):
    return cl.elbow_curvature(score_table(spark, sf), ["model_id"])


@query("recommend_scores", "model_id:l k:i", sql("", """SELECT model_id, min(k) AS k FROM (SELECT *, max(score) OVER (PARTITION BY model_id) AS best FROM (
    SELECT model_id, k, 0.45 * coalesce((silhouette - min(silhouette) OVER w) / nullif(max(silhouette) OVER w - min(silhouette) OVER w, 0), 0.5)
      + 0.25 * coalesce((ch - min(ch) OVER w) / nullif(max(ch) OVER w - min(ch) OVER w, 0), 0.5)
      + 0.20 * coalesce((max(db) OVER w - db) / nullif(max(db) OVER w - min(db) OVER w, 0), 0.5)
      + 0.10 * coalesce((curvature - min(curvature) OVER w) / nullif(max(curvature) OVER w - min(curvature) OVER w, 0), 0.5)
      - 0.05 * (k - min(k) OVER w)::DOUBLE / greatest(1, max(k) OVER w - min(k) OVER w) AS score FROM curved WINDOW w AS (PARTITION BY model_id)))
    WHERE best - score <= 0.03 GROUP BY model_id""", **_SCORES))
def recommend_scores(spark, sf):
    return cl.recommend_k(score_table(spark, sf), ["model_id"])


@query("finite_rows", "vec_id:l y:d6", sql("vec", "SELECT vec_id, 1 / (x1 - 0.3) AS y FROM wide WHERE vec_id % 5 > 1", **WIDE))
def finite_rows(spark, sf):
    df = wide(spark, sf).selectExpr("vec_id", """CASE vec_id % 5 WHEN 0 THEN double('NaN') WHEN 1 THEN double('Infinity')
        ELSE 1 / (x1 - 0.3D) END AS y""")
    return cl.finite_rows(df, ["y"])


@query("training_budget", "features:i budget:l")
def training_budget(spark, sf):
    px = scene(spark, sf).selectExpr("raster_id", *[f"cast({b} AS double) AS {b}" for b in ("b1", "b2", "b3", "b4")])
    n = px.count()
    budget = cl.training_budget(px, ["b1", "b2", "b3", "b4"], n, 13, lo=min(20_000, n // 2))
    return px.groupBy().agg(F.lit(4).alias("features"), F.lit(budget).alias("budget"))


@query("folder_quick_k", "k:i", sql("", """SELECT round_even(quantile_cont(2 + o_custkey % 9, 0.5), 0) AS k FROM orders
    WHERE o_orderkey IN (SELECT floor(i * (SELECT count(*) - 1 FROM orders)::DOUBLE / 4) FROM (SELECT unnest(range(5)) AS i))"""))
def folder_quick_k(spark, sf):
    per = table(spark, sf, "orders").selectExpr("o_orderkey AS pos", "cast(2 + o_custkey % 9 AS int) AS k")
    return cl.folder_median_k(per, 5)


_REPR = {"cent": """SELECT raster_id, ("left" + "left" + width * 0.5::DOUBLE) / 2 AS cx, (top - height * 0.5::DOUBLE + top) / 2 AS cy FROM rasters""",
    "ext": """SELECT count(*) AS n, min(cx) AS x0, max(cx) - min(cx) AS dx, min(cy) AS y0, max(cy) - min(cy) AS dy,
        least(count(*), greatest(8, ceil(sqrt(count(*))))) AS budget FROM cent""",
    "g1": "SELECT *, greatest(1, round_even(sqrt(budget / (dx / dy)), 0)) AS ny FROM ext",
    "g2": "SELECT *, greatest(1, round_even(budget / ny, 0)) AS nx FROM g1",
    "cell": """SELECT raster_id, cx, cy, least(floor((cx - x0) / (dx / nx)), nx - 1) AS ix, least(floor((cy - y0) / (dy / ny)), ny - 1) AS iy,
        x0, y0, dx / nx AS cw, dy / ny AS ch, budget FROM cent, g2""",
    "picked": """SELECT raster_id, budget FROM cell QUALIFY row_number() OVER (PARTITION BY ix, iy
        ORDER BY (cx - (x0 + (ix + 0.5) * cw))**2 + (cy - (y0 + (iy + 0.5) * ch))**2, raster_id) = 1"""}


@query("representative_rasters", "raster_id:l", sql("rasters", """SELECT raster_id FROM picked UNION ALL
    SELECT raster_id FROM (SELECT raster_id, row_number() OVER (ORDER BY md5(raster_id::VARCHAR), raster_id) AS n FROM rasters
      WHERE raster_id NOT IN (SELECT raster_id FROM picked)) WHERE n <= (SELECT max(budget) - count(*) FROM picked)""", **_REPR))
def representative_rasters(spark, sf):
    cat = rasters(spark, sf).selectExpr("raster_id", "left", "top", "left + width * 0.5D AS right", "top - height * 0.5D AS bottom")
    return sp.select_representative(cat)


BANDS = ["b1", "b2", "b3", "b4"]
ITERATIONS = 4  # a fixed number, as the SQL unrolls them
_SB = ", ".join(f"({b} - m{b}) / s{b} AS {b}" for b in BANDS)


def shared_model(spark, sf, k=7):
    """Scaler and Lloyd centres over all pixels of all rasters, from the first rows by hash."""
    px = scene(spark, sf).selectExpr("raster_id", "row", "col", *[f"cast({b} AS double) AS {b}" for b in BANDS])
    sample = px
    stats = cl.scaler_stats(sample, BANDS).first()
    train = cl.standardize(sample, BANDS, stats)
    init = train.orderBy(F.expr(sp.PIXEL_HASH)).limit(k).collect()
    centers = cl.lloyd(train, BANDS, [[r[b] for b in BANDS] for r in init], iterations=ITERATIONS, tol=0.0)
    return px, stats, centers


def _near(points, centers, out):
    d = " + ".join(f"(p.{b}-c.{b})*(p.{b}-c.{b})" for b in BANDS)
    return f"""SELECT p.*, c.k AS label FROM {points} p JOIN {centers} c ON true
        QUALIFY row_number() OVER (PARTITION BY p.raster_id, p.row, p.col ORDER BY {d}, c.k) = 1"""


def _move(prev, lab):
    return (f"SELECT c.k, " + ", ".join(f"coalesce(avg(l.{b}), any_value(c.{b})) AS {b}" for b in BANDS)
            + f" FROM {prev} c LEFT JOIN {lab} l ON l.label = c.k GROUP BY c.k")


SHARED = {
    "sample": "SELECT raster_id, row, col, b1, b2, b3, b4, md5(concat_ws('/', raster_id, row, col)) AS h FROM scene",
    "st": "SELECT " + ", ".join(f"avg({b}) AS m{b}, coalesce(nullif(stddev_pop({b}), 0), 1) AS s{b}" for b in BANDS) + " FROM sample",
    "train": f"SELECT raster_id, row, col, h, {_SB} FROM sample, st",
    "c0": "SELECT row_number() OVER (ORDER BY h) AS k, b1, b2, b3, b4 FROM train QUALIFY row_number() OVER (ORDER BY h) <= 7",
    **{name: text for i in range(ITERATIONS) for name, text in ((f"l{i}", _near("train", f"c{i}", "")), (f"c{i + 1}", _move(f"c{i}", f"l{i}")))},
    "std_all": f"SELECT raster_id, row, col, {_SB} FROM scene, st",
    "shared": _near("std_all", f"c{ITERATIONS}", ""),
}


@query("shared_model_labels", "raster_id:i row:i col:i label:i", sql("scene", "SELECT raster_id, row, col, label FROM shared", **SHARED))
def shared_model_labels(spark, sf):
    px, stats, centers = shared_model(spark, sf)
    return cl.assign_nearest(cl.standardize(px, BANDS, stats), BANDS, centers)
