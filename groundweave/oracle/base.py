"""Building blocks of the SQL counterparts: shared CTEs and text helpers (DuckDB)."""

from __future__ import annotations

from ..functions.palette import preset_rows
from ..plans.fixtures import SCORES, SCORE_STEPS, ZONE_BANDS, band_sql

CLASS_VALUES = ", ".join(
    f"({i}, '{cid}', '{name}', '{color}', {r}, {g}, {b}, '{kind}', '{comp}')"
    for i, cid, name, color, r, g, b, kind, comp in preset_rows()
)

CTES = {
    "scene": f"""
        SELECT CAST(mrow // 50 AS INT) AS raster_id, CAST(mrow % 50 AS INT) AS row, CAST(col AS INT) AS col, zone,
               {', '.join(f"{band_sql(b, '//')} AS {b}" for b in ZONE_BANDS)}
        FROM (SELECT *, CAST(((mrow // 20) * 3 + (col // 25) * 5) % 7 AS INT) AS zone
              FROM (SELECT event_id // 100 AS mrow, event_id % 100 AS col,
                           (event_id * 7919 + user_id * 31) % 17 - 8 AS n FROM events))""",
    "dims": "SELECT raster_id, max(row) + 1 AS height, max(col) + 1 AS width FROM scene GROUP BY raster_id",
    "px": "SELECT s.*, d.height, d.width FROM scene s JOIN dims d USING (raster_id)",
    "meta": """SELECT raster_id, width, height, 0.5::DOUBLE AS a, 1000.0::DOUBLE * raster_id AS c,
               -0.5::DOUBLE AS e, 500000.0::DOUBLE AS f FROM dims""",
    "classes": f"""SELECT * FROM (VALUES {CLASS_VALUES})
        AS v(class_idx, id, name, color, r, g, b, material_type, composite_name)""",
    "labels13": """SELECT raster_id, row, col, arg_min(class_idx,
            ((b1-r)*(b1-r)+(b2-g)*(b2-g)+(b3-b)*(b3-b)) * 100 + class_idx) AS label
        FROM scene, classes GROUP BY raster_id, row, col""",
    "lab": "SELECT s.*, l.label FROM px s JOIN labels13 l USING (raster_id, row, col)",
    "vec": """SELECT vec_id, CAST(list_slice(embedding, 1, 64) AS DOUBLE[]) AS x, label FROM embeddings""",
    "rasters": """SELECT o_orderkey AS raster_id,
            '/in/' || (o_custkey % 7) || '/scene ' || o_orderkey || (CASE o_orderkey % 5 WHEN 0 THEN '.tif'
              WHEN 1 THEN '.TIFF' WHEN 2 THEN '.jpg' WHEN 3 THEN '.png' ELSE '.txt' END) AS path,
            (o_custkey % 97) * 50.0::DOUBLE AS "left", (o_orderkey % 89) * 50.0::DOUBLE AS top,
            CAST(200 + o_orderkey % 300 AS INT) AS width, CAST(200 + o_custkey % 300 AS INT) AS height,
            CAST(3 + o_orderkey % 2 AS INT) AS bands,
            CASE WHEN o_orderkey % 2 = 0 THEN 3857 ELSE 4326 END AS epsg FROM orders""",
    "user_classes": """SELECT r_regionkey + 1 AS class_idx, 'user-' || (r_regionkey + 1) AS id,
            'user-' || (['a','b','c','d','e'])[r_regionkey + 1] AS name,
            '#' || printf('%06X', (r_regionkey * 2500000 + 4210752) % 16777216) AS color FROM region""",
    "layers": """SELECT n_nationkey AS layer_idx, 'layer-' || n_nationkey AS id,
            CASE n_nationkey % 6 WHEN 1 THEN 'user-b' WHEN 3 THEN 'BM_SAND' ELSE n_name END AS name,
            CASE n_nationkey % 6 WHEN 0 THEN 'user-1' WHEN 2 THEN 'class-13' ELSE 'none' END AS class_id,
            CASE WHEN n_nationkey % 6 = 4 THEN n_nationkey * 10 END AS override_r,
            CASE WHEN n_nationkey % 6 = 4 THEN 20 END AS override_g,
            CASE WHEN n_nationkey % 6 = 4 THEN 30 END AS override_b FROM nation""",
    # Vertices of the test features: part, position, x, y in metres.
    "anchors": """SELECT s_suppkey AS feature_id, s_nationkey % 3 AS layer_idx, s_suppkey % 2 AS rid,
            (['point','line','triangle','box'])[s_suppkey % 4 + 1] AS kind,
            (s_suppkey * 37) % 90 + 0.25::DOUBLE + CASE WHEN s_suppkey % 7 = 0 THEN 5000 ELSE 0 END AS x0,
            (s_suppkey * 53) % 45 + 0.25::DOUBLE AS y0, (2 + s_suppkey % 8)::DOUBLE AS s
        FROM supplier WHERE s_suppkey % 10 <> 9""",
    "verts": """SELECT feature_id, layer_idx, kind, part, pos,
            1000.0::DOUBLE*rid + 0.5*(x0 + dx*s) AS x, 500000.0::DOUBLE - 0.5*(y0 + dy*s) AS y
        FROM anchors JOIN (VALUES
            ('point',1,1,0::DOUBLE,0::DOUBLE),
            ('line',1,1,0,0), ('line',1,2,1,0.5), ('line',1,3,1.5,0.3),
            ('triangle',1,1,0,0), ('triangle',1,2,1,0), ('triangle',1,3,0,1), ('triangle',1,4,0,0),
            ('box',1,1,0,0), ('box',1,2,1,0), ('box',1,3,1,1), ('box',1,4,0,1), ('box',1,5,0,0),
            ('box',2,1,0.3,0.3), ('box',2,2,0.7,0.3), ('box',2,3,0.7,0.7), ('box',2,4,0.3,0.7), ('box',2,5,0.3,0.3)
        ) AS t(k, part, pos, dx, dy) ON k = kind""",
    "clusters": f"""SELECT k // 13 AS model_id, CAST(k % 13 + 1 AS INT) AS cluster, CAST((k * 37 + z * 5) % 256 AS INT) AS r,
            CAST((k * 73 + z * 3) % 256 AS INT) AS g,
            CAST(CASE WHEN k % 3 = 0 THEN (k * 37 + z * 5 + k % 11) % 256 ELSE (k * 29) % 256 END AS INT) AS b,
            1 + (k * 7919) % 1000 AS pixels,
            {', '.join(f"((k * {step} + z) % 101) / 100.0::DOUBLE AS {name}" for name, step in zip(SCORES, SCORE_STEPS))}
        FROM (SELECT p_partkey AS k, p_size AS z FROM part)""",
    "progress": """SELECT user_id % 20 AS task_id, ts, event_id AS seq,
            CASE event_type WHEN 'view' THEN 'Loading raster' WHEN 'click' THEN 'Feature extraction'
              WHEN 'purchase' THEN 'KMeans clustering' WHEN 'signup' THEN 'Pixel assignment' ELSE 'Saving output' END AS phase,
            CAST(floor(value) AS BIGINT) % 100 AS done, 100 AS total FROM events""",
}


def sql(deps: str, body: str, **extra: str) -> str:
    """A statement over the named shared CTEs, then the given ones, in order."""
    parts = [f"{d} AS ({CTES[d]})" for d in deps.split()] + [f"{n} AS ({t})" for n, t in extra.items()]
    return (f"WITH RECURSIVE {', '.join(parts)} " if parts else "") + body


def mirror(value: str, size: str) -> str:
    """In-image coordinate of a mirrored one (edge pixel repeated)."""
    m = f"(((({value}) % (2*{size})) + 2*{size}) % (2*{size}))"
    return f"(CASE WHEN {m} < {size} THEN {m} ELSE 2*{size} - 1 - {m} END)"


def mirror101(value: str, size: str) -> str:
    period = f"greatest(1, 2*({size}-1))"
    m = f"(((({value}) % {period}) + {period}) % {period})"
    return f"least({m}, {period} - {m})"


def around(k: int, name: str) -> str:
    return f"(SELECT unnest(range(-{k}, {k + 1})) AS {name})"


def box(src: str, sums: dict[str, str], size: int, where: str = "true") -> str:
    """Box sums with mirrored borders, as a direct self-join over all offsets."""
    k = size // 2
    aggs = ", ".join(f"sum({e}) AS {n}" for n, e in sums.items())
    return f"""SELECT p.raster_id, p.row, p.col, {aggs}
        FROM {src} p, {around(k, 'dy')}, {around(k, 'dx')}
        JOIN {src} q ON q.raster_id = p.raster_id AND q.row = {mirror('p.row + dy', 'p.height')}
             AND q.col = {mirror('p.col + dx', 'p.width')}
        WHERE {where} GROUP BY p.raster_id, p.row, p.col"""


def box2(src: str, sums: dict[str, str], size: int) -> str:
    """The same for large boxes: columns first, then rows."""
    k = size // 2
    first = ", ".join(f"sum({e}) AS {n}" for n, e in sums.items())
    second = ", ".join(f"sum(q.{n}) AS {n}" for n in sums)
    return f"""SELECT p.raster_id, p.row, p.col, {second}
        FROM {src} p, {around(k, 'dy')} JOIN (
            SELECT p.raster_id, p.row, p.col, {first} FROM {src} p, {around(k, 'dx')}
            JOIN {src} q ON q.raster_id = p.raster_id AND q.row = p.row AND q.col = {mirror('p.col + dx', 'p.width')}
            GROUP BY p.raster_id, p.row, p.col) q
          ON q.raster_id = p.raster_id AND q.col = p.col AND q.row = {mirror('p.row + dy', 'p.height')}
        GROUP BY p.raster_id, p.row, p.col"""


def offsets(widths: dict[int, int]) -> str:
    """Footprint cells as a VALUES table t(dy, dx)."""
    cells = [(dy, dx) for dy, w in widths.items() for dx in range(-w, w + 1)]
    return "(VALUES " + ", ".join(f"({dy},{dx})" for dy, dx in cells) + ") AS t(dy, dx)"


def dilate(mask: str, widths: dict[int, int], dims: str = "dims", keys: str = "raster_id") -> str:
    """Cells within the footprint of a mask cell, inside the image."""
    return f"""SELECT DISTINCT {', '.join('m.' + k for k in keys.split())}, m.row + dy AS row, m.col + dx AS col
        FROM {mask} m JOIN {dims} d USING (raster_id), {offsets(widths)}
        WHERE m.row + dy BETWEEN 0 AND height - 1 AND m.col + dx BETWEEN 0 AND width - 1"""


def erode(mask: str, widths: dict[int, int], outside: bool, dims: str = "dims") -> str:
    """Cells whose whole footprint is in the mask; ``outside`` says what lies beyond the image."""
    n = sum(2 * w + 1 for w in widths.values())
    beyond = (
        "count(*) FILTER (WHERE m.row + dy NOT BETWEEN 0 AND height - 1 OR m.col + dx NOT BETWEEN 0 AND width - 1)"
        if outside else "0"
    )
    return f"""SELECT m.raster_id, m.row, m.col FROM {mask} m JOIN {dims} d USING (raster_id), {offsets(widths)}
        LEFT JOIN {mask} q ON q.raster_id = m.raster_id AND q.row = m.row + dy AND q.col = m.col + dx
        GROUP BY m.raster_id, m.row, m.col HAVING count(q.row) + {beyond} = {n}"""


def components(mask: str, conn: int = 4, extra: str = "") -> dict[str, str]:
    """CTEs (recursive closure over row runs) that end in <mask>_cc(raster_id, row, col, comp, crow, ccol)."""
    keys = "raster_id" + (", " + extra if extra else "")
    same = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    reach = 0 if conn == 4 else 1
    ks = ", ".join(f"a.{k}" for k in keys.split(", "))
    return {
        f"{mask}_runs": f"""SELECT {keys}, row, min(col) AS c0, max(col) AS c1, row * 100000 + min(col) AS id FROM (
            SELECT *, col - row_number() OVER (PARTITION BY {keys}, row ORDER BY col) AS grp FROM {mask})
            GROUP BY {keys}, row, grp""",
        f"{mask}_edges": f"""SELECT {ks}, a.id AS u, b.id AS v FROM {mask}_runs a JOIN {mask}_runs b
            ON {same} AND abs(a.row - b.row) = 1 AND a.c0 <= b.c1 + {reach} AND b.c0 <= a.c1 + {reach}""",
        f"{mask}_reach": f"""SELECT {keys}, id, id AS seen FROM {mask}_runs UNION
            SELECT {ks}, a.id, b.v FROM {mask}_reach a JOIN {mask}_edges b ON {same} AND a.seen = b.u""",
        f"{mask}_lab": f"SELECT {keys}, id, min(seen) AS comp FROM {mask}_reach GROUP BY {keys}, id",
        f"{mask}_cc": f"""SELECT {ks}, a.row, unnest(range(a.c0, a.c1 + 1)) AS col, b.comp
            FROM {mask}_runs a JOIN {mask}_lab b ON {same} AND a.id = b.id""",
    }


def boxes(mask: str, extra: str = "") -> str:
    """Area and bounding box of the components of ``components(mask)``."""
    keys = "raster_id" + (", " + extra if extra else "")
    return f"""SELECT {keys}, comp, count(*) AS area, max(row) - min(row) + 1 AS bh, max(col) - min(col) + 1 AS bw,
        min(row) AS r0, max(row) AS r1, min(col) AS c0, max(col) AS c1
        FROM {mask}_cc GROUP BY {keys}, comp"""


def diamond(r: int) -> dict[int, int]:
    return {dy: r - abs(dy) for dy in range(-r, r + 1)}


def names_in(names) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"
