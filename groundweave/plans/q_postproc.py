"""Queries over label clean-up, morphology, components and areas."""

from pyspark.sql import functions as F

from ..functions import palette as pal
from ..operators import focal, postproc as pp, runs as rn
from ..oracle.base import around, box, box2, boxes, components, diamond, dilate, erode, names_in, sql
from ..session import bounded
from .fixtures import classes, dims, labels13, labelled, raster_meta, scene, sized
from .registry import query

PX = "raster_id:i row:i col:i "
LAB = "scene dims px classes labels13 lab"
_idx = {n: i for i, (n, _, _) in enumerate(pal.PRESET, start=1)}


def _ids(names):
    return "(" + ", ".join(str(_idx[n]) for n in sorted(names, key=_idx.get)) + ")"


BLD, ROAD = _ids(pal.BUILDING_NAMES), _ids(pal.ROAD_NAMES)
PROT = _ids([n for n in _idx if any(w in n for w in pal.PROTECTED_WORDS)])
BR = "((b1 + b2 + b3) / 3.0::DOUBLE)"
SAT = "((greatest(b1, b2, b3) - least(b1, b2, b3)) / (greatest(b1, b2, b3) + 1e-6))"
STRUCT = f"({BR} > 150 OR (b4 - b3) / (b4 + b3 + 1e-6) > 0.3)"


def lab(spark, sf):
    return sized(labelled(spark, sf))


def circle(r):
    return {dy: w for dy, w in focal.disk_widths(r).items()}


@query("smooth_median", PX + "m1:i m3:i", sql("scene dims classes labels13", """SELECT a.raster_id, a.row, a.col, a.m AS m1, b.m AS m3 FROM
    (SELECT p.raster_id, p.row, p.col, list_sort(list(q.label))[count(*) // 2 + 1] AS m FROM labels13 p, d1 JOIN labels13 q ON q.raster_id = p.raster_id AND q.row = p.row + dy AND q.col = p.col + dx GROUP BY ALL) a JOIN
    (SELECT p.raster_id, p.row, p.col, list_sort(list(q.label))[count(*) // 2 + 1] AS m FROM labels13 p, d3 JOIN labels13 q ON q.raster_id = p.raster_id AND q.row = p.row + dy AND q.col = p.col + dx GROUP BY ALL) b
    USING (raster_id, row, col)""",
    d1=f"SELECT * FROM {around(1, 'dy')}, {around(1, 'dx')} WHERE dy*dy + dx*dx <= 1", d3=f"SELECT * FROM {around(3, 'dy')}, {around(3, 'dx')} WHERE dy*dy + dx*dx <= 9"))
def smooth_median(spark, sf):
    px = lab(spark, sf)
    return pp.smooth(px, "median_1").withColumnRenamed("label", "m1").join(pp.smooth(px, "median_3").withColumnRenamed("label", "m3"), ["raster_id", "row", "col"])


@query("structure_mask", PX + "structure:b", sql("scene", f"SELECT raster_id, row, col, {STRUCT} AS structure FROM scene"))
def structure_mask(spark, sf):
    return scene(spark, sf).selectExpr("raster_id", "row", "col", f"{pp.STRUCTURE} AS structure")


def _fix(b):
    gain = f"least(4, greatest(0.5::DOUBLE, (m_{b} / 3721.0::DOUBLE) / greatest(w / 3721.0::DOUBLE, 1e-6) / greatest({b}::DOUBLE, 0.01)))"
    return f"CASE WHEN shadow = 1 THEN floor(least(255, greatest(0, 0.8::DOUBLE * ({b} * {gain}) + {1.0 - 0.8!r}::DOUBLE * {b}))) ELSE {b} END AS {b}"


@query("shadow_balance", PX + "b1:i b2:i b3:i", sql("scene dims px", f"SELECT raster_id, row, col, {_fix('b1')}, {_fix('b2')}, b3 FROM fl JOIN wsum USING (raster_id, row, col)",
    local=box2("px", {"s": "q.b1 + q.b2 + q.b3"}, 61),
    dk=f"SELECT raster_id, row, col FROM px JOIN local USING (raster_id, row, col) WHERE {BR} < 0.62::DOUBLE * (s / (3 * 3721.0::DOUBLE)) AND {SAT} < 0.25 AND {BR} > 5",
    **components("dk"), big="SELECT raster_id, comp FROM dk_cc GROUP BY ALL HAVING count(*) >= 30",
    fl="SELECT px.*, CASE WHEN EXISTS (SELECT 1 FROM dk_cc d JOIN big USING (raster_id, comp) WHERE d.raster_id = px.raster_id AND d.row = px.row AND d.col = px.col) THEN 1 ELSE 0 END AS shadow FROM px",
    wsum=box2("fl", {"w": "1 - q.shadow", "m_b1": "(1 - q.shadow) * q.b1", "m_b2": "(1 - q.shadow) * q.b2"}, 61).replace("sum(q.w)", "sum(q.w)::DOUBLE")))
def shadow_balance(spark, sf):
    return pp.shadow_balance(sized(scene(spark, sf)), min_px=30)


_CTX = _ids(set(pal.BUILDING_NAMES + pal.ROAD_NAMES))
SHADOW = {
    "st": f"SELECT raster_id, row, col FROM lab WHERE {STRUCT}", "near": dilate("st", diamond(5)),
    "loc": box("lab", {"s": "q.b1 + q.b2 + q.b3"}, 11),
    "cand": f"""SELECT raster_id, row, col FROM lab JOIN loc USING (raster_id, row, col) JOIN near USING (raster_id, row, col)
        WHERE {BR} < least(100, s / 363.0::DOUBLE * 0.72::DOUBLE) AND {SAT} < 0.20 AND NOT {STRUCT} AND label <> 13""",
    **components("cand"), "cand_box": boxes("cand"),
    "small": "SELECT c.* FROM cand_cc c JOIN cand_box b USING (raster_id, comp) WHERE area BETWEEN 4 AND 160 AND greatest(bh, bw) <= 5 * least(bh, bw) AND area >= 0.20 * bh * bw",
    "ctxm": f"SELECT raster_id, row, col FROM lab WHERE label IN {_CTX}", "nearctx": dilate("ctxm", diamond(3)),
    "hits": """SELECT s.raster_id, s.comp FROM small s LEFT JOIN nearctx n USING (raster_id, row, col) GROUP BY ALL HAVING count(n.raster_id) >= 0.75 * count(*)""",
    "ins": "SELECT s.* FROM small s JOIN hits USING (raster_id, comp)", "grown": dilate("ins", diamond(2), keys="raster_id comp"),
    "shr": f"""SELECT g.raster_id, g.comp FROM grown g JOIN lab l USING (raster_id, row, col) WHERE l.label > 0 AND NOT EXISTS (SELECT 1 FROM ins i WHERE i.raster_id = g.raster_id AND i.comp = g.comp AND i.row = g.row AND i.col = g.col)
        GROUP BY ALL HAVING avg(CASE WHEN l.label IN {_CTX} THEN 1.0 ELSE 0 END) >= 0.5""",
    "sc": "SELECT c.raster_id, c.row, c.col FROM cand_cc c WHERE NOT EXISTS (SELECT 1 FROM shr s WHERE s.raster_id = c.raster_id AND s.comp = c.comp)",
}


@query("shadow_candidates", PX, sql(LAB, "SELECT * FROM sc", **SHADOW))
def shadow_candidates(spark, sf):
    return rn.pixels_of(pp.shadow_candidates(lab(spark, sf), classes(spark)))


def _nearest(targets, sources):
    """Brute-force nearest source of every target."""
    return f"""SELECT t.raster_id, t.row, t.col, arg_min(struct_pack(r := s.row, c := s.col), ((t.row-s.row)*(t.row-s.row) + (t.col-s.col)*(t.col-s.col)) * 10000000000 + s.row * 100000 + s.col) AS src
        FROM {targets} t JOIN {sources} s ON s.raster_id = t.raster_id GROUP BY t.raster_id, t.row, t.col"""


def _painted(base="lab"):
    return f"""SELECT l.raster_id, l.row, l.col, coalesce(s.label, l.label) AS label FROM {base} l LEFT JOIN nn n USING (raster_id, row, col)
        LEFT JOIN {base} s ON s.raster_id = n.raster_id AND s.row = n.src.r AND s.col = n.src.c"""


@query("shadow_infer", PX + "label:i", sql(LAB, _painted(), **SHADOW,
    src=f"SELECT raster_id, row, col FROM lab WHERE label > 0 AND label NOT IN {PROT} AND NOT EXISTS (SELECT 1 FROM sc WHERE sc.raster_id = lab.raster_id AND sc.row = lab.row AND sc.col = lab.col)",
    nn=_nearest("sc", "src")))
def shadow_infer(spark, sf):
    px = lab(spark, sf)
    return pp.shadow_infer(px, pp.shadow_candidates(px, classes(spark)), classes(spark))


@query("road_opening", PX + "label:i", sql(LAB, _painted(),
    rd=f"SELECT raster_id, row, col FROM lab WHERE label IN {ROAD} AND (SELECT count(*) FROM lab l2 WHERE l2.raster_id = lab.raster_id AND l2.label IN {ROAD}) >= 10",
    er=erode("rd", circle(2), True), op=dilate("er", circle(2)),
    rem="SELECT * FROM rd EXCEPT SELECT * FROM op", src=f"SELECT raster_id, row, col FROM lab WHERE label NOT IN {ROAD}", nn=_nearest("rem", "src")))
def road_opening(spark, sf):
    return pp.road_opening(lab(spark, sf), classes(spark))


GAPPED = {"gl": "SELECT * EXCLUDE (label), CASE WHEN row % 8 = 0 OR col % 11 = 0 THEN 0 ELSE label END AS label FROM lab"}


@query("absorb_patches", PX + "label:i", sql(LAB, _painted("gl"), **GAPPED, m="SELECT raster_id, row, col FROM gl WHERE label > 0", **components("m"),
    maj="""SELECT raster_id, comp, arg_min(label, -n * 100 + label) AS label FROM (SELECT c.raster_id, c.comp, g.label, count(*) AS n FROM m_cc c JOIN gl g USING (raster_id, row, col) GROUP BY ALL) GROUP BY ALL HAVING sum(n) <= 80""",
    gone=f"SELECT c.raster_id, c.row, c.col FROM m_cc c JOIN maj USING (raster_id, comp) WHERE label NOT IN {PROT}",
    src="SELECT raster_id, row, col FROM gl WHERE label > 0 AND NOT EXISTS (SELECT 1 FROM gone g WHERE g.raster_id = gl.raster_id AND g.row = gl.row AND g.col = gl.col)",
    nn=_nearest("gone", "src")))
def absorb_patches(spark, sf):
    px = lab(spark, sf).withColumn("label", F.expr("CASE WHEN row % 8 = 0 OR col % 11 = 0 THEN 0 ELSE label END"))
    return pp.absorb_small_patches(px, classes(spark))


def _cap_ctes(near_ids, reach, cond, shape, it, group, share, extra=None):
    return {
        "ctxm": f"SELECT raster_id, row, col FROM lab WHERE label IN {near_ids}", "near": dilate("ctxm", diamond(reach)),
        "loc": box("lab", {"s": "q.b1 + q.b2 + q.b3"}, 15), **(extra or {}),
        "cand": f"SELECT raster_id, row, col FROM (SELECT *, s / 675.0::DOUBLE AS mean FROM lab JOIN loc USING (raster_id, row, col) JOIN near USING (raster_id, row, col)) {'JOIN rm USING (raster_id)' if extra else ''} WHERE {cond}",
        **components("cand"), "cand_box": boxes("cand"),
        "ok": f"SELECT c.* FROM cand_cc c JOIN cand_box USING (raster_id, comp) WHERE {shape}",
        "grown": dilate("ok", diamond(it), keys="raster_id comp"),
        "rng": """SELECT g.raster_id, g.comp, l.label FROM grown g JOIN lab l USING (raster_id, row, col) WHERE l.label > 0
            AND NOT EXISTS (SELECT 1 FROM ok i WHERE i.raster_id = g.raster_id AND i.comp = g.comp AND i.row = g.row AND i.col = g.col)""",
        "tot": f"SELECT raster_id, comp FROM rng GROUP BY ALL HAVING avg(CASE WHEN label IN {group} THEN 1.0 ELSE 0 END) >= {share}",
        "dom": f"SELECT raster_id, comp, arg_min(label, -n * 100 + label) AS new FROM (SELECT raster_id, comp, label, count(*) AS n FROM rng WHERE label IN {group} GROUP BY ALL) GROUP BY ALL",
    }


_CAPPED = """SELECT l.raster_id, l.row, l.col, coalesce(p.new, l.label) AS label FROM lab l LEFT JOIN (
    SELECT o.raster_id, o.row, o.col, new FROM ok o JOIN tot USING (raster_id, comp) JOIN dom USING (raster_id, comp)) p USING (raster_id, row, col)"""


@query("cap_windows", PX + "label:i", sql(LAB, _CAPPED, **_cap_ctes(BLD, 4, f"{BR} < mean * 0.68::DOUBLE AND label NOT IN {BLD} AND label NOT IN {PROT}",
    "area BETWEEN 4 AND 150 AND greatest(bh, bw) <= 4.5 * least(bh, bw) AND area >= 0.25 * bh * bw", 2, BLD, 0.5)))
def cap_windows(spark, sf):
    return pp.cap_windows(lab(spark, sf), classes(spark))


@query("cap_road_features", PX + "label:i", sql(LAB, _CAPPED, **_cap_ctes(ROAD, 2,
    f"({BR} > road_mean * 1.30::DOUBLE OR (abs({BR} - mean) > mean * 0.22::DOUBLE AND label NOT IN {ROAD})) AND label NOT IN {PROT} AND label NOT IN {BLD}",
    "area BETWEEN 4 AND 250", 2, ROAD, 0.55, {"rm": f"SELECT raster_id, avg({BR}) AS road_mean FROM lab WHERE label IN {ROAD} GROUP BY raster_id"})))
def cap_road_features(spark, sf):
    return pp.cap_road_features(lab(spark, sf), classes(spark))


@query("cap_facades", PX + "label:i", sql(LAB, _CAPPED, **_cap_ctes(BLD, 4, f"{BR} < mean * 0.75::DOUBLE AND label NOT IN {_CTX} AND label NOT IN {PROT}",
    "area BETWEEN 8 AND 600 AND greatest(bh, bw) >= 1.8 * least(bh, bw)", 3, BLD, 0.45)))
def cap_facades(spark, sf):
    return pp.cap_facades(lab(spark, sf), classes(spark), min_px=8)


# Road queries join the two asphalt classes, so that cars lie inside one asphalt body.
MERGED = {"ml": "SELECT * EXCLUDE (label), CASE WHEN label = 8 THEN 1 ELSE label END AS label FROM lab"}


def merged(spark, sf):
    return lab(spark, sf).withColumn("label", F.expr("CASE WHEN label = 8 THEN 1 ELSE label END"))


ENCLOSE = {**MERGED,
    "obj": f"SELECT raster_id, row, col FROM ml WHERE label > 0 AND label NOT IN {ROAD} AND label NOT IN {PROT}", **components("obj"), "obj_box": boxes("obj"),
    "ok": "SELECT c.* FROM obj_cc c JOIN obj_box USING (raster_id, comp) WHERE area BETWEEN 2 AND 72",
    "grown": dilate("ok", diamond(3), keys="raster_id comp"),
    "rng": """SELECT g.raster_id, g.comp, g.row, g.col, l.label FROM grown g JOIN ml l USING (raster_id, row, col) WHERE l.label > 0
        AND NOT EXISTS (SELECT 1 FROM ok i WHERE i.raster_id = g.raster_id AND i.comp = g.comp AND i.row = g.row AND i.col = g.col)""",
    "enc": f"SELECT raster_id, comp FROM rng GROUP BY ALL HAVING avg(CASE WHEN label = 1 THEN 1.0 ELSE 0 END) >= 0.7 OR avg(CASE WHEN label IN {ROAD} THEN 1.0 ELSE 0 END) >= 0.85",
    "asp": """SELECT b.raster_id, b.comp AS object, m.row, m.col FROM enc JOIN obj_box b USING (raster_id, comp) JOIN ml m ON m.raster_id = b.raster_id
        AND m.label = 1 AND m.row BETWEEN r0 - 4 AND r1 + 4 AND m.col BETWEEN c0 - 4 AND c1 + 4""", **components("asp", 4, "object"),
    "tch": "SELECT a.raster_id, a.object AS comp FROM asp_cc a JOIN rng r ON r.raster_id = a.raster_id AND r.comp = a.object AND r.row = a.row AND r.col = a.col GROUP BY ALL HAVING count(DISTINCT a.comp) <= 2",
    "e1": """SELECT l.* EXCLUDE (label), CASE WHEN o.raster_id IS NOT NULL THEN 1 ELSE l.label END AS label FROM ml l LEFT JOIN
        (SELECT ok.raster_id, ok.row, ok.col FROM ok JOIN tch USING (raster_id, comp)) o USING (raster_id, row, col)"""}


def _infill(base):
    return {"am": f"SELECT raster_id, row, col FROM {base} WHERE label = 1", "amd": dilate("am", diamond(2)), "amc": erode("amd", diamond(2), False),
        "fm": f"SELECT c.* FROM amc c JOIN {base} l USING (raster_id, row, col) WHERE l.label <> 1 AND l.label NOT IN {PROT}", **components("fm"),
        "gap": "SELECT raster_id, comp FROM fm_cc GROUP BY ALL HAVING count(*) <= 6",
        "e2": f"""SELECT l.* EXCLUDE (label), CASE WHEN g.raster_id IS NOT NULL THEN 1 ELSE l.label END AS label FROM {base} l LEFT JOIN
        (SELECT f.raster_id, f.row, f.col FROM fm_cc f JOIN gap USING (raster_id, comp)) g USING (raster_id, row, col)"""}


@query("enclose_objects", PX + "label:i", sql(LAB, "SELECT raster_id, row, col, label FROM e1", **ENCLOSE))
def enclose_objects(spark, sf):
    return pp.enclose_objects(merged(spark, sf), classes(spark))


@query("infill_gaps", PX + "label:i", sql(LAB, "SELECT raster_id, row, col, label FROM e2", **MERGED, **_infill("ml")))
def infill_gaps(spark, sf):
    return pp.infill_gaps(merged(spark, sf), classes(spark))


@query("road_object_removal", PX + "label:i changed:b", sql(LAB, "SELECT e2.raster_id, e2.row, e2.col, e2.label, e2.label <> ml.label AS changed FROM e2 JOIN ml USING (raster_id, row, col)", **ENCLOSE, **_infill("e1")))
def road_object_removal(spark, sf):
    return pp.remove_road_objects(merged(spark, sf), classes(spark))


MASK = {"mask": "SELECT raster_id, row, col FROM lab WHERE label IN (1, 8) AND (row * 7 + col * 3) % 11 <> 0"}


def road_mask(spark, sf):
    px = lab(spark, sf)
    runs = rn.runs_of(px.where("label IN (1, 8) AND (row * 7 + col * 3) % 11 <> 0").select("raster_id", "row", "col"))
    return runs, pp.raster_dims(px)


@query("mask_dilate", PX, sql(LAB, "SELECT * FROM m2", **MASK, m2=dilate("mask", circle(2))))
def mask_dilate(spark, sf):
    runs, d = road_mask(spark, sf)
    return rn.pixels_of(rn.dilate(runs, rn.disk(2), d))


@query("mask_erode", PX + "outside:b", sql(LAB, "SELECT *, true AS outside FROM m2 UNION ALL SELECT *, false FROM m3", **MASK, m2=erode("mask", circle(1), True), m3=erode("mask", circle(1), False)))
def mask_erode(spark, sf):
    runs, d = road_mask(spark, sf)
    part = lambda o: rn.pixels_of(rn.erode(runs, rn.disk(1), d, outside=o)).withColumn("outside", F.lit(o))
    return part(True).unionByName(part(False))


@query("mask_open", PX, sql(LAB, "SELECT * FROM m3", **MASK, m2=erode("mask", circle(1), True), m3=dilate("m2", circle(1))))
def mask_open(spark, sf):
    runs, d = road_mask(spark, sf)
    return rn.pixels_of(rn.opening(runs, rn.disk(1), d))


@query("mask_close", PX, sql(LAB, "SELECT * FROM m3", **MASK, m2=dilate("mask", diamond(2)), m3=erode("m2", diamond(2), False)))
def mask_close(spark, sf):
    runs, d = road_mask(spark, sf)
    return rn.pixels_of(rn.closing(runs, rn.diamond(2), d, outside=False))


CC = {**MASK, **components("mask"), "mask_box": boxes("mask")}
_COMP = "(comp // 100000) * 2147483648 + comp % 100000 AS comp"


@query("connected_components", PX + "comp:l", sql(LAB, f"SELECT raster_id, row, col, {_COMP} FROM mask_cc", **CC))
def connected_components(spark, sf):
    runs, _ = road_mask(spark, sf)
    return rn.pixels_of(rn.components(runs, tile=32))


@query("component_metrics", "raster_id:i comp:l area:l bh:i bw:i aspect:d6 fill:d6", sql(LAB, f"""SELECT raster_id, {_COMP}, area, bh, bw,
    greatest(bh, bw)::DOUBLE / least(bh, bw) AS aspect, area::DOUBLE / (bh * bw) AS fill FROM mask_box""", **CC))
def component_metrics(spark, sf):
    runs, _ = road_mask(spark, sf)
    return rn.metrics(rn.components(runs))


@query("ring_stats", "raster_id:i comp:l label:i n:l", sql(LAB, f"""SELECT raster_id, {_COMP}, label, n FROM (SELECT g.raster_id, g.comp, l.label, count(*) AS n FROM grown g JOIN lab l USING (raster_id, row, col)
    WHERE l.label > 0 AND NOT EXISTS (SELECT 1 FROM mask_cc i WHERE i.raster_id = g.raster_id AND i.comp = g.comp AND i.row = g.row AND i.col = g.col) GROUP BY ALL)""",
    **CC, grown=dilate("mask_cc", diamond(2), keys="raster_id comp")))
def ring_stats(spark, sf):
    runs, d = road_mask(spark, sf)
    return rn.ring_stats(rn.components(runs), lab(spark, sf), 2, d)


@query("nearest_source", PX + "src_row:i src_col:i", sql(LAB, "SELECT raster_id, row, col, src.r AS src_row, src.c AS src_col FROM nn",
    t="SELECT raster_id, row, col FROM lab WHERE label = 13", s="SELECT raster_id, row, col FROM lab WHERE label IN (2, 10)", nn=_nearest("t", "s")))
def nearest_source(spark, sf):
    px = lab(spark, sf)
    return rn.nearest_source(px.where("label = 13").select("raster_id", "row", "col"), px, "label IN (2, 10)")


# --- flagship ------------------------------------------------------------------------

AREA_CTES = {"mean3": box("px", {"m1": "q.b1", "m2": "q.b2", "m3": "q.b3"}, 3),
    "al": """SELECT raster_id, row, col, arg_min(class_idx, struct_pack(d := (m1/9-r)*(m1/9-r) + (m2/9-g)*(m2/9-g) + (m3/9-b)*(m3/9-b), i := class_idx)) AS label
        FROM mean3, classes GROUP BY raster_id, row, col"""}


@query("material_area", "raster_id:i material:s material_type:s pixels:l square_m:d6", sql("scene dims px classes",
    "SELECT raster_id, name AS material, material_type, count(*) AS pixels, count(*) * 0.25 AS square_m FROM al JOIN classes ON class_idx = label GROUP BY ALL", **AREA_CTES))
def material_area(spark, sf):
    from ..operators.clustering import assign_nearest
    from ..operators.features import spectral_mean
    rgb = [list(map(float, r[4:7])) for r in pal.preset_rows()]
    means = spectral_mean(sized(scene(spark, sf)), ["b1", "b2", "b3"])
    labels = assign_nearest(means, ["mean_b1", "mean_b2", "mean_b3"], rgb)
    return pp.material_area(labels, classes(spark), raster_meta(spark, sf))
