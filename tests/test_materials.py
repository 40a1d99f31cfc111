import pytest
from pyspark.sql import functions as F

from groundweave.functions import palette as pal, rules
from groundweave.operators import materials as mt, sampling as sp
from groundweave.session import each_of, where_once

ZERO = {s: 0.0 for s in mt.SCORES}


def rails(spark, rows):
    """Material after the guard rails for (material, rgb, scores) rows."""
    data = [(0, i + 1, m, *rgb, *[float({**ZERO, **s}[n]) for n in mt.SCORES]) for i, (m, rgb, s) in enumerate(rows)]
    schema = "model_id INT, cluster INT, material STRING, r INT, g INT, b INT, " + ", ".join(f"{n} DOUBLE" for n in mt.SCORES)
    out = mt.guardrails(spark.createDataFrame(data, schema), pal.preset_classes(spark))
    return [r.material for r in out.orderBy("cluster").collect()]


def test_each_guardrail(spark):
    dark, light = (45, 45, 48), (180, 180, 180)
    cases = [
        ("BM_WATER", dark, {"road": 0.40, "water_conf": 0.9}, "BM_ASPHALT"),
        ("BM_WATER", light, {"asphalt": 0.38, "veg": 0.9, "grass": 0.9}, "BM_CONCRETE"),
        ("BM_SOIL", dark, {"water_conf": 0.28}, "BM_WATER"),
        ("BM_FOLIAGE", (101, 67, 33), {"dry": 0.60, "veg": 0.21}, "BM_SOIL"),
        ("BM_LAND_DRY_GRASS", dark, {"sand": 0.50, "dry": 0.3}, "BM_SAND"),
        ("BM_LAND_GRASS", dark, {"sand": 0.45}, "BM_SAND"),
        ("BM_SAND", dark, {"grass": 0.25, "veg": 0.20}, "BM_LAND_GRASS"),
        ("BM_SAND", dark, {"veg": 0.30, "dry": 0.2, "sand": 0.1}, "BM_LAND_DRY_GRASS"),
        ("BM_WATER", (101, 67, 33), {}, "BM_SOIL"),
        ("BM_VEGETATION", dark, {"line": 0.55}, "BM_ASPHALT"),
        ("BM_ASPHALT", (34, 139, 34), {"veg": 0.35, "grass": 0.12}, "BM_VEGETATION"),
        ("BM_SAND", dark, {"asphalt": 0.35, "dark_gray": 0.25, "sand": 0.39}, "BM_ASPHALT"),
        ("BM_ASPHALT", dark, {"sand": 0.50, "asphalt": 0.24}, "BM_SAND"),
        ("BM_VEGETATION", dark, {"water_conf": 0.30}, "BM_WATER"),
        ("BM_ROCK", dark, {"water_conf": 0.9, "road": 0.9}, "BM_ROCK"),
    ]
    assert rails(spark, [c[:3] for c in cases]) == [c[3] for c in cases]


def test_rule_table_is_complete():
    chains = rules.RULES
    assert {m for names, _ in chains for m in names} <= set(rules.ALL)
    assert sum(len(t) for _, t in chains) >= 164
    assert [d for names, t in chains if names == rules.SETS["metals"] for _, d, _ in t] == [2.5]


def test_missing_classes_are_never_assigned(spark):
    few = pal.preset_classes(spark).where("name IN ('BM_ASPHALT', 'BM_SOIL', 'BM_VEGETATION')")
    data = [(0, i, 10 * i, 40 * i, 5 * i, 10 + i, *[0.3] * 15) for i in range(1, 6)]
    c = spark.createDataFrame(data, "model_id INT, cluster INT, r INT, g INT, b INT, pixels INT, " + ", ".join(f"{n} DOUBLE" for n in mt.SCORES))
    got = {r.material for r in mt.map_clusters(c, few).collect()}
    assert got and got <= {"BM_ASPHALT", "BM_SOIL", "BM_VEGETATION"}


def test_diversity_steals_from_repeated_materials(spark):
    # Four clusters, all cheapest in material 1; two distinct materials are wanted.
    costs = [(0, c, m, f"M{m}", (0.0 if m == 1 else 1.0 + c * (m == 2))) for c in (1, 2, 3, 4) for m in (1, 2, 3, 4)]
    df = spark.createDataFrame(costs, "model_id INT, cluster INT, material_idx INT, material STRING, cost DOUBLE")
    got = {r.cluster: r.material for r in mt.enforce_diversity(df).collect()}
    assert got == {1: "M2", 2: "M1", 3: "M1", 4: "M1"}


def test_palette_tail_variants(spark):
    df = spark.range(28, 34).withColumnRenamed("id", "i")
    cli, form, web = (["x"] * 0 + [r[0] for r in df.select(pal.palette_color("i", v)).collect()] for v in ("cli", "form", "web"))
    assert cli[0] == "#FF7F50" and form[0] == "#FF00FF" and cli[2] == form[2] and len(web[2]) == 7


def test_open_weight_is_clipped(spark):
    df = spark.createDataFrame([(0, 0.1, 0.9, 0.1), (1, 0.5, 0.5, 0.5)], "k INT, s1 DOUBLE, s2 DOUBLE, s3 DOUBLE")
    got = {r.k: r.open_weight for r in mt.open_fractions(df, ["k"]).collect()}
    assert got == {0: 1.0, 1: 0.0}


def test_first_by_hash_is_exact_per_key(spark):
    df = spark.range(5000).selectExpr("id", "CASE WHEN id < 4500 THEN 0 ELSE 1 END AS k")
    got = sp.first_by_hash(df, ["k"], "md5(cast(id AS string))", 100)
    import hashlib
    for k, ids in ((0, range(4500)), (1, range(4500, 5000))):
        want = sorted(ids, key=lambda i: hashlib.md5(str(i).encode()).hexdigest())[:100]
        assert {r.id for r in got.where(f"k = {k}").collect()} == set(want)


def test_each_of_rejects_large_tables(spark):
    with pytest.raises(ValueError):
        each_of(spark.range(2), spark.range(100))


def test_where_once_equals_where(spark):
    df = spark.range(50).withColumn("h", F.expr("id * 3 % 7"))
    cond = "h > 2 AND h < 6"
    assert where_once(df, ["h"], cond).count() == df.where(cond).count()


def test_clusters_of_one_file_are_dealt_by_model(spark, monkeypatch):
    monkeypatch.setattr(mt, "CLUSTERS", 4, raising=False)
    rows = [(m, c, 40 * c, 200 - 9 * m, 30 * m, 10 * c) for m in range(10) for c in (1, 2)] + [(None, 1, 1, 1, 1, 1)]
    given = spark.createDataFrame(rows, "model_id LONG, cluster INT, r INT, g INT, b INT, pixels LONG").coalesce(1)
    pairs = mt.with_materials(given, pal.preset_classes(spark))
    assert pairs.rdd.getNumPartitions() == 6  # 21 rows
    blended = mt.prevalence_blend(mt.colour_cost(pairs))
    assert blended.count() == 20 * 13
    assert {(r.model_id, r.cluster): r.freq for r in blended.select("model_id", "cluster", "freq").distinct().collect()} == {(m, c): c / 3 for m in range(10) for c in (1, 2)}
    plan = mt.cluster_material(blended)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1, plan
