"""Registered queries against their SQL at the smallest scale.

The quick ones always run; GROUNDWEAVE_FULL=1 runs all of them.
"""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_module

QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()
QUICK = """gray ndvi colour_indices texture_std edge_mask tile_windows rw_windows pad_pow2_dims raster_info output_names geom_tile_join
    scaler_stats assign_nearest recommend_k representative_rasters colour_cost semantic_penalty guardrails greedy_colours palette_n
    mask_open mask_close component_metrics rasterize_polygons auto_colours fill_holes merge_feature_masks progress_rollup stage_table""".split()
NAMES = sorted(ORACLES) if os.environ.get("GROUNDWEAVE_FULL") else QUICK


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    rel = duck.execute(ORACLES[name])
    cols = [d[0] for d in rel.description]
    assert sorted(cols) == sorted(df.columns)
    clean = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else v
    got = sorted(tuple(str(clean(r[c])) for c in cols) for r in df.collect())
    assert got == sorted(tuple(str(clean(v)) for v in r) for r in rel.fetchall())


def test_entry_is_stable(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["raster_id", "material", "material_type", "pixels", "square_m"] and df.count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 130
