"""Percentiles of continuous values against numpy."""

import numpy as np
import pytest

from groundweave.functions.stats import percentile

rng = np.random.default_rng(3)
CASES = {
    "uniform": rng.uniform(-5, 5, 5000), "equal and one outlier": np.append(np.full(4000, 2.5), 1e300), "one": [7.25], "two": [1.0, 2.0],
    "powers": 10.0 ** rng.uniform(-200, 200, 2000), "few values": rng.integers(0, 4, 3000) / 3, "both ends": [-1.7e308, 1.7e308, 0.0, 1.0], "tiny": np.arange(300) * 5e-324,
}


@pytest.mark.parametrize("small, p", [(1, 0.95), (50, 0.5), (16_384, 1.0), (16_384, 0.0)])
def test_against_numpy(spark, small, p):
    rows = [(name, float(v)) for name, vs in CASES.items() for v in vs] + [("none", None), ("none", float("nan")), ("uniform", None), ("one", float("inf"))]
    df = spark.createDataFrame(rows, "name STRING, v DOUBLE")
    got = {r["name"]: r["q"] for r in percentile(df, ["name"], "v", p, "q", small).collect()}
    assert set(got) == set(CASES)
    for name, vs in CASES.items():
        ordered = np.sort(np.array(vs))
        rank = (len(ordered) - 1) * p
        a, b = ordered[int(np.floor(rank))], ordered[int(np.ceil(rank))]
        want = a + (b - a) * (rank - np.floor(rank))
        assert got[name] == want or abs(got[name] - want) <= 1e-12 * abs(want), name


def test_without_keys_and_without_rows(spark):
    df = spark.createDataFrame([(float(i),) for i in range(101)], "v DOUBLE")
    assert percentile(df, [], "v", 0.95, "q", 5).first()["q"] == 95.0
    assert percentile(df.where("false"), [], "v", 0.95, "q").collect() == []
