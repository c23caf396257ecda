"""Values at ranks against sorted lists."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberlane.operators import ranks

RANKS = {"lo": ranks.floor_rank(0.02), "q1": ranks.part_rank(1, 4), "q3": ranks.part_rank(3, 4), "last": lambda n: n - 1, "none": lambda n: n}


def groups():
    draw = np.random.default_rng(2)
    return {
        "one": [3.5],
        "two": [2.0, 1.0],
        "ties": [7.0] * 500 + [1.0],
        "skewed": [float(x) for x in np.round(np.exp(draw.normal(0, 6, 3000)), 6)],
        "plain": [float(x) for x in np.round(draw.normal(0, 1, 4000), 6)],
        "negative": [float(-x) for x in range(1000)],
    }


def rank(n, name):
    return {"lo": int(0.02 * (n - 1)), "q1": n // 4, "q3": 3 * n // 4, "last": n - 1, "none": n}[name]


@pytest.mark.parametrize("margin", [ranks.MARGIN, 0.0])
def test_ranks_equal_sorted_lists(spark, monkeypatch, margin):
    """With no margin brackets miss and have to be widened."""
    monkeypatch.setattr(ranks, "MARGIN", margin or 1e-9)
    rows = [(g, v) for g, values in groups().items() for v in values] + [("plain", None), ("empty", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r.g: r for r in ranks.at_ranks(df, ["g"], "v", RANKS).collect()}
    assert set(got) == set(groups())
    for g, values in groups().items():
        values = sorted(values)
        assert got[g].n == len(values)
        for name in RANKS:
            k = rank(len(values), name)
            assert got[g][name] == (values[k] if k < len(values) else None), (g, name)


def test_percentiles_on_the_line(spark):
    df = spark.createDataFrame([(g, v) for g, values in groups().items() for v in values], "g string, v double")
    for r in ranks.interpolated(df, ["g"], "v", {"a": 0.25, "b": 0.98}).collect():
        np.testing.assert_allclose([r.a, r.b], np.percentile(groups()[r.g], [25, 98]), rtol=1e-12)


def test_no_list_of_a_group_is_made(spark):
    df = spark.range(10_000).select(F.lit("g").alias("g"), F.rand(3).alias("v"))
    plan = ranks.at_ranks(df, ["g"], "v", {"m": ranks.floor_rank(0.5)})._jdf.queryExecution().toString()
    assert "collect_list" not in plan


def test_empty(spark):
    assert ranks.at_ranks(spark.createDataFrame([], "g string, v double"), ["g"], "v", RANKS).collect() == []
