import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphstream.operators import panels, quantiles, stability

AT = {"low": 0.0, "q05": 0.05, "median": 0.5, "q95": 0.95, "high": 1.0}


def check(df, rows, most):
    got = {r.g: r for r in quantiles.exact(df, ["g"], "v", AT, most).collect()}
    held = {}
    for g, v in rows:
        if v is not None and np.isfinite(v):
            held.setdefault(g, []).append(v)
    assert got.keys() == held.keys()
    for g, values in held.items():
        for name, p in AT.items():
            assert np.isclose(got[g][name], np.quantile(values, p), rtol=1e-12, atol=1e-300), (g, name)


@pytest.mark.parametrize("most", [3, 100_000])
def test_equal_to_plain_quantiles(spark, most):
    draw = random.Random(most)
    rows = [("even", float(i)) for i in range(3000)] + [("ties", float(draw.choice([1, 1, 1, 2, 5]))) for _ in range(3000)]
    rows += [("wide", draw.choice([-1, 1]) * 10 ** draw.uniform(-300, 300)) for _ in range(2000)] + [("one", 4.5), ("two", -1.0), ("two", 2.0), (None, 1.0), (None, 3.0)]
    rows += [("one", None), ("one", float("nan")), ("two", float("inf")), ("none", None), ("steps", 0.0)] + [("steps", float(10**9 + i % 3)) for i in range(400)]
    draw.shuffle(rows)
    check(spark.createDataFrame(rows, "g string, v double").repartition(5), rows, most)


def test_no_rows_and_no_groups(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 4.0)], "k int, v double")
    assert quantiles.exact(df.limit(0), ["k"], "v", AT).count() == 0
    (row,) = quantiles.exact(df, [], "v", {"m": 0.25}).collect()
    assert row.asDict() == {"m": 2.5}


def test_summaries_by_it(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("a", 3.0, None), (None, 5.0, 2.0)], "g string, x double, y double")
    got = {(r.g, r.metric): r for r in panels.summary_stats(df, ["g"], ["x", "y"]).collect()}
    assert got["a", "x"].median == 2.0 and got["a", "x"].q05 == 1.1 and got[None, "x"].q95 == 5.0
    assert got["a", "y"].n == 0 and got["a", "y"].median is None and got[None, "y"].median == 2.0
    (r,) = stability.interval(df.where("g = 'a'"), ["g"], "x").collect()
    assert (r.n, r.mean, r.low, r.high) == (2, 2.0, 1.05, 2.95) and np.isclose(r.width, 1.9)


def test_bootstrap_draws_of_a_group_over_many_partitions(spark):
    df = spark.range(500).select(F.col("id"), F.when(F.col("id") < 450, "big").otherwise("small").alias("g")).repartition(7)
    got = stability.bootstrap_rows(df, "g", "id", 3, 100, 5)
    n = {(r.g, r.replicate): r.n for r in got.groupBy("g", "replicate").agg(F.count("*").alias("n")).collect()}
    assert n == {("big", i): 100 for i in (1, 2, 3)} | {("small", i): 50 for i in (1, 2, 3)}
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, stability.bootstrap_rows(df.coalesce(1), "g", "id", 3, 100, 5).select(got.columns).collect()))
