"""Distributed ranks and quantiles against numpy, with heavy values and heavy groups."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from agropanel.operators import metrics, ranks


def sample(seed=1, n=3000):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        group = "hot" if rng.random() < 0.6 else rng.choice(["a", "b", "c", None])
        value = 5.0 if rng.random() < 0.4 else round(rng.gauss(0, 10), 2)
        rows.append((group, None if rng.random() < 0.05 else value))
    rows.append(("single", 1.25))
    return rows


@pytest.mark.parametrize("pieces", [4, 37])
def test_grouped_quantiles(spark, pieces):
    rows = sample()
    df = spark.createDataFrame(rows, "g string, v double")
    probabilities = [0.0, 0.02, 0.05, 0.5, 0.95, 1.0]
    got = {(r.g, r.p): r.quantile for r in ranks.exact_quantiles(df, "v", probabilities, ["g"], pieces).collect()}
    groups = {}
    for g, v in rows:
        if v is not None:
            groups.setdefault(g, []).append(v)
    assert len(got) == len(groups) * len(probabilities)
    for g, values in groups.items():
        for p in probabilities:
            assert got[g, p] == pytest.approx(np.quantile(values, p), abs=1e-9), (g, p)


def test_global_quantiles(spark):
    values = [v for _, v in sample(2) if v is not None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = {r.p: r.quantile for r in ranks.exact_quantiles(df, "v", [0.2, 0.4, 0.6, 0.8]).collect()}
    for p, q in got.items():
        assert q == pytest.approx(np.quantile(values, p))


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([], "v double")
    assert ranks.exact_quantiles(df, "v", [0.5]).count() == 0


def test_dense_numbers(spark):
    keys = sorted({(f"s{i % 7}", f"d{i:04d}") for i in range(900)})
    shuffled = keys[:]
    random.Random(3).shuffle(shuffled)
    df = spark.createDataFrame(shuffled, "state string, district string").repartition(5)
    got = {(r.state, r.district): r["rank"] for r in ranks.dense_numbers(df, ["state", "district"], pieces=16).collect()}
    assert got == {k: i + 1 for i, k in enumerate(keys)}


def test_ranges_are_balanced(spark):
    df = spark.range(20000).select((F.col("id") % 3 == 0).cast("string").alias("g"), F.col("id").cast("double").alias("v"))
    counted, spans = ranks._cumulative(df, ["g"], "v", 16)
    sizes = [r["_range_n"] for r in spans.collect()]
    assert sum(sizes) == 20000 and max(sizes) < 4 * 20000 / 16


def test_quantile_buckets_keep_ties_together(spark):
    import pandas as pd

    values = [1.0] * 30 + [2.0] * 5 + [float(i) for i in range(3, 40)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = {r.v: r.bucket for r in metrics.quantile_bucket(df, "v").distinct().collect()}
    edges = np.quantile(values, [0.2, 0.4, 0.6, 0.8])
    want = {v: metrics.QUINTILES[int((edges < v).sum())] for v in values}
    assert got == want
    spread = [float(i) for i in range(100)]
    cut = pd.qcut(pd.Series(spread), 5, labels=list(metrics.QUINTILES))
    frame = spark.createDataFrame([(v,) for v in spread], "v double")
    got = {r.v: r.bucket for r in metrics.quantile_bucket(frame, "v").collect()}
    assert [got[v] for v in spread] == list(cut)


def test_histogram_against_numpy(spark):
    values = [v for _, v in sample(5) if v is not None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = {r.bin: r.n for r in metrics.histogram(df, "v").collect()}
    counts, _ = np.histogram(values, bins=30)
    assert sum(got.values()) == len(values)
    assert sum(abs(got.get(i + 1, 0) - int(c)) for i, c in enumerate(counts)) <= 4  # values on an inner edge


def test_histogram_of_equal_values(spark):
    df = spark.createDataFrame([(2.0,)] * 4, "v double")
    assert [(r.bin, r.n) for r in metrics.histogram(df, "v").collect()] == [(1, 4)]


def test_narrow_quantiles_are_exact_and_move_few_values(spark, monkeypatch):
    """Groups of distinct, repeated, few, null and infinite values; only the values in a bracket are counted."""
    rows = [("wide", float(x * 7919 % 20011)) for x in range(20000)] + [("same", 3.0)] * 3000 + [("few", 1.0), ("few", 2.0), ("none", None)]
    rows += [(None, float(x)) for x in range(10)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    counted = []
    whole = ranks._cumulative

    def watched(*given):
        found = whole(*given)
        counted.append(found[0].count())
        return found

    monkeypatch.setattr(ranks, "_cumulative", watched)
    named = {"low": 0.02, "mid": 0.5, "all": 1.0}
    got = {r["g"]: (r["low"], r["mid"], r["all"]) for r in ranks.narrow_quantiles(df, "v", named, ["g"]).collect()}
    for g in ("wide", "same", "few", None):
        values = [v for k, v in rows if k == g]
        assert got[g] == pytest.approx(tuple(np.quantile(values, p) for p in named.values()))
    assert "none" not in got
    assert len(counted) == 1 and counted[0] < 3000
    odd = spark.createDataFrame([(float("-inf"),), (float("-inf"),), (1.0,)], "v double")
    assert str(ranks.narrow_quantiles(odd, "v", {"m": 0.5}).first()["m"]) == str(ranks.wide_quantiles(odd, "v", {"m": 0.5}).first()["m"])
    assert len(counted) == 4
    assert ranks.narrow_quantiles(df.where("false"), "v", {"m": 0.5}).count() == ranks.wide_quantiles(df.where("false"), "v", {"m": 0.5}).count()
