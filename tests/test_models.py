"""Models, attribution, scenarios and raster means."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from agropanel.functions import seasons as S
from agropanel.operators import explain, metrics, models, scenario, zonal

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(4)
    rows = []
    for year in range(2000, 2008):
        for _ in range(40):
            a, b, c = rng.gauss(0, 3), rng.gauss(5, 1), rng.random()
            rows.append((year, a, None if rng.random() < 0.1 else b, c, 3 * a - 2 * b + 10 * c + rng.gauss(0, 0.2)))
    return spark.createDataFrame(rows, "year int, a double, b double, c double, yield_kg_ha double").persist()


def test_ridge_is_the_closed_form(spark, table):
    train, test = table.where("year < 2006"), table.where("year >= 2006")
    scored = models.fit_ridge(train, FEATURES, 10.0).transform(test)
    got = np.array([r.pred for r in scored.orderBy("year", "a").collect()])
    x, y = np.array([[r.a, r.b, r.c] for r in train.collect()], dtype=float), np.array([r.yield_kg_ha for r in train.collect()])
    med = np.nanmedian(x, axis=0)
    x = np.where(np.isnan(x), med, x)
    mean, std = x.mean(0), x.std(0)
    z = (x - mean) / std
    w = np.linalg.solve(z.T @ z + 10.0 * np.eye(3), z.T @ (y - y.mean()))
    t = np.array([[r.a, r.b, r.c] for r in test.orderBy("year", "a").collect()], dtype=float)
    want = ((np.where(np.isnan(t), med, t) - mean) / std) @ w + y.mean()
    assert got == pytest.approx(want, rel=1e-6)


def brute_shapley(x, leaves, n):
    """Shapley values by all subsets; a feature outside the subset follows the training shares."""
    def value(subset):
        total = 0.0
        for v, _, path in leaves:
            reach = v
            for j, (low, high, share) in path.items():
                reach *= float(low < x[j] <= high) if j in subset else share
            total += reach
        return total

    out = []
    for i in range(n):
        rest = [j for j in range(n) if j != i]
        phi = 0.0
        for k in range(n):
            for s in itertools.combinations(rest, k):
                weight = math.factorial(k) * math.factorial(n - k - 1) / math.factorial(n)
                phi += weight * (value({*s, i}) - value(set(s)))
        out.append(phi)
    return out


def test_attribution_sums_to_the_prediction_and_is_shapley(spark, table):
    train, test = table.where("year < 2006"), table.where("year >= 2006")
    model = models.fit_trees(train, FEATURES, models.boosted(maxIter=4, maxDepth=3), indicators=True)
    assert len(model.prepared.names()) == 6
    scored = model.transform(test).select("year", "a", "features", "pred")
    rows = explain.attribute(scored, model.model, model.prepared.names()).collect()
    for r in rows:
        assert sum(r.attributions.values()) + r.base_value == pytest.approx(r.pred)
    leaves = explain.leaves_of(model.model)
    first = scored.first()
    x = np.array(first.features)
    assert explain.shapley(x[None, :], leaves)[0] == pytest.approx(brute_shapley(x, leaves, 6))


def test_attribution_of_a_forest(spark, table):
    model = models.fit_trees(table, FEATURES, models.forest(numTrees=3, maxDepth=3))
    scored = model.transform(table.limit(20)).select("features", "pred")
    for r in explain.attribute(scored, model.model, FEATURES, average=True).collect():
        assert sum(r.attributions.values()) + r.base_value == pytest.approx(r.pred)


def test_early_stopping_uses_the_validation_rows(spark, table):
    train, valid = table.where("year < 2006"), table.where("year >= 2006")
    model = models.fit_trees(train, FEATURES, models.boosted(maxIter=6, maxDepth=2), valid)
    assert 1 <= len(model.model.trees) <= 6


def test_band_by_group_and_without(spark):
    held = spark.createDataFrame([("x", float(i), 0.0) for i in range(101)], "g string, yield_kg_ha double, pred double")
    new = spark.createDataFrame([("x", 10.0), ("y", 10.0)], "g string, pred double")
    got = {r.g: (r.lower, r.upper) for r in models.conformal_band(new, held, ["g"]).collect()}
    assert got == {"x": (12.0, 108.0), "y": (None, None)}
    assert {(r.lower, r.upper) for r in models.conformal_band(new, held, lower_q=0.1, upper_q=0.9).collect()} == {(20.0, 100.0)}


def test_draws_are_distinct_and_repeatable():
    a = models.draw_settings(draws=40)
    assert a == models.draw_settings(draws=40) and len({str(x) for x in a}) == 40
    assert models.expanding_folds([2003, 2001, 2002, 2000], 2) == [(2002, 2002), (2003, 2003)]
    assert models.expanding_folds(range(1990, 2010), 5) == [(1995, 1997), (1998, 2000), (2001, 2003), (2004, 2006), (2007, 2009)]
    assert models.expanding_folds([2000, 2001], 5) == [(2001, 2001)] and models.expanding_folds([2000]) == []


def test_walk_forward_and_search(spark, table):
    folds = models.walk_forward(table, FEATURES, models.fit_ridge, min_train_years=5).collect()
    assert [(r.test_year, r.n_train, r.n_test) for r in folds] == [(2005, 200, 40), (2006, 240, 40), (2007, 280, 40)]
    found = models.search(table, FEATURES, [{"maxIter": 2, "maxDepth": 2}, {"maxIter": 2, "maxDepth": 1}], folds=1).collect()
    assert len(found) == 2 and found[0].rmse <= found[1].rmse


def test_model_tables(spark, table):
    one = models.headline(table.where("year < 2006"), table.where("year >= 2006"), FEATURES, models.fit_ridge, "ridge")
    both = models.comparison([one, one.withColumn("rmse", F.lit(0.0))]).collect()
    assert both[0].rmse == 0.0 and both[1].n_features == 3
    crops = table.withColumn("crop", F.when(F.col("a") > 0, "Wheat").otherwise("Rice")).withColumn("crop_encoded", F.lit(0))
    parts = models.per_crop(crops, crops, [*FEATURES, "crop_encoded"], ["Wheat", "Rice"], models.fit_ridge)
    assert metrics.weighted_mean(parts, ["rmse"]).first().rmse > 0
    scored = models.fit_ridge(table, FEATURES).transform(table)
    row = models.error_columns(scored).first()
    assert row.error == pytest.approx(row.yield_kg_ha - row.pred)
    assert models.change_columns(scored).first().change == pytest.approx(row.pred - row.yield_kg_ha)


def test_top_factors_and_group_share(spark):
    df = spark.createDataFrame([({"gdd_rabi": 1.0, "lag_yield_1": -9.0, "x": None, "area": 2.0},)], "attributions map<string,double>")
    top = df.select(explain.top_factors(k=2).alias("t")).first().t
    assert [(t.feature, t.value) for t in top] == [("lag_yield_1", -9.0), ("area", 2.0)]
    imp = metrics.importance(df.select(F.expr("map('gdd_rabi', 1D, 'lag', -3D) AS attributions")))
    assert {r.feature: r.pct_of_total for r in imp.collect()} == {"gdd_rabi": 25.0, "lag": 75.0}
    assert metrics.group_share(imp).first().pct == 25.0
    assert explain.long_form(df, []).count() == 4


# ---- scenarios ----

SCEN = "nasa_rainfall_rabi double, gdd_rabi double, heat_stress_days double, lag_yield_1 double, drought_flag int, flood_flag int, pred_yield double"


def linear(df):
    return df.withColumn("scenario_yield", F.col("nasa_rainfall_rabi") + F.col("gdd_rabi") + F.col("heat_stress_days"))


def test_no_change_reproduces_the_baseline(spark):
    df = spark.createDataFrame([(100.0, 10.0, 3.0, 7.0, 0, 1, 113.0)], SCEN)
    row = scenario.scenario_grid(df, df.columns[:4], [(0.0, 0.0)], linear).first()
    assert row.delta == 0 and (row.drought_flag, row.flood_flag) == (0, 1)


def test_changes_and_flags(spark):
    df = spark.createDataFrame([(100.0, 10.0, 3.0, 7.0, 0, 0, 113.0)], SCEN)
    got = {(r.rain_pct, r.temp_c): r for r in scenario.scenario_grid(df, df.columns[:4], [(-25.0, 2.0), (25.0, 0.0), (24.0, 0.0)], linear).collect()}
    dry = got[-25.0, 2.0]
    assert (dry.nasa_rainfall_rabi, dry.gdd_rabi, dry.heat_stress_days, dry.lag_yield_1) == (75.0, 12.0, 5.0, 7.0)
    assert dry.delta == -21.0 and (dry.drought_flag, dry.flood_flag) == (1, 0)
    assert got[25.0, 0.0].flood_flag == 1 and got[24.0, 0.0].flood_flag == 0


def test_daily_adjustments(spark):
    df = spark.sql("SELECT explode(sequence(DATE '2026-06-01', DATE '2026-06-10')) AS date").withColumns(
        {"rainfall_mm": F.lit(2.0), "temp_max_c": F.lit(30.0), "temp_min_c": F.lit(20.0), "temp_avg_c": F.lit(25.0)}
    )
    day = S.block_day("date")
    out = scenario.dry_spell(scenario.scale_rain(df, 50.0), day, 2, 3)
    out = scenario.heatwave(scenario.shift_temperature(out, 1.0), day, 8, 5, 4.0)
    row = out.agg(F.sum("rainfall_mm").alias("r"), F.max("temp_max_c").alias("x"), F.count_if(F.col("temp_avg_c") == 30).alias("n"),
                  F.max("temp_min_c").alias("m")).first()
    assert tuple(row) == (21.0, 35.0, 2, 21.0)


def test_bounds_and_sweep(spark):
    assert scenario.clamped("rain_scale_pct", 150.0) == (100.0, True) and scenario.clamped("temp_shift_c", 5.0) == (5.0, False)
    assert scenario.sweep(-10, 10, 3) == [-10, 0, 10]
    with pytest.raises(ValueError):
        scenario.sweep(0, 1, 42)
    inputs = spark.createDataFrame([(90.0, 10.0, 20.0)], "irrigation_pct double, nitrogen_per_ha double, fertilizer_per_ha double")
    assert tuple(scenario.shift_inputs(inputs, 20.0, -50.0).first()) == (100.0, 5.0, 10.0)


# ---- raster ----

def test_zonal_against_all_pairs(spark):
    rng = random.Random(8)
    sites = [("s", f"d{i}", rng.uniform(-60, 60), rng.uniform(-170, 170)) for i in range(15)]
    pixels = []
    for _, _, lat, lon in sites:
        for _ in range(40):
            pixels.append((lat + rng.uniform(-0.1, 0.1), lon + rng.uniform(-0.3, 0.3), "2001-07-01", rng.uniform(0, 10000)))
    ps = spark.createDataFrame(pixels, "lat double, lon double, date string, value double").withColumn("date", F.to_date("date"))
    ss = spark.createDataFrame(sites, "state string, district string, lat double, lon double")
    got = {r.district: r.ndvi_kharif for r in zonal.zonal_mean(ps, ss).collect()}

    def metres(a, b, c, d):
        a, b, c, d = map(math.radians, (a, b, c, d))
        h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
        return 2 * zonal.EARTH_M * math.asin(math.sqrt(h))

    want = {}
    for _, name, lat, lon in sites:
        inside = [v * 0.0001 for a, b, _, v in pixels if metres(lat, lon, a, b) <= 5000]
        if inside:
            want[name] = sum(inside) / len(inside)
    assert got == {k: pytest.approx(v) for k, v in want.items()} and len(want) > 8


def test_zonal_weights_pixels_equally_and_cuts_the_last_day(spark):
    ps = spark.createDataFrame(
        [(0.0, 0.0, "2001-07-01", 10.0), (0.0, 0.0, "2001-08-01", 20.0), (0.001, 0.0, "2001-07-01", 40.0),
         (0.0, 0.0, "2001-10-31", 900.0), (0.0, 0.0, "2002-01-05", 7.0), (0.0, 0.0, "2002-04-05", 7000.0)],
        "lat double, lon double, date string, value double",
    ).withColumn("date", F.to_date("date"))
    ss = spark.createDataFrame([("s", "d", 0.0, 0.0)], "state string, district string, lat double, lon double")
    row, = zonal.zonal_mean(ps, ss, scale=1.0).collect()
    assert (row.year, row.ndvi_kharif, row.ndvi_rabi) == (2001, 27.5, 7.0)


def test_water_share(spark):
    ps = spark.createDataFrame(
        [(0.0, 0.0, 2000, 3), (0.001, 0.0, 2000, 1), (0.002, 0.0, 2000, 2), (0.0, 0.001, 2000, 0), (0.0, 0.0, 2001, 2)],
        "lat double, lon double, year int, cls int",
    )
    ss = spark.createDataFrame([("s", "d", 0.0, 0.0)], "state string, district string, lat double, lon double")
    shares = zonal.zonal_share(ps, ss, F.col("cls") >= 2)
    assert {r.year: r.water_pct_rabi for r in shares.collect()} == {2000: 50.0, 2001: 100.0}
    assert zonal.latest_share(shares).first().current_water_pct_kharif == 100.0
