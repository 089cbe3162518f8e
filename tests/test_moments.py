"""Windows of moments against fits of the same rows, and quantile models against exact quantiles."""

import numpy as np
import pytest
from agropanel.operators import models, moments, quantile
from agropanel.operators.panel import TARGET, median_map
from pyspark.sql import functions as F

FEATURES = ["a", "b", "c", "flat"]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    out = []
    for year in range(1990, 2004):
        for i in range(int(rng.integers(3, 40))):
            a, b = rng.normal(50, 9), rng.normal(3000, 700)
            c = float(rng.integers(0, 4))
            y = 900 + 12 * a - 0.3 * b + 60 * c + rng.normal(0, 30)
            out.append((year, "g" + str(i % 3), a if rng.random() > 0.2 else None, b if year > 1992 and rng.random() > 0.3 else None, c, 7.0, y if rng.random() > 0.05 else None))
    return out + [(None, "g0", 1.0, 1.0, 1.0, 7.0, 5.0), (1995, "g0", None, None, None, None, 1000.0)]


@pytest.fixture(scope="module")
def panel(spark, rows):
    return spark.createDataFrame(rows, f"year int, crop string, a double, b double, c double, flat double, {TARGET} double").cache()


def test_medians_of_every_window(panel, rows):
    found = {(r["feature"], r["before"]): r["median"] for r in moments.medians_before(panel, FEATURES, pieces=5).collect()}
    want = {}
    for at, name in ((2, "a"), (3, "b"), (4, "c"), (5, "flat")):
        for year in range(1991, 2004):
            known = [r[at] for r in rows if r[0] is not None and r[0] < year and r[6] is not None and r[at] is not None]
            if known:
                want[name, year] = pytest.approx(float(np.median(known)))
    assert found == want


@pytest.mark.parametrize("year", [1992, 1996, 2003])
def test_a_window_is_the_ridge_of_its_rows(panel, year):
    fits = moments.fits_before(panel, FEATURES, {"all": FEATURES, "some": ["c", "a"]})
    train = panel.where((F.col("year") < year) & F.col(TARGET).isNotNull())
    for name, features in (("all", FEATURES), ("some", ["c", "a"])):
        ridge, mine = models.fit_ridge(train, features), fits[name][year]
        weights = [0.0 if mine.scale[i] == 0 else w for i, w in enumerate(ridge.model.coefficients.toArray())]
        assert mine.weights == pytest.approx(weights, rel=1e-5, abs=1e-5)
        assert mine.constant == pytest.approx(ridge.model.intercept, rel=1e-8) and mine.n == train.count()
        test = panel.where(F.col("year") == year)
        a = [r["pred"] for r in ridge.transform(test).orderBy(TARGET).collect()]
        b = [r["pred"] for r in test.withColumn("pred", moments.predicted(mine)).orderBy(TARGET).collect()]
        assert a == pytest.approx(b, rel=1e-6)


def test_walk_forward_equals_a_fit_for_each_year(panel):
    known = panel.where(f"{TARGET} IS NOT NULL AND year IS NOT NULL")
    sets = {"few": ["a", "c"], "more": FEATURES[:3]}
    found = {(r["label"], r["test_year"]): r for r in moments.walk_forward(panel, sets, min_train_years=10).collect()}
    for name, features in sets.items():
        want = models.walk_forward(known, features, models.fit_ridge, min_train_years=10).collect()
        assert {y for label, y in found if label == name} == {r["test_year"] for r in want}
        for r in want:
            mine = found[name, r["test_year"]]
            assert (mine["n_train"], mine["n_test"]) == (r["n_train"], r["n_test"])
            assert [mine["rmse"], mine["mape"], mine["r2"]] == pytest.approx([r["rmse"], r["mape"], r["r2"]], rel=1e-5)


def test_headline_is_the_fit_before_the_test_years(panel):
    known = panel.where(f"{TARGET} IS NOT NULL AND year IS NOT NULL")
    found = moments.headline(panel, {"x": ["a", "b"]}, 2001, 2002).collect()
    want = models.headline(known.where("year < 2001"), known.where("year BETWEEN 2001 AND 2002"), ["a", "b"], models.fit_ridge, "x").first()
    assert len(found) == 1 and found[0]["n"] == want["n"] and found[0]["n_features"] == 2
    assert [found[0][c] for c in ("rmse", "mape", "r2")] == pytest.approx([want[c] for c in ("rmse", "mape", "r2")], rel=1e-6)


def test_no_rows(panel):
    none = panel.limit(0)
    assert moments.walk_forward(none, {"x": ["a"]}).count() == 0 and moments.headline(none, {"x": ["a"]}, 1, 2).count() == 0
    assert quantile.fit(none, ["a"]) is None


def test_constant_model_is_the_exact_quantile(panel, rows):
    model = quantile.fit(panel, [], (0.1, 0.5, 0.9))
    known = [r[6] for r in rows if r[6] is not None]
    for q in (0.1, 0.5, 0.9):
        assert float(model.weights[q][-1]) == pytest.approx(float(np.quantile(known, q)))


def loss(y, p, q):
    r = y - p
    return np.where(r >= 0, q * r, (q - 1) * r).mean()


def test_slopes_reach_the_least_check_loss(spark):
    """Against a subgradient search from many starts on noise whose spread grows with x."""
    rng = np.random.default_rng(5)
    x = rng.uniform(0, 10, 1500)
    y = 20 + 3 * x + rng.normal(0, 1, 1500) * (0.5 + 0.6 * x)
    table = spark.createDataFrame([(float(a), float(b), 2000) for a, b in zip(x, y)], f"x double, {TARGET} double, year int")
    model = quantile.fit(table, ["x"], (0.1, 0.9))
    scored = model.transform(table, {0.1: "lo", 0.9: "hi"})
    for q, name in ((0.1, "lo"), (0.9, "hi")):
        mine = quantile.check_loss(scored, name, q).first()["loss"]
        # the best line goes through the q-quantile of what a slope leaves: search the slope finely
        best = min(loss(y, s * x + np.quantile(y - s * x, q), q) for s in np.linspace(1, 6, 2001))
        assert mine <= best * 1.002
        assert scored.where(F.col(TARGET) <= F.col(name)).count() == pytest.approx(1500 * q, abs=2)


def test_a_fit_goes_on_from_its_written_steps(spark, panel, tmp_path):
    state = f"file://{tmp_path}/steps"
    whole = quantile.fit(panel, ["a", "c"], steps=30)
    quantile.fit(panel, ["a", "c"], steps=12, state=state)
    resumed = quantile.fit(panel, ["a", "c"], steps=30, state=state)
    assert spark.read.parquet(state).select("step").distinct().count() == resumed.steps == whole.steps
    for q in whole.weights:
        assert resumed.weights[q] == pytest.approx(whole.weights[q], rel=1e-9)


def test_band_and_correction_by_group(panel):
    model = quantile.fit(panel.where("year < 1998"), ["a", "b", "c"])
    known = panel.where(f"{TARGET} IS NOT NULL")
    banded = quantile.band(model, known)
    assert set(banded.columns) == {*panel.columns, "lower", "upper"} and banded.where("lower > upper").count() == 0
    assert banded.where("a IS NULL").count() == known.where("a IS NULL").count() > 0  # nulls stay nulls
    held = banded.where("year BETWEEN 1998 AND 2000")
    wide = quantile.corrected(held, held, ["crop"], 0.8)
    for r in quantile.coverage_and_width(wide.withColumnRenamed("crop", "g"), ["g"]).collect():
        assert 0.74 <= r["coverage"] <= 0.9
    alone = quantile.corrected(banded.where("crop = 'g1'"), held.where("crop = 'g0'"), ["crop"])
    assert sorted(r["lower"] for r in alone.collect()) == sorted(r["lower"] for r in banded.where("crop = 'g1'").collect())


def test_medians_are_those_of_the_imputation(panel):
    train = panel.where((F.col("year") < 1999) & F.col(TARGET).isNotNull())
    found = {r["feature"]: r["median"] for r in moments.medians_before(panel, FEATURES).where("before = 1999").collect()}
    assert found == pytest.approx(median_map(train, FEATURES))
