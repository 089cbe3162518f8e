"""Alert diffs, drift and the gate."""

import pytest
from pyspark.sql import functions as F

from agropanel.operators import drift, gate, metrics, watch

SNAP = "state string, district string, crop string, pred_yield double, rai double, severity double"


def snap(spark, rows):
    return spark.createDataFrame([("s", d, "Wheat", y, 0.1, v) for d, y, v in rows], SNAP)


def test_diff_and_feed_order(spark):
    before = snap(spark, [("a", 1000.0, 0.5), ("b", 1000.0, 0.5), ("c", 1000.0, 1.5), ("d", 1000.0, 0.5)])
    now = snap(spark, [("a", 600.0, 1.0), ("b", 1050.0, 0.6), ("c", 1001.0, 1.5), ("d", 1200.0, 0.5), ("e", 1.0, 0.1)])
    feed = watch.feed_order(watch.diff(now, before)).collect()
    assert [(r.district, r.alert_level) for r in feed] == [
        ("a", "urgent"), ("d", "watch"), ("e", "new"), ("c", "elevated_stable"), ("b", "minor_change"),
    ]
    assert feed[0].change_note.startswith("Forecast moved -400 kg/ha")


def test_first_snapshot_is_baseline(spark):
    out = watch.diff(snap(spark, [("a", 1.0, 0.1)]), None).first()
    assert out.alert_level == "baseline" and out.yield_change is None


def test_counts_leave_out_missing_levels(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "alert_level string")
    assert {r.alert_level: (r.n, round(r.share, 3)) for r in watch.alert_counts(df).collect()} == {
        "a": (2, 0.667), "b": (1, 0.333),
    }


def test_drift_baseline_vote_and_share(spark):
    train = spark.createDataFrame([(float(i), 1.0) for i in range(101)], "x double, flat double")
    base = drift.as_dict(drift.baseline(train, ["x", "flat"]))
    assert base["x"]["p05"] == 5.0 and base["x"]["p95"] == 95.0 and base["x"]["mean"] == 50.0
    live = spark.createDataFrame([(150.0, 9.0), (50.0, 1.0), (None, 1.0)], "x double, flat double")
    assert [r.drift_severity for r in drift.row_severity(live, base).collect()] == [3, 0, 0]
    assert [r.drift_status for r in drift.vote(live, base, ["x", "flat"], 1).collect()] == [
        "significant_drift", "normal", "normal",
    ]
    shares = {r.feature: r.extreme_share for r in drift.extreme_share(train, live, ["x", "flat", "absent"], 2.0).collect()}
    assert shares == {"x": pytest.approx(1 / 3)}


def levels(spark, counts, values):
    rows = []
    for (level, n), value in zip(counts, values, strict=True):
        rows += [(level, float(value(i))) for i in range(n)]
    return spark.createDataFrame(rows, "alert_level string, yield_change double")


@pytest.mark.parametrize(
    "counts, values, verdict, status",
    [
        ([("stable", 8), ("watch", 4)], [lambda i: i, lambda i: 200], "plausible", "pass"),
        ([("stable", 10)], [lambda i: i], "plausible", "pass"),
        ([("baseline", 20)], [lambda i: 0], "first_snapshot", "pass"),
        ([("stable", 20)], [lambda i: i], "low_variance", "pass"),
        ([("stable", 40), ("urgent", 1)], [lambda i: i % 3, lambda i: 900], "homogeneous_top", "pass"),
        ([("stable", 40)], [lambda i: i * 10], "hidden_variance", "fail"),
        ([("minor_change", 40)], [lambda i: 148 if i == 0 else 10 + i % 3], "model_version_change", "warn"),
    ],
)
def test_diversity(spark, counts, values, verdict, status):
    row = gate.diversity(levels(spark, counts, values), "alert_level", "alerts", "yield_change").first()
    assert (row.status, verdict in row.detail) == (status, True)


def test_diversity_without_a_measure(spark):
    df = spark.createDataFrame([("low",)] * 20, "risk string")
    row = gate.diversity(df, "risk", "risk").first()
    assert row.status == "fail" and "concentrated" in row.detail and "100%" in row.detail


def found(spark, rows):
    return spark.createDataFrame(
        [(i, *r) for i, r in enumerate(rows)], "seq int, check string, status string, detail string, override_ref string"
    )


def test_rollup_precedence(spark):
    df = found(
        spark,
        [("a", "pass", "fine", None), ("a", "warn", "heads up", None), ("b", "overridden", "known", "b (expires 2026-12-01)"),
         ("b", "pass", "ok", None), ("c", "fail", "broken", None), ("c", "overridden", "other", "c (expires x)")],
    )
    got = [tuple(r)[1:] for r in gate.rollup(df).orderBy("seq").collect()]
    assert got == [
        ("a", "pass", "heads up", None), ("b", "overridden", "known", "b (expires 2026-12-01)"),
        ("c", "fail", "broken | other", "c (expires x)"),
    ]
    long = found(spark, [("a", "fail", "x" * 1500, None), ("a", "fail", "y" * 1500, None)])
    assert len(gate.rollup(long).first().detail) == 2000


def test_overrides_expire(spark):
    df = found(spark, [("a", "fail", "bad", None), ("b", "fail", "bad", None), ("a", "pass", "ok", None)])
    register = spark.createDataFrame([("a", "known", "2026-05-01"), ("b", "old", "2026-04-30")],
                                     "check_id string, reason string, expires string").withColumn("expires", F.to_date("expires"))
    got = {r.seq: r for r in gate.apply_overrides(df, register, "2026-05-01").collect()}
    assert got[0].status == "overridden" and got[0].override_ref == "a (expires 2026-05-01)"
    assert got[1].status == "fail" and "expired" in got[1].detail and got[2].status == "pass"


def test_report_and_verdict(spark):
    df = found(spark, [("a", "pass", "", None), ("b", "warn", "", None)])
    assert tuple(gate.report(df).first()) == (True, 0, 1, 2)
    assert gate.report(df.union(found(spark, [("c", "fail", "", None)]))).first().passed is False


def test_schema_check(spark):
    df = gate.schema_consistency(spark, {"m": ["a", "b"], "old": ["b", "a"], "x": None, "more": ["a", "b", "c"]}, ["a", "b"])
    got = {r.detail.split(":")[0]: (r.status, r.detail) for r in df.collect()}
    assert {k: v[0] for k, v in got.items()} == {"m": "pass", "old": "fail", "x": "warn", "more": "fail"}
    assert "extra ['c']" in got["more"][1]


def test_outputs_and_ledger(spark):
    full, empty = spark.range(1), spark.range(0)
    assert [r.status for r in gate.outputs_present(spark, {"a": full, "b": empty, "c": None}).collect()] == ["pass", "fail", "fail"]
    schema = "state string, district string, error string"
    assert gate.fetch_completeness(spark.createDataFrame([], schema)).first().status == "pass"
    row = gate.fetch_completeness(spark.createDataFrame([("s", "d", "x")], schema)).first()
    assert row.status == "fail" and "s/d" in row.detail
    many = spark.range(5000).selectExpr("'s' AS state", "format_string('%05d', id) AS district", "'x' AS error")
    row = gate.fetch_completeness(many).first()
    assert row.detail.startswith("5000 sites") and "s/00999" in row.detail and "s/01000" not in row.detail and len(row.detail) > 2000


def test_match_or_refuse(spark):
    df = spark.createDataFrame([(1, "Wheat"), (2, "Wheat")], "district_id int, crop string")
    assert gate.require_matched(df, 2, ["district_id", "crop"]) is df
    with pytest.raises(RuntimeError, match="matched"):
        gate.require_matched(df, 3, ["district_id", "crop"])
    with pytest.raises(RuntimeError, match="duplicate"):
        gate.require_matched(df.union(df), 4, ["district_id", "crop"])


def test_plausible_values(spark):
    df = spark.createDataFrame([(1000.0,), (7000.0,)], "pred double")
    assert gate.plausible_values(df, "pred").first().status == "pass"
    assert gate.plausible_values(df.union(spark.createDataFrame([(None,)], "pred double")), "pred").first().status == "fail"


def test_freshness(spark):
    gate.require_fresh(2, 1)
    with pytest.raises(RuntimeError, match="older"):
        gate.require_fresh(1, 2)
    row = gate.unresolved_share(spark.createDataFrame([(1,), (None,)], "x int"), "x").first()
    assert row.share == 0.5 and row.passed is False


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([(10.0, 12.0), (20.0, 18.0), (30.0, 33.0)], "y double, p double")
    row = metrics.metrics(df, "y", "p").first()
    assert row.rmse == pytest.approx((17 / 3) ** 0.5) and row.mae == pytest.approx(7 / 3) and row.n == 3
    assert row.mape == pytest.approx((0.2 + 0.1 + 0.1) / 3 * 100) and row.r2 == pytest.approx(1 - 17 / 200)
    assert metrics.metrics(df.limit(1), "y", "p").first().r2 is None


def test_walk_forward_trains_on_the_past_only(spark):
    rows = [(y, float(y + i), float(y)) for y in range(2000, 2004) for i in range(1, 7)] + [(2004, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "year int, yield_kg_ha double, lag_yield_1 double")
    got = {r.test_year: (r.n_train, r.n_test) for r in metrics.walk_forward_persistence(df, 2).collect()}
    assert got == {2002: (12, 6), 2003: (18, 6)}


def test_published_residual_quality(spark):
    """Metrics from residuals equal metrics from predictions."""
    df = spark.createDataFrame([(4000.0, 100.0), (3000.0, -50.0), (2000.0, 20.0)], "yield_kg_ha double, residual double")
    scored = df.withColumn("pred", F.col("yield_kg_ha") - F.col("residual"))
    again = metrics.residuals(scored, "yield_kg_ha", "pred").first()
    assert again.residual == 100.0
    row = metrics.residual_moments(df).first()
    assert row["mean"] == pytest.approx(70 / 3) and row.std_pop == pytest.approx(61.2825877)
