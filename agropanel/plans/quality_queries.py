"""Registered queries over forecast quality, drift, alerts and the gate."""

from __future__ import annotations

from pyspark.sql import functions as F

from agropanel.functions import classify as K
from agropanel.operators import drift, gate, metrics, models, panel, watch, weather
from agropanel.operators.anomaly import rai_history
from agropanel.plans import oracle as o
from agropanel.plans.registry import register, tidy
from agropanel.sources import fixtures as fx
from agropanel.sources import readers, sinks

SITE = ["state", "district"]
FIRST_CUT = "2000-06-30"
SECOND_CUT = "9999-12-31"  # the newest snapshot reads every order
LIMITS = K.ChangeThresholds(same_yield=500.0, watch_yield=15000.0, urgent_yield=30000.0)

_SPLIT = "CASE WHEN year <= 1998 THEN 'train' WHEN year <= 1999 THEN 'valid' ELSE 'test' END"
_SCORED = o.YIELD + "," + o.LAGS + f""",
    scored AS (SELECT *, lag_yield_1 AS pred, yield_kg_ha - lag_yield_1 AS e, lag_yield_1 * 0.7 AS lower,
                      lag_yield_1 * 1.3 AS upper, {_SPLIT} AS split FROM lags WHERE lag_yield_1 IS NOT NULL)"""


def scored(spark, sf_dir):
    """Persistence forecast with a band of 30 percent on each side."""
    rows = metrics.persistence(panel.yield_lags(fx.yield_panel(spark, sf_dir)))
    rows = rows.withColumn("lower", F.col("pred") * 0.7).withColumn("upper", F.col("pred") * 1.3)
    return metrics.residuals(panel.with_split(rows, 1998, 1999), "yield_kg_ha", "pred")


def metric_sql(y: str = "yield_kg_ha") -> str:
    return f"""sqrt(avg(e * e)) AS rmse, avg(abs(e)) AS mae, avg(abs(e / {y})) * 100 AS mape,
    CASE WHEN count(*) > 1 THEN 1 - sum(e * e) / nullif(var_pop({y}) * count(*), 0) END AS r2, count(*) AS n"""


_METRICS = ("rmse", "mae", "mape", "r2")


@register(
    "persistence_metrics",
    o.query(
        _SCORED,
        f"SELECT split, {o.nums(*_METRICS)}, n::BIGINT AS n FROM (SELECT split, {metric_sql()} FROM scored GROUP BY ALL)",
    ),
)
def persistence_metrics(spark, sf_dir):
    return tidy(metrics.metrics(scored(spark, sf_dir), "yield_kg_ha", "pred", ["split"]))


@register(
    "weighted_metrics",
    o.query(
        _SCORED,
        "SELECT "
        + ", ".join(o.num(f"sum({c} * n) / sum(n)", 4, c) for c in _METRICS)
        + f" FROM (SELECT crop, {metric_sql()} FROM scored WHERE split = 'test' GROUP BY ALL)",
    ),
)
def weighted_metrics(spark, sf_dir):
    """Per-crop metrics combined with the test rows as weights."""
    test = scored(spark, sf_dir).where(F.col("split") == "test")
    return tidy(metrics.weighted_mean(metrics.metrics(test, "yield_kg_ha", "pred", ["crop"]), _METRICS))


_FOLDS = _SCORED + f""",
    folds AS (SELECT * FROM (SELECT year, {metric_sql()} FROM scored GROUP BY ALL)
              WHERE year >= (SELECT min(year) FROM lags) + 3 AND n >= 5)"""


@register(
    "walk_forward_persistence",
    o.query(
        _FOLDS,
        f"""SELECT year::INTEGER AS test_year, (SELECT count(*) FROM lags l WHERE l.year < f.year)::BIGINT AS n_train,
        n::BIGINT AS n_test, {o.nums('rmse', 'mape', 'r2')} FROM folds f""",
    ),
)
def walk_forward_persistence(spark, sf_dir):
    return tidy(metrics.walk_forward_persistence(panel.yield_lags(fx.yield_panel(spark, sf_dir)), 3))


@register(
    "fold_summary",
    o.query(
        _FOLDS,
        "SELECT count(*)::BIGINT AS n_folds, "
        + ", ".join(
            o.num(f"{fn}({c})", 4, f"{c}_{name}")
            for c in ("rmse", "mape", "r2")
            for name, fn in (("mean", "avg"), ("std", "stddev_samp"))
        )
        + " FROM folds",
    ),
)
def fold_summary(spark, sf_dir):
    folds = metrics.walk_forward_persistence(panel.yield_lags(fx.yield_panel(spark, sf_dir)), 3)
    return tidy(metrics.fold_summary(folds))


@register(
    "residual_stats",
    o.query(
        _SCORED,
        f"""SELECT crop, {o.nums('mean', 'std_pop', 'skew', 'mean_abs')}, n::BIGINT AS n FROM (
        SELECT crop, avg(e) AS mean, stddev_pop(e) AS std_pop, avg(abs(e)) AS mean_abs, count(*) AS n,
          (avg(e * e * e) - 3 * avg(e) * avg(e * e) + 2 * avg(e) ** 3) / stddev_pop(e) ** 3 AS skew
        FROM scored WHERE split = 'test' GROUP BY ALL)""",
    ),
)
def residual_stats(spark, sf_dir):
    test = scored(spark, sf_dir).where(F.col("split") == "test")
    return tidy(metrics.residual_moments(test, by=["crop"]))


@register(
    "group_stats",
    o.query(
        _SCORED,
        f"""SELECT state, {o.nums('mean', 'std', 'min', 'max')}, n::BIGINT AS n FROM (
        SELECT state, avg(e) AS mean, stddev_samp(e) AS std, min(e) AS min, max(e) AS max, count(*) AS n
        FROM scored GROUP BY ALL)""",
    ),
)
def group_stats(spark, sf_dir):
    return tidy(metrics.group_stats(scored(spark, sf_dir), "residual", ["state"]))


@register(
    "interval_coverage",
    o.query(
        _SCORED,
        f"""SELECT crop, count(*)::BIGINT AS n, {o.num('avg((yield_kg_ha BETWEEN lower AND upper)::INT)', 4, 'coverage')},
        {o.num('avg(upper - lower)', 4, 'mean_width')} FROM scored WHERE split = 'test' GROUP BY ALL""",
    ),
)
def interval_coverage(spark, sf_dir):
    test = scored(spark, sf_dir).where(F.col("split") == "test")
    return tidy(metrics.interval_coverage(test, ["crop"], "yield_kg_ha"))


@register(
    "conformal_band_persistence",
    o.query(
        _SCORED
        + """,
        offsets AS (SELECT crop, quantile_cont(e, 0.02) AS lo, quantile_cont(e, 0.98) AS hi FROM scored
                    WHERE split = 'valid' GROUP BY ALL)""",
        f"""SELECT crop, count(*)::BIGINT AS n,
        {o.num('avg((yield_kg_ha BETWEEN pred + lo AND pred + hi)::INT)', 4, 'coverage')},
        {o.num('avg((pred + hi) - (pred + lo))', 4, 'mean_width')}
        FROM scored JOIN offsets USING (crop) WHERE split = 'test' GROUP BY ALL""",
    ),
)
def conformal_band_persistence(spark, sf_dir):
    """Band of the persistence forecast from the residuals of the validation years, per crop."""
    rows = scored(spark, sf_dir).drop("lower", "upper")
    test, valid = rows.where(F.col("split") == "test"), rows.where(F.col("split") == "valid")
    return tidy(metrics.interval_coverage(models.conformal_band(test, valid, ["crop"]), ["crop"], "yield_kg_ha"))


_QUINTILE = _SCORED + """,
    edges AS (SELECT quantile_cont(pred, [0.2, 0.4, 0.6, 0.8]) AS q FROM scored WHERE split = 'test'),
    bucketed AS (
      SELECT s.*, CASE WHEN pred <= q[1] THEN 'lowest' WHEN pred <= q[2] THEN 'low' WHEN pred <= q[3] THEN 'mid'
                       WHEN pred <= q[4] THEN 'high' ELSE 'highest' END AS bucket
      FROM scored s, edges WHERE split = 'test')"""


@register(
    "quintile_calibration",
    o.query(
        _QUINTILE,
        f"""SELECT bucket, {o.num('avg((yield_kg_ha BETWEEN lower AND upper)::INT)', 6, 'coverage')},
        count(*)::BIGINT AS n FROM bucketed GROUP BY ALL""",
    ),
)
def quintile_calibration(spark, sf_dir):
    test = scored(spark, sf_dir).where(F.col("split") == "test")
    return tidy(metrics.quintile_calibration(test, "pred", "yield_kg_ha"), 6)


@register(
    "worst_quintile",
    o.query(
        _QUINTILE,
        f"""SELECT bucket, {o.num('coverage', 6)}, (coverage < 0.6)::INTEGER AS flagged FROM (
        SELECT bucket, avg((yield_kg_ha BETWEEN lower AND upper)::INT) AS coverage FROM bucketed GROUP BY ALL)
        ORDER BY coverage, bucket LIMIT 1""",
    ),
)
def worst_quintile(spark, sf_dir):
    test = scored(spark, sf_dir).where(F.col("split") == "test")
    worst = metrics.worst_bucket(metrics.quintile_calibration(test, "pred", "yield_kg_ha"))
    return tidy(worst.withColumn("flagged", F.col("flagged").cast("int")), 6)


@register(
    "mean_deviation_check",
    o.query(
        _SCORED,
        f"""SELECT {o.nums('pred_mean', 'hist_mean', 'deviation_pct')}, (abs(deviation_pct) > 25)::INTEGER AS warn
        FROM (SELECT *, (pred_mean - hist_mean) / hist_mean * 100 AS deviation_pct FROM (
          SELECT (SELECT avg(pred) FROM scored WHERE crop = 'BUILDING') AS pred_mean,
                 (SELECT avg(yield_kg_ha) FROM lags WHERE crop = 'BUILDING'
                    AND year >= (SELECT max(year) FROM lags) - 4) AS hist_mean))""",
    ),
)
def mean_deviation_check(spark, sf_dir):
    predictions = scored(spark, sf_dir).withColumn("pred_yield", F.col("pred"))
    out = metrics.mean_deviation(predictions, fx.yield_panel(spark, sf_dir), "BUILDING")
    return tidy(out.withColumn("warn", F.col("warn").cast("int")))


@register(
    "histogram30",
    o.query(
        "edges AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)",
        f"""SELECT least(floor((o_totalprice - lo) * 30 / (hi - lo)) + 1, 30)::INTEGER AS bin, count(*)::BIGINT AS n,
        {o.num('min(o_totalprice)', 2, 'lowest')}, {o.num('max(o_totalprice)', 2, 'highest')}
        FROM orders, edges GROUP BY 1""",
    ),
)
def histogram30(spark, sf_dir):
    return tidy(metrics.histogram(fx.table(spark, sf_dir, "orders"), "o_totalprice"), 2)


# ---- drift ----------------------------------------------------------------------------------------------------

_EVENT_FEATURES = ["n_events", "total_value", "mean_value", "max_value"]
_EVENTS = """
    event_days AS (
      SELECT user_id, CAST(ts AS DATE) AS day, count(*)::DOUBLE AS n_events, sum(value) AS total_value,
             avg(value) AS mean_value, max(value) AS max_value FROM events GROUP BY ALL),
    past AS (SELECT * FROM event_days WHERE day < DATE '2024-01-21'),
    live AS (SELECT * FROM event_days WHERE day >= DATE '2024-01-21'),
    stats AS ("""
_EVENTS += " UNION ALL ".join(
    f"SELECT '{c}' AS feature, avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS min, max({c}) AS max, "
    f"quantile_cont({c}, 0.05) AS p05, quantile_cont({c}, 0.95) AS p95 FROM past"
    for c in _EVENT_FEATURES
)
_EVENTS += ")"


def event_split(spark, sf_dir):
    rows = fx.event_days(spark, sf_dir)
    cut = F.lit("2024-01-21").cast("date")
    return rows.where(F.col("day") < cut), rows.where(F.col("day") >= cut)


@register(
    "drift_baseline",
    o.query(_EVENTS, f"SELECT feature, {o.nums('mean', 'std', 'min', 'max', 'p05', 'p95')} FROM stats"),
)
def drift_baseline(spark, sf_dir):
    return tidy(drift.baseline(event_split(spark, sf_dir)[0], _EVENT_FEATURES))


def _severity_sql(c: str) -> str:
    s = f"(SELECT {{}} FROM stats WHERE feature = '{c}')"
    z = f"abs(({c} - {s.format('mean')}) / {s.format('std')})"
    outside = f"({c} < {s.format('p05')} OR {c} > {s.format('p95')})"
    return f"CASE WHEN {z} > 3 THEN 3 WHEN {z} > 2 OR {outside} THEN 2 WHEN {z} > 1.5 THEN 1 ELSE 0 END"


@register(
    "drift_v1",
    o.query(
        _EVENTS,
        f"""SELECT user_id, day, sev::INTEGER AS drift_severity,
        ['normal', 'mild_drift', 'moderate_drift', 'severe_drift'][sev + 1] AS drift_level
        FROM (SELECT user_id, day, greatest({', '.join(_severity_sql(c) for c in _EVENT_FEATURES)}) AS sev FROM live)""",
    ),
)
def drift_v1(spark, sf_dir):
    past, live = event_split(spark, sf_dir)
    stats = drift.as_dict(drift.baseline(past, _EVENT_FEATURES))
    return drift.row_severity(live, stats).select("user_id", "day", "drift_severity", "drift_level")


def _drifted_sql(c: str) -> str:
    s = f"(SELECT {{}} FROM stats WHERE feature = '{c}')"
    return f"(abs(({c} - {s.format('mean')}) / {s.format('std')}) > 2)::INTEGER"


@register(
    "drift_vote",
    o.query(
        _EVENTS,
        f"""SELECT user_id, day, n::INTEGER AS n_drifted, CASE WHEN n >= 3 THEN 'significant_drift'
        WHEN n >= 1 THEN 'mild_drift' ELSE 'normal' END AS drift_status
        FROM (SELECT user_id, day, {' + '.join(_drifted_sql(c) for c in _EVENT_FEATURES)} AS n FROM live)""",
    ),
)
def drift_vote(spark, sf_dir):
    past, live = event_split(spark, sf_dir)
    stats = drift.as_dict(drift.baseline(past, _EVENT_FEATURES))
    return drift.vote(live, stats, _EVENT_FEATURES).select("user_id", "day", "n_drifted", "drift_status")


@register(
    "feature_plausibility",
    o.query(
        _EVENTS,
        " UNION ALL ".join(
            f"SELECT '{c}' AS feature, "
            + o.num(f"avg((abs(({c} - mean) / std) > 3)::INTEGER)", 6, "extreme_share")
            + f", count(*)::BIGINT AS n FROM live, stats WHERE feature = '{c}'"
            for c in _EVENT_FEATURES
        ),
    ),
)
def feature_plausibility(spark, sf_dir):
    past, live = event_split(spark, sf_dir)
    return tidy(drift.extreme_share(past, live, _EVENT_FEATURES), 6)


# ---- snapshots and alerts -------------------------------------------------------------------------------------

def snapshot(spark, sf_dir, until):
    rows = fx.snapshot_rows(spark, sf_dir, until)
    return watch.snapshot(rows, fx.area_history(spark, sf_dir, until))


def alerts(spark, sf_dir):
    """Differences between the forecasts of two cut-off dates."""
    before, now = snapshot(spark, sf_dir, FIRST_CUT), snapshot(spark, sf_dir, SECOND_CUT)
    return watch.diff(now, before, limits=LIMITS)


ALERTS_SQL = o.snapshot_sql("before", FIRST_CUT) + "," + o.snapshot_sql("now", SECOND_CUT) + """,
    changed AS (
      SELECT n.*, n.pred_yield - b.pred_yield AS yield_change, n.rai - b.rai AS rai_change,
             n.severity - b.severity AS severity_change, b.severity AS previous_severity
      FROM now n LEFT JOIN before b ON n.state = b.state AND n.district = b.district AND n.crop = b.crop),
    alerts AS (
      SELECT *, CASE WHEN previous_severity IS NULL THEN 'new'
        WHEN abs(yield_change) < 500 AND abs(severity_change) < 0.05 AND severity > 1.2 THEN 'elevated_stable'
        WHEN abs(yield_change) < 500 AND abs(severity_change) < 0.05 THEN 'stable'
        WHEN abs(yield_change) > 30000 AND (coalesce(severity_change > 0.3, false) OR yield_change < -15000) THEN 'urgent'
        WHEN severity > 2 AND severity_change > 0.3 THEN 'urgent'
        WHEN abs(yield_change) > 15000 OR abs(severity_change) > 0.3 THEN 'watch'
        ELSE 'minor_change' END AS alert_level FROM changed)"""
_CHANGES = ("yield_change", "rai_change", "severity_change", "severity")


@register(
    "snapshot_diff_alerts",
    o.query(ALERTS_SQL, f"SELECT state, district, crop, {o.nums(*_CHANGES)}, alert_level FROM alerts"),
)
def snapshot_diff_alerts(spark, sf_dir):
    return tidy(alerts(spark, sf_dir).select(*SITE, "crop", *_CHANGES, "alert_level"))


@register(
    "alert_counts",
    o.query(
        ALERTS_SQL,
        f"""SELECT alert_level, count(*)::BIGINT AS n, {o.num('count(*) / (SELECT count(*) FROM alerts)', 6, 'share')}
        FROM alerts GROUP BY ALL""",
    ),
)
def alert_counts(spark, sf_dir):
    return tidy(watch.alert_counts(alerts(spark, sf_dir)), 6)


@register(
    "alert_feed",
    o.query(
        ALERTS_SQL,
        f"""SELECT state, district, crop, alert_level, {o.num('severity')},
        CASE alert_level WHEN 'urgent' THEN 0 WHEN 'watch' THEN 1 WHEN 'new' THEN 2 WHEN 'elevated_stable' THEN 3
             WHEN 'stable' THEN 4 END::DOUBLE AS feed_rank FROM alerts""",
    ),
)
def alert_feed(spark, sf_dir):
    feed = watch.feed_order(alerts(spark, sf_dir)).withColumn("feed_rank", F.col("feed_rank").cast("double"))
    return tidy(feed.select(*SITE, "crop", "alert_level", "severity", "feed_rank"))


@register(
    "alert_notes",
    o.query(
        ALERTS_SQL,
        """SELECT alert_level, kind, count(*)::BIGINT AS n FROM (
        SELECT alert_level, CASE WHEN alert_level = 'watch' AND yield_change > 0 THEN 'improved'
          WHEN alert_level = 'watch' THEN 'declined'
          WHEN alert_level = 'urgent' AND abs(yield_change) > 30000
            AND (coalesce(severity_change > 0.3, false) OR yield_change < -15000) THEN 'worsening'
          WHEN alert_level = 'urgent' THEN 'rising' ELSE 'other' END AS kind FROM alerts) GROUP BY ALL""",
    ),
)
def alert_notes(spark, sf_dir):
    note = F.col("change_note")
    kind = (
        F.when(note.contains("improved"), "improved").when(note.contains("declined"), "declined")
        .when(note.contains("worsening"), "worsening").when(note.contains("rising"), "rising").otherwise("other")
    )
    rows = alerts(spark, sf_dir).select("alert_level", kind.alias("kind"))
    return rows.groupBy("alert_level", "kind").agg(F.count(F.lit(1)).alias("n"))


@register(
    "first_snapshot",
    o.query(o.snapshot_sql("now", SECOND_CUT), "SELECT 'baseline' AS alert_level, count(*)::BIGINT AS n FROM now"),
)
def first_snapshot(spark, sf_dir):
    feed = watch.diff(snapshot(spark, sf_dir, SECOND_CUT), None)
    return feed.groupBy("alert_level").agg(F.count(F.lit(1)).alias("n"))


# ---- gate -----------------------------------------------------------------------------------------------------

_CONCENTRATION = ("top_share", "measure_std", "measure_range", "measure_mean_abs", "measure_kurtosis", "top_std", "top_range")


@register(
    "gate_diversity",
    o.query(
        ALERTS_SQL
        + """,
        levels AS (SELECT alert_level, count(*) AS n, stddev_samp(yield_change) AS s, max(yield_change) - min(yield_change) AS r
                   FROM alerts GROUP BY ALL),
        top AS (SELECT * FROM levels ORDER BY n DESC, alert_level DESC LIMIT 1),
        one AS (
          SELECT (SELECT count(*) FROM alerts) AS n_rows, (SELECT alert_level FROM top) AS top_level,
            (SELECT n FROM top) / (SELECT count(*) FROM alerts) AS top_share, (SELECT s FROM top) AS top_std,
            (SELECT r FROM top) AS top_range, stddev_samp(yield_change) AS measure_std,
            max(yield_change) - min(yield_change) AS measure_range, avg(abs(yield_change)) AS measure_mean_abs,
            kurtosis_pop(yield_change) AS measure_kurtosis FROM alerts)""",
        f"""SELECT n_rows::BIGINT AS n_rows, top_level, {o.nums(*_CONCENTRATION)},
        CASE WHEN top_share <= 0.4 OR n_rows <= 10 THEN 'plausible' WHEN top_level = 'baseline' THEN 'first_snapshot'
             WHEN measure_std < 20 AND measure_range < 100 THEN 'low_variance'
             WHEN top_level = 'minor_change' AND measure_mean_abs < 150 AND measure_kurtosis > 1 THEN 'model_version_change'
             WHEN top_std < 20 AND top_range < 100 THEN 'homogeneous_top' ELSE 'hidden_variance' END AS verdict FROM one""",
    ),
)
def gate_diversity(spark, sf_dir):
    """A lower share limit than usual, so that the later rules are reached."""
    row = gate.concentration(alerts(spark, sf_dir), "alert_level", "yield_change")
    return tidy(row.withColumn("verdict", gate.diversity_verdict(max_share=0.4)))


_LINES = """
    by_nation AS (
      SELECT n_nationkey AS seq, 'region ' || n_regionkey AS check_name, n_name AS nation, avg(o_totalprice) AS mean,
             count(*) AS n
      FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
    lines AS (
      SELECT seq, check_name, CASE WHEN seq % 5 = 2 AND seq < 10 THEN 'fail' WHEN seq % 3 = 0 THEN 'warn' ELSE 'pass' END AS status,
             nation || ': ' || n || ' orders' AS detail FROM by_nation)"""


def finding_lines(spark, sf_dir):
    """One finding per nation, checked per region, over all orders."""
    nation = fx.table(spark, sf_dir, "nation")
    customers = fx.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    per_customer = fx.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    per_nation = per_customer.join(customers, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(
        F.sum("n").alias("n")
    )
    rows = per_nation.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    seq = F.col("n_nationkey")
    status = F.when((seq % 5 == 2) & (seq < 10), "fail").when(seq % 3 == 0, "warn").otherwise("pass")
    return rows.select(
        seq.alias("seq"), F.concat(F.lit("region "), "n_regionkey").alias("check"), status.alias("status"),
        F.concat("n_name", F.lit(": "), "n", F.lit(" orders")).alias("detail"),
        F.lit(None).cast("string").alias("override_ref"),
    )


def override_rows(spark):
    return spark.createDataFrame(
        [("region 2", "known and explained", "2030-01-01"), ("region 1", "old", "2020-01-01")],
        "check_id string, reason string, expires string",
    ).withColumn("expires", F.to_date("expires"))


_OVERRIDDEN = _LINES + """,
    overridden AS (
      SELECT seq, check_name,
        CASE WHEN status = 'fail' AND check_name = 'region 2' THEN 'overridden' ELSE status END AS status,
        CASE WHEN status = 'fail' AND check_name = 'region 2' THEN detail || ' | overridden: known and explained'
             WHEN status = 'fail' AND check_name = 'region 1' THEN detail || ' | override expired 2020-01-01'
             ELSE detail END AS detail,
        CASE WHEN status = 'fail' AND check_name = 'region 2' THEN 'region 2 (expires 2030-01-01)' END AS override_ref
      FROM lines)"""


@register(
    "override_apply",
    o.query(
        _OVERRIDDEN,
        """SELECT seq::INTEGER AS seq, check_name AS "check", status, detail, coalesce(override_ref, '') AS override_ref
        FROM overridden""",
    ),
)
def override_apply(spark, sf_dir):
    out = gate.apply_overrides(finding_lines(spark, sf_dir), override_rows(spark), "2026-01-01")
    return out.withColumn("override_ref", F.coalesce("override_ref", F.lit("")))


@register(
    "gate_rollup",
    o.query(
        _OVERRIDDEN,
        """SELECT min(seq)::INTEGER AS seq, check_name,
        CASE WHEN bool_or(status = 'fail') THEN 'fail' WHEN bool_or(status = 'overridden') THEN 'overridden'
             ELSE 'pass' END AS status,
        coalesce(string_agg(detail, ' | ' ORDER BY seq) FILTER (WHERE status <> 'pass'),
                 string_agg(detail, ' | ' ORDER BY seq)) AS detail,
        coalesce(string_agg(override_ref, '; ' ORDER BY seq), '') AS override_ref FROM overridden GROUP BY check_name""",
    ),
)
def gate_rollup(spark, sf_dir):
    found = gate.apply_overrides(finding_lines(spark, sf_dir), override_rows(spark), "2026-01-01")
    return gate.rollup(found).withColumn("override_ref", F.coalesce("override_ref", F.lit("")))


@register(
    "gate_report",
    o.query(
        _OVERRIDDEN,
        """SELECT bool_and(status <> 'fail')::INTEGER AS passed, count(*) FILTER (WHERE status = 'fail')::BIGINT AS failures,
        count(*) FILTER (WHERE status IN ('warn', 'overridden'))::BIGINT AS warnings, count(*)::BIGINT AS n_findings
        FROM overridden""",
    ),
)
def gate_report(spark, sf_dir):
    found = gate.apply_overrides(finding_lines(spark, sf_dir), override_rows(spark), "2026-01-01")
    return gate.report(found).withColumn("passed", F.col("passed").cast("int"))


@register(
    "duplicate_keys",
    o.query(
        o.SEASON_YIELD,
        """SELECT count(*)::BIGINT AS n_keys, coalesce(sum(n), 0)::BIGINT AS n_rows FROM (
        SELECT state, district, crop, season, year, count(*) AS n FROM season_yield GROUP BY ALL HAVING count(*) > 1)""",
    ),
)
def duplicate_keys(spark, sf_dir):
    keys = [*SITE, "crop", "season", "year"]
    return gate.duplicate_keys(fx.season_yields(spark, sf_dir), keys)


@register(
    "plausible_values",
    o.query(
        o.YIELD,
        """SELECT CASE WHEN n > 0 THEN 'fail' ELSE 'pass' END AS status, 'yield_kg_ha ' || n || ' outside' AS detail
        FROM (SELECT count(*) FILTER (WHERE yield_kg_ha IS NULL OR NOT yield_kg_ha BETWEEN 5000 AND 400000) AS n
              FROM yield_panel)""",
    ),
)
def plausible_values(spark, sf_dir):
    found = gate.plausible_values(fx.yield_panel(spark, sf_dir), "yield_kg_ha", 5000.0, 400000.0)
    return found.select("status", "detail")


@register(
    "fill_value_report",
    o.query(
        o.DAILY,
        " UNION ALL ".join(
            f"SELECT '{c}' AS measure, count(*) FILTER (WHERE {c} IS NULL)::BIGINT AS n_fill, "
            f"min(date) FILTER (WHERE {c} IS NULL) AS first_day, max(date) FILTER (WHERE {c} IS NULL) AS last_day FROM daily"
            for c in ("temp_max_c", "temp_min_c", "temp_avg_c", "solar_radiation")
        ),
    ),
)
def fill_value_report(spark, sf_dir):
    report = readers.fill_report(fx.daily_raw(spark, sf_dir))
    return report.where(F.col("n_fill") > 0)


@register(
    "fill_values_nulled",
    o.query(
        o.DAILY,
        f"""SELECT state, district, count(*)::BIGINT AS n_days, count(temp_max_c)::BIGINT AS n_measured,
        {o.num('avg(temp_max_c)', 4, 'mean_max')} FROM daily GROUP BY ALL""",
    ),
)
def fill_values_nulled(spark, sf_dir):
    clean = readers.clean_daily(fx.daily_raw(spark, sf_dir))
    return tidy(
        clean.groupBy(*SITE).agg(
            F.count(F.lit(1)).alias("n_days"), F.count("temp_max_c").alias("n_measured"),
            F.avg("temp_max_c").alias("mean_max"),
        )
    )


@register(
    "feature_range_gate",
    o.query(
        o.SEASONAL + "," + o.RAI,
        """SELECT detail_feature, CASE WHEN share > 0.5 THEN 'fail' ELSE 'pass' END AS status FROM ("""
        + " UNION ALL ".join(
            f"SELECT '{c}' AS detail_feature, (SELECT avg(coalesce(abs(({c} - m) / s) > 3, false)::INTEGER) "
            f"FROM rai WHERE year = 2001) AS share FROM (SELECT avg({c}) AS m, stddev_samp({c}) AS s FROM rai WHERE year < 2001)"
            for c in ("nasa_rainfall_rabi", "gdd_kharif", "rainfall_anomaly_index")
        )
        + ")",
    ),
)
def feature_range_gate(spark, sf_dir):
    rows = rai_history(weather.seasonal(fx.daily(spark, sf_dir)))
    columns = ["nasa_rainfall_rabi", "gdd_kharif", "rainfall_anomaly_index"]
    found = gate.feature_ranges(rows.where(F.col("year") < 2001), rows.where(F.col("year") == 2001), columns)
    return found.select(F.substring_index("detail", " ", 1).alias("detail_feature"), "status")


@register(
    "gate_findings",
    o.query(
        ALERTS_SQL
        + """,
        lost AS (SELECT count(*) AS n FROM customer WHERE NOT EXISTS (
          SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '2001-01-01'))""",
        """SELECT 0::INTEGER AS seq, 'schema_consistency' AS check_name, 'fail' AS status
        UNION ALL SELECT 1::INTEGER, 'output_files_present', 'pass'
        UNION ALL SELECT 2::INTEGER, 'weather_fetch_completeness', CASE WHEN n > 0 THEN 'fail' ELSE 'pass' END FROM lost
        UNION ALL SELECT 3::INTEGER, 'plausible_values',
          CASE WHEN count(*) FILTER (WHERE pred_yield IS NULL OR NOT pred_yield BETWEEN 0 AND 1000000) > 0 THEN 'fail'
               ELSE 'pass' END FROM alerts
        UNION ALL SELECT 4::INTEGER, 'classification_diversity', CASE WHEN max(n) / sum(n) <= 0.85 THEN 'pass' ELSE 'fail' END
          FROM (SELECT alert_level, count(*) AS n FROM alerts GROUP BY ALL)""",
    ),
)
def gate_findings(spark, sf_dir):
    """A whole gate run over the alert feed, one row per check; one model was fitted without the contract's last feature."""
    feed = alerts(spark, sf_dir)
    everyone = fx.customer_sites(spark, sf_dir)
    landed = fx.yield_panel(spark, sf_dir).where(F.col("year") >= 2001)
    found = gate.combine(
        [
            gate.schema_consistency(spark, {"model": panel.FEATURES, "stale": panel.FEATURES[:-1]}, panel.FEATURES),
            gate.outputs_present(spark, {"alerts": feed}),
            gate.fetch_completeness(sinks.failure_ledger(everyone, landed)),
            gate.plausible_values(feed, "pred_yield", 0.0, 1000000.0),
            gate.diversity(feed, "alert_level", "alerts", "yield_change"),
        ]
    )
    return gate.rollup(found).select("seq", "check_name", "status")
