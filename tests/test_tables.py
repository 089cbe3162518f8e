"""Readers, sinks, the run manifest, the views on it, streaming ingest and a whole refresh."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from agropanel import schema as sc
from agropanel.operators import panel, watch
from agropanel.plans import refresh as rf
from agropanel.plans import views
from agropanel.sources import readers, sinks
from agropanel.streaming import ingest


def document(state, district, values):
    return json.dumps({"state": state, "district": district, "lat": 1.0, "lon": 2.0, "properties": {"parameter": values}})


def test_payload(spark, tmp_path):
    (tmp_path / "a.json").write_text(
        document("s", "d", {"PRECTOTCORR": {"20260101": 1.5, "20260102": -999.0}, "T2M": {"20260102": 9.0, "20260103": 8.0}})
    )
    rows = {r.date.day: r for r in readers.clean_daily(readers.read_payload(spark, str(tmp_path))).collect()}
    assert sorted(rows) == [1, 2, 3]
    assert rows[1].rainfall_mm == 1.5 and rows[1].temp_avg_c is None
    assert rows[2].rainfall_mm is None and rows[2].temp_avg_c == 9.0 and rows[3].rainfall_mm is None


def test_csv_and_optional_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("district_id,year,season,metric,value\n1,2000,Rabi,ndvi,0.5\n2,bad,Rabi,ndvi,NaN\n")
    df = readers.read_csv(spark, str(tmp_path / "a.csv"), sc.ENV_SEASONAL, ["district_id", "year", "value"])
    assert [tuple(r) for r in df.collect()] == [(1, 2000, 0.5), (2, None, None)]
    assert readers.read_optional(spark, str(tmp_path / "none"), sc.YIELD) is None
    assert readers.read_table(spark, str(tmp_path / "none"), sc.YIELD).count() == 0


def test_config_files(spark, tmp_path):
    (tmp_path / "names.txt").write_text("b\n a \n\nc")
    assert readers.read_names(spark, str(tmp_path / "names.txt")) == ["b", "a", "c"]
    (tmp_path / "o.json").write_text(json.dumps({"x": {"reason": "r", "evidence": "e", "caveat": "c", "expires": "2026-01-02"}}, indent=1))
    row = readers.read_overrides(spark, str(tmp_path / "o.json")).first()
    assert row.check_id == "x" and row.expires == dt.date(2026, 1, 2)
    assert readers.read_overrides(spark, str(tmp_path / "no.json")).count() == 0
    (tmp_path / "b.json").write_text(json.dumps({"f": {"mean": 1.0, "std": 2.0, "p05": 0.0, "p95": 3.0}}))
    assert readers.read_drift_baseline(spark, str(tmp_path / "b.json")).first()["std"] == 2.0
    (tmp_path / "p.json").write_text('{"max_depth": 8}')
    assert readers.read_parameters(spark, str(tmp_path / "p.json")) == {"max_depth": 8}


def test_snapshots_are_appended_and_the_newest_before_now_is_read(spark, tmp_path):
    path = str(tmp_path / "snap")
    assert readers.latest_snapshot(spark, path) is None
    df = spark.createDataFrame([("s", "d", "Wheat", 1.0, 0.1, 0.2, 0, 0, 5.0)],
                               "state string, district string, crop string, pred_yield double, rai double, severity double, "
                               "drought_flag int, flood_flag int, change double")
    sinks.append_snapshot(df, path, "20260101_000000")
    sinks.append_snapshot(df.withColumn("pred_yield", F.lit(2.0)), path, "20260102_000000")
    assert readers.latest_snapshot(spark, path).first().pred_yield == 2.0
    sinks.append_snapshot(df.withColumn("pred_yield", F.lit(3.0)), path, "20260102_000000")
    assert [r.pred_yield for r in readers.latest_snapshot(spark, path).collect()] == [3.0]
    assert spark.read.parquet(path).count() == 2
    with pytest.raises(Exception, match="twice"):
        watch.diff(df, df.union(df)).collect()
    assert readers.latest_snapshot(spark, path, "20260102_000000").first().pred_yield == 1.0
    assert readers.latest_snapshot(spark, path, "20260101_000000") is None


def test_ledger_is_written_empty_over_an_old_one(spark, tmp_path):
    path = str(tmp_path / "ledger")
    sites = spark.createDataFrame([("s", "a"), ("s", "b")], "state string, district string")
    sinks.write_ledger(sinks.failure_ledger(sites, sites.limit(1)), path)
    assert readers.read_csv(spark, path, sc.FAILURES).count() == 1
    sinks.write_ledger(sinks.failure_ledger(sites, sites), path)
    assert readers.read_csv(spark, path, sc.FAILURES).count() == 0


def test_upsert_twice_gives_the_same_table(spark, tmp_path):
    path = str(tmp_path / "env")
    keys = ["district_id", "year", "season", "metric"]
    first = spark.createDataFrame([(1, 2000, "Rabi", "ndvi", 1.0), (1, 2001, "Rabi", "ndvi", 2.0)], sc.ENV_SEASONAL)
    second = spark.createDataFrame([(1, 2001, "Rabi", "ndvi", 9.0), (2, 2001, "Rabi", "ndvi", 3.0)], sc.ENV_SEASONAL)
    for batch in (first, second, second):
        sinks.upsert(spark, batch, path, keys, sc.ENV_SEASONAL)
    got = {(r.district_id, r.year): r.value for r in spark.read.parquet(path).collect()}
    assert got == {(1, 2000): 1.0, (1, 2001): 9.0, (2, 2001): 3.0}


def test_upsert_refuses_repeated_keys_and_keeps_the_old_table_on_failure(spark, tmp_path):
    path, schema = str(tmp_path / "t"), sc.ENV_SEASONAL
    rows = spark.createDataFrame([(1, 2000, "Rabi", "ndvi", 0.5)], "district_id int, year int, season string, metric string, value double")
    rows = rows.select(*[F.col(c) if c in rows.columns else F.lit(None).alias(c) for c in schema.fieldNames()])
    keys = ["district_id", "year", "season", "metric"]
    sinks.upsert(spark, rows, path, keys, schema)
    with pytest.raises(ValueError, match="repeated keys"):
        sinks.upsert(spark, rows.union(rows), path, keys, schema)
    with pytest.raises(Exception, match="broken"):
        sinks.replace_table(rows.withColumn("value", F.raise_error(F.lit("broken")).cast("double")), path)
    sinks.replace_table(rows.withColumn("value", F.lit(2.0)), path)
    assert [r.value for r in spark.read.parquet(path).collect()] == [2.0]


def test_partitioned_upsert_rewrites_only_touched_partitions(spark, tmp_path):
    path = str(tmp_path / "env")
    keys = ["district_id", "year", "season", "metric"]
    first = spark.createDataFrame([(1, 2000, "Rabi", "ndvi", 1.0), (1, 2001, "Rabi", "ndvi", 2.0)], sc.ENV_SEASONAL)
    sinks.upsert(spark, first, path, keys, sc.ENV_SEASONAL, partition_by=["year"])
    before = {f.name for f in (tmp_path / "env" / "year=2000").iterdir()}
    second = spark.createDataFrame([(1, 2001, "Rabi", "ndvi", 9.0), (2, 2001, "Rabi", "ndvi", 3.0)], sc.ENV_SEASONAL)
    sinks.upsert(spark, second, path, keys, sc.ENV_SEASONAL, partition_by=["year"])
    assert {f.name for f in (tmp_path / "env" / "year=2000").iterdir()} == before
    got = {(r.district_id, r.year): r.value for r in spark.read.parquet(path).collect()}
    assert got == {(1, 2000): 1.0, (1, 2001): 9.0, (2, 2001): 3.0}
    with pytest.raises(ValueError, match="part of the key"):
        sinks.upsert(spark, second, path, ["district_id"], sc.ENV_SEASONAL, partition_by=["year"])


def test_gate_report_is_written(spark, tmp_path):
    from agropanel.operators import gate

    found = gate.combine([gate.findings(spark, [("a", "pass", "fine"), ("b", "fail", "bad")])])
    gate.write_report(found, str(tmp_path / "report"), "2026-01-01T00:00:00")
    summary = spark.read.json(str(tmp_path / "report" / "summary")).first()
    assert summary.passed is False and summary.failures == 1 and summary.generated_at == "2026-01-01T00:00:00"
    assert spark.read.json(str(tmp_path / "report" / "findings")).count() == 2


def test_upsert_keeps_the_first_known_value(spark):
    old = spark.createDataFrame([("v1", "2025-01-01", 1), ("v2", None, 1)], "model_version string, trained_at string, m int")
    new = spark.createDataFrame([("v1", "2026-01-01", 2), ("v2", "2026-01-01", 2), ("v3", "2026-01-01", 2)], old.schema)
    got = {r.model_version: (r.trained_at, r.m) for r in sinks.merge_rows(old, new, ["model_version"], ["trained_at"]).collect()}
    assert got == {"v1": ("2025-01-01", 2), "v2": ("2026-01-01", 2), "v3": ("2026-01-01", 2)}


def test_prediction_rows_keep_nulls_and_fill_the_season(spark):
    df = spark.createDataFrame(
        [(7, "Wheat", 4100.0, 3900.0, float("nan"), 2019, "b", 1.0, None, 0.5, -0.5)],
        "district_id int, crop string, pred_yield double, pred_lower double, pred_upper double, baseline_yield_year int, "
        "prediction_basis string, f1 double, f2 double, shap_f1 double, shap_f2 double",
    )
    row = sinks.prediction_rows(df, ["f1", "f2"], "r").first()
    assert row.season == "Rabi" and row.pred_upper is None and row.features == {"f1": 1.0, "f2": None}
    assert row.attributions == {"f1": 0.5, "f2": -0.5}


def runs(spark, rows):
    return spark.createDataFrame(
        [(i, s, p, dt.date(2026, 10, d), dt.datetime(2026, 10, d), dt.datetime(2026, 10, d, 1) if f else None) for i, s, p, d, f in rows],
        "run_id string, status string, gate_passed boolean, weather_data_as_of date, started_at timestamp, finished_at timestamp",
    )


def test_only_a_passed_run_is_latest(spark):
    events = runs(spark, [("a", "running", None, 1, False), ("a", "ok", True, 1, True), ("b", "running", None, 2, False),
                          ("b", "flagged", False, 2, True), ("c", "running", None, 3, False)])
    assert [r.run_id for r in views.latest_run(events).collect()] == ["a"]
    assert {r.run_id: r.status for r in sinks.run_state(events).collect()} == {"a": "ok", "b": "flagged", "c": "running"}
    assert views.freshness(events, "2026-10-08").first().status == "ok"
    assert views.freshness(events, "2026-10-09").first().status == "stale"
    assert views.freshness(events.limit(1), "2026-10-09").first().status == "no_promoted_run"
    assert [r.run_id for r in views.run_history(events).collect()] == ["b", "a"]


def test_publish_promotes_flags_and_fails(spark, tmp_path):
    root = str(tmp_path / "store")
    data = spark.createDataFrame([(1, "urgent")], "district_id int, alert_level string")

    def checks(status):
        return lambda run: spark.createDataFrame([("c", status, "", None)], "check_name string, status string, detail string, override_ref string")

    seen = []

    def output(run, previous):
        seen.append(previous)
        return data

    def go(run, status, at, build=output):
        return sinks.publish(spark, root, {"watch_events": build}, checks(status), "v1", "2026-10-01", f"2026-10-01 {at}:00:00",
                             f"2026-10-01 {at}:30:00", run_id=run)

    assert go("a", "pass", "01") == ("a", "ok")
    assert go("b", "fail", "02") == ("b", "flagged")
    with pytest.raises(ZeroDivisionError):
        go("c", "pass", "03", lambda run, prev: 1 / 0)
    assert go("d", "overridden", "04") == ("d", "ok")
    assert seen == [None, "a", "a"]
    manifest = spark.read.schema(sc.RUNS).parquet(f"{root}/runs")
    assert {r.run_id: r.status for r in sinks.run_state(manifest).collect()} == {"a": "ok", "b": "flagged", "c": "failed", "d": "ok"}
    table = spark.read.parquet(f"{root}/watch_events")
    assert table.count() == 3 and views.of_latest(table, manifest).count() == 1
    assert go("d", "pass", "05")[1] == "ok" and spark.read.parquet(f"{root}/watch_events").count() == 3


def shaped(spark, lower, upper):
    return views.shape_prediction(
        spark.createDataFrame(
            [("Punjab", "Amritsar", "punjab/amritsar", "Wheat", "Rabi", 5173.259, lower, upper, 2019, "b", 0.4213, 0.0, 1.0, 4900.0)],
            "state string, district string, slug string, crop string, season string, pred_yield double, pred_lower double, "
            "pred_upper double, baseline_yield_year int, prediction_basis string, rainfall_anomaly_index double, "
            "drought_flag double, flood_flag double, baseline_yield double",
        ),
        detail=True,
    ).first()


def test_shape_of_a_prediction(spark):
    row = shaped(spark, 4000.0, 5100.0)
    assert row.pred_yield_kg_ha == 5173.3 and row.contains_point is False and row.change_vs_baseline_kg_ha == 273.3
    assert row.rainfall_anomaly_index == 0.42 and row.drought_flag is False and row.flood_flag is True
    row = shaped(spark, 4000.0, 5500.0)
    assert row.contains_point is True and row.interval_width_kg_ha == 1500.0
    row = shaped(spark, None, None)
    assert row.contains_point is None and row.interval_width_kg_ha is None


def test_coverage_is_rounded(spark):
    rows = [("v", "Wheat", 1.0, 0.0, 2.0 if i < 186 else 0.5) for i in range(236)]
    df = spark.createDataFrame(rows, "model_version string, crop string, actual double, lower double, upper double")
    assert tuple(views.crop_coverage(df, "v").first()) == ("Wheat", 236, 0.788)


def districts(spark):
    return spark.createDataFrame(
        [(1, "punjab/a", "Punjab", "a", 1.0, 1.0), (2, "punjab/b", "Punjab", "b", 1.0, 1.0), (3, "goa/c", "Goa", "c", 1.0, 1.0)],
        "district_id int, slug string, state string, district string, lat double, lon double",
    )


def test_watch_order(spark):
    events = spark.createDataFrame(
        [("r", 1, "Wheat", "watch", "", 10.0, 0.0, 0.0), ("r", 2, "Wheat", "watch", "", -200.0, 0.0, 0.0),
         ("r", 3, "Wheat", "urgent", "", None, 0.0, 0.0), ("r", 1, "Rice", "minor_change", "", 9.0, 0.0, 0.0)],
        "run_id string, district_id int, crop string, alert_level string, change_note string, yield_change double, "
        "rai_change double, severity_change double",
    )
    preds = spark.createDataFrame([("r", 2, "Wheat", 4000.04)], "run_id string, district_id int, crop string, pred_yield double")
    got = views.watch(events, preds, districts(spark)).collect()
    assert [(r.slug, r.alert_level) for r in got] == [
        ("goa/c", "urgent"), ("punjab/b", "watch"), ("punjab/a", "watch"), ("punjab/a", "minor_change"),
    ]
    assert got[1].pred_yield_kg_ha == 4000.0 and got[0].pred_yield_kg_ha is None
    assert views.watch(events, preds, districts(spark), "WATCH", "Wheat", "Punjab", 1, 1).first().slug == "punjab/a"
    assert {r.alert_level: r.n for r in views.watch_counts(events).collect()}["watch"] == 2


def test_risk_order_and_percent(spark):
    table = spark.createDataFrame(
        [("r", 1, 50.0, 10, 0.0, 1.0, 5, None, "insufficient_data", ""), ("r", 2, 50.0, 10, 100.0, 20.0, 5, -2.5, "high", ""),
         ("r", 3, 50.0, 10, None, 1.0, 5, -3.0, "high", "")],
        sc.SEASON_RISK,
    )
    got = views.risk(table, districts(spark)).collect()
    assert [r.slug for r in got] == ["goa/c", "punjab/b", "punjab/a"]
    assert [r.rainfall_vs_normal_pct for r in got] == [None, -50.0, None]


def test_state_filter_does_not_match_a_longer_name(spark):
    df = spark.createDataFrame([("goa/a",), ("goa-north/b",)], "slug string")
    assert [r.slug for r in views.in_state(df, "Goa").collect()] == ["goa/a"]
    assert views.equals_ignoring_case(df, "slug", "GOA/A").count() == 1 and views.filtered(df, slug=None).count() == 2


def test_site_views(spark):
    sites = views.sites(districts(spark), None, "district", "desc", 2, 1).collect()
    assert [r.district for r in sites] == ["b", "a"]
    hist = spark.createDataFrame([(1, "Wheat", "Rabi", y, 1.0, 2.0) for y in (2000, 2002)],
                                 "district_id int, crop string, season string, year int, yield_kg_ha double, area_ha double")
    assert tuple(views.coverage(hist).first()) == ("Wheat", "Rabi", 2000, 2002, 2)
    assert views.site_history(hist, 1, "Wheat").count() == 2 and views.live_crops(hist, 1).count() == 1


def test_streamed_documents_replace_earlier_days(spark, tmp_path):
    landing, table, state = tmp_path / "in", str(tmp_path / "daily"), str(tmp_path / "ck")
    landing.mkdir()
    (landing / "1.json").write_text(document("s", "d", {"PRECTOTCORR": {"20251231": 1.0, "20260101": -999.0}}))
    ingest.run_once(spark, str(landing), table, state)
    (landing / "2.json").write_text(document("s", "d", {"PRECTOTCORR": {"20260101": 4.0, "20260102": 5.0}}))
    ingest.run_once(spark, str(landing), table, state)
    ingest.run_once(spark, str(landing), table, state)
    got = {str(r.date): r.rainfall_mm for r in spark.read.parquet(table).collect()}
    assert got == {"2025-12-31": 1.0, "2026-01-01": 4.0, "2026-01-02": 5.0}


def weather_rows(spark, sites, first, last):
    days = spark.sql(f"SELECT explode(sequence(DATE '{first}', DATE '{last}')) AS date")
    places = spark.createDataFrame(sites, "state string, district string, k int").withColumn("j", F.lit(1))
    rows = days.withColumn("j", F.lit(1)).join(places, "j")
    noise = (F.abs(F.hash("date", "district")) % 100).cast("double")
    return rows.select(
        "state", "district", F.lit(1.0).alias("lat"), F.lit(1.0).alias("lon"), "date",
        F.when(noise > 60, noise / 10 + F.col("k")).otherwise(0.0).alias("rainfall_mm"),
        (28 + noise / 10).alias("temp_max_c"), (10 + noise / 20).alias("temp_min_c"), (20 + noise / 15).alias("temp_avg_c"),
        F.lit(50.0).alias("humidity_pct"), (15 + noise / 30).alias("solar_radiation"),
    )


def test_refresh_end_to_end(spark, tmp_path):
    from agropanel.operators import anomaly, weather

    names = [("Punjab", "Ropar" if i == 0 else f"site {i}", i) for i in range(12)]
    daily = weather_rows(spark, names, "2020-06-01", "2026-07-20").persist()
    seasonal = anomaly.rai_history(weather.seasonal(daily)).persist()
    yields = spark.createDataFrame(
        [(s, d, "Wheat", "Rabi", y, 4000.0 + 10 * k + 5 * y % 7, 100.0) for s, d, k in names for y in range(2020, 2026)],
        "state string, district string, crop string, season string, year int, yield_kg_ha double, area_ha double",
    )
    history = panel.merge_master(yields, seasonal).persist()
    sites = spark.createDataFrame(
        [(i + 1, f"punjab/{i}", s, "Rupnagar" if d == "Ropar" else d, 1.0, 1.0) for i, (s, d, _) in enumerate(names)], sc.SITES
    )
    inputs = rf.Inputs(daily, sites.select("state", "district").limit(0), history, seasonal, sites)
    features = ["nasa_rainfall_rabi", "rainfall_anomaly_index"]

    def score(level):
        def run(df):
            point = F.lit(4000.0) + F.coalesce("nasa_rainfall_rabi", F.lit(0.0)) * level
            return df.withColumn("pred_yield", point).withColumn("pred_lower", point - 100).withColumn("pred_upper", point + 100)
        return run

    def go(stamp, level):
        settings = rf.Settings(2025, 2026, 2020, "Wheat", "v1", "2026-07-22", stamp, f"2026-07-22 0{level}:00:00", features)
        return rf.refresh(spark, str(tmp_path), inputs, settings, score(level))

    run, status = go("20260722_010000", 1)
    manifest = spark.read.schema(sc.RUNS).parquet(f"{tmp_path}/runs")
    checks = {r.check_name: r.status for r in spark.read.parquet(f"{tmp_path}/sanity_checks").collect()}
    assert set(checks) == {"schema_consistency", "classification_diversity", "feature_ranges", "output_files_present",
                           "weather_fetch_completeness"}
    assert status in ("ok", "flagged")
    predictions = spark.read.parquet(f"{tmp_path}/predictions")
    assert predictions.count() == 12 and predictions.where("district_id = 1").first().features["nasa_rainfall_rabi"] > 0
    events = spark.read.parquet(f"{tmp_path}/watch_events")
    assert {r.alert_level for r in events.collect()} == {"baseline"}
    second, _ = go("20260722_020000", 2)
    events = spark.read.parquet(f"{tmp_path}/watch_events").where(F.col("run_id") == second)
    assert events.count() == 12 and "baseline" not in {r.alert_level for r in events.collect()}
    assert spark.read.parquet(f"{tmp_path}/snapshots").count() == 24
    good, bad = score(3), score(3)
    good.features, bad.features = features, features[:1]
    for stamp, run, want in (("20260722_040000", good, "pass"), ("20260722_050000", bad, "fail")):
        settings = rf.Settings(2025, 2026, 2020, "Wheat", "v1", "2026-07-22", stamp, "2026-07-22 05:00:00", features)
        name, _ = rf.refresh(spark, str(tmp_path), inputs, settings, run)
        found = spark.read.parquet(f"{tmp_path}/sanity_checks").where(F.col("run_id") == name)
        assert {r.status for r in found.where("check_name = 'schema_consistency'").collect()} == {want}
    fewer = rf.Inputs(daily, inputs.expected_sites, history, seasonal, sites.where("district_id > 1"))
    with pytest.raises(RuntimeError, match="matched a known site"):
        rf.refresh(spark, str(tmp_path), fewer, settings, good)
    if status == "ok":
        assert views.latest_run(spark.read.schema(sc.RUNS).parquet(f"{tmp_path}/runs")).count() == 1
    assert manifest.where("status = 'failed'").count() == 0


def test_payload_dates_are_matched_without_walking(spark):
    """A document's work grows with its dates: 40,000 of them, in six variables and an unknown one, with gaps and a variable left out."""
    import datetime as dt
    import time

    days = [(dt.date(1900, 1, 1) + dt.timedelta(i)).strftime("%Y%m%d") for i in range(40_000)]
    codes = list(readers.PAYLOAD_VARIABLES)
    parameter = {code: {d: float(i) for i, d in enumerate(days) if i % (k + 1) == 0} for k, code in enumerate(codes[:-1])}
    parameter["OTHER"] = {"20300101": 1.0, "no date": 2.0}
    schema = "state string, district string, lat double, lon double, properties struct<parameter: map<string, map<string, double>>>"
    documents = spark.createDataFrame([("S", "a", 1.0, 2.0, {"parameter": parameter}), ("S", "b", 1.0, 2.0, None)], schema).cache()
    assert documents.count() == 2
    begun = time.monotonic()
    rows = {r["date"].strftime("%Y%m%d"): r for r in readers.explode_payload(documents).collect()}
    assert time.monotonic() - begun < 15
    assert set(rows) == {*days, "20300101"}
    names = list(readers.PAYLOAD_VARIABLES.values())
    for i, d in enumerate(days):
        assert [rows[d][c] for c in names] == [float(i) if i % (k + 1) == 0 else None for k in range(5)] + [None]
    assert [rows["20300101"][c] for c in names] == [None] * 6
