"""Retention with interruptions, deltas between runs, and the weekly stream with late and repeated rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from agropanel import schema as sc
from agropanel.plans import views
from agropanel.sources import readers, retention
from agropanel.streaming import weekly


@pytest.fixture
def store(spark, tmp_path):
    """Five finished runs a hundred days apart, and one that still runs; two rows each."""
    path = str(tmp_path / "predictions")
    rows = [(f"2001-0{run}", i, "Rice", "Kharif", 1.0 * i, None, None, 2000, "b", {"x": 1.0, "y": None}, {"x": 0.5})
            for run in range(1, 7) for i in range(2)]
    spark.createDataFrame(rows, sc.PREDICTIONS).write.partitionBy("run_id").parquet(path)
    day = dt.datetime(2001, 1, 1)
    events = [(f"2001-0{run}", "ok", True, day + dt.timedelta(100 * run), day + dt.timedelta(100 * run)) for run in range(1, 6)]
    events.append(("2001-06", "running", None, day, None))
    return path, spark.createDataFrame(events, "run_id string, status string, gate_passed boolean, started_at timestamp, finished_at timestamp")


def _held(spark, path):
    table = readers.read_table(spark, path, sc.PREDICTIONS)
    found = table.groupBy("run_id").agg(F.count(F.lit(1)), F.count("attributions"), F.count("features")).collect()
    return {r[0]: tuple(r)[1:] for r in found}


WANTED = {"2001-01": (2, 0, 0), "2001-02": (2, 0, 0), "2001-03": (2, 0, 2), "2001-04": (2, 2, 2), "2001-05": (2, 2, 2), "2001-06": (2, 2, 2)}
AS_OF = "2002-05-01"  # 385, 285, 185 and fewer days after the runs


def test_trim_keeps_rows_and_repeats(spark, store):
    path, events = store
    assert retention.trim(spark, path, events, AS_OF, keep=2, feature_days=190) == 3
    assert _held(spark, path) == WANTED
    assert retention.trim(spark, path, events, AS_OF, keep=2, feature_days=190) == 0
    # a run that grows old later loses its features then
    assert retention.trim(spark, path, events, "2002-06-01", keep=2, feature_days=190) == 1
    assert _held(spark, path)["2001-03"] == (2, 0, 0)
    assert readers.read_table(spark, path, sc.PREDICTIONS).where("pred_yield is null").count() == 0


@pytest.mark.parametrize("at", ["staged", "set aside", "half switched"])
def test_interrupted_trim(spark, store, monkeypatch, at, tmp_path):
    path, events = store
    true_switch = retention._switch

    def broken(spark, path, staged, aside):
        if at == "staged":
            raise RuntimeError("lost")
        root = tmp_path / "predictions"
        if at == "half switched":
            # the first partition is switched whole
            hidden = root / "_trim-later"
            hidden.mkdir()
            runs = sorted(p for p in (tmp_path / "predictions" / staged.rsplit("/", 1)[1]).iterdir() if p.name.startswith("run_id="))
            for p in runs[1:]:
                p.rename(hidden / p.name)
            true_switch(spark, path, staged, aside)
        last = root / "run_id=2001-03"
        (root / aside.rsplit("/", 1)[1]).mkdir(exist_ok=True)
        last.rename(root / aside.rsplit("/", 1)[1] / last.name)
        raise RuntimeError("lost")

    monkeypatch.setattr(retention, "_switch", broken)
    with pytest.raises(RuntimeError, match="lost"):
        retention.trim(spark, path, events, AS_OF, keep=2, feature_days=190)
    monkeypatch.undo()
    assert retention.recover(spark, path) == (0 if at == "staged" else 1)
    assert {k: v[0] for k, v in _held(spark, path).items()} == dict.fromkeys(WANTED, 2)
    retention.trim(spark, path, events, AS_OF, keep=2, feature_days=190)
    assert _held(spark, path) == WANTED
    assert not [p.name for p in (tmp_path / "predictions").iterdir() if p.name.startswith(("_trim", "_aside"))]


def test_feature_deltas(spark):
    rows = [
        ("a", 1, "R", "K", {"x": 10.0, "y": 1.0, "z": 5.0, "gone": 3.0}), ("b", 1, "R", "K", {"x": 11.0, "y": 2.0, "z": 5.0, "new": 0.0}),
        ("b", 2, "R", "K", {"x": 1.0}), ("a", 3, "R", "K", None), ("b", 3, "R", "K", None), ("a", 4, "R", None, {"x": 0.0}), ("b", 4, "R", None, {"x": -2.0}),
    ]
    table = spark.createDataFrame(rows, "run_id string, district_id int, crop string, season string, features map<string,double>")
    out = views.feature_deltas(table, "a", "b", 3).orderBy("district_id", "rank").collect()
    assert [(r["district_id"], r["feature"], r["before"], r["after"], r["delta"], r["rank"]) for r in out] == [
        (1, "gone", 3.0, None, None, 1), (1, "new", None, 0.0, None, 2), (1, "y", 1.0, 2.0, 1.0, 3), (2, "x", None, 1.0, None, 1), (4, "x", 0.0, -2.0, -2.0, 1)]


def _land(spark, path, days):
    rows = [("S", "a", 1.0, 2.0, dt.date(2001, 1, 4) + dt.timedelta(d), v, *[None] * 5) for d, v in days]
    spark.createDataFrame(rows, sc.DAILY).coalesce(1).write.mode("append").parquet(path)


def test_weekly_stream_over_restarts(spark, tmp_path):
    """2001-01-04 begins a week. Late days are dropped, repeated ones count once, and a restart goes on where it stopped."""
    landed, table, checkpoint = (str(tmp_path / n) for n in ("landed", "weeks", "stream"))

    def closed():
        return {(r["week_start"] - dt.date(2001, 1, 4)).days: (r["days"], r["rainfall_mm"]) for r in weekly.closed_weeks(spark, table).collect()}

    _land(spark, landed, [(d, 1.0) for d in range(21)] + [(3, 1.0)])
    weekly.run_once(spark, landed, table, checkpoint)
    assert closed() == {0: (7, 7.0)}
    _land(spark, landed, [(1, 100.0), (20, 1.0), *[(d, 2.0) for d in range(21, 28)]])
    weekly.run_once(spark, landed, table, checkpoint)
    assert closed() == {0: (7, 7.0), 7: (7, 7.0)}
    _land(spark, landed, [(60, None)])
    weekly.run_once(spark, landed, table, checkpoint)
    assert closed() == {0: (7, 7.0), 7: (7, 7.0), 14: (7, 7.0), 21: (7, 14.0)}


def test_weekly_stream_keeps_one_state_row_for_each_site(spark, tmp_path):
    """The state does not grow with the days; a day known first as null stays so, null sites are a site, null days are dropped."""
    landed, table, checkpoint = (str(tmp_path / n) for n in ("landed", "weeks", "stream"))
    rows = [("S", site, 1.0, 2.0, dt.date(2001, 1, 4) + dt.timedelta(d), None if d < 7 else 1.0, *[None] * 5) for site in ("a", "b", None) for d in range(70)]
    rows.append(("S", "a", 1.0, 2.0, None, 9.0, *[None] * 5))
    spark.createDataFrame(rows, sc.DAILY).coalesce(1).write.parquet(landed)
    weekly.run_once(spark, landed, table, checkpoint)
    assert spark.read.format("statestore").load(checkpoint).count() == 3
    assert {(r["district"], r["days"], r["rainfall_mm"]) for r in weekly.closed_weeks(spark, table).collect()} == {
        (site, *found) for site in ("a", "b", None) for found in ((0, None), (7, 7.0))}
    assert weekly.closed_weeks(spark, table).count() == 3 * 8
    # days of the open weeks come again, one site for the first time
    _land(spark, landed, [(d, 5.0) for d in range(61, 80)])
    weekly.run_once(spark, landed, table, checkpoint)
    assert {(r["week_start"], r["days"], r["rainfall_mm"]) for r in weekly.closed_weeks(spark, table).where("district = 'a'").collect()} >= {
        (dt.date(2001, 1, 4) + dt.timedelta(56), 7, 7.0)}


def test_a_replayed_batch_replaces_its_rows(spark, tmp_path):
    table = str(tmp_path / "weeks")
    batch = spark.createDataFrame([("S", "a", dt.date(2001, 1, 4), 7, 1.0)], "state string, district string, week_start date, days long, rainfall_mm double")
    for epoch in (0, 1, 1):
        weekly._write(batch, epoch, table)
    assert weekly.closed_weeks(spark, table).count() == 2
