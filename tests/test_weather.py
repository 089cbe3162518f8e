"""Seasonal windows and agronomic features on blocks small enough to check by hand."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from agropanel.functions import seasons as S
from agropanel.operators import anomaly, gate, weather

RAIN = [0, 0, 0, 5, 0, 0, 10, 0, 0, 0]
SCHEMA = (
    "state string, district string, date date, rainfall_mm double, temp_max_c double, temp_min_c double, "
    "temp_avg_c double, humidity_pct double, solar_radiation double"
)


def days(spark, rains, start=dt.date(2001, 11, 1), district="d", skip=()):
    rows = [
        ("s", district, start + dt.timedelta(i), None if r is None else float(r), 30.0, 10.0, 20.0, 50.0, 20.0)
        for i, r in enumerate(rains) if i not in skip
    ]
    return spark.createDataFrame(rows, SCHEMA)


def block(spark, rains, **kw):
    return weather.block_features(days(spark, rains, **kw), ["district"], "rabi").first()


def test_golden_block(spark):
    row = block(spark, RAIN)
    assert row.gdd_rabi == 100.0
    assert row.max_dry_streak_rabi == 3
    assert row.rainfall_cv_rabi == pytest.approx(2.249828525701843)
    assert row.water_balance_rabi == pytest.approx(-62.76149998553268)


def test_prefix_names(spark):
    out = weather.block_features(days(spark, RAIN), ["district"], "rabi", "current_")
    assert out.columns[1:] == [
        "current_gdd_rabi", "current_max_dry_streak_rabi", "current_rainfall_cv_rabi", "current_water_balance_rabi",
    ]


def test_all_wet_and_all_dry(spark):
    assert block(spark, [5] * 10).max_dry_streak_rabi == 0
    dry = block(spark, [0] * 10)
    assert dry.max_dry_streak_rabi == 10 and dry.rainfall_cv_rabi is None


def test_unknown_day_breaks_a_run_but_an_absent_day_does_not(spark):
    assert block(spark, [0, 0, None, 0, 0, 0]).max_dry_streak_rabi == 3
    assert block(spark, [0, 0, 9, 0, 0, 0], skip={2}).max_dry_streak_rabi == 5


def longest_run(rains):
    best = run = 0
    for r in rains:
        run = run + 1 if r is not None and r < 1 else 0
        best = max(best, run)
    return best


def test_runs_against_plain_code_over_word_borders(spark):
    rng = random.Random(7)
    frames, want = None, {}
    for n in (1, 29, 30, 31, 60, 61, 150, 152):
        for p in (0.3, 0.9, 0.99):
            rains = [rng.choices([0.0, 3.0, None], [p, (1 - p) * 0.8, (1 - p) * 0.2])[0] for _ in range(n)]
            skip = {i for i in range(n) if rng.random() < 0.1}
            if len(skip) == n:
                skip = set()
            name = f"{n}-{p}"
            want[name] = longest_run([r for i, r in enumerate(rains) if i not in skip])
            frame = days(spark, rains, district=name, skip=skip)
            frames = frame if frames is None else frames.union(frame)
    got = weather.block_features(frames, ["district"], "rabi").collect()
    assert {r.district: r.max_dry_streak_rabi for r in got} == want


def test_a_run_may_be_longer_than_a_season_or_a_year(spark):
    assert block(spark, [0] * 500).max_dry_streak_rabi == 500
    assert block(spark, [0] * 500, start=dt.date(1969, 7, 1)).max_dry_streak_rabi == 500
    assert block(spark, [0] * 200 + [4] + [0] * 900 + [4], start=dt.date(2001, 4, 3)).max_dry_streak_rabi == 900


@pytest.mark.parametrize(
    "date, season, year",
    [
        ("2001-11-15", "Rabi", 2001), ("2001-12-31", "Rabi", 2001), ("2002-01-01", "Rabi", 2001),
        ("2002-02-28", "Rabi", 2001), ("2002-03-31", "Rabi", 2001), ("2002-04-01", None, 2001),
        ("2002-05-31", None, 2001), ("2002-06-01", "Kharif", 2002), ("2002-10-31", "Kharif", 2002),
        ("2010-11-01", "Rabi", 2010), ("2011-01-10", "Rabi", 2010), ("2010-06-10", "Kharif", 2010),
    ],
)
def test_crop_year(spark, date, season, year):
    d = F.lit(date).cast("date")
    row = spark.range(1).select(
        S.season_name(d).alias("s"), S.crop_year(d).alias("y"), S.kharif_year(d).alias("k"), S.rabi_year(d).alias("r")
    ).first()
    assert (row.s, row.y) == (season, year)
    assert row.k == (year if season == "Kharif" else None)
    assert row.r == (year if season == "Rabi" else None)


@pytest.mark.parametrize("date, offset", [("2026-06-01", 0), ("2026-06-23", 22), ("2026-07-07", 36), ("2026-10-31", 152)])
def test_season_day(spark, date, offset):
    assert spark.range(1).select(S.season_day(F.lit(date).cast("date"))).first()[0] == offset


def test_labels_and_age(spark):
    d = F.lit("2026-07-07").cast("date")
    row = spark.range(1).select(
        S.window_label(d).alias("w"), S.season_label(F.lit("2026-04-02").cast("date")).alias("i"),
        S.request_end(F.lit("2026-07-10").cast("date")).alias("e"),
        S.is_stale(d, F.lit("2026-07-14").cast("date")).alias("fresh"),
        S.is_stale(d, F.lit("2026-07-15").cast("date")).alias("stale"),
    ).first()
    assert row.w == "Jun 1–Jul 07" and row.i == "Inter-season" and row.e == dt.date(2026, 7, 7)
    assert row.fresh is False and row.stale is True


def test_seasonal_blocks_follow_the_crop_year(spark):
    start = dt.date(2001, 6, 1)
    daily = days(spark, [1.0] * 365, start=start)
    row = weather.seasonal(daily).where("year = 2001").first()
    assert row.nasa_rainfall_kharif == 153 and row.nasa_rainfall_rabi == 151 and row.nasa_rainfall_annual == 365
    assert row.rabi_days_observed == 151 and row.rabi_season_partial == 0
    assert weather.seasonal(daily).count() == 1


def test_partial_winter_and_missing_monsoon(spark):
    daily = days(spark, [1.0] * 139, start=dt.date(2001, 11, 1))
    row = weather.seasonal(daily).first()
    assert row.rabi_season_partial == 1 and row.nasa_rainfall_kharif is None and row.gdd_kharif is None


def test_empty_total_is_zero_in_history_but_null_live(spark):
    daily = days(spark, [None] * 20, start=dt.date(2001, 11, 1))
    assert weather.seasonal(daily).first().nasa_rainfall_rabi == 0.0
    assert weather.current_season(daily, 2001).first().current_rabi_rainfall is None


def test_live_kharif_scales_rain_before_the_features(spark):
    rains = [0.9] * 100 + [4.0] * 53
    daily = days(spark, rains, start=dt.date(2026, 6, 1))
    scale = spark.createDataFrame([("s", "d", 2.0, 100.0)], "state string, district string, rain_scale double, live_mean double")
    row = weather.live_kharif(daily, 2026, scale).first()
    assert row.live_rain_raw == pytest.approx(302.0) and row.cur_rain_kharif == pytest.approx(604.0)
    assert row.cur_max_dry_streak_kharif == 0  # 0.9 mm doubles past the dry limit
    assert row.rain_departure_pct == pytest.approx(202.0)


def test_live_kharif_without_a_factor_has_no_features_but_keeps_the_site(spark):
    daily = days(spark, [1.0] * 10, start=dt.date(2026, 6, 1))
    empty = spark.createDataFrame([], "state string, district string, rain_scale double, live_mean double")
    row = weather.live_kharif(daily, 2026, empty).first()
    assert row.kharif_days_observed == 10 and row.cur_gdd_kharif is None and row.cur_rain_kharif is None


def test_rain_scale_needs_complete_seasons(spark):
    whole = None
    for year in range(2020, 2024):
        part = days(spark, [2.0] * 153, start=dt.date(year, 6, 1))
        whole = part if whole is None else whole.union(part)
    short = days(spark, [9.0] * 100, start=dt.date(2024, 6, 1))
    history = spark.createDataFrame([("s", "d", 612.0)], "state string, district string, nasa_rainfall_kharif double")
    row = anomaly.rain_scale(whole.union(short), history, 2020, 2025).first()
    assert row.live_mean == pytest.approx(306.0) and row.rain_scale == pytest.approx(2.0)
    assert anomaly.rain_scale(whole, history, 2021, 2025).count() == 0
    seasons = weather.seasonal(whole.union(short), known_days=True)
    assert tuple(anomaly.rain_scale(seasons, history, 2020, 2025).first()) == tuple(row)


def test_rai_flags_of_null_and_zero_spread(spark):
    seasonal = spark.createDataFrame(
        [("s", "a", 2000, 10.0), ("s", "a", 2001, 10.0), ("s", "b", 2000, 10.0)],
        "state string, district string, year int, nasa_rainfall_annual double",
    )
    for row in anomaly.rai_history(seasonal).collect():
        assert row.rainfall_anomaly_index is None and row.drought_flag == 0 and row.flood_flag == 0


def test_too_many_sites_without_a_baseline_is_an_error(spark):
    live = spark.createDataFrame([("s", "a", 5.0), ("s", "b", 6.0)], "state string, district string, cur_rain_kharif double")
    history = spark.createDataFrame(
        [("s", "a", 5.0), ("s", "a", 7.0)], "state string, district string, nasa_rainfall_kharif double"
    )
    with pytest.raises(Exception, match="too many sites"):
        anomaly.live_kharif_rai(live, history).collect()
    assert [r.district for r in anomaly.live_kharif_rai(live, history, 0.6).collect()] == ["a"]


def test_season_to_date_uses_the_same_window(spark):
    frames = days(spark, [1.0] * 20 + [None] * 5, start=dt.date(2026, 6, 1))
    for i, year in enumerate(range(2020, 2026)):
        frames = frames.union(days(spark, [1.0 + i] * 153, start=dt.date(year, 6, 1)))
    row = anomaly.season_to_date(frames, 2026, 2020, as_of="2026-06-25").first()
    assert row.days_elapsed == 20 and row.actual_partial_rainfall_mm == 20.0
    assert row.window_hist_mean == pytest.approx(70.0) and row.n_years == 6
    assert row.kharif_risk_level == "high" and "5 days old" in row.risk_explanation


def test_season_to_date_with_little_history(spark):
    frames = days(spark, [1.0] * 20, start=dt.date(2026, 6, 1))
    for year in (2024, 2025):
        frames = frames.union(days(spark, [2.0] * 153, start=dt.date(year, 6, 1)))
    assert anomaly.season_to_date(frames, 2026, 2020).first().kharif_risk_level == "insufficient_data"


def test_duplicate_days_are_counted(spark):
    daily = days(spark, [1.0, 2.0])
    row = gate.duplicate_keys(daily.union(daily.limit(1)), ["state", "district", "date"]).first()
    assert (row.n_keys, row.n_rows) == (1, 2)
