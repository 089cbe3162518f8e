"""Folded scenarios against the same adjustments applied to the daily rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from agropanel import schema as sc
from agropanel.functions import seasons as S
from agropanel.operators import scenario, weather
from agropanel.operators import season_fold as sf


@pytest.fixture(scope="module")
def daily(spark):
    rng, rows = random.Random(3), []
    for site in "abc":
        for i in range(800):
            if rng.random() < 0.05:
                continue
            low = rng.uniform(-2, 25)
            high = low + rng.uniform(-1, 18)
            rain = None if rng.random() < 0.04 else rng.choice([0.0, 0.0, 0.9, 1.3, 4.0, 30.0])
            mean = None if rng.random() < 0.03 else (low + high) / 2
            rows.append(("S", site, 1.0, 2.0, dt.date(2001, 6, 1) + dt.timedelta(i), rain, high, low, mean, 50.0, 12.0))
    rows += [("S", "dry", 1.0, 2.0, dt.date(2001, 7, d), None, None, None, None, None, None) for d in range(1, 20)]
    rows += [("S", "spring", 1.0, 2.0, dt.date(2001, 4, d), 1.0, 1.0, 1.0, 1.0, 1.0, 1.0) for d in range(1, 20)]
    return spark.createDataFrame(rows, sc.DAILY).cache()


CASES = [
    sf.Adjustment(), sf.Adjustment(rain_scale_pct=-30), sf.Adjustment(temp_shift_c=2.5), sf.Adjustment(dry_spell_days=20, dry_spell_start=15),
    sf.Adjustment(heatwave_days=10, heatwave_start=5, heatwave_delta_c=6),
    sf.Adjustment(rain_scale_pct=40, dry_spell_days=12, dry_spell_start=60, temp_shift_c=-1, heatwave_days=6, heatwave_start=140, heatwave_delta_c=3),
]


def _moved(daily, season, a):
    """The same scenario on the rows of the season only."""
    member = sf.MEMBERS[season]("date")
    inside, rest = daily.where(member), daily.where(~member)
    days = scenario.dry_spell(scenario.scale_rain(inside, a.rain_scale_pct), S.block_day("date"), a.dry_spell_start, int(a.dry_spell_days))
    days = scenario.heatwave(scenario.shift_temperature(days, a.temp_shift_c), S.block_day("date"), a.heatwave_start, int(a.heatwave_days), a.heatwave_delta_c)
    return weather.seasonal(days.unionByName(rest))


@pytest.mark.parametrize("season", ["kharif", "rabi"])
def test_fold_is_the_scenario_on_daily_rows(daily, season):
    names = sf.feature_names(season)
    found = sf.scenarios(sf.season_blocks(daily, season), season, CASES)
    got = {(r["district"], r["year"], r["scenario"]): [r[c] for c in names] for r in found.collect()}
    wanted = {}
    for i, a in enumerate(CASES):
        rows = _moved(daily, season, a).where(F.col(f"nasa_rainfall_{season}").isNotNull())
        wanted |= {(r["district"], r["year"], i): [r[c] for c in names] for r in rows.collect()}
    assert set(got) == set(wanted) and len(got) >= 6 * len(CASES)
    for key, values in wanted.items():
        assert [x is None for x in got[key]] == [x is None for x in values], (key, names)
        assert [x or 0.0 for x in got[key]] == pytest.approx([x or 0.0 for x in values], rel=1e-9, abs=1e-9), (key, names)


def test_no_scenario_and_no_day(daily):
    blocks = sf.season_blocks(daily, "kharif")
    assert sf.scenarios(blocks, "kharif", []).count() == 0
    assert sf.season_blocks(daily.limit(0), "rabi").count() == 0
    assert blocks.where("district = 'spring'").count() == 0


def test_uniform_rain_leaves_variation(daily):
    rows = sf.scenarios(sf.season_blocks(daily, "kharif").where("district = 'a'"), "kharif", [sf.Adjustment(), sf.Adjustment(rain_scale_pct=50)])
    one, two = (rows.where(F.col("scenario") == i).orderBy("year").collect() for i in (0, 1))
    for a, b in zip(one, two, strict=True):
        assert b["rainfall_cv_kharif"] == pytest.approx(a["rainfall_cv_kharif"]) and b["nasa_rainfall_kharif"] == pytest.approx(a["nasa_rainfall_kharif"] * 1.5)


def test_inputs_move_with_their_own_parameters(daily):
    blocks = sf.season_blocks(daily, "kharif").withColumns({"irrigation_pct": F.lit(90.0), "nitrogen_per_ha": F.lit(10.0)})
    row = sf.scenarios(blocks, "kharif", [sf.Adjustment(irrigation_pct_delta=20, nitrogen_pct_delta=-50)]).first()
    assert (row["irrigation_pct"], row["nitrogen_per_ha"]) == (100.0, 5.0)


def test_bounds_and_cases():
    moved, names = sf.Adjustment(rain_scale_pct=-75, temp_shift_c=2).bounded()
    assert moved == sf.Adjustment(rain_scale_pct=-60, temp_shift_c=2) and names == ("rain_scale_pct",)
    sides = sf.sensitivity_cases(steps={"dry_spell": {"dry_spell_days": 14.0, "dry_spell_start": 40}})
    assert [(s, a.dry_spell_days, a.dry_spell_start) for _, s, a in sides] == [("low", 0.0, 40), ("high", 14.0, 40)]
    assert len(sf.crossed(sf.Adjustment(), ("rain_scale_pct", range(15)), ("temp_shift_c", range(15)))) == 225
    with pytest.raises(ValueError, match="at most"):
        sf.crossed(sf.Adjustment(), ("rain_scale_pct", range(16)), ("temp_shift_c", [0]))


def test_equal_swings_rank_by_name(spark):
    cases = [("b", "low", None), ("b", "high", None), ("a", "low", None), ("a", "high", None), ("c", "low", None), ("c", "high", None)]
    rows = spark.createDataFrame([("x", i, float(d)) for i, d in enumerate([-1, 1, 1, -1, 0, 5])], "k string, scenario int, delta double")
    assert [(r["operator"], r["rank"]) for r in sf.ranked(rows, cases, ["k"]).orderBy("rank").collect()] == [("c", 1), ("a", 2), ("b", 3)]


def test_blocks_are_folded_many_at_once(spark):
    """More blocks than one array holds, empty and null ones between: each block's totals are its own, and the days are sent once."""
    kind = "k int, days array<struct<day:int,rainfall_mm:double,temp_max_c:double,temp_min_c:double,temp_avg_c:double,solar_radiation:double>>"
    rows = []
    for k in range(2 * sf.BLOCKS + 7):
        days = [(d, None if (k + d) % 7 == 3 else float((k * d) % 4), 36.0, 1.0, None if d % 3 else 20.0, 10.0) for d in range(k % 5)]
        rows.append((k, None if k % 11 == 10 else days))
    table = spark.createDataFrame(rows, kind).coalesce(1)
    found = table.withColumn("t", sf._totals([sf.Adjustment(), sf.Adjustment(rain_scale_pct=100.0)]))
    for r in found.collect():
        if r["days"] is None:
            assert r["t"] is None
            continue
        for t, factor in zip(r["t"], (1, 2), strict=True):
            rain = [None if d["rainfall_mm"] is None else d["rainfall_mm"] * factor for d in r["days"]]
            known = [x for x in rain if x is not None]
            runs, now = [0], 0
            for x in rain:
                now = now + 1 if x is not None and x < 1 else 0
                runs.append(now)
            assert (t["rain_n"], t["rain"], t["longest"], t["heat"], t["frost"]) == (len(known), sum(known), max(runs), len(rain), len(rain))
            assert t["tavg_n"] == len(rain[::3]) and t["gdd"] == 10.0 * len(rain[::3])
