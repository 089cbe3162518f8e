"""Registered queries on scenarios of a season's days: response curve, grid, ranked operators and map."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agropanel.operators import scenario
from agropanel.operators import season_fold as sf
from agropanel.plans import oracle as o
from agropanel.plans.registry import register, tidy
from agropanel.sources import fixtures as fx

SITE = ["state", "district"]
_BASE = sf.Adjustment(temp_shift_c=1.0, dry_spell_days=10, dry_spell_start=25)
_CURVE = sf.varied(_BASE, "rain_scale_pct", -60.0, 100.0, 9)
_GRID = sf.crossed(sf.Adjustment(), ("rain_scale_pct", (-40.0, -20.0, 0.0, 20.0, 40.0)), ("temp_shift_c", (-2.0, 0.0, 2.0, 4.0)))
_SPELLS = {"dry_spell": {"dry_spell_days": 14.0, "dry_spell_start": 40}, "heatwave": {"heatwave_days": 7.0, "heatwave_delta_c": 4.0, "heatwave_start": 30}}
_SIDES = sf.sensitivity_cases(steps={k: sf.STEPS[k] for k in ("rain_scale_pct", "temp_shift_c")} | _SPELLS)
_SERVED = sf.Adjustment(rain_scale_pct=-75.0, temp_shift_c=1.5, heatwave_days=5, heatwave_start=10, heatwave_delta_c=4.0).bounded()[0]


def response(rows: DataFrame) -> DataFrame:
    """A fixed linear answer to every feature of the monsoon season, so that the result can be checked."""
    return rows.withColumn(
        "scenario_yield",
        20000 + F.col("nasa_rainfall_kharif") * 2 - F.col("nasa_temp_avg_kharif") * 30 - F.col("nasa_temp_max_kharif") * 11 + F.col("gdd_kharif") * 0.5
        - F.col("max_dry_streak_kharif") * 7 + F.coalesce("rainfall_cv_kharif", F.lit(0.0)) * 10 + F.col("water_balance_kharif") * 0.25
        + F.col("nasa_rainfall_annual") * 0.125 - F.col("heat_stress_days") * 3 - F.col("frost_risk_days") * 2,
    )


def cases_sql(cases) -> str:
    """CTEs up to `moved`: features and yield of every site, crop year and scenario; scenario -1 is the season as it was."""
    rows = ", ".join(
        f"({i}, {', '.join(f'{float(v)!r}::DOUBLE' for v in asdict(a).values())})" for i, a in enumerate([sf.Adjustment(), *cases], -1)
    )
    return (
        o.DAILY
        + f""",
    cases AS (SELECT * FROM (VALUES {rows}) c(scenario, {', '.join(sf.PARAMETERS)})),
    days AS (
      SELECT state, district, cy, scenario, date, solar_radiation, temp_min_c + temp_shift_c AS tmin,
        CASE WHEN day >= dry_spell_start AND day < dry_spell_start + dry_spell_days THEN 0 ELSE rainfall_mm * (1 + rain_scale_pct / 100) END AS rain,
        temp_max_c + temp_shift_c + CASE WHEN day >= heatwave_start AND day < heatwave_start + heatwave_days THEN heatwave_delta_c ELSE 0 END AS tmax,
        temp_avg_c + temp_shift_c + CASE WHEN day >= heatwave_start AND day < heatwave_start + heatwave_days THEN heatwave_delta_c ELSE 0 END AS tavg
      FROM (SELECT *, date - make_date(y, 6, 1) AS day FROM daily WHERE season = 'Kharif'), cases),
    numbered AS (
      SELECT state, district, cy, scenario, date - (row_number() OVER (PARTITION BY state, district, cy, scenario ORDER BY date))::INT AS island
      FROM days WHERE rain < 1),
    runs AS (
      SELECT state, district, cy, scenario, max(n) AS streak
      FROM (SELECT state, district, cy, scenario, island, count(*) AS n FROM numbered GROUP BY ALL) GROUP BY ALL),
    rest AS (
      SELECT state, district, cy, coalesce(sum(rainfall_mm), 0) AS rain_rest, count(*) FILTER (WHERE temp_max_c > 35) AS heat_rest,
        count(*) FILTER (WHERE temp_min_c < 2) AS frost_rest
      FROM daily WHERE season IS NULL OR season <> 'Kharif' GROUP BY ALL),
    sums AS (
      SELECT state, district, cy, scenario, sum(rain) AS rain, avg(tavg) AS tavg, avg(tmax) AS tmax, sum(greatest(tavg - 10, 0)) AS gdd,
        CASE WHEN avg(rain) > 0 THEN stddev_samp(rain) / avg(rain) END AS cv,
        sum(rain) - sum(0.0023::DOUBLE * solar_radiation * (tavg + 17.8::DOUBLE) * sqrt(greatest(tmax - tmin, 0))) AS balance,
        count(*) FILTER (WHERE tmax > 35) AS heat, count(*) FILTER (WHERE tmin < 2) AS frost
      FROM days GROUP BY ALL),
    seasons AS (
      SELECT s.* EXCLUDE (heat, frost), coalesce(streak, 0) AS streak, rain + coalesce(rain_rest, 0) AS annual,
        heat + coalesce(heat_rest, 0) AS heat, frost + coalesce(frost_rest, 0) AS frost
      FROM sums s LEFT JOIN runs USING (state, district, cy, scenario) LEFT JOIN rest USING (state, district, cy)),
    answered AS (
      SELECT *, 20000 + rain * 2 - tavg * 30 - tmax * 11 + gdd * 0.5 - streak * 7 + coalesce(cv, 0) * 10 + balance * 0.25 + annual * 0.125
        - heat * 3 - frost * 2 AS answer
      FROM seasons),
    moved AS (
      SELECT a.*, b.answer AS pred_yield, a.answer - b.answer AS delta, cases.* EXCLUDE (scenario)
      FROM answered a JOIN answered b USING (state, district, cy) JOIN cases ON cases.scenario = a.scenario
      WHERE b.scenario = -1 AND a.scenario >= 0)"""
    )


@register(
    "scenario_sweep",
    o.query(
        cases_sql(_CURVE),
        f"""SELECT state, district, cy::INTEGER AS year, {o.num('rain_scale_pct', 3)}, {o.num('rain', 3, 'nasa_rainfall_kharif')}, streak::BIGINT AS max_dry_streak_kharif,
        {o.num('cv', 3, 'rainfall_cv_kharif')}, {o.num('annual', 3, 'nasa_rainfall_annual')}, {o.num('pred_yield', 3)}, {o.num('answer', 3, 'scenario_yield')}
        FROM moved""",
    ),
)
def scenario_sweep(spark, sf_dir):
    """Response curve to the season's rain, on top of a warmer season with a dry spell, at every site and crop year."""
    rows = sf.scored(fx.daily(spark, sf_dir), "kharif", _CURVE, response)
    features = ["nasa_rainfall_kharif", "max_dry_streak_kharif", "rainfall_cv_kharif", "nasa_rainfall_annual"]
    return tidy(rows.select(*SITE, "year", "rain_scale_pct", *features, "pred_yield", "scenario_yield"), 3)


@register(
    "scenario_heatmap",
    o.query(
        cases_sql(_GRID),
        f"""SELECT state, district, cy::INTEGER AS year, {o.nums('rain_scale_pct', 'temp_shift_c', digits=3)}, {o.num('gdd', 3, 'gdd_kharif')}, heat::BIGINT AS heat_stress_days,
        {o.num('balance', 3, 'water_balance_kharif')}, {o.num('delta', 3)} FROM moved""",
    ),
)
def scenario_heatmap(spark, sf_dir):
    """Change of the answer over a grid of rain and temperature."""
    rows = sf.scored(fx.daily(spark, sf_dir), "kharif", _GRID, response)
    return tidy(rows.select(*SITE, "year", "rain_scale_pct", "temp_shift_c", "gdd_kharif", "heat_stress_days", "water_balance_kharif", "delta"), 3)


@register(
    "scenario_tornado",
    o.query(
        cases_sql([a for _, _, a in _SIDES]) + f""",
    named AS (
      SELECT m.*, operator, side
      FROM moved m JOIN (VALUES {', '.join(f"({i}, '{name}', '{side}')" for i, (name, side, _) in enumerate(_SIDES))}) n(scenario, operator, side) USING (scenario)),
    both_sides AS (
      SELECT state, district, cy, operator, max(delta) FILTER (WHERE side = 'low') AS low, max(delta) FILTER (WHERE side = 'high') AS high
      FROM named GROUP BY ALL)""",
        f"""SELECT state, district, cy::INTEGER AS year, operator, {o.nums('low', 'high', digits=3)}, {o.num('abs(high - low)', 3, 'swing')},
        row_number() OVER (PARTITION BY state, district, cy ORDER BY round(abs(high - low), 6) DESC, operator)::INTEGER AS rank FROM both_sides""",
    ),
)
def scenario_tornado(spark, sf_dir):
    """Operators of every site and crop year by the swing between a step down and a step up."""
    rows = sf.scored(fx.daily(spark, sf_dir), "kharif", [a for _, _, a in _SIDES], response)
    return tidy(sf.ranked(rows, _SIDES, [*SITE, "year"]), 3)


@register(
    "scenario_map",
    o.query(
        cases_sql([_SERVED]) + """,
    spans AS (
      SELECT state, district, min(rain) AS rlo, max(rain) AS rhi, min(tavg) AS tlo, max(tavg) AS thi, min(heat) AS hlo, max(heat) AS hhi,
        avg(rain) AS m, stddev_samp(rain) AS s
      FROM answered WHERE scenario = -1 GROUP BY ALL),
    judged AS (SELECT moved.*, (rain - m) / nullif(s, 0) AS rai, rlo, rhi, tlo, thi, hlo, hhi FROM moved JOIN spans USING (state, district))""",
        f"""SELECT state, district, cy::INTEGER AS year, {o.num('delta', 3)}, {o.num('delta * 100 / nullif(pred_yield, 0)', 3, 'delta_pct')},
        {o.num('rai', 3, 'rainfall_anomaly_index')}, coalesce(rai < -1, false)::INTEGER AS drought_flag, coalesce(rai > 1, false)::INTEGER AS flood_flag,
        concat_ws(',', CASE WHEN rain < rlo OR rain > rhi THEN 'nasa_rainfall_kharif' END, CASE WHEN tavg < tlo OR tavg > thi THEN 'nasa_temp_avg_kharif' END,
          CASE WHEN heat < hlo OR heat > hhi THEN 'heat_stress_days' END) AS out_of_range FROM judged""",
    ),
)
def scenario_map(spark, sf_dir):
    """One scenario, whose rain had to be moved into its bounds, at all sites, with flags and what leaves the observed range."""
    daily = fx.daily(spark, sf_dir)
    rows = sf.scored(daily, "kharif", [_SERVED], response)
    history = sf.baseline(sf.season_blocks(daily, "kharif"), "kharif").drop("days")
    judged = sf.with_anomaly(rows, history, "kharif")
    warned = scenario.out_of_range(judged, history, ["nasa_rainfall_kharif", "nasa_temp_avg_kharif", "heat_stress_days"], SITE)
    warned = warned.withColumn("out_of_range", F.array_join("out_of_range", ","))
    names = ["delta", "delta_pct", "rainfall_anomaly_index", "drought_flag", "flood_flag", "out_of_range"]
    return tidy(warned.select(*SITE, "year", *names), 3)
