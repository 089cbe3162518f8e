"""Registered queries over daily weather."""

from __future__ import annotations

from pyspark.sql import functions as F

from agropanel.functions import seasons as S
from agropanel.functions import classify as K
from agropanel.operators import anomaly, weather
from agropanel.plans import oracle as o
from agropanel.plans.registry import register, tidy
from agropanel.sources import fixtures as fx

SITE = ["state", "district"]
KHARIF = ["nasa_rainfall_kharif", "nasa_temp_avg_kharif", "nasa_temp_max_kharif", "nasa_humidity_kharif"]
RABI = ["nasa_rainfall_rabi", "nasa_temp_avg_rabi", "nasa_temp_max_rabi"]
ANNUAL = ["nasa_rainfall_annual", "nasa_solar_annual"]
EXTRA = ["gdd", "max_dry_streak", "rainfall_cv", "water_balance"]
LIVE_YEAR = 2001
KEYS_SQL = "state, district, year::INTEGER AS year"


def seasonal(spark, sf_dir):
    return weather.seasonal(fx.daily(spark, sf_dir))


@register(
    "seasonal_kharif",
    o.query(o.SEASONAL, f"SELECT {KEYS_SQL}, {o.nums(*KHARIF)} FROM seasonal WHERE k_rows > 0"),
)
def seasonal_kharif(spark, sf_dir):
    return tidy(seasonal(spark, sf_dir).where(F.col("nasa_rainfall_kharif").isNotNull()).select(*SITE, "year", *KHARIF))


@register(
    "seasonal_rabi_partial",
    o.query(
        o.SEASONAL,
        f"SELECT {KEYS_SQL}, {o.nums(*RABI)}, {o.longs('rabi_days_observed')}, {o.ints('rabi_season_partial')} "
        "FROM seasonal WHERE r_rows > 0",
    ),
)
def seasonal_rabi_partial(spark, sf_dir):
    df = seasonal(spark, sf_dir).where(F.col("rabi_days_observed").isNotNull())
    return tidy(df.select(*SITE, "year", *RABI, "rabi_days_observed", "rabi_season_partial"))


@register(
    "seasonal_annual",
    o.query(
        o.SEASONAL,
        f"SELECT {KEYS_SQL}, {o.nums(*ANNUAL)}, {o.longs('heat_stress_days', 'frost_risk_days')} FROM seasonal",
    ),
)
def seasonal_annual(spark, sf_dir):
    df = seasonal(spark, sf_dir)
    return tidy(df.select(*SITE, "year", *ANNUAL, "heat_stress_days", "frost_risk_days"))


_MERGED = KHARIF + RABI + ANNUAL + [f"{x}_{s}" for s in ("kharif", "rabi") for x in EXTRA if x != "max_dry_streak"]
_MERGED_INT = ["max_dry_streak_kharif", "max_dry_streak_rabi", "heat_stress_days", "frost_risk_days"]


@register(
    "seasonal_merged",
    o.query(
        o.SEASONAL,
        f"SELECT {KEYS_SQL}, {o.nums(*_MERGED)}, "
        + ", ".join(f"{c}::DOUBLE AS {c}" for c in _MERGED_INT)
        + " FROM seasonal",
    ),
)
def seasonal_merged(spark, sf_dir):
    df = seasonal(spark, sf_dir)
    return tidy(df.select(*SITE, "year", *_MERGED, *[F.col(c).cast("double").alias(c) for c in _MERGED_INT]))


_CALENDAR = KHARIF + RABI + ANNUAL


@register(
    "calendar_seasonal_v1",
    o.query(
        o.DAILY,
        f"""SELECT district, y::INTEGER AS year, {o.nums(*_CALENDAR)},
        {o.longs('heat_stress_days', 'frost_risk_days')}
        FROM (SELECT district, y,
          coalesce(sum(rainfall_mm) FILTER (WHERE season = 'Kharif'), 0) AS nasa_rainfall_kharif,
          avg(temp_avg_c) FILTER (WHERE season = 'Kharif') AS nasa_temp_avg_kharif,
          avg(temp_max_c) FILTER (WHERE season = 'Kharif') AS nasa_temp_max_kharif,
          avg(humidity_pct) FILTER (WHERE season = 'Kharif') AS nasa_humidity_kharif,
          coalesce(sum(rainfall_mm) FILTER (WHERE season = 'Rabi'), 0) AS nasa_rainfall_rabi,
          avg(temp_avg_c) FILTER (WHERE season = 'Rabi') AS nasa_temp_avg_rabi,
          avg(temp_max_c) FILTER (WHERE season = 'Rabi') AS nasa_temp_max_rabi,
          sum(rainfall_mm) AS nasa_rainfall_annual, avg(solar_radiation) AS nasa_solar_annual,
          count(*) FILTER (WHERE temp_max_c > 35) AS heat_stress_days,
          count(*) FILTER (WHERE temp_min_c < 2) AS frost_risk_days
          FROM daily GROUP BY ALL)""",
    ),
)
def calendar_seasonal_v1(spark, sf_dir):
    return tidy(weather.calendar_seasonal(fx.daily(spark, sf_dir)))


@register(
    "agronomic_features",
    o.query(
        o.SEASONAL,
        f"""SELECT state, district, season, year::INTEGER AS year, {o.nums('gdd', 'rainfall_cv', 'water_balance')}
        FROM (SELECT state, district, 'kharif' AS season, year, gdd_kharif AS gdd, rainfall_cv_kharif AS rainfall_cv,
                     water_balance_kharif AS water_balance FROM seasonal WHERE k_rows > 0
              UNION ALL
              SELECT state, district, 'rabi', year, gdd_rabi, rainfall_cv_rabi, water_balance_rabi
              FROM seasonal WHERE r_rows > 0)""",
    ),
)
def agronomic_features(spark, sf_dir):
    """Block form: the blocks are keyed by season and crop year and computed by the shared block function."""
    days = fx.daily(spark, sf_dir).withColumn("season", F.lower(S.season_name("date")))
    days = days.where(F.col("season").isNotNull()).withColumn("year", S.crop_year("date"))
    out = weather.block_features(days, [*SITE, "season", "year"], "block")
    names = {f"{x}_block": x for x in ("gdd", "rainfall_cv", "water_balance")}
    return tidy(out.select(*SITE, "season", "year", *[F.col(a).alias(b) for a, b in names.items()]))


@register(
    "dry_streak",
    o.query(
        o.DAILY + "," + o.STREAK,
        "SELECT state, district, lower(season) AS season, cy::INTEGER AS year, coalesce(streak, 0)::INTEGER AS streak "
        "FROM (SELECT DISTINCT state, district, season, cy FROM marked) LEFT JOIN streaks USING (state, district, season, cy)",
    ),
)
def dry_streak(spark, sf_dir):
    days = fx.daily(spark, sf_dir).withColumn("season", F.lower(S.season_name("date")))
    days = days.where(F.col("season").isNotNull()).withColumn("year", S.crop_year("date"))
    out = weather.block_features(days, [*SITE, "season", "year"], "block")
    return out.select(*SITE, "season", "year", F.col("max_dry_streak_block").alias("streak"))


@register(
    "rai_flags",
    o.query(
        o.SEASONAL + "," + o.RAI,
        f"""SELECT {KEYS_SQL}, {o.nums('nasa_rainfall_annual', 'mean_rainfall', 'std_rainfall',
        'rainfall_anomaly_index')}, (coalesce(rainfall_anomaly_index < -1, false))::INTEGER AS drought_flag,
        (coalesce(rainfall_anomaly_index > 1, false))::INTEGER AS flood_flag FROM rai""",
    ),
)
def rai_flags(spark, sf_dir):
    df = anomaly.rai_history(seasonal(spark, sf_dir))
    columns = ["nasa_rainfall_annual", "mean_rainfall", "std_rainfall", "rainfall_anomaly_index"]
    return tidy(df.select(*SITE, "year", *columns, "drought_flag", "flood_flag"))


@register(
    "season_to_date_risk",
    o.query(
        o.DAILY
        + """,
        cut AS (SELECT max(date) AS last FROM daily WHERE y = 2001 AND m >= 6 AND rainfall_mm IS NOT NULL),
        totals AS (
          SELECT state, district, y, sum(rainfall_mm) AS total, count(rainfall_mm) AS days
          FROM daily, cut WHERE y BETWEEN 1996 AND 2001 AND date >= make_date(y, 6, 1)
            AND date - make_date(y, 6, 1) <= last - DATE '2001-06-01' GROUP BY ALL),
        stats AS (
          SELECT state, district, max(total) FILTER (WHERE y = 2001) AS partial_mm,
            max(days) FILTER (WHERE y = 2001) AS days_elapsed, avg(total) FILTER (WHERE y < 2001) AS mean_mm,
            stddev_samp(total) FILTER (WHERE y < 2001) AS std_mm, count(total) FILTER (WHERE y < 2001) AS n_years
          FROM totals GROUP BY ALL),
        scored AS (SELECT *, (partial_mm - mean_mm) / nullif(std_mm, 0) AS z FROM stats WHERE days_elapsed > 0)""",
        f"""SELECT state, district, {o.nums('partial_mm', 'mean_mm', 'std_mm', 'z')},
        {o.longs('days_elapsed', 'n_years')},
        CASE WHEN z IS NULL OR n_years < 3 THEN 'insufficient_data' WHEN z < -1.2 THEN 'high'
             WHEN z < -0.5 THEN 'moderate' ELSE 'low' END AS risk FROM scored""",
    ),
)
def season_to_date_risk(spark, sf_dir):
    df = anomaly.season_to_date(fx.daily(spark, sf_dir), LIVE_YEAR, 1996)
    return tidy(
        df.select(
            *SITE,
            F.col("actual_partial_rainfall_mm").alias("partial_mm"),
            F.col("window_hist_mean").alias("mean_mm"),
            F.col("window_hist_std").alias("std_mm"),
            F.col("kharif_risk_zscore").alias("z"),
            "days_elapsed",
            "n_years",
            F.col("kharif_risk_level").alias("risk"),
        )
    )


_SCALE = """,
    live_years AS (
      SELECT state, district, y, sum(rainfall_mm) AS total FROM daily WHERE season = 'Kharif' AND y BETWEEN 1997 AND 2000
      GROUP BY ALL HAVING count(rainfall_mm) >= 140),
    live AS (SELECT state, district, avg(total) AS live_mean FROM live_years GROUP BY ALL HAVING count(*) >= 4),
    hist AS (SELECT state, district, avg(nasa_rainfall_kharif) AS hist_mean, stddev_samp(nasa_rainfall_kharif) AS hist_std
             FROM seasonal GROUP BY ALL),
    scale AS (SELECT state, district, hist_mean, live_mean, hist_mean / live_mean AS rain_scale
              FROM hist JOIN live USING (state, district) WHERE live_mean <> 0),
    cur AS (
      SELECT d.state, d.district, count(rainfall_mm) AS kharif_days_observed, sum(rainfall_mm) AS live_rain_raw,
        any_value(rain_scale) AS rain_scale, any_value(live_mean) AS live_mean,
        sum(rainfall_mm * rain_scale) AS cur_rain_kharif, avg(temp_avg_c) AS cur_temp_avg_kharif
      FROM daily d LEFT JOIN scale s USING (state, district) WHERE y = 2001 AND season = 'Kharif' GROUP BY ALL)"""


@register(
    "rain_scale",
    o.query(
        o.SEASONAL + _SCALE,
        f"""SELECT state, district, {o.longs('kharif_days_observed')}, {o.nums('live_rain_raw', 'rain_scale',
        'cur_rain_kharif', 'cur_temp_avg_kharif', 'hist_mean', 'hist_std', 'rain_departure_pct', 'cur_rai')},
        (cur_rai < -1)::INTEGER AS cur_drought, (cur_rai > 1)::INTEGER AS cur_flood
        FROM (SELECT cur.*, hist_mean, hist_std, (live_rain_raw / live_mean - 1) * 100 AS rain_departure_pct,
                     (cur_rain_kharif - hist_mean) / nullif(hist_std, 0) AS cur_rai
              FROM cur LEFT JOIN hist USING (state, district)) WHERE cur_rai IS NOT NULL""",
    ),
)
def rain_scale(spark, sf_dir):
    days = fx.daily(spark, sf_dir)
    history = weather.seasonal(days, known_days=True)
    scale = anomaly.rain_scale(history, history, 1997, 2000)
    live = weather.live_kharif(days, LIVE_YEAR, scale, sites=fx.supplier_sites(spark, sf_dir))
    out = anomaly.live_kharif_rai(live, history, max_missing=0.5)
    return tidy(
        out.select(
            *SITE, "kharif_days_observed", "live_rain_raw", "rain_scale", "cur_rain_kharif", "cur_temp_avg_kharif",
            "hist_mean", "hist_std", "rain_departure_pct", "cur_rai", "cur_drought", "cur_flood",
        )
    )


@register(
    "live_conditions",
    o.query(
        o.SEASONAL
        + """,
        live AS (
          SELECT d.state, d.district,
            sum(rainfall_mm) FILTER (WHERE cy = 2000 AND season = 'Rabi') AS current_rabi_rainfall,
            avg(temp_avg_c) FILTER (WHERE cy = 2000 AND season = 'Rabi') AS current_rabi_temp_avg,
            sum(rainfall_mm) FILTER (WHERE y = 2001 AND m >= 6) AS current_kharif_partial_rainfall,
            count(rainfall_mm) FILTER (WHERE y = 2001 AND m >= 6) AS current_kharif_partial_days
          FROM daily d GROUP BY ALL),
        stats AS (SELECT state, district, avg(nasa_rainfall_rabi) AS hist_mean,
                         stddev_samp(nasa_rainfall_rabi) AS hist_std FROM seasonal GROUP BY ALL),
        scored AS (SELECT live.*, (current_rabi_rainfall - hist_mean) / nullif(hist_std, 0) AS current_rai
                   FROM live LEFT JOIN stats USING (state, district))""",
        f"""SELECT c.state, c.district, {o.nums('current_rabi_rainfall', 'current_rabi_temp_avg',
        'current_kharif_partial_rainfall', 'current_rai')}, {o.longs('current_kharif_partial_days')},
        coalesce(current_rai < -1, false)::INTEGER AS current_drought_flag,
        coalesce(current_rai > 1, false)::INTEGER AS current_flood_flag,
        s.max_dry_streak_rabi::INTEGER AS current_max_dry_streak_rabi,
        {o.num('s.gdd_rabi', 4, 'current_gdd_rabi')}, (SELECT max(date) FROM daily) AS data_as_of
        FROM scored c JOIN seasonal s ON s.state = c.state AND s.district = c.district AND s.year = 2000""",
    ),
)
def live_conditions(spark, sf_dir):
    days = fx.daily(spark, sf_dir)
    live = weather.current_season(days, LIVE_YEAR - 1, sites=fx.supplier_sites(spark, sf_dir))
    out = anomaly.live_rai(live, weather.seasonal(days), "current_rabi_rainfall", "nasa_rainfall_rabi")
    return tidy(
        out.select(
            *SITE, "current_rabi_rainfall", "current_rabi_temp_avg", "current_kharif_partial_rainfall",
            "current_kharif_partial_days", "current_rai", "current_drought_flag", "current_flood_flag",
            "current_max_dry_streak_rabi", "current_gdd_rabi", "data_as_of",
        )
    )
