"""Registered queries over yield records and the joined panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from agropanel.functions import scalars as f
from agropanel.operators import anomaly, gate, groundwater, metrics, panel, weather
from agropanel.plans import oracle as o
from agropanel.plans import refresh, views
from agropanel.plans.registry import register, tidy
from agropanel.sources import fixtures as fx

SITE = ["state", "district"]
KEYS = [*SITE, "crop", "season", "year"]
KEYS_SQL = "state, district, crop, season, year::INTEGER AS year"
STATES = [f"Nation_{i}" for i in range(20)]
CROPS = ["Building", "Machinery", "Automobile", "Household"]


def raw_records(spark, sf_dir):
    """Records as delivered: untidy names, year as text, yields in t/ha, some not positive."""
    return fx.season_yields(spark, sf_dir).select(
        F.concat(F.lit(" "), F.lower("state"), F.lit(" ")).alias("state"),
        F.upper("district").alias("district"),
        F.lower("crop").alias("crop"),
        F.concat(F.col("year"), F.lit("-"), F.lpad(((F.col("year") + 1) % 100).cast("string"), 2, "0")).alias("year_text"),
        F.concat("season", F.lit("  ")).alias("season"),
        "area_ha",
        ((F.col("yield_kg_ha") - 60000) / 1000).alias("yield_t_ha"),
    )


@register(
    "panel_clean",
    o.query(
        o.SEASON_YIELD,
        f"""SELECT upper(state[1]) || lower(state[2:]) AS state, upper(district[1]) || lower(district[2:]) AS district,
        upper(crop[1]) || lower(crop[2:]) AS crop, year::INTEGER AS year, season, area_ha,
        {o.num('(yield_kg_ha - 60000) / 1000 * 1000', 2, 'yield_kg_ha')},
        {o.num('round_even(((yield_kg_ha - 60000) / 1000 * 1000) * area_ha / 1000, 0)', 0, 'production_tons')}
        FROM season_yield WHERE yield_kg_ha > 60000 AND state IN ({', '.join(f"'NATION_{i}'" for i in range(20))})
          AND crop IN ({', '.join(f"'{c.upper()}'" for c in CROPS)})""",
    ),
)
def panel_clean(spark, sf_dir):
    return tidy(panel.clean_yields(raw_records(spark, sf_dir), STATES, CROPS), 2)


@register(
    "dup_rows",
    o.query(
        o.SEASON_YIELD,
        f"""SELECT {KEYS_SQL}, record, n::BIGINT AS key_count FROM (
        SELECT *, count(*) OVER (PARTITION BY state, district, crop, season, year) AS n FROM season_yield) WHERE n > 1""",
    ),
)
def dup_rows(spark, sf_dir):
    return panel.duplicates(fx.season_yields(spark, sf_dir), KEYS).select(*KEYS, "record", "key_count")


@register(
    "dup_average",
    o.query(
        o.SEASON_YIELD,
        f"""SELECT {KEYS_SQL}, {o.nums('yield_kg_ha', 'area_ha')} FROM (
        SELECT state, district, crop, season, year, avg(yield_kg_ha) AS yield_kg_ha, avg(area_ha) AS area_ha
        FROM season_yield GROUP BY ALL)""",
    ),
)
def dup_average(spark, sf_dir):
    return tidy(panel.average_duplicates(fx.season_yields(spark, sf_dir), KEYS))


@register(
    "season_overlap",
    o.query(
        o.SEASON_YIELD,
        f"""SELECT count(*)::BIGINT AS n_both, count(*) FILTER (WHERE k = r)::BIGINT AS n_identical,
        {o.num('count(*) FILTER (WHERE k = r) / count(*) * 100', 4, 'pct_identical')} FROM (
        SELECT state, district, year, avg(area_ha) FILTER (WHERE season = 'Kharif') AS k,
               avg(area_ha) FILTER (WHERE season = 'Rabi') AS r FROM season_yield GROUP BY ALL)
        WHERE k IS NOT NULL AND r IS NOT NULL""",
    ),
)
def season_overlap(spark, sf_dir):
    records = panel.average_duplicates(fx.season_yields(spark, sf_dir), KEYS)
    return tidy(panel.season_overlap(records, [*SITE, "year"], "area_ha", "Kharif", "Rabi"))


@register(
    "filters_and_exclusions",
    o.query(
        o.SEASON_YIELD,
        f"""SELECT {KEYS_SQL}, record, {o.num('yield_kg_ha')} FROM season_yield
        WHERE crop IS DISTINCT FROM 'FURNITURE' AND NOT (state = 'NATION_3' AND crop IN ('BUILDING', 'MACHINERY'))
          AND yield_kg_ha BETWEEN 50000 AND 250000""",
    ),
)
def filters_and_exclusions(spark, sf_dir):
    listed = spark.createDataFrame([("NATION_3", "BUILDING"), ("NATION_3", "MACHINERY")], "state string, crop string")
    df = panel.keep_different(fx.season_yields(spark, sf_dir), "crop", "FURNITURE")
    df = panel.drop_listed(df, listed, ["state", "crop"]).where(F.col("yield_kg_ha").between(50000, 250000))
    return tidy(df.select(*KEYS, "record", "yield_kg_ha"))


_LAGS = ["lag_yield_1", "lag_yield_2", "lag_yield_3", "yield_trend"]


@register(
    "lag_features",
    o.query(
        o.YIELD + "," + o.LAGS,
        f"""SELECT {KEYS_SQL}, {o.nums(*_LAGS[:3])}, {o.num('lag_yield_1 - lag_yield_3', 4, 'yield_trend')} FROM lags""",
    ),
)
def lag_features(spark, sf_dir):
    return tidy(panel.yield_lags(fx.yield_panel(spark, sf_dir)).select(*KEYS, *_LAGS))


@register(
    "rolling3",
    o.query(o.YIELD + "," + o.LAGS, f"SELECT {KEYS_SQL}, {o.nums('rolling_yield_3yr')} FROM lags"),
)
def rolling3(spark, sf_dir):
    return tidy(panel.yield_lags(fx.yield_panel(spark, sf_dir)).select(*KEYS, "rolling_yield_3yr"))


@register(
    "gap_vs_state",
    o.query(
        o.YIELD,
        f"""SELECT {KEYS_SQL}, {o.num('gap', 4, 'yield_gap_vs_state')} FROM (
        SELECT *, lag(yield_kg_ha) OVER w - lag(mean) OVER w AS gap FROM (
          SELECT *, avg(yield_kg_ha) OVER (PARTITION BY state, crop, year) AS mean FROM yield_panel)
        WINDOW w AS (PARTITION BY state, district, crop ORDER BY year, season))""",
    ),
)
def gap_vs_state(spark, sf_dir):
    return tidy(panel.gap_vs_state(fx.yield_panel(spark, sf_dir)).select(*KEYS, "yield_gap_vs_state"))


def site_history(spark, sf_dir):
    """Site yields with seasonal weather and anomaly: the joined panel."""
    history = anomaly.rai_history(weather.seasonal(fx.daily(spark, sf_dir)))
    return panel.merge_master(fx.site_yields(spark, sf_dir), history)


_MASTER = o.SEASONAL + "," + o.RAI + "," + o.SITE_YIELD + """,
    flagged AS (SELECT *, coalesce(rainfall_anomaly_index < -1, false)::INTEGER AS drought_flag,
                coalesce(rainfall_anomaly_index > 1, false)::INTEGER AS flood_flag FROM rai),
    master AS (SELECT y.*, f.* EXCLUDE (state, district, year) FROM site_yield y
               LEFT JOIN flagged f ON f.state = y.state AND f.district = y.district AND f.year = y.year)"""
_MASTER_NUM = ["yield_kg_ha", "nasa_rainfall_kharif", "nasa_rainfall_rabi", "gdd_kharif", "water_balance_rabi",
               "rainfall_anomaly_index"]


@register(
    "master_merge",
    o.query(
        _MASTER,
        f"SELECT {KEYS_SQL}, {o.nums(*_MASTER_NUM)}, drought_flag::DOUBLE AS drought_flag, "
        "NULL::DOUBLE AS ndvi_kharif FROM master",
    ),
)
def master_merge(spark, sf_dir):
    df = site_history(spark, sf_dir)
    return tidy(
        df.select(*KEYS, *_MASTER_NUM, F.col("drought_flag").cast("double").alias("drought_flag"), "ndvi_kharif")
    )


@register(
    "lag_flags",
    o.query(
        _MASTER,
        f"""SELECT state, district, year::INTEGER AS year,
        coalesce(lag(flood) OVER w, 0)::INTEGER AS flood_flag_lag1,
        coalesce(lag(drought) OVER w, 0)::INTEGER AS drought_flag_lag1,
        {o.num('coalesce(lag(idx) OVER w, 0)', 4, 'rai_lag1')}
        FROM (SELECT state, district, year, max(flood_flag) AS flood, max(drought_flag) AS drought,
                     max(rainfall_anomaly_index) AS idx FROM master GROUP BY ALL)
        WINDOW w AS (PARTITION BY state, district ORDER BY year)""",
    ),
)
def lag_flags(spark, sf_dir):
    return tidy(panel.lag_flags(site_history(spark, sf_dir)))


@register(
    "latest_known",
    o.query(
        o.SITE_YIELD,
        f"""SELECT {KEYS_SQL}, {o.nums('yield_kg_ha', 'area_ha')} FROM (
        SELECT *, row_number() OVER (PARTITION BY state, district, crop ORDER BY year DESC, season) AS rn FROM site_yield)
        WHERE rn = 1""",
    ),
)
def latest_known(spark, sf_dir):
    return tidy(panel.latest_known(fx.site_yields(spark, sf_dir)).select(*KEYS, "yield_kg_ha", "area_ha"))


_LATEST_MASTER = """,
    latest AS (SELECT * EXCLUDE (rn) FROM (
      SELECT *, row_number() OVER (PARTITION BY state, district, crop ORDER BY year DESC, season) AS rn FROM master)
      WHERE rn = 1)"""


@register(
    "live_override",
    o.query(
        _MASTER + _LATEST_MASTER
        + """,
        live AS (
          SELECT state, district, sum(rainfall_mm) AS rain, avg(temp_avg_c) AS tavg FROM daily
          WHERE cy = 1999 AND season = 'Rabi' GROUP BY ALL),
        stats AS (SELECT state, district, avg(nasa_rainfall_rabi) AS m, stddev_samp(nasa_rainfall_rabi) AS s
                  FROM seasonal GROUP BY ALL),
        scored AS (SELECT live.*, (rain - m) / nullif(s, 0) AS live_rai FROM live JOIN stats USING (state, district))""",
        f"""SELECT {KEYS_SQL}, {o.num('r', 4, 'nasa_rainfall_rabi')}, {o.num('t', 4, 'nasa_temp_avg_rabi')},
        {o.num('i', 4, 'rainfall_anomaly_index')}, d::DOUBLE AS drought_flag, 2001::INTEGER AS baseline_yield_year
        FROM (SELECT l.state, l.district, crop, season, year,
          CASE WHEN crop = 'Wheat' THEN rain ELSE nasa_rainfall_rabi END AS r,
          CASE WHEN crop = 'Wheat' THEN tavg ELSE nasa_temp_avg_rabi END AS t,
          CASE WHEN crop = 'Wheat' THEN live_rai ELSE rainfall_anomaly_index END AS i,
          CASE WHEN crop = 'Wheat' THEN coalesce(live_rai < -1, false)::INTEGER ELSE drought_flag END AS d
          FROM latest l LEFT JOIN scored USING (state, district))""",
    ),
)
def live_override(spark, sf_dir):
    days = fx.daily(spark, sf_dir)
    live = anomaly.live_rai(
        weather.current_season(days, 1999, sites=fx.supplier_sites(spark, sf_dir)), weather.seasonal(days), "current_rabi_rainfall", "nasa_rainfall_rabi"
    )
    rows = refresh.live_rabi_rows(site_history(spark, sf_dir), live)
    columns = ["nasa_rainfall_rabi", "nasa_temp_avg_rabi", "rainfall_anomaly_index"]
    flag = F.col("drought_flag").cast("double").alias("drought_flag")
    return tidy(rows.select(*KEYS, *columns, flag, "baseline_yield_year"))


@register(
    "live_known_override",
    o.query(
        _MASTER + _LATEST_MASTER
        + """,
        live AS (SELECT state, district, sum(rainfall_mm) AS rain, avg(temp_avg_c) AS tavg FROM daily
                 WHERE y = 2001 AND season = 'Kharif' GROUP BY ALL)""",
        f"""SELECT {KEYS_SQL}, {o.num('coalesce(rain, nasa_rainfall_kharif)', 4, 'nasa_rainfall_kharif')},
        {o.num('coalesce(tavg, nasa_temp_avg_kharif)', 4, 'nasa_temp_avg_kharif')}
        FROM latest LEFT JOIN live USING (state, district) WHERE crop = 'Rice' AND rain IS NOT NULL""",
    ),
)
def live_known_override(spark, sf_dir):
    days = fx.daily(spark, sf_dir)
    live = weather.live_kharif(days, 2001, sites=fx.supplier_sites(spark, sf_dir))
    rows = refresh.live_kharif_rows(site_history(spark, sf_dir), live)
    return tidy(rows.select(*KEYS, "nasa_rainfall_kharif", "nasa_temp_avg_kharif"))


@register(
    "fallback_lookup",
    o.query(
        o.SEASONAL
        + """,
        exact AS (SELECT state, district, avg(nasa_rainfall_kharif) AS m, stddev_samp(nasa_rainfall_kharif) AS s
                  FROM seasonal GROUP BY ALL)""",
        f"""SELECT state, district, {o.num('m', 4, 'hist_mean')}, {o.num('s', 4, 'hist_std')} FROM (
        SELECT CASE WHEN site % 4 = 0 THEN 'other spelling' ELSE site.state END AS state, site.district, m, s
        FROM site JOIN exact USING (state, district))""",
    ),
)
def fallback_lookup(spark, sf_dir):
    history = weather.seasonal(fx.daily(spark, sf_dir))
    sites = fx.supplier_sites(spark, sf_dir)
    odd = F.when(F.col("site") % 4 == 0, F.lit("other spelling")).otherwise(F.col("state"))
    live = sites.select(odd.alias("state"), "district")
    out = anomaly.baseline_with_fallback(live, history, "nasa_rainfall_kharif")
    return tidy(out.select(*SITE, "hist_mean", "hist_std"))


@register(
    "match_rate",
    o.query(
        _MASTER,
        f"""SELECT count(*)::BIGINT AS n_rows, count(nasa_rainfall_kharif)::BIGINT AS n_matched,
        {o.num('count(nasa_rainfall_kharif) / count(*)', 6, 'match_rate')} FROM master""",
    ),
)
def match_rate(spark, sf_dir):
    return tidy(panel.match_rate(site_history(spark, sf_dir), "nasa_rainfall_kharif"), 6)


_COMPLETE = ["season", "nasa_rainfall_kharif", "nasa_rainfall_rabi", "rainfall_anomaly_index", "ndvi_kharif"]


@register(
    "completeness",
    o.query(
        _MASTER,
        "SELECT feature, CASE WHEN share > 0.9 THEN 'OK' WHEN share > 0.5 THEN 'WARN' ELSE 'FAIL' END AS status, "
        + o.num("share", 6)
        + " FROM ("
        + " UNION ALL ".join(
            f"SELECT '{c}' AS feature, "
            + ("count(NULL) / count(*)" if c.startswith("ndvi") else f"count({c}) / count(*)")
            + " AS share FROM master"
            for c in _COMPLETE
        )
        + ")",
    ),
)
def completeness(spark, sf_dir):
    return tidy(panel.completeness(site_history(spark, sf_dir), _COMPLETE), 6)


_ENGINEERED = ["time_trend", "season_encoded", "state_encoded", "crop_encoded"]
_RATIOS = ["log_area", "fertilizer_per_ha", "nitrogen_per_ha", "irrigation_pct"]


@register(
    "engineered_features",
    o.query(
        o.YIELD + "," + o.COVARIATES,
        f"""SELECT {KEYS_SQL}, (year - 1997)::INTEGER AS time_trend, NULL::INTEGER AS season_encoded,
        CASE state WHEN 'NATION_0' THEN 0 WHEN 'NATION_1' THEN 1 WHEN 'NATION_2' THEN 2 END::INTEGER AS state_encoded,
        (crop = 'BUILDING')::INTEGER AS crop_encoded, {o.num('ln(1 + area_ha)', 6, 'log_area')},
        {o.num('fertilizer_tons / (area_ha + 1)', 6, 'fertilizer_per_ha')},
        {o.num('nitrogen_tons / (area_ha + 1)', 6, 'nitrogen_per_ha')},
        {o.num('CASE WHEN pct IS NOT NULL THEN least(greatest(pct, 0), 100) END', 6, 'irrigation_pct')}
        FROM (SELECT y.*, fertilizer_tons, nitrogen_tons, irrigated_area_1000ha * 1000 / (area_ha + 1) * 100 AS pct
              FROM yield_panel y LEFT JOIN covariates USING (state, district, year))""",
    ),
)
def engineered_features(spark, sf_dir):
    codes = {"NATION_0": 0, "NATION_1": 1, "NATION_2": 2}
    joined = fx.yield_panel(spark, sf_dir).join(fx.covariates(spark, sf_dir), [*SITE, "year"], "left")
    out = panel.input_ratios(panel.encodings(joined, codes, "BUILDING"))
    return tidy(out.select(*KEYS, *_ENGINEERED, *_RATIOS), 6)


@register(
    "coordinates_join",
    o.query(
        o.YIELD,
        """SELECT state, count(*)::BIGINT AS n_rows, count(lat)::BIGINT AS n_located FROM (
        SELECT y.state, CASE WHEN custkey % 5 <> 0 THEN 1 END AS lat FROM yield_panel y) GROUP BY ALL""",
    ),
)
def coordinates_join(spark, sf_dir):
    """Coordinates of four sites in five are known; rows of the others stay without."""
    sites = fx.customer_sites(spark, sf_dir).where(F.col("custkey") % 5 != 0)
    joined = panel.with_coordinates(fx.yield_panel(spark, sf_dir), sites)
    return joined.groupBy("state").agg(F.count(F.lit(1)).alias("n_rows"), F.count("lat").alias("n_located"))


@register(
    "coordinate_patch",
    o.query(
        "",
        f"""SELECT n_name AS state, s_name AS district,
        {o.num('CASE WHEN s_suppkey % 7 = 0 THEN 28.5 ELSE 24.0::DOUBLE + (s_suppkey % 97) * 0.05::DOUBLE END', 4, 'lat')}
        FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    ).replace("WITH \n", ""),
)
def coordinate_patch(spark, sf_dir):
    sites = fx.supplier_sites(spark, sf_dir)
    fixes = sites.where(F.col("site") % 7 == 0).select(*SITE, F.lit(28.5).alias("lat"))
    return tidy(panel.patch(sites, fixes, SITE, ["lat"]).select(*SITE, "lat"))


@register(
    "chrono_split_counts",
    o.query(
        o.YIELD,
        """SELECT CASE WHEN year <= 1998 THEN 'train' WHEN year <= 1999 THEN 'valid' ELSE 'test' END AS split,
        count(*)::BIGINT AS n, min(year)::INTEGER AS first_year, max(year)::INTEGER AS last_year
        FROM yield_panel GROUP BY ALL""",
    ),
)
def chrono_split_counts(spark, sf_dir):
    split = panel.with_split(fx.yield_panel(spark, sf_dir), 1998, 1999)
    return split.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.min("year").alias("first_year"), F.max("year").alias("last_year")
    )


@register(
    "impute_train_median",
    o.query(
        o.YIELD + "," + o.COVARIATES,
        f"""SELECT {KEYS_SQL}, {o.nums('fertilizer_tons', 'nitrogen_tons')} FROM (
        SELECT state, district, crop, season, year, coalesce(fertilizer_tons, mf) AS fertilizer_tons,
               coalesce(nitrogen_tons, mn) AS nitrogen_tons
        FROM yield_panel LEFT JOIN covariates USING (state, district, year),
        (SELECT quantile_cont(fertilizer_tons, 0.5) AS mf, quantile_cont(nitrogen_tons, 0.5) AS mn
         FROM yield_panel JOIN covariates USING (state, district, year) WHERE year <= 1998))""",
    ),
)
def impute_train_median(spark, sf_dir):
    columns = ["fertilizer_tons", "nitrogen_tons"]
    joined = fx.yield_panel(spark, sf_dir).join(fx.covariates(spark, sf_dir), [*SITE, "year"], "left")
    medians = panel.median_map(joined.where(F.col("year") <= 1998), columns)
    return tidy(panel.impute(joined, medians).select(*KEYS, *columns))


_ENV = {c: s for c, s in panel.ENV_SPECS.items() if c.startswith("nasa")}


def env_sql(source: str, where: str = "true") -> str:
    return " UNION ALL ".join(
        f"SELECT site AS district_id, year, '{season}' AS season, '{metric}' AS metric, {c} AS value "
        f"FROM {source} WHERE {c} IS NOT NULL AND {where}"
        for c, (season, metric) in _ENV.items()
    )


_WITH_ID = o.SEASONAL + ", keyed AS (SELECT s.*, site.site FROM seasonal s JOIN site USING (state, district))"


def seasonal_with_id(spark, sf_dir):
    seasonal = weather.seasonal(fx.daily(spark, sf_dir))
    ids = fx.supplier_sites(spark, sf_dir).select(*SITE, F.col("site").cast("int").alias("district_id"))
    return seasonal.join(ids, SITE)


@register(
    "unpivot_env",
    o.query(
        _WITH_ID,
        "SELECT district_id::INTEGER AS district_id, year::INTEGER AS year, season, metric, "
        + o.num("value")
        + f" FROM ({env_sql('keyed')})",
    ),
)
def unpivot_env(spark, sf_dir):
    return tidy(panel.to_long(seasonal_with_id(spark, sf_dir), ["district_id", "year"], _ENV))


@register(
    "dedupe_keep_last",
    o.query(
        _WITH_ID,
        "SELECT district_id::INTEGER AS district_id, year::INTEGER AS year, season, metric, "
        + o.num("CASE WHEN year >= 1999 THEN value + 1 ELSE value END", 4, "value")
        + f" FROM ({env_sql('keyed')})",
    ),
)
def dedupe_keep_last(spark, sf_dir):
    """A second source repeats the years from 1999 with other values and wins."""
    first = panel.to_long(seasonal_with_id(spark, sf_dir), ["district_id", "year"], _ENV)
    second = first.where(F.col("year") >= 1999).withColumn("value", F.col("value") + 1)
    return tidy(panel.env_seasonal([first, second]))


_WELLS = o.DAILY + """,
    readings AS (
      SELECT 'region ' || n_regionkey AS state, d.state AS district, d.district AS well, y AS year,
             CASE m WHEN 1 THEN 'Jan' WHEN 5 THEN 'May' WHEN 8 THEN 'Aug' WHEN 11 THEN 'Nov' END AS month,
             avg(temp_max_c) AS gwl
      FROM daily d JOIN nation n ON n.n_name = d.state WHERE m IN (1, 5, 8, 11) GROUP BY ALL)"""


@register(
    "wells_unpivot",
    o.query(
        _WELLS,
        f"""SELECT state, district, well, month || '-' || lpad((year % 100)::VARCHAR, 2, '0') AS period, month,
        year::INTEGER AS year, {o.num('gwl')} FROM readings WHERE gwl IS NOT NULL""",
    ),
)
def wells_unpivot(spark, sf_dir):
    long = groundwater.wells_long(fx.wells_wide(spark, sf_dir), [*SITE, "well"], 1900)
    year = F.when(F.col("year") < 1950, F.col("year") + 100).otherwise(F.col("year"))
    return tidy(long.withColumn("year", year))


_WELL_COLUMNS = ["gw_depth_premonsoon_m", "gw_depth_premonsoon_mean_m", "gw_depth_postmonsoon_m",
                 "gw_depth_postmonsoon_mean_m"]


@register(
    "wells_median",
    o.query(
        _WELLS,
        f"""SELECT state, district, year::INTEGER AS year, {o.nums(*_WELL_COLUMNS)},
        n_wells_premonsoon::DOUBLE AS n_wells_premonsoon, n_wells_postmonsoon::DOUBLE AS n_wells_postmonsoon
        FROM (SELECT state, district, year,
          quantile_cont(gwl, 0.5) FILTER (WHERE month = 'May') AS gw_depth_premonsoon_m,
          avg(gwl) FILTER (WHERE month = 'May') AS gw_depth_premonsoon_mean_m,
          nullif(count(gwl) FILTER (WHERE month = 'May'), 0) AS n_wells_premonsoon,
          quantile_cont(gwl, 0.5) FILTER (WHERE month = 'Nov') AS gw_depth_postmonsoon_m,
          avg(gwl) FILTER (WHERE month = 'Nov') AS gw_depth_postmonsoon_mean_m,
          nullif(count(gwl) FILTER (WHERE month = 'Nov'), 0) AS n_wells_postmonsoon
          FROM readings WHERE gwl IS NOT NULL AND month IN ('May', 'Nov') GROUP BY ALL)""",
    ),
)
def wells_median(spark, sf_dir):
    long = groundwater.wells_long(fx.wells_wide(spark, sf_dir), SITE, 1900)
    long = long.withColumn("year", F.when(F.col("year") < 1950, F.col("year") + 100).otherwise(F.col("year")))
    counts = [F.col(c).cast("double").alias(c) for c in ("n_wells_premonsoon", "n_wells_postmonsoon")]
    return tidy(groundwater.pre_and_post(long).select(*SITE, "year", *_WELL_COLUMNS, *counts))


@register(
    "trend_slope",
    o.query(
        o.YIELD,
        f"""SELECT district, {o.num('slope', 4, 'yield_trend')} FROM (
        SELECT district, regr_slope(yield_kg_ha, year) AS slope FROM yield_panel GROUP BY ALL HAVING count(*) > 3)""",
    ),
)
def trend_slope(spark, sf_dir):
    return tidy(groundwater.trend(fx.yield_panel(spark, sf_dir), "district", "year", "yield_kg_ha", "yield_trend"))


_ERRORS = o.YIELD + "," + o.LAGS + """,
    errors AS (SELECT district, avg(abs(yield_kg_ha - lag_yield_1)) AS abs_error, count(*) AS n FROM lags
               WHERE lag_yield_1 IS NOT NULL GROUP BY ALL),
    trends AS (SELECT district, regr_slope(yield_kg_ha, year) AS slope FROM yield_panel GROUP BY ALL HAVING count(*) > 3)"""


def persistence_errors(spark, sf_dir):
    lagged = panel.yield_lags(fx.yield_panel(spark, sf_dir)).where(F.col("lag_yield_1").isNotNull())
    return lagged.withColumn("residual", F.col("yield_kg_ha") - F.col("lag_yield_1"))


@register(
    "district_abs_error",
    o.query(_ERRORS, f"SELECT district, {o.num('abs_error')}, n::BIGINT AS n FROM errors"),
)
def district_abs_error(spark, sf_dir):
    return tidy(groundwater.abs_error(persistence_errors(spark, sf_dir), "district"))


@register(
    "pearson",
    o.query(
        _ERRORS,
        f"""SELECT count(*)::BIGINT AS n, {o.num('CASE WHEN count(*) >= 5 THEN corr(slope, abs_error) END', 6, 'r')}
        FROM errors JOIN trends USING (district)""",
    ),
)
def pearson(spark, sf_dir):
    errors = groundwater.abs_error(persistence_errors(spark, sf_dir), "district")
    trends = groundwater.trend(fx.yield_panel(spark, sf_dir), "district", "year", "yield_kg_ha", "slope")
    return tidy(groundwater.pearson(errors.join(trends, "district"), "slope", "abs_error"), 6)


@register(
    "join_by_name",
    o.query(
        o.YIELD,
        f"""SELECT state, count(*)::BIGINT AS n, {o.num('avg(yield_kg_ha)', 4, 'mean_yield')}
        FROM yield_panel GROUP BY ALL""",
    ),
)
def join_by_name(spark, sf_dir):
    """Names of the right side differ in case and outer blanks."""
    left = fx.yield_panel(spark, sf_dir)
    right = left.select(F.concat(F.lit(" "), F.upper("district")).alias("district"), "year", F.col("area_ha").alias("a"))
    joined = groundwater.join_by_name(left, right)
    return tidy(joined.groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.avg("yield_kg_ha").alias("mean_yield")))


@register(
    "state_year_pivot",
    o.query(
        o.SEASONAL,
        "SELECT state, "
        + ", ".join(
            o.num(f"avg(nasa_rainfall_kharif) FILTER (WHERE year = {y})", 4, f"y{y}") for y in range(1994, 2002)
        )
        + " FROM seasonal GROUP BY ALL",
    ),
)
def state_year_pivot(spark, sf_dir):
    seasonal = weather.seasonal(fx.daily(spark, sf_dir))
    wide = seasonal.groupBy("state").pivot("year", list(range(1994, 2002))).agg(F.avg("nasa_rainfall_kharif"))
    return tidy(wide.select("state", *[F.col(str(y)).alias(f"y{y}") for y in range(1994, 2002)]))


@register(
    "state_compare",
    o.query(
        o.SEASONAL,
        f"""SELECT state, {o.nums('baseline_mean', 'live_mean', digits=4)}, {o.num('live_2001', 4)},
        {o.num('round_even((live_mean / baseline_mean - 1) * 100, 1)', 1, 'live_vs_baseline_pct')},
        n_dry::BIGINT AS n_dry, direction
        FROM (SELECT *, CASE WHEN official IS NULL THEN 'not found' WHEN (live_2001 / live_mean - 1 < 0) = (official < 0)
                 THEN 'OK' ELSE 'WRONG' END AS direction FROM (
          SELECT state, avg(nasa_rainfall_kharif) FILTER (WHERE year < 1998) AS baseline_mean,
            avg(nasa_rainfall_kharif) FILTER (WHERE year BETWEEN 1998 AND 2000) AS live_mean,
            avg(nasa_rainfall_kharif) FILTER (WHERE year = 2001) AS live_2001,
            count(*) FILTER (WHERE year = 2001 AND nasa_rainfall_kharif < 2400) AS n_dry,
            CASE state WHEN 'NATION_0' THEN -41 WHEN 'NATION_1' THEN -23 WHEN 'NATION_2' THEN 8 END AS official
          FROM seasonal GROUP BY ALL))""",
    ),
)
def state_compare(spark, sf_dir):
    from agropanel.functions import classify as K

    official = spark.createDataFrame([("NATION_0", -41.0), ("NATION_1", -23.0), ("NATION_2", 8.0)], "state string, official double")
    rain, year = F.col("nasa_rainfall_kharif"), F.col("year")
    by_state = weather.seasonal(fx.daily(spark, sf_dir)).groupBy("state").agg(
        F.avg(F.when(year < 1998, rain)).alias("baseline_mean"),
        F.avg(F.when(year.between(1998, 2000), rain)).alias("live_mean"),
        F.avg(F.when(year == 2001, rain)).alias("live_2001"),
        F.count_if((year == 2001) & (rain < 2400)).alias("n_dry"),
    )
    joined = by_state.join(official, "state", "left")
    verdict = K.departure_verdict((F.try_divide("live_2001", "live_mean") - 1) * 100, "official", "n_dry")
    joined = joined.withColumn("live_vs_baseline_pct", f.half_even((F.try_divide("live_mean", "baseline_mean") - 1) * 100, 1))
    joined = joined.withColumn("direction", verdict["direction"])
    return tidy(joined.drop("official"))


@register(
    "state_summary",
    o.query(
        o.SEASONAL + "," + o.RAI,
        f"""SELECT state, year::INTEGER AS year, count(*)::BIGINT AS n_sites,
        {o.num('round_even(avg(nasa_rainfall_kharif), 0)', 0, 'mean_rain')},
        count(*) FILTER (WHERE rainfall_anomaly_index < -1)::BIGINT AS n_dry,
        count(*) FILTER (WHERE rainfall_anomaly_index > 1)::BIGINT AS n_wet,
        count(*) FILTER (WHERE rainfall_anomaly_index IS NULL)::BIGINT AS n_missing
        FROM rai GROUP BY ALL""",
    ),
)
def state_summary(spark, sf_dir):
    rows = anomaly.rai_history(weather.seasonal(fx.daily(spark, sf_dir)))
    return rows.groupBy("state", "year").agg(
        F.count(F.lit(1)).alias("n_sites"),
        f.half_even(F.avg("nasa_rainfall_kharif"), 0).alias("mean_rain"),
        F.sum("drought_flag").alias("n_dry"),
        F.sum("flood_flag").alias("n_wet"),
        F.count_if(F.col("rainfall_anomaly_index").isNull()).alias("n_missing"),
    )


@register(
    "distinct_counts",
    o.query(
        o.YIELD,
        """SELECT crop, count(DISTINCT district)::BIGINT AS n_districts, count(DISTINCT state)::BIGINT AS n_states,
        count(DISTINCT year)::BIGINT AS n_years FROM yield_panel GROUP BY ALL""",
    ),
)
def distinct_counts(spark, sf_dir):
    return fx.yield_panel(spark, sf_dir).groupBy("crop").agg(
        F.countDistinct("district").alias("n_districts"), F.countDistinct("state").alias("n_states"),
        F.countDistinct("year").alias("n_years"),
    )


@register(
    "distinct_sites",
    o.query(o.YIELD, "SELECT DISTINCT state, district FROM yield_panel"),
)
def distinct_sites(spark, sf_dir):
    return fx.yield_panel(spark, sf_dir).select(*SITE).distinct()


@register(
    "describe_column",
    o.query(
        o.YIELD,
        " UNION ALL ".join(
            f"SELECT '{name}' AS summary, {o.num(expr, 2, 'value')} FROM yield_panel"
            for name, expr in (
                ("count", "count(yield_kg_ha)"), ("mean", "avg(yield_kg_ha)"), ("stddev", "stddev_samp(yield_kg_ha)"),
                ("min", "min(yield_kg_ha)"), ("max", "max(yield_kg_ha)"),
            )
        ),
    ),
)
def describe_column(spark, sf_dir):
    summary = metrics.describe(fx.yield_panel(spark, sf_dir), "yield_kg_ha")
    return tidy(summary.select("summary", F.col("yield_kg_ha").cast("double").alias("value")), 2)


@register(
    "top_trends",
    o.query(
        _ERRORS,
        f"""SELECT district, {o.num('slope', 4, 'yield_trend')}, {o.num('abs_error')} FROM errors JOIN trends USING (district)
        ORDER BY slope DESC LIMIT 5""",
    ),
)
def top_trends(spark, sf_dir):
    """Five sites with the steepest rise, with their forecast error."""
    trends = groundwater.trend(fx.yield_panel(spark, sf_dir), "district", "year", "yield_kg_ha", "yield_trend")
    joined = trends.join(groundwater.abs_error(persistence_errors(spark, sf_dir), "district"), "district")
    return tidy(views.largest(joined, "yield_trend").select("district", "yield_trend", "abs_error"))


@register(
    "wells_implausible",
    o.query(
        _WELLS,
        """SELECT count(*) FILTER (WHERE may > 32 OR nov > 32)::BIGINT AS n_implausible FROM (
        SELECT state, district, year, quantile_cont(gwl, 0.5) FILTER (WHERE month = 'May') AS may,
               quantile_cont(gwl, 0.5) FILTER (WHERE month = 'Nov') AS nov
        FROM readings WHERE gwl IS NOT NULL AND month IN ('May', 'Nov') GROUP BY ALL)""",
    ),
)
def wells_implausible(spark, sf_dir):
    long = groundwater.wells_long(fx.wells_wide(spark, sf_dir), SITE, 1900)
    return groundwater.implausible_depths(groundwater.pre_and_post(long), 32.0)


@register(
    "unresolved_share",
    o.query(
        o.YIELD + "," + o.COVARIATES,
        f"""SELECT {o.num('avg((nitrogen_tons IS NULL)::INT)', 6, 'share')},
        (avg((nitrogen_tons IS NULL)::INT) <= 0.1)::INTEGER AS passed
        FROM yield_panel LEFT JOIN covariates USING (state, district, year)""",
    ),
)
def unresolved_share(spark, sf_dir):
    joined = fx.yield_panel(spark, sf_dir).join(fx.covariates(spark, sf_dir), [*SITE, "year"], "left")
    out = gate.unresolved_share(joined, "nitrogen_tons")
    return tidy(out.withColumn("passed", F.col("passed").cast("int")), 6)


@register(
    "pearson_by_site",
    o.query(
        o.YIELD + """,
        found AS (SELECT state, district, count(*) AS n, corr(year, yield_kg_ha) AS r FROM yield_panel GROUP BY ALL HAVING count(*) BETWEEN 5 AND 10),
        sides AS (SELECT *, abs(r) AS s, sqrt(1 - r * r) AS c, asin(abs(r)) AS a FROM found)""",
        f"""SELECT state, district, n::BIGINT AS n, {o.num('r', 6)}, {o.num("""1 - CASE n
          WHEN 5 THEN 2 / pi() * (a + s * c) WHEN 6 THEN s * (1 + c ** 2 / 2) WHEN 7 THEN 2 / pi() * (a + s * (c + 2.0 / 3 * c ** 3))
          WHEN 8 THEN s * (1 + c ** 2 / 2 + 3.0 / 8 * c ** 4) WHEN 9 THEN 2 / pi() * (a + s * (c + 2.0 / 3 * c ** 3 + 8.0 / 15 * c ** 5))
          ELSE s * (1 + c ** 2 / 2 + 3.0 / 8 * c ** 4 + 5.0 / 16 * c ** 6) END""", 6, 'p')} FROM sides""",
    ),
)
def pearson_by_site(spark, sf_dir):
    """Does a site's yield follow the years? Its correlation and p-value; up to ten years the tail has a closed form."""
    found = groundwater.pearson_by(fx.yield_panel(spark, sf_dir).withColumn("year", F.col("year").cast("double")), "year", "yield_kg_ha", [*SITE], 5)
    return tidy(found.where("n BETWEEN 5 AND 10"), 6)
