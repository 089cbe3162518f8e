"""Registered queries over sites, published runs, views, scenarios, text and raster cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from agropanel.functions import classify as K
from agropanel.functions import scalars as f
from agropanel.functions import seasons as S
from agropanel.functions import text
from agropanel.operators import anomaly, explain, metrics, panel, scenario, weather, zonal
from agropanel.plans import oracle as o
from agropanel.plans import views
from agropanel.plans.quality_queries import ALERTS_SQL, FIRST_CUT, SECOND_CUT, alerts, snapshot
from agropanel.plans.registry import register, tidy
from agropanel.sources import fixtures as fx
from agropanel.sources import readers, sinks

SITE = ["state", "district"]


# ---- sites and ids --------------------------------------------------------------------------------------------

def reported_sites(spark, sf_dir):
    """Line counts per supplier as another source would report them: one in ten under an alias, one in ten unknown."""
    lines = fx.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("site")).agg(F.count(F.lit(1)).alias("n"))
    rows = lines.join(fx.supplier_sites(spark, sf_dir), "site")
    name = (
        F.when(F.col("site") % 10 == 0, F.concat(F.lit("Alt "), "district"))
        .when(F.col("site") % 10 == 1, F.concat(F.lit("Other "), "district")).otherwise(F.col("district"))
    )
    return rows.select("state", name.alias("district"), "n")


def site_ids(spark, sf_dir):
    return fx.supplier_sites(spark, sf_dir).select(*SITE, F.col("site").cast("int").alias("district_id"))


def site_aliases(spark, sf_dir):
    odd = fx.supplier_sites(spark, sf_dir).where(F.col("site") % 10 == 0)
    return odd.select("state", F.concat(F.lit("Alt "), "district").alias("alias"), F.col("district").alias("canonical"))


_REPORTED = """
    reported AS (SELECT n_name AS state, s_name, s_suppkey AS site, count(*) AS n FROM lineitem
      JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL)"""


@register(
    "id_resolve",
    o.query(
        _REPORTED,
        """SELECT state, CASE WHEN site % 10 = 0 THEN 'Alt ' || s_name ELSE s_name END AS district, n::BIGINT AS n,
        site::INTEGER AS district_id FROM reported WHERE site % 10 <> 1""",
    ),
)
def id_resolve(spark, sf_dir):
    rows = panel.resolve_ids(reported_sites(spark, sf_dir), site_ids(spark, sf_dir), site_aliases(spark, sf_dir))
    return panel.known_sites(rows).select(*SITE, "n", "district_id")


@register(
    "unknown_sites",
    o.query(
        _REPORTED,
        "SELECT state, 'Other ' || s_name AS district, 1::BIGINT AS n_rows FROM reported WHERE site % 10 = 1",
    ),
)
def unknown_sites(spark, sf_dir):
    rows = panel.resolve_ids(reported_sites(spark, sf_dir), site_ids(spark, sf_dir), site_aliases(spark, sf_dir))
    return panel.unknown_sites(rows)


_SLUG = "trim(regexp_replace(lower({}), '[^a-z0-9]+', '-', 'g'), '-')"
_SITE_SLUG = f"{_SLUG.format('n_name')} || '/' || {_SLUG.format('c_name')}"


@register(
    "stable_ids",
    o.query(
        "",
        f"""SELECT slug, state, district, id::INTEGER AS district_id FROM (
        SELECT slug, state, district, CASE WHEN k % 3 = 0 THEN k ELSE (SELECT max(c_custkey) FROM customer WHERE c_custkey % 3 = 0)
          + row_number() OVER (PARTITION BY k % 3 = 0 ORDER BY state, district) END AS id
        FROM (SELECT {_SITE_SLUG} AS slug, n_name AS state, c_name AS district, c_custkey AS k
              FROM customer JOIN nation ON c_nationkey = n_nationkey))""",
    ).replace("WITH \n", ""),
)
def stable_ids(spark, sf_dir):
    """A third of the customers already has an id; the others are numbered after them."""
    everyone = fx.customer_sites(spark, sf_dir)
    known = everyone.where(F.col("custkey") % 3 == 0)
    existing = known.select(f.site_slug().alias("slug"), F.col("custkey").cast("int").alias("district_id"))
    return panel.assign_ids(everyone.select(*SITE), existing).select("slug", *SITE, "district_id")


@register(
    "slugify",
    o.query(
        "",
        f"SELECT page_id, {_SLUG.format('url')} AS slug, lower(trim(url)) AS name_key FROM pages",
    ).replace("WITH \n", ""),
)
def slugify(spark, sf_dir):
    pages = fx.table(spark, sf_dir, "pages")
    return pages.select("page_id", f.slug("url").alias("slug"), f.name_key("url").alias("name_key"))


@register(
    "season_calendar",
    o.query(
        "",
        """SELECT season, crop_year::INTEGER AS crop_year, first_day::INTEGER AS first_day, last_day::INTEGER AS last_day,
        n::BIGINT AS n FROM (
        SELECT CASE WHEN m BETWEEN 6 AND 10 THEN 'Kharif' WHEN m IN (11, 12, 1, 2, 3) THEN 'Rabi' ELSE 'Inter-season' END AS season,
               year(d) - CASE WHEN m < 6 THEN 1 ELSE 0 END AS crop_year, min(d - make_date(year(d), 6, 1)) AS first_day,
               max(d - make_date(year(d), 6, 1)) AS last_day, count(*) AS n
        FROM (SELECT CAST(o_orderdate AS DATE) AS d, month(o_orderdate) AS m FROM orders) GROUP BY ALL)""",
    ).replace("WITH \n", ""),
)
def season_calendar(spark, sf_dir):
    d = fx.table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("date"))
    rows = d.select(S.season_label("date").alias("season"), S.crop_year("date").alias("crop_year"), S.season_day("date").alias("day"))
    return rows.groupBy("season", "crop_year").agg(
        F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count(F.lit(1)).alias("n")
    )


# ---- run tables -----------------------------------------------------------------------------------------------

def districts(spark, sf_dir):
    rows = fx.customer_sites(spark, sf_dir)
    return rows.select(F.col("custkey").cast("int").alias("district_id"), f.site_slug().alias("slug"), *SITE, "lat", "lon")


def history(spark, sf_dir):
    rows = fx.yield_panel(spark, sf_dir)
    return rows.select(F.col("custkey").cast("int").alias("district_id"), "crop", "season", "year", "yield_kg_ha", "area_ha")


def run_events(spark, sf_dir):
    """Manifest with one run per month of orders; its size decides how the run ended."""
    monthly = fx.table(spark, sf_dir, "orders").groupBy(F.trunc(F.col("o_orderdate").cast("date"), "month").alias("month")).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.col("o_orderdate").cast("date")).alias("last")
    )
    status = F.when(F.col("n") % 7 == 0, "failed").when(F.col("n") % 3 == 0, "flagged").otherwise("ok")
    begun = monthly.select(
        F.date_format("month", "'run-'yyyy-MM").alias("run_id"), status.alias("final"), "last",
        F.col("last").cast("timestamp").alias("started_at"),
    )
    opened = begun.select("run_id", F.lit("running").alias("status"), F.lit(None).cast("boolean").alias("gate_passed"),
                          F.col("last").alias("weather_data_as_of"), "started_at", F.lit(None).cast("timestamp").alias("finished_at"))
    closed = begun.select("run_id", F.col("final").alias("status"), (F.col("final") == "ok").alias("gate_passed"),
                          F.col("last").alias("weather_data_as_of"), "started_at",
                          (F.col("started_at") + F.expr("INTERVAL 1 HOUR")).alias("finished_at"))
    return opened.unionByName(closed)


_RUNS = """
    runs AS (
      SELECT strftime(month, 'run-%Y-%m') AS run_id, last,
             CASE WHEN n % 7 = 0 THEN 'failed' WHEN n % 3 = 0 THEN 'flagged' ELSE 'ok' END AS status
      FROM (SELECT date_trunc('month', o_orderdate) AS month, count(*) AS n, max(CAST(o_orderdate AS DATE)) AS last
            FROM orders GROUP BY ALL))"""


@register(
    "run_states",
    o.query(_RUNS, "SELECT run_id, status, (status = 'ok')::INTEGER AS gate_passed, last AS weather_data_as_of FROM runs"),
)
def run_states(spark, sf_dir):
    state = sinks.run_state(run_events(spark, sf_dir))
    return state.select("run_id", "status", F.col("gate_passed").cast("int").alias("gate_passed"), "weather_data_as_of")


@register(
    "run_promotion",
    o.query(
        _RUNS,
        "SELECT run_id, status, last AS weather_data_as_of FROM runs WHERE status = 'ok' ORDER BY last DESC LIMIT 1",
    ),
)
def run_promotion(spark, sf_dir):
    return views.latest_run(run_events(spark, sf_dir)).select("run_id", "status", "weather_data_as_of")


@register(
    "view_freshness",
    o.query(
        _RUNS,
        """SELECT CASE WHEN DATE '2001-08-05' - last > 7 THEN 'stale' ELSE 'ok' END AS status,
        (DATE '2001-08-05' - last)::INTEGER AS data_age_days, run_id
        FROM runs WHERE status = 'ok' ORDER BY last DESC LIMIT 1""",
    ),
)
def view_freshness(spark, sf_dir):
    return views.freshness(run_events(spark, sf_dir), "2001-08-05")


@register(
    "retained_runs",
    o.query(_RUNS, "SELECT run_id FROM runs ORDER BY last DESC, run_id DESC LIMIT 30"),
)
def retained_runs(spark, sf_dir):
    return sinks.retained_runs(sinks.run_state(run_events(spark, sf_dir)))


_FEATURES = ["rainfall_anomaly_index", "drought_flag", "flood_flag"]


# keeps the rounded views off exact ties, which two engines may round apart
_OFF_TIE = 0.000123


def untied(df, *columns):
    return df.withColumns({c: F.col(c) + _OFF_TIE for c in columns})


def prediction_table(spark, sf_dir):
    """Predictions of two runs with a band and the feature map."""
    parts = None
    for run_id, cut in (("first", FIRST_CUT), ("second", SECOND_CUT)):
        rows = untied(snapshot(spark, sf_dir, cut), "pred_yield", "rai")
        rows = rows.select(
            F.col("custkey").cast("int").alias("district_id"), "crop", F.lit("S").alias("season"), "pred_yield",
            (F.col("pred_yield") * 0.9).alias("pred_lower"), (F.col("pred_yield") * 1.2).alias("pred_upper"),
            "baseline_yield_year", F.lit(f"rows until {cut}").alias("prediction_basis"),
            F.col("rai").alias("rainfall_anomaly_index"), (F.col("rai") < 2).cast("int").alias("drought_flag"),
            (F.col("rai") > 3).cast("int").alias("flood_flag"),
        )
        rows = sinks.prediction_rows(rows, _FEATURES, run_id)
        parts = rows if parts is None else parts.unionByName(rows)
    return parts


def two_runs(spark, sf_dir):
    """Both runs ended well, each at its own cut-off; the later one is served."""
    orders = fx.table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("d"))
    parts = None
    for run_id, cut in (("first", FIRST_CUT), ("second", SECOND_CUT)):
        row = orders.where(F.col("d") <= F.lit(cut).cast("date")).agg(F.max("d").alias("weather_data_as_of"))
        at = F.col("weather_data_as_of").cast("timestamp")
        row = row.select(F.lit(run_id).alias("run_id"), F.lit("ok").alias("status"), F.lit(True).alias("gate_passed"),
                         "weather_data_as_of", at.alias("started_at"), at.alias("finished_at"))
        parts = row if parts is None else parts.unionByName(row)
    return parts


_PREDICTIONS = o.snapshot_sql("now", SECOND_CUT) + "," + o.YIELD + f""",
    untied AS (SELECT * REPLACE (pred_yield + {_OFF_TIE} AS pred_yield, rai + {_OFF_TIE} AS rai) FROM now),
    rows AS (
      SELECT n.state, n.district, {_SLUG.format('n.state')} || '/' || {_SLUG.format('n.district')} AS slug, n.crop,
             'S' AS season, n.pred_yield, n.pred_yield * 0.9 AS pred_lower, n.pred_yield * 1.2 AS pred_upper,
             n.baseline_yield_year, n.rai, n.rai < 2 AS drought, n.rai > 3 AS flood, y.yield_kg_ha AS baseline,
             n.custkey
      FROM untied n LEFT JOIN yield_panel y ON y.custkey = n.custkey AND y.year = n.baseline_yield_year)"""
_SHAPED = f"""state, district, slug, crop, season, {o.num('round_even(pred_yield, 1)', 1, 'pred_yield_kg_ha')},
    {o.num('round_even(pred_lower, 1)', 1, 'pred_lower')}, {o.num('round_even(pred_upper, 1)', 1, 'pred_upper')},
    (pred_yield BETWEEN pred_lower AND pred_upper)::INTEGER AS contains_point, drought::INTEGER AS drought_flag,
    flood::INTEGER AS flood_flag, {o.num('round_even(rai, 2)', 2, 'rainfall_anomaly_index')},
    {o.num('round_even(pred_yield - baseline, 1)', 1, 'change_vs_baseline_kg_ha')}"""


def _plain(df):
    flags = [c for c, t in df.dtypes if t == "boolean"]
    return tidy(df.withColumns({c: F.col(c).cast("int") for c in flags}), 2)


@register(
    "view_predictions",
    o.query(
        _PREDICTIONS,
        f"""SELECT {_SHAPED} FROM rows WHERE crop = 'BUILDING' ORDER BY pred_yield - baseline DESC NULLS FIRST, slug
        LIMIT 50 OFFSET 10""",
    ),
)
def view_predictions(spark, sf_dir):
    latest = views.of_latest(prediction_table(spark, sf_dir), two_runs(spark, sf_dir))
    out = views.predictions(
        latest, districts(spark, sf_dir), history(spark, sf_dir), crop="BUILDING", sort="change_vs_baseline",
        order="desc", offset=10,
    )
    return _plain(out)


@register(
    "view_predictions_state",
    o.query(
        _PREDICTIONS,
        f"SELECT {_SHAPED} FROM rows WHERE state = 'NATION_4' AND drought ORDER BY district, slug, crop LIMIT 200",
    ),
)
def view_predictions_state(spark, sf_dir):
    latest = views.of_latest(prediction_table(spark, sf_dir), two_runs(spark, sf_dir))
    out = views.predictions(
        latest, districts(spark, sf_dir), history(spark, sf_dir), state="Nation 4", flagged_only=True, limit=200
    )
    return _plain(out)


@register(
    "view_prediction_detail",
    o.query(
        _PREDICTIONS,
        f"""SELECT {_SHAPED}, {o.num('round_even(baseline, 1)', 1, 'baseline_yield_kg_ha')},
        baseline_yield_year::INTEGER AS baseline_yield_year, 'rows until {SECOND_CUT}' AS prediction_basis,
        {o.num('round_even(pred_upper - pred_lower, 1)', 1, 'interval_width_kg_ha')}
        FROM rows WHERE slug = (SELECT min(slug) FROM rows WHERE crop = 'MACHINERY') AND crop = 'MACHINERY'""",
    ),
)
def view_prediction_detail(spark, sf_dir):
    latest = views.of_latest(prediction_table(spark, sf_dir), two_runs(spark, sf_dir))
    places = districts(spark, sf_dir)
    mine = latest.where(F.col("crop") == "MACHINERY").join(places, "district_id")
    first = mine.agg(F.min("slug")).first()[0]
    return _plain(views.prediction(latest, places, history(spark, sf_dir), first, "MACHINERY"))


@register(
    "page_total",
    o.query(_PREDICTIONS, "SELECT count(*)::BIGINT AS total FROM rows WHERE state = 'NATION_4'"),
)
def page_total(spark, sf_dir):
    latest = views.of_latest(prediction_table(spark, sf_dir), two_runs(spark, sf_dir))
    rows = views.prediction_rows(latest, districts(spark, sf_dir), history(spark, sf_dir))
    return views.total(views.in_state(rows, "NATION_4"))


@register(
    "view_alert_type",
    o.query(
        _PREDICTIONS,
        """SELECT CASE WHEN drought THEN 'drought' WHEN flood THEN 'flood' ELSE 'general' END AS alert_type,
        count(*)::BIGINT AS n FROM rows GROUP BY ALL""",
    ),
)
def view_alert_type(spark, sf_dir):
    latest = views.of_latest(prediction_table(spark, sf_dir), two_runs(spark, sf_dir))
    rows = views.prediction_rows(latest, districts(spark, sf_dir), history(spark, sf_dir))
    return views.alert_type(rows).groupBy("alert_type").agg(F.count(F.lit(1)).alias("n"))


@register(
    "view_run_basis",
    o.query(
        _PREDICTIONS,
        f"SELECT 'rows until {SECOND_CUT}' AS prediction_basis, count(*)::BIGINT AS n, "
        "max(baseline_yield_year)::INTEGER AS baseline_yield_year FROM rows",
    ),
)
def view_run_basis(spark, sf_dir):
    return views.main_basis(views.of_latest(prediction_table(spark, sf_dir), two_runs(spark, sf_dir)))


_CHANGES = ("yield_change", "rai_change", "severity_change")


def watch_events(spark, sf_dir):
    rows = alerts(spark, sf_dir).withColumn("district_id", F.col("custkey").cast("int"))
    return sinks.watch_rows(untied(rows, *_CHANGES), "second", "first")


_WATCH = ALERTS_SQL + f""",
    listed AS (SELECT * REPLACE ({', '.join(f'{c} + {_OFF_TIE} AS {c}' for c in ('pred_yield', *_CHANGES))}), {_SLUG.format('state')} || '/' || {_SLUG.format('district')} AS slug FROM alerts)"""


@register(
    "view_watch",
    o.query(
        _WATCH,
        f"""SELECT state, district, slug, crop, alert_level, {o.num('round_even(pred_yield, 1)', 1, 'pred_yield_kg_ha')},
        {o.num('round_even(yield_change, 1)', 1, 'yield_change_kg_ha')}, {o.num('round_even(rai_change, 2)', 2, 'rai_change')},
        {o.num('round_even(severity_change, 2)', 2, 'severity_change')} FROM listed
        ORDER BY CASE alert_level WHEN 'urgent' THEN 0 WHEN 'watch' THEN 1 WHEN 'new' THEN 2 WHEN 'elevated_stable' THEN 3
                 WHEN 'minor_change' THEN 4 WHEN 'stable' THEN 5 ELSE 6 END, abs(coalesce(yield_change, 0)) DESC, slug, crop
        LIMIT 100 OFFSET 5""",
    ),
)
def view_watch(spark, sf_dir):
    out = views.watch(
        watch_events(spark, sf_dir), prediction_table(spark, sf_dir), districts(spark, sf_dir), limit=100, offset=5
    )
    return tidy(out.drop("change_note"), 2)


@register(
    "view_watch_level",
    o.query(
        _WATCH,
        f"""SELECT slug, crop, alert_level, {o.num('round_even(yield_change, 1)', 1, 'yield_change_kg_ha')} FROM listed
        WHERE alert_level = 'minor_change' AND state = 'NATION_7'
        ORDER BY abs(coalesce(yield_change, 0)) DESC, slug, crop LIMIT 50""",
    ),
)
def view_watch_level(spark, sf_dir):
    out = views.watch(
        watch_events(spark, sf_dir), prediction_table(spark, sf_dir), districts(spark, sf_dir), level=" Minor_Change ",
        state="nation_7",
    )
    return tidy(out.select("slug", "crop", "alert_level", "yield_change_kg_ha"), 1)


@register(
    "view_watch_counts",
    o.query(ALERTS_SQL, "SELECT alert_level, count(*)::BIGINT AS n FROM alerts GROUP BY ALL"),
)
def view_watch_counts(spark, sf_dir):
    return views.watch_counts(watch_events(spark, sf_dir))


def risk_table(spark, sf_dir):
    rows = anomaly.season_to_date(fx.daily(spark, sf_dir), 2001, 1996, as_of="2001-11-05")
    return sinks.risk_rows(rows.join(site_ids(spark, sf_dir), SITE), "second")


def supplier_districts(spark, sf_dir):
    rows = fx.supplier_sites(spark, sf_dir)
    return rows.select(F.col("site").cast("int").alias("district_id"), f.site_slug().alias("slug"), *SITE, "lat", "lon")


_RISK = o.DAILY + f""",
    totals AS (SELECT state, district, y, sum(rainfall_mm) AS total, count(rainfall_mm) AS days FROM daily
               WHERE y BETWEEN 1996 AND 2001 AND date >= make_date(y, 6, 1) AND date - make_date(y, 6, 1)
                 <= (SELECT max(date) FROM daily WHERE y = 2001 AND m >= 6) - DATE '2001-06-01' GROUP BY ALL),
    stats AS (SELECT state, district, max(total) FILTER (WHERE y = 2001) AS t, max(days) FILTER (WHERE y = 2001) AS days,
                avg(total) FILTER (WHERE y < 2001) AS mean, stddev_samp(total) FILTER (WHERE y < 2001) AS std,
                count(total) FILTER (WHERE y < 2001) AS n FROM totals GROUP BY ALL),
    risks AS (SELECT *, {_SLUG.format('state')} || '/' || {_SLUG.format('district')} AS slug, (t - mean) / nullif(std, 0) AS z
              FROM stats),
    levels AS (SELECT *, CASE WHEN z IS NULL OR n < 3 THEN 'insufficient_data' WHEN z < -1.2 THEN 'high'
                 WHEN z < -0.5 THEN 'moderate' ELSE 'low' END AS risk_level FROM risks)"""


@register(
    "view_risk",
    o.query(
        _RISK,
        f"""SELECT state, district, slug, risk_level, {o.num('round_even(z, 2)', 2, 'zscore')},
        {o.num('round_even(t, 1)', 1, 'partial_rainfall_mm')}, days::BIGINT AS days_elapsed,
        {o.num('round_even(mean, 1)', 1, 'hist_mean_mm')}, {o.num('round_even(std, 1)', 1, 'hist_std_mm')},
        n::BIGINT AS n_years, {o.num('CASE WHEN mean > 0 THEN round_even((t - mean) / mean * 100, 1) END', 1, 'rainfall_vs_normal_pct')}
        FROM levels ORDER BY CASE risk_level WHEN 'high' THEN 0 WHEN 'moderate' THEN 1 WHEN 'low' THEN 2 ELSE 3 END,
        z NULLS LAST, slug LIMIT 50 OFFSET 3""",
    ),
)
def view_risk(spark, sf_dir):
    out = views.risk(risk_table(spark, sf_dir), supplier_districts(spark, sf_dir), offset=3)
    return tidy(out.drop("explanation"), 2)


@register(
    "view_risk_counts",
    o.query(_RISK, "SELECT risk_level, count(*)::BIGINT AS n FROM levels GROUP BY ALL"),
)
def view_risk_counts(spark, sf_dir):
    return views.risk_counts(risk_table(spark, sf_dir))


@register(
    "view_sites",
    o.query(
        "",
        f"""SELECT {_SITE_SLUG} AS slug, n_name AS state, c_name AS district,
        {o.num('24.0::DOUBLE + (c_custkey % 97) * 0.05::DOUBLE', 2, 'lat')}, {o.num('74.0::DOUBLE + (c_custkey % 89) * 0.05::DOUBLE', 2, 'lon')}
        FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_2'
        ORDER BY district DESC, slug LIMIT 20 OFFSET 20""",
    ).replace("WITH \n", ""),
)
def view_sites(spark, sf_dir):
    return tidy(views.sites(districts(spark, sf_dir), "Nation_2", "district", "desc", 20, 20), 2)


@register(
    "view_coverage",
    o.query(
        o.YIELD,
        """SELECT custkey::INTEGER AS district_id, crop, season, min(year)::INTEGER AS first_year, max(year)::INTEGER AS last_year,
        count(*)::BIGINT AS n_years FROM yield_panel GROUP BY ALL""",
    ),
)
def view_coverage(spark, sf_dir):
    return views.coverage(history(spark, sf_dir), ["district_id", "crop", "season"])


@register(
    "view_crop_coverage",
    o.query(
        _PREDICTIONS,
        f"""SELECT crop, count(*)::BIGINT AS n,
        {o.num('round_even(avg((baseline BETWEEN pred_lower AND pred_upper)::INT), 3)', 3, 'coverage')}
        FROM rows WHERE baseline IS NOT NULL GROUP BY ALL""",
    ),
)
def view_crop_coverage(spark, sf_dir):
    latest = views.of_latest(prediction_table(spark, sf_dir), two_runs(spark, sf_dir))
    rows = views.prediction_rows(latest, districts(spark, sf_dir), history(spark, sf_dir))
    tested = rows.where(F.col("baseline_yield").isNotNull()).select(
        F.lit("v1").alias("model_version"), "crop", F.col("baseline_yield").alias("actual"),
        F.col("pred_lower").alias("lower"), F.col("pred_upper").alias("upper"),
    )
    return tidy(views.crop_coverage(tested, "v1"), 3)


@register(
    "view_environment",
    o.query(
        o.SEASONAL,
        f"""SELECT site::INTEGER AS district_id, year::INTEGER AS year, 'Kharif' AS season, 'rainfall_mm' AS metric,
        {o.num('nasa_rainfall_kharif', 4, 'value')}
        FROM seasonal JOIN site USING (state, district) WHERE nasa_rainfall_kharif IS NOT NULL""",
    ),
)
def view_environment(spark, sf_dir):
    rows = weather.seasonal(fx.daily(spark, sf_dir)).join(site_ids(spark, sf_dir), SITE)
    env = panel.to_long(rows, ["district_id", "year"])
    return tidy(views.environment(env, metric="rainfall_mm", season="Kharif"))


# ---- advice and scenarios -------------------------------------------------------------------------------------

_ADVICE = o.YIELD + "," + o.LAGS + """,
    gaps AS (
      SELECT l.*, lag(yield_kg_ha) OVER w - lag(mean) OVER w AS gap FROM (
        SELECT *, avg(yield_kg_ha) OVER (PARTITION BY state, crop, year) AS mean FROM lags) l
      WINDOW w AS (PARTITION BY state, district, crop ORDER BY year, season)),
    advised AS (
      SELECT *, (area_ha < 1.5)::INTEGER AS drought_flag, (area_ha > 2.5)::INTEGER AS flood_flag, lag_yield_1 AS pred_yield,
             lag_yield_1 * (1 - area_ha / 20) AS pred_lower, lag_yield_1 * (1 + area_ha / 20) AS pred_upper
      FROM gaps WHERE lag_yield_1 IS NOT NULL)"""


def advised_rows(spark, sf_dir):
    rows = panel.gap_vs_state(panel.yield_lags(fx.yield_panel(spark, sf_dir)))
    area, last = F.col("area_ha"), F.col("lag_yield_1")
    return rows.where(last.isNotNull()).withColumns(
        {
            "drought_flag": (area < 1.5).cast("int"), "flood_flag": (area > 2.5).cast("int"), "pred_yield": last,
            "pred_lower": last * (1 - area / 20), "pred_upper": last * (1 + area / 20),
        }
    )


_ENTRIES = [
    ("drought_flag = 1", "alert", "Drought conditions"),
    ("flood_flag = 1", "alert", "Excess rainfall"),
    ("(pred_upper - pred_lower) * 100.0 / pred_yield > 28", "caution", "Wide forecast range"),
    ("coalesce(gap < -400, false)", "caution", "Below state average"),
]


@register(
    "advisory",
    o.query(
        _ADVICE,
        " UNION ALL ".join(
            f"SELECT district, crop, year::INTEGER AS year, '{lv}' AS level, '{t}' AS title FROM advised WHERE {c}"
            for c, lv, t in _ENTRIES
        )
        + " UNION ALL SELECT district, crop, year::INTEGER, 'normal', 'No findings' FROM advised WHERE "
        + " AND ".join(f"NOT ({c})" for c, _, _ in _ENTRIES),
    ),
)
def advisory(spark, sf_dir):
    return views.advisories(advised_rows(spark, sf_dir)).select("district", "crop", "year", "level", "title")


@register(
    "map_bucket",
    o.query(
        _ADVICE,
        """SELECT bucket, change_bucket, count(*)::BIGINT AS n FROM (
        SELECT CASE WHEN drought_flag = 1 THEN 'drought' WHEN flood_flag = 1 THEN 'flood' WHEN pred_yield < 100000 THEN 'low'
                    WHEN pred_yield < 200000 THEN 'mid' ELSE 'high' END AS bucket,
               CASE WHEN drought_flag = 1 THEN 'drought' WHEN flood_flag = 1 THEN 'flood'
                    WHEN pred_yield - yield_kg_ha > 0 THEN 'higher' ELSE 'lower' END AS change_bucket
        FROM advised) GROUP BY ALL""",
    ),
)
def map_bucket(spark, sf_dir):
    rows = advised_rows(spark, sf_dir)
    change = F.col("pred_yield") - F.col("yield_kg_ha")
    out = rows.select(
        K.map_bucket("drought_flag", "flood_flag", "pred_yield", 100000.0, 200000.0).alias("bucket"),
        K.change_bucket("drought_flag", "flood_flag", change).alias("change_bucket"),
    )
    return out.groupBy("bucket", "change_bucket").agg(F.count(F.lit(1)).alias("n"))


_SCENARIOS = [(-50.0, 0.0), (-25.0, 1.5), (0.0, 0.0), (25.0, -1.0), (10.0, 3.0)]


@register(
    "scenario_grid",
    o.query(
        o.SEASONAL + "," + o.RAI,
        f"""SELECT state, district, year::INTEGER AS year, rain_pct, temp_c, {o.num('rain', 4, 'nasa_rainfall_rabi')},
        {o.num('tavg', 4, 'nasa_temp_avg_rabi')}, {o.num('rain * 2 - tavg * 30 - (nasa_rainfall_rabi * 2 - nasa_temp_avg_rabi * 30)', 4, 'delta')},
        CASE WHEN rain_pct <= -25 THEN 1 ELSE coalesce(rainfall_anomaly_index < -1, false)::INTEGER END::INTEGER AS drought_flag,
        CASE WHEN rain_pct >= 25 THEN 1 ELSE coalesce(rainfall_anomaly_index > 1, false)::INTEGER END::INTEGER AS flood_flag
        FROM (SELECT *, nasa_rainfall_rabi * (1 + rain_pct / 100) AS rain, nasa_temp_avg_rabi + temp_c AS tavg
              FROM rai, (VALUES {', '.join(f'({a}::DOUBLE, {b}::DOUBLE)' for a, b in _SCENARIOS)}) s(rain_pct, temp_c)
              WHERE nasa_rainfall_rabi IS NOT NULL AND nasa_temp_avg_rabi IS NOT NULL)""",
    ),
)
def scenario_grid(spark, sf_dir):
    """Scored with a fixed linear response, so that the result can be checked."""
    rows = anomaly.rai_history(weather.seasonal(fx.daily(spark, sf_dir)))
    rows = rows.dropna(subset=["nasa_rainfall_rabi", "nasa_temp_avg_rabi"])

    def response(df):
        return df.withColumn("scenario_yield", F.col("nasa_rainfall_rabi") * 2 - F.col("nasa_temp_avg_rabi") * 30)

    base = response(rows).withColumnRenamed("scenario_yield", "pred_yield")
    features = ["nasa_rainfall_rabi", "nasa_temp_avg_rabi"]
    out = scenario.scenario_grid(base, features, _SCENARIOS, response)
    return tidy(out.select(*SITE, "year", "rain_pct", "temp_c", *features, "delta", "drought_flag", "flood_flag"))


@register(
    "daily_scenario",
    o.query(
        o.DAILY,
        f"""SELECT state, district, cy::INTEGER AS year, {o.num('rain', 4, 'nasa_rainfall_kharif')},
        {o.num('tmax', 4, 'nasa_temp_max_kharif')}, {o.num('tavg', 4, 'nasa_temp_avg_kharif')}, hot::BIGINT AS heat_stress_days
        FROM (SELECT state, district, cy,
          sum(CASE WHEN day >= 20 AND day < 34 THEN 0 ELSE rainfall_mm * (1 + -20 / 100.0::DOUBLE) END) FILTER (WHERE season = 'Kharif') AS rain,
          avg(temp_max_c + 1.5 + CASE WHEN day >= 10 AND day < 15 THEN 4 ELSE 0 END) FILTER (WHERE season = 'Kharif') AS tmax,
          avg(temp_avg_c + 1.5 + CASE WHEN day >= 10 AND day < 15 THEN 4 ELSE 0 END) FILTER (WHERE season = 'Kharif') AS tavg,
          count(*) FILTER (WHERE temp_max_c + 1.5 + CASE WHEN day >= 10 AND day < 15 THEN 4 ELSE 0 END > 35) AS hot,
          count(*) FILTER (WHERE season = 'Kharif') AS k
          FROM (SELECT *, CASE WHEN season = 'Kharif' THEN date - make_date(y, 6, 1) END AS day FROM daily) GROUP BY ALL) WHERE k > 0""",
    ),
)
def daily_scenario(spark, sf_dir):
    """Rain down by a fifth, a two-week dry spell, warmer days and a five-day heatwave; features recomputed."""
    days = scenario.scale_rain(fx.daily(spark, sf_dir), -20.0)
    day = F.when(S.is_kharif("date"), S.block_day("date"))
    days = scenario.dry_spell(days, day, 20, 14)
    days = scenario.heatwave(scenario.shift_temperature(days, 1.5), day, 10, 5, 4.0)
    out = weather.seasonal(days).where(F.col("nasa_rainfall_kharif").isNotNull())
    columns = ["nasa_rainfall_kharif", "nasa_temp_max_kharif", "nasa_temp_avg_kharif"]
    return tidy(out.select(*SITE, "year", *columns, "heat_stress_days"))


@register(
    "scenario_range_warnings",
    o.query(
        o.SEASONAL + """,
        spans AS (SELECT state, district, min(nasa_rainfall_kharif) AS lo, max(nasa_rainfall_kharif) AS hi,
                  min(nasa_temp_avg_kharif) AS tlo, max(nasa_temp_avg_kharif) AS thi FROM seasonal GROUP BY ALL)""",
        """SELECT feature, count(*)::BIGINT AS n FROM (
        SELECT 'nasa_rainfall_kharif' AS feature FROM seasonal JOIN spans USING (state, district)
          WHERE nasa_rainfall_kharif * 1.3 < lo OR nasa_rainfall_kharif * 1.3 > hi
        UNION ALL SELECT 'nasa_temp_avg_kharif' FROM seasonal JOIN spans USING (state, district)
          WHERE nasa_temp_avg_kharif + 1 < tlo OR nasa_temp_avg_kharif + 1 > thi) GROUP BY ALL""",
    ),
)
def scenario_range_warnings(spark, sf_dir):
    seasonal = weather.seasonal(fx.daily(spark, sf_dir))
    columns = ["nasa_rainfall_kharif", "nasa_temp_avg_kharif"]
    moved = seasonal.withColumns({columns[0]: F.col(columns[0]) * 1.3, columns[1]: F.col(columns[1]) + 1})
    warned = scenario.out_of_range(moved, seasonal, columns, SITE)
    return warned.select(F.explode("out_of_range").alias("feature")).groupBy("feature").agg(F.count(F.lit(1)).alias("n"))


# ---- JSON, text, raster ---------------------------------------------------------------------------------------

@register(
    "payload_explode",
    o.query(
        o.DAILY,
        f"""SELECT state, district, date, {o.nums('rainfall_mm', 'temp_max_c', 'humidity_pct')} FROM daily""",
    ),
)
def payload_explode(spark, sf_dir):
    """Documents of one site and year are written as JSON text and read back as daily rows."""
    days = fx.daily(spark, sf_dir)
    days = days.withColumn("day", F.date_format("date", "yyyyMMdd"))
    # at most 366 entries per document; one list holds all measures of a day, so that a row enters one buffer only
    listed = F.collect_list(F.struct("day", *readers.PAYLOAD_VARIABLES.values()))
    documents = days.groupBy("state", "district", "lat", "lon", F.year("date").alias("year")).agg(listed.alias("days"))

    def known(c: str):
        return F.transform(F.filter("days", lambda d: d[c].isNotNull()), lambda d: F.struct(d["day"], d[c]))

    documents = documents.withColumns({code: F.map_from_entries(known(c)) for code, c in readers.PAYLOAD_VARIABLES.items()})
    names = list(readers.PAYLOAD_VARIABLES)
    parameter = F.create_map(*[x for code in names for x in (F.lit(code), F.col(code))])
    body = F.to_json(F.struct(F.struct(parameter.alias("parameter")).alias("properties")))
    landed = documents.select("state", "district", "lat", "lon", body.alias("body"))
    schema = "struct<properties: struct<parameter: map<string, map<string, double>>>>"
    parsed = landed.withColumn("j", F.from_json("body", schema)).select("state", "district", "lat", "lon", "j.properties")
    rows = readers.explode_payload(parsed)
    return tidy(rows.select("state", "district", "date", "rainfall_mm", "temp_max_c", "humidity_pct"))


@register(
    "json_features",
    o.query(
        "",
        f"""SELECT event_type, count(*)::BIGINT AS n, {o.num("sum((props->>'$.k')::DOUBLE)", 2, 'total')},
        count(props->>'$.missing')::BIGINT AS n_missing_field FROM events GROUP BY ALL""",
    ).replace("WITH \n", ""),
)
def json_features(spark, sf_dir):
    events = fx.table(spark, sf_dir, "events")
    rows = events.select("event_type", f.json_number("props", "k").alias("k"), f.json_number("props", "missing").alias("x"))
    return tidy(
        rows.groupBy("event_type").agg(
            F.count(F.lit(1)).alias("n"), F.sum("k").alias("total"), F.count("x").alias("n_missing_field")
        ),
        2,
    )


@register(
    "json_objects",
    o.query(
        "",
        """SELECT p_partkey, '{"size":' || p_size || ',"brand":"' || p_brand || '","none":null}' AS body,
        'part_' || sha256(p_name)[1:8] AS version FROM part""",
    ).replace("WITH \n", ""),
)
def json_objects(spark, sf_dir):
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    rows = parts.select(
        "p_partkey", "p_name", F.col("p_size").alias("size"), F.col("p_brand").alias("brand"),
        F.lit(None).cast("string").alias("none"),
    )
    return rows.select(
        "p_partkey", f.json_object(["size", "brand", "none"]).alias("body"), f.content_version("p_name", "part").alias("version")
    )


#: Named references in the given pages, all that the SQL twin decodes there.
_PAGE_REFERENCES = {"lt": "<", "gt": ">", "quot": '"', "#39": "'", "#x27": "'", "nbsp": "\u00a0", "copy": "\u00a9", "middot": "\u00b7"}


def clean_sql(column: str) -> str:
    """SQL twin of text.clean."""
    out = f"coalesce({column}, '')"
    for name, char in [*_PAGE_REFERENCES.items(), ("amp", "&")]:
        quoted = char.replace("'", "''")
        out = f"regexp_replace({out}, '&{name};?', '{quoted}', 'g')"
    out = f"translate(regexp_replace({out}, '<[^>]*>', ' ', 'g'), '<>', '  ')"
    blanks = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
    return f"trim(regexp_replace({out}, '{blanks}', ' ', 'g'))"


@register(
    "text_sanitise",
    o.query(
        "",
        f"""SELECT page_id, {clean_sql('html')} AS body, substring({clean_sql('html')}, 1, 280) AS snippet,
        coalesce(CASE WHEN length(trim(url)) <= 500 AND regexp_matches(trim(url), '(?i)^https?://[^\\s<>"'']+$')
             THEN trim(url) END, '') AS link,
        'a ' || chr((945 + page_id % 25)::INTEGER) || ' —é…≪ ' || chr((128512 + page_id % 60)::INTEGER) || ' &lt; x' AS spelled
        FROM pages""",
    ).replace("WITH \n", ""),
)
def text_sanitise(spark, sf_dir):
    """The pages, and references spelled in every way: decimal, hexadecimal, named, doubly escaped."""
    pages = fx.table(spark, sf_dir, "pages")
    spelled = F.concat(
        F.lit("a &#"), (945 + F.col("page_id") % 25).cast("string"), F.lit("; &mdash;&eacute;&hellip;&Lt; &#x"),
        F.lower(F.hex(128512 + F.col("page_id") % 60)), F.lit("; &amp;lt; <b>x"),
    )
    return pages.select(
        "page_id", text.clean("html").alias("body"), text.clean("html", text.LIMITS["snippet"]).alias("snippet"),
        F.coalesce(text.link("url"), F.lit("")).alias("link"), text.clean(spelled).alias("spelled"),
    )


@register(
    "text_sections",
    o.query(
        "found AS (SELECT page_id, (page_id % 20)::INTEGER AS section, trim(url) AS url, html FROM pages "
        "WHERE length(trim(url)) <= 500 AND regexp_matches(trim(url), '(?i)^https?://[^\\s<>\"'']+$')), "
        "first AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY page_id) AS position FROM found)",
        f"""SELECT n_nationkey::INTEGER AS section, n_name AS category, 'rain & ' || n_name AS query,
        count(url)::BIGINT AS n_results, coalesce(string_agg(url, ' ' ORDER BY position), '') AS urls,
        coalesce(string_agg(substring({clean_sql('html')}, 1, 280), ' ' ORDER BY position), '') AS snippets,
        (n_regionkey = 1)::INTEGER AS failed
        FROM nation LEFT JOIN (SELECT * FROM first WHERE position <= 3) f ON f.section = n_nationkey
        GROUP BY n_nationkey, n_name, n_regionkey""",
    ),
)
def text_sections(spark, sf_dir):
    """Retrieved pages under the nations; five nations have none, one region's source failed."""
    pages = fx.table(spark, sf_dir, "pages")
    results = pages.select(
        (F.col("page_id") % 20).cast("int").alias("section"), "page_id", "url", F.col("url").alias("title"), F.col("html").alias("content")
    )
    sections = fx.table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("int").alias("section"), F.concat(F.lit("&lt;b&gt;"), "n_name", F.lit("</b>")).alias("category"),
        F.concat(F.lit("rain &amp;  "), "n_name").alias("query"), F.when(F.col("n_regionkey") == 1, "timeout").alias("error"),
    )
    shaped = text.shape_sections(sections, results, "section", "page_id")
    return shaped.select(
        "section", "category", "query", F.size("results").cast("long").alias("n_results"),
        F.array_join("results.url", " ").alias("urls"), F.array_join("results.snippet", " ").alias("snippets"),
        F.col("failed").cast("int").alias("failed"),
    )


@register(
    "text_top_results",
    o.query(
        "found AS (SELECT page_id, trim(url) AS url, html, split_part(url, '/', 3) AS host FROM pages "
        "WHERE length(trim(url)) <= 500 AND regexp_matches(trim(url), '(?i)^https?://[^\\s<>\"'']+$'))",
        f"""SELECT host, page_id, position::INTEGER AS position, url, substring({clean_sql('url')}, 1, 160) AS title,
        substring({clean_sql('html')}, 1, 280) AS snippet FROM (
        SELECT *, row_number() OVER (PARTITION BY host ORDER BY page_id) AS position FROM found) WHERE position <= 3""",
    ),
)
def text_top_results(spark, sf_dir):
    pages = fx.table(spark, sf_dir, "pages")
    rows = pages.select(
        F.split_part("url", F.lit("/"), F.lit(3)).alias("host"), "page_id", "url", F.col("url").alias("title"),
        F.col("html").alias("content"),
    )
    return text.top_results(rows, "host", "page_id").select("host", "page_id", "position", "url", "title", "snippet")


_NEAR = """
    sites AS (SELECT n_name AS state, s_name AS district, 24.0::DOUBLE + (s_suppkey % 97) * 0.05::DOUBLE AS slat,
              74.0::DOUBLE + (s_suppkey % 89) * 0.05::DOUBLE AS slon FROM supplier JOIN nation ON s_nationkey = n_nationkey),
    pixels AS (SELECT 24.0::DOUBLE + (o_orderkey * 7 % 97) * 0.05::DOUBLE AS lat,
               74.0::DOUBLE + (o_orderkey * 13 % 89) * 0.05::DOUBLE AS lon, CAST(o_orderdate AS DATE) AS date,
               o_totalprice AS value, o_orderkey % 4 AS water_class FROM orders),
    per_pixel AS (SELECT lat, lon, {period}, avg({value}) AS v FROM pixels WHERE {where} GROUP BY ALL),
    near AS (
      SELECT s.*, p.* FROM sites s JOIN per_pixel p ON abs(p.lat - s.slat) < 0.2 AND abs(p.lon - s.slon) < 0.2
      AND 2 * 6371008.8::DOUBLE * asin(sqrt(sin(radians(p.lat - s.slat) / 2) ** 2
        + cos(radians(p.lat)) * cos(radians(s.slat)) * sin(radians(p.lon - s.slon) / 2) ** 2)) <= 7000)"""
_SEASON = "CASE WHEN month(date) BETWEEN 6 AND 10 THEN 'Kharif' ELSE 'Rabi' END"


@register(
    "zonal_mean",
    o.query(
        _NEAR.format(
            period=f"{_SEASON} AS season, year(date) - CASE WHEN month(date) < 6 THEN 1 ELSE 0 END AS year",
            value="value * 0.0001::DOUBLE",
            where="month(date) NOT IN (4, 5) AND strftime(date, '%m-%d') NOT IN ('10-31', '03-31')",
        ),
        f"""SELECT state, district, year::INTEGER AS year, {o.num("avg(v) FILTER (WHERE season = 'Kharif')", 4, 'ndvi_kharif')},
        {o.num("avg(v) FILTER (WHERE season = 'Rabi')", 4, 'ndvi_rabi')} FROM near GROUP BY ALL""",
    ),
)
def zonal_mean(spark, sf_dir):
    return tidy(zonal.zonal_mean(fx.pixels(spark, sf_dir), fx.supplier_sites(spark, sf_dir), 7000.0))


@register(
    "zonal_share",
    o.query(
        _NEAR.format(period="year(date) AS year", value="(water_class >= 2)::INT * 100.0::DOUBLE", where="true"),
        f"""SELECT state, district, year::INTEGER AS year, {o.num('avg(v)', 4, 'water_pct_kharif')},
        {o.num('avg(v)', 4, 'water_pct_rabi')} FROM near GROUP BY ALL""",
    ),
)
def zonal_share(spark, sf_dir):
    sites = fx.supplier_sites(spark, sf_dir)
    return tidy(zonal.zonal_share(fx.pixels(spark, sf_dir), sites, F.col("water_class") >= 2, 7000.0))


# ---- attribution views ----------------------------------------------------------------------------------------

_PARTS = ["rain_part", "temp_part", "area_part", "trend_part"]
_CONTRIB = o.YIELD + "," + o.LAGS + """,
    parts AS (SELECT district, crop, year, lag_yield_1 - lag_yield_2 AS rain_part, (lag_yield_1 - 150000) / 3 AS temp_part,
              area_ha * 1000 AS area_part, lag_yield_3 / 10 AS trend_part FROM lags WHERE lag_yield_3 IS NOT NULL)"""
_CONTRIB = _CONTRIB.replace("parts AS (", "raw_parts AS (") + f""",
    parts AS (SELECT * REPLACE ({', '.join(f'{c} + {_OFF_TIE} AS {c}' for c in _PARTS)}) FROM raw_parts)"""


def contributions(spark, sf_dir):
    rows = panel.yield_lags(fx.yield_panel(spark, sf_dir)).where(F.col("lag_yield_3").isNotNull())
    last = F.col("lag_yield_1")
    rows = rows.withColumns(
        {
            "rain_part": last - F.col("lag_yield_2"), "temp_part": (last - 150000) / 3,
            "area_part": F.col("area_ha") * 1000, "trend_part": F.col("lag_yield_3") / 10,
        }
    )
    rows = untied(rows, *_PARTS)
    return rows.select("district", "crop", "year", panel.feature_map(_PARTS).alias("attributions"))


_UNPIVOTED = " UNION ALL ".join(f"SELECT district, crop, year, '{c}' AS feature, {c} AS v FROM parts" for c in _PARTS)


@register(
    "importance_share",
    o.query(
        _CONTRIB,
        f"""SELECT feature, {o.num('imp', 4, 'importance')}, {o.num('imp * 100 / sum(imp) OVER ()', 4, 'pct_of_total')}
        FROM (SELECT feature, avg(abs(v)) AS imp FROM ({_UNPIVOTED}) GROUP BY ALL)""",
    ),
)
def importance_share(spark, sf_dir):
    return tidy(metrics.importance(contributions(spark, sf_dir)))


@register(
    "importance_group_share",
    o.query(
        _CONTRIB,
        f"""SELECT {o.num("sum(imp) FILTER (WHERE feature IN ('rain_part', 'temp_part')) * 100 / sum(imp)", 4, 'pct')}
        FROM (SELECT feature, avg(abs(v)) AS imp FROM ({_UNPIVOTED}) GROUP BY ALL)""",
    ),
)
def importance_group_share(spark, sf_dir):
    return tidy(metrics.group_share(metrics.importance(contributions(spark, sf_dir)), ["rain", "temp"]))


@register(
    "top_factors",
    o.query(
        _CONTRIB,
        f"""SELECT district, crop, year::INTEGER AS year, rn::INTEGER AS position, feature, {o.num('round_even(v, 2)', 2, 'value')}
        FROM (SELECT *, row_number() OVER (PARTITION BY district, crop, year ORDER BY abs(v) DESC, feature) AS rn
              FROM ({_UNPIVOTED})) WHERE rn <= 2""",
    ),
)
def top_factors(spark, sf_dir):
    rows = contributions(spark, sf_dir).withColumn("top", explain.top_factors(k=2))
    rows = rows.select("district", "crop", "year", F.posexplode("top").alias("position", "t"))
    return tidy(rows.select("district", "crop", "year", (F.col("position") + 1).alias("position"), "t.feature", "t.value"), 2)


# ---- sinks ----------------------------------------------------------------------------------------------------

@register(
    "upsert_merge",
    o.query(
        "",
        f"""SELECT c_custkey AS k, CASE WHEN n IS NOT NULL THEN 'new' ELSE 'old' END AS source,
        {o.num('coalesce(n, 0)', 2, 'value')}, {o.num('c_acctbal', 2, 'first_value')}
        FROM customer LEFT JOIN (SELECT o_custkey, sum(o_totalprice) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01'
        GROUP BY ALL) ON c_custkey = o_custkey""",
    ).replace("WITH \n", ""),
)
def upsert_merge(spark, sf_dir):
    """Customers as the old table, the orders of the last year as the new rows; `first_value` keeps what was known."""
    old = fx.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("k"), F.lit("old").alias("source"), F.lit(0.0).alias("value"), F.col("c_acctbal").alias("first_value")
    )
    recent = fx.table(spark, sf_dir, "orders").where(F.col("o_orderdate") >= F.lit("2001-01-01").cast("timestamp_ntz"))
    new = recent.groupBy(F.col("o_custkey").alias("k")).agg(F.sum("o_totalprice").alias("value")).select(
        "k", F.lit("new").alias("source"), "value", F.lit(-1.0).alias("first_value")
    )
    return tidy(sinks.merge_rows(old, new, ["k"], ["first_value"]), 2)


@register(
    "failure_ledger",
    o.query(
        "",
        """SELECT n_name AS state, c_name AS district, 'no rows landed' AS error FROM customer JOIN nation ON c_nationkey = n_nationkey
        WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '2001-01-01')""",
    ).replace("WITH \n", ""),
)
def failure_ledger(spark, sf_dir):
    """Customers without any order in the last year."""
    everyone = fx.customer_sites(spark, sf_dir)
    landed = fx.yield_panel(spark, sf_dir).where(F.col("year") >= 2001)
    return sinks.failure_ledger(everyone, landed)


@register(
    "feature_maps",
    o.query(
        o.YIELD,
        f"""SELECT custkey::INTEGER AS district_id, crop, season, year::INTEGER AS year, 2::BIGINT AS n_features,
        {o.num('yield_kg_ha', 4, 'a')}, {o.num('area_ha', 4, 'b')} FROM yield_panel""",
    ),
)
def feature_maps(spark, sf_dir):
    rows = history(spark, sf_dir).withColumn("features", panel.feature_map(["yield_kg_ha", "area_ha"]))
    return tidy(
        rows.select(
            "district_id", "crop", "season", "year", F.size("features").cast("long").alias("n_features"),
            F.col("features")["yield_kg_ha"].alias("a"), F.col("features")["area_ha"].alias("b"),
        )
    )
