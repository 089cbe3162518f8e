"""SQL twins of the fixture views, used to check results with another engine."""

from __future__ import annotations

from agropanel.plans.registry import nudge

DAILY = """
site AS (
  SELECT s_suppkey AS site, n_name AS state, s_name AS district,
         24.0::DOUBLE + (s_suppkey % 97) * 0.05::DOUBLE AS lat,
         74.0::DOUBLE + (s_suppkey % 89) * 0.05::DOUBLE AS lon
  FROM supplier JOIN nation ON s_nationkey = n_nationkey),
shipped AS (
  SELECT l_suppkey AS site, CAST(l_shipdate AS DATE) AS date, sum(l_quantity) AS q,
         sum(round(l_discount * 100)::BIGINT)::DOUBLE / count(*) AS d, sum(round(l_tax * 100)::BIGINT)::DOUBLE / count(*) AS t,
         sum(round(l_extendedprice * 100)::BIGINT)::DOUBLE / count(*) AS p
  FROM lineitem GROUP BY 1, 2),
calendar AS (
  SELECT CAST(unnest(generate_series(first, last, INTERVAL 1 DAY)) AS DATE) AS date
  FROM (SELECT min(CAST(l_shipdate AS DATE)) AS first, max(CAST(l_shipdate AS DATE)) AS last FROM lineitem)),
daily AS (
  SELECT state, district, lat, lon, c.date, coalesce(q, 0)::DOUBLE AS rainfall_mm, 18 + 2.5::DOUBLE * d AS temp_max_c,
         14 - 2 * t AS temp_min_c, ((18 + 2.5::DOUBLE * d) + (14 - 2 * t)) / 2 AS temp_avg_c,
         10 * t AS humidity_pct, 10 + p / 500000 AS solar_radiation,
         year(c.date) AS y, month(c.date) AS m,
         year(c.date) - CASE WHEN month(c.date) < 6 THEN 1 ELSE 0 END AS cy,
         CASE WHEN month(c.date) BETWEEN 6 AND 10 THEN 'Kharif'
              WHEN month(c.date) IN (11, 12, 1, 2, 3) THEN 'Rabi' END AS season
  FROM site CROSS JOIN calendar c LEFT JOIN shipped s ON s.site = site.site AND s.date = c.date)"""

YIELD = """
yield_panel AS (
  SELECT n_name AS state, c_name AS district, c_mktsegment AS crop, 'S' AS season, year(o_orderdate) AS year,
         avg(o_totalprice) AS yield_kg_ha, count(*)::DOUBLE AS area_ha, c_custkey AS custkey
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  GROUP BY ALL)"""

SEASON_YIELD = """
season_yield AS (
  SELECT n_name AS state, c_name AS district, c_mktsegment AS crop,
         CASE WHEN month(o_orderdate) <= 6 THEN 'Rabi' ELSE 'Kharif' END AS season, year(o_orderdate) AS year,
         avg(o_totalprice) AS yield_kg_ha, count(*)::DOUBLE AS area_ha, o_orderstatus AS record
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  GROUP BY ALL)"""

COVARIATES = """
covariates AS (
  SELECT n_name AS state, c_name AS district, year(o_orderdate) AS year,
         CASE WHEN c_custkey % 11 <> 0 THEN sum(l_discount) END AS fertilizer_tons,
         CASE WHEN c_custkey % 11 <> 0 THEN sum(l_tax) END AS nitrogen_tons, sum(l_quantity) / 10000 AS irrigated_area_1000ha
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  GROUP BY n_name, c_name, c_custkey, year(o_orderdate))"""

ET0 = "0.0023::DOUBLE * solar_radiation * (temp_avg_c + 17.8::DOUBLE) * sqrt(greatest(temp_max_c - temp_min_c, 0))"


def block_sql(season: str, label: str) -> str:
    """Aggregates of one season block grouped by site and crop year."""
    f = f"FILTER (WHERE season = '{season}')"
    return f"""
    CASE WHEN count(*) {f} > 0 THEN coalesce(sum(rainfall_mm) {f}, 0) END AS nasa_rainfall_{label},
    avg(temp_avg_c) {f} AS nasa_temp_avg_{label}, avg(temp_max_c) {f} AS nasa_temp_max_{label},
    CASE WHEN count(*) {f} > 0 THEN coalesce(sum(greatest(temp_avg_c - 10, 0)) {f}, 0) END AS gdd_{label},
    CASE WHEN avg(rainfall_mm) {f} > 0 THEN stddev_samp(rainfall_mm) {f} / avg(rainfall_mm) {f} END
      AS rainfall_cv_{label},
    CASE WHEN count(*) {f} > 0 THEN coalesce(sum(rainfall_mm) {f}, 0) - coalesce(sum({ET0}) {f}, 0) END
      AS water_balance_{label}"""


STREAK = """
marked AS (
  SELECT state, district, season, cy, date, rainfall_mm < 1 AS dry,
         row_number() OVER (PARTITION BY state, district, season, cy ORDER BY date) AS i
  FROM daily WHERE season IS NOT NULL),
islands AS (
  SELECT *, i - row_number() OVER (PARTITION BY state, district, season, cy ORDER BY date) AS island
  FROM marked WHERE dry),
streaks AS (
  SELECT state, district, season, cy, max(n) AS streak
  FROM (SELECT state, district, season, cy, island, count(*) AS n FROM islands GROUP BY ALL) GROUP BY ALL)"""

SEASONAL = (
    DAILY
    + ","
    + STREAK
    + f""",
blocks AS (
  SELECT state, district, cy AS year, {block_sql('Kharif', 'kharif')}, {block_sql('Rabi', 'rabi')},
    avg(humidity_pct) FILTER (WHERE season = 'Kharif') AS nasa_humidity_kharif,
    count(*) FILTER (WHERE season = 'Kharif') AS k_rows, count(*) FILTER (WHERE season = 'Rabi') AS r_rows,
    coalesce(sum(rainfall_mm), 0) AS nasa_rainfall_annual, avg(solar_radiation) AS nasa_solar_annual,
    count(*) FILTER (WHERE temp_max_c > 35) AS heat_stress_days,
    count(*) FILTER (WHERE temp_min_c < 2) AS frost_risk_days
  FROM daily GROUP BY ALL),
seasonal AS (
  SELECT b.*, CASE WHEN k_rows > 0 THEN coalesce(k.streak, 0) END AS max_dry_streak_kharif,
    CASE WHEN r_rows > 0 THEN coalesce(r.streak, 0) END AS max_dry_streak_rabi,
    CASE WHEN r_rows > 0 THEN r_rows END AS rabi_days_observed,
    CASE WHEN r_rows > 0 THEN (r_rows < 140)::INT END AS rabi_season_partial
  FROM blocks b
  LEFT JOIN streaks k ON k.state = b.state AND k.district = b.district AND k.cy = b.year AND k.season = 'Kharif'
  LEFT JOIN streaks r ON r.state = b.state AND r.district = b.district AND r.cy = b.year AND r.season = 'Rabi')"""
)

RAI = """
rai AS (
  SELECT *, (nasa_rainfall_annual - mean_rainfall) / nullif(std_rainfall, 0) AS rainfall_anomaly_index
  FROM (SELECT *, avg(nasa_rainfall_annual) OVER w AS mean_rainfall,
               stddev_samp(nasa_rainfall_annual) OVER w AS std_rainfall
        FROM seasonal WINDOW w AS (PARTITION BY state, district)))"""


def num(expr: str, digits: int = 4, name: str | None = None) -> str:
    """Double rounded like registry.tidy, without negative zero."""
    rounded = f"round(({expr}) + {nudge(digits)!r}::DOUBLE, {digits})"
    return f"CASE WHEN {rounded} = 0 THEN 0.0::DOUBLE ELSE {rounded}::DOUBLE END AS {name or expr}"


def nums(*columns: str, digits: int = 4) -> str:
    return ", ".join(num(c, digits) for c in columns)


def ints(*columns: str) -> str:
    return ", ".join(f"{c}::INTEGER AS {c}" for c in columns)


def longs(*columns: str) -> str:
    return ", ".join(f"{c}::BIGINT AS {c}" for c in columns)


def query(ctes: str, body: str) -> str:
    return f"WITH {ctes.strip().strip(',')}\n{body.strip()}"


SITE_YIELD = """
site_yield AS (
  SELECT n_name AS state, s_name AS district,
         CASE l_returnflag WHEN 'R' THEN 'Wheat' WHEN 'A' THEN 'Rice' WHEN 'N' THEN 'Maize' ELSE l_returnflag END AS crop,
         CASE l_returnflag WHEN 'R' THEN 'Rabi' WHEN 'A' THEN 'Kharif' END AS season, year(l_shipdate) AS year,
         avg(l_extendedprice) AS yield_kg_ha, count(*)::DOUBLE AS area_ha
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL)"""

LAGS = """
lags AS (
  SELECT *, lag(yield_kg_ha, 1) OVER w AS lag_yield_1, lag(yield_kg_ha, 2) OVER w AS lag_yield_2,
         lag(yield_kg_ha, 3) OVER w AS lag_yield_3,
         CASE WHEN count(yield_kg_ha) OVER w3 >= 2 THEN avg(yield_kg_ha) OVER w3 END AS rolling_yield_3yr
  FROM yield_panel
  WINDOW w AS (PARTITION BY state, district, crop ORDER BY year, season),
         w3 AS (PARTITION BY state, district, crop ORDER BY year, season ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))"""


def snapshot_sql(name: str, until: str) -> str:
    return f"""
{name}_panel AS (
  SELECT n_name AS state, c_name AS district, c_mktsegment AS crop, c_custkey AS custkey, year(o_orderdate) AS year,
         avg(o_totalprice) AS yield_kg_ha, count(*)::DOUBLE AS area_ha
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  WHERE o_orderdate <= TIMESTAMP '{until}' GROUP BY ALL),
{name}_rows AS (
  SELECT state, district, crop, custkey, avg(yield_kg_ha) FILTER (WHERE rn <= 3) AS pred_yield,
         max(yield_kg_ha) FILTER (WHERE rn = 1) AS last_yield, max(year) FILTER (WHERE rn = 1) AS baseline_yield_year,
         max(area_ha) FILTER (WHERE rn = 1) AS rai
  FROM (SELECT *, row_number() OVER (PARTITION BY custkey ORDER BY year DESC) AS rn FROM {name}_panel) GROUP BY ALL),
{name}_spread AS (
  SELECT state, district, avg(area_ha) AS m, stddev_samp(area_ha) AS s FROM {name}_panel GROUP BY ALL),
{name} AS (
  SELECT r.*, abs((rai - m) / nullif(s, 0)) AS severity FROM {name}_rows r JOIN {name}_spread USING (state, district))"""
