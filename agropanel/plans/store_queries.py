"""Registered queries that write tables and read them back, and views and texts that no other query covers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from agropanel import schema as sc
from agropanel.functions import scalars as f
from agropanel.lineage import folder
from agropanel.operators import anomaly
from agropanel.plans import oracle as o
from agropanel.plans import serving_queries as serving
from agropanel.plans import views
from agropanel.plans.quality_queries import ALERTS_SQL, FIRST_CUT, SECOND_CUT, SITE, alerts, snapshot
from agropanel.plans.registry import register, tidy
from agropanel.sources import fixtures as fx
from agropanel.sources import landing, readers, sinks


def _place(spark, name: str) -> str:
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


@register(
    "snapshot_store",
    o.query(
        o.snapshot_sql("before", FIRST_CUT) + "," + o.snapshot_sql("now", SECOND_CUT),
        f"""SELECT 'newest' AS which, state, district, crop, {o.nums('pred_yield', 'rai', 'severity')} FROM now
        UNION ALL SELECT 'earlier', state, district, crop, {o.nums('pred_yield', 'rai', 'severity')} FROM before""",
    ),
)
def snapshot_store(spark, sf_dir):
    """Two stamps, the newer one written twice: both are read back once."""
    path, null = _place(spark, "snapshots"), F.lit(None)
    for stamp, cut in (("20000630_000000", FIRST_CUT), ("20010801_000000", SECOND_CUT), ("20010801_000000", SECOND_CUT)):
        rows = snapshot(spark, sf_dir, cut).withColumns(
            {"drought_flag": null.cast("int"), "flood_flag": null.cast("int"), "change": null.cast("double")}
        )
        sinks.append_snapshot(rows, path, stamp)
    newest, earlier = readers.latest_snapshot(spark, path), readers.latest_snapshot(spark, path, "20010801_000000")
    both = newest.withColumn("which", F.lit("newest")).unionByName(earlier.withColumn("which", F.lit("earlier")))
    return tidy(both.select("which", *SITE, "crop", "pred_yield", "rai", "severity"))


_YEARLY = f"SELECT state, district, crop, year::INTEGER AS year, season, {o.nums('area_ha', 'yield_kg_ha')} FROM yield_panel"


@register("csv_round_trip", o.query(o.YIELD, _YEARLY))
def csv_round_trip(spark, sf_dir):
    """Yields written as CSV and read with their schema."""
    path = _place(spark, "yields-csv")
    rows = fx.yield_panel(spark, sf_dir).withColumn("production_tons", F.lit(None).cast("double"))
    rows.select(*sc.YIELD.fieldNames()).write.option("header", True).csv(path)
    return tidy(readers.read_csv(spark, path, sc.YIELD).drop("production_tons"))


@register("parquet_round_trip", o.query(o.YIELD, _YEARLY))
def parquet_round_trip(spark, sf_dir):
    """Yields replaced as a whole table twice and read as an optional source."""
    path = _place(spark, "yields")
    rows = fx.yield_panel(spark, sf_dir).withColumn("production_tons", F.lit(None).cast("double")).select(*sc.YIELD.fieldNames())
    sinks.replace_table(rows.where("year < 1998"), path)
    sinks.replace_table(rows, path)
    return tidy(readers.read_optional(spark, path, sc.YIELD).drop("production_tons"))


@register(
    "upsert_store",
    o.query(
        o.YIELD,
        f"""SELECT custkey::INTEGER AS district_id, year::INTEGER AS year, {o.num('CASE WHEN year >= 1999 THEN yield_kg_ha * 2 ELSE yield_kg_ha END', 4, 'value')}
        FROM yield_panel""",
    ),
)
def upsert_store(spark, sf_dir):
    """A keyed table whose later years are written anew, by whole partitions."""
    path, keys = _place(spark, "env"), ["district_id", "year", "season", "metric"]
    rows = fx.yield_panel(spark, sf_dir).select(
        F.col("custkey").cast("int").alias("district_id"), F.col("year").cast("int").alias("year"), "season",
        F.lit("yield").alias("metric"), F.col("yield_kg_ha").alias("value"),
    )
    sinks.upsert(spark, rows, path, keys, sc.ENV_SEASONAL, partition_by=["year"])
    later = rows.where("year >= 1999").withColumn("value", F.col("value") * 2)
    for _ in range(2):
        sinks.upsert(spark, later, path, keys, sc.ENV_SEASONAL, partition_by=["year"])
    return tidy(readers.read_table(spark, path, sc.ENV_SEASONAL).select("district_id", "year", "value"))


@register(
    "run_store",
    o.query(
        o.YIELD,
        "SELECT 'second' AS run_id, count(*)::BIGINT AS n FROM yield_panel "
        "UNION ALL SELECT 'first', count(*) FROM yield_panel WHERE year <= 1999",
    ),
)
def run_store(spark, sf_dir):
    """Run-scoped appends; the first run is written twice and replaces its own partition only."""
    path, rows = _place(spark, "runs"), fx.yield_panel(spark, sf_dir)
    for run_id, part in (("first", rows), ("second", rows), ("first", rows.where("year <= 1999"))):
        sinks.append_run(part, path, run_id)
    return spark.read.parquet(path).groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))


@register(
    "failure_store",
    o.query(
        "",
        """SELECT n_name AS state, c_name AS district, 'no rows landed' AS error FROM customer JOIN nation ON c_nationkey = n_nationkey
        WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '2001-01-01')""",
    ).replace("WITH \n", ""),
)
def failure_store(spark, sf_dir):
    """The ledger of sites without rows of the last year, written and read as CSV."""
    path = _place(spark, "failures")
    landed = fx.yield_panel(spark, sf_dir).where(F.col("year") >= 2001)
    sinks.write_ledger(sinks.failure_ledger(fx.customer_sites(spark, sf_dir), landed), path)
    return readers.read_csv(spark, path, sc.FAILURES).select("state", "district", "error")


@register(
    "view_compare_sites",
    o.query(
        serving._PREDICTIONS,
        f"""SELECT slug, crop, {o.nums('pred_yield', 'pred_lower', 'pred_upper', digits=2)} FROM rows
        WHERE crop = 'BUILDING' AND slug IN (SELECT slug FROM rows WHERE custkey IN (1, 2, 4, 5, 7, 8, 10))""",
    ),
)
def view_compare_sites(spark, sf_dir):
    """Chosen sites of one crop side by side."""
    sites = serving.districts(spark, sf_dir)
    table = serving.prediction_table(spark, sf_dir).where("run_id = 'second'")
    slugs = [r["slug"] for r in sites.where("district_id in (1, 2, 4, 5, 7, 8, 10)").select("slug").collect()]
    return tidy(views.compare_sites(table, sites, slugs, "BUILDING"), 2)


@register(
    "view_risk_text",
    o.query(
        serving._RISK,
        """SELECT slug, CASE WHEN mean IS NOT NULL AND n >= 3 THEN round_even(t, 0)::BIGINT || ' mm so far (Jun 1–'
          || strftime((SELECT max(date) FROM daily WHERE y = 2001 AND m >= 6), '%b %d') || '), usual ' || round_even(mean, 0)::BIGINT
          || ' mm over ' || n || ' earlier years; data ' || (DATE '2001-11-05' - (SELECT max(date) FROM daily WHERE y = 2001 AND m >= 6))
          || ' days old.' ELSE 'Fewer than 3 earlier years to compare with.' END AS explanation FROM levels""",
    ),
)
def view_risk_text(spark, sf_dir):
    """The sentence on the season's rain of every site."""
    rows = anomaly.season_to_date(fx.daily(spark, sf_dir), 2001, 1996, as_of="2001-11-05")
    return rows.select(f.site_slug().alias("slug"), F.col("risk_explanation").alias("explanation"))


@register(
    "change_texts",
    o.query(
        ALERTS_SQL,
        """SELECT state, district, crop, CASE
          WHEN alert_level = 'new' THEN 'Site added since the last snapshot.'
          WHEN alert_level = 'stable' THEN 'No notable change since the last snapshot.'
          WHEN alert_level = 'elevated_stable' THEN 'Unchanged; severity still high at ' || printf('%.2f', round_even(severity, 2))
          WHEN alert_level = 'urgent' AND abs(yield_change) > 30000 AND (coalesce(severity_change > 0.3, false) OR yield_change < -15000)
            THEN 'Forecast moved ' || printf('%+.0f', round_even(yield_change, 0)) || ' kg/ha and is worsening.'
          WHEN alert_level = 'urgent' THEN 'Rainfall severity rising: ' || printf('%.2f', round_even(previous_severity, 2)) || ' -> '
            || printf('%.2f', round_even(severity, 2))
          WHEN alert_level = 'watch' AND yield_change > 0 THEN 'Forecast improved ' || printf('%+.0f', round_even(yield_change, 0)) || ' kg/ha'
          WHEN alert_level = 'watch' THEN 'Forecast declined ' || printf('%+.0f', round_even(yield_change, 0)) || ' kg/ha'
          ELSE 'Small change, ' || printf('%+.0f', round_even(yield_change, 0)) || ' kg/ha, below the alert limit.' END AS change_note
        FROM alerts""",
    ),
)
def change_texts(spark, sf_dir):
    """The sentence on every change of forecast."""
    return alerts(spark, sf_dir).select(*SITE, "crop", "change_note")


@register(
    "distinct_live_crops",
    o.query(ALERTS_SQL, "SELECT DISTINCT custkey::INTEGER AS district_id, crop FROM now"),
)
def distinct_live_crops(spark, sf_dir):
    """Crops with a served forecast at every site."""
    table = serving.prediction_table(spark, sf_dir).where("run_id = 'second'")
    return table.select("district_id", "crop").distinct()


@register(
    "sorted_sites",
    o.query(
        o.YIELD,
        f"SELECT district, {o.num('max(yield_kg_ha)', 4, 'best')} FROM yield_panel WHERE lower(crop) = 'machinery' "
        "GROUP BY district ORDER BY max(yield_kg_ha) DESC NULLS LAST, district LIMIT 25",
    ),
)
def sorted_sites(spark, sf_dir):
    """The 25 best sites of a crop whose name is given in another case, by any column of the table."""
    rows = views.equals_ignoring_case(fx.yield_panel(spark, sf_dir), "crop", "Machinery")
    best = rows.groupBy("district").agg(F.max("yield_kg_ha").alias("best"))
    return tidy(views.sort_any(best, "best", descending=True).limit(25))


def _landed_documents(spark, sf_dir):
    """A weather document per supplier as JSON text, some of them damaged or under another name, by key."""
    lines = fx.table(spark, sf_dir, "lineitem")
    days = lines.groupBy(F.col("l_suppkey").alias("site"), F.date_format("l_shipdate", "yyyyMMdd").alias("day")).agg(F.sum("l_quantity").alias("q"))
    # a site has no more days than the calendar
    series = days.groupBy("site").agg(F.map_from_entries(F.collect_list(F.struct("day", "q"))).alias("rain"))
    kind = F.col("site") % 8
    named = fx.with_supplier(series, spark, sf_dir).where(kind != 3)
    rain = F.when(kind == 2, F.transform_values("rain", lambda _, v: F.lit(-999.0))).when(kind == 6, F.transform_keys("rain", lambda k, _: F.concat(F.lit("x"), k)))
    rain = rain.when(kind == 1, F.map_from_entries(F.array().cast("array<struct<k:string,v:double>>"))).otherwise(F.col("rain"))
    district = F.when(kind == 4, F.concat(F.lit("Nowhere "), F.col("site").cast("string"))).otherwise(F.col("district"))
    text = F.to_json(F.struct("state", district.alias("district"), "lat", "lon", F.struct(F.create_map(F.lit("PRECTOTCORR"), rain).alias("parameter")).alias("properties")))
    cut_short = F.substring(text, 1, F.length(text) - 40)
    # every eighth document is cut; another eighth comes twice, cut and whole
    return named.select(F.explode(F.when(kind == 0, F.array(cut_short)).when(kind == 5, F.array(cut_short, text)).otherwise(F.array(text))).alias("value"))


@register(
    "landing_reasons",
    o.query(
        """site AS (SELECT s_suppkey AS site, n_name AS state, s_name AS district FROM supplier JOIN nation ON s_nationkey = n_nationkey),
        shipped AS (SELECT DISTINCT l_suppkey AS site FROM lineitem)""",
        """SELECT state, district, CASE WHEN site NOT IN (SELECT site FROM shipped) OR site % 8 IN (3, 4) THEN 'no document landed'
          WHEN site % 8 = 0 THEN 'unreadable document' WHEN site % 8 = 1 THEN 'no series in the document'
          WHEN site % 8 = 2 THEN 'only fill values' ELSE 'no readable date' END AS error
        FROM site WHERE site % 8 NOT IN (5, 7) OR site NOT IN (SELECT site FROM shipped)
        UNION ALL SELECT state, 'Nowhere ' || site, 'site is not expected' FROM site JOIN shipped USING (site) WHERE site % 8 = 4""",
    ),
)
def landing_reasons(spark, sf_dir):
    """Why each expected site has no rows, from documents of which some are cut, empty, filled, misdated, absent or strange."""
    path = _place(spark, "landing")
    _landed_documents(spark, sf_dir).write.text(path)
    found = landing.verdicts(landing.read_landed(spark, path))
    return landing.ledger(fx.supplier_sites(spark, sf_dir), found)


@register(
    "landing_rows",
    """SELECT n_name AS state, s_name AS district, CAST(l_shipdate AS DATE) AS date, sum(l_quantity)::DOUBLE AS rainfall_mm
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 8 IN (5, 7) GROUP BY ALL""",
)
def landing_rows(spark, sf_dir):
    """The daily rows of the documents that were whole and of an expected site."""
    path = _place(spark, "landing")
    _landed_documents(spark, sf_dir).write.text(path)
    daily = readers.clean_daily(readers.explode_payload(landing.whole_documents(landing.read_landed(spark, path))))
    known = daily.join(fx.supplier_sites(spark, sf_dir).select("state", "district"), ["state", "district"], "left_semi")
    return known.where("rainfall_mm IS NOT NULL").select("state", "district", "date", "rainfall_mm")
