"""Panel-shaped views over the order tables, so that every operator runs on data that grows with them.

Sites are suppliers (daily weather) or customers (yields). Each view is a DataFrame; the SQL twins are in
plans/oracle.py.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# given schemas save one footer-reading job per table
SCHEMAS = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "pages": "page_id long, url string, html string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _nation_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey"), F.col("n_name").alias("state"))


def with_supplier(df: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """State, district and coordinates of `site`.

    The two dimensions are joined one after the other: a dimension joined beforehand is estimated as the product of
    its parts, and the planner would then rather broadcast the facts.
    """
    key = F.col("s_suppkey")
    suppliers = table(spark, sf_dir, "supplier").select(
        key.alias("site"),
        F.col("s_nationkey").alias("n_nationkey"),
        F.col("s_name").alias("district"),
        (24.0 + (key % 97) * 0.05).alias("lat"),
        (74.0 + (key % 89) * 0.05).alias("lon"),
    )
    return df.join(suppliers, "site").join(_nation_names(spark, sf_dir), "n_nationkey").drop("n_nationkey")


def supplier_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per weather site; coordinates are spread over a grid by key."""
    key = F.col("s_suppkey")
    return (
        table(spark, sf_dir, "supplier")
        .join(_nation_names(spark, sf_dir), F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            key.alias("site"),
            "state",
            F.col("s_name").alias("district"),
            (24.0 + (key % 97) * 0.05).alias("lat"),
            (74.0 + (key % 89) * 0.05).alias("lon"),
        )
    )


def cents(column: str):
    """Hundredths as whole numbers: their sums do not depend on the order of the rows."""
    return F.round(F.col(column) * 100).cast("long")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily weather per supplier from the first to the last shipping day; days without a shipment are dry and unmeasured.

    Shipments shrink to one row per site-day first (so a site never has more rows than the calendar has days); the
    empty days up to the next shipment are then generated in place and are never shuffled.
    """
    lines = table(spark, sf_dir, "lineitem")
    first = lines.agg(F.min("l_shipdate").cast("date")).scalar()
    last = lines.agg(F.max("l_shipdate").cast("date")).scalar()
    shipped = lines.select(
        F.col("l_suppkey").alias("site"),
        F.col("l_shipdate").cast("date").alias("_from"),
        F.col("l_quantity").alias("q"),
        cents("l_discount").alias("d"),
        cents("l_tax").alias("t"),
        cents("l_extendedprice").alias("p"),
    )
    openings = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("site"), first.alias("_from"))
    per_day = (
        shipped.unionByName(openings, allowMissingColumns=True)
        .groupBy("site", "_from")
        .agg(F.sum("q").alias("q"), *[(F.sum(c) / F.count(c)).alias(c) for c in ("d", "t", "p")])
    )
    following = F.lead("_from").over(Window.partitionBy("site").orderBy("_from"))
    # whole-number offsets: a sequence of dates would go through calendar arithmetic for every element
    spans = per_day.withColumn("_gap", F.datediff(F.coalesce(following, F.date_add(last, 1)), F.col("_from")))
    dense = spans.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_gap") - 1)))
    dense = dense.withColumn("date", F.date_add(F.col("_from"), F.col("_i")))
    shipped_today = F.col("_i") == 0

    def measured(x):
        return F.when(shipped_today, x)

    dense = dense.select(
        "site",
        "date",
        F.coalesce(measured(F.col("q")), F.lit(0.0)).alias("rainfall_mm"),
        measured(18 + 2.5 * F.col("d")).alias("temp_max_c"),
        measured(14 - 2 * F.col("t")).alias("temp_min_c"),
        measured(((18 + 2.5 * F.col("d")) + (14 - 2 * F.col("t"))) / 2).alias("temp_avg_c"),
        measured(10 * F.col("t")).alias("humidity_pct"),
        measured(10 + F.col("p") / 500000).alias("solar_radiation"),
    )
    return with_supplier(dense, spark, sf_dir).drop("site")


def daily_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily view as a source would deliver it: unmeasured values carry the fill value."""
    return daily(spark, sf_dir).fillna(-999.0, ["temp_max_c", "temp_min_c", "temp_avg_c", "solar_radiation"])


def with_customer(df: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """State, district and crop of `custkey`; joined like the suppliers."""
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("custkey"), F.col("c_nationkey").alias("n_nationkey"), F.col("c_name").alias("district"),
        F.col("c_mktsegment").alias("crop"),
    )
    return df.join(customers, "custkey").join(_nation_names(spark, sf_dir), "n_nationkey").drop("n_nationkey")


def customer_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return (
        table(spark, sf_dir, "customer")
        .join(_nation_names(spark, sf_dir), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            key.alias("custkey"),
            "state",
            F.col("c_name").alias("district"),
            F.col("c_mktsegment").alias("crop"),
            (24.0 + (key % 97) * 0.05).alias("lat"),
            (74.0 + (key % 89) * 0.05).alias("lon"),
        )
    )


def yield_panel(spark: SparkSession, sf_dir: str, until: str | None = None) -> DataFrame:
    """Yearly yield per customer: mean order value as yield, number of orders as area; optionally as of a date."""
    orders = table(spark, sf_dir, "orders")
    if until:
        orders = orders.where(F.col("o_orderdate") <= F.lit(until).cast("timestamp_ntz"))
    yearly = orders.groupBy(F.col("o_custkey").alias("custkey"), F.year("o_orderdate").alias("year")).agg(
        F.avg("o_totalprice").alias("yield_kg_ha"), F.count(F.lit(1)).cast("double").alias("area_ha")
    )
    return with_customer(yearly, spark, sf_dir).select(
        "state", "district", "crop", F.lit("S").alias("season"), "year", "yield_kg_ha", "area_ha", "custkey"
    )


def season_yields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yields per customer, year and season (half-year); keys can repeat by order status, as raw records do."""
    orders = table(spark, sf_dir, "orders")
    season = F.when(F.month("o_orderdate") <= 6, "Rabi").otherwise("Kharif")
    yearly = orders.groupBy(
        F.col("o_custkey").alias("custkey"),
        F.year("o_orderdate").alias("year"),
        season.alias("season"),
        F.col("o_orderstatus").alias("record"),
    ).agg(F.avg("o_totalprice").alias("yield_kg_ha"), F.count(F.lit(1)).cast("double").alias("area_ha"))
    return with_customer(yearly, spark, sf_dir).select(
        "state", "district", "crop", "season", "year", "yield_kg_ha", "area_ha", "record"
    )


def covariates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs per customer and year: taxes as nitrogen, discounts as fertiliser, quantity as irrigated area.

    Every eleventh customer reports no fertiliser and no nitrogen, as real records leave gaps.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_tax", "l_discount")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"))
    # lines shrink to one row per order before the join
    per_order = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sum("l_quantity").alias("q"), F.sum("l_tax").alias("t"), F.sum("l_discount").alias("d")
    )
    per_year = (
        per_order.join(orders, "o_orderkey")
        .groupBy(F.col("o_custkey").alias("custkey"), "year")
        .agg(
            F.when(F.col("custkey") % 11 != 0, F.sum("d")).alias("fertilizer_tons"),
            F.when(F.col("custkey") % 11 != 0, F.sum("t")).alias("nitrogen_tons"),
            (F.sum("q") / 10000).alias("irrigated_area_1000ha"),
        )
    )
    return with_customer(per_year, spark, sf_dir).select(
        "state", "district", "year", "fertilizer_tons", "nitrogen_tons", "irrigated_area_1000ha"
    )


CROP_BY_FLAG = {"R": "Wheat", "A": "Rice", "N": "Maize"}


def site_yields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yield per weather site, crop and year, so that yields and daily weather share their keys."""
    crop = F.col("l_returnflag")
    for flag, name in CROP_BY_FLAG.items():
        crop = F.when(F.col("l_returnflag") == flag, F.lit(name)).otherwise(crop)
    yearly = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_suppkey").alias("site"), crop.alias("crop"), F.year("l_shipdate").alias("year"))
        .agg(F.avg("l_extendedprice").alias("yield_kg_ha"), F.count(F.lit(1)).cast("double").alias("area_ha"))
    )
    season = F.when(F.col("crop") == "Wheat", "Rabi").when(F.col("crop") == "Rice", "Kharif")
    named = with_supplier(yearly, spark, sf_dir).withColumn("season", season)
    return named.select("state", "district", "crop", "season", "year", "yield_kg_ha", "area_ha")


def wells_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per well (supplier) with a column per period, such as May-97; the reading is a monthly mean."""
    regions = table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("district"), F.concat(F.lit("region "), F.col("n_regionkey")).alias("state")
    )
    days = daily(spark, sf_dir).select(
        F.col("state").alias("district"), F.col("district").alias("well"), F.year("date").alias("y"),
        F.month("date").alias("m"), "temp_max_c",
    )
    months = {1: "Jan", 5: "May", 8: "Aug", 11: "Nov"}
    cells = [
        F.avg(F.when((F.col("y") == y) & (F.col("m") == m), F.col("temp_max_c"))).alias(f"{name}-{y % 100:02d}")
        for y in range(1995, 2002) for m, name in months.items()
    ]
    wide = days.groupBy("district", "well").agg(*cells)
    return wide.join(regions, "district")


def snapshot_rows(spark: SparkSession, sf_dir: str, until: str) -> DataFrame:
    """Forecast per customer as of a date: mean of the last three yearly yields, anomaly from the order counts."""
    panel = yield_panel(spark, sf_dir, until)
    # a customer has one row per year, so the group is a handful of rows
    newest = Window.partitionBy("state", "district", "crop", "custkey").orderBy(F.col("year").desc())
    ranked = panel.withColumn("_rn", F.row_number().over(newest))
    last = F.col("_rn") == 1
    return ranked.groupBy("state", "district", "crop", "custkey").agg(
        F.avg(F.when(F.col("_rn") <= 3, F.col("yield_kg_ha"))).alias("pred_yield"),
        F.max(F.when(last, F.col("yield_kg_ha"))).alias("last_yield"),
        F.max(F.when(last, F.col("year"))).alias("baseline_yield_year"),
        F.max(F.when(last, F.col("area_ha"))).alias("rai"),
    )


def area_history(spark: SparkSession, sf_dir: str, until: str) -> DataFrame:
    """History of the same anomaly measure per site and year."""
    panel = yield_panel(spark, sf_dir, until)
    return panel.select("state", "district", "year", F.col("area_ha").alias("rainfall_anomaly_index"))


def event_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user and day: event count, total, mean and largest value."""
    return (
        table(spark, sf_dir, "events")
        .groupBy("user_id", F.col("ts").cast("date").alias("day"))
        .agg(
            F.count(F.lit(1)).cast("double").alias("n_events"),
            F.sum("value").alias("total_value"),
            F.avg("value").alias("mean_value"),
            F.max("value").alias("max_value"),
        )
    )


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raster cells derived from orders: a place on a grid, a date, a raw value and a class."""
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        (24.0 + (key * 7 % 97) * 0.05).alias("lat"),
        (74.0 + (key * 13 % 89) * 0.05).alias("lon"),
        F.col("o_orderdate").cast("date").alias("date"),
        F.col("o_totalprice").alias("value"),
        (key % 4).alias("water_class"),
    )
