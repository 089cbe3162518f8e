"""Readers. Every reader takes a schema; optional inputs come back as None or as null columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agropanel import schema as sc
from agropanel.functions.scalars import fill_to_null

# Parameter names of the weather source and the columns they become.
PAYLOAD_VARIABLES = {
    "PRECTOTCORR": "rainfall_mm",
    "T2M_MAX": "temp_max_c",
    "T2M_MIN": "temp_min_c",
    "T2M": "temp_avg_c",
    "RH2M": "humidity_pct",
    "ALLSKY_SFC_SW_DWN": "solar_radiation",
}


def read_csv(spark: SparkSession, path: str, schema: T.StructType, columns: Sequence[str] | None = None) -> DataFrame:
    """CSV with a header; bad numbers become null, NaN becomes null."""
    df = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)
    df = nan_to_null(df)
    return df.select(*columns) if columns else df


def nan_to_null(df: DataFrame) -> DataFrame:
    doubles = [c for c, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in doubles}) if doubles else df


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path holds anything Spark can list, on any file system the session knows."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop))


def read_optional(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame | None:
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else None


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Parquet table, or an empty frame of the same schema before its first write."""
    found = read_optional(spark, path, schema)
    return spark.createDataFrame([], schema) if found is None else found


def read_payload(spark: SparkSession, path: str) -> DataFrame:
    """Landed weather documents, one JSON object per site, to daily rows."""
    return explode_payload(spark.read.schema(sc.PAYLOAD).json(path))


def explode_payload(documents: DataFrame) -> DataFrame:
    """Nested variable -> (date -> value) maps to one row per site and date.

    Dates of every variable are exploded, so a date missing from one of them still yields a row. What is no date yields none.
    """
    parameter = F.col("properties.parameter")
    dates = F.array_distinct(F.flatten(F.transform(F.map_values(parameter), lambda m: F.map_keys(m))))
    held = documents.select("state", "district", "lat", "lon", parameter.alias("p"), dates.alias("dates"))
    found = F.map_from_arrays("dates", F.array_repeat(F.lit(0), F.size("dates")))
    for code in PAYLOAD_VARIABLES:
        # the maps are matched by hash: a lookup of each date would walk through them
        values = F.coalesce(F.try_element_at("p", F.lit(code)), F.create_map().cast("map<string,double>"))
        found = F.map_zip_with(found, values, lambda _, before, x: F.struct(before.alias("before"), x.alias("x")))
    rows = held.select("state", "district", "lat", "lon", F.explode(found).alias("day", "v"))
    values, at = {}, F.col("v")
    for name in reversed(PAYLOAD_VARIABLES.values()):
        values[name], at = at["x"], at["before"]
    rows = rows.select("state", "district", "lat", "lon", F.try_to_date("day", "yyyyMMdd").alias("date"), *[x.alias(c) for c, x in values.items()])
    return rows.where(F.col("date").isNotNull()).select(*sc.DAILY.fieldNames())


def clean_daily(daily: DataFrame, floor: float = -900.0) -> DataFrame:
    """Fill values and NaN of all measures become null, once, at ingest."""
    present = [m for m in sc.MEASURES if m in daily.columns]
    return daily.withColumns({m: fill_to_null(m, floor) for m in present})


def fill_report(daily: DataFrame, floor: float = -900.0) -> DataFrame:
    """How many fill values each measure holds and which dates they span, from one aggregation."""
    present = [m for m in sc.MEASURES if m in daily.columns]

    def stats(m: str) -> list[Column]:
        bad = F.col(m) <= floor
        return [
            F.count_if(bad).alias(f"n_{m}"),
            F.min(F.when(bad, F.col("date"))).alias(f"a_{m}"),
            F.max(F.when(bad, F.col("date"))).alias(f"b_{m}"),
        ]

    wide = daily.agg(*[c for m in present for c in stats(m)])
    rows = F.array(
        *[
            F.struct(
                F.lit(m).alias("measure"), F.col(f"n_{m}").alias("n_fill"), F.col(f"a_{m}").alias("first_day"),
                F.col(f"b_{m}").alias("last_day"),
            )
            for m in present
        ]
    )
    return wide.select(F.inline(rows))


def read_names(spark: SparkSession, path: str) -> list[str]:
    """Ordered name list, one per line (the feature contract: tens of names)."""
    lines = spark.read.text(path, wholetext=True).first()
    return [x.strip() for x in (lines[0] if lines else "").splitlines() if x.strip()]


def read_overrides(spark: SparkSession, path: str) -> DataFrame:
    """Override register, a JSON object keyed by check, as rows."""
    register = T.MapType(T.StringType(), sc.OVERRIDE)
    empty = spark.createDataFrame([], T.StructType([T.StructField("check_id", T.StringType()), *sc.OVERRIDE.fields]))
    if not exists(spark, path):
        return empty
    text = spark.read.text(path, wholetext=True)
    entries = text.select(F.explode(F.from_json("value", register)).alias("check_id", "o"))
    return entries.select("check_id", "o.*")


def read_parameters(spark: SparkSession, path: str) -> dict:
    """Small JSON object of model parameters as a driver dict."""
    import json

    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def read_drift_baseline(spark: SparkSession, path: str) -> DataFrame:
    """Stored baseline: feature -> statistics, as rows."""
    stats = T.StructType([T.StructField(c, T.DoubleType()) for c in ("mean", "std", "min", "max", "p05", "p95")])
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.explode(F.from_json("value", T.MapType(T.StringType(), stats))).alias("feature", "s"))
    return rows.select("feature", "s.*")


def latest_snapshot(spark: SparkSession, path: str, before: str | None = None) -> DataFrame | None:
    """Newest snapshot older than `before`; reads one partition only. None before the first write."""
    if not exists(spark, path):
        return None
    everything = spark.read.schema(sc.SNAPSHOT).parquet(path)
    stamps = everything.select("snapshot_ts")
    if before is not None:
        stamps = stamps.where(F.col("snapshot_ts") < before)
    newest = stamps.agg(F.max("snapshot_ts")).first()[0]
    return None if newest is None else everything.where(F.col("snapshot_ts") == newest)


def table_found(spark: SparkSession, path: str) -> bool:
    """Whether a readable, non-empty Parquet table is at the path."""
    if not exists(spark, path):
        return False
    try:
        return not spark.read.parquet(path).isEmpty()
    except AnalysisException:
        return False
