"""Landed weather documents with a verdict each, and a ledger that says why a site has no rows.

Documents are read permissively: one that is no JSON keeps its text, from which the site is taken if it can still be read
there. Every document gets one verdict; a site fails only if none of its documents is whole. Documents of sites that nobody
expects, or of no site at all, are listed too, so nothing that landed goes unmentioned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agropanel import schema as sc

RAW = "_raw"
# The verdicts, in the order in which they are looked for.
UNREADABLE, NO_SITE, NO_SERIES, NO_DATES, ONLY_FILL = (
    "unreadable document", "no site in the document", "no series in the document", "no readable date", "only fill values",
)
ABSENT, UNKNOWN = "no document landed", "site is not expected"
LANDED = T.StructType([*sc.PAYLOAD.fields, T.StructField(RAW, T.StringType())])


def read_landed(spark: SparkSession, path: str) -> DataFrame:
    """One row per landed document; `_raw` holds the text of those that could not be parsed."""
    reader = spark.read.schema(LANDED).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", RAW)
    return reader.json(path)


def _found_in_text(name: str) -> Column:
    """A string member of a damaged document."""
    inside = F.regexp_extract(F.col(RAW), rf'"{name}"\s*:\s*"([^"]*)"', 1)
    return F.when(inside != "", inside)


def verdicts(documents: DataFrame, floor: float = -900.0) -> DataFrame:
    """(state, district, reason, n_days) per document; reason is null for a whole one.

    n_days counts the readable dates that hold a value of any variable above the fill values.
    """
    parameter = F.col("properties.parameter")
    entries = F.flatten(F.transform(F.map_values(parameter), lambda m: F.map_entries(m)))
    known = F.filter("_entries", lambda e: F.try_to_date(e["key"], "yyyyMMdd").isNotNull())
    valued = F.filter(known, lambda e: e["value"].isNotNull() & ~F.isnan(e["value"]) & (e["value"] > floor))
    state, district = (F.coalesce(F.col(c), F.when(F.col(RAW).isNotNull(), _found_in_text(c))) for c in sc.SITE_KEYS)
    out = documents.withColumn("_entries", F.coalesce(entries, F.array().cast("array<struct<key:string,value:double>>")))
    reason = (
        F.when(F.col(RAW).isNotNull(), UNREADABLE)
        .when(F.col("state").isNull() | F.col("district").isNull(), NO_SITE)
        .when(F.size("_entries") == 0, NO_SERIES)
        .when(F.size(known) == 0, NO_DATES)
        .when(F.size(valued) == 0, ONLY_FILL)
    )
    n_days = F.size(F.array_distinct(F.transform(valued, lambda e: e["key"]))).cast("long")
    return out.select(state.alias("state"), district.alias("district"), reason.alias("reason"), n_days.alias("n_days"))


def ledger(expected: DataFrame, found: DataFrame, keys: tuple[str, ...] = sc.SITE_KEYS) -> DataFrame:
    """(state, district, error): expected sites without a whole document, and documents of other sites.

    A site's reasons are those of its documents, each once, in a fixed order: five at most, whatever the number of documents.
    Null site names match each other, so documents without a site make one line.
    """
    per_site = found.groupBy(*keys).agg(
        F.bool_or(F.col("reason").isNull()).alias("whole"), F.count(F.lit(1)).alias("n"), F.collect_set("reason").alias("reasons"))
    sites = expected.select(*keys).distinct().withColumn("_expected", F.lit(True))
    renamed = sites.select(*[F.col(k).alias(f"_e_{k}") for k in keys], "_expected")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_e_{k}"))
    both = per_site.join(renamed, same, "full_outer")
    texts = F.array_join(F.array_sort("reasons"), "; ")
    error = (
        F.when(F.col("n").isNull(), F.lit(ABSENT))
        .when(F.col("_expected").isNull(), F.when(F.size("reasons") > 0, F.concat_ws("; ", F.lit(UNKNOWN), texts)).otherwise(F.lit(UNKNOWN)))
        .when(~F.col("whole"), texts)
    )
    named = [F.when(F.col("n").isNull(), F.col(f"_e_{k}")).otherwise(F.col(k)).alias(k) for k in keys]
    return both.select(*named, error.alias("error")).where(F.col("error").isNotNull())


def whole_documents(documents: DataFrame) -> DataFrame:
    """Documents that could be parsed, in the form that `readers.explode_payload` takes."""
    return documents.where(F.col(RAW).isNull()).drop(RAW)
