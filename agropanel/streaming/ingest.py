"""Landed weather documents to the daily table, incrementally.

The source re-sends recent days until they are final, so a later value replaces an earlier one. A file stream picks
up new documents once; each micro-batch rewrites only the year partitions it touches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agropanel import schema as sc
from agropanel.lineage import cut
from agropanel.operators.panel import keep_last
from agropanel.sources.readers import clean_daily, explode_payload, read_optional

KEYS = ("state", "district", "date")


def daily_stream(spark: SparkSession, landing: str) -> DataFrame:
    """Cleaned daily rows of newly landed documents."""
    documents = spark.readStream.schema(sc.PAYLOAD).json(landing)
    return clean_daily(explode_payload(documents)).withColumn("landed_at", F.current_timestamp())


def merge_daily(batch: DataFrame, table: str) -> None:
    """Upserts a batch by (state, district, date) into a table partitioned by year.

    Running it again with the same batch gives the same table, so a restarted stream does no harm.
    """
    spark = batch.sparkSession
    columns = [*sc.DAILY.fieldNames(), "landed_at"]
    incoming = batch.select(*columns).withColumn("year", F.year("date")).persist()
    years = [r[0] for r in incoming.select("year").distinct().collect()]
    if not years:
        incoming.unpersist()
        return
    schema = incoming.schema
    old = read_optional(spark, table, schema)
    rows = incoming if old is None else old.where(F.col("year").isin(*years)).unionByName(incoming)
    merged = keep_last(rows, [*KEYS, "year"], ["landed_at"])
    # a table may not be read and overwritten in one job: the checkpoint holds the merged rows
    writer = cut(merged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("year").parquet(table)
    incoming.unpersist()


def run_once(spark: SparkSession, landing: str, table: str, checkpoint: str) -> None:
    """Processes everything that has landed since the last call, then stops."""
    query = (
        daily_stream(spark, landing)
        .writeStream.foreachBatch(lambda batch, _epoch: merge_daily(batch, table))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
