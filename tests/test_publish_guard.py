"""A run whose tables changed after they were checked is not published."""

import time

import pytest
from agropanel import schema as sc
from agropanel.sources import sinks
from pyspark.sql import functions as F


def publish(spark, root, run):
    rows = spark.createDataFrame([(1, 2.0)], "district_id int, value double")
    found = spark.createDataFrame([("c", "pass", "x", None)], "check_name string, status string, detail string, override_ref string")
    return sinks.publish(spark, root, {"out": lambda _run, _prev: rows}, lambda _run: found, "v", "2026-10-01", "2026-10-01 01:00:00",
                         "2026-10-01 02:00:00", run_id=run)


def test_rewritten_after_the_check(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/runs"
    assert publish(spark, root, "a") == ("a", "ok")
    append = sinks.append_run

    def meddled(df, path, run_id):
        append(df, path, run_id)
        if path.endswith("sanity_checks"):
            time.sleep(1.1)
            append(spark.createDataFrame([(1, 3.0)], "district_id int, value double"), f"{root}/out", run_id)

    monkeypatch.setattr(sinks, "append_run", meddled)
    with pytest.raises(RuntimeError, match="older than its inputs"):
        publish(spark, root, "b")
    state = {r["run_id"]: r["status"] for r in sinks.run_state(spark.read.schema(sc.RUNS).parquet(f"{root}/runs")).collect()}
    assert state == {"a": "ok", "b": "failed"}
    assert sinks.promoted(sinks.run_state(spark.read.schema(sc.RUNS).parquet(f"{root}/runs"))).select("run_id").first()[0] == "a"


def test_time_of_the_newest_file(spark, tmp_path):
    assert sinks.modified(spark, f"file://{tmp_path}/none") is None
    spark.range(3).withColumn("p", F.col("id") % 2).write.partitionBy("p").parquet(f"file://{tmp_path}/t")
    assert sinks.modified(spark, f"file://{tmp_path}/t") > 0
