"""Retention of published forecasts: what old runs no longer need goes, and every run keeps its rows.

The newest runs keep all. Older ones lose their attributions, and after some months their features too. Only run partitions
that still hold what has to go are rewritten: beside the table first, then each partition is switched by two renames, and the
old files go last. `recover` ends a trim that was interrupted anywhere: a partition that was set aside and not replaced comes
back, so no step loses a row, and trimming again does the rest. One trim runs at a time; readers may read meanwhile, and one
that looks between the two renames misses that run until the second.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agropanel import schema as sc
from agropanel.sources.readers import read_table
from agropanel.sources.sinks import retained_runs, run_state

STAGED, ASIDE = "_trim-", "_aside-"  # readers skip names that begin so
KEEP_RUNS, FEATURE_DAYS = 30, 180


def decided(events: DataFrame, as_of: str, keep: int = KEEP_RUNS, feature_days: int = FEATURE_DAYS) -> DataFrame:
    """(run_id, drop_features) of the finished runs that lose their attributions; an unfinished run loses nothing."""
    runs = run_state(events)
    old = runs.where(F.col("finished_at").isNotNull()).join(retained_runs(runs, keep), "run_id", "left_anti")
    age = F.datediff(F.lit(as_of).cast("date"), F.col("finished_at").cast("date"))
    return old.select("run_id", (age > feature_days).alias("drop_features"))


def marked(table: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows of the plan whose partition still holds something that has to go."""
    held = table.groupBy("run_id").agg(
        F.bool_or(F.col("attributions").isNotNull()).alias("_a"), F.bool_or(F.col("features").isNotNull()).alias("_f"))
    return plan.join(held, "run_id").where(F.col("_a") | (F.col("drop_features") & F.col("_f"))).select("run_id", "drop_features")


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path
    return at, at(path).getFileSystem(spark._jsc.hadoopConfiguration())


def _children(fs, path) -> list:
    return [s.getPath() for s in fs.listStatus(path)] if fs.exists(path) else []


def recover(spark: SparkSession, path: str) -> int:
    """Ends an interrupted trim; the number of partitions that came back."""
    at, fs = _files(spark, path)
    back, children = 0, _children(fs, at(path))
    for aside in (c for c in children if c.getName().startswith(ASIDE)):
        for old in _children(fs, aside):
            place = at(at(path), old.getName())
            if not fs.exists(place):
                if not fs.rename(old, place):
                    raise OSError(f"{place} could not be put back from {old}")
                back += 1
        fs.delete(aside, True)
    for staged in (c for c in children if c.getName().startswith(STAGED)):
        fs.delete(staged, True)
    return back


def _switch(spark: SparkSession, path: str, staged: str, aside: str) -> None:
    at, fs = _files(spark, path)
    fs.mkdirs(at(aside))
    for new in _children(fs, at(staged)):
        name = new.getName()
        if not name.startswith("run_id="):
            continue
        place = at(at(path), name)
        if not (fs.rename(place, at(at(aside), name)) and fs.rename(new, place)):
            raise OSError(f"{place} could not be switched; recover() puts it right")


def trim(
    spark: SparkSession, path: str, events: DataFrame, as_of: str, keep: int = KEEP_RUNS, feature_days: int = FEATURE_DAYS, schema=sc.PREDICTIONS
) -> int:
    """Rewrites the run partitions of a prediction table that hold too much; the number of them.

    Safe to repeat: a second call finds nothing to do. The list of runs to rewrite, those since the last trim, is all that
    the driver sees; their rows move in one job.
    """
    recover(spark, path)
    table = read_table(spark, path, schema)
    plan = marked(table, decided(events, as_of, keep, feature_days)).collect()
    if not plan:
        return 0
    bare = [r["run_id"] for r in plan if r["drop_features"]]
    kinds = {f.name: f.dataType for f in schema.fields}
    rows = table.where(F.col("run_id").isin([r["run_id"] for r in plan])).withColumns({
        "attributions": F.lit(None).cast(kinds["attributions"]),
        "features": F.when(~F.col("run_id").isin(bare), F.col("features")) if bare else F.col("features"),
    })
    name = uuid.uuid4().hex
    staged, aside = f"{path}/{STAGED}{name}", f"{path}/{ASIDE}{name}"
    rows.write.partitionBy("run_id").parquet(staged)
    _switch(spark, path, staged, aside)
    recover(spark, path)
    return len(plan)
