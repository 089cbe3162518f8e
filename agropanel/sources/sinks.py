"""Writers: partitioned tables, append-only snapshots, keyed upsert, failure ledger and the run manifest.

There is no table format with transactions here, so a reader sees a run only through the manifest, whose row is
written last; a failed run leaves files no view reads.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agropanel import schema as sc
from agropanel.functions.scalars import season_or_default
from agropanel.lineage import cut
from agropanel.operators import gate
from agropanel.operators.panel import CROP_SEASON, feature_map
from agropanel.sources.readers import exists, read_table


def overwrite(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def replace_table(df: DataFrame, path: str) -> None:
    """Writes beside the table and then switches the folders; if the new one cannot be put in place, the old one is put back."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm

    def at(name: str):
        return jvm.org.apache.hadoop.fs.Path(name)

    new, old = f"{path}__new_{uuid.uuid4().hex}", f"{path}__old_{uuid.uuid4().hex}"
    df.write.parquet(new)
    fs = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    had = fs.exists(at(path))
    if had and not fs.rename(at(path), at(old)):
        raise OSError(f"{path} could not be set aside")
    try:
        placed = fs.rename(at(new), at(path))
    except Exception:
        placed = False
    if not placed:
        if had:
            fs.rename(at(old), at(path))
        raise OSError(f"{path} could not be put in place; its rows are in {new}")
    if had:
        fs.delete(at(old), True)


def append_run(df: DataFrame, path: str, run_id: str) -> None:
    """Run-scoped append; a repeated write of the same run replaces its partition only."""
    tagged = df.withColumn("run_id", F.lit(run_id))
    writer = tagged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("run_id").parquet(path)


def append_snapshot(df: DataFrame, path: str, stamp: str) -> None:
    """Adds one snapshot; a repeated write of one stamp replaces it, other snapshots are never touched."""
    columns = [c for c in sc.SNAPSHOT.fieldNames() if c != "snapshot_ts"]
    out = df.select(*columns, F.lit(stamp).alias("snapshot_ts"))
    writer = out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("snapshot_ts").parquet(path)


def failure_ledger(expected: DataFrame, landed: DataFrame, keys: Sequence[str] = ("state", "district")) -> DataFrame:
    """Expected sites without any landed row."""
    missing = expected.select(*keys).join(landed.select(*keys).distinct(), list(keys), "left_anti")
    return missing.withColumn("error", F.lit("no rows landed"))


def write_ledger(ledger: DataFrame, path: str) -> None:
    """Always written, also empty, so that an old ledger cannot stay behind."""
    ledger.select(*sc.FAILURES.fieldNames()).write.mode("overwrite").option("header", True).csv(path)


def merge_rows(
    existing: DataFrame, incoming: DataFrame, keys: Sequence[str], keep_first: Sequence[str] = ()
) -> DataFrame:
    """Result of a keyed upsert: new rows win, except columns in `keep_first`, which keep their first known value.

    The keys of `incoming` must be unique; `upsert` refuses others.
    """
    keys = list(keys)
    columns = existing.columns
    new = incoming
    if keep_first:
        old = existing.select(*keys, *[F.col(c).alias(f"_old_{c}") for c in keep_first])
        new = incoming.join(old, keys, "left")
        for c in keep_first:
            new = new.withColumn(c, F.coalesce(f"_old_{c}", c))
    untouched = existing.join(incoming.select(*keys), keys, "left_anti")
    return untouched.select(*columns).unionByName(new.select(*columns))


def upsert(
    spark: SparkSession, incoming: DataFrame, path: str, keys: Sequence[str], schema, keep_first: Sequence[str] = (),
    partition_by: Sequence[str] = (),
) -> None:
    """Merges into a table. A table may not be read and overwritten in one job, so the result is cut first.

    With partition columns, which must be part of the key, only the partitions that receive rows are read and
    rewritten.
    """
    if not set(partition_by) <= set(keys):
        raise ValueError("partition columns must be part of the key")
    repeated = incoming.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if not repeated.isEmpty():
        raise ValueError(f"repeated keys {list(keys)} in the rows to merge")
    existing = read_table(spark, path, schema)
    if partition_by:
        touched = incoming.select(*partition_by).distinct()
        existing = existing.join(touched, list(partition_by), "left_semi").select(*schema.fieldNames())
    merged = cut(merge_rows(existing, incoming, keys, keep_first))
    if partition_by:
        writer = merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(*partition_by).parquet(path)
    else:
        replace_table(merged, path)


# ---- run-scoped rows ------------------------------------------------------------------------------------------

def prediction_rows(df: DataFrame, features: Sequence[str], run_id: str) -> DataFrame:
    """Predictions with the feature and attribution vectors as maps that keep nulls."""
    shap = [F.col(f"shap_{c}").cast("double").alias(c) for c in features if f"shap_{c}" in df.columns]
    attributions = F.lit(None).cast("map<string,double>")
    if shap:
        pairs = []
        for c in features:
            pairs += [F.lit(c), F.col(f"shap_{c}").cast("double")]
        attributions = F.create_map(*pairs)
    season = F.col("season") if "season" in df.columns else F.lit(None).cast("string")
    return df.select(
        F.lit(run_id).alias("run_id"),
        "district_id",
        "crop",
        season_or_default(season, "crop", CROP_SEASON).alias("season"),
        F.col("pred_yield").cast("double").alias("pred_yield"),
        F.nanvl(F.col("pred_lower").cast("double"), F.lit(None).cast("double")).alias("pred_lower"),
        F.nanvl(F.col("pred_upper").cast("double"), F.lit(None).cast("double")).alias("pred_upper"),
        F.col("baseline_yield_year").cast("int").alias("baseline_yield_year"),
        "prediction_basis",
        feature_map(features).alias("features"),
        attributions.alias("attributions"),
    )


def watch_rows(df: DataFrame, run_id: str, previous_run_id: str | None) -> DataFrame:
    return df.select(
        F.lit(run_id).alias("run_id"), "district_id", "crop", "alert_level", "change_note", "yield_change",
        "rai_change", "severity_change", F.lit(previous_run_id).cast("string").alias("prev_run_id"),
    )


def risk_rows(df: DataFrame, run_id: str) -> DataFrame:
    return df.select(
        F.lit(run_id).alias("run_id"),
        "district_id",
        F.col("actual_partial_rainfall_mm").alias("partial_rainfall_mm"),
        F.col("days_elapsed").cast("long").alias("days_elapsed"),
        F.col("window_hist_mean").alias("hist_mean"),
        F.col("window_hist_std").alias("hist_std"),
        F.col("n_years").cast("long").alias("n_years"),
        F.col("kharif_risk_zscore").alias("zscore"),
        F.col("kharif_risk_level").alias("risk_level"),
        F.col("risk_explanation").alias("explanation"),
    )


# ---- run manifest ---------------------------------------------------------------------------------------------

def run_state(events: DataFrame) -> DataFrame:
    """Current row per run from the append-only manifest: the last event wins."""
    order = F.struct(F.coalesce("finished_at", "started_at"), (F.col("status") != "running").alias("done"))
    rest = [c for c in events.columns if c != "run_id"]
    return events.groupBy("run_id").agg(F.max_by(F.struct(*rest), order).alias("_r")).select("run_id", "_r.*")


def promoted(runs: DataFrame) -> DataFrame:
    """The one latest run: newest finished run whose gate passed. An aggregate, so no flag is ever updated."""
    rest = [c for c in runs.columns]
    good = runs.where((F.col("status") == "ok") & F.col("gate_passed"))
    best = good.agg(F.max_by(F.struct(*rest), F.struct("finished_at", "run_id")).alias("_r"))
    return best.where(F.col("_r").isNotNull()).select("_r.*")


def modified(spark: SparkSession, path: str) -> int | None:
    """When the newest data file below a path was written, in milliseconds; None if there is none."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        return None
    newest, files = None, fs.listFiles(hadoop, True)
    while files.hasNext():
        file = files.next()
        if not file.getPath().getName().startswith(("_", ".")):
            newest = max(newest or 0, file.getModificationTime())
    return newest


def append_event(events: DataFrame, manifest: str) -> None:
    """Adds rows to the manifest. Each writer commits in a folder of its own and then moves its files in, so that one writer's
    commit cannot sweep away what another is about to commit."""
    spark = events.sparkSession
    name = uuid.uuid4().hex
    at = spark._jvm.org.apache.hadoop.fs.Path
    fs = at(manifest).getFileSystem(spark._jsc.hadoopConfiguration())
    own = f"{manifest}/_event-{name}"
    events.coalesce(1).write.parquet(own)
    for i, file in enumerate(s.getPath() for s in fs.listStatus(at(own)) if s.getPath().getName().startswith("part-")):
        if not fs.rename(file, at(f"{manifest}/event-{name}-{i}.parquet")):
            raise OSError(f"an event could not be added to {manifest}")
    fs.delete(at(own), True)


def publish(
    spark: SparkSession,
    root: str,
    outputs: Mapping[str, Callable[[str, str | None], DataFrame]],
    checks: Callable[[str], DataFrame],
    model_version: str,
    as_of: str,
    started_at: str,
    finished_at: str,
    git_sha: str | None = None,
    run_id: str | None = None,
) -> tuple[str, str]:
    """Writes a run: manifest row 'running', the tables, the checks, then the closing manifest row.

    Each output is a function of (run id, previous promoted run id). The status is ok if no check failed, else
    flagged; an error, or a table that is newer than its checks, closes the run as failed. Only an ok run is found by
    `promoted`, and the pointer moves to it unless a newer run has it already.
    """
    from agropanel.sources import pointer

    run_id = run_id or str(uuid.uuid4())
    manifest = f"{root}/runs"
    previous = None
    if exists(spark, manifest):
        row = promoted(run_state(spark.read.schema(sc.RUNS).parquet(manifest))).select("run_id").first()
        previous = row[0] if row else None

    def record(status: str, passed: bool | None, finished: str | None, report: str | None = None) -> None:
        base = spark.createDataFrame(
            [(run_id, status, passed, model_version, as_of, git_sha, started_at, finished, report)],
            "run_id string, status string, gate_passed boolean, model_version string, weather_data_as_of string, "
            "git_sha string, started_at string, finished_at string, gate_report string",
        )
        typed = base.withColumns(
            {
                "weather_data_as_of": F.to_date("weather_data_as_of"),
                "started_at": F.to_timestamp("started_at"),
                "finished_at": F.to_timestamp("finished_at"),
            }
        )
        append_event(typed, manifest)

    record("running", None, None)
    try:
        for name, build in outputs.items():
            append_run(build(run_id, previous).drop("run_id"), f"{root}/{name}", run_id)
        append_run(checks(run_id).drop("run_id"), f"{root}/sanity_checks", run_id)
        times = [modified(spark, f"{root}/{name}/run_id={run_id}") for name in ("sanity_checks", *outputs)]
        if times[0] is not None:
            # a table that someone rewrote after it was checked is not published
            gate.require_fresh(times[0], max((t for t in times[1:] if t is not None), default=times[0]))
        written = spark.read.parquet(f"{root}/sanity_checks").where(F.col("run_id") == run_id)
        report = written.agg(
            F.count_if(F.col("status") == "fail").alias("n"),
            F.to_json(F.sort_array(F.collect_list(F.struct("check_name", "status")))).alias("j"),
        ).first()
        status = "ok" if report["n"] == 0 else "flagged"
        record(status, report["n"] == 0, finished_at, report["j"])
    except Exception:
        record("failed", False, finished_at)
        raise
    if status == "ok":
        pointer.advance(spark, root, run_id, finished_at)
    return run_id, status


def retained_runs(runs: DataFrame, keep: int = 30) -> DataFrame:
    """The newest finished runs, whose attributions are kept."""
    done = runs.where(F.col("finished_at").isNotNull())
    return done.orderBy(F.col("finished_at").desc(), F.col("run_id").desc()).limit(keep).select("run_id")
