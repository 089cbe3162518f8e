"""Which run is the latest: numbered pointer files that only one writer can create, and recovery of half-written runs.

A pointer is a file whose name is its number; the highest number is the latest run. A writer reads it, makes sure that its own
run is newer, writes the next pointer beside and puts it in place only if that number is still free. Of two writers that read the
same pointer one wins; the other reads again and goes on only if its run is newer than the winner's. So the latest run never
moves back, and readers always find a whole pointer.
"""

from __future__ import annotations

import json
import os
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agropanel import schema as sc
from agropanel.sources.sinks import append_event, promoted, run_state

FOLDER = "_latest"


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    return at, fs


def _write(spark: SparkSession, path: str, text: str) -> None:
    at, fs = _files(spark, path)
    out = fs.create(at(path), False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def place(spark: SparkSession, source: str, target: str) -> bool:
    """Moves a file to a name that nobody holds; False if somebody holds it.

    Distributed file systems refuse to rename onto a file. A local one would replace it, so there a link is made, which does
    fail.
    """
    at, fs = _files(spark, target)
    where = fs.makeQualified(at(target))
    if where.toUri().getScheme() == "file":
        here = [unquote(urlparse(fs.makeQualified(at(p)).toUri().toString()).path) for p in (source, target)]
        try:
            os.link(*here)
        except FileExistsError:
            return False
        os.unlink(here[0])
        return True
    if fs.exists(where):
        return False
    return fs.rename(at(source), where)


def latest(spark: SparkSession, root: str) -> tuple[int, dict] | None:
    """Number and content of the newest pointer; None before the first."""
    at, fs = _files(spark, f"{root}/{FOLDER}")
    folder = at(f"{root}/{FOLDER}")
    if not fs.exists(folder):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    number = max((int(n) for n in names if n.isdigit()), default=None)
    if number is None:
        return None
    text = spark.read.text(f"{root}/{FOLDER}/{number:012d}", wholetext=True).first()[0]
    return number, json.loads(text)


def advance(spark: SparkSession, root: str, run_id: str, finished_at: str) -> bool:
    """Makes a finished run the latest, unless a newer one is; True if it is the latest afterwards through this call."""
    at, fs = _files(spark, f"{root}/{FOLDER}")
    mine = {"run_id": run_id, "finished_at": finished_at}
    fs.mkdirs(at(f"{root}/{FOLDER}"))
    while True:
        now = latest(spark, root)
        if now is not None and (now[1]["finished_at"], now[1]["run_id"]) >= (finished_at, run_id):
            return False
        beside = f"{root}/{FOLDER}/_{uuid.uuid4().hex}"
        _write(spark, beside, json.dumps(mine))
        number = 0 if now is None else now[0] + 1
        if place(spark, beside, f"{root}/{FOLDER}/{number:012d}"):
            return True
        fs.delete(at(beside), False)


def of_latest(spark: SparkSession, root: str, name: str, schema) -> DataFrame:
    """Rows that the latest run has in a run-scoped table; only its partition is read."""
    now = latest(spark, root)
    if now is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{root}/{name}").where(F.col("run_id") == now[1]["run_id"])


def unfinished(events: DataFrame, begun_before: str) -> DataFrame:
    """Runs that began before a time and were neither closed nor continued."""
    state = run_state(events)
    return state.where((F.col("status") == "running") & (F.col("started_at") < F.lit(begun_before).cast("timestamp")))


def recover(spark: SparkSession, root: str, begun_before: str, at_time: str, tables: tuple[str, ...]) -> dict[str, list[str]]:
    """Puts right what interrupted writers left; safe to repeat.

    Runs still open that began before `begun_before` are closed as failed. The partitions of failed runs go from `tables`. A
    good run whose writer was lost between its closing row and the pointer becomes the latest. The answer names the runs of
    each kind; they are as many as writers were lost since the last recovery.
    """
    at, fs = _files(spark, root)
    manifest = f"{root}/runs"
    lost = unfinished(spark.read.schema(sc.RUNS).parquet(manifest), begun_before)
    closing = lost.withColumns({
        "status": F.lit("failed"), "gate_passed": F.lit(False), "finished_at": F.lit(at_time).cast("timestamp")}).select(*sc.RUNS.fieldNames())
    names = [r["run_id"] for r in lost.select("run_id").collect()]
    if names:
        append_event(spark.createDataFrame(closing.collect(), sc.RUNS), manifest)
    state = run_state(spark.read.schema(sc.RUNS).parquet(manifest))
    swept = []
    failed = {r["run_id"] for r in state.where("status = 'failed'").select("run_id").toLocalIterator()}
    for name in tables:
        folder = at(f"{root}/{name}")
        for child in fs.listStatus(folder) if fs.exists(folder) else []:
            run = unquote(child.getPath().getName().partition("=")[2])
            if child.getPath().getName().startswith("run_id=") and run in failed:
                fs.delete(child.getPath(), True)
                swept.append(run)
    best = promoted(state).select("run_id", F.date_format("finished_at", "yyyy-MM-dd HH:mm:ss").alias("t")).first()
    moved = best is not None and advance(spark, root, best["run_id"], best["t"])
    return {"closed": sorted(names), "swept": sorted(set(swept)), "pointed": [best["run_id"]] if moved else []}
