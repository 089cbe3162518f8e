"""Registered queries on published runs over time: retention, what moved between two runs, and the weekly stream."""

from __future__ import annotations

import uuid

from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import functions as F

from agropanel import schema as sc
from agropanel.lineage import folder
from agropanel.plans import oracle as o
from agropanel.plans import serving_queries as serving
from agropanel.plans import views
from agropanel.plans.quality_queries import FIRST_CUT, SECOND_CUT
from agropanel.plans.registry import register, tidy
from agropanel.sources import fixtures as fx
from agropanel.sources import pointer, readers, retention, sinks
from agropanel.streaming import weekly

_AS_OF, _KEEP = "2001-08-15", 3


def _place(spark, name: str) -> str:
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def monthly_forecasts(spark, sf_dir):
    """A run per month: the mean order of every customer, with features and attributions."""
    orders = fx.table(spark, sf_dir, "orders")
    month = F.date_format(F.col("o_orderdate").cast("date"), "'run-'yyyy-MM").alias("run_id")
    rows = orders.groupBy(month, F.col("o_custkey").cast("int").alias("district_id")).agg(
        F.avg("o_totalprice").alias("pred_yield"), F.count(F.lit(1)).cast("double").alias("n"))
    given = {"features": F.create_map(F.lit("n"), F.col("n")), "attributions": F.create_map(F.lit("n"), F.col("pred_yield") / 10)}
    rest = {f.name: F.lit(None).cast(f.dataType) for f in sc.PREDICTIONS.fields if f.name not in ("run_id", "district_id", "pred_yield", *given)}
    return rows.withColumns(given | rest).select(*sc.PREDICTIONS.fieldNames())


@register(
    "retention_trim",
    f"""WITH runs AS (
      SELECT strftime(o_orderdate, 'run-%Y-%m') AS run_id, max(CAST(o_orderdate AS DATE)) AS last, count(DISTINCT o_custkey) AS n FROM orders GROUP BY ALL),
    ranked AS (SELECT *, row_number() OVER (ORDER BY last DESC) AS i FROM runs)
    SELECT run_id, n::BIGINT AS n, CASE WHEN i <= {_KEEP} THEN n ELSE 0 END::BIGINT AS with_attributions,
      CASE WHEN i <= {_KEEP} OR DATE '{_AS_OF}' - last <= 180 THEN n ELSE 0 END::BIGINT AS with_features FROM ranked""",
)
def retention_trim(spark, sf_dir):
    """What each run holds after its table was trimmed twice: the second time finds nothing to do."""
    path = _place(spark, "forecasts")
    monthly_forecasts(spark, sf_dir).repartition("run_id").write.partitionBy("run_id").parquet(path)
    events = serving.run_events(spark, sf_dir)
    retention.trim(spark, path, events, _AS_OF, _KEEP)
    if retention.trim(spark, path, events, _AS_OF, _KEEP):
        raise RuntimeError("a second trim found something to do")
    table = readers.read_table(spark, path, sc.PREDICTIONS)
    return table.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n"), F.count("attributions").alias("with_attributions"), F.count("features").alias("with_features"))


@register(
    "feature_deltas",
    o.query(
        o.snapshot_sql("before", FIRST_CUT) + "," + o.snapshot_sql("now", SECOND_CUT) + f""",
    pairs AS (
      SELECT n.custkey, n.crop, b.custkey IS NOT NULL AS had, n.rai + {serving._OFF_TIE} AS x, b.rai + {serving._OFF_TIE} AS y
      FROM now n LEFT JOIN before b ON b.custkey = n.custkey AND b.crop = n.crop),
    long AS (
      SELECT custkey, crop, 'rainfall_anomaly_index' AS feature, x AS after, y AS before FROM pairs
      UNION ALL SELECT custkey, crop, 'drought_flag', (x < 2)::INT::DOUBLE, (y < 2)::INT::DOUBLE FROM pairs
      UNION ALL SELECT custkey, crop, 'flood_flag', (x > 3)::INT::DOUBLE, (y > 3)::INT::DOUBLE FROM pairs),
    moved AS (
      SELECT *, after - before AS delta, round(abs(after - before) / greatest(abs(before), abs(after)), 9) AS share
      FROM long WHERE after IS DISTINCT FROM before)""",
        f"""SELECT custkey::INTEGER AS district_id, crop, feature, {o.nums('before', 'after', 'delta')}, rank::INTEGER AS rank
        FROM (SELECT *, row_number() OVER (PARTITION BY custkey, crop ORDER BY coalesce(share, 2) DESC, feature) AS rank FROM moved) WHERE rank <= 2""",
    ),
)
def feature_deltas(spark, sf_dir):
    """The two features of every forecast that moved most between the two runs."""
    out = views.feature_deltas(serving.prediction_table(spark, sf_dir), "first", "second", 2)
    return tidy(out.select("district_id", "crop", "feature", "before", "after", "delta", "rank"))


@register(
    "weekly_stream",
    o.query(
        o.DAILY + """,
    weeks AS (
      SELECT state, district, DATE '1970-01-01' + ((date - DATE '1970-01-01') // 7 * 7)::INTEGER AS week_start, count(rainfall_mm) AS days, sum(rainfall_mm) AS rainfall_mm
      FROM daily GROUP BY ALL)""",
        f"""SELECT state, district, week_start, days::BIGINT AS days, {o.num('rainfall_mm')} FROM weeks
        WHERE week_start + 7 <= (SELECT max(date) FROM daily) - 10""",
    ),
)
def weekly_stream(spark, sf_dir):
    """Closed weeks of a stream that holds every wet day twice."""
    landed, table, checkpoint = (_place(spark, name) for name in ("landed", "weeks", "stream"))
    daily = fx.daily(spark, sf_dir).select(*sc.DAILY.fieldNames())
    daily.unionByName(daily.where("rainfall_mm > 0")).write.parquet(landed)
    weekly.run_once(spark, landed, table, checkpoint)
    weekly.run_once(spark, landed, table, checkpoint)
    return tidy(weekly.closed_weeks(spark, table))


_TIMES = "yyyy-MM-dd HH:mm:ss"


def _manifest(spark, sf_dir, root):
    """The months' runs as a stored manifest; a month that failed has no closing row yet, as if its writer had been lost."""
    rest = {c: F.lit(None).cast("string") for c in ("model_version", "git_sha", "gate_report")}
    events = serving.run_events(spark, sf_dir).where("status <> 'failed'").withColumns(rest)
    sinks.append_event(events.select(*sc.RUNS.fieldNames()), f"{root}/runs")
    return spark.read.schema(sc.RUNS).parquet(f"{root}/runs")


@register(
    "run_pointer",
    o.query(
        serving._RUNS,
        """, good AS (SELECT * FROM runs WHERE status = 'ok' ORDER BY last DESC LIMIT 1)
        SELECT run_id, status, last AS weather_data_as_of, (SELECT count(*) FROM (
          SELECT DISTINCT o_custkey FROM orders, good WHERE strftime(o_orderdate, 'run-%Y-%m') = run_id))::BIGINT AS n FROM good""",
    ).replace(")\n, good", "), good"),
)
def run_pointer(spark, sf_dir):
    """Four writers race to make their runs the latest, the newest run first; what the pointer names, with its rows."""
    root = _place(spark, "published")
    state = sinks.run_state(_manifest(spark, sf_dir, root)).where("status = 'ok'")
    monthly_forecasts(spark, sf_dir).repartition("run_id").write.partitionBy("run_id").parquet(f"{root}/predictions")
    # runs are months of the history; the last twelve of them race
    done = state.orderBy(F.col("finished_at").desc()).select("run_id", F.date_format("finished_at", _TIMES).alias("t")).limit(12).collect()
    with ThreadPool(4) as pool:
        pool.map(inheritable_thread_target(spark)(lambda r: pointer.advance(spark, root, r["run_id"], r["t"])), done, 1)
    rows = pointer.of_latest(spark, root, "predictions", sc.PREDICTIONS)
    n = rows.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))
    return state.join(n, "run_id").select("run_id", "status", "weather_data_as_of", "n")


@register(
    "run_recovery",
    o.query(
        serving._RUNS,
        """, held AS (SELECT strftime(o_orderdate, 'run-%Y-%m') AS run_id, count(DISTINCT o_custkey) AS n FROM orders GROUP BY ALL)
        SELECT run_id, status, CASE WHEN status = 'failed' THEN 0 ELSE n END::BIGINT AS n,
          (run_id = (SELECT run_id FROM runs WHERE status = 'ok' ORDER BY last DESC LIMIT 1))::INTEGER AS latest
        FROM runs JOIN held USING (run_id)""",
    ).replace(")\n, held", "), held"),
)
def run_recovery(spark, sf_dir):
    """Every run after lost writers were put right: state, rows that are left, and which one the pointer names."""
    root = _place(spark, "recovered")
    _manifest(spark, sf_dir, root)
    monthly_forecasts(spark, sf_dir).repartition("run_id").write.partitionBy("run_id").parquet(f"{root}/predictions")
    for _ in range(2):
        again = pointer.recover(spark, root, "2100-01-01 00:00:00", "2100-01-01 00:00:00", ("predictions",))
    if any(again.values()):
        raise RuntimeError(f"a second recovery found something to do: {again}")
    latest = pointer.latest(spark, root)
    rows = readers.read_table(spark, f"{root}/predictions", sc.PREDICTIONS).groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))
    state = sinks.run_state(spark.read.schema(sc.RUNS).parquet(f"{root}/runs"))
    return state.join(rows, "run_id", "left").select(
        "run_id", "status", F.coalesce("n", F.lit(0)).alias("n"), (F.col("run_id") == F.lit(latest[1]["run_id"])).cast("int").alias("latest"))
