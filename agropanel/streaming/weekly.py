"""Weekly rain of every site from a stream of daily rows, each week given once, when it can no longer change.

The day of a row is its event time. Rows from before the watermark come too late and are dropped. The state has one row for each
site, with its open weeks: which of the seven days have come, how many of them are known, and their total. A day that comes again is
dropped by its bit; once its week is closed, it is late. A closed week is written under the number of its batch: a batch that is
replayed after a failure replaces its own rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from agropanel import schema as sc

KEYS = ("state", "district")
DELAY = "10 days"


_DAY_MS = 24 * 3600 * 1000
_CLOSED = "state string, district string, start array<long>, days array<long>, total array<double>"
_OPEN = "open binary"
#: An open week: its number since 1970-01-01, a bit for each day that has come, known days and their total.
_SLOT = np.dtype([("week", np.int64), ("seen", np.int64), ("days", np.int64), ("total", np.float64)])


def added(weeks: np.ndarray, at: np.ndarray, known: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Open weeks of a site, ascending, with more days (in milliseconds) in them; of equal days the first one counts."""
    days, first = np.unique(at // _DAY_MS, return_index=True)
    known, values = known[first], np.where(known, values, 0.0)[first]
    number, bit = days // 7, days % 7
    out = np.zeros(len(both := np.union1d(weeks["week"], number)), _SLOT)
    out["week"] = both
    out[np.searchsorted(both, weeks["week"])] = weeks
    place = np.searchsorted(both, number)
    fresh = (out["seen"][place] >> bit) & 1 == 0
    np.add.at(out["seen"], place[fresh], 1 << bit[fresh])
    np.add.at(out["days"], place[fresh & known], 1)
    np.add.at(out["total"], place[fresh & known], values[fresh & known])
    return out


def _site(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Takes a site's new days into its open weeks and gives those that the watermark has closed."""
    weeks = np.frombuffer(bytes(state.get[0]), _SLOT) if state.exists else np.zeros(0, _SLOT)
    if not state.hasTimedOut:
        for frame in frames:
            weeks = added(weeks, frame["at_ms"].to_numpy(), frame["known"].to_numpy(bool), frame["rainfall_mm"].to_numpy())
    ends = (weeks["week"] + 1) * 7 * _DAY_MS
    closed = ends <= state.getCurrentWatermarkMs()
    if closed.all():
        state.remove()
    else:
        state.update((weeks[~closed].tobytes(),))
        # a timeout comes once the watermark is past its time, a week closes once the watermark reaches its end
        state.setTimeoutTimestamp(int(ends[~closed].min()) - 1)
    done = weeks[closed]
    if len(done):
        found = {"start": done["week"] * 7 * _DAY_MS, "days": done["days"], "total": done["total"]}
        yield pd.DataFrame({"state": [key[0]], "district": [key[1]]} | {name: [values] for name, values in found.items()})


def weekly(rows: DataFrame, delay: str = DELAY) -> DataFrame:
    """(state, district, week_start, days, rainfall_mm) of the closed weeks of a stream of daily rows.

    Weeks are seven days from 1970-01-01 on. `days` counts the days with a known value; the total of a week without any is null.
    """
    at = F.col("date").cast("timestamp")
    timed = rows.where("date IS NOT NULL").select(*KEYS, at.alias("at"), "rainfall_mm").withWatermark("at", delay)
    given = timed.select(*KEYS, "at", F.unix_millis("at").alias("at_ms"), F.col("rainfall_mm").isNotNull().alias("known"), "rainfall_mm")
    found = given.groupBy(*KEYS).applyInPandasWithState(_site, _CLOSED, _OPEN, "append", GroupStateTimeout.EventTimeTimeout)
    weeks = found.select(*KEYS, F.inline(F.arrays_zip("start", "days", "total")))
    rain = F.when(F.col("days") > 0, F.col("total")).alias("rainfall_mm")
    return weeks.select(*KEYS, F.timestamp_millis("start").cast("date").alias("week_start"), "days", rain)


def _write(batch: DataFrame, epoch: int, table: str) -> None:
    tagged = batch.withColumn("batch", F.lit(epoch))
    tagged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(table)


def run_once(spark: SparkSession, landing: str, table: str, checkpoint: str, delay: str = DELAY) -> None:
    """Reads what has landed since the last call, writes the weeks that this closes, and stops."""
    rows = spark.readStream.schema(sc.DAILY).parquet(landing)
    query = (
        weekly(rows, delay).writeStream.outputMode("append")
        .foreachBatch(lambda batch, epoch: _write(batch, epoch, table))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def closed_weeks(spark: SparkSession, table: str) -> DataFrame:
    schema = sc.struct(
        state=sc.T.StringType(), district=sc.T.StringType(), week_start=sc.T.DateType(), days=sc.T.LongType(), rainfall_mm=sc.T.DoubleType(),
        batch=sc.T.LongType(),
    )
    return spark.read.schema(schema).parquet(table).drop("batch")
