"""Exact ranks and quantiles that never sort one group in one task.

Rows are first reduced to distinct keys with counts. The key space is then range-partitioned, so each range holds a
bounded share of the keys whatever group they belong to, and the range number is checkpointed with the keys. Counts
per range give each range its offset; only inside a range are rows ordered by a window.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agropanel.lineage import cut

SKETCH = 1000  # accuracy of the sketch that brackets a quantile; it changes the work, not the result


def _ranged(keys: DataFrame, columns: Sequence[str], pieces: int | None) -> DataFrame:
    """Keys with the number of their range; greater keys never have a smaller number.

    The number is stored by the checkpoint, so every later step sees the same ranges. Without `pieces` the session's
    shuffle partitions decide.
    """
    spread = keys.repartitionByRange(pieces, *columns) if pieces else keys.repartitionByRange(*columns)
    return cut(spread.withColumn("_range", F.spark_partition_id()))


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys match; the key columns of the left side are kept."""
    renamed = right.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys]
    )
    condition = F.lit(True)
    for k in keys:
        condition = condition & left[k].eqNullSafe(renamed[f"_r_{k}"])
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in keys])


def _cumulative(df: DataFrame, by: Sequence[str], value: str, pieces: int | None):
    """(counted keys with their range, ranges with the number of rows before them inside their group)."""
    keys = [*by, value]
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    counted = _ranged(counts, keys, pieces)
    spans = counted.groupBy(*by, "_range").agg(F.sum("_n").alias("_range_n"))
    # at most one row per range and group here, so these windows stay small
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    earlier = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("_before", F.coalesce(F.sum("_range_n").over(earlier), F.lit(0)))
    spans = spans.withColumn("_total", F.sum("_range_n").over(whole))
    return counted, spans


def exact_quantiles(
    df: DataFrame, value: str, probabilities: Sequence[float], by: Sequence[str] = (), pieces: int | None = None
) -> DataFrame:
    """Linearly interpolated quantiles per group as rows (by…, p, quantile)."""
    by = list(by)
    counted, spans = _cumulative(df.select(*by, value), by, value, pieces)
    return _pick(counted, spans, value, probabilities, by)


def _pick(counted: DataFrame, spans: DataFrame, value: str, probabilities: Sequence[float], by: Sequence[str]) -> DataFrame:
    """Values at the wanted positions; only ranges that hold one are ordered."""

    def low(p):
        return F.floor(F.lit(float(p)) * (F.col("_total") - 1))

    def high(p):
        return F.ceil(F.lit(float(p)) * (F.col("_total") - 1))

    def inside(position, start, n):
        return (position >= start) & (position < start + n)

    needed = F.lit(False)
    for p in probabilities:
        for position in (low(p), high(p)):
            needed = needed | inside(position, F.col("_before"), F.col("_range_n"))
    hits = spans.where(needed).select(*by, "_range", "_before", "_total")
    ranked = null_safe_join(counted, hits, [*by, "_range"])
    within = Window.partitionBy(*by, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumn("_start", F.col("_before") + F.coalesce(F.sum("_n").over(within), F.lit(0)))
    wanted = F.array(
        *[F.struct(F.lit(float(p)).alias("p"), low(p).alias("lo"), high(p).alias("hi")) for p in probabilities]
    )
    at = (
        ranked.select(*by, value, "_n", "_start", "_total", F.explode(wanted).alias("w"))
        .select(
            *by,
            F.col("w.p").alias("p"),
            (F.col("w.p") * (F.col("_total") - 1) - F.col("w.lo")).alias("_frac"),
            F.when(inside(F.col("w.lo"), F.col("_start"), F.col("_n")), F.col(value)).alias("_lo"),
            F.when(inside(F.col("w.hi"), F.col("_start"), F.col("_n")), F.col(value)).alias("_hi"),
        )
        .where(F.col("_lo").isNotNull() | F.col("_hi").isNotNull())
        .groupBy(*by, "p")
        .agg(F.max("_lo").alias("_lo"), F.max("_hi").alias("_hi"), F.max("_frac").alias("_frac"))
    )
    lo, hi = F.col("_lo").cast("double"), F.col("_hi").cast("double")
    return at.select(*by, "p", (lo + (hi - lo) * F.col("_frac")).alias("quantile"))


def wide_quantiles(
    df: DataFrame, value: str, named: dict[str, float], by: Sequence[str] = (), pieces: int | None = None,
    mean: str | None = None, count: str | None = None,
) -> DataFrame:
    """Quantiles with one column per name; mean and number of values come from the same counted keys."""
    by = list(by)
    counted, spans = _cumulative(df.select(*by, value), by, value, pieces)
    long = _pick(counted, spans, value, list(named.values()), by)
    picks = [F.max(F.when(F.col("p") == float(p), F.col("quantile"))).alias(name) for name, p in named.items()]
    out = long.groupBy(*by).agg(*picks)
    extra = []
    if mean:
        extra.append((F.sum(F.col(value) * F.col("_n")) / F.sum("_n")).alias(mean))
    if count:
        extra.append(F.sum("_n").alias(count))
    return null_safe_join(out, counted.groupBy(*by).agg(*extra), by) if extra else out


def narrow_quantiles(df: DataFrame, value: str, named: dict[str, float], by: Sequence[str] = (), pieces: int | None = None) -> DataFrame:
    """`wide_quantiles` of doubles in few, large groups: exact, without moving more than a small share of the values.

    A sketch gives each wanted quantile a bracket. Values outside of it keep their place as an infinity, so the rows of a task
    shrink to the values inside and two more before they move. A bracket that misses its quantile would show as a result that is
    not finite; then all values are counted, as they are if they hold such values themselves.
    """
    by, wide = list(by), 2 / SKETCH
    rows = df.select(*by, F.col(value).cast("double").alias(value)).where(F.col(value).isNotNull())
    sketch = F.percentile_approx(value, [min(max(p + d, 0.0), 1.0) for p in named.values() for d in (-wide, wide)], SKETCH)
    # one row per group on the right
    brackets = F.broadcast(rows.groupBy(*by).agg(sketch.alias("_b"), F.count(F.lit(1)).alias("_c")))
    beside = null_safe_join(rows, brackets, by) if by else rows.crossJoin(brackets)

    def end(place: int, inside: bool, open_: float):
        # a small group needs no bracket, and a bracket of few rows could miss the two that a quantile lies between
        return F.when(F.lit(inside) & (F.col("_c") >= 10 * SKETCH), F.col("_b")[place]).otherwise(F.lit(open_))

    ends = [
        F.struct(F.lit(i).alias("i"), end(2 * i, p > wide, -math.inf).alias("low"), end(2 * i + 1, p < 1 - wide, math.inf).alias("high"))
        for i, p in enumerate(named.values())]
    each = beside.select(*by, value, F.explode(F.array(*ends)).alias("_end"))
    kept = F.when(F.col(value) < F.col("_end.low"), -math.inf).when(F.col(value) > F.col("_end.high"), math.inf).otherwise(F.col(value))
    # the probability is part of the group: its values outside of the bracket are infinities for it alone
    counted, spans = _cumulative(each.select(*by, F.col("_end.i").alias("_i"), kept.alias(value)), [*by, "_i"], value, pieces)
    long = _pick(counted, spans, value, list(named.values()), [*by, "_i"])
    own = [F.max(F.when((F.col("_i") == i) & (F.col("p") == float(p)), F.col("quantile"))).alias(name) for i, (name, p) in enumerate(named.items())]
    out = cut(long.groupBy(*by).agg(*own))
    finite = F.lit(True)
    for name in named:
        finite = finite & F.coalesce(F.abs(F.col(name)) < math.inf, F.lit(False))
    return out if out.where(~finite).isEmpty() else wide_quantiles(df, value, named, by, pieces)


def dense_numbers(keys: DataFrame, columns: Sequence[str], name: str = "rank", pieces: int | None = None) -> DataFrame:
    """Consecutive numbers from 1 in key order over distinct keys, without a single-partition sort."""
    columns = list(columns)
    placed = _ranged(keys, columns, pieces)
    spans = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_range").orderBy(*columns)
    numbered = placed.withColumn("_pos", F.row_number().over(inside))
    # one row per range partition on the right
    joined = numbered.join(F.broadcast(spans), "_range")
    return joined.withColumn(name, (F.col("_before") + F.col("_pos")).cast("long")).drop("_range", "_before", "_pos")
