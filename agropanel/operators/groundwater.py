"""Well readings in wide form to depths per site and year, and their trend against model errors."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agropanel.functions import scalars as f
from agropanel.operators.ranks import wide_quantiles

PERIOD = r"^(Jan|May|Aug|Nov)-\d{2}$"
SITE = ("state", "district")


def period_columns(df: DataFrame, pattern: str = PERIOD) -> list[str]:
    return [c for c in df.columns if re.match(pattern, c)]


def wells_long(wide: DataFrame, ids: Sequence[str] = SITE, century: int = 2000) -> DataFrame:
    """One row per well and period with a numeric reading."""
    periods = period_columns(wide)
    text = wide.select(*ids, *[F.col(f"`{c}`").cast("string").alias(c) for c in periods])
    long = text.unpivot(list(ids), periods, "period", "_v").withColumn("gwl", F.col("_v").try_cast("double"))
    long = long.where(F.col("gwl").isNotNull()).drop("_v")
    return long.withColumn("month", f.period_month("period")).withColumn("year", f.period_year("period", century))


def wells_by_year(long: DataFrame, keys: Sequence[str] = (*SITE, "year"), prefix: str = "gw_depth") -> DataFrame:
    """Median and mean depth and number of wells; the median is exact and does not gather a group's readings."""
    return wide_quantiles(
        long, "gwl", {f"{prefix}_median": 0.5}, list(keys), mean=f"{prefix}_mean", count="n_wells"
    )


def pre_and_post(long: DataFrame) -> DataFrame:
    """Pre-monsoon (May) and post-monsoon (November) depth per site and year.

    Both readings come out of one grouping by month, which makes the full outer join a conditional aggregation.
    """
    keys = [*SITE, "year"]
    by_month = wells_by_year(long.where(F.col("month").isin("May", "Nov")), [*keys, "month"])

    def pick(column, month):
        return F.max(F.when(F.col("month") == month, F.col(column)))

    return by_month.groupBy(*keys).agg(
        pick("gw_depth_median", "May").alias("gw_depth_premonsoon_m"),
        pick("gw_depth_mean", "May").alias("gw_depth_premonsoon_mean_m"),
        pick("n_wells", "May").alias("n_wells_premonsoon"),
        pick("gw_depth_median", "Nov").alias("gw_depth_postmonsoon_m"),
        pick("gw_depth_mean", "Nov").alias("gw_depth_postmonsoon_mean_m"),
        pick("n_wells", "Nov").alias("n_wells_postmonsoon"),
    )


def implausible_depths(depths: DataFrame, limit_m: float = 100.0) -> DataFrame:
    deep = (F.col("gw_depth_premonsoon_m") > limit_m) | (F.col("gw_depth_postmonsoon_m") > limit_m)
    return depths.agg(F.count_if(deep).alias("n_implausible"))


def join_by_name(left: DataFrame, right: DataFrame, name: str = "district", also: Sequence[str] = ("year",)) -> DataFrame:
    """Inner join on a name whose case and outer blanks may differ."""
    a = left.withColumn("_name", f.name_key(name))
    b = right.withColumn("_name", f.name_key(name)).drop(name)
    b = b.drop(*[c for c in b.columns if c in left.columns and c not in also])
    return a.join(b, ["_name", *also]).drop("_name")


def trend(df: DataFrame, key: str, x: str, y: str, name: str, min_points: int = 3) -> DataFrame:
    """Least-squares slope per key, for keys with more than `min_points` values."""
    known = F.col(x).isNotNull() & F.col(y).isNotNull()
    stats = df.where(known).groupBy(key).agg(F.regr_slope(y, x).alias(name), F.count(F.lit(1)).alias("_n"))
    return stats.where(F.col("_n") > min_points).drop("_n")


def abs_error(df: DataFrame, key: str, residual: str = "residual") -> DataFrame:
    return df.groupBy(key).agg(F.avg(F.abs(residual)).alias("abs_error"), F.count(F.lit(1)).alias("n"))


def pearson(df: DataFrame, x: str, y: str, min_rows: int = 5) -> DataFrame:
    """Correlation and number of pairs in one row; null below `min_rows` pairs."""
    both = df.dropna(subset=[x, y])
    n = F.count(F.lit(1))
    return both.agg(n.alias("n"), F.when(n >= min_rows, F.corr(x, y)).alias("r"))


def pearson_p(r: float, n: int) -> float:
    """Two-sided p-value of a correlation: the tail of Student's t with n - 2 degrees of freedom."""
    if n < 3 or abs(r) >= 1:
        return 0.0 if abs(r) >= 1 else 1.0
    df = n - 2
    x = 1 - r * r  # P(|T| > t) = I_x(df/2, 1/2) with x = df / (df + t^2)
    return _beta_tail(df / 2, 0.5, x)


def _beta_tail(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return max(0.0, min(1.0, x))
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_tail(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    out = d
    for m in range(1, 500):
        for top in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1 / ((1 + top * d) or tiny)
            c = (1 + top / c) or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * out


# Coefficients of the Lanczos approximation of the gamma function (g = 7)
LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905,
    -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)
FRACTION_STEPS = 200  # most steps of the continued fraction; it settles after some dozen, later for many pairs
STEPS_AT_LEAST, STEPS_BY_ROOT = 14, 4  # measured: 10 for five pairs, and never more than these for up to 200,000


def _log_gamma(x: Column) -> Column:
    """For x of one half or more."""
    z = x - 1
    series = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], 1):
        series = series + F.lit(c) / (z + i)
    t = z + 7.5
    return F.lit(0.5 * math.log(2 * math.pi)) + (z + 0.5) * F.log(t) - t + F.log(series)


def _bound(values: dict[str, Column], then: Callable[[Column], Column]) -> Column:
    """`then` of a struct of `values`, each of which is computed once per row, however often `then` names it."""
    return F.transform(F.array(F.struct(*[c.alias(name) for name, c in values.items()])), then)[0]


def _beta_tail_column(known: Column) -> Column:
    """P-value of `known` (r, n) with at least three pairs off a line."""
    r = known["r"]
    a, x = (known["n"] - 2).cast("double") / 2, 1 - r * r
    swap = x > (a + 1) / (a + 2.5)
    sides = {"p": F.when(swap, 0.5).otherwise(a), "q": F.when(swap, a).otherwise(0.5), "y": F.when(swap, 1 - x).otherwise(x), "swap": swap}
    return _bound(sides, _fraction)


def fraction_steps(a: Column) -> Column:
    """Steps after which the fraction has settled for half the degrees of freedom `a`."""
    return F.least(F.lit(FRACTION_STEPS), F.ceil(STEPS_AT_LEAST + STEPS_BY_ROOT * F.sqrt(F.greatest(a, F.lit(1.0)))).cast("int"))


def _fraction(side: Column) -> Column:
    p, q, y = side["p"], side["q"], side["y"]
    front = F.exp(_log_gamma(p + q) - _log_gamma(p) - _log_gamma(q) + p * F.log(y) + q * F.log(1 - y)) / p

    def step(state, top):
        return _bound({"d": 1 / (1 + top * state["d"]), "c": 1 + top / state["c"], "out": state["out"]},
                      lambda s: F.struct(s["c"].alias("c"), s["d"].alias("d"), (s["out"] * s["c"] * s["d"]).alias("out")))

    def both(state, i):
        m = i.cast("double")
        first = step(state, m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)))
        return _bound({"s": first}, lambda b: step(b["s"], -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))))

    d0 = 1 / (1 - (p + q) * y / (p + 1))
    start = F.struct(F.lit(1.0).alias("c"), d0.alias("d"), d0.alias("out"))
    tail = front * F.aggregate(F.sequence(F.lit(1), fraction_steps(F.greatest(p, q))), start, both)["out"]
    return F.when(side["swap"], 1 - tail).otherwise(tail)


def pearson_p_column(r: Column, n: Column) -> Column:
    """`pearson_p` for every row: null where r is null, 1 below three pairs, 0 where all pairs lie on a line.

    The incomplete beta function's continued fraction runs as an aggregate over a sequence as long as the number of pairs
    needs it, so a table of many groups needs no Python; what all steps share is computed once.
    """
    value = _bound({"r": r, "n": n}, _beta_tail_column)
    return F.when(F.abs(r) >= 1, 0.0).when((n < 3) | (r == 0), F.when(r.isNotNull(), 1.0)).otherwise(value)


def pearson_by(df: DataFrame, x: str, y: str, by: list[str], min_rows: int = 5) -> DataFrame:
    """(by…, n, r, p): correlation of each group with its two-sided p-value; null below `min_rows` pairs."""
    n = F.count(F.lit(1))
    found = df.dropna(subset=[x, y]).groupBy(*by).agg(n.alias("n"), F.when(n >= min_rows, F.corr(x, y)).alias("r"))
    return found.withColumn("p", pearson_p_column(F.col("r"), F.col("n")))
