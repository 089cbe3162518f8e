"""Many what-if scenarios of a season from one pass over the daily rows.

A season block is one row per site and crop year that carries its days, at most 153 of them. A scenario is a fold over those
days which adjusts each one on the way, so the daily rows are shuffled once, whatever the number of scenarios, and the
features of a scenario never leave the row. Tasks fold their blocks in Arrow batches, some hundred blocks at a time. What lies outside the season enters the annual figures as three numbers.

The adjustments act in a fixed order: rain is scaled, a dry spell empties days, all days get warmer, a heatwave warms some of
them further, and the yearly inputs are shifted. Lags, vegetation and humidity stay as they are.

Defined results: a season without any day has no row; a day without rain counts for no total and ends a dry run, unless a dry
spell empties it; repeated site-days each count, as in the other seasonal features; no scenarios give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, fields, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agropanel.functions import seasons as S
from agropanel.functions.scalars import clip
from agropanel.operators import anomaly
from agropanel.operators.scenario import BOUNDS, clamped, sweep
from agropanel.operators.weather import DRY_DAY_MM, ET0_FACTOR, ET0_OFFSET_C, FROST_DAY_C, GDD_BASE_C, HEAT_DAY_C

SITE = ("state", "district")
MEMBERS = {"kharif": S.is_kharif, "rabi": S.is_rabi}
_DAY = ("rainfall_mm", "temp_max_c", "temp_min_c", "temp_avg_c", "solar_radiation")
MOST_GRID = 15  # values of each parameter of a grid


@dataclass(frozen=True)
class Adjustment:
    """One scenario; the default changes nothing. Starts count from the first day of the season."""

    rain_scale_pct: float = 0.0
    dry_spell_days: float = 0.0
    dry_spell_start: int = 0
    temp_shift_c: float = 0.0
    heatwave_days: float = 0.0
    heatwave_start: int = 0
    heatwave_delta_c: float = 0.0
    irrigation_pct_delta: float = 0.0
    nitrogen_pct_delta: float = 0.0

    def bounded(self) -> tuple[Adjustment, tuple[str, ...]]:
        """The scenario inside its bounds, and the parameters that had to be moved."""
        inside = {c: clamped(c, getattr(self, c)) for c in BOUNDS}
        return replace(self, **{c: x for c, (x, _) in inside.items()}), tuple(c for c, (_, moved) in inside.items() if moved)


PARAMETERS = tuple(f.name for f in fields(Adjustment))
# The change of each operator that the ranked comparison applies in both directions.
STEPS = {
    "rain_scale_pct": {"rain_scale_pct": 20.0},
    "temp_shift_c": {"temp_shift_c": 1.0},
    "irrigation_pct_delta": {"irrigation_pct_delta": 10.0},
    "nitrogen_pct_delta": {"nitrogen_pct_delta": 20.0},
}


def varied(base: Adjustment, parameter: str, start: float, stop: float, steps: int) -> list[Adjustment]:
    """Scenarios that differ from `base` in one parameter, at equal distances."""
    return [replace(base, **{parameter: x}) for x in sweep(start, stop, steps)]


def crossed(base: Adjustment, one: tuple[str, Sequence[float]], two: tuple[str, Sequence[float]]) -> list[Adjustment]:
    """Scenarios for each pair of values of two parameters."""
    if max(len(one[1]), len(two[1])) > MOST_GRID:
        raise ValueError(f"a grid takes at most {MOST_GRID} values of a parameter")
    return [replace(base, **{one[0]: x, two[0]: y}) for x in one[1] for y in two[1]]


# ---- blocks ---------------------------------------------------------------------------------------------------

def season_blocks(daily: DataFrame, season: str, keys: Sequence[str] = SITE) -> DataFrame:
    """(keys, year, days, …): the days of one season per site and crop year, in order, and what the rest of the year adds."""
    member = MEMBERS[season]("date")
    days = daily.withColumns({"year": S.crop_year("date"), "_in": member, "day": S.block_day("date")})
    rest = ~F.col("_in")
    # the grouping keeps this partitioning; the folds cost more than the bytes tell, so the tasks are not to be merged
    spread = days.repartition(int(daily.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    wide = spread.groupBy(*keys, "year").agg(
        # a season has no more days than the calendar gives it
        F.sort_array(F.collect_list(F.when(F.col("_in"), F.struct("day", *_DAY)))).alias("days"),
        F.coalesce(F.sum(F.when(rest, F.col("rainfall_mm"))), F.lit(0.0)).alias("_rain_rest"),
        F.count_if(rest & (F.col("temp_max_c") > HEAT_DAY_C)).alias("_heat_rest"),
        F.count_if(rest & (F.col("temp_min_c") < FROST_DAY_C)).alias("_frost_rest"),
    )
    return wide.where(F.size("days") > 0)


_COUNTS = ("rain_n", "tavg_n", "tmax_n", "heat", "frost", "longest")
_SUMS = ("rain", "mean", "spread", "tavg", "tmax", "gdd", "et0")
_TOTALS = f"array<struct<{','.join(f'{c}:bigint' for c in _COUNTS)},{','.join(f'{c}:double' for c in _SUMS)}>>"
BLOCKS = 256  # blocks whose days are held in arrays at once


def _columns(days: pa.Array) -> tuple[np.ndarray, dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Number of days of each block, and the days of all of them as values and as whether they are known, by name."""
    flat = days.flatten()
    kinds = {c: pc.struct_field(flat, c).cast(pa.float64()) for c in ("day", *_DAY)}
    values = {c: x.fill_null(0.0).to_numpy(zero_copy_only=False) for c, x in kinds.items()}
    return pc.fill_null(pc.list_value_length(days), 0).to_numpy(), values, {c: x.is_valid().to_numpy(zero_copy_only=False) for c, x in kinds.items()}


def _summed(sizes: np.ndarray, value: dict[str, np.ndarray], known: dict[str, np.ndarray], a: Adjustment) -> dict[str, np.ndarray]:
    """Totals of each block's days under one scenario."""
    filled = sizes > 0
    starts = np.cumsum(sizes) - sizes
    first, at = np.repeat(starts, sizes), starts[filled]

    def reduced(how: np.ufunc, x: np.ndarray, kind: type) -> np.ndarray:
        out = np.zeros(len(sizes), kind)
        if len(at):
            out[filled] = how.reduceat(x.astype(kind), at)
        return out

    def count(x: np.ndarray) -> np.ndarray:
        return reduced(np.add, x, np.int64)

    def total(x: np.ndarray, where: np.ndarray) -> np.ndarray:
        return reduced(np.add, np.where(where, x, 0.0), float)

    def hit(name: str) -> np.ndarray:
        start = getattr(a, f"{name}_start")
        return (value["day"] >= start) & (value["day"] < start + getattr(a, f"{name}_days"))

    empty, warm = hit("dry_spell"), np.where(hit("heatwave"), a.heatwave_delta_c, 0.0)
    rain = np.where(empty, 0.0, value["rainfall_mm"] * (1 + a.rain_scale_pct / 100))
    wet, mid, high, low = known["rainfall_mm"] | empty, known["temp_avg_c"], known["temp_max_c"], known["temp_min_c"]
    tavg, tmax = value["temp_avg_c"] + a.temp_shift_c + warm, value["temp_max_c"] + a.temp_shift_c + warm
    tmin = value["temp_min_c"] + a.temp_shift_c
    n, rain_sum = count(wet), total(rain, wet)
    mean = rain_sum / np.maximum(n, 1)
    place = np.arange(len(rain))
    # the last day that ends a dry run, or the day before the block
    ended = np.maximum.accumulate(np.maximum(np.where(wet & (rain < DRY_DAY_MM), -1, place), first - 1)) if len(rain) else place
    gap = tmax - tmin
    et0 = value["solar_radiation"] * (tavg + ET0_OFFSET_C) * np.sqrt(np.where(gap < 0, 0.0, gap)) * ET0_FACTOR
    return {
        "rain_n": n, "tavg_n": count(mid), "tmax_n": count(high), "heat": count(high & ((tmax > HEAT_DAY_C) | np.isnan(tmax))),
        "frost": count(low & (tmin < FROST_DAY_C)), "longest": reduced(np.maximum, place - ended, np.int64), "rain": rain_sum, "mean": mean,
        "spread": total((rain - np.repeat(mean, sizes)) ** 2, wet), "tavg": total(tavg, mid), "tmax": total(tmax, high),
        "gdd": total(np.maximum(tavg - GDD_BASE_C, 0.0), mid), "et0": total(et0, known["solar_radiation"] & mid & high & low),
    }


def _totals(cases: Sequence[Adjustment]) -> Column:
    """Array with the totals of a block's days for each of `cases`: the days go to Python once, whatever their number."""
    cases = list(cases)

    def folded(days: pa.Array) -> pa.Array:
        sizes, value, known = _columns(days)
        found = [_summed(sizes, value, known, a) for a in cases]
        fields = {c: np.stack([f[c] for f in found], axis=1).ravel() if found else np.zeros(0, np.int64 if c in _COUNTS else float) for c in (*_COUNTS, *_SUMS)}
        offsets = np.arange(len(days) + 1, dtype=np.int32) * len(cases)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(x) for x in fields.values()], list(fields)))

    @F.arrow_udf(_TOTALS)
    def run(days: pa.Array) -> pa.Array:
        return pa.concat_arrays([folded(days.slice(i, BLOCKS)) for i in range(0, max(1, len(days)), BLOCKS)])

    return F.when(F.col("days").isNotNull(), run("days"))


def feature_names(season: str) -> list[str]:
    return [
        f"nasa_rainfall_{season}", f"nasa_temp_avg_{season}", f"nasa_temp_max_{season}", f"gdd_{season}", f"max_dry_streak_{season}",
        f"rainfall_cv_{season}", f"water_balance_{season}", "nasa_rainfall_annual", "heat_stress_days", "frost_risk_days",
    ]


def _features(blocks: DataFrame, season: str) -> DataFrame:
    """`blocks` with the season's features from their totals `_t`."""
    t = F.col("_t")
    n = t["rain_n"]
    deviation = F.when(n > 1, F.sqrt(t["spread"] / F.when(n > 1, n - 1)))
    values = (
        t["rain"], F.try_divide(t["tavg"], t["tavg_n"]), F.try_divide(t["tmax"], t["tmax_n"]), t["gdd"], t["longest"],
        F.when((n > 0) & (t["mean"] > 0), deviation / t["mean"]), t["rain"] - t["et0"], F.col("_rain_rest") + t["rain"],
        F.col("_heat_rest") + t["heat"], F.col("_frost_rest") + t["frost"],
    )
    return blocks.withColumns(dict(zip(feature_names(season), values, strict=True))).drop("_t")


def baseline(blocks: DataFrame, season: str) -> DataFrame:
    """Blocks with their features as observed."""
    return _features(blocks.withColumn("_t", _totals([Adjustment()])[0]), season)


def scenarios(blocks: DataFrame, season: str, cases: Sequence[Adjustment]) -> DataFrame:
    """Every block once per scenario: its number, its parameters and the features under it.

    `blocks` may have the yearly inputs; irrigation, nitrogen and fertilizer move if they are there.
    """
    numbered = [F.struct(F.lit(i).alias("scenario"), *[F.lit(float(v)).alias(c) for c, v in asdict(a).items()]) for i, a in enumerate(cases)]
    kind = f"array<struct<scenario:int,{','.join(f'{c}:double' for c in PARAMETERS)}>>"
    kept = [c for c in blocks.columns if c not in (*PARAMETERS, "scenario")]
    folded = blocks.withColumn("_all", _totals(cases))
    each = folded.select(*kept, F.explode(F.arrays_zip(F.array(*numbered).cast(kind).alias("s"), F.col("_all").alias("t"))).alias("_e"))
    out = _features(each.select(*kept, "_e.s.*", F.col("_e.t").alias("_t")), season)
    shifts = {
        "irrigation_pct": clip(F.col("irrigation_pct") + F.col("irrigation_pct_delta"), 0, 100) if "irrigation_pct" in kept else None,
        **{c: F.col(c) * (1 + F.col("nitrogen_pct_delta") / 100) if c in kept else None for c in ("nitrogen_per_ha", "fertilizer_per_ha")},
    }
    present = {c: x for c, x in shifts.items() if x is not None}
    return (out.withColumns(present) if present else out).drop("days", "_rain_rest", "_heat_rest", "_frost_rest")


# ---- what is served -------------------------------------------------------------------------------------------

def with_anomaly(rows: DataFrame, history: DataFrame, season: str, keys: Sequence[str] = SITE) -> DataFrame:
    """Anomaly of a scenario's season rain against the site's observed history, with its two flags."""
    measure = f"nasa_rainfall_{season}"
    based = rows.join(anomaly.site_baseline(history, measure, keys, "mean_rainfall", "std_rainfall"), list(keys), "left")
    return anomaly.with_rai(based, measure).drop("mean_rainfall", "std_rainfall")


def scored(
    daily: DataFrame, season: str, cases: Sequence[Adjustment], score: Callable[[DataFrame], DataFrame], keys: Sequence[str] = SITE
) -> DataFrame:
    """(keys, year, scenario, parameters, features, pred_yield, scenario_yield, delta, delta_pct) from one pass over the daily rows.

    `score` adds scenario_yield to rows with the features. It sees the observed season and each scenario.
    """
    base = score(baseline(season_blocks(daily, season, keys), season)).withColumnRenamed("scenario_yield", "pred_yield")
    found = score(scenarios(base.drop(*feature_names(season)), season, cases))
    delta = F.col("scenario_yield") - F.col("pred_yield")
    return found.withColumns({"delta": delta, "delta_pct": F.try_divide(delta * 100, F.col("pred_yield"))})


def sensitivity_cases(base: Adjustment = Adjustment(), steps: dict[str, dict[str, float]] | None = None) -> list[tuple[str, str, Adjustment]]:
    """(operator, 'low' or 'high', scenario): every operator one step down and up, kept inside its bounds.

    A step that can only go one way (a spell has no negative length) stays at the base on the other side.
    """
    cases = []
    for operator, change in (STEPS if steps is None else steps).items():
        for side, sign in (("low", -1), ("high", 1)):
            moved = {c: getattr(base, c) + sign * x for c, x in change.items() if c in BOUNDS}
            fixed = {c: x for c, x in change.items() if c not in BOUNDS}
            cases.append((operator, side, replace(base, **moved, **fixed).bounded()[0]))
    return cases


def ranked(results: DataFrame, cases: Sequence[tuple[str, str, Adjustment]], keys: Sequence[str]) -> DataFrame:
    """(keys, operator, low, high, swing, rank): effect of each operator in both directions, greatest swing first.

    A key has one row per operator, so the window stays as small as their number; equal swings rank by name.
    """
    names = F.array(*[F.lit(o) for o, _, _ in cases])
    sides = F.array(*[F.lit(s) for _, s, _ in cases])
    named = results.withColumns({"operator": F.get(names, F.col("scenario")), "_side": F.get(sides, F.col("scenario"))})
    both = named.groupBy(*keys, "operator").agg(
        F.max(F.when(F.col("_side") == "low", F.col("delta"))).alias("low"), F.max(F.when(F.col("_side") == "high", F.col("delta"))).alias("high"))
    both = both.withColumn("swing", F.abs(F.col("high") - F.col("low")))
    # rounded, so that sums in another order rank alike
    order = Window.partitionBy(*keys).orderBy(F.round("swing", 6).desc_nulls_last(), "operator")
    return both.withColumn("rank", F.row_number().over(order))
