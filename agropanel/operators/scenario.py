"""What-if scenarios on model features and on the daily series behind them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agropanel.functions.scalars import clip

TEMPERATURE_COUNTS = ("heat_stress_days", "frost_risk_days")
# Allowed range of each daily-series adjustment.
BOUNDS = {
    "rain_scale_pct": (-60.0, 100.0),
    "dry_spell_days": (0.0, 60.0),
    "temp_shift_c": (-3.0, 5.0),
    "heatwave_days": (0.0, 30.0),
    "heatwave_delta_c": (0.0, 8.0),
    "irrigation_pct_delta": (-30.0, 30.0),
    "nitrogen_pct_delta": (-50.0, 50.0),
}


def rain_features(features: Sequence[str]) -> list[str]:
    return [c for c in features if "rainfall" in c or "water_balance" in c]


def temperature_features(features: Sequence[str]) -> list[str]:
    return [c for c in features if "temp" in c or "gdd" in c or c in TEMPERATURE_COUNTS]


def with_scenarios(df: DataFrame, scenarios: Sequence[tuple[float, float]]) -> DataFrame:
    """Every row once per (rain %, temperature °C) pair. The pairs are a short literal list, so this is a generator
    on each row and not a join."""
    pairs = F.array(
        *[F.struct(F.lit(float(r)).alias("rain_pct"), F.lit(float(t)).alias("temp_c")) for r, t in scenarios]
    )
    return df.withColumn("_s", F.explode(pairs)).select(*df.columns, "_s.rain_pct", "_s.temp_c")


def apply_features(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Shifts the features of a row by its own `rain_pct` and `temp_c`."""
    present = [c for c in features if c in df.columns]
    changed = {c: F.col(c) * (1 + F.col("rain_pct") / 100) for c in rain_features(present)}
    for c in temperature_features(present):
        changed[c] = changed.get(c, F.col(c)) + F.col("temp_c")
    return df.withColumns(changed) if changed else df


def reflag(df: DataFrame, limit: float = 25.0) -> DataFrame:
    """Dry or wet flags forced on by a large rain change, else as observed."""
    return df.withColumn(
        "drought_flag", F.when(F.col("rain_pct") <= -limit, 1).otherwise(F.col("drought_flag"))
    ).withColumn("flood_flag", F.when(F.col("rain_pct") >= limit, 1).otherwise(F.col("flood_flag")))


def scenario_grid(
    df: DataFrame, features: Sequence[str], scenarios: Sequence[tuple[float, float]],
    score: Callable[[DataFrame], DataFrame], baseline: str = "pred_yield",
) -> DataFrame:
    """All scenarios of all rows, scored in one pass, with the change against the baseline prediction."""
    scored = score(apply_features(with_scenarios(df, scenarios), features))
    return reflag(scored.withColumn("delta", F.col("scenario_yield") - F.col(baseline)))


def sweep(start: float, stop: float, steps: int, max_steps: int = 41) -> list[float]:
    if not 2 <= steps <= max_steps:
        raise ValueError(f"steps must be between 2 and {max_steps}")
    return [start + (stop - start) * i / (steps - 1) for i in range(steps)]


def clamped(name: str, value: float) -> tuple[float, bool]:
    """Value inside its bounds, and whether it had to be moved."""
    low, high = BOUNDS[name]
    inside = min(max(value, low), high)
    return inside, inside != value


# ---- daily series ---------------------------------------------------------------------------------------------

def scale_rain(daily: DataFrame, percent: float) -> DataFrame:
    return daily.withColumn("rainfall_mm", F.col("rainfall_mm") * (1 + percent / 100))


def dry_spell(daily: DataFrame, day: Column, start: int, days: int) -> DataFrame:
    """No rain on a run of days, counted from the start of the season."""
    hit = (day >= start) & (day < start + days)
    return daily.withColumn("rainfall_mm", F.when(hit, F.lit(0.0)).otherwise(F.col("rainfall_mm")))


def shift_temperature(daily: DataFrame, degrees: float) -> DataFrame:
    return daily.withColumns({c: F.col(c) + degrees for c in ("temp_max_c", "temp_min_c", "temp_avg_c")})


def heatwave(daily: DataFrame, day: Column, start: int, days: int, degrees: float) -> DataFrame:
    """Warmer maximum and mean on a run of days."""
    hit = (day >= start) & (day < start + days)
    return daily.withColumns(
        {c: F.when(hit, F.col(c) + degrees).otherwise(F.col(c)) for c in ("temp_max_c", "temp_avg_c")}
    )


def shift_inputs(panel: DataFrame, irrigation_points: float = 0.0, nitrogen_percent: float = 0.0) -> DataFrame:
    factor = 1 + nitrogen_percent / 100
    return panel.withColumns(
        {
            "irrigation_pct": clip(F.col("irrigation_pct") + irrigation_points, 0, 100),
            "nitrogen_per_ha": F.col("nitrogen_per_ha") * factor,
            "fertilizer_per_ha": F.col("fertilizer_per_ha") * factor,
        }
    )


def out_of_range(df: DataFrame, history: DataFrame, features: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Names of the features of a row that lie outside what its own history has seen."""
    spans = history.groupBy(*keys).agg(
        *[F.min(c).alias(f"_lo_{c}") for c in features], *[F.max(c).alias(f"_hi_{c}") for c in features]
    )
    joined = df.join(spans, list(keys), "left")
    outside = F.array(
        *[
            F.when((F.col(c) < F.col(f"_lo_{c}")) | (F.col(c) > F.col(f"_hi_{c}")), F.lit(c))
            for c in features
        ]
    )
    named = joined.withColumn("out_of_range", F.filter(outside, lambda x: x.isNotNull()))
    return named.drop(*[f"_lo_{c}" for c in features], *[f"_hi_{c}" for c in features])
