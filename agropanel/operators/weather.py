"""Seasonal weather features from daily rows.

Everything here is one hash aggregation with map-side partials: season membership is a condition inside the
aggregates, and the order of days, which the dry-spell length needs, is kept in bit positions instead of a sort.
Kharif, Rabi and the agricultural year share one crop year, so one grouping serves all three and no outer join is
needed. Duplicate site-days are a data error (see gate.duplicate_keys).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agropanel.functions import seasons as S
from agropanel.operators.ranks import null_safe_join

# Agronomic constants.
GDD_BASE_C = 10.0
DRY_DAY_MM = 1.0
HEAT_DAY_C = 35.0
FROST_DAY_C = 2.0
FULL_RABI_DAYS = 140
ET0_FACTOR = 0.0023
ET0_OFFSET_C = 17.8

_DAYS_PER_WORD = 30  # two bits per day in a 64-bit word


def evapotranspiration() -> Column:
    """Daily reference evapotranspiration (simplified Hargreaves form with measured radiation)."""
    spread = F.col("temp_max_c") - F.col("temp_min_c")
    root = F.sqrt(F.when(spread < 0, F.lit(0.0)).otherwise(spread))
    return F.col("solar_radiation") * (F.col("temp_avg_c") + ET0_OFFSET_C) * root * ET0_FACTOR


def degree_days() -> Column:
    excess = F.col("temp_avg_c") - GDD_BASE_C
    return F.when(excess > 0, excess)


def with_day_bits(daily: DataFrame, day: Column) -> DataFrame:
    """Adds the daily terms of the features, and the word and two-bit code (present, and dry or not) of the day
    counted from the block start."""
    code = F.when(F.col("rainfall_mm") < DRY_DAY_MM, F.lit(3)).otherwise(F.lit(2)).cast("long")
    place = (2 * F.pmod(day, F.lit(_DAYS_PER_WORD))).cast("int")
    return daily.withColumns(
        {
            "_word": F.floor(day / _DAYS_PER_WORD).cast("int"),
            "_bits": F.call_function("shiftleft", code, place),
            "_gdd": degree_days(),
            "_et0": evapotranspiration(),
        }
    )


def _words(max_days: int) -> range:
    return range(-(-max_days // _DAYS_PER_WORD))


def dry_words(member: Column, name: str, max_days: int) -> list[Column]:
    """One word per 30 days; a partial result of fixed size that merges in any order."""
    return [
        F.bit_or(F.when(member & (F.col("_word") == w), F.col("_bits"))).alias(f"_{name}_{w}")
        for w in _words(max_days)
    ]


def longest_dry_run(name: str, max_days: int) -> Column:
    """Longest run of dry days: base-4 digits are 3 for dry, 2 for wet or unknown, 0 for an absent day."""
    digits = [
        F.lpad(F.conv(F.coalesce(F.col(f"_{name}_{w}"), F.lit(0)).cast("string"), 10, 4), _DAYS_PER_WORD, "0")
        for w in reversed(_words(max_days))
    ]
    present = F.replace(F.concat(*digits), F.lit("0"), F.lit(""))
    # the runs hold one repeated character, so the greatest text is the longest one
    return F.length(F.array_max(F.split(present, "2")))


def block_partials(member: Column, name: str, max_days: int = 153) -> list[Column]:
    """Aggregates of one season block; `member` says which rows belong to it."""

    def over(x) -> Column:
        return F.when(member, x)

    rain = F.col("rainfall_mm")
    return [
        F.count(over(F.lit(1))).alias(f"_{name}_rows"),
        F.count(over(rain)).alias(f"_{name}_days"),
        F.sum(over(rain)).alias(f"_{name}_rain"),
        F.avg(over(rain)).alias(f"_{name}_rain_mean"),
        F.stddev_samp(over(rain)).alias(f"_{name}_rain_std"),
        F.avg(over(F.col("temp_avg_c"))).alias(f"_{name}_tavg"),
        F.avg(over(F.col("temp_max_c"))).alias(f"_{name}_tmax"),
        F.avg(over(F.col("humidity_pct"))).alias(f"_{name}_humidity"),
        F.sum(over(F.col("_gdd"))).alias(f"_{name}_gdd"),
        F.sum(over(F.col("_et0"))).alias(f"_{name}_et0"),
        *dry_words(member, name, max_days),
    ]


def _zero(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0.0))


def agronomic_columns(name: str, suffix: str, prefix: str = "", max_days: int = 153, dry: Column | None = None) -> list[Column]:
    """Degree days, longest dry spell, rain variation and water balance of a block; null without any row.

    `dry` is the longest dry spell where it does not come from day words of this block.
    """
    seen = F.col(f"_{name}_rows") > 0
    mean = F.col(f"_{name}_rain_mean")
    return [
        F.when(seen, _zero(f"_{name}_gdd")).alias(f"{prefix}gdd_{suffix}"),
        F.when(seen, longest_dry_run(name, max_days) if dry is None else dry).alias(f"{prefix}max_dry_streak_{suffix}"),
        F.when(mean > 0, F.col(f"_{name}_rain_std") / mean).alias(f"{prefix}rainfall_cv_{suffix}"),
        F.when(seen, _zero(f"_{name}_rain") - _zero(f"_{name}_et0")).alias(f"{prefix}water_balance_{suffix}"),
    ]


def seasonal(daily: DataFrame, keys: Sequence[str] = ("state", "district"), known_days: bool = False) -> DataFrame:
    """One row per site and crop year with the Kharif, Rabi and agricultural-year blocks.

    With `known_days` also kharif_days_known, the monsoon days with a rainfall value.
    """
    keys = list(keys)
    tagged = daily.withColumns(
        {"year": S.crop_year("date"), "_is_k": S.is_kharif("date"), "_is_r": S.is_rabi("date")}
    )
    days = with_day_bits(tagged, S.block_day("date"))
    kharif, rabi = F.col("_is_k"), F.col("_is_r")
    wide = days.groupBy(*keys, "year").agg(
        *block_partials(kharif, "k"),
        *block_partials(rabi, "r"),
        F.sum("rainfall_mm").alias("_rain"),
        F.avg("solar_radiation").alias("_solar"),
        F.count_if(F.col("temp_max_c") > HEAT_DAY_C).alias("_heat"),
        F.count_if(F.col("temp_min_c") < FROST_DAY_C).alias("_frost"),
    )
    k_seen, r_seen = F.col("_k_rows") > 0, F.col("_r_rows") > 0
    return wide.select(
        *keys,
        "year",
        F.when(k_seen, _zero("_k_rain")).alias("nasa_rainfall_kharif"),
        F.col("_k_tavg").alias("nasa_temp_avg_kharif"),
        F.col("_k_tmax").alias("nasa_temp_max_kharif"),
        F.col("_k_humidity").alias("nasa_humidity_kharif"),
        *agronomic_columns("k", "kharif"),
        F.when(r_seen, _zero("_r_rain")).alias("nasa_rainfall_rabi"),
        F.col("_r_tavg").alias("nasa_temp_avg_rabi"),
        F.col("_r_tmax").alias("nasa_temp_max_rabi"),
        F.when(r_seen, F.col("_r_rows")).alias("rabi_days_observed"),
        F.when(r_seen, (F.col("_r_rows") < FULL_RABI_DAYS).cast("int")).alias("rabi_season_partial"),
        *agronomic_columns("r", "rabi"),
        _zero("_rain").alias("nasa_rainfall_annual"),
        F.col("_solar").alias("nasa_solar_annual"),
        F.col("_heat").alias("heat_stress_days"),
        F.col("_frost").alias("frost_risk_days"),
        *([F.col("_k_days").alias("kharif_days_known")] if known_days else []),
    )


def calendar_seasonal(daily: DataFrame, keys: Sequence[str] = ("district",)) -> DataFrame:
    """Earlier convention: every block is cut inside the calendar year, the winter months of one year together."""
    kharif, rabi = S.is_kharif("date"), S.is_rabi("date")

    def total(member=None):
        rain = F.col("rainfall_mm")
        return F.coalesce(F.sum(rain if member is None else F.when(member, rain)), F.lit(0.0))

    def mean(member, c):
        return F.avg(F.when(member, F.col(c)))

    return daily.groupBy(*keys, F.year("date").alias("year")).agg(
        total(kharif).alias("nasa_rainfall_kharif"),
        mean(kharif, "temp_avg_c").alias("nasa_temp_avg_kharif"),
        mean(kharif, "temp_max_c").alias("nasa_temp_max_kharif"),
        mean(kharif, "humidity_pct").alias("nasa_humidity_kharif"),
        total(rabi).alias("nasa_rainfall_rabi"),
        mean(rabi, "temp_avg_c").alias("nasa_temp_avg_rabi"),
        mean(rabi, "temp_max_c").alias("nasa_temp_max_rabi"),
        total().alias("nasa_rainfall_annual"),
        F.avg("solar_radiation").alias("nasa_solar_annual"),
        F.count_if(F.col("temp_max_c") > HEAT_DAY_C).alias("heat_stress_days"),
        F.count_if(F.col("temp_min_c") < FROST_DAY_C).alias("frost_risk_days"),
    )


def longest_dry_runs(days: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, _dry): longest run of dry days per key over any number of days, from rows with `_word` and `_bits`.

    Days merge into words of 30 as partial results; a key then holds one small number per word of its days.
    """
    words = days.groupBy(*keys, "_word").agg(F.bit_or("_bits").alias("_bits"))
    ordered = F.sort_array(F.collect_list(F.struct("_word", "_bits")), asc=False)
    digits = F.transform(ordered, lambda w: F.lpad(F.conv(w["_bits"].cast("string"), 10, 4), _DAYS_PER_WORD, "0"))
    present = F.replace(F.array_join(digits, ""), F.lit("0"), F.lit(""))
    return words.groupBy(*keys).agg(F.length(F.array_max(F.split(present, "2"))).alias("_dry"))


def block_features(block: DataFrame, keys: Sequence[str], season: str, prefix: str = "") -> DataFrame:
    """The four agronomic features of arbitrary blocks of daily rows, one block per key, however long."""
    days = with_day_bits(block, F.unix_date(F.col("date").cast("date")))
    wide = days.groupBy(*keys).agg(*block_partials(F.lit(True), "b", 0))
    joined = null_safe_join(wide, longest_dry_runs(days, keys), keys)
    return joined.select(*keys, *agronomic_columns("b", season, prefix, dry=F.col("_dry")))


def current_season(
    daily: DataFrame,
    rabi_start_year: int,
    keys: Sequence[str] = ("state", "district"),
    sites: DataFrame | None = None,
) -> DataFrame:
    """Live view: the winter season that began in the given year and the monsoon season after it, so far.

    Totals are null, not zero, where no value was reported. Every site keeps a row; with a site table only the days
    of the two seasons are read.
    """
    keys, y = list(keys), rabi_start_year
    winter = S.between_days("date", f"{y}-11-01", f"{y + 1}-03-31")
    monsoon = S.between_days("date", f"{y + 1}-06-01", f"{y + 1}-12-31")
    rows = daily if sites is None else daily.where(S.between_days("date", f"{y}-11-01", f"{y + 1}-12-31"))
    days = with_day_bits(rows, S.block_day("date"))
    live_rain = F.when(monsoon, F.col("rainfall_mm"))
    wide = days.groupBy(*keys).agg(
        *block_partials(winter, "r"),
        F.sum(live_rain).alias("_partial"),
        F.count(live_rain).alias("_partial_days"),
    )
    out = wide.select(
        *keys,
        F.col("_r_rain").alias("current_rabi_rainfall"),
        F.col("_r_tavg").alias("current_rabi_temp_avg"),
        F.col("_r_tmax").alias("current_rabi_temp_max"),
        F.col("_partial").alias("current_kharif_partial_rainfall"),
        F.col("_partial_days").alias("current_kharif_partial_days"),
        *agronomic_columns("r", "rabi", "current_"),
    )
    if sites is not None:
        out = sites.select(*keys).distinct().join(out, keys, "left")
        days_seen = F.coalesce("current_kharif_partial_days", F.lit(0))
        out = out.withColumn("current_kharif_partial_days", days_seen)
    return out.withColumn("data_as_of", daily.agg(F.max("date")).scalar())


def live_kharif(
    daily: DataFrame,
    year: int,
    scale: DataFrame | None = None,
    keys: Sequence[str] = ("state", "district"),
    sites: DataFrame | None = None,
) -> DataFrame:
    """Monsoon season of one year per site; with `scale` (keys, rain_scale, live_mean) on the training scale.

    The factor is constant per site, so it is applied to each daily value before the features are computed. Every
    site keeps a row, also one without any day in this season; a given site table saves looking for them in the
    daily rows.
    """
    keys = list(keys)
    days = daily.where(S.kharif_days("date", year))
    if scale is None:
        days = days.withColumns({"rain_scale": F.lit(1.0), "live_mean": F.lit(None).cast("double")})
    else:
        days = days.join(scale.select(*keys, "rain_scale", "live_mean"), keys, "left")
    raw = F.col("rainfall_mm")
    days = days.withColumn("_raw", raw).withColumn("rainfall_mm", raw * F.col("rain_scale"))
    days = with_day_bits(days, S.block_day("date"))
    wide = days.groupBy(*keys).agg(
        *block_partials(F.lit(True), "k"),
        F.count("_raw").alias("kharif_days_observed"),
        F.sum("_raw").alias("live_rain_raw"),
        F.max("rain_scale").alias("rain_scale"),
        F.max("live_mean").alias("live_mean"),
    )
    out = wide.select(
        *keys,
        "kharif_days_observed",
        "live_rain_raw",
        "rain_scale",
        ((F.try_divide(F.col("live_rain_raw"), F.col("live_mean")) - 1) * 100).alias("rain_departure_pct"),
        F.col("_k_rain").alias("cur_rain_kharif"),
        F.col("_k_tavg").alias("cur_temp_avg_kharif"),
        F.col("_k_tmax").alias("cur_temp_max_kharif"),
        F.col("_k_humidity").alias("cur_humidity_kharif"),
        *agronomic_columns("k", "kharif", "cur_"),
    )
    usable = (F.col("kharif_days_observed") > 0) & F.col("rain_scale").isNotNull()
    names = [f"cur_{c}_kharif" for c in ("gdd", "max_dry_streak", "rainfall_cv", "water_balance")]
    out = out.withColumns({c: F.when(usable, F.col(c)) for c in names})
    everyone = (daily if sites is None else sites).select(*keys).distinct()
    filled = everyone.join(out, keys, "left")
    return filled.withColumn("kharif_days_observed", F.coalesce("kharif_days_observed", F.lit(0)))
