"""Rainfall anomaly against a site's own history, season-to-date risk, and scale alignment of a live source."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agropanel.functions import classify as K
from agropanel.functions import seasons as S
from agropanel.functions.scalars import zscore
from agropanel.lineage import cut

SITE = ("state", "district")


def site_baseline(
    seasonal: DataFrame, measure: str, keys: Sequence[str] = SITE, mean: str = "hist_mean", std: str = "hist_std"
) -> DataFrame:
    """Long-term mean and sample deviation of one seasonal measure per site."""
    return seasonal.groupBy(*keys).agg(F.avg(measure).alias(mean), F.stddev_samp(measure).alias(std))


def with_baseline(
    seasonal: DataFrame,
    measure: str,
    keys: Sequence[str] = SITE,
    mean: str = "mean_rainfall",
    std: str = "std_rainfall",
    complete_only: Column | None = None,
) -> DataFrame:
    """The same statistics on every site-year row; a site has one row per year, so the window stays small."""
    w = Window.partitionBy(*keys)
    x = F.col(measure) if complete_only is None else F.when(complete_only, F.col(measure))
    return seasonal.withColumn(mean, F.avg(x).over(w)).withColumn(std, F.stddev_samp(x).over(w))


def with_rai(
    df: DataFrame, measure: str, mean: str = "mean_rainfall", std: str = "std_rainfall",
    name: str = "rainfall_anomaly_index", dry: str = "drought_flag", wet: str = "flood_flag",
) -> DataFrame:
    """Anomaly index and its two flags; a null index raises neither flag."""
    return (
        df.withColumn(name, zscore(measure, mean, std))
        .withColumn(dry, K.dry_flag(name))
        .withColumn(wet, K.wet_flag(name))
    )


def rai_history(seasonal: DataFrame, keys: Sequence[str] = SITE, measure: str = "nasa_rainfall_annual") -> DataFrame:
    return with_rai(with_baseline(seasonal, measure, keys), measure)


def live_rai(
    live: DataFrame, history: DataFrame, live_measure: str, history_measure: str, keys: Sequence[str] = SITE,
    name: str = "current_rai", dry: str = "current_drought_flag", wet: str = "current_flood_flag",
) -> DataFrame:
    """Anomaly of a live season against the history of the same season."""
    joined = live.join(site_baseline(history, history_measure, keys), list(keys), "left")
    return with_rai(joined, live_measure, "hist_mean", "hist_std", name, dry, wet)


def baseline_with_fallback(live: DataFrame, history: DataFrame, measure: str) -> DataFrame:
    """Baseline by (state, district); where the state is spelled differently, by district alone."""
    exact = site_baseline(history, measure, SITE)
    coarse = site_baseline(history, measure, ("district",), "_mean_d", "_std_d")
    joined = live.join(exact, list(SITE), "left").join(coarse, "district", "left")
    return (
        joined.withColumn("hist_mean", F.coalesce("hist_mean", "_mean_d"))
        .withColumn("hist_std", F.coalesce("hist_std", "_std_d"))
        .drop("_mean_d", "_std_d")
    )


def season_to_date(
    daily: DataFrame,
    live_year: int,
    first_year: int,
    keys: Sequence[str] = SITE,
    min_years: int = 3,
    month: int = 6,
    as_of: str | None = None,
) -> DataFrame:
    """Season-to-date rainfall against the same calendar window of earlier years, with a risk level.

    Live year and history share one grouping by (site, year), so the daily rows are shuffled once and no join is
    needed. The window end is the last live day with a value, found by a scalar subquery.
    """
    keys = list(keys)
    seen = F.col("rainfall_mm").isNotNull()
    day = S.season_day("date", month)
    in_live = S.between_days("date", f"{live_year}-{month:02d}-01", f"{live_year}-12-31")
    last = daily.where(in_live & seen).agg(F.max("date")).scalar()
    in_range = S.between_days("date", f"{first_year}-{month:02d}-01", f"{live_year}-12-31")
    years = daily.where(in_range & (day >= 0))
    years = years.where(day <= S.season_day(last, month, F.lit(live_year)))
    totals = years.groupBy(*keys, F.year("date").alias("_year")).agg(
        F.sum("rainfall_mm").alias("_total"), F.count("rainfall_mm").alias("_days")
    )
    live, past = F.col("_year") == live_year, F.col("_year") < live_year
    stats = totals.groupBy(*keys).agg(
        F.max(F.when(live, F.col("_total"))).alias("actual_partial_rainfall_mm"),
        F.max(F.when(live, F.col("_days"))).alias("days_elapsed"),
        F.avg(F.when(past, F.col("_total"))).alias("window_hist_mean"),
        F.stddev_samp(F.when(past, F.col("_total"))).alias("window_hist_std"),
        F.count(F.when(past, F.col("_total"))).alias("n_years"),
    )
    z = zscore("actual_partial_rainfall_mm", "window_hist_mean", "window_hist_std")
    out = stats.where(F.col("days_elapsed") > 0).withColumn("kharif_risk_zscore", z)
    level = K.season_risk("kharif_risk_zscore", "window_hist_mean", "window_hist_std", "n_years", min_years)
    out = out.withColumn("kharif_risk_level", level).withColumn("window_end", last)
    today = F.lit(as_of).cast("date") if as_of else last
    note = K.season_risk_note(
        "actual_partial_rainfall_mm", "window_hist_mean", "n_years", S.window_label("window_end"),
        F.datediff(today, F.col("window_end")), min_years,
    )
    return out.withColumn("risk_explanation", note)


def rain_scale(
    daily: DataFrame,
    history: DataFrame,
    first_year: int,
    last_year: int,
    min_days: int = 140,
    min_years: int = 4,
    keys: Sequence[str] = SITE,
) -> DataFrame:
    """Factor that maps live monsoon rainfall onto the historical scale, from complete live seasons only.

    `daily` may also be seasonal rows with kharif_days_known, which spares another pass over the daily rows.
    """
    keys = list(keys)
    if "kharif_days_known" in daily.columns:
        seasons = daily.where(F.col("year").between(first_year, last_year))
        complete = seasons.select(*keys, F.col("nasa_rainfall_kharif").alias("_total"), F.col("kharif_days_known").alias("_days"))
    else:
        in_range = S.between_days("date", f"{first_year}-06-01", f"{last_year}-10-31")
        seasons = daily.where(in_range & S.is_kharif("date"))
        complete = seasons.groupBy(*keys, F.year("date").alias("_year")).agg(
            F.sum("rainfall_mm").alias("_total"), F.count("rainfall_mm").alias("_days")
        )
    complete = complete.where(F.col("_days") >= min_days)
    live = complete.groupBy(*keys).agg(F.avg("_total").alias("live_mean"), F.count("_total").alias("_n"))
    live = live.where(F.col("_n") >= min_years).drop("_n")
    past = history.groupBy(*keys).agg(F.avg("nasa_rainfall_kharif").alias("hist_mean"))
    both = past.join(live, keys).dropna(subset=["hist_mean", "live_mean"])
    return both.withColumn("rain_scale", F.try_divide("hist_mean", "live_mean"))


def live_kharif_rai(live: DataFrame, history: DataFrame, max_missing: float = 0.1) -> DataFrame:
    """Anomaly of the live monsoon season; sites without a baseline are dropped, too many of them is an error."""
    scored = with_rai(
        baseline_with_fallback(live, history, "nasa_rainfall_kharif"),
        "cur_rain_kharif", "hist_mean", "hist_std", "cur_rai", "cur_drought", "cur_flood",
    )
    # one row per site, needed for the share and for the result
    scored = cut(scored)
    share = scored.agg(F.avg(F.col("cur_rai").isNull().cast("int"))).first()[0]
    if share is not None and share > max_missing:
        raise RuntimeError(f"too many sites without a rainfall baseline: {share:.0%}")
    return scored.where(F.col("cur_rai").isNotNull())
