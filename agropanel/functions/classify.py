"""Rule-based labels. Thresholds are strict; a comparison with null does not fire a rule."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from agropanel.functions.scalars import _col, signed_whole, two_decimals, zscore

# Label vocabularies, most urgent first.
ALERT_LEVELS = ("urgent", "watch", "new", "elevated_stable", "minor_change", "stable", "baseline")
RISK_LEVELS = ("high", "moderate", "low", "insufficient_data")
FEED_LEVELS = ("urgent", "watch", "new", "elevated_stable", "stable")
DRIFT_LEVELS = ("normal", "mild_drift", "moderate_drift", "severe_drift")


def _fires(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def dry_flag(rai) -> Column:
    return _fires(_col(rai) < -1.0).cast("int")


def wet_flag(rai) -> Column:
    return _fires(_col(rai) > 1.0).cast("int")


@dataclass(frozen=True)
class ChangeThresholds:
    """Limits of the change classifier; yields in kg/ha, severities in standard deviations."""

    same_yield: float = 5.0
    same_severity: float = 0.05
    elevated_severity: float = 1.2
    watch_yield: float = 150.0
    urgent_yield: float = 300.0
    watch_severity: float = 0.3
    extreme_severity: float = 2.0


def change_level(
    yield_change="yield_change",
    severity_change="severity_change",
    severity="severity",
    previous_severity="previous_severity",
    limits: ChangeThresholds = ChangeThresholds(),
) -> Column:
    dy, ds, sev = _col(yield_change), _col(severity_change), _col(severity)
    unchanged = (F.abs(dy) < limits.same_yield) & (F.abs(ds) < limits.same_severity)
    rising = _fires(ds > limits.watch_severity)
    worse = rising | _fires(dy < -limits.watch_yield)
    moved = _fires(F.abs(dy) > limits.watch_yield) | _fires(F.abs(ds) > limits.watch_severity)
    urgent = (_fires(F.abs(dy) > limits.urgent_yield) & worse) | (_fires(sev > limits.extreme_severity) & rising)
    return (
        F.when(_col(previous_severity).isNull(), "new")
        .when(unchanged & _fires(sev > limits.elevated_severity), "elevated_stable")
        .when(unchanged, "stable")
        .when(urgent, "urgent")
        .when(moved, "watch")
        .otherwise("minor_change")
    )


def change_note(
    level="alert_level",
    yield_change="yield_change",
    severity_change="severity_change",
    severity="severity",
    previous_severity="previous_severity",
    limits: ChangeThresholds = ChangeThresholds(),
) -> Column:
    """One sentence that explains a change level."""
    lv, dy = _col(level), _col(yield_change)
    amount = F.concat(signed_whole(dy), F.lit(" kg/ha"))
    worse = _fires(_col(severity_change) > limits.watch_severity) | _fires(dy < -limits.watch_yield)
    by_yield = _fires(F.abs(dy) > limits.urgent_yield) & worse
    pair = F.concat(two_decimals(previous_severity), F.lit(" -> "), two_decimals(severity))
    return (
        F.when(lv == "baseline", "First snapshot, nothing to compare with.")
        .when(lv == "new", "Site added since the last snapshot.")
        .when(lv == "stable", "No notable change since the last snapshot.")
        .when(lv == "elevated_stable", F.concat(F.lit("Unchanged; severity still high at "), two_decimals(severity)))
        .when((lv == "urgent") & by_yield, F.concat(F.lit("Forecast moved "), amount, F.lit(" and is worsening.")))
        .when(lv == "urgent", F.concat(F.lit("Rainfall severity rising: "), pair))
        .when((lv == "watch") & _fires(dy > 0), F.concat(F.lit("Forecast improved "), amount))
        .when(lv == "watch", F.concat(F.lit("Forecast declined "), amount))
        .otherwise(F.concat(F.lit("Small change, "), amount, F.lit(", below the alert limit.")))
    )


def season_risk(z, mean, std, n_years, min_years: int = 3) -> Column:
    """Risk of a dry season from the standardised season-to-date rainfall."""
    zz, m, s, n = _col(z), _col(mean), _col(std), _col(n_years)
    unusable = zz.isNull() | m.isNull() | s.isNull() | (s == 0) | n.isNull() | (n < min_years)
    return F.when(unusable, "insufficient_data").when(zz < -1.2, "high").when(zz < -0.5, "moderate").otherwise("low")


def season_risk_note(total, mean, n_years, label, lag_days, min_years: int = 3) -> Column:
    known = _col(mean).isNotNull() & (_col(n_years) >= min_years)
    text = F.concat_ws(
        "",
        F.format_string("%.0f", F.bround(_col(total), 0)),
        F.lit(" mm so far ("),
        _col(label),
        F.lit("), usual "),
        F.format_string("%.0f", F.bround(_col(mean), 0)),
        F.lit(" mm over "),
        _col(n_years).cast("string"),
        F.lit(" earlier years; data "),
        _col(lag_days).cast("string"),
        F.lit(" days old."),
    )
    return F.when(known, text).otherwise(F.format_string(f"Fewer than {min_years} earlier years to compare with."))


def drift_severity(x, mean, std, p05, p95) -> Column:
    """0 normal to 3 severe, from the distance to the training mean and the 5-95 % range."""
    v = _col(x)
    distance = F.abs(zscore(v, mean, std))
    outside = _fires(v < _col(p05)) | _fires(v > _col(p95))
    grade = F.when(_fires(distance > 3), 3).when(_fires(distance > 2) | outside, 2).when(_fires(distance > 1.5), 1)
    return F.when(_col(std) == 0, 0).otherwise(grade.otherwise(0))


def drift_status(severity) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in DRIFT_LEVELS]), _col(severity) + 1)


def is_drifted(x, mean, std, limit: float = 2.0) -> Column:
    return _fires(F.abs(zscore(x, mean, std)) > limit)


def vote_label(n_drifted, threshold: int = 3) -> Column:
    n = _col(n_drifted)
    return F.when(n >= threshold, "significant_drift").when(n >= 1, "mild_drift").otherwise("normal")


def completeness_label(share) -> Column:
    s = _col(share)
    return F.when(s > 0.9, "OK").when(s > 0.5, "WARN").otherwise("FAIL")


def alert_type(drought, flood) -> Column:
    return F.when(_fires(_col(drought) == 1), "drought").when(_fires(_col(flood) == 1), "flood").otherwise("general")


def map_bucket(drought, flood, value, low: float = 2500.0, high: float = 3500.0) -> Column:
    v = _col(value)
    return (
        F.when(_fires(_col(drought) == 1), "drought")
        .when(_fires(_col(flood) == 1), "flood")
        .when(v < low, "low")
        .when(v < high, "mid")
        .otherwise("high")
    )


def change_bucket(drought, flood, change) -> Column:
    return (
        F.when(_fires(_col(drought) == 1), "drought")
        .when(_fires(_col(flood) == 1), "flood")
        .when(_fires(_col(change) > 0), "higher")
        .otherwise("lower")
    )


def advisories(
    drought, flood, lower, upper, point, gap_vs_state, wide_percent: float = 28.0, low_gap: float = -400.0
) -> Column:
    """Array of (level, title) entries; a row without any finding gets one normal entry."""
    p, gap = _col(point), _col(gap_vs_state)
    width = F.when(p > 0, F.try_divide((_col(upper) - _col(lower)) * 100.0, p)).otherwise(0.0)

    def entry(level, title):
        return F.struct(F.lit(level).alias("level"), F.lit(title).alias("title"))

    rules = [
        (_fires(_col(drought) == 1), entry("alert", "Drought conditions")),
        (_fires(_col(flood) == 1), entry("alert", "Excess rainfall")),
        (_fires(width > wide_percent), entry("caution", "Wide forecast range")),
        (_fires(gap < low_gap), entry("caution", "Below state average")),
    ]
    fired = F.filter(F.array(*[F.when(c, e) for c, e in rules]), lambda e: e.isNotNull())
    return F.when(F.size(fired) > 0, fired).otherwise(F.array(entry("normal", "No findings")))


def gap_percent(point, gap_vs_state) -> Column:
    """How far a forecast lies from the average of its state, in percent of that average; 0 where the forecast is not positive."""
    p, gap = _col(point), _col(gap_vs_state)
    return F.when(p > 0, F.try_divide(F.abs(gap), p - gap) * 100).otherwise(0.0)


def advisory_text(title, site, state, point, gap_vs_state) -> Column:
    """A sentence for each title of `advisories`; null for a title that is not listed."""
    t, where = _col(title), _col(site)
    share = F.bround(gap_percent(point, gap_vs_state), 0).cast("long").cast("string")
    below = F.concat(
        where, F.lit(" is forecast "), F.format_number(F.abs(_col(gap_vs_state)), 0), F.lit(" kg/ha ("), share, F.lit("%) below the average of "),
        _col(state), F.lit("."))
    return (
        F.when(t == "Drought conditions", F.concat(where, F.lit(" has had far less rain than usual this season; plan for water shortage.")))
        .when(t == "Excess rainfall", F.concat(where, F.lit(" has had far more rain than usual this season; check low fields for damage.")))
        .when(t == "Wide forecast range", F.concat(F.lit("The forecast of "), where, F.lit(" is uncertain; check it in the field before use.")))
        .when(t == "Below state average", below)
        .when(t == "No findings", F.concat(where, F.lit(" shows nothing unusual this season.")))
    )


def departure_verdict(departure, official, n_dry, tolerance: float = -15.0) -> Column:
    """Compares a computed rainfall departure with an official one."""
    d, o = _col(departure), _col(official)
    same_side = F.when(o.isNull(), "not found").when((d < 0) == (o < 0), "OK").otherwise("WRONG")
    plausible = (o >= tolerance) | (_col(n_dry) > 0)
    flags = F.when(o.isNull(), "not found").when(plausible, "plausible").otherwise("suspicious")
    return F.struct(same_side.alias("direction"), flags.alias("dry_flags"))


def rank_of(level, levels) -> Column:
    """Position of a label in its vocabulary; null if it is not listed."""
    out = F.lit(None).cast("int")
    for i, name in enumerate(levels):
        out = F.when(_col(level) == name, F.lit(i)).otherwise(out)
    return out
