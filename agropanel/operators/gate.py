"""Checks on outputs before they are served. Each check yields finding rows; the verdict decides promotion."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agropanel import schema as sc
from agropanel.functions import classify as K
from agropanel.operators.drift import extreme_share


def _finding(check: str, status, detail) -> list[Column]:
    """Columns of a finding; the detail is given as a column or plain text."""
    as_col = lambda v: F.lit(v) if isinstance(v, str) else v
    return [
        F.lit(check).alias("check"), as_col(status).alias("status"), as_col(detail).alias("detail"),
        F.lit(None).cast("string").alias("override_ref"),
    ]


def findings(spark: SparkSession, rows: Sequence[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(
        [(c, s, d, None) for c, s, d in rows], "check string, status string, detail string, override_ref string"
    )


def combine(parts: Sequence[DataFrame]) -> DataFrame:
    """Findings of several checks in order; `seq` keeps the order of the checks."""
    out = None
    for i, part in enumerate(parts):
        tagged = part.withColumn("seq", F.lit(i)).select(*sc.FINDINGS.fieldNames())
        out = tagged if out is None else out.unionByName(tagged)
    return out


def schema_consistency(spark: SparkSession, models: Mapping[str, Sequence[str] | None], contract: Sequence[str]) -> DataFrame:
    """Feature list of each model against the contract: equal in names and order, or a failure."""
    rows = []
    for name, features in models.items():
        if features is None:
            rows.append(("schema_consistency", "warn", f"{name}: feature list unknown"))
        elif list(features) == list(contract):
            rows.append(("schema_consistency", "pass", f"{name}: {len(contract)} features match"))
        else:
            missing, extra = sorted(set(contract) - set(features)), sorted(set(features) - set(contract))
            detail = f"missing {missing}, extra {extra}" if missing or extra else "same features in another order"
            rows.append(("schema_consistency", "fail", f"{name}: {detail}"))
    return findings(spark, rows)


def concentration(df: DataFrame, level: str, measure: str | None = None) -> DataFrame:
    """One row: the most frequent level, its share, and how a measure spreads overall and inside that level.

    Levels and total come out of one rollup, so the table is read once, and a level that holds nearly all rows is
    still aggregated in parallel.
    """
    x = F.col(measure).cast("double") if measure else F.lit(None).cast("double")
    rolled = (
        df.select(F.col(level).alias("level"), x.alias("x"))
        .rollup("level")
        .agg(
            F.grouping("level").alias("all"), F.count(F.lit(1)).alias("n"), F.count("level").alias("labelled"),
            F.stddev_samp("x").alias("std"), (F.max("x") - F.min("x")).alias("range"),
            F.avg(F.abs("x")).alias("mean_abs"), F.kurtosis("x").alias("kurtosis"),
        )
    )
    total = F.col("all") == 1
    labelled = ~total & F.col("level").isNotNull()
    one = rolled.agg(
        *[F.max(F.when(total, F.col(c))).alias(c) for c in ("n", "labelled", "std", "range", "mean_abs", "kurtosis")],
        F.max_by(F.struct("level", "n", "std", "range"), F.when(labelled, F.struct("n", "level"))).alias("top"),
    )
    return one.select(
        F.coalesce("n", F.lit(0)).alias("n_rows"),
        F.col("top.level").alias("top_level"),
        F.try_divide(F.col("top.n"), F.col("labelled")).alias("top_share"),
        F.col("std").alias("measure_std"), F.col("range").alias("measure_range"),
        F.col("mean_abs").alias("measure_mean_abs"), F.col("kurtosis").alias("measure_kurtosis"),
        F.col("top.std").alias("top_std"), F.col("top.range").alias("top_range"),
    )


def diversity_verdict(
    max_share: float = 0.85, min_rows: int = 10, low_std: float = 20.0, low_range: float = 100.0,
    version_shift: float = 150.0, version_kurtosis: float = 1.0, has_measure: bool = True,
) -> Column:
    """Why a nearly uniform classification is acceptable, or that it is not."""
    plausible = (F.col("top_share") <= max_share) | (F.col("n_rows") <= min_rows)
    verdict = F.when(plausible, "plausible").when(F.col("top_level") == "baseline", "first_snapshot")
    if not has_measure:
        return verdict.otherwise("concentrated")
    flat = (F.col("measure_std") < low_std) & (F.col("measure_range") < low_range)
    shifted = (
        (F.col("top_level") == "minor_change") & (F.col("measure_mean_abs") < version_shift)
        & (F.col("measure_kurtosis") > version_kurtosis)
    )
    uniform_top = (F.col("top_std") < low_std) & (F.col("top_range") < low_range)
    return (
        verdict.when(flat, "low_variance").when(shifted, "model_version_change").when(uniform_top, "homogeneous_top")
        .otherwise("hidden_variance")
    )


def diversity(df: DataFrame, level: str, label: str, measure: str | None = None) -> DataFrame:
    """Classification diversity as a finding."""
    row = concentration(df, level, measure).withColumn("verdict", diversity_verdict(has_measure=measure is not None))
    status = (
        F.when(F.col("verdict").isin("concentrated", "hidden_variance"), "fail")
        .when(F.col("verdict") == "model_version_change", "warn").otherwise("pass")
    )
    share = F.format_string("%.0f%%", F.bround(F.col("top_share") * 100, 0))
    detail = F.concat_ws(" ", F.lit(f"{label}:"), F.col("verdict"), F.coalesce(share, F.lit("-")), F.col("top_level"))
    return row.select(*_finding("classification_diversity", status, detail))


def feature_ranges(history: DataFrame, live: DataFrame, features: Sequence[str], max_share: float = 0.5) -> DataFrame:
    """A feature fails if most live sites lie far outside the pooled history at once."""
    shares = extreme_share(history, live, features)
    status = F.when(F.col("extreme_share") > max_share, "fail").otherwise("pass")
    percent = F.format_string("%.0f%%", F.bround(F.col("extreme_share") * 100, 0))
    return shares.select(*_finding("feature_ranges", status, F.concat_ws(" ", "feature", percent)))


def outputs_present(spark: SparkSession, tables: Mapping[str, DataFrame | None]) -> DataFrame:
    rows = []
    for name, df in tables.items():
        if df is None:
            rows.append(("output_files_present", "fail", f"missing: {name}"))
        elif df.isEmpty():
            rows.append(("output_files_present", "fail", f"empty: {name}"))
        else:
            rows.append(("output_files_present", "pass", f"present: {name}"))
    return findings(spark, rows)


MOST_NAMED = 1000  # two characters or more each, in a detail of at most 2,000


def fetch_completeness(ledger: DataFrame) -> DataFrame:
    """Any site in the failure ledger is a failure. The detail counts them and names the first by name; the ledger has all.

    As many are gathered as a report's detail can hold, however many sites failed.
    """
    n = ledger.agg(F.count(F.lit(1)).alias("n"))
    first = ledger.select(F.concat_ws("/", "state", "district").alias("site")).orderBy("site").limit(MOST_NAMED)
    names = first.agg(F.array_join(F.sort_array(F.collect_list("site")), ", ")).scalar()
    status = F.when(F.col("n") > 0, "fail").otherwise("pass")
    detail = F.when(F.col("n") > 0, F.concat_ws(" ", F.col("n").cast("string"), F.lit("sites without rows:"), names))
    return n.select(*_finding("weather_fetch_completeness", status, detail.otherwise("all sites landed")))


def plausible_values(df: DataFrame, column: str, low: float = 1000.0, high: float = 7000.0) -> DataFrame:
    """No missing value and none outside the bounds."""
    bad = F.count_if(F.col(column).isNull() | ~F.col(column).between(low, high))
    row = df.agg(bad.alias("n"), F.count(F.lit(1)).alias("rows"))
    status = F.when(F.col("n") > 0, "fail").otherwise("pass")
    return row.select(
        *_finding("plausible_values", status, F.concat_ws(" ", F.lit(column), F.col("n").cast("string"), F.lit("outside")))
    )


def freshness(report_at, newest_input_at, as_of=None, data_as_of=None, max_days: int = 7) -> list[Column]:
    """Whether a report is newer than its inputs, and whether the data are too old."""
    fresh = (report_at >= newest_input_at).alias("report_is_fresh")
    return [fresh] if as_of is None else [fresh, (F.datediff(as_of, data_as_of) > max_days).alias("data_is_stale")]


def require_fresh(report_at, newest_input_at) -> None:
    if report_at < newest_input_at:
        raise RuntimeError("the gate report is older than its inputs; run the gate again")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Number of repeated keys in one row."""
    repeated = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    return repeated.agg(F.count(F.lit(1)).alias("n_keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"))


def require_matched(df: DataFrame, expected: int, keys: Sequence[str], source: str = "table") -> DataFrame:
    """Refuses a table with lost rows or repeated keys. Only counts reach the driver."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    n, worst = per_key.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    if n != expected:
        raise RuntimeError(f"{source}: {n} of {expected} rows matched a known site")
    if worst > 1:
        raise RuntimeError(f"{source}: duplicate keys")
    return df


def unresolved_share(df: DataFrame, column: str, max_share: float = 0.1) -> DataFrame:
    row = df.agg(F.avg(F.col(column).isNull().cast("int")).alias("share"))
    return row.withColumn("passed", F.coalesce(F.col("share") <= max_share, F.lit(True)))


def apply_overrides(found: DataFrame, overrides: DataFrame, as_of, check_id: Column | None = None) -> DataFrame:
    """A failure with a running override becomes 'overridden'; an expired one is named in the detail and still fails.

    The register is a hand-written file of a few entries.
    """
    date = F.lit(as_of).cast("date") if isinstance(as_of, str) else as_of
    keyed = found.withColumn("_id", F.col("check") if check_id is None else check_id)
    register = overrides.select(F.col("check_id").alias("_id"), "reason", "expires")
    joined = keyed.join(register, "_id", "left")
    failing = F.col("status") == "fail"
    running = failing & F.coalesce(F.col("expires") >= date, F.lit(False))
    expired = failing & F.coalesce(F.col("expires") < date, F.lit(False))
    ref = F.concat(F.col("_id"), F.lit(" (expires "), F.col("expires").cast("string"), F.lit(")"))
    return joined.select(
        *[c for c in found.columns if c not in ("status", "detail", "override_ref")],
        F.when(running, "overridden").otherwise(F.col("status")).alias("status"),
        F.when(running, F.concat_ws(" | ", "detail", F.concat(F.lit("overridden: "), "reason")))
        .when(expired, F.concat_ws(" | ", "detail", F.concat(F.lit("override expired "), F.col("expires").cast("string"))))
        .otherwise(F.col("detail")).alias("detail"),
        F.when(running, ref).otherwise(F.col("override_ref")).alias("override_ref"),
    )


def rollup(found: DataFrame, max_detail: int = 2000) -> DataFrame:
    """One row per check: fail over overridden over pass, joined details and references, in order of appearance.

    Findings are one row per check line (tens of rows per run), so collecting them per check is bounded.
    """
    line = F.struct("seq", "detail", "override_ref", (F.col("status") != "pass").alias("notable"))
    grouped = found.groupBy("check").agg(
        F.bool_or(F.col("status") == "fail").alias("failed"),
        F.bool_or(F.col("status") == "overridden").alias("overridden"),
        F.min("seq").alias("seq"),
        F.sort_array(F.collect_list(line)).alias("lines"),
    )
    notable = F.filter("lines", lambda e: e["notable"])
    chosen = F.when(F.size(notable) > 0, notable).otherwise(F.col("lines"))
    refs = F.filter(F.transform("lines", lambda e: e["override_ref"]), lambda r: F.coalesce(r != "", F.lit(False)))
    detail = F.array_join(F.transform(chosen, lambda e: e["detail"]), " | ")
    return grouped.select(
        "seq",
        F.col("check").alias("check_name"),
        F.when(F.col("failed"), "fail").when(F.col("overridden"), "overridden").otherwise("pass").alias("status"),
        F.substring(detail, 1, max_detail).alias("detail"),
        F.nullif(F.array_join(refs, "; "), F.lit("")).alias("override_ref"),
    )


def report(found: DataFrame) -> DataFrame:
    """Summary row of a gate run: it passes if nothing failed."""
    return found.agg(
        F.coalesce(F.bool_and(F.col("status") != "fail"), F.lit(True)).alias("passed"),
        F.count_if(F.col("status") == "fail").alias("failures"),
        F.count_if(F.col("status").isin("warn", "overridden")).alias("warnings"),
        F.count(F.lit(1)).alias("n_findings"),
    )


def write_report(found: DataFrame, path: str, generated_at: str) -> None:
    """Findings as JSON lines and the summary row beside them."""
    found.write.mode("overwrite").json(f"{path}/findings")
    report(found).withColumn("generated_at", F.lit(generated_at)).write.mode("overwrite").json(f"{path}/summary")
