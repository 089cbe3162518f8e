"""Registered queries on what comes in and what guards it: raw records, registers, reports, request days and verdicts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from agropanel import schema as sc
from agropanel.functions import classify as K
from agropanel.functions import scalars as f
from agropanel.functions import seasons as S
from agropanel.lineage import folder
from agropanel.operators import gate, panel
from agropanel.plans import oracle as o
from agropanel.plans import serving_queries as serving
from agropanel.plans import views
from agropanel.plans.quality_queries import _LINES, finding_lines
from agropanel.plans.registry import register, tidy
from agropanel.sources import fixtures as fx
from agropanel.sources import readers

# Headings of a raw record file and the columns they become
HEADINGS = {"State Name": "state", "Dist. Name": "district", "Crop": "crop", "Season (text)": "season", "Year": "year", "Yield (Kg per ha)": "yield_kg_ha"}
_USUAL = {"BUILDING": "Kharif", "MACHINERY": "Rabi"}


def _place(spark, name: str) -> str:
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


@register(
    "raw_records",
    o.query(
        o.YIELD,
        f"""SELECT state, district, crop, year::INTEGER AS year, {o.num('yield_kg_ha')},
        CASE WHEN custkey % 3 = 0 THEN 'Rabi' WHEN crop = 'BUILDING' THEN 'Kharif' WHEN crop = 'MACHINERY' THEN 'Rabi' END AS season
        FROM yield_panel""",
    ),
)
def raw_records(spark, sf_dir):
    """One folder of records per crop, read as one table: headings renamed, columns required, seasons trimmed or inferred."""
    path = _place(spark, "raw")
    key = F.col("custkey") % 3
    season = F.when(key == 0, "Rabi  ").when(key == 1, "  ")
    rows = fx.yield_panel(spark, sf_dir).withColumn("season", season)
    named = rows.select(F.col("crop").alias("part"), *[F.col(c).cast("string").alias(heading) for heading, c in HEADINGS.items()])
    named.write.partitionBy("part").option("header", True).option("ignoreTrailingWhiteSpace", False).option("ignoreLeadingWhiteSpace", False).csv(path)
    raw = spark.read.schema(", ".join(f"`{h}` string" for h in HEADINGS)).option("header", True).csv(f"{path}/part=*")
    table = panel.require_columns(panel.select_renamed(raw, HEADINGS), HEADINGS.values())
    return tidy(table.select(
        "state", "district", "crop", F.col("year").cast("int").alias("year"), F.col("yield_kg_ha").cast("double").alias("yield_kg_ha"),
        f.season_or_default("season", "crop", _USUAL).alias("season")))


@register(
    "override_register",
    "SELECT n_name AS check_id, 'seen by ' || n_regionkey AS reason, CASE WHEN n_nationkey % 2 = 0 THEN 'file ' || n_nationkey END AS evidence, "
    "DATE '2026-01-01' + n_nationkey AS expires FROM nation",
)
def override_register(spark, sf_dir):
    """A register written as one JSON object keyed by check, read as rows; absent entries are null."""
    path = _place(spark, "register")
    entry = F.struct(
        F.concat(F.lit("seen by "), F.col("n_regionkey").cast("string")).alias("reason"),
        F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("file "), F.col("n_nationkey").cast("string"))).alias("evidence"),
        F.date_add(F.lit("2026-01-01").cast("date"), F.col("n_nationkey")).alias("expires"))
    # nations are a fixed dimension, as a register is a hand-written file
    whole = fx.table(spark, sf_dir, "nation").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("n_name", entry)))).alias("value"))
    whole.write.text(path)
    return readers.read_overrides(spark, path).select("check_id", "reason", "evidence", "expires")


@register("report_files", o.query(_LINES, "SELECT seq, check_name AS \"check\", status, detail, (SELECT count(*) FROM lines WHERE status = 'fail')::BIGINT AS failures FROM lines"))
def report_files(spark, sf_dir):
    """A gate's findings as JSON lines and its summary beside them, both read back."""
    path = _place(spark, "report")
    gate.write_report(finding_lines(spark, sf_dir), path, "2026-01-01")
    found = spark.read.schema(sc.FINDINGS).json(f"{path}/findings")
    summary = spark.read.schema("failures long").json(f"{path}/summary")
    return found.select("seq", "check", "status", "detail").withColumn("failures", summary.select("failures").scalar())


@register(
    "request_window",
    """SELECT s_name AS district, max(CAST(l_shipdate AS DATE)) + 1 AS first_day, DATE '2002-01-10' - 3 AS last_day,
      greatest(DATE '2002-01-10' - 3 - max(CAST(l_shipdate AS DATE)), 0)::INTEGER AS days
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_suppkey, s_name""",
)
def request_window(spark, sf_dir):
    """The days to request for every site: from the day after its last one to the last day that a delayed source has."""
    last = fx.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.max(F.col("l_shipdate").cast("date")).alias("last"))
    end = S.request_end(F.lit("2002-01-10").cast("date"))
    rows = last.join(fx.table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("district")), "s_suppkey")
    return rows.select("district", F.date_add("last", 1).alias("first_day"), end.alias("last_day"), F.greatest(F.datediff(end, "last"), F.lit(0)).alias("days"))


@register(
    "official_departure",
    o.query(
        o.YIELD + """,
    sites AS (
      SELECT state, district, avg(yield_kg_ha) FILTER (WHERE year = 2000) AS now, avg(yield_kg_ha) FILTER (WHERE year < 2000) AS normal
      FROM yield_panel GROUP BY ALL),
    states AS (
      SELECT state, (avg(now) - avg(normal)) / avg(normal) * 100 AS departure, count(*) FILTER (WHERE now < normal * 0.75) AS n_dry FROM sites GROUP BY state),
    official AS (
      SELECT n_name AS state, (avg(o_totalprice) FILTER (WHERE year(o_orderdate) = 2000) / avg(o_totalprice) FILTER (WHERE year(o_orderdate) < 2000) - 1) * 100 AS official
      FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey % 5 <> 0 GROUP BY n_name)""",
        f"""SELECT state, {o.nums('departure', 'official')}, n_dry::BIGINT AS n_dry,
        CASE WHEN official IS NULL THEN 'not found' WHEN (departure < 0) = (official < 0) THEN 'OK' ELSE 'WRONG' END AS direction,
        CASE WHEN official IS NULL THEN 'not found' WHEN official >= -15 OR n_dry > 0 THEN 'plausible' ELSE 'suspicious' END AS dry_flags
        FROM states LEFT JOIN official USING (state) WHERE departure IS NOT NULL""",
    ),
)
def official_departure(spark, sf_dir):
    """Each state's departure from normal, from its sites, held against a figure made otherwise; some states have none."""
    site = ["state", "district"]
    y, value = F.col("year"), F.col("yield_kg_ha")
    sites = fx.yield_panel(spark, sf_dir).groupBy(*site).agg(F.avg(F.when(y == 2000, value)).alias("now"), F.avg(F.when(y < 2000, value)).alias("normal"))
    states = sites.groupBy("state").agg(
        F.avg("now").alias("now"), F.avg("normal").alias("normal"), F.count_if(F.col("now") < F.col("normal") * 0.75).alias("n_dry"))
    states = states.select("state", ((F.col("now") - F.col("normal")) / F.col("normal") * 100).alias("departure"), "n_dry")
    price, ordered = F.col("o_totalprice"), F.year("o_orderdate")
    nations = fx.table(spark, sf_dir, "nation").where(F.col("n_nationkey") % 5 != 0)
    told = fx.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        *[F.sum(F.when(c, price)).alias(f"s{i}") for i, c in enumerate((ordered == 2000, ordered < 2000))],
        *[F.count_if(c).alias(f"n{i}") for i, c in enumerate((ordered == 2000, ordered < 2000))])
    told = told.join(fx.table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey")), "c_custkey")
    told = told.groupBy("n_nationkey").agg(*[F.sum(c).alias(c) for c in ("s0", "s1", "n0", "n1")]).join(nations, "n_nationkey")
    share = F.try_divide(F.col("s0"), F.col("n0")) / F.try_divide(F.col("s1"), F.col("n1"))
    official = told.select(F.col("n_name").alias("state"), ((share - 1) * 100).alias("official"))
    verdict = K.departure_verdict("departure", "official", "n_dry")
    both = states.join(official, "state", "left").where("departure is not null").withColumn("_v", verdict)
    return tidy(both.select("state", "departure", "official", "n_dry", "_v.direction", "_v.dry_flags"))


@register(
    "feature_admission",
    o.query(
        o.YIELD + "," + o.COVARIATES,
        f"""SELECT (count(fertilizer_tons) >= 0.7 * count(*))::INTEGER AS wide, (count(CASE WHEN year % 2 = 0 THEN fertilizer_tons END) >= 0.7 * count(*))::INTEGER AS narrow,
        {o.num('avg((fertilizer_tons IS NOT NULL)::INTEGER)', 4, 'share')} FROM yield_panel LEFT JOIN covariates USING (state, district, year)""",
    ),
)
def feature_admission(spark, sf_dir):
    """Whether a groundwater column enters the contract: one that most rows have does, one of every second year does not."""
    joined = fx.yield_panel(spark, sf_dir).join(fx.covariates(spark, sf_dir), ["state", "district", "year"], "left")
    wells = panel.OPTIONAL_FEATURES["groundwater"]
    wide = joined.withColumns({c: F.col("fertilizer_tons") for c in wells})
    narrow = wide.withColumns({c: F.when(F.col("year") % 2 == 0, F.col(c)) for c in wells})
    entered = {name: int(set(wells) <= set(panel.admitted_features(rows))) for name, rows in (("wide", wide), ("narrow", narrow))}
    share = joined.agg(F.avg(F.col("fertilizer_tons").isNotNull().cast("int")).alias("share"))
    return tidy(share.select(*[F.lit(v).alias(k) for k, v in entered.items()], "share"))


_TOLD = {
    "Drought conditions": "district || ' has had far less rain than usual this season; plan for water shortage.'",
    "Excess rainfall": "district || ' has had far more rain than usual this season; check low fields for damage.'",
    "Wide forecast range": "'The forecast of ' || district || ' is uncertain; check it in the field before use.'",
    "Below state average": "district || ' is forecast ' || format('{:,.0f}', abs(gap)) || ' kg/ha (' || "
    "round_even(abs(gap) / (pred_yield - gap) * 100, 0)::BIGINT || '%) below the average of ' || state || '.'",
    "No findings": "district || ' shows nothing unusual this season.'",
}
_ALL_ENTRIES = [*serving._ENTRIES, (" AND ".join(f"NOT ({c})" for c, _, _ in serving._ENTRIES), "normal", "No findings")]


@register(
    "advisory_texts",
    o.query(
        serving._ADVICE,
        " UNION ALL ".join(
            f"SELECT district, crop, year::INTEGER AS year, '{level}' AS level, '{title}' AS title, {_TOLD[title]} AS text FROM advised WHERE {c}"
            for c, level, title in _ALL_ENTRIES
        ),
    ),
)
def advisory_texts(spark, sf_dir):
    """Every advisory entry with its sentence; one below the average of its state tells by how much and by what share."""
    return views.advisory_lines(serving.advised_rows(spark, sf_dir)).select("district", "crop", "year", "level", "title", "text")
