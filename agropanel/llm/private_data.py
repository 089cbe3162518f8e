"""Personal data by bootstrapped contextual extraction, in DataFrame operations only.

Four fixed patterns find the seeds: email, ip, card and phone spans. Every number-like or address-like run of a text, seed
or not, is an instance with lexical patterns: the two words before it, and the words on both sides. Spark scores the graph
of patterns and instances in rounds: a pattern's confidence in a kind is the share of its distinct instances known to be
of that kind, where an unknown one counts half and one of another kind in full; an unknown instance's score is the chance
that not all of its accepted patterns are wrong; instances above the threshold join the known ones of the next round, until
a round finds none. Seeds always stay; the spans of discovered instances are added, and those of seeds that are written
elsewhere in a way that no fixed pattern matches: an address is the same in any case, a number by its digits, an ip address
by its dots too.

Matches are found with their places by splitting a text at them: the lengths of what lies between add up. The expressions
use possessive loops and lookbehinds that leave the matches as they are but keep the search linear in the text.

Defined results: a null text is empty and has no spans; repeated rows keep a row each; places are code points; extra
columns pass through `find` and `mask` (columns that begin with _pii_ are reserved); an empty table gives no rows.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agropanel.llm.common import table, written

KINDS = ("email", "ip", "card", "phone")
MIN_SUPPORT = 5  # distinct known instances that a pattern needs
MIN_CONFIDENCE = 0.9
MIN_SCORE = 0.9
UNKNOWN = 0.5  # weight of an instance of no known kind in a confidence
MIN_DIGITS = 7  # of a number that may be discovered

_LOCAL = "A-Za-z0-9._%+-"
EXPRESSIONS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}",
    # maximal chains of digits: those of other than 12 to 19 digits fail in any case
    "card": r"[0-9](?<![0-9][0-9])(?<![0-9][\x20-][0-9])(?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
INSTANCE = rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]*+@[^\x20\x09-\x0D]++|\+?[0-9][0-9().\x20-]*[0-9]"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_TEXT = "_pii_text"


def _digits(value):
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value):
    digits = F.reverse(_digits(value))
    at = F.sequence(F.lit(1), F.length(digits))

    def weight(i):
        d = F.substring(digits, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).otherwise(F.when(d > 4, d * 2 - 9).otherwise(d * 2))

    return F.aggregate(F.transform(at, weight), F.lit(0), lambda a, b: a + b) % 10 == 0


VALID = {
    "email": lambda value: F.lit(True),
    "ip": lambda value: value.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"),
    "card": _luhn,
    "phone": lambda value: F.length(_digits(value)).between(9, 15),
}
# a text without these characters has no match: a plain search decides before the expression runs
NEEDS = {
    "email": lambda: F.contains(F.col(_TEXT), F.lit("@")),
    "ip": lambda: F.col(_TEXT).rlike(r"[0-9]\.[0-9]"),
    "card": lambda: F.col(_TEXT).rlike(r"[0-9][\x20-]?[0-9]"),
    "phone": lambda: F.contains(F.col(_TEXT), F.lit("+")),
    "instance": lambda: F.contains(F.col(_TEXT), F.lit("@")) | F.col(_TEXT).rlike(r"[0-9][0-9().\x20-]*[0-9]"),
}


def _matches(found, gaps):
    """Array of (start, end, value, at) from the matched values and the text between them."""
    step = F.aggregate(
        F.sequence(F.lit(0), F.size(found) - 1),
        F.struct(F.lit(0).alias("pos"), F.array().cast("array<struct<start:int,end:int,value:string,at:int>>").alias("out")),
        lambda acc, i: F.struct(
            (acc["pos"] + F.length(F.get(gaps, i)) + F.length(F.get(found, i))).alias("pos"),
            F.concat(acc["out"], F.array(F.struct(
                (acc["pos"] + F.length(F.get(gaps, i))).alias("start"),
                (acc["pos"] + F.length(F.get(gaps, i)) + F.length(F.get(found, i))).alias("end"), F.get(found, i).alias("value"), i.alias("at"),
            ))).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    none = F.array().cast("array<struct<start:int,end:int,value:string,at:int>>")
    return F.when(F.size(found) > 0, step).otherwise(none)


def _split(df: DataFrame, name: str, expression: str) -> DataFrame:
    """`df` with _pii_v_NAME, the matches, and _pii_g_NAME, the text before, between and after them."""
    found = F.when(NEEDS[name](), F.regexp_extract_all(_TEXT, F.lit(expression), F.lit(0))).otherwise(F.array().cast("array<string>"))
    df = df.withColumn(f"_pii_v_{name}", found)
    gaps = F.when(F.size(f"_pii_v_{name}") > 0, F.split(_TEXT, expression, -1)).otherwise(F.array().cast("array<string>"))
    return df.withColumn(f"_pii_g_{name}", gaps)


def _valid(matches, number: int):
    """The matches that pass their kind's test, as (start, kind, end)."""
    good = F.filter(matches, lambda m: VALID[KINDS[number]](m["value"]))
    return F.transform(good, lambda m: F.struct(m["start"].alias("start"), F.lit(number).alias("kind"), m["end"].alias("end")))


def _base(df: DataFrame) -> DataFrame:
    """`df` with _pii_base: the seeds as (start, kind, end), by start and then kind, kinds by number."""
    arrays = []
    for number, kind in enumerate(KINDS):
        df = _split(df, kind, EXPRESSIONS[kind])
        matches = _matches(F.col(f"_pii_v_{kind}"), F.col(f"_pii_g_{kind}"))
        arrays.append(_valid(matches, number))
    df = df.withColumn("_pii_base", F.array_sort(F.concat(*arrays)))
    return df.drop(*[f"_pii_{x}_{kind}" for x in "vg" for kind in KINDS])


def _words(text):
    return F.transform(F.split(F.trim(F.regexp_replace(text, r"[\x09-\x0D]", " ")), " +"), lambda w: F.regexp_replace(F.lower(w), "[0-9]", "9"))


def _identity(value, kind):
    """What two spellings of one identifier have in common."""
    digits = F.when(kind == KINDS.index("ip"), F.regexp_replace(value, "[^0-9.]", "")).otherwise(_digits(value))
    return F.when(F.contains(value, F.lit("@")), F.lower(value)).otherwise(digits)


def _instances(df: DataFrame) -> DataFrame:
    """`df` with _pii_seen: every instance as (start, end, value, kind, patterns); kind is that of a seed it overlaps."""
    df = _split(df, "instance", INSTANCE)
    gaps = F.col("_pii_g_instance")

    def instance(m):
        left, right = _words(F.right(F.get(gaps, m["at"]), F.lit(80))), _words(F.left(F.get(gaps, m["at"] + 1), F.lit(40)))
        w1, w2, r1 = F.element_at(left, -1), F.coalesce(F.get(left, F.size(left) - 2), F.lit("")), F.get(right, F.lit(0))
        seeds = F.filter("_pii_base", lambda s: (s["start"] < m["end"]) & (m["start"] < s["end"]))
        kind = F.get(seeds, F.lit(0))["kind"]
        return F.struct(
            m["start"].alias("start"), m["end"].alias("end"), _identity(m["value"], kind).alias("value"), kind.alias("kind"),
            F.array(F.concat_ws(" ", w2, w1, F.lit("_")), F.concat_ws(" ", w1, F.lit("_"), r1)).alias("patterns"),
        )

    matches = _matches(F.col("_pii_v_instance"), gaps)
    likely = F.filter(matches, lambda m: F.contains(m["value"], F.lit("@")) | (F.length(_digits(m["value"])) >= MIN_DIGITS))
    # a run may be longer than the seed in it: the seed itself is known too, and has no patterns of its own
    # (of overlapping seeds the first, whose kind the run has)
    first = F.filter("_pii_base", lambda s: ~F.exists("_pii_base", lambda o: (o["start"] < s["start"]) & (s["start"] < o["end"])))
    own = F.transform(first, lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"),
        _identity(F.substring(F.col(_TEXT), s["start"] + 1, s["end"] - s["start"]), s["kind"]).alias("value"),
        s["kind"].alias("kind"), F.array().cast("array<string>").alias("patterns"),
    ))
    return df.withColumn("_pii_seen", F.concat(F.transform(likely, instance), own)).drop("_pii_v_instance", "_pii_g_instance")


def bootstrap(seen: DataFrame, rounds: int | None = None, support: int = MIN_SUPPORT, confidence: float = MIN_CONFIDENCE,
              score: float = MIN_SCORE, unknown: float = UNKNOWN) -> DataFrame:
    """(value, kind) of the seeds and of the instances discovered from (value, kind or null, patterns) rows.

    The graph holds each pattern and value once, however often they occur, so a value or pattern with a third of all
    occurrences is one partial row per task. Rounds end when nothing is discovered, or after `rounds` of them.
    """
    edges = written(seen.select("value", F.explode("patterns").alias("pattern")).distinct(), "edges")
    known = written(seen.where("kind is not null").groupBy("value").agg(F.min("kind").alias("kind")), "known")
    for _ in itertools.count() if rounds is None else range(rounds):
        state = edges.join(known, "value", "left")
        shares = [F.sum((F.col("kind") == k).cast("long")).alias(f"n{k}") for k in range(len(KINDS))]
        counts = state.groupBy("pattern").agg(F.sum(F.when(F.col("kind").isNull(), unknown).otherwise(1.0)).alias("n"), *shares)
        best = F.greatest(*[F.struct(F.coalesce(f"n{k}", F.lit(0)).alias("n"), F.lit(k).alias("kind")) for k in range(len(KINDS))])
        good = counts.withColumn("best", best).select(
            "pattern", F.col("best.kind").alias("kind"), F.col("best.n").alias("hits"), (F.col("best.n") / F.col("n")).alias("confidence")
        ).where((F.col("hits") >= support) & (F.col("confidence") >= confidence))
        doubt = F.log(1.0 - F.least(F.col("confidence"), F.lit(0.999)))
        unseen = state.where("kind is null").drop("kind").join(good, "pattern")
        scored = unseen.groupBy("value", "kind").agg((1 - F.exp(F.sum(doubt))).alias("score")).where(F.col("score") >= score - 1e-9)
        new = written(scored.groupBy("value").agg(F.max(F.struct("score", (-F.col("kind")).alias("k"))).alias("m")).select("value", (-F.col("m.k")).alias("kind")), "new")
        if new.isEmpty():
            break
        known = written(known.union(new), "known")
    return known


def find(docs: DataFrame, text: str = "text", keep_columns: bool = True, **settings) -> DataFrame:
    """`docs` (or its columns other than the text) with _pii_base and _pii_spans, arrays of (start, kind, end) by start.

    The texts are read once; what is found is written with a row number, and only instances move after that.
    """
    kept = docs.columns if keep_columns else [c for c in docs.columns if c != text]
    rows = _instances(_base(docs.withColumn(_TEXT, F.coalesce(F.col(text), F.lit("")))))
    rows = rows.select(*kept, "_pii_base", "_pii_seen").withColumn("_pii_row", F.monotonically_increasing_id())
    rows = written(rows, "private")
    seen = rows.select("_pii_row", F.explode("_pii_seen").alias("s")).select("_pii_row", "s.*")
    known = bootstrap(seen.select("value", "kind", "patterns"), **settings).withColumnRenamed("kind", "new")
    added = seen.where("kind is null").join(known, "value").select("_pii_row", F.struct("start", F.col("new").alias("kind"), "end").alias("span"))
    # a row's own spans: bounded by its text
    added = added.groupBy("_pii_row").agg(F.collect_list("span").alias("_pii_added"))
    both = rows.drop("_pii_seen").join(added, "_pii_row", "left")
    spans = F.when(F.col("_pii_added").isNull(), F.col("_pii_base")).otherwise(F.array_sort(F.concat("_pii_base", "_pii_added")))
    return both.withColumn("_pii_spans", spans).select(*kept, "_pii_base", "_pii_spans")


def mask(docs: DataFrame, text: str = "text", **settings) -> DataFrame:
    """`docs` with every span of personal data replaced by its kind in angle brackets; overlapping spans become one."""
    found = find(docs, text, **settings)
    span = "struct<start:int,kind:int,end:int>"

    def merge(out, s):
        last = F.element_at(out, -1)
        joined = F.struct(last["start"].alias("start"), last["kind"].alias("kind"), F.greatest(last["end"], s["end"]).alias("end"))
        touches = (F.size(out) > 0) & (F.get(out, F.size(out) - 1)["end"] > s["start"])
        return F.when(touches, F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(joined))).otherwise(F.concat(out, F.array(s)))

    merged = F.aggregate("_pii_spans", F.array().cast(f"array<{span}>"), merge)
    found = found.withColumn("_pii_spans", F.when(F.size("_pii_spans") > 0, merged).otherwise(F.col("_pii_spans")))
    named = F.array(*[F.lit(f"<{k}>") for k in KINDS])

    def piece(s, i):
        start = F.when(i > 0, F.get("_pii_spans", i - 1)["end"]).otherwise(0)
        return F.concat(F.substring(F.col(text), start + 1, s["start"] - start), F.get(named, s["kind"]))

    tail = F.substring(F.col(text), F.element_at("_pii_spans", -1)["end"] + 1, F.length(text))
    masked = F.concat(F.array_join(F.transform("_pii_spans", piece), ""), tail)
    out = F.when(F.size("_pii_spans") > 0, masked).otherwise(F.col(text))
    return found.select(*[out.alias(c) if c == text else F.col(c) for c in docs.columns])


def masked_with_size(docs: DataFrame, text: str = "text", size: str = "n_chars", **settings) -> DataFrame:
    """`mask`, with the column of text lengths brought up to date where the text changed."""
    out = mask(docs.withColumn("_pii_before", F.length(text)), text, **settings)
    changed = F.length(text) != F.col("_pii_before")
    return out.withColumn(size, F.when(changed, F.length(text).cast("long")).otherwise(F.col(size))).drop("_pii_before")


def _listed(spans):
    names = F.array(*map(F.lit, KINDS))
    one = F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(one, ",")


def op1_private_data(spark, sf_dir):
    """Personal data of every document; n_* count the seeds, n_added the other spans."""
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_columns=False)

    def count(k: int):
        return F.size(F.filter("_pii_base", lambda s: s["kind"] == k)).cast("long")

    counts = [count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select(
        "doc_id", *counts, F.sha2(_listed(F.col("_pii_base")), 256).alias("base_sha256"), _listed(F.col("_pii_spans")).alias("spans"),
        (F.size("_pii_spans") - F.size("_pii_base")).cast("long").alias("n_added"),
    )
