"""Plain text out of retrieved snippets."""

from __future__ import annotations

import html
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agropanel.functions.scalars import _col

# Length limits.
LIMITS = {"category": 80, "query": 200, "title": 160, "snippet": 280, "url": 500}
BLANKS = r"(?U)[\s\x1c-\x1f]+"
LINK = r"(?i)^https?://[^\s<>\"']+$"


@F.pandas_udf(T.StringType())
def unescape(values: pd.Series) -> pd.Series:
    """Every named and numeric character reference, decoded once."""
    return values.map(html.unescape, na_action="ignore")


def decode_entities(c) -> Column:
    """Character references decoded in Arrow batches; texts without an ampersand stay in the JVM."""
    text = _col(c)
    return F.coalesce(unescape(F.when(F.contains(text, F.lit("&")), text)), text)


def clean(c, limit: int | None = None) -> Column:
    """References decoded first, so that escaped tags go too; then markup and doubled blanks; then the length cap."""
    text = decode_entities(F.coalesce(_col(c), F.lit("")))
    text = F.regexp_replace(text, "<[^>]*>", " ")
    text = F.translate(text, "<>", "  ")
    text = F.trim(F.regexp_replace(text, BLANKS, " "))
    return text if limit is None else F.substring(text, 1, limit)


def link(c, limit: int = LIMITS["url"]) -> Column:
    """A citable link, or null."""
    url = F.trim(_col(c))
    return F.when((F.length(url) <= limit) & url.rlike(LINK), url)


def top_results(df: DataFrame, section: str, order: str, k: int = 3) -> DataFrame:
    """The first k citable results of each section, as plain text.

    Expects title, content and url. The rank limit is applied before the shuffle, so a huge section costs no more
    than k rows per task.
    """
    citable = df.withColumn("url", link("url")).where(F.col("url").isNotNull())
    w = Window.partitionBy(section).orderBy(order)
    first = citable.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k)
    titled = first.withColumn("title", clean("title", LIMITS["title"]))
    return titled.withColumn("snippet", clean("content", LIMITS["snippet"])).drop("content")


def shape_sections(sections: DataFrame, results: DataFrame, section: str, order: str, k: int = 3) -> DataFrame:
    """Every section with its plain category and query, its first k citable results and whether its source failed.

    `sections` holds (section, category, query, error), `results` (section, order, title, content, url). A section
    without a citable result keeps an empty list; the error's text is not passed on.
    """
    first = top_results(results, section, order, k)
    item = F.struct("position", "title", "snippet", "url")
    listed = first.groupBy(section).agg(F.sort_array(F.collect_list(item)).alias("results"))  # at most k items
    empty = F.array().cast("array<struct<position:int,title:string,snippet:string,url:string>>")
    return sections.join(listed, section, "left").select(
        section, clean("category", LIMITS["category"]).alias("category"), clean("query", LIMITS["query"]).alias("query"),
        F.coalesce("results", empty).alias("results"), (F.coalesce(F.col("error"), F.lit("")) != "").alias("failed"),
    )
