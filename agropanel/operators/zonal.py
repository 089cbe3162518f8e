"""Means of raster pixels around sites.

Pixels are first reduced to one row per position and period. Sites are then listed under every grid cell their
circle touches, which turns the distance condition into an equi-join on the cell plus a distance filter.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agropanel.functions import seasons as S

EARTH_M = 6_371_008.8
METRES_PER_DEGREE = EARTH_M * math.pi / 180


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    half = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(half, F.lit(1.0))))


def _cell(x, size: float) -> Column:
    return F.floor(x / size).cast("int")


def _site_cells(sites: DataFrame, ids: Sequence[str], radius_m: float, size: float) -> DataFrame:
    reach = radius_m / METRES_PER_DEGREE * 1.001
    width = F.lit(reach) / F.cos(F.radians(F.least(F.abs(F.col("lat")) + reach, F.lit(89.0))))
    rows = sites.select(
        *ids,
        F.col("lat").alias("_lat"),
        F.col("lon").alias("_lon"),
        F.explode(F.sequence(_cell(F.col("lat") - reach, size), _cell(F.col("lat") + reach, size))).alias("_cy"),
        width.alias("_w"),
    )
    return rows.withColumn(
        "_cx", F.explode(F.sequence(_cell(F.col("_lon") - F.col("_w"), size), _cell(F.col("_lon") + F.col("_w"), size)))
    ).drop("_w")


def zonal(
    pixels: DataFrame, sites: DataFrame, radius_m: float, by: Sequence[str], value: Column, ids=("state", "district")
) -> DataFrame:
    """Mean over the pixels of a circle of the pixels' own means per period `by`."""
    size = radius_m / METRES_PER_DEGREE
    per_pixel = pixels.groupBy("lat", "lon", *by).agg(F.avg(value).alias("_v"))
    per_pixel = per_pixel.where(F.col("_v").isNotNull())
    placed = per_pixel.withColumn("_cy", _cell(F.col("lat"), size)).withColumn("_cx", _cell(F.col("lon"), size))
    near = placed.join(_site_cells(sites, ids, radius_m, size), ["_cy", "_cx"])
    inside = near.where(haversine_m(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon")) <= radius_m)
    return inside.groupBy(*ids, *by).agg(F.avg("_v").alias("mean"), F.count(F.lit(1)).alias("n_pixels"))


def zonal_mean(
    pixels: DataFrame, sites: DataFrame, radius_m: float = 5000.0, scale: float = 0.0001, value: str = "value"
) -> DataFrame:
    """Seasonal mean per site and crop year, one column per season; a period ends before its last calendar day."""
    d = F.col("date")
    last_day = F.date_format(d, "MM-dd").isin("10-31", "03-31")
    tagged = pixels.withColumn("season", S.season_name(d)).withColumn("year", S.crop_year(d))
    tagged = tagged.where(F.col("season").isNotNull() & ~last_day)
    means = zonal(tagged, sites, radius_m, ["season", "year"], F.col(value) * scale)

    def pick(season):
        return F.max(F.when(F.col("season") == season, F.col("mean")))

    return means.groupBy("state", "district", "year").agg(
        pick("Kharif").alias("ndvi_kharif"), pick("Rabi").alias("ndvi_rabi")
    )


def zonal_share(pixels: DataFrame, sites: DataFrame, predicate: Column, radius_m: float = 5000.0) -> DataFrame:
    """Yearly share in percent of pixels that meet a condition; both seasons carry the yearly value."""
    yearly = pixels.withColumn("year", F.year("date")) if "year" not in pixels.columns else pixels
    share = zonal(yearly, sites, radius_m, ["year"], predicate.cast("int") * 100.0)
    return share.select(
        "state", "district", "year", F.col("mean").alias("water_pct_kharif"), F.col("mean").alias("water_pct_rabi")
    )


def latest_share(shares: DataFrame) -> DataFrame:
    """The newest year as a baseline for live rows."""
    newest = shares.agg(F.max("year")).scalar()
    return shares.where(F.col("year") == newest).select(
        "state", "district", F.col("water_pct_kharif").alias("current_water_pct_kharif"),
        F.col("water_pct_rabi").alias("current_water_pct_rabi"),
    )
