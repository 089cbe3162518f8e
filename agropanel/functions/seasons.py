"""Crop-season calendar as column expressions.

The monsoon season (Kharif) runs June to October, the winter season (Rabi) November to March. Both carry the year
in which the agricultural year (June to May) starts, so one crop-year column serves every seasonal aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KHARIF_MONTHS = (6, 7, 8, 9, 10)
RABI_MONTHS = (11, 12, 1, 2, 3)
SEASON_START_MONTH = {"kharif": 6, "rabi": 11}


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def crop_year(date) -> Column:
    """Year in which the agricultural year holding `date` began."""
    d = _col(date)
    return F.year(d) - F.when(F.month(d) < 6, 1).otherwise(0)


def is_kharif(date) -> Column:
    return F.month(_col(date)).isin(*KHARIF_MONTHS)


def is_rabi(date) -> Column:
    return F.month(_col(date)).isin(*RABI_MONTHS)


def season_name(date) -> Column:
    """Kharif, Rabi, or null between seasons."""
    return F.when(is_kharif(date), "Kharif").when(is_rabi(date), "Rabi")


def season_label(date) -> Column:
    """Like season_name, but April and May are named."""
    return F.coalesce(season_name(date), F.lit("Inter-season"))


def kharif_year(date) -> Column:
    return F.when(is_kharif(date), crop_year(date))


def rabi_year(date) -> Column:
    return F.when(is_rabi(date), crop_year(date))


def season_day(date, month: int = 6, year=None) -> Column:
    """Days since the first of `month` in the date's own calendar year (or the given year); 0 on that day."""
    d = _col(date)
    y = F.year(d) if year is None else _col(year)
    return F.datediff(d, F.make_date(y, F.lit(month), F.lit(1)))


def block_day(date) -> Column:
    """Day number inside the running season: 0 on June 1 (Kharif) or November 1 (Rabi); null between seasons."""
    d = _col(date)
    start = F.when(is_kharif(d), F.make_date(F.year(d), F.lit(6), F.lit(1))).when(
        is_rabi(d), F.make_date(crop_year(d), F.lit(11), F.lit(1))
    )
    return F.datediff(d, start)


def between_days(date, first: str, last: str) -> Column:
    """Range of literal days, which a Parquet scan can use to skip row groups."""
    d = _col(date)
    return (d >= F.lit(first).cast("date")) & (d <= F.lit(last).cast("date"))


def kharif_days(date, year: int) -> Column:
    return between_days(date, f"{year}-06-01", f"{year}-10-31")


def window_label(date) -> Column:
    """Season-to-date window as text, from June 1 to the given date."""
    return F.concat(F.lit("Jun 1–"), F.date_format(_col(date), "MMM dd"))


def request_end(as_of, source_lag_days: int = 3) -> Column:
    """Last day worth requesting from a source that publishes with a fixed delay."""
    return F.date_sub(_col(as_of), source_lag_days)


def age_days(date, as_of) -> Column:
    return F.datediff(_col(as_of), _col(date))


def is_stale(date, as_of, max_days: int = 7) -> Column:
    return age_days(date, as_of) > max_days
