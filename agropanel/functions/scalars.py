"""Small column functions shared by the operators. All are built-in expressions; none is a Python UDF."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def title_name(c) -> Column:
    """Trimmed name, each word capitalised; letters after an apostrophe or hyphen start a word too."""
    text = F.lower(F.trim(_col(c)))
    for mark in ("'", "-", "."):
        # a private separator makes initcap see the next letter as the start of a word
        text = F.replace(text, F.lit(mark), F.lit(f"{mark}\u0001 "))
    return F.replace(F.initcap(text), F.lit("\u0001 "), F.lit(""))


def start_year(c) -> Column:
    """First year of a text such as 2001-02."""
    return F.split_part(_col(c), F.lit("-"), F.lit(1)).try_cast("int")


def kg_per_ha(tons_per_ha) -> Column:
    return _col(tons_per_ha) * 1000.0


def production_tons(yield_kg_ha, area_ha) -> Column:
    return F.bround(_col(yield_kg_ha) * _col(area_ha) / 1000.0, 0)


def period_month(c) -> Column:
    return F.substring(_col(c), 1, 3)


def period_year(c, century: int = 2000) -> Column:
    return F.substring(_col(c), 5, 2).try_cast("int") + century


def slug(c) -> Column:
    dashed = F.regexp_replace(F.lower(_col(c)), "[^a-z0-9]+", "-")
    return F.regexp_replace(dashed, "^-+|-+$", "")


def site_slug(state="state", district="district") -> Column:
    return F.concat_ws("/", slug(state), slug(district))


def name_key(c) -> Column:
    """Join key for names whose spelling differs only in case and outer blanks."""
    return F.lower(F.trim(_col(c)))


def fill_to_null(c, floor: float = -900.0) -> Column:
    """Source fill values (at or below the floor) and NaN become null."""
    x = _col(c)
    return F.when((x > floor) & ~F.isnan(x), x)


def clip(c, low: float, high: float) -> Column:
    x = _col(c)
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high))))


def zscore(x, mean, std) -> Column:
    """Null instead of an error where the spread is zero."""
    return F.try_divide(_col(x) - _col(mean), F.nullif(_col(std), F.lit(0.0)))


def per_hectare(amount, area_ha) -> Column:
    return _col(amount) / (_col(area_ha) + 1)


def percent_of_area(area_1000ha, area_ha) -> Column:
    return clip(_col(area_1000ha) * 1000 / (_col(area_ha) + 1) * 100, 0, 100)


def encode(c, codes: Mapping[str, int]) -> Column:
    """Code of a listed value, null for any other."""
    out = F.lit(None).cast("int")
    for value, code in codes.items():
        out = F.when(_col(c) == value, F.lit(code)).otherwise(out)
    return out


def season_or_default(season, crop, by_crop: Mapping[str, str]) -> Column:
    """Season text, trimmed; where it is missing, the usual season of the crop."""
    text = F.nullif(F.trim(_col(season)), F.lit(""))
    default = F.lit(None).cast("string")
    for name, usual in by_crop.items():
        default = F.when(F.trim(_col(crop)) == name, F.lit(usual)).otherwise(default)
    return F.coalesce(text, default)


def half_even(c, digits: int) -> Column:
    return F.bround(_col(c), digits)


def contains_point(lower, point, upper) -> Column:
    return _col(point).between(_col(lower), _col(upper))


def percent_vs(x, normal, digits: int = 1) -> Column:
    """Departure from normal in percent; null unless normal is positive."""
    m = _col(normal)
    return F.when(m > 0, F.bround((_col(x) - m) / m * 100, digits))


def json_number(c, field: str) -> Column:
    """Numeric field of a JSON object held as text."""
    return F.get_json_object(_col(c), f"$.{field}").try_cast("double")


def json_object(columns: Sequence[str]) -> Column:
    """Row as a JSON object that keeps null fields."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def content_version(content, prefix: str = "model") -> Column:
    """Version name derived from content, so that equal content gets an equal name everywhere."""
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(_col(content).cast("string"), 256), 1, 8))


def signed_whole(c) -> Column:
    """Number as text without decimals, rounded half to even, always with a sign."""
    return F.format_string("%+.0f", F.bround(_col(c), 0))


def two_decimals(c) -> Column:
    return F.format_string("%.2f", F.bround(_col(c), 2))
