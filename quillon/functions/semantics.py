"""Expression semantics that the analytics queries share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def falsy_coalesce(value: Column, default) -> Column:
    """``default`` for null and for the empty string."""
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))


def pct(part: Column, whole: Column) -> Column:
    """100 * part / whole, 0 where the whole is null or 0."""
    return F.coalesce(F.try_divide(part.cast("double"), F.nullif(whole.cast("double"), F.lit(0.0))) * 100, F.lit(0.0))


def pct1(part: Column, whole: Column) -> Column:
    """``pct`` rounded half to even to one decimal."""
    return F.bround(pct(part, whole), 1)


def half_up(value: Column) -> Column:
    return F.floor(value + 0.5).cast("bigint")


def unicode_trim(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def study_time(seconds: Column) -> Column:
    """'2h 5m', or '5m' below an hour."""
    hours, minutes = F.floor(seconds / 3600).cast("bigint"), F.floor(seconds % 3600 / 60).cast("bigint")
    return F.when(hours > 0, F.concat(hours.cast("string"), F.lit("h "), minutes.cast("string"), F.lit("m"))).otherwise(F.concat(minutes.cast("string"), F.lit("m")))


def long(value: Column | str) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast("bigint")
