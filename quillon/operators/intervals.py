"""Overlaps of intervals by bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _binned(df: DataFrame, start: str, end: str, width: int, side: str) -> DataFrame:
    first, last = F.floor(F.col(start) / F.lit(width)), F.floor(F.col(end) / F.lit(width))
    return df.withColumn(f"__{side}", first).withColumn("__bin", F.explode(F.sequence(first, F.greatest(first, last))))


def overlaps(left: DataFrame, right: DataFrame, keys: list[str], width: int, margin: int = 0) -> DataFrame:
    """Rows of left(keys, l_start, l_end, ...) with those of right(keys, r_start, r_end, ...) that they overlap by more than ``margin`` at either end.

    Bounds are whole numbers. An interval is in each bin of ``width`` that it touches, and a pair is
    reported in the first bin that both touch, so intervals of one key meet in many tasks. Choose
    ``width`` about as long as the longer intervals are. Null bounds and keys meet nothing.
    """
    l, r = _binned(left, "l_start", "l_end", width, "l"), _binned(right, "r_start", "r_end", width, "r")  # noqa: E741
    meet = l.join(r, [*keys, "__bin"])
    first = F.col("__bin") == F.greatest("__l", "__r")
    cross = (F.col("l_start") < F.col("r_end") - F.lit(margin)) & (F.col("l_end") > F.col("r_start") + F.lit(margin))
    return meet.where(first & cross).drop("__bin", "__l", "__r")


def first_overlap(pairs: DataFrame, by: list[str], order: list[str | Column], taken: list[str]) -> DataFrame:
    """For each left row, known by ``by``, the columns ``taken`` of the first right row in an order."""
    g = pairs.groupBy(*by).agg(F.min_by(F.struct(*taken), F.struct(*order)).alias("__t"))
    return g.select(*by, *(F.col(f"__t.{c}").alias(c) for c in taken))
