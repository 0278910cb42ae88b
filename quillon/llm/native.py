"""Column expressions that the native operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often and inside whatever lambda it's used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def upto(n: Column) -> Column:
    """[0, 1, ... n - 1], empty for n below 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def total(values: Column, kind: str = "long") -> Column:
    return F.aggregate(values, F.lit(0).cast(kind), lambda a, v: a + v)


def quoted(text: str) -> str:
    """A pattern that matches the text alone."""
    return "\\Q" + text + "\\E"
