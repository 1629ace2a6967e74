"""Quoting of column names: one place, since names may hold dots and backticks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quoted(name: str) -> str:
    """The name as SQL text."""
    return "`" + name.replace("`", "``") + "`"


def column(name: str) -> Column:
    return F.col(quoted(name))


def number(name: str) -> Column:
    """The column as double with NaN as NULL: a NaN is a gap, as in the reference."""
    return as_number(column(name))


def as_number(value: Column) -> Column:
    value = value.cast("double")
    return F.when(~F.isnan(value), value)
