"""Text forms of numbers and dates (R11, R12), as built-in column functions.

``format_number`` rounds the exact binary value like Python's ``format`` and DuckDB's
``format``; ``format_string('%,.2f')`` rounds half up on the decimal text and disagrees on halves,
so it is not used.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The reference's text layouts.
DATE_PATTERN = "yyyy-MM-dd HH:mm"   # '%Y-%m-%d %H:%M'
MONEY_SUFFIX = " $"                 # '{:,.2f} $'
PERCENT_PREFIX = "%"                # '%{r2*100:.0f}'


def fixed(x: Column, digits: int = 4) -> Column:
    """'{:.4f}': fixed digits, no grouping."""
    pattern = "0." + "0" * digits if digits else "0"
    return F.call_function("format_number", x, F.lit(pattern))


def money(x: Column) -> Column:
    """'{:,.2f} $'."""
    return F.concat(F.format_number(x, 2), F.lit(MONEY_SUFFIX))


def grouped_int(x: Column) -> Column:
    """'{:,.0f}'."""
    return F.format_number(x, 0)


def percent(r2: Column) -> Column:
    """R² as a whole percent, '%89'."""
    return F.concat(F.lit(PERCENT_PREFIX), fixed(r2 * F.lit(100.0), 0))


def run_date(ts: Column) -> Column:
    """'%Y-%m-%d %H:%M' of a timestamp (session time zone)."""
    return F.date_format(ts, DATE_PATTERN)
