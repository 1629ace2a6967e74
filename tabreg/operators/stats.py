"""Fitted statistics (A1-A4): medians, modes, mean/population std, category domains.

Scale notes
-----------
* Every statistic is computed for all columns of a kind in one pass (one ``agg`` or one
  ``unpivot`` + ``groupBy``), never one job per column.
* ``F.median`` merges every distinct value of a column into the single final task of a global
  aggregate, so its memory grows with the data. The exact median here is an order statistic found by
  range refinement: each pass is a ``groupBy(target, bucket)`` with map-side partial aggregation
  (at most ``targets x buckets`` rows reach the driver), until the range is one value: the same
  way for few rows as for many. ``approx=True`` gives the one-pass ``percentile_approx`` instead.
* Mode and domain go through ``groupBy(column, value).count()``: a hot value (a third of all rows)
  is collapsed map-side before the shuffle, so skew costs nothing.
"""

from __future__ import annotations

import math
import sys
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import AllNullColumn, TooManyCategories
from ..names import column as _q
from ..names import number

BUCKETS = 1024


@dataclass
class _Target:
    column: str
    rank: int          # 0-based rank among the column's non-null values
    lo: float
    hi: float
    below: int         # non-null values of the column strictly below ``lo``
    inside: int        # values within [lo, hi]


def column_ranges(df: DataFrame, columns: list[str]) -> dict[str, tuple[int, float | None, float | None]]:
    """(count, min, max) of every column's values (neither null nor NaN), one aggregate job."""
    if not columns:
        return {}
    aggs = []
    for i, c in enumerate(columns):
        v = number(c)
        aggs += [F.count(v).alias(f"n{i}"), F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}")]
    row = df.agg(*aggs).collect()[0]
    return {c: (row[f"n{i}"], row[f"lo{i}"], row[f"hi{i}"]) for i, c in enumerate(columns)}


def order_statistics(df: DataFrame, ranks: dict[str, list[int]], ranges=None, buckets: int = BUCKETS,
                     below: bool = False) -> dict[tuple[str, int], float | tuple[float, int]]:
    """Exact k-th smallest value of each column for each requested 0-based rank; with ``below``
    also how many values are smaller.

    Range refinement: the target's value lies in [lo, hi]; one pass counts the rows of that range
    per bucket (with each bucket's min and max), and the target moves into the bucket that holds its
    rank. The ends of a range fall into different buckets, so each pass leaves fewer distinct values;
    it ends when the range is one value. Infinities have buckets of their own.
    """
    ranges = ranges or column_ranges(df, list(ranks))
    targets = []
    for c, ks in ranks.items():
        n, lo, hi = ranges[c]
        for k in ks:
            if not 0 <= k < n:
                raise ValueError(f"rank {k} out of range for column {c!r} with {n} values")
            targets.append(_Target(c, k, lo, hi, 0, n))
    while open_ := [t for t in targets if t.lo != t.hi]:
        _bucket_pass(df, open_, buckets)
    return {(t.column, t.rank): (t.lo, t.below) if below else t.lo for t in targets}


def _magnitude(x: float) -> float:
    """Grows with x over all finite doubles, by the power of two of its size."""
    return 0.0 if x == 0 else math.copysign(math.log2(abs(x)) + 1100, x)


def _bucket(v, t: _Target, buckets: int):
    """Bucket of a value of the range: -1 and ``buckets`` for infinities, else by equal widths, of
    magnitudes while the range holds several powers of two, so that few passes do whatever the
    distribution: some four powers of two are left after the first, and then a 1,024th each time."""
    lo, hi = max(t.lo, -sys.float_info.max), min(t.hi, sys.float_info.max)
    if _magnitude(hi) - _magnitude(lo) > 5:
        size = F.log2(F.abs(v)) + 1100
        at = F.when(v == 0, 0.0).when(v > 0, size).otherwise(-size)
        first, last = _magnitude(lo), _magnitude(hi)
    else:    # halves, since the width of a range may be beyond the largest double
        at, first, last = v / 2, lo / 2, hi / 2
    if last > first:
        at = F.floor((at - F.lit(first)) / F.lit(last - first) * F.lit(buckets))
        at = F.when(v >= F.lit(hi), buckets - 1).when(v <= F.lit(lo), 0).otherwise(F.least(F.greatest(at, F.lit(0)), F.lit(buckets - 1)))
    else:    # neighbours among the smallest numbers, or infinities around one value
        at = F.when(v <= F.lit(lo), 0).otherwise(buckets - 1)
    return F.when(v == float("-inf"), -1).when(v == float("inf"), buckets).otherwise(at).cast("int")


def _bucket_pass(df: DataFrame, targets: list[_Target], buckets: int) -> None:
    items = []
    for i, t in enumerate(targets):
        v = number(t.column)
        items.append(F.when(v.between(t.lo, t.hi), F.struct(F.lit(i).alias("t"), v.alias("v"), _bucket(v, t, buckets).alias("b"))))
    values = df.select(F.explode(F.filter(F.array(*items), lambda x: x.isNotNull())).alias("s")).select("s.*")
    hist = values.groupBy("t", "b").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
    per = {}
    for r in hist:
        per.setdefault(r["t"], []).append(r)
    for i, t in enumerate(targets):
        was = (t.lo, t.hi, t.inside)
        for r in sorted(per[i], key=lambda r: r["b"]):
            if t.below + r["n"] > t.rank:
                t.inside, t.lo, t.hi = r["n"], r["lo"], r["hi"]
                break
            t.below += r["n"]
        if was == (t.lo, t.hi, t.inside):
            raise RuntimeError(f"no progress in the order statistic of column {t.column!r}: {was}")


def fit_medians(df: DataFrame, columns: list[str], approx: bool = False, accuracy: int = 10_000,
                allow_all_null: bool = False, buckets: int = BUCKETS, ranges=None) -> dict[str, float | None]:
    """Median of each column over its non-null values; an even count averages the two middle values."""
    if not columns:
        return {}
    if approx:
        row = df.agg(*[F.percentile_approx(number(c), 0.5, accuracy).alias(f"m{i}")
                       for i, c in enumerate(columns)]).collect()[0]
        out = {c: row[f"m{i}"] for i, c in enumerate(columns)}
    else:
        ranges = ranges or column_ranges(df, columns)
        ranks = {}
        for c in columns:
            n = ranges[c][0]
            if n:
                ranks[c] = sorted({(n - 1) // 2, n // 2})
        stats = order_statistics(df, ranks, ranges, buckets)
        out = {}
        for c in columns:
            n = ranges[c][0]
            if not n:
                out[c] = None
                continue
            a, b = stats[(c, (n - 1) // 2)], stats[(c, n // 2)]
            out[c] = a if a == b else a / 2.0 + b / 2.0 if math.isinf(b - a) else a + (b - a) / 2.0
    for c, v in out.items():
        if v is None and not allow_all_null:
            raise AllNullColumn(c)
    return out


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Long (column, value, n) table of non-null value counts for all given columns at once."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), _q(c).cast("string").alias("value")) for c in columns])
    return (df.select(F.explode(pairs).alias("p")).select("p.*")
            .where(F.col("value").isNotNull())
            .groupBy("column", "value").agg(F.count("*").alias("n")))


def mode_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, mode): most frequent non-null value, ties to the smallest value. Fully distributed."""
    vc = value_counts(df, columns)
    return vc.groupBy("column").agg(
        F.min_by("value", F.struct((-F.col("n")).alias("neg_n"), F.col("value"))).alias("mode"))


def fit_modes(df: DataFrame, columns: list[str]) -> dict[str, str]:
    if not columns:
        return {}
    got = {r["column"]: r["mode"] for r in mode_table(df, columns).collect()}
    for c in columns:
        if c not in got:
            raise AllNullColumn(c)
    return {c: got[c] for c in columns}


def fit_modes_and_domains(df: DataFrame, columns: list[str], max_categories: int | None = None):
    """Modes and sorted category domains from one ``groupBy(column, value)`` job.

    The driver receives one row per category (they become feature names). With ``max_categories``
    it takes at most ``columns x max_categories`` rows and raises if there is one more.
    """
    if not columns:
        return {}, {}
    counted = value_counts(df, columns)
    bound = None if max_categories is None else len(columns) * max_categories
    rows = (counted if bound is None else counted.limit(bound + 1)).collect()
    if bound is not None and len(rows) > bound:
        raise TooManyCategories(f"more than {max_categories} categories per column on average in {columns}")
    per = {c: [] for c in columns}
    for r in rows:
        per[r["column"]].append((r["value"], r["n"]))
    modes, domains = {}, {}
    for c in columns:
        vals = per[c]
        if not vals:
            raise AllNullColumn(c)
        if max_categories is not None and len(vals) > max_categories:
            raise TooManyCategories(f"column {c!r} has {len(vals)} categories (limit {max_categories})")
        modes[c] = min(vals, key=lambda vn: (-vn[1], vn[0]))[0]
        domains[c] = sorted(v for v, _ in vals)
    return modes, domains


def domain_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value) distinct non-null values, distributed."""
    return value_counts(df, columns).select("column", "value")


def fit_scale(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """(mean, population std) of each column in one aggregate; a zero std is kept as 0 here and
    replaced by 1 where it divides."""
    if not columns:
        return {}
    aggs = []
    for i, c in enumerate(columns):
        v = number(c)
        aggs += [F.avg(v).alias(f"m{i}"), F.stddev_pop(v).alias(f"s{i}")]
    row = df.agg(*aggs).collect()[0]
    return {c: (row[f"m{i}"], row[f"s{i}"]) for i, c in enumerate(columns)}


#: Categories of all text columns that may come to the driver, where they become feature names.
CATEGORY_ROWS = 1_000_000


def profile(df: DataFrame, numeric: list[str], text: list[str], max_categories: int | None = None):
    """What the preparation fits besides the median refinement, in two jobs.

    Numeric columns take one wide aggregate (count, min, max, mean and population variance of their
    non-null values). Text columns alone are unpivoted to (column, value) and counted; partial
    aggregation runs map-side, so the shuffle and the collected result hold one row per category. More
    than ``text x max_categories`` of them (None: ``CATEGORY_ROWS`` in all) raise instead of reaching the driver.

    Returns (ranges, moments, value counts, rows): ranges[c] = (n, min, max), moments[c] =
    (n, mean, var_pop), counts[c] = [(value, n), ...], rows = row count (None without numerics).
    """
    ranges, moments, counts, total = {}, {}, {c: [] for c in text}, None
    if numeric:
        aggs = [F.count("*").alias("rows")]
        for i, c in enumerate(numeric):
            x = number(c)
            aggs += [f(x).alias(f"{name}{i}") for name, f in (("n", F.count), ("lo", F.min), ("hi", F.max), ("mean", F.avg), ("var", F.var_pop))]
        row = df.agg(*aggs).first()
        total = row["rows"]
        for i, c in enumerate(numeric):
            ranges[c] = (row[f"n{i}"], row[f"lo{i}"], row[f"hi{i}"])
            moments[c] = (row[f"n{i}"], row[f"mean{i}"], row[f"var{i}"])
    if text:
        bound = CATEGORY_ROWS if max_categories is None else len(text) * max_categories
        got = value_counts(df, text).limit(bound + 1).collect()
        if len(got) > bound:
            raise TooManyCategories(f"more than {bound} categories in {text}; drop columns that name rows, or set max_categories")
        for r in got:
            counts[r["column"]].append((r["value"], r["n"]))
    return ranges, moments, counts, total


def modes_and_domains(counts: dict[str, list[tuple[str, int]]], max_categories: int | None = None):
    """Mode (most rows, ties to the smallest value) and sorted domain of each text column."""
    modes, domains = {}, {}
    for c, vals in counts.items():
        if not vals:
            raise AllNullColumn(c)
        if max_categories is not None and len(vals) > max_categories:
            raise TooManyCategories(f"column {c!r} has {len(vals)} categories (limit {max_categories})")
        modes[c] = min(vals, key=lambda vn: (-vn[1], vn[0]))[0]
        domains[c] = sorted(v for v, _ in vals)
    return modes, domains


def filled_moments(n_rows: int, moments: tuple, fill: float) -> tuple[float, float]:
    """Mean and population std after filling the gaps with ``fill``, from the non-null moments.

    The gaps form a second group of ``n_rows - n`` copies of ``fill`` with zero variance; the two
    groups combine by the parallel update of Chan, Golub and LeVeque (stable, no second pass)."""
    n_a, mean_a, var_a = moments
    n_b = n_rows - n_a
    if n_a == 0:
        return float(fill), 0.0
    n = n_a + n_b
    delta = fill - mean_a
    mean = mean_a + delta * n_b / n
    m2 = var_a * n_a + delta * delta * n_a * n_b / n
    return mean, math.sqrt(max(m2 / n, 0.0))


def safe_std(s: float | None) -> float:
    return 1.0 if s is None or s == 0.0 or math.isnan(s) else s
