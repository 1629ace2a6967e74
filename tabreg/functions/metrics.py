"""Scores and residual columns.

``evaluate`` computes count, MAE, R² and the joint min/max of label and prediction in **one**
aggregate pass: R²'s total sum of squares is ``var_pop(label) * n``, whose partial buffers Spark
merges with a stable (Chan et al.) update, so no second pass over a broadcast mean is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def residual(label: str = "label", prediction: str = "prediction") -> Column:
    return (F.col(label) - F.col(prediction)).alias("residual")


def abs_error(label: str = "label", prediction: str = "prediction") -> Column:
    return F.abs(F.col(label) - F.col(prediction)).alias("abs_error")


def metric_exprs(label: str = "label", prediction: str = "prediction") -> list[Column]:
    y, p = F.col(label), F.col(prediction)
    n = F.count(F.lit(1))
    ss_res = F.sum((y - p) * (y - p))
    ss_tot = F.var_pop(y) * n
    return [
        n.alias("n"),
        F.avg(F.abs(y - p)).alias("mae"),
        (F.lit(1.0) - ss_res / ss_tot).alias("r2"),
        F.least(F.min(y), F.min(p)).alias("line_min"),
        F.greatest(F.max(y), F.max(p)).alias("line_max"),
    ]


def evaluate_frame(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One-row (n, mae, r2, line_min, line_max)."""
    return df.agg(*metric_exprs(label, prediction))


def evaluate(df: DataFrame, label: str = "label", prediction: str = "prediction") -> dict:
    return evaluate_frame(df, label, prediction).collect()[0].asDict()


def mae_frame(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.agg(F.avg(F.abs(F.col(label) - F.col(prediction))).alias("mae"))
