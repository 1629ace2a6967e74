"""Evaluation reports (R1-R9) as DataFrames that any charting tool can plot (S6 re-aimed).

Top-k reports use ``orderBy(...).limit(k)``, which Spark plans as ``TakeOrderedAndProject``: each
task keeps only its k best rows, so the driver merges tasks x k rows however large the test set is.
The sort key always ends with the row key, so ties resolve the same way on every run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.metrics import abs_error, residual
from ..names import column


def residual_rows(scored: DataFrame, key: str, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(key, label, prediction, residual, abs_error): the rows behind the actual-vs-predicted and
    residual charts (R5, R7)."""
    return scored.select(column(key), column(label), F.col(prediction), residual(label, prediction),
                         abs_error(label, prediction))


def best_k(scored: DataFrame, key: str, k: int = 5, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """The k predictions with the smallest absolute error."""
    return residual_rows(scored, key, label, prediction).orderBy(F.col("abs_error").asc(), column(key).asc()).limit(k)


def worst_k(scored: DataFrame, key: str, k: int = 5, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """The k predictions with the largest absolute error."""
    return residual_rows(scored, key, label, prediction).orderBy(F.col("abs_error").desc(), column(key).asc()).limit(k)


def best_and_worst(scored: DataFrame, key: str, k: int = 5, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """The k best and the k worst predictions, told apart by ``kind`` (R3 and R4 in one table)."""
    best = best_k(scored, key, k, label, prediction).withColumn("kind", F.lit("best"))
    return best.unionByName(worst_k(scored, key, k, label, prediction).withColumn("kind", F.lit("worst")))


def ideal_line(scored: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """End points of the y = x line: joint min and max of label and prediction."""
    return scored.agg(F.least(F.min(label), F.min(prediction)).alias("line_min"),
                      F.greatest(F.max(label), F.max(prediction)).alias("line_max"))


def importance_frame(spark: SparkSession, pairs: list[tuple[str, float]]) -> DataFrame:
    """(pos, feature, importance) by name (R8); one row per feature of the fitted model."""
    return spark.createDataFrame([(i, n, float(v)) for i, (n, v) in enumerate(pairs)],
                                 "pos int, feature string, importance double")


def top_importances(imp: DataFrame, k: int = 20) -> DataFrame:
    """The k largest importances, name as tie-break."""
    return imp.orderBy(F.col("importance").desc(), F.col("feature").asc()).limit(k)


def write_report_tables(path: str, scored: DataFrame, key: str, imp: DataFrame | None = None,
                        label: str = "label") -> None:
    """Write the plotted rows (S6): residual rows, the ideal line and importances."""
    residual_rows(scored, key, label).write.mode("overwrite").parquet(f"{path}/residuals")
    ideal_line(scored, label).write.mode("overwrite").parquet(f"{path}/ideal_line")
    if imp is not None:
        imp.write.mode("overwrite").parquet(f"{path}/importances")
