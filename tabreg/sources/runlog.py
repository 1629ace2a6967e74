"""Run log (S5): one fixed schema, appended as parquet.

The reference appends CSV rows whose columns drift between scripts (seven, six or five columns,
a number or a text in the same slot). Here every run writes the same typed row; parameters are
JSON text, the cross-validation score is a nullable double.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

RUN_LOG_SCHEMA = T.StructType([
    T.StructField("model", T.StringType(), False),
    T.StructField("mae", T.DoubleType()),
    T.StructField("r2", T.DoubleType()),
    T.StructField("params", T.StringType()),
    T.StructField("cv_mae", T.DoubleType()),
    T.StructField("total_seconds", T.DoubleType()),
    T.StructField("run_at", T.TimestampType()),
])


def log_row(spark: SparkSession, model: str, mae: float, r2: float, params: str | None,
            cv_mae: float | None, total_seconds: float, run_at: dt.datetime | None = None) -> DataFrame:
    run_at = run_at or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None, second=0, microsecond=0)
    row = (model, float(mae), float(r2), params, None if cv_mae is None else float(cv_mae),
           round(float(total_seconds), 2), run_at)
    return spark.createDataFrame([row], RUN_LOG_SCHEMA)


def append_run_log(row: DataFrame, path: str) -> None:
    row.coalesce(1).write.mode("append").parquet(path)


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN_LOG_SCHEMA).parquet(path)
