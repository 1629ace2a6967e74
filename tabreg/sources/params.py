"""Best-parameter sink and source (S3, S4) as one-row JSON tables with a fixed schema.

One schema covers all three models; a key a model does not use is NULL. A write adds a file to the folder,
which Spark's commit makes visible as a whole, and then removes the older ones; readers take the newest. So
a write that is killed at any time leaves parameters that are whole: the old ones, or the new.
"""

from __future__ import annotations

import warnings

from py4j.protocol import Py4JError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SourceNotFound
from ..session import delete_dir

PARAMS_SCHEMA = T.StructType([
    T.StructField("learning_rate", T.DoubleType()),
    T.StructField("max_depth", T.IntegerType()),
    T.StructField("n_estimators", T.IntegerType()),
    T.StructField("num_leaves", T.IntegerType()),
    T.StructField("min_samples_leaf", T.IntegerType()),
    T.StructField("min_child_samples", T.IntegerType()),
])
PARAM_KEYS = [f.name for f in PARAMS_SCHEMA.fields]


def params_frame(spark: SparkSession, params: dict) -> DataFrame:
    unknown = set(params) - set(PARAM_KEYS)
    if unknown:
        raise ValueError(f"unknown parameter names: {sorted(unknown)}")
    row = tuple(None if params.get(k) is None else (float(params[k]) if k == "learning_rate" else int(params[k]))
                for k in PARAM_KEYS)
    return spark.createDataFrame([row], PARAMS_SCHEMA)


def write_params(spark: SparkSession, params: dict, path: str) -> bool:
    """Write the winning parameters. Unknown names raise; a failed write only warns (returns
    False), as in the reference."""
    row = params_frame(spark, params)
    try:
        older = _files(spark, path)
        row.coalesce(1).write.mode("append").json(path)
        for file in older:
            delete_dir(spark, file)
        return True
    except (Py4JError, PySparkException) as e:
        warnings.warn(f"parameters not saved to {path}: {e}")
        return False


def write_params_rows(rows: DataFrame, path: str) -> None:
    """Parameter sets, one a row, as JSON; a name that ``rows`` lacks is NULL."""
    if unknown := set(rows.columns) - set(PARAM_KEYS):
        raise ValueError(f"unknown parameter names: {sorted(unknown)}")
    kinds = {f.name: f.dataType for f in PARAMS_SCHEMA.fields}
    columns = [F.col(k) if k in rows.columns else F.lit(None).alias(k) for k in PARAM_KEYS]
    rows.select(*[c.cast(kinds[k]).alias(k) for k, c in zip(PARAM_KEYS, columns, strict=True)]).write.mode("overwrite").json(path)


def _files(spark: SparkSession, path: str) -> list[str]:
    """The parameter files in the folder, if there is one."""
    try:
        found = spark.read.text(path).select("_metadata.file_path").distinct().collect()
    except AnalysisException:
        return []
    return [r[0] for r in found]


def read_params_rows(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_params_rows`` wrote: a parameter set a row."""
    return spark.read.schema(PARAMS_SCHEMA).json(path)


def read_params_frame(spark: SparkSession, path: str) -> DataFrame:
    try:
        rows = spark.read.schema(PARAMS_SCHEMA).option("multiLine", True).json(path)
        age = [F.col("_metadata.file_modification_time").desc(), F.col("_metadata.file_name").desc()]
        return rows.orderBy(*age).limit(1)
    except AnalysisException as e:
        raise SourceNotFound(f"parameter file not found: {path}; run the search for this model first") from e


def read_params(spark: SparkSession, path: str) -> dict:
    """The parameter dict with absent keys left out (explicit ``max_depth: null`` is lost, as in JSON
    written by the reference's search only when the key is present)."""
    rows = read_params_frame(spark, path).collect()
    if not rows:
        raise SourceNotFound(f"parameter file is empty: {path}")
    return {k: v for k, v in rows[0].asDict().items() if v is not None}
