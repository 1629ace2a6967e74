"""Projections and column roles.

All of these only touch the schema or add projections, so Catalyst prunes whatever is dropped
straight out of the parquet scan; none of them runs a job by itself.
"""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..errors import MissingColumns, MissingLabel
from ..names import column

# The columns the reference pipeline drops before modelling, and its label.
REFERENCE_DROP = ["Id", "Alley", "PoolQC", "Fence", "MiscFeature", "FireplaceQu", "MasVnrType"]
REFERENCE_LABEL = "SalePrice"

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def drop_lenient(df: DataFrame, columns=REFERENCE_DROP) -> DataFrame:
    """Drop the named columns; names that are absent are ignored."""
    return df.drop(*columns)


def drop_strict(df: DataFrame, columns=REFERENCE_DROP) -> DataFrame:
    """Drop the named columns; any absent name is an error listing all of them."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise MissingColumns(missing)
    return df.drop(*columns)


def split_label(df: DataFrame, label: str, key: str | None = None) -> tuple[DataFrame, list[str]]:
    """Move the label (as double) beside the key and list the remaining feature columns."""
    if label not in df.columns:
        raise MissingLabel(f"label column {label!r} not found")
    features = [c for c in df.columns if c not in (label, key)]
    cols = ([column(key)] if key else []) + [column(label).cast("double").alias(label)]
    return df.select(*cols, *[column(c) for c in features]), features


def column_roles(df: DataFrame, features: list[str] | None = None) -> dict[str, str]:
    """Role of each feature: ``numeric`` (int/float), ``categorical`` (text), ``boolean``, or ``other``."""
    features = features if features is not None else df.columns
    fields = {f.name: f.dataType for f in df.schema.fields}
    roles = {}
    for c in features:
        t = fields[c]
        if isinstance(t, NUMERIC_TYPES):
            roles[c] = "numeric"
        elif isinstance(t, T.StringType):
            roles[c] = "categorical"
        elif isinstance(t, T.BooleanType):
            roles[c] = "boolean"
        else:
            roles[c] = "other"
    return roles


def feature_name_frame(spark, names: list[str]) -> DataFrame:
    """(pos, name) rows of a fitted feature list; positions link vector slots to names."""
    return spark.createDataFrame([(i, n) for i, n in enumerate(names)], "pos int, name string")


def assemble(df: DataFrame, features: list[str], out: str = "features") -> DataFrame:
    """Feature vector for Spark ML; any null or NaN is an error, as in the reference's fit. Slots
    stand in the order of ``features``; the assembler sees positional names, since it can't read
    names that hold dots."""
    slots = [f"__slot{i}" for i in range(len(features))]
    rows = df.select("*", *[column(c).alias(s) for c, s in zip(features, slots)])
    return VectorAssembler(inputCols=slots, outputCol=out, handleInvalid="error").transform(rows).drop(*slots)
