"""Least squares of minimum norm (M1) by tall-skinny QR.

Every one-hot category is kept, so columns are collinear and many coefficient vectors fit equally
well; the reference's solver takes the one of least norm after centring. Each task reduces its rows to the
triangular factor of ``[1, X, y]``, batch by batch, factors are merged by the same step in a few
tasks, and the driver merges those: rows never leave their task, and no cross products are formed, which
would square the condition number. The constant column comes first, so the rest of the factor is that of
the centred rows; a singular value decomposition of its small block gives the solution. Directions with a
singular value below ``TOLERANCE`` times the largest are taken as collinear.

A row with a gap is an error. The factor has (features + 2)^2 numbers, and the driver holds ``MERGERS`` of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..names import column
from .growing import _vector_entries

TOLERANCE = 1e-10
#: Tasks that merge the factors, and numbers of a matrix that a task factors at a time.
MERGERS, CELLS = 16, 1 << 22


def _factor(*parts: np.ndarray) -> np.ndarray:
    return np.linalg.qr(np.concatenate(parts), mode="r")


class LinearModel:
    def __init__(self, feature_names: list[str], coefficients: np.ndarray, intercept: float):
        self.feature_names, self.coefficients, self.intercept = list(feature_names), coefficients, float(intercept)

    def transform(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        """The prediction as one column expression."""
        weights = [float(c) for c in self.coefficients]
        if "features" in df.columns and "features" not in self.feature_names:
            terms = F.zip_with(vector_to_array("features"), F.array(*map(F.lit, weights)), lambda x, w: x * w)
            return df.withColumn(out, F.aggregate(terms, F.lit(self.intercept), lambda a, t: a + t))
        terms = [F.lit(w) * column(c).cast("double") for c, w in zip(self.feature_names, weights, strict=True)]
        return df.withColumn(out, reduce(lambda a, t: a + t, terms, F.lit(self.intercept)))


def fit_linear(df: DataFrame, feature_names: list[str], label: str = "label") -> LinearModel:
    d = len(feature_names)
    vector = "features" in df.columns and "features" not in feature_names
    inputs = [F.col("features")] if vector else [column(c).cast("double").alias(f"x{i}") for i, c in enumerate(feature_names)]
    rows = df.select(column(label).cast("double").alias("y"), F.lit(0).alias("a"), F.lit(0).alias("b"), *inputs)
    step = max(1, CELLS // (d + 2))

    def matrix(batch: pa.RecordBatch) -> np.ndarray:
        m = np.zeros((batch.num_rows, d + 2))
        m[:, 0], m[:, -1] = 1.0, batch.column(0).to_numpy(zero_copy_only=False)
        if vector:
            row, f, v = _vector_entries(batch)
            m[row, f + 1] = v
        else:
            for i in range(d):
                m[:, i + 1] = batch.column(i + 3).to_numpy(zero_copy_only=False)
        if np.isnan(m).any():
            raise ValueError("least squares needs rows without gaps")
        return m

    def reduced(parts: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
        r = None
        for part in parts:
            r = _factor(part) if r is None else _factor(r, part)
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([r.tobytes()], pa.binary())], names=["part", "r"])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from reduced(matrix(b.slice(i, step)) for b in batches for i in range(0, b.num_rows, step))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from reduced(np.frombuffer(r).reshape(-1, d + 2) for b in batches for r in b.column(1).to_pylist())

    factors = rows.mapInArrow(local, "part long, r binary").repartition(MERGERS, "part").sortWithinPartitions("part")
    found = sorted((x["part"], bytes(x["r"])) for x in factors.mapInArrow(merged, "part long, r binary").collect())
    if not found:
        raise ValueError("no training rows")
    r = _factor(*(np.frombuffer(b).reshape(-1, d + 2) for _, b in found))
    r = np.concatenate([r, np.zeros((max(0, d + 2 - len(r)), d + 2))])
    coefficients = np.linalg.lstsq(r[1: d + 1, 1: d + 1], r[1: d + 1, d + 1], rcond=TOLERANCE)[0] if d else np.zeros(0)
    means = r[0, 1:] / r[0, 0]
    return LinearModel(feature_names, coefficients, means[-1] - means[:-1] @ coefficients)
