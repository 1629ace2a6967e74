"""Scoring a stream with a fitted preparation and model.

``FittedPrep.transform`` is a projection with the fitted values as literals and a fitted model's
``transform`` is a per-row expression (Spark ML or the leaf-wise trees), so both apply to a
streaming DataFrame as they are: no state, no watermark, each micro-batch is scored
independently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.prepare import FittedPrep
from ..plans.models import FittedModel


def score_stream(stream: DataFrame, prep: FittedPrep, fitted: FittedModel) -> DataFrame:
    """(key, [label,] prediction) for each arriving row."""
    rows = prep.transform(stream)
    cols = [c for c in (prep.key, prep.label) if c and c in rows.columns]
    return fitted.transform(rows).select(*cols, "prediction")
