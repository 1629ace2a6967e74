"""The boosted models (M2, M3) and the forest (M4) as fitted by ``growing``.

``LeafwiseBooster`` grows shrunken trees from the label mean, with a limit of leaves (M3) or of depth (M2);
``Forest`` averages trees that are each grown on a Poisson bootstrap of the rows. Loss is squared
error, a leaf's value the mean residual. Prediction on new rows uses the raw thresholds (``x <= edge``; a gap
goes right), no binning.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..names import column
from .growing import Spec, TreeRows, fit_models
from .trees import Limits, Tree, stacked

#: (row, tree) pairs that a scoring step handles at a time.
PAIRS = 1 << 20


class TreeModel:
    """Trees whose values are added (``rate``; boosting) or averaged (None; forest)."""

    def __init__(self, feature_names, init, trees, edges, learning_rate):
        self.feature_names = list(feature_names)
        self.init = float(init)
        self.trees: list[Tree] = trees
        self.edges = edges
        self.learning_rate = learning_rate

    def transform(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        """Adds the prediction: each row of an Arrow batch walks down all trees at once."""
        init, rate, many = self.init, self.learning_rate, len(self.trees)
        if not many:
            return df.withColumn(out, F.lit(init))
        roots, feature, threshold, left, right, value = stacked(self.trees, "feature", "threshold", "left", "right", "value")
        used = np.unique(feature[feature >= 0]).tolist()
        if not used:
            return df.withColumn(out, F.lit(init + rate * float(value.sum()) if rate is not None else float(value.mean())))
        place = np.zeros(max(used) + 1, np.int64)
        place[used] = np.arange(len(used))
        sent = df.sparkSession.sparkContext.broadcast((roots, np.where(feature >= 0, place[np.maximum(feature, 0)], -1), threshold, left, right, value))

        @F.pandas_udf("double")
        def score(rows: pd.DataFrame) -> pd.Series:
            roots, feature, threshold, left, right, value = sent.value
            x, total = rows.to_numpy(dtype=np.float64), np.empty(len(rows))
            step = max(1, PAIRS // many)
            for i in range(0, len(x), step):
                part = x[i: i + step]
                row, at = np.repeat(np.arange(len(part)), many), np.tile(roots, len(part))
                moving = np.flatnonzero(feature[at] >= 0)
                while len(moving):
                    node = at[moving]
                    at[moving] = np.where(part[row[moving], feature[node]] <= threshold[node], left[node], right[node])
                    moving = moving[feature[at[moving]] >= 0]
                values = value[at].reshape(len(part), many)
                total[i: i + step] = values.mean(axis=1) if rate is None else init + rate * values.sum(axis=1)
            return pd.Series(total)

        return df.withColumn(out, score(F.struct(*[column(self.feature_names[f]).cast("double").alias(f"x{f}") for f in used])))

    def used_features(self) -> list[int]:
        return sorted({f for t in self.trees for f in t.feature[t.feature >= 0].tolist()})

    def importances(self, kind: str = "split") -> list[float]:
        """By feature: number of splits, or each tree's share of the gain, averaged over trees (forest)
        or summed over them and divided by the sum (boosting)."""
        out = np.zeros(len(self.feature_names))
        for t in self.trees:
            inner = t.feature >= 0
            amount = np.bincount(t.feature[inner], np.ones(inner.sum()) if kind == "split" else t.gain[inner], len(out))
            out += amount / amount.sum() if kind != "split" and self.learning_rate is None and amount.sum() else amount
        if kind != "split" and out.sum():
            out /= out.sum()
        return out.tolist()

    def stump_rows(self) -> list[tuple]:
        """(feature, threshold, n_left, n_right, left_value, right_value, gain) of each tree's root
        split; values are mean residuals before the learning rate."""
        rows = []
        for t in self.trees:
            if t.feature[0] >= 0:
                a, b = int(t.left[0]), int(t.right[0])
                lv, rv = (float(t.value[i]) if t.feature[i] < 0 else None for i in (a, b))
                rows.append((self.feature_names[t.feature[0]], float(t.threshold[0]), int(t.n[a]), int(t.n[b]), lv, rv, float(t.gain[0])))
        return rows


LeafwiseModel = TreeModel


class LeafwiseBooster:
    def __init__(self, feature_names, label: str = "label", n_estimators: int = 100, learning_rate: float = 0.1,
                 num_leaves: int | None = 31, min_child_samples: int = 20, max_bin: int = 255, max_depth: int | None = None):
        depth = None if max_depth is None or max_depth <= 0 else int(max_depth)
        self.feature_names, self.label, self.max_bin = list(feature_names), label, max_bin
        self.spec = Spec(Limits(num_leaves, depth, max(1, min_child_samples)), n_estimators, learning_rate)

    def fit(self, df: DataFrame) -> TreeModel:
        return _fitted(TreeRows(df, self.feature_names, self.label, max_bin=self.max_bin), self.spec)


class Forest:
    """Trees of any depth on all features; ``key`` names the rows for the bootstrap (None: their values do, and
    equal rows are drawn together)."""

    def __init__(self, feature_names, label: str = "label", n_estimators: int = 100, max_depth: int | None = None, min_samples_leaf: int = 1,
                 bootstrap: bool = True, max_bin: int = 255, seed: int = 42, key: str | None = None):
        self.feature_names, self.label, self.max_bin, self.seed, self.key = list(feature_names), label, max_bin, seed, key
        self.spec = Spec(Limits(None, max_depth, max(1, min_samples_leaf)), n_estimators, None, bootstrap=bootstrap)

    def fit(self, df: DataFrame) -> TreeModel:
        return _fitted(TreeRows(df, self.feature_names, self.label, key=self.key, max_bin=self.max_bin), self.spec, self.seed)


def _fitted(data: TreeRows, spec: Spec, seed: int = 42) -> TreeModel:
    try:
        trees = fit_models(data, [spec], seed)[0]
    finally:
        data.release()
    return TreeModel(data.features, data.start(spec), trees, data.layout.edges, spec.rate)
