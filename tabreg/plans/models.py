"""Model registry (M1-M8): name -> fit with the reference's factory settings.

The tree models run on ``growing``: both boosted ones start from the label mean and shrink every tree (M2
limits the depth, M3 the leaves), the forest averages trees of any depth on bootstraps of the rows. Linear
regression is the least-squares solution of minimum norm. Trees bin features (``max_bins``): one of at
most that many values is split exactly as the reference does, others at bounds of equal shares.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import UnknownModel
from .growing import Spec
from .leafwise import Forest, LeafwiseBooster
from .linear import fit_linear
from .trees import Limits

# The reference's model names and the factory settings of the libraries it calls.
LINEAR, BOOSTED, LEAFWISE, FOREST = "LinearRegression", "GradientBoosting", "LGBM", "RandomForest"
MODELS = [BOOSTED, LEAFWISE, FOREST, LINEAR]
FACTORY = {
    LINEAR: {},
    BOOSTED: {"n_estimators": 100, "max_depth": 3, "learning_rate": 0.1},
    LEAFWISE: {"n_estimators": 100, "learning_rate": 0.1, "num_leaves": 31, "min_child_samples": 20},
    FOREST: {"n_estimators": 100, "max_depth": None, "min_samples_leaf": 1},
}
DEFAULT_RUN_NAMES = {LINEAR: "LR_Default", BOOSTED: "GBR_Default", LEAFWISE: "LGBM_Default", FOREST: "RF_Default"}
SEED = 42
#: Bins a feature.
BINS = 255


def final_run_name(model: str) -> str:
    return f"{model}_Final"


def search_run_name(model: str) -> str:
    return f"{model}_Optimized"


def infer_model(params: dict) -> tuple[str, str]:
    """Model from the shape of a parameter set: ``num_leaves`` means leaf-wise boosting, otherwise
    depth-limited boosting; ``min_samples_leaf`` (forest) is our extension. Returns (model, run name)."""
    n = params.get("n_estimators")
    if "num_leaves" in params:
        return LEAFWISE, f"LGBM_FINAL_{n}"
    if "min_samples_leaf" in params:
        return FOREST, f"RF_FINAL_{n}"
    return BOOSTED, f"GBR_FINAL_{n}"


@dataclass
class FittedModel:
    model: str
    params: dict
    feature_names: list[str]
    inner: object
    fit_seconds: float = 0.0
    extra: dict = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``prediction`` (double) to rows holding the named feature columns."""
        if self.model == LINEAR:
            return self.inner.transform(df)
        return self.inner.transform(_used_columns(df, self.feature_names, self.inner.used_features()))

    def importances(self, kind: str = "split") -> list[tuple[str, float]]:
        """Tree importances, or absolute coefficients for the linear model, by feature name."""
        if self.model == LINEAR:
            vals = [abs(v) for v in self.inner.coefficients]
        elif self.model == LEAFWISE:
            vals = self.inner.importances(kind)
        else:
            vals = self.inner.importances("gain")
        return list(zip(self.feature_names, [float(v) for v in vals]))

    def params_json(self) -> str:
        return json.dumps(self.params, sort_keys=True)


def _used_columns(df: DataFrame, names: list[str], used: list[int]) -> DataFrame:
    """The feature columns that trees ask for, taken out of a ``features`` vector if there is one."""
    if "features" not in df.columns or "features" in names:
        return df
    rows = df.withColumn("features", vector_to_array("features"))
    return rows.select("*", *[F.col("features")[i].alias(names[i]) for i in used]).drop("features")


def fit_model(model: str, train: DataFrame, feature_names: list[str], params: dict | None = None,
              label: str = "label", seed: int = SEED, max_bins: int | None = None, key: str | None = None) -> FittedModel:
    """Fit ``model`` on rows holding the label and the named feature columns (or their vector).
    ``key`` names the rows for the forest's bootstrap (None: their values do)."""
    import time

    if model not in FACTORY:
        raise UnknownModel(f"unknown model {model!r}; known: {MODELS}")
    p = dict(FACTORY[model])
    p.update(params or {})
    t0 = time.monotonic()
    if model == LINEAR:
        inner = fit_linear(train, feature_names, label)
    elif model == FOREST:
        inner = Forest(feature_names, label, int(p["n_estimators"]), p["max_depth"], int(p["min_samples_leaf"]), max_bin=max_bins or BINS, seed=seed, key=key).fit(train)
    else:
        limits, trees, rate = _boosting(model, p)
        inner = LeafwiseBooster(feature_names, label, trees, rate, limits.num_leaves, limits.min_child, max_bins or BINS, limits.max_depth).fit(train)
    return FittedModel(model, {k: v for k, v in p.items()}, list(feature_names), inner, time.monotonic() - t0)


def _boosting(model: str, p: dict) -> tuple[Limits, int, float]:
    if model == BOOSTED:      # depth alone ends growth, and a leaf may hold one row
        limits = Limits(2 ** int(p["max_depth"]), int(p["max_depth"]), int(p.get("min_samples_leaf") or 1))
    else:
        limits = Limits(int(p["num_leaves"]), p.get("max_depth"), int(p.get("min_child_samples", 20)))
    return limits, int(p["n_estimators"]), float(p["learning_rate"])


def tree_spec(model: str, params: dict, held_out: int = -1) -> Spec:
    """What a tree model with these parameters grows, without the rows of the fold ``held_out``."""
    p = FACTORY[model] | params
    if model == FOREST:
        return Spec(Limits(None, p["max_depth"], max(1, int(p["min_samples_leaf"]))), int(p["n_estimators"]), None, held_out)
    limits, trees, rate = _boosting(model, p)
    return Spec(limits, trees, rate, held_out)
