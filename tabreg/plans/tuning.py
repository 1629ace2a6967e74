"""Grid search with k-fold cross-validation.

Folds come from a seeded key hash (``operators.split.k_fold``) over the training rows only. Trees of
all candidates and folds grow together (``growing.fit_models``): rows are binned and packed once (for boosting,
those of equal bins as one weighted row), a job makes the histograms that all of them want next, and candidates that differ in ``n_estimators`` alone
are one model, scored after as many of its trees as each asks for. Bins are told from all training rows, so where a feature has
more values than bins, a fold's cuts may differ from those of a fit on its rows alone; with one bin a
value they are the same. Per-fold scores come back as a DataFrame, so the search can be inspected and
re-aggregated in SQL.
"""

from __future__ import annotations

import itertools
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import mae_frame
from ..names import column
from ..operators.split import k_fold
from .growing import TreeRows, fit_models, held_out_errors
from .models import BINS, BOOSTED, FOREST, LEAFWISE, LINEAR, SEED, fit_model, tree_spec

# The reference's search grids.
REFERENCE_GRIDS = {
    BOOSTED: {"n_estimators": [100, 300, 500], "max_depth": [3, 5], "learning_rate": [0.1, 0.05]},
    LEAFWISE: {"n_estimators": [100, 300, 500], "learning_rate": [0.1, 0.05], "num_leaves": [10, 20, 31]},
    FOREST: {"n_estimators": [100, 200], "max_depth": [10, 20, None], "min_samples_leaf": [1, 2, 4]},
}
FOLDS = 5


def param_grid(grid: dict[str, list]) -> list[dict]:
    """Cartesian product, keys in sorted order and the last key varying fastest."""
    keys = sorted(grid)
    return [dict(zip(keys, vals)) for vals in itertools.product(*[grid[k] for k in keys])]


def cv_scores(model: str, train: DataFrame, feature_names: list[str], grid: dict[str, list], key: str,
              folds: int = FOLDS, fold_seed: int = 43, label: str = "label", max_bins: int | None = None, seed: int = SEED) -> DataFrame:
    """(candidate, params, fold, mae) for every candidate x fold, fitted on the other folds."""
    cands = param_grid(grid)
    features = ["features"] if "features" in train.columns else [column(c) for c in feature_names]
    data = k_fold(train.select(column(key), column(label), *features), key, folds, fold_seed, "__fold")
    scores = _linear_scores if model == LINEAR else _tree_scores
    maes = scores(model, data, feature_names, cands, key, folds, label, max_bins or BINS, seed)
    rows = [(ci, json.dumps(c, sort_keys=True), f, maes[ci, f]) for ci, c in enumerate(cands) for f in range(folds) if (ci, f) in maes]
    return train.sparkSession.createDataFrame(rows, "candidate int, params string, fold int, mae double")


def _tree_scores(model, data, feature_names, cands, key, folds, label, max_bins, seed) -> dict[tuple[int, int], float]:
    shared: dict[str, list[int]] = {}          # candidates that differ in the number of trees alone
    for ci, c in enumerate(cands):
        shared.setdefault(json.dumps({k: v for k, v in c.items() if k != "n_estimators"}, sort_keys=True), []).append(ci)
    models = [(group, f) for group in shared.values() for f in range(folds)]
    trees = [[tree_spec(model, cands[ci]).trees for ci in group] for group, _ in models]
    specs = [tree_spec(model, cands[group[0]] | {"n_estimators": max(t)}, f) for (group, f), t in zip(models, trees, strict=True)]
    rows = TreeRows(data, feature_names, label, "__fold", key, max_bins)
    try:
        errors = held_out_errors(rows, specs, fit_models(rows, specs, seed), trees)
    finally:
        rows.release()
    return {(ci, f): errors[m, t] for m, (group, f) in enumerate(models) for ci, t in zip(group, trees[m], strict=True) if (m, t) in errors}


def _linear_scores(model, data, feature_names, cands, key, folds, label, max_bins, seed) -> dict[tuple[int, int], float]:
    out = {}
    for ci, c in enumerate(cands):
        for f in range(folds):
            fit = fit_model(model, data.where(F.col("__fold") != f), feature_names, c, label=label, key=key)
            mae = mae_frame(fit.transform(data.where(F.col("__fold") == f)), label).first()["mae"]
            if mae is not None:
                out[ci, f] = float(mae)
    return out


def mean_scores(scores: DataFrame) -> DataFrame:
    """(candidate, params, cv_mae): mean fold MAE per candidate."""
    return scores.groupBy("candidate", "params").agg(F.avg("mae").alias("cv_mae"))


def best_candidate(scores: DataFrame) -> DataFrame:
    """One row: the lowest mean MAE, first candidate on ties."""
    m = mean_scores(scores)
    return m.agg(F.min_by(F.struct("candidate", "params", "cv_mae"),
                          F.struct("cv_mae", "candidate")).alias("b")).select("b.*")
