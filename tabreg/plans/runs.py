"""Composite runs (E1-E5): prepare -> split -> fit -> score -> log -> report tables.

Each run persists its prepared rows once (fit and scoring both read them), times the work up to
the scores like the reference does (load, preparation, split, fit, predict; not the log or
reports), and returns everything as DataFrames. Nothing row-sized reaches the driver: only fitted
statistics, trees, coefficients and scores do.

Every run takes the preparation's options too (``prep``): ``strict_drop``, ``approx_median``,
``max_categories``, ``drop_last``; and ``max_bins`` for the trees.
"""

from __future__ import annotations

import json
import time
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import evaluate
from ..names import column
from ..operators.columns import REFERENCE_DROP
from ..operators.prepare import FittedPrep, Preparer, fill_median_expr
from ..operators.split import TEST, TRAIN, train_test_split
from ..operators.stats import fit_medians
from ..sources.params import read_params, write_params
from ..sources.runlog import append_run_log, log_row
from . import reports
from .models import (DEFAULT_RUN_NAMES, LEAFWISE, FittedModel, final_run_name, fit_model, infer_model,
                     search_run_name)
from .tuning import FOLDS, best_candidate, cv_scores


@dataclass
class RunResult:
    name: str
    model: str
    prep: FittedPrep
    fitted: FittedModel
    scored: DataFrame          # key, label, prediction of the test rows
    metrics: dict              # n, mae, r2, line_min, line_max
    total_seconds: float
    cv_mae: float | None = None
    scores: DataFrame | None = None

    def log(self) -> DataFrame:
        return log_row(self.scored.sparkSession, self.name, self.metrics["mae"], self.metrics["r2"],
                       self.fitted.params_json() if self.name not in DEFAULT_RUN_NAMES.values() else None,
                       self.cv_mae, self.total_seconds)

    def importances(self) -> DataFrame:
        return reports.importance_frame(self.scored.sparkSession, self.fitted.importances())

    def release(self) -> None:
        """Drop the cached scored rows once the reports that need them are written."""
        self.scored.unpersist()

    def write_reports(self, path: str, key: str | None = None) -> None:
        """The rows behind the reference's charts (residuals, ideal line, importances)."""
        reports.write_report_tables(path, self.scored, key or self.prep.key, self.importances(), self.prep.label)

    def summary(self) -> DataFrame:
        spark = self.scored.sparkSession
        m = self.metrics
        return spark.createDataFrame([(self.name, int(m["n"]), float(m["mae"]), float(m["r2"]))],
                                     "model string, n_test long, mae double, r2 double")


def _prepare_split(df: DataFrame, key: str, label: str, drop, scale: bool, test_size: float, seed: int,
                   fit_scope: str = "all", sparse: bool = False, fill_label: bool = False, **prep):
    """Project the source to key, label and features once and persist that (the fit statistics,
    the transform and every model pass then read it instead of rescanning and re-deriving the
    source), then tag the seeded split on the prepared rows, also persisted.

    ``fit_scope='all'`` fits the preparation on every row before the split, as the reference does;
    ``'train'`` fits it on the training rows only (the split depends on the key alone)."""
    if fit_scope not in ("all", "train"):
        raise ValueError("fit_scope must be 'all' or 'train'")
    if fill_label:     # the oldest scripts fill the label like any number, before it is split off
        df = df.withColumn(label, fill_median_expr(label, fit_medians(df, [label])[label]))
    base, _ = Preparer(label=label, key=key, drop=drop, strict_drop=prep.pop("strict_drop", False)).select_features(df)
    base = train_test_split(base, key, test_size, seed).persist(StorageLevel.MEMORY_AND_DISK)
    fit_rows = base if fit_scope == "all" else base.where(F.col("split") == TRAIN)
    try:
        prep = Preparer(label=label, key=key, drop=["split"], scale=scale, **prep).fit(fit_rows)
    except BaseException:
        base.unpersist()
        raise
    prepared = prep.to_vector(base, keep=["split"]) if sparse else prep.transform(base, keep=["split"])
    rows = prepared.persist(StorageLevel.MEMORY_AND_DISK)
    train = rows.where(F.col("split") == TRAIN).drop("split")
    test = rows.where(F.col("split") == TEST).drop("split")
    return prep, _Persisted([base, rows]), train, test


class _Persisted:
    def __init__(self, frames):
        self.frames = frames

    def unpersist(self):
        for f in self.frames:
            f.unpersist()


def _score(fitted: FittedModel, test: DataFrame, key: str, label: str):
    scored = fitted.transform(test).select(column(key), column(label), "prediction").persist(StorageLevel.MEMORY_AND_DISK)
    return scored, evaluate(scored, label)


def fit_and_score(df: DataFrame, model: str, key: str, label: str = "label", drop=REFERENCE_DROP,
                  params: dict | None = None, name: str | None = None, scale: bool = True,
                  test_size: float = 0.2, seed: int = 42, fit_scope: str = "all", sparse: bool = False,
                  max_bins: int | None = None, **options) -> RunResult:
    """``sparse=True`` prepares one sparse vector (wide text columns) instead of one column per
    category."""
    t0 = time.monotonic()
    prep, rows, train, test = _prepare_split(df, key, label, drop, scale, test_size, seed, fit_scope, sparse, **options)
    try:
        fitted = fit_model(model, train, prep.feature_names, params, label=label, seed=seed, max_bins=max_bins, key=key)
        scored, metrics = _score(fitted, test, key, label)
        total = time.monotonic() - t0
    finally:
        rows.unpersist()
    return RunResult(name or DEFAULT_RUN_NAMES[model], model, prep, fitted, scored, metrics, total)


def default_run(df: DataFrame, model: str, key: str, label: str = "label", drop=REFERENCE_DROP,
                log_path: str | None = None, params: dict | None = None, report_path: str | None = None,
                **kw) -> RunResult:
    """Factory settings (``params`` may shrink them for a quick run)."""
    res = fit_and_score(df, model, key, label, drop, params=params, **kw)
    if log_path:
        append_run_log(res.log(), log_path)
    if report_path:
        res.write_reports(report_path, key)
    return res


def search_run(df: DataFrame, model: str, key: str, grid: dict, label: str = "label", drop=REFERENCE_DROP,
               params_path: str | None = None, log_path: str | None = None, folds: int = FOLDS,
               scale: bool = True, test_size: float = 0.2, seed: int = 42,
               fit_scope: str = "all", report_path: str | None = None, sparse: bool = False,
               max_bins: int | None = None, **options) -> RunResult:
    """Grid search with k folds on the training rows, refit the winner, score the test rows."""
    t0 = time.monotonic()
    prep, rows, train, test = _prepare_split(df, key, label, drop, scale, test_size, seed, fit_scope, sparse, **options)
    try:
        scores = cv_scores(model, train, prep.feature_names, grid, key, folds, label=label, max_bins=max_bins, seed=seed)
        best = best_candidate(scores).collect()[0]
        best_params = json.loads(best["params"])
        if params_path:
            write_params(df.sparkSession, best_params, params_path)
        fitted = fit_model(model, train, prep.feature_names, best_params, label=label, seed=seed, max_bins=max_bins, key=key)
        scored, metrics = _score(fitted, test, key, label)
        total = time.monotonic() - t0
    finally:
        rows.unpersist()
    res = RunResult(search_run_name(model), model, prep, fitted, scored, metrics, total,
                    cv_mae=float(best["cv_mae"]), scores=scores)
    if log_path:
        append_run_log(res.log(), log_path)
    if report_path:
        res.write_reports(report_path, key)
    return res


def final_run(df: DataFrame, model: str | None, key: str, params_path: str, label: str = "label",
              drop=REFERENCE_DROP, log_path: str | None = None, report_path: str | None = None,
              **kw) -> RunResult:
    """Fit with saved parameters. With ``model=None`` the model is inferred from the parameter
    shape (M8)."""
    params = read_params(df.sparkSession, params_path)
    if model is None:
        model, name = infer_model(params)
    else:
        name = final_run_name(model)
    res = fit_and_score(df, model, key, label, drop, params=params, name=name, **kw)
    if log_path:
        append_run_log(res.log(), log_path)
    if report_path:
        res.write_reports(report_path, key)
    return res


def inspect_run(df: DataFrame, model: str, key: str, label: str = "label", drop=REFERENCE_DROP,
                params: dict | None = None, k: int = 5, strict_drop: bool = True, fill_label: bool | None = None):
    """Strict drop, unscaled preparation, fit, then the best and worst k predictions. Returns
    (run, rows with ``kind``). ``fill_label`` (None: for the leaf-wise model, as in the reference's
    old scripts) fills gaps of the label by its median."""
    fill = model == LEAFWISE if fill_label is None else fill_label
    res = fit_and_score(df, model, key, label, drop, params=params, scale=False, strict_drop=strict_drop, fill_label=fill)
    return res, reports.best_and_worst(res.scored, key, k, label)


def inspect_search(df: DataFrame, model: str, key: str, grid: dict, label: str = "label", drop=REFERENCE_DROP,
                   k: int = 5, strict_drop: bool = True, fill_label: bool | None = None, **kw):
    """E5: the same inspection after a grid search. Returns (run, rows with ``kind``)."""
    fill = model == LEAFWISE if fill_label is None else fill_label
    res = search_run(df, model, key, grid, label, drop, scale=False, strict_drop=strict_drop, fill_label=fill, **kw)
    return res, reports.best_and_worst(res.scored, key, k, label)
