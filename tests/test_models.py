import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabreg.errors import UnknownModel
from tabreg.frames import frame_a
from tabreg.functions.metrics import evaluate
from tabreg.plans.leafwise import LeafwiseBooster
from tabreg.plans.models import BOOSTED, FOREST, LEAFWISE, LINEAR, fit_model, infer_model
from tabreg.plans.runs import default_run
from tabreg.plans.tuning import REFERENCE_GRIDS, best_candidate, param_grid

SF01 = "/root/testdata/sf0.01"


def test_linear_matches_normal_equations(spark):
    rng = np.random.default_rng(3)
    X = rng.normal(size=(300, 3))
    y = X @ np.array([2.0, -1.0, 0.5]) + 4.0 + rng.normal(0, 0.1, 300)
    pdf = pd.DataFrame(X, columns=["a", "b", "c"]).assign(label=y)
    m = fit_model(LINEAR, spark.createDataFrame(pdf), ["a", "b", "c"])
    A = np.c_[X, np.ones(len(X))]
    sol = np.linalg.lstsq(A, y, rcond=None)[0]
    assert np.allclose(list(m.inner.coefficients) + [m.inner.intercept], sol, atol=1e-6)


@pytest.mark.parametrize("model", [LINEAR, BOOSTED, FOREST, LEAFWISE])
def test_models_beat_mean_predictor(spark, model):
    params = {BOOSTED: {"n_estimators": 10}, FOREST: {"n_estimators": 10, "max_depth": 8},
              LEAFWISE: {"n_estimators": 10, "num_leaves": 10}, LINEAR: {}}[model]
    res = default_run(frame_a(spark, SF01), model, "doc_id", drop=["text"], params=params)
    base = res.scored.agg(F.avg("label").alias("m")).collect()[0]["m"]
    mean_mae = evaluate(res.scored.withColumn("prediction", F.lit(base)))["mae"]
    assert res.metrics["n"] == 182
    assert res.metrics["mae"] < 0.5 * mean_mae
    assert res.metrics["r2"] <= 1.0
    imp = res.importances().collect()
    assert len(imp) == len(res.prep.feature_names)


def test_unknown_model(spark):
    with pytest.raises(UnknownModel):
        fit_model("Nope", spark.range(1), [])


def test_infer_model_by_param_shape():
    assert infer_model({"learning_rate": 0.1, "n_estimators": 100, "num_leaves": 10}) == ("LGBM", "LGBM_FINAL_100")
    assert infer_model({"learning_rate": 0.1, "max_depth": 3, "n_estimators": 500}) == ("GradientBoosting", "GBR_FINAL_500")
    assert infer_model({"max_depth": 20, "min_samples_leaf": 2, "n_estimators": 100})[0] == "RandomForest"


def test_grid_sizes_and_order():
    assert [len(param_grid(REFERENCE_GRIDS[m])) for m in (BOOSTED, LEAFWISE, FOREST)] == [12, 18, 18]
    g = param_grid({"b": [1, 2], "a": [3, 4]})
    assert g == [{"a": 3, "b": 1}, {"a": 3, "b": 2}, {"a": 4, "b": 1}, {"a": 4, "b": 2}]


def test_best_candidate_first_wins_ties(spark):
    rows = [(0, json.dumps({"x": 0}), f, 1.0) for f in range(5)] + [(1, json.dumps({"x": 1}), f, 1.0) for f in range(5)]
    scores = spark.createDataFrame(rows, "candidate int, params string, fold int, mae double")
    assert best_candidate(scores).collect()[0]["candidate"] == 0


def _brute_tree(X, g, num_leaves, min_child):
    n, nf = X.shape
    def best(idx):
        G, N = g[idx].sum(), len(idx)
        out = (-np.inf, None)
        for f in range(nf):
            for v in np.unique(X[idx, f])[:-1]:
                l, r = idx[X[idx, f] <= v], idx[X[idx, f] > v]
                if len(l) < min_child or len(r) < min_child:
                    continue
                gain = g[l].sum() ** 2 / len(l) + g[r].sum() ** 2 / len(r) - G * G / N
                if gain > out[0] + 1e-9:
                    out = (gain, (f, v, l, r))
        return out
    leaves = [np.arange(n)]
    info = [best(leaves[0])]
    splits = []
    while len(leaves) < num_leaves:
        k = max(range(len(leaves)), key=lambda i: (info[i][0], -i))
        if not info[k][0] > 0:
            break
        gain, (f, v, l, r) = info[k]
        splits.append((f, v, round(gain, 6)))
        leaves[k:k + 1] = [l, r]
        info[k:k + 1] = [best(l), best(r)]
    return sorted(splits), leaves


@pytest.mark.parametrize("seed,cells", [(0, 4_000_000), (1, 4_000_000), (0, 40)])
def test_leafwise_tree_equals_brute_force(spark, seed, cells, monkeypatch):
    monkeypatch.setattr("tabreg.plans.trees.TASK_CELLS", cells)    # several rounds when small
    if cells == 40:
        monkeypatch.setattr("tabreg.plans.growing.UNIT_BYTES", 10)    # histograms as jobs
    rng = np.random.default_rng(seed)
    X = rng.integers(0, 10, size=(400, 3)).astype(float)
    y = np.where(X[:, 0] > 4, 8.0, 0.0) + X[:, 1] ** 1.3 + rng.normal(0, 1, 400)
    pdf = pd.DataFrame(X, columns=["a", "b", "c"]).assign(label=y)
    m = LeafwiseBooster(["a", "b", "c"], n_estimators=1, num_leaves=7, min_child_samples=15).fit(spark.createDataFrame(pdf))
    t = m.trees[0]
    mine = sorted((f, thr, round(t.gains[node], 6)) for node, (f, _b, thr, _l, _r) in t.splits.items())
    splits, leaves = _brute_tree(X, y - y.mean(), 7, 15)
    assert mine == splits
    pred = np.full(len(y), y.mean())
    for idx in leaves:
        pred[idx] += 0.1 * (y[idx] - y.mean()).mean()
    got = m.transform(spark.createDataFrame(pdf)).select("prediction").toPandas()["prediction"].to_numpy()
    assert np.allclose(np.sort(got), np.sort(pred))


def test_two_step_stump_finds_exact_split(spark):
    pdf = pd.DataFrame({"x": np.arange(100, dtype=float)})
    pdf["label"] = np.where(pdf["x"] <= 36, 1.0, 5.0)
    m = LeafwiseBooster(["x"], n_estimators=1, num_leaves=2, min_child_samples=5).fit(spark.createDataFrame(pdf))
    f, thr, nl, nr, lv, rv, gain = m.stump_rows()[0]
    assert (f, thr, nl, nr) == ("x", 36.0, 37, 63)
    assert lv < 0 < rv


def test_boosting_train_loss_never_rises(spark):
    rng = np.random.default_rng(5)
    X = rng.normal(size=(500, 2))
    y = np.sin(X[:, 0] * 2) + X[:, 1] + rng.normal(0, 0.1, 500)
    df = spark.createDataFrame(pd.DataFrame(X, columns=["a", "b"]).assign(label=y))
    m = LeafwiseBooster(["a", "b"], n_estimators=6, num_leaves=6, min_child_samples=10).fit(df)
    losses = []
    for k in range(1, len(m.trees) + 1):
        sub = type(m)(m.feature_names, m.init, m.trees[:k], m.edges, m.learning_rate)
        p = sub.transform(df).select("label", "prediction").toPandas()
        losses.append(float(((p.label - p.prediction) ** 2).mean()))
    assert all(b <= a + 1e-12 for a, b in zip(losses, losses[1:]))
    gains = m.importances("gain")
    assert abs(sum(gains) - 1) < 1e-9


def test_leafwise_max_depth_limits_tree(spark):
    rng = np.random.default_rng(2)
    X = rng.integers(0, 10, size=(400, 3)).astype(float)
    y = X[:, 0] * 2 + X[:, 1] + rng.normal(0, 1, 400)
    pdf = pd.DataFrame(X, columns=["a", "b", "c"]).assign(label=y)
    m = LeafwiseBooster(["a", "b", "c"], n_estimators=1, num_leaves=31, min_child_samples=5,
                        max_depth=2).fit(spark.createDataFrame(pdf))
    t = m.trees[0]
    assert len(t.leaves) <= 4 and len(t.splits) <= 3
    # depth 2 with all positive-gain splits is the level-wise tree: root plus its two children
    assert set(t.splits) == {0, 1, 2}


@pytest.mark.parametrize("unit_bytes", [32 << 20, 2000, 10])
def test_leafwise_several_trees_equal_brute_force(spark, unit_bytes, monkeypatch):
    """Every tree and the final predictions equal brute-force best-first boosting, whether models, small
    nodes or no rows go to a task of their own."""
    monkeypatch.setattr("tabreg.plans.growing.UNIT_BYTES", unit_bytes)
    monkeypatch.setattr("tabreg.plans.growing.CHECKPOINT", 2)
    rng = np.random.default_rng(11)
    X = rng.integers(0, 12, size=(300, 3)).astype(float)
    y = np.where(X[:, 0] > 5, 10.0, 0.0) + X[:, 1] ** 1.5 + rng.normal(0, 1, 300)
    pdf = pd.DataFrame(X, columns=["a", "b", "c"]).assign(label=y)
    m = LeafwiseBooster(["a", "b", "c"], n_estimators=3, learning_rate=0.1, num_leaves=6,
                        min_child_samples=15).fit(spark.createDataFrame(pdf))
    pred = np.full(len(y), y.mean())
    for tree in m.trees:
        splits, leaves = _brute_tree(X, y - pred, 6, 15)
        mine = sorted((f, thr, round(tree.gains[n], 6)) for n, (f, _b, thr, _l, _r) in tree.splits.items())
        assert mine == splits
        for idx in leaves:
            pred[idx] += 0.1 * (y[idx] - pred[idx]).mean()
    got = m.transform(spark.createDataFrame(pdf)).toPandas()
    assert np.allclose(got["prediction"].to_numpy(), pred)


def test_boosting_starts_from_the_mean_and_shrinks_every_tree(spark):
    pdf = pd.DataFrame({"x": np.arange(100, dtype=float)})
    pdf["label"] = np.where(pdf["x"] <= 36, 1.0, 5.0)
    df = spark.createDataFrame(pdf)
    fitted = fit_model(BOOSTED, df, ["x"], {"n_estimators": 1, "max_depth": 1, "learning_rate": 0.1})
    mean = pdf["label"].mean()
    got = sorted({round(r["prediction"], 9) for r in fitted.transform(df).collect()})
    assert got == [round(mean + 0.1 * (1 - mean), 9), round(mean + 0.1 * (5 - mean), 9)]


def test_forest_does_not_depend_on_partitions(spark):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame(rng.normal(size=(300, 2)), columns=["a", "b"]).assign(label=rng.normal(size=300))
    df = spark.createDataFrame(pdf)
    sums = []
    for n in (1, 16):
        fitted = fit_model(FOREST, df.repartition(n), ["a", "b"], {"n_estimators": 4})
        sums.append([r["prediction"] for r in fitted.transform(df).orderBy("a").collect()])
    assert sums[0] == sums[1]


def test_scores_keep_missing_values_on_the_right(spark):
    pdf = pd.DataFrame({"x": np.arange(40, dtype=float)})
    pdf["label"] = np.where(pdf["x"] <= 19, 0.0, 9.0)
    m = LeafwiseBooster(["x"], n_estimators=2, num_leaves=2, min_child_samples=1).fit(spark.createDataFrame(pdf))
    got = m.transform(spark.createDataFrame([(None,), (float("nan"),), (39.0,)], "x double")).collect()
    assert len({r["prediction"] for r in got}) == 1
