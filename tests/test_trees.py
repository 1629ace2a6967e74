"""The tree engine: equal trees whatever the partitions and wherever nodes are grown, forests, sparse rows, bins,
the grid in lockstep; and least squares of minimum norm."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import functions as F

from tabreg.plans import growing, trees
from tabreg.plans.leafwise import Forest, LeafwiseBooster
from tabreg.plans.models import BOOSTED, FOREST, LEAFWISE, LINEAR, fit_model
from tabreg.plans.tuning import cv_scores, param_grid

FIELDS = ("cell", "feature", "threshold", "left", "right", "value", "gain", "n")


def same(a, b):
    return len(a.trees) == len(b.trees) and all(np.array_equal(getattr(s, f), getattr(t, f)) for s, t in zip(a.trees, b.trees, strict=True) for f in FIELDS)


def made(n=700, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 9, size=(n, 3)).astype(float)
    x[:, 2] = rng.normal(size=n).round(2)
    y = np.where(x[:, 0] > 4, 7.0, 0.0) + x[:, 1] + rng.normal(0, 1, n)
    x[rng.random((n, 3)) < 0.05] = np.nan
    return pd.DataFrame(x, columns=["a", "b.c", "d"]).assign(label=y, key=range(n))


@pytest.mark.parametrize("model", ["boosted", "forest"])
def test_trees_do_not_depend_on_partitions_or_place(spark, model, monkeypatch):
    monkeypatch.setattr(growing, "CHECKPOINT", 2)
    df, found = spark.createDataFrame(made()), []
    for parts, unit_bytes in ((1, 32 << 20), (3, 3000), (16, 32 << 20), (2, 10 if model == "boosted" else 600)):
        monkeypatch.setattr(growing, "UNIT_BYTES", unit_bytes)
        if model == "boosted":
            found.append(LeafwiseBooster(["a", "b.c", "d"], n_estimators=5, num_leaves=8, min_child_samples=5).fit(df.repartition(parts)))
        else:
            found.append(Forest(["a", "b.c", "d"], n_estimators=3, key="key").fit(df.repartition(parts)))
    assert all(same(found[0], m) for m in found[1:])


def test_near_ties_are_settled_the_same_way(spark):
    """Two features with the same rows on each side, and sums that differ by rounding if added in another order."""
    n = 400
    x = np.arange(n) % 2
    pdf = pd.DataFrame({"a": x.astype(float), "b": 1.0 - x, "label": np.where(x > 0, 0.1, 0.7) + np.arange(n) * 1e-13})
    fits = [LeafwiseBooster(["a", "b"], n_estimators=3, num_leaves=4).fit(spark.createDataFrame(pdf).repartition(p)) for p in (1, 3, 16)]
    assert same(fits[0], fits[1]) and same(fits[0], fits[2])
    assert fits[0].trees[0].feature[0] == 0


def by_rows(x, y, rounds, rate, depth):
    """Predictions after boosting over single rows in plain NumPy, after each round."""
    p, out = np.full(len(y), y.mean()), []
    for _ in range(rounds):
        tree = brute(x, y - p, np.ones(len(y)), depth, 1)
        p = p + rate * np.array([walked(tree, row) for row in x])
        out.append(p)
    return out


@pytest.mark.parametrize("pieces", [False, True])
def test_boosting_costs_as_many_steps_as_there_are_different_rows(spark, pieces, monkeypatch):
    """3,000 rows of 12 kinds, in a unit that holds 40 rows: no rounds of jobs, and the trees of single rows."""
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.integers(0, 4, 3000), rng.integers(-1, 2, 3000)]).astype(float)
    y = x[:, 0] ** 2 + 3 * x[:, 1] + rng.normal(0, 1, 3000).round(3)
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"]).assign(label=y, key=range(3000))).repartition(5)
    monkeypatch.setattr(growing, "UNIT_BYTES", 40 * 32)
    if pieces:              # groups come in several blocks, and again in another one
        monkeypatch.setattr(growing, "PART_BYTES", 2000)
        monkeypatch.setattr(growing, "BLOCK_GROUPS", 2)

    def refused(*_):
        raise AssertionError("rounds of jobs")

    if not pieces:
        monkeypatch.setattr(growing, "_boost_rounds", refused)
    model = fit_model(BOOSTED, df, ["a", "b"], {"n_estimators": 4})
    got = model.transform(df).toPandas().sort_values("key")["prediction"].to_numpy()
    assert np.allclose(got, by_rows(x, y, 4, 0.1, 3)[-1], atol=1e-6)
    data = growing.TreeRows(df, ["a", "b"])
    groups = data.groups.collect()
    data.release()
    sizes = np.concatenate([np.frombuffer(r["w"], np.int64) for r in groups])
    assert sizes.sum() == sum(len(r["y"]) // 8 for r in groups) == 3000 and (pieces or len(sizes) == 12)


def test_scores_by_groups_are_those_of_single_rows(spark, monkeypatch):
    """Absolute errors need every label: labels differ within a group, and folds share groups."""
    from tabreg.operators.split import k_fold

    monkeypatch.setattr(growing, "UNIT_BYTES", 60 * 32)
    monkeypatch.setattr(growing, "_boost_rounds", lambda *_: pytest.fail("rounds of jobs"))
    rng = np.random.default_rng(6)
    x = np.column_stack([rng.integers(0, 5, 1500), rng.integers(0, 3, 1500)]).astype(float)
    pdf = pd.DataFrame(x, columns=["a", "b"]).assign(label=x[:, 0] * x[:, 1] + rng.exponential(2, 1500).round(2), key=range(1500))
    df = spark.createDataFrame(pdf)
    scores = cv_scores(BOOSTED, df.repartition(3), ["a", "b"], {"n_estimators": [2, 4], "max_depth": [2], "learning_rate": [0.3]}, "key", folds=2).collect()
    fold = k_fold(df, "key", 2, 43).toPandas().sort_values("key")["fold"].to_numpy()
    y = pdf.label.to_numpy()
    for r in scores:
        seen, n = fold != r["fold"], json.loads(r["params"])["n_estimators"]
        p, left = np.full(len(y), y[seen].mean()), y[seen] - y[seen].mean()
        for _ in range(n):
            tree = brute(x[seen], left, np.ones(seen.sum()), 2, 1)
            step = 0.3 * np.array([walked(tree, row) for row in x])
            p, left = p + step, left - step[seen]
        assert r["mae"] == pytest.approx(np.abs(y - p)[~seen].mean(), abs=1e-6)
    assert len(scores) == 4


def brute(x, y, w, depth, min_leaf, at=0):
    """A tree of largest gains on weighted rows, as nested tuples."""
    n, g = w.sum(), (w * y).sum()
    best = (0.0, None)
    for f in range(x.shape[1]) if depth else ():
        for v in np.unique(x[:, f])[:-1]:
            left = x[:, f] <= v
            nl, gl = w[left].sum(), (w * y)[left].sum()
            if nl >= min_leaf and n - nl >= min_leaf:
                gain = gl * gl / nl + (g - gl) ** 2 / (n - nl) - g * g / n
                if gain > best[0] + 1e-7:
                    best = (gain, (f, v))
    if best[1] is None:
        return g / n
    f, v = best[1]
    left = x[:, f] <= v
    return (f, v, brute(x[left], y[left], w[left], depth - 1, min_leaf), brute(x[~left], y[~left], w[~left], depth - 1, min_leaf))


def walked(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


@pytest.mark.parametrize(("depth", "min_leaf", "unit_bytes"), [(60, 1, 32 << 20), (60, 4, 500), (3, 2, 10)])
def test_forest_equals_brute_force_on_its_bootstraps(spark, depth, min_leaf, unit_bytes, monkeypatch):
    monkeypatch.setattr(growing, "UNIT_BYTES", unit_bytes)
    rng = np.random.default_rng(1)
    x = rng.integers(-6, 6, size=(160, 2)).astype(float)
    y = x[:, 0] * 3 + rng.normal(0, 2, 160)
    pdf = pd.DataFrame(x, columns=["a", "b"]).assign(label=y, key=[f"k{i}" for i in range(160)])
    df = spark.createDataFrame(pdf)
    keys = df.select(F.xxhash64("key")).toPandas().to_numpy()[:, 0]
    model = Forest(["a", "b"], n_estimators=3, max_depth=depth if depth < 60 else None, min_samples_leaf=min_leaf, key="key").fit(df)
    expected = np.zeros(160)
    for t in range(3):
        w = trees.bootstrap_weights(keys, t, 42)
        use = w > 0
        tree = brute(x[use], y[use], w[use], depth, min_leaf)
        expected += [walked(tree, row) / 3 for row in x]
    got = model.transform(df).toPandas()["prediction"].to_numpy()
    assert np.allclose(got, expected, atol=1e-6)


def test_bootstrap_draws_each_row_about_once():
    w = trees.bootstrap_weights(np.arange(200_000), 7, 42)
    share = np.bincount(w, minlength=4)[:4] / len(w)
    assert np.allclose(share, np.exp(-1.0) / np.array([1, 1, 2, 6]), atol=4e-3)
    assert not np.array_equal(w, trees.bootstrap_weights(np.arange(200_000), 8, 42))


def test_sparse_vector_grows_the_trees_of_named_columns(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"c": rng.integers(0, 12, 500), "z": rng.integers(-3, 4, 500).astype(float)})
    pdf["label"] = np.where(pdf.c.isin([3, 5]), 9.0, 0.0) + pdf.z
    names = [f"c_{i}" for i in range(12)] + ["z"]
    wide = spark.createDataFrame(pdf.assign(**{f"c_{i}": (pdf.c == i).astype(float) for i in range(12)}))
    coded = OneHotEncoder(inputCol="c", outputCol="v", dropLast=False).fit(spark.createDataFrame(pdf)).transform(spark.createDataFrame(pdf))
    from pyspark.ml.feature import VectorAssembler

    vector = VectorAssembler(inputCols=["v", "z"], outputCol="features").transform(coded).select("label", "features")
    for model in (BOOSTED, FOREST):
        a = fit_model(model, wide, names, {"n_estimators": 4})
        b = fit_model(model, vector, names, {"n_estimators": 4})
        if model == BOOSTED:
            assert same(a.inner, b.inner)
            assert np.allclose(np.sort(a.transform(wide).toPandas()["prediction"]), np.sort(b.transform(vector).toPandas()["prediction"]))
        assert len(b.inner.trees) == 4
    x, y = fit_model(LINEAR, wide, names).inner, fit_model(LINEAR, vector, names).inner
    assert np.allclose(x.coefficients, y.coefficients, atol=1e-9)


def test_five_thousand_categories(spark):
    """A row is as wide as its text columns, not as their categories."""
    rows = spark.range(20_000).select((F.col("id") % 5000).cast("int").alias("c"), F.when(F.col("id") % 5000 == 77, 50.0).otherwise(1.0).alias("label"))
    vector = OneHotEncoder(inputCol="c", outputCol="features", dropLast=False).fit(rows).transform(rows).select("label", "features")
    names = [f"c_{i}" for i in range(5000)]
    data = growing.TreeRows(vector, names)
    widths = {len(r["cells"]) // r["n"] // data.layout.kind(0).itemsize for r in data.blocks.select("n", "cells").collect()}
    data.release()
    assert widths == {1}
    model = fit_model(BOOSTED, vector, names, {"n_estimators": 2, "max_depth": 2})
    assert model.inner.trees[0].feature[0] == 77


def test_bins_are_equal_shares_whatever_the_partitions(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=3000), np.full(500, 0.0), 1e9 + rng.normal(size=1500), -np.exp(rng.normal(size=1000) * 5)])
    pdf = pd.DataFrame({"x": rng.permutation(x), "label": 1.0})
    edges = []
    for parts in (1, 7):
        data = growing.TreeRows(spark.createDataFrame(pdf).repartition(parts), ["x"], max_bin=50)
        edges.append(data.layout.edges[0])
        data.release()
    assert np.array_equal(edges[0], edges[1]) and 30 <= len(edges[0]) <= 51
    counts = np.diff(np.concatenate(([0], np.searchsorted(np.sort(x), edges[0], side="right"))))
    alone = np.isin(edges[0], [0.0])
    assert counts[~alone].max() <= 2.2 * len(x) / 50
    assert set(edges[0]) <= set(x)


@pytest.mark.parametrize(("model", "grid"), [(BOOSTED, {"n_estimators": [2, 5], "max_depth": [1, 3], "learning_rate": [0.3]}),
                                             (LEAFWISE, {"n_estimators": [3], "num_leaves": [4, 9], "learning_rate": [0.2]}),
                                             (FOREST, {"n_estimators": [2, 4], "max_depth": [3, None], "min_samples_leaf": [2]})])
def test_grid_in_lockstep_equals_separate_fits(spark, model, grid, monkeypatch):
    from tabreg.operators.split import k_fold

    pdf = made(300, 8).drop(columns="d")
    df, names = spark.createDataFrame(pdf), ["a", "b.c"]
    scores = {(r["candidate"], r["fold"]): r["mae"] for r in cv_scores(model, df, names, grid, "key", folds=2).collect()}
    monkeypatch.setattr(growing, "UNIT_BYTES", 700)      # the same search by histogram jobs and small nodes
    again = {(r["candidate"], r["fold"]): r["mae"] for r in cv_scores(model, df.repartition(3), names, grid, "key", folds=2).collect()}
    monkeypatch.undo()
    assert scores == again and len(scores) == 2 * len(param_grid(grid))
    folds = k_fold(df, "key", 2, 43)
    for c, params in enumerate(param_grid(grid)):
        for f in range(2):
            fit = fit_model(model, folds.where(F.col("fold") != f), names, params, key="key")
            out = fit.transform(folds.where(F.col("fold") == f)).toPandas()
            assert scores[c, f] == pytest.approx((out.label - out.prediction).abs().mean(), abs=1e-6), json.dumps(params)


@pytest.mark.parametrize("parts", [1, 5])
def test_least_squares_of_minimum_norm(spark, parts):
    rng = np.random.default_rng(2)
    c, d = rng.integers(0, 4, 300), rng.integers(0, 3, 300)
    x = np.column_stack([rng.normal(50, 10, 300), np.eye(4)[c], np.eye(3)[d], np.ones(300)])
    y = x[:, 0] * 2 + c * 3 - d + rng.normal(0, 0.1, 300) + 1e4
    names = [f"x{i}" for i in range(x.shape[1])]
    model = fit_model(LINEAR, spark.createDataFrame(pd.DataFrame(x, columns=names).assign(label=y)).repartition(parts), names)
    expected = np.linalg.lstsq(x - x.mean(0), y - y.mean(), rcond=None)[0]
    assert np.allclose(model.inner.coefficients, expected, atol=1e-8)
    assert model.inner.intercept == pytest.approx(y.mean() - x.mean(0) @ expected, abs=1e-6)


def test_fewer_rows_than_features_and_no_rows(spark):
    df = spark.createDataFrame(pd.DataFrame({"a": [1.0, 2.0], "b": [0.0, 5.0], "c": [3.0, 3.0], "label": [1.0, 4.0]}))
    model = fit_model(LINEAR, df, ["a", "b", "c"])
    got = model.transform(df).toPandas()
    assert np.allclose(got.prediction, got.label)
    for kind in (LINEAR, BOOSTED, FOREST):
        with pytest.raises(ValueError, match="no training rows"):
            fit_model(kind, df.where("a > 9"), ["a", "b", "c"])


def test_a_forest_with_too_many_nodes_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(growing, "MAX_NODES", 50)
    with pytest.raises(ValueError, match="max_depth"):
        fit_model(FOREST, spark.createDataFrame(made(200)), ["a", "b.c", "d"], {"n_estimators": 2})
