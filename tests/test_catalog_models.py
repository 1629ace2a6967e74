"""The registered model queries, run as they are: factory settings, the reference's grid, all four models."""

import json
import math

import pytest

import __spark_entry__ as E
from tabreg.plans import runs
from tabreg.plans.models import BOOSTED, FACTORY, FOREST, LEAFWISE, LINEAR, MODELS
from tabreg.plans.tuning import REFERENCE_GRIDS, param_grid

SF001 = "/root/testdata/sf0.001"


@pytest.fixture()
def fits(monkeypatch):
    """(model, trees, leaves of the largest tree, depth of the deepest) of each real fit."""
    seen, fit_model = [], runs.fit_model

    def fit(model, *args, **kw):
        out = fit_model(model, *args, **kw)
        trees = getattr(out.inner, "trees", [])
        seen.append((model, len(trees), max((int((t.feature < 0).sum()) for t in trees), default=0), max((int(t.depth.max()) for t in trees), default=0)))
        return out

    monkeypatch.setattr(runs, "fit_model", fit)
    return seen


def check(seen):
    for model, trees, leaves, depth in seen:
        if model == BOOSTED:
            assert (trees, depth) == (FACTORY[model]["n_estimators"], FACTORY[model]["max_depth"])
        if model == LEAFWISE:      # 160 rows, 20 a leaf: fewer leaves than the limit
            assert trees == FACTORY[model]["n_estimators"] and 1 < leaves <= FACTORY[model]["num_leaves"]
        if model == FOREST:        # grown until leaves are pure
            assert trees == FACTORY[model]["n_estimators"] and leaves > 60 and depth > 7


@pytest.mark.parametrize(("name", "models"), [("gbt_fit", [BOOSTED]), ("forest_fit", [FOREST]), ("leafwise_fit", [LEAFWISE]), ("importances", [BOOSTED]), ("inspect_run", [LEAFWISE])])
def test_factory_settings(spark, fits, name, models):
    rows = E.queries()[name](spark, SF001).collect()
    assert rows and [f[0] for f in fits] == models
    check(fits)


def test_default_run_and_predictions_agree(spark, fits):
    log = {r["model"]: r for r in E.queries()["default_run"](spark, SF001).collect()}
    rows = E.queries()["predict"](spark, SF001).toPandas()
    assert [f[0] for f in fits] == MODELS * 2
    check(fits)
    for model, run in runs.DEFAULT_RUN_NAMES.items():
        own = rows[rows.model == model]
        assert len(own) == own.doc_id.nunique() > 20
        assert log[run]["mae"] == pytest.approx((own.label - own.prediction).abs().mean(), rel=1e-9)
        assert log[run]["r2"] < 1 and log[run]["total_seconds"] > 0


def test_search_queries_tell_one_story(spark, fits):
    q = E.queries()
    scores = q["cv_scores"](spark, SF001).toPandas()
    grid = param_grid(REFERENCE_GRIDS[BOOSTED])
    assert len(scores) == 5 * len(grid) and [json.loads(p) for p in scores.sort_values(["candidate", "fold"]).params[::5]] == grid
    means = scores.groupby("candidate").mae.mean()
    best = q["cv_best"](spark, SF001).first()
    assert best["candidate"] == means.idxmin() and math.isclose(best["cv_mae"], means.min(), rel_tol=1e-12)
    log = q["search_run"](spark, SF001).first()
    assert json.loads(log["params"]).items() >= json.loads(best["params"]).items() and math.isclose(log["cv_mae"], best["cv_mae"], rel_tol=1e-9)
    tuned = q["tuned_run"](spark, SF001).first()
    assert tuned["mae"] == pytest.approx(log["mae"], rel=1e-9)
    assert q["inspect_search"](spark, SF001).count() == 10
    assert {f[0] for f in fits} == {BOOSTED}


def test_leafwise_reference_grid_ends(spark):
    """The leaf-wise grid (18 candidates) at its full size, on two folds."""
    from tabreg.frames import frame_a

    res = runs.search_run(frame_a(spark, SF001), LEAFWISE, "doc_id", REFERENCE_GRIDS[LEAFWISE], drop=["text"], folds=2)
    assert res.scores.count() == 36 and res.cv_mae > 0
    res.release()


def test_linear_search_takes_the_same_way(spark):
    from tabreg.frames import frame_a

    res = runs.search_run(frame_a(spark, SF001), LINEAR, "doc_id", {"unused": [0, 1]}, drop=["text"], folds=2)
    assert res.scores.count() == 4
    res.release()
