import numpy as np
import pytest
from pyspark.sql import functions as F

from tabreg.errors import DummyNameClash, MissingColumns, MissingLabel
from tabreg.operators import columns as C
from tabreg.operators.prepare import Preparer, prepare


def test_flat_column_scales_to_zero(spark):
    df = spark.createDataFrame([(i, float(i), 5.0) for i in range(5)], "k long, label double, flat double")
    rows, _ = prepare(df, "label", key="k", drop=[])
    assert {r["flat"] for r in rows.collect()} == {0.0}


def test_scaled_mean_zero_std_one_and_dummies_sum_to_one(spark):
    from tabreg.frames import frame_a

    rows, fitted = prepare(frame_a(spark, "/root/testdata/sf0.01"), "label", key="doc_id", drop=["text"])
    st = rows.agg(F.avg("n_words").alias("m"), F.stddev_pop("n_words").alias("s")).collect()[0]
    assert abs(st["m"]) < 1e-9 and abs(st["s"] - 1) < 1e-9
    for c in ("lang", "source"):
        dummies = [n for n in fitted.feature_names if n.startswith(c + "_")]
        sums = rows.select(sum((F.col(d) for d in dummies), F.lit(0)).alias("t")).distinct().collect()
        assert [r["t"] for r in sums] == [1]


def test_feature_order_numeric_then_dummies(spark):
    df = spark.createDataFrame([(1, 10.0, "b", 1.0, "y"), (2, 20.0, "a", 2.0, "x")],
                               "k long, label double, t1 string, n1 double, t2 string")
    fitted = Preparer("label", "k", drop=[]).fit(df)
    assert fitted.feature_names == ["n1", "t1_a", "t1_b", "t2_x", "t2_y"]


def test_unseen_category_all_zero(spark):
    train = spark.createDataFrame([(1, 1.0, "a"), (2, 2.0, "b")], "k long, label double, c string")
    test = spark.createDataFrame([(3, 3.0, "z")], "k long, label double, c string")
    fitted = Preparer("label", "k", drop=[]).fit(train)
    r = fitted.transform(test).collect()[0]
    assert (r["c_a"], r["c_b"]) == (0, 0)


def test_dummy_name_clash(spark):
    df = spark.createDataFrame([(1, 1.0, "c", "b_c")], "k long, label double, a_b string, a string")
    with pytest.raises(DummyNameClash):
        Preparer("label", "k", drop=[]).fit(df)


def test_bool_without_gaps_passes_through(spark):
    df = spark.createDataFrame([(1, 1.0, True), (2, 2.0, False)], "k long, label double, flag boolean")
    fitted = Preparer("label", "k", drop=[]).fit(df)
    assert fitted.feature_names == ["flag"]
    assert sorted(r["flag"] for r in fitted.transform(df).collect()) == [0.0, 1.0]


def test_bool_with_gaps_becomes_text(spark):
    df = spark.createDataFrame([(1, 1.0, True), (2, 2.0, True), (3, 3.0, None), (4, 1.0, False)],
                               "k long, label double, flag boolean")
    fitted = Preparer("label", "k", drop=[]).fit(df)
    assert fitted.feature_names == ["flag_False", "flag_True"]
    got = {r["k"]: (r["flag_False"], r["flag_True"]) for r in fitted.transform(df).collect()}
    assert got[3] == (0, 1)       # mode fill with True
    assert got[4] == (1, 0)


def test_lenient_and_strict_drop(spark):
    df = spark.createDataFrame([(1, 1.0, "x")], "Id long, SalePrice double, Alley string")
    assert C.drop_lenient(df).columns == ["SalePrice"]
    with pytest.raises(MissingColumns) as e:
        C.drop_strict(df)
    assert "PoolQC" in e.value.columns and "Id" not in e.value.columns


def test_no_label(spark):
    df = spark.createDataFrame([(1, 1.0)], "k long, x double")
    with pytest.raises(MissingLabel):
        Preparer("SalePrice", "k", drop=[]).fit(df)


def test_label_never_filled_or_scaled(spark):
    df = spark.createDataFrame([(1, 100.0, 1.0), (2, 300.0, None), (3, 200.0, 3.0)], "k long, label double, x double")
    rows, _ = prepare(df, "label", key="k", drop=[])
    assert sorted(r["label"] for r in rows.collect()) == [100.0, 200.0, 300.0]
    xs = sorted(r["x"] for r in rows.collect())
    assert np.allclose(xs, sorted((np.array([1, 2, 3]) - 2) / np.std([1, 2, 3])))


def test_drop_last_leaves_out_last_category(spark):
    df = spark.createDataFrame([(1, 1.0, "a", 1.0), (2, 2.0, "b", 2.0), (3, 3.0, "c", 2.0)],
                               "k long, label double, t string, x double")
    fitted = Preparer("label", "k", drop=[], drop_last=True).fit(df)
    assert fitted.feature_names == ["x", "t_a", "t_b"]
    assert fitted.transform(df).columns == ["k", "label", "x", "t_a", "t_b"]


def test_fit_scope_train_only(spark):
    from tabreg.frames import frame_a
    from tabreg.plans.runs import fit_and_score

    a = frame_a(spark, "/root/testdata/sf0.01")
    full = fit_and_score(a, "LinearRegression", "doc_id", drop=["text"])
    leak_free = fit_and_score(a, "LinearRegression", "doc_id", drop=["text"], fit_scope="train")
    assert leak_free.metrics["n"] == full.metrics["n"] == 182
    assert leak_free.prep.scale["n_words"] != full.prep.scale["n_words"]
    assert leak_free.metrics["r2"] > 0.7


def test_sparse_vector_equals_dense_columns(spark):
    from pyspark.ml.functions import vector_to_array

    from tabreg.frames import frame_a

    a = frame_a(spark, "/root/testdata/sf0.01")
    fitted = Preparer("label", "doc_id", drop=["text"]).fit(a)
    dense = fitted.transform(a)
    vec = fitted.to_vector(a).select("doc_id", vector_to_array("features").alias("v"))
    got = {r["doc_id"]: r["v"] for r in vec.collect()}
    for r in dense.collect():
        want = [float(r[n]) for n in fitted.feature_names]
        assert np.allclose(got[r["doc_id"]], want)
    unseen = spark.createDataFrame([(10**9, 1.0, 5.0, "xx", "zz", "t")], a.schema)
    v = fitted.to_vector(unseen).select(vector_to_array("features").alias("v")).collect()[0]["v"]
    assert sum(v[1:]) == 0.0


def test_sparse_run_matches_dense_run(spark):
    from tabreg.frames import frame_a
    from tabreg.plans.runs import fit_and_score

    a = frame_a(spark, "/root/testdata/sf0.01")
    dense = fit_and_score(a, "GradientBoosting", "doc_id", drop=["text"], params={"n_estimators": 5})
    sparse = fit_and_score(a, "GradientBoosting", "doc_id", drop=["text"], params={"n_estimators": 5}, sparse=True)
    assert abs(dense.metrics["mae"] - sparse.metrics["mae"]) < 1e-6
