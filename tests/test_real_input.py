"""Input as it comes: odd names, gaps of every kind, repeated keys, ordinary CSV."""

import math
import random

import pytest
from pyspark.sql import functions as F
from tabreg.errors import DuplicateKeys, RaggedRows, TooManyCategories, UnsupportedColumn
from tabreg.operators import stats as S
from tabreg.operators.columns import assemble
from tabreg.operators.prepare import Preparer
from tabreg.operators.split import k_fold, train_test_exact, train_test_split
from tabreg.plans.runs import default_run, search_run
from tabreg.sources.csv import read_csv
from tabreg.sources.params import params_frame, read_params, write_params


def medians(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(4)
    return S.fit_medians(df, ["x"], buckets=64)["x"]


def test_median_of_odd_values(spark):
    inf, nan = math.inf, math.nan
    assert medians(spark, [1.0, nan, 3.0, None, 4.0, nan]) == 3.0
    assert medians(spark, [inf, 1.0, 2.0]) == 2.0
    assert medians(spark, [-inf, -inf, 5.0, inf, inf]) == 5.0
    assert medians(spark, [-inf, -inf, -inf, 0.0, inf]) == -inf
    assert medians(spark, [1.7e308, -1.7e308, 1.6e308, -1.6e308, 5e-324]) == 5e-324
    assert medians(spark, [5e-324, 0.0, 5e-324, 1e-323, 0.0]) == 5e-324
    wide = [(-1) ** i * 10.0 ** (i % 600 - 300) for i in range(1201)]
    assert medians(spark, wide) == sorted(wide)[600]


def house(spark, n=120):
    rows = [(i, float(i % 17 + (i % 3) * 5), float("nan") if i % 11 == 0 else float(i % 17), ["1.5Fin", "2Story", "a`b", None][i % 4]) for i in range(n)]
    return spark.createDataFrame(rows, "`the.key` long, label double, `area.sq` double, `style.x` string")


@pytest.mark.parametrize("model", ["LinearRegression", "GradientBoosting", "RandomForest", "LGBM"])
def test_dotted_and_quoted_names_in_every_model(spark, model):
    params = {} if model == "LinearRegression" else {"n_estimators": 2}
    res = default_run(house(spark), model, "the.key", drop=[], params=params)
    assert "style.x_1.5Fin" in res.prep.feature_names and "style.x_a`b" in res.prep.feature_names
    assert res.metrics["n"] > 0 and math.isfinite(res.metrics["mae"])
    res.release()


def test_assemble_keeps_order(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "`a.b` double, `c` double")
    assert assemble(df, ["c", "a.b"]).first()["features"].toArray().tolist() == [2.0, 1.0]


def test_nan_is_a_gap(spark):
    df = spark.createDataFrame([(1, 0.0, 1.0), (2, 0.0, math.nan), (3, 0.0, 3.0), (4, 0.0, None)], "k long, label double, x double")
    fitted = Preparer(label="label", key="k", drop=[], scale=False).fit(df)
    assert sorted(r["x"] for r in fitted.transform(df).collect()) == [1.0, 2.0, 2.0, 3.0]


def test_dates_are_refused(spark):
    df = spark.createDataFrame([(1, 0.0)], "k long, label double").withColumn("day", F.current_date())
    with pytest.raises(UnsupportedColumn, match="day"):
        Preparer(label="label", key="k", drop=[]).fit(df)


def test_many_categories(spark):
    df = spark.range(1500).select(F.col("id").alias("k"), F.col("id").cast("double").alias("label"), F.concat(F.lit("c"), F.col("id")).alias("c"))
    assert len(Preparer(label="label", key="k", drop=[]).fit(df).feature_names) == 1500
    res = default_run(df, "LinearRegression", "k", drop=[], sparse=True)
    assert res.metrics["n"] > 0
    res.release()


@pytest.mark.parametrize("share", [0.004, 0.125])
def test_small_and_odd_shares(spark, share):
    n = train_test_split(spark.range(20_000), "id", share).where("split = 'test'").count()
    assert abs(n - share * 20_000) < 4 * math.sqrt(share * 20_000)


def test_null_keys_are_rows_like_others(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 2 == 0, F.col("id")).alias("k.y"), F.col("id").alias("v"))
    assert train_test_exact(df, "k.y", 0.2).where("split = 'test'").count() == 200
    assert train_test_split(df, "k.y", 0.2).where("split = 'test' AND `k.y` IS NULL").count() > 50
    assert k_fold(df, "k.y").where("fold IS NULL").count() == 0


def test_repeated_keys_cannot_be_cut_exactly(spark):
    df = spark.range(1000).select((F.col("id") % 10).alias("k"))
    with pytest.raises(DuplicateKeys):
        train_test_exact(df, "k", 0.25)
    assert train_test_exact(df, "k", 0.2).where("split = 'test'").count() == 200


def write(tmp_dir, text):
    with open(f"{tmp_dir}/x.csv", "w") as f:
        f.write(text)
    return f"{tmp_dir}/x.csv"


def test_ordinary_csv(spark, tmp_dir):
    path = write(tmp_dir, 'a,b.c,n,big,t\n1,"he said ""hi, you""",1D,12345678901234567890, NA \n2,"x",2F,5,NA\n')
    df = read_csv(spark, path)
    assert dict(df.dtypes) == {"a": "bigint", "b.c": "string", "n": "string", "big": "double", "t": "string"}
    rows = sorted(tuple(r) for r in df.collect())
    assert rows[0] == (1, 'he said "hi, you"', "1D", 12345678901234567890.0, " NA ") and rows[1][4] is None


def test_csv_line_breaks_in_quotes(spark, tmp_dir):
    path = write(tmp_dir, 'a,b\n1,"two\nlines"\n2,y\n')
    assert sorted(tuple(r) for r in read_csv(spark, path, multi_line=True).collect()) == [(1, "two\nlines"), (2, "y")]


def test_csv_strict(spark, tmp_dir):
    path = write(tmp_dir, "a,b\n1,2\n3,4,5\n6\n")
    for multi_line in (False, True):
        assert read_csv(spark, path, strict=False, multi_line=multi_line).count() == 3
        with pytest.raises(RaggedRows, match="2 rows"):
            read_csv(spark, path, multi_line=multi_line)


@pytest.mark.parametrize("block", [64, 1 << 20])
def test_quoted_csv_in_blocks_reads_like_the_whole(spark, tmp_dir, block):
    rng = random.Random(1)
    words = ["x", "two\nlines", 'he said ""hi""', "a,b", "", "\n\n", '""', "été", "long " * 30, "\r\nend"]
    rows = [[str(i)] + [rng.choice(words) for _ in range(3)] for i in range(40)]
    text = "id,b.c,d,e\n" + "".join(",".join(r[:1] + [f'"{v}"' for v in r[1:]]) + rng.choice(["\n", "\r\n"]) for r in rows)
    path = write(tmp_dir, text)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in old:
            spark.conf.set(k, str(block))
        got = read_csv(spark, path, infer=False, multi_line=True, na_values=[]).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    expected = sorted(tuple(r[:1] + [v.replace('""', '"') for v in r[1:]]) for r in rows)
    assert sorted(tuple(v or "" for v in r) for r in got) == expected


def test_a_killed_write_leaves_the_old_parameters(spark, tmp_dir, monkeypatch):
    path = f"{tmp_dir}/p"
    assert write_params(spark, {"n_estimators": 5}, path)
    monkeypatch.setattr("tabreg.sources.params.delete_dir", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):      # killed after the new file came to stand beside the old one
        write_params(spark, {"n_estimators": 7}, path)
    assert read_params(spark, path) == {"n_estimators": 7}
    monkeypatch.undo()
    monkeypatch.setattr("pyspark.sql.readwriter.DataFrameWriter.json", lambda *_a, **_k: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):      # killed before that
        write_params(spark, {"n_estimators": 9}, path)
    monkeypatch.undo()
    assert read_params(spark, path) == {"n_estimators": 7}
    assert write_params(spark, {"max_depth": 2}, path)
    assert read_params(spark, path) == {"max_depth": 2} and spark.read.text(path).count() == 1


def test_a_column_that_names_rows_is_refused(spark, monkeypatch):
    monkeypatch.setattr(S, "CATEGORY_ROWS", 100)
    df = spark.range(500).select(F.col("id").alias("k"), F.col("id").cast("double").alias("label"), F.col("id").cast("string").alias("c"))
    with pytest.raises(TooManyCategories):
        Preparer(label="label", key="k", drop=[]).fit(df)


@pytest.mark.parametrize("model", ["LinearRegression", "GradientBoosting", "RandomForest"])
def test_runs_do_not_depend_on_input_partitions(spark, model):
    params = {} if model == "LinearRegression" else {"n_estimators": 3}
    maes = []
    for parts in (2, 64):
        res = default_run(house(spark).repartition(parts), model, "the.key", drop=[], params=params)
        maes.append(res.metrics["mae"])
        res.release()
    assert maes[0] == pytest.approx(maes[1], rel=1e-9)


def test_params_names(spark, tmp_dir):
    with pytest.raises(ValueError, match="nonsense"):
        write_params(spark, {"nonsense": 1}, f"{tmp_dir}/p")
    assert params_frame(spark, {"min_child_samples": 20, "num_leaves": 31}).first()["min_child_samples"] == 20


def test_search_with_many_categories(spark):
    df = spark.range(1200).select(F.col("id").alias("k"), (F.col("id") % 7).cast("double").alias("label"), F.concat(F.lit("c."), F.col("id")).alias("c"))
    res = search_run(df, "LinearRegression", "k", {"unused": [0]}, drop=[], sparse=True, folds=2)
    assert res.scores.count() == 2
    res.release()
