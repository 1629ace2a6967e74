import math
import os

import pytest
from pyspark.sql import functions as F

from tabreg.errors import SourceNotFound
from tabreg.operators.split import k_fold, train_test_exact, train_test_split
from tabreg.sources.csv import read_csv
from tabreg.sources.params import read_params, write_params
from tabreg.sources.runlog import append_run_log, log_row, read_run_log

SF01 = "/root/testdata/sf0.01"


def _docs(spark):
    return spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id")


@pytest.mark.parametrize("parts", [1, 5])
def test_split_cover_disjoint_partition_independent(spark, parts):
    base = {r["doc_id"]: r["split"] for r in train_test_split(_docs(spark), "doc_id").collect()}
    again = {r["doc_id"]: r["split"] for r in train_test_split(_docs(spark).repartition(parts), "doc_id").collect()}
    assert base == again
    assert set(base.values()) == {"train", "test"}
    assert len(base) == _docs(spark).count()


def test_exact_split_count_and_order(spark):
    got = train_test_exact(_docs(spark).repartition(3), "doc_id", 0.2, 42)
    n = _docs(spark).count()
    assert got.where(F.col("split") == "test").count() == math.ceil(0.2 * n)


def test_folds_cover_train_rows(spark):
    train = train_test_split(_docs(spark), "doc_id").where(F.col("split") == "train")
    folds = k_fold(train, "doc_id", 5)
    counts = {r["fold"]: r["count"] for r in folds.groupBy("fold").count().collect()}
    assert set(counts) == set(range(5)) and sum(counts.values()) == train.count()


def test_na_markers_csv(spark, tmp_dir):
    path = os.path.join(tmp_dir, "na_markers.csv")
    with open(path, "w") as f:
        f.write("Id,x,t\n1,NA,NA\n2,None,None\n3,,\n4,N/A,N/A\n5,2.5,hello\n6,3,\n")
    df = read_csv(spark, path)
    assert dict(df.dtypes) == {"Id": "bigint", "x": "double", "t": "string"}
    rows = {r["Id"]: (r["x"], r["t"]) for r in df.collect()}
    assert rows[1] == rows[2] == rows[3] == rows[4] == (None, None)
    assert rows[5] == (2.5, "hello") and rows[6] == (3.0, None)


def test_missing_source(spark, tmp_dir):
    with pytest.raises(SourceNotFound):
        read_csv(spark, os.path.join(tmp_dir, "absent.csv"))
    with pytest.raises(SourceNotFound):
        read_params(spark, os.path.join(tmp_dir, "absent.json"))


def test_params_roundtrip(spark, tmp_dir):
    from bench import BEST_PARAMS

    for params in BEST_PARAMS.values():
        path = os.path.join(tmp_dir, f"p{len(params)}{sorted(params)[0]}")
        assert write_params(spark, params, path)
        assert read_params(spark, path) == params


def test_run_log_append(spark, tmp_dir):
    path = os.path.join(tmp_dir, "log")
    append_run_log(log_row(spark, "LR_Default", 1.0, 0.5, None, None, 0.123), path)
    append_run_log(log_row(spark, "GBR_Final", 2.0, 0.6, '{"n_estimators": 5}', 3.0, 1.0), path)
    rows = sorted(read_run_log(spark, path).collect(), key=lambda r: r["model"])
    assert [r["model"] for r in rows] == ["GBR_Final", "LR_Default"]
    assert rows[1]["total_seconds"] == 0.12 and rows[0]["cv_mae"] == 3.0
