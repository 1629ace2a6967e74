import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from tabreg.plans.runs import default_run, final_run, search_run
from tabreg.sources.csv import read_csv
from tabreg.sources.runlog import read_run_log
from tabreg.streaming.scoring import score_stream

SF01 = "/root/testdata/sf0.01"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["model", "n_test", "mae", "r2"] and len(rows) == 1


def _norm(v):
    return "NULL" if v is None else (repr(round(v, 9)) if isinstance(v, float) else str(v))


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF01}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF01)
    rel = duck.sql(E.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(rel.columns, rel.fetchall())


def _house_like(path, n=200, seed=0):
    """Generated house-like CSV with the reference's named columns plus a few features."""
    rnd = random.Random(seed)
    with open(path, "w") as f:
        f.write("Id,LotArea,YearBuilt,Street,Zone,Alley,PoolQC,Fence,MiscFeature,FireplaceQu,MasVnrType,SalePrice\n")
        for i in range(1, n + 1):
            area = rnd.randint(2000, 20000)
            year = rnd.randint(1900, 2010)
            street = rnd.choice(["Pave", "Grvl"])
            zone = rnd.choice(["RL", "RM", "FV", "NA"])
            price = 20000 + area * 8 + (year - 1900) * 900 + (15000 if street == "Pave" else 0) + rnd.randint(-5000, 5000)
            area_txt = "NA" if i % 13 == 0 else str(area)
            f.write(f"{i},{area_txt},{year},{street},{zone},NA,,NA,None,Gd,None,{price}\n")


def test_house_like_csv_end_to_end(spark, tmp_dir):
    csv = os.path.join(tmp_dir, "train.csv")
    _house_like(csv)
    raw = read_csv(spark, csv)
    log = os.path.join(tmp_dir, "log")
    reports_dir = os.path.join(tmp_dir, "reports")
    res = default_run(raw, "LinearRegression", key="Id", label="SalePrice", log_path=log, report_path=reports_dir)
    assert spark.read.parquet(f"{reports_dir}/residuals").count() == res.metrics["n"]
    assert spark.read.parquet(f"{reports_dir}/importances").count() == len(res.prep.feature_names)
    assert set(res.prep.feature_names) >= {"LotArea", "YearBuilt", "Street_Grvl", "Street_Pave", "Zone_RL"}
    assert not any(c.startswith(("Alley", "PoolQC", "Fence")) for c in res.prep.feature_names)
    assert res.metrics["r2"] > 0.8
    assert read_run_log(spark, log).count() == 1


def test_search_then_final_run_same_params(spark, tmp_dir):
    from tabreg.frames import frame_a

    a = frame_a(spark, SF01)
    params_path = os.path.join(tmp_dir, "best")
    grid = {"n_estimators": [3, 6], "max_depth": [2], "learning_rate": [0.1]}
    s = search_run(a, "GradientBoosting", "doc_id", grid, drop=["text"], params_path=params_path, folds=3)
    assert s.scores.count() == 6 and s.cv_mae > 0
    f = final_run(a, "GradientBoosting", "doc_id", params_path, drop=["text"])
    assert f.fitted.params["n_estimators"] == s.fitted.params["n_estimators"]
    assert abs(f.metrics["mae"] - s.metrics["mae"]) < 1e-9


def test_stream_scoring(spark, tmp_dir):
    from tabreg.frames import frame_a

    a = frame_a(spark, SF01)
    res = default_run(a, "LinearRegression", "doc_id", drop=["text"])
    src = os.path.join(tmp_dir, "incoming")
    a.limit(50).write.parquet(src)
    stream = spark.readStream.schema(a.schema).parquet(src)
    q = (score_stream(stream, res.prep, res.fitted).writeStream.format("memory").queryName("scored_stream")
         .option("checkpointLocation", os.path.join(tmp_dir, "ckpt")).start())
    q.processAllAvailable()
    q.stop()
    got = spark.sql("SELECT * FROM scored_stream")
    assert got.count() == 50 and got.where(F.col("prediction").isNull()).count() == 0
