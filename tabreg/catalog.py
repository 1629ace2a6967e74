"""Registered queries: one per operator of the inventory, each over whole driver tables.

Every query reads the driver tables (through the frames of FIXTURES.md) and returns a DataFrame.
``ORACLE_SQL`` holds the DuckDB statement for each query that SQL can express; computed columns
carry the same aliases on both sides, and doubles that depend on summation order are rounded the
same way on both sides. Boosting is checked round by round on stumps, a forest by one tree on all rows,
and least squares by elimination; what SQL can't express of the larger fits is checked by row count here and
against brute force in the tests.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import frame_a, frame_b, frame_l
from .functions import formats as fmt
from .functions.metrics import evaluate_frame
from .operators import columns as C
from .operators import stats as S
from .operators.prepare import Preparer, fill_median_expr, fill_mode_expr, one_hot_exprs, scale_expr
from .operators.split import TEST, TRAIN, k_fold, train_test_exact, train_test_split
from .plans import reports
from .plans.models import BOOSTED, FOREST, LEAFWISE, LINEAR, MODELS, fit_model
from .plans.leafwise import Forest
from .plans.tuning import REFERENCE_GRIDS, best_candidate, mean_scores
from .session import fresh_dir
from .sources.csv import read_csv, write_csv

A_KEY, B_KEY = "doc_id", "p_partkey"
A_DROP = ["text"]
A_NUMERIC, A_TEXT = ["n_words"], ["lang", "source"]
B_DROP = ["p_name", "Id", "Alley"]         # two names are absent: the lenient drop ignores them
SEED, FOLD_SEED = 42, 43
STUMPS = {"n_estimators": 2, "max_depth": 1, "learning_rate": 0.1}
#: Bins that tell all word counts apart, as SQL does.
EXACT = 32_000
STUMP_GRID = {"n_estimators": [1, 2], "max_depth": [1], "learning_rate": [0.1, 0.5]}


# ---------------------------------------------------------------- shared pieces

def _a(spark, d):
    return frame_a(spark, d)


def _a_medians(a: DataFrame) -> dict:
    return S.fit_medians(a, A_NUMERIC)


def _a_filled(a: DataFrame) -> DataFrame:
    """Frame A with median / mode fills (no scaling): doc_id, label, n_words, lang, source."""
    med = _a_medians(a)
    modes = S.fit_modes(a, A_TEXT)
    return a.select(A_KEY, "label", fill_median_expr("n_words", med["n_words"]).alias("n_words"),
                    *[fill_mode_expr(c, modes[c]).alias(c) for c in A_TEXT])


def _a_fixed_prediction(spark, d) -> DataFrame:
    """Test rows of the seed-42 split with the fixed linear prediction 7 * n_words (filled)."""
    f = train_test_split(_a_filled(_a(spark, d)), A_KEY, 0.2, SEED)
    return (f.where(F.col("split") == TEST)
            .select(A_KEY, "label", (F.lit(7.0) * F.col("n_words")).alias("prediction")))


def _a_prepared(spark, d, scale=True):
    a = _a(spark, d)
    prep = Preparer(label="label", key=A_KEY, drop=A_DROP, scale=scale).fit(a)
    return prep, prep.transform(a)


def _rounded(df: DataFrame, cols: list[str], digits: int) -> DataFrame:
    return df.select(*[F.round(F.col(c), digits).alias(c) if c in cols else F.col(c) for c in df.columns])


def _run(spark, d, model):
    """E1 on frame A with the model's factory settings."""
    from .plans.runs import default_run

    return default_run(_a(spark, d), model, A_KEY, drop=A_DROP)


# ---------------------------------------------------------------- sources, projections

def q_csv_scan(spark, d):
    b = frame_b(spark, d).drop("p_name")
    path = fresh_dir(spark, "csv_scan")
    write_csv(b, path)
    return read_csv(spark, path)


def q_drop_lenient(spark, d):
    return C.drop_lenient(frame_b(spark, d), B_DROP)


def q_drop_strict(spark, d):
    return C.drop_strict(frame_b(spark, d), ["p_name"])


def q_label_split(spark, d):
    df, _ = C.split_label(C.drop_lenient(frame_b(spark, d), B_DROP), "label", B_KEY)
    return df


def q_column_roles(spark, d):
    df, feats = C.split_label(C.drop_lenient(frame_b(spark, d), B_DROP), "label", B_KEY)
    roles = C.column_roles(df, feats)
    gaps = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.lit(roles[c]).alias("role"),
                 F.col(c).isNull().cast("long").alias("gap")) for c in feats])).alias("s")).select("s.*")
    return gaps.groupBy("feature", "role").agg(F.sum("gap").alias("n_missing"))


def q_feature_names(spark, d):
    prep, _ = _a_prepared(spark, d)
    return C.feature_name_frame(spark, prep.feature_names)


def q_assemble(spark, d):
    """The vector's slots, a row each, rounded as in ``prepare``."""
    prep, rows = _a_prepared(spark, d)
    vectors = C.assemble(rows, prep.feature_names).select(A_KEY, vector_to_array("features").alias("slots"))
    return vectors.select(A_KEY, F.posexplode("slots").alias("slot", "value")).withColumn("value", F.round("value", 9))


# ---------------------------------------------------------------- fitted statistics

def q_fit_median(spark, d):
    prep, _ = _a_prepared(spark, d)
    return spark.createDataFrame([(c, float(v)) for c, v in prep.medians.items()], "feature string, median double")


def q_fit_mode(spark, d):
    prep, _ = _a_prepared(spark, d)
    return spark.createDataFrame(list(prep.modes.items()), "feature string, mode string")


def q_fit_scale(spark, d):
    prep, _ = _a_prepared(spark, d)
    rows = spark.createDataFrame([(c, *v) for c, v in prep.scale.items()], "feature string, mean double, std double")
    return rows.select("feature", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


def q_category_domain(spark, d):
    return S.domain_table(_a(spark, d), A_TEXT).select(F.col("column").alias("feature"), "value")


# ---------------------------------------------------------------- transforms

def q_fill_median(spark, d):
    a = _a(spark, d)
    med = _a_medians(a)
    return a.select(A_KEY, fill_median_expr("n_words", med["n_words"]).alias("n_words"))


def q_fill_mode(spark, d):
    a = _a(spark, d)
    modes = S.fit_modes(a, A_TEXT)
    return a.select(A_KEY, *[fill_mode_expr(c, modes[c]).alias(c) for c in A_TEXT])


def q_standard_scale(spark, d):
    f = _a_filled(_a(spark, d))
    (mean, std), = S.fit_scale(f, ["n_words"]).values()
    return f.select(A_KEY, F.round(scale_expr(F.col("n_words"), mean, std), 9).alias("n_words"))


def q_one_hot(spark, d):
    a = _a(spark, d)
    domains = _a_prepared(spark, d)[0].domains
    return a.select(A_KEY, *[e for c in A_TEXT for e in one_hot_exprs(c, F.col(c), domains[c])])


def q_prepare(spark, d):
    _, rows = _a_prepared(spark, d)
    return _rounded(rows, ["n_words"], 9)


def q_prepare_unscaled(spark, d):
    _, rows = _a_prepared(spark, d, scale=False)
    return rows


# ---------------------------------------------------------------- sampling

def q_train_test_split(spark, d):
    return train_test_split(_a(spark, d).select(A_KEY), A_KEY, 0.2, SEED)


def q_train_test_exact(spark, d):
    return train_test_exact(_a(spark, d).select(A_KEY), A_KEY, 0.2, SEED)


def q_k_fold(spark, d):
    t = train_test_split(_a(spark, d).select(A_KEY), A_KEY, 0.2, SEED)
    return k_fold(t.where(F.col("split") == TRAIN).select(A_KEY), A_KEY, 5, FOLD_SEED)


# ---------------------------------------------------------------- scores and reports (fixed prediction)

def q_metrics(spark, d):
    m = evaluate_frame(_a_fixed_prediction(spark, d))
    return m.select("n", F.round("mae", 6).alias("mae"), F.round("r2", 9).alias("r2"))


def q_residuals(spark, d):
    return reports.residual_rows(_a_fixed_prediction(spark, d), A_KEY)


def q_best_k(spark, d):
    return reports.best_k(_a_fixed_prediction(spark, d), A_KEY, 5)


def q_worst_k(spark, d):
    return reports.worst_k(_a_fixed_prediction(spark, d), A_KEY, 5)


def q_ideal_line(spark, d):
    return reports.ideal_line(_a_fixed_prediction(spark, d))


def q_report_tables(spark, d):
    """The three tables behind the charts (residuals, ideal line, importances of least squares),
    written and read back, as rows of one shape."""
    path = fresh_dir(spark, "reports")
    reports.write_report_tables(path, _a_fixed_prediction(spark, d), A_KEY, _run(spark, d, LINEAR).importances())
    text, none = F.lit(None).cast("string"), F.lit(None).cast("double")
    residuals = spark.read.parquet(f"{path}/residuals").select(F.lit("residuals").alias("chart"), F.col(A_KEY).cast("string").alias("name"), F.col("label").alias("x"), F.col("residual").alias("y"))
    line = spark.read.parquet(f"{path}/ideal_line").select(F.lit("ideal_line"), text, "line_min", "line_max")
    bars = spark.read.parquet(f"{path}/importances").select(F.lit("importances"), "feature", F.round("importance", 5), none)
    return residuals.union(line).union(bars)


def q_best_and_worst(spark, d):
    return reports.best_and_worst(_a_fixed_prediction(spark, d), A_KEY, 5)


def q_format_fields(spark, d):
    a = _a(spark, d)
    x = F.col("label") / F.lit(7.0)
    ratio = F.col("label") / (F.col("label") + F.lit(1000.0))
    ts = F.expr("timestamp_ntz'2025-11-12 00:07:00' + make_dt_interval(0, 0, 0, doc_id * 61)")
    return a.select(A_KEY, fmt.fixed(x, 4).alias("fixed4"), fmt.money(x).alias("money"),
                    fmt.grouped_int(F.col("label") * F.lit(13.5)).alias("grouped"),
                    fmt.percent(ratio).alias("percent"), fmt.run_date(ts).alias("run_date"))


# ---------------------------------------------------------------- models

def q_linear_one(spark, d):
    """One-feature least squares through Spark ML, checked against regr_slope / regr_intercept."""
    f = train_test_split(_a_filled(_a(spark, d)), A_KEY, 0.2, SEED)
    train = f.where(F.col("split") == TRAIN)
    m = fit_model(LINEAR, train, ["n_words"])
    coef = float(m.inner.coefficients[0])
    icpt = float(m.inner.intercept)
    return (train.agg(F.count("*").alias("n"))
            .select("n", F.round(F.lit(coef), 6).alias("slope"), F.round(F.lit(icpt), 4).alias("intercept")))


def _rounded_scores(df):
    return _rounded(_rounded(df, ["mae"], 5), ["r2"], 8)


def q_linear_fit(spark, d):
    return _rounded_scores(_run(spark, d, LINEAR).summary())


def q_gbt_fit(spark, d):
    return _run(spark, d, BOOSTED).summary()


def q_forest_fit(spark, d):
    return _run(spark, d, FOREST).summary()


def q_leafwise_fit(spark, d):
    return _run(spark, d, LEAFWISE).summary()


def q_predict(spark, d):
    """M5: the test rows scored by each of the four models."""
    scored = [_run(spark, d, model).scored.withColumn("model", F.lit(model)) for model in MODELS]
    return reduce(DataFrame.unionByName, scored)


def q_importances(spark, d):
    return _run(spark, d, BOOSTED).importances()


def q_importances_top(spark, d):
    return _rounded(reports.top_importances(_run(spark, d, LINEAR).importances(), 20), ["importance"], 5)


def q_default_run(spark, d):
    """M6: the log rows of the factory runs of the four models."""
    return reduce(DataFrame.unionByName, [_run(spark, d, model).log() for model in MODELS])


def q_stump_split(spark, d):
    """One round of leaf-wise boosting with two leaves on ``part``: the exact best split of
    ``p_size`` for ``p_retailprice`` (50 distinct sizes, one bin each)."""
    from .plans.leafwise import LeafwiseBooster

    raw = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_retailprice").alias("label"), "p_size")
    m = LeafwiseBooster(["p_size"], n_estimators=1, num_leaves=2, min_child_samples=20).fit(raw)
    rows = [(f, thr, nl, nr, round(lv, 6), round(rv, 6), round(g, 2)) for f, thr, nl, nr, lv, rv, g in m.stump_rows()]
    return spark.createDataFrame(rows, "feature string, threshold double, n_left long, n_right long, "
                                       "left_value double, right_value double, gain double")


def q_boosted_rounds(spark, d):
    """M2 and M5: two rounds of depth-1 boosting of ``p_retailprice`` by ``p_size``, and what it
    predicts for each size: the label mean plus shrunk leaf values."""
    raw = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_retailprice").alias("label"), "p_size")
    fitted = fit_model(BOOSTED, raw, ["p_size"], {"n_estimators": 2, "max_depth": 1})
    return fitted.transform(raw.select("p_size").distinct()).select("p_size", F.round("prediction", 6).alias("prediction"))


def _search(spark, d):
    """The reference's grid search of boosted trees on frame A."""
    from .plans.runs import search_run

    return search_run(_a(spark, d), BOOSTED, A_KEY, REFERENCE_GRIDS[BOOSTED], drop=A_DROP)


def q_cv_scores(spark, d):
    return _search(spark, d).scores


def q_cv_best(spark, d):
    return best_candidate(_search(spark, d).scores)


def q_search_run(spark, d):
    return _search(spark, d).log()


def q_params_roundtrip(spark, d):
    """A parameter set for each source, derived from its documents, written as JSON (S3) and read back."""
    from .sources.params import read_params_rows, write_params_rows

    rows = _a(spark, d).groupBy("source").agg(F.count("*").alias("n"), F.max("label").alias("top"))
    few = F.col("n") % 2 == 0
    rows = rows.select((F.lit(1.0) / (F.lit(1.0) + F.col("n"))).alias("learning_rate"), F.when(few, (F.col("top") % 7).cast("int")).alias("max_depth"),
                       F.col("n").cast("int").alias("n_estimators"), F.when(~few, (F.col("top") % 31).cast("int")).alias("num_leaves"))
    path = fresh_dir(spark, "params")
    write_params_rows(rows, path)
    return read_params_rows(spark, path)


def q_tuned_run(spark, d):
    """The saved best parameters drive the final fit (model inferred from their shape, M8)."""
    import json

    from .plans.runs import final_run
    from .sources.params import write_params

    res = _search(spark, d)
    path = fresh_dir(spark, "params")
    write_params(spark, json.loads(res.fitted.params_json()), path)
    return final_run(_a(spark, d), None, A_KEY, path, drop=A_DROP).summary()


def q_run_log(spark, d):
    """E1 runs of two models (least squares, two boosted stumps) appended to one fresh log and read back
    (S5); the clock's columns are only looked at for sense."""
    from .plans.runs import default_run
    from .sources.runlog import append_run_log, read_run_log

    path = fresh_dir(spark, "run_log")
    append_run_log(_run(spark, d, LINEAR).log(), path)
    append_run_log(default_run(_a(spark, d), BOOSTED, A_KEY, drop=A_DROP, params=STUMPS, name="GBR_Stumps", max_bins=EXACT).log(), path)
    sensible = (F.col("total_seconds") >= 0) & F.col("run_at").isNotNull()
    return _rounded_scores(read_run_log(spark, path).select("model", "mae", "r2", "params", "cv_mae", sensible.alias("timed")))


def q_boosted_stumps(spark, d):
    """M2, M5: two rounds of boosted stumps over all prepared features of frame A, and the test rows' predictions."""
    from .plans.runs import default_run

    scored = default_run(_a(spark, d), BOOSTED, A_KEY, drop=A_DROP, params=STUMPS, max_bins=EXACT).scored
    return _rounded(scored, ["prediction"], 5)


def q_search_stumps(spark, d):
    """Fold scores of a grid of boosted stumps (rounds x rate), all grown together."""
    from .plans.runs import search_run

    res = search_run(_a(spark, d), BOOSTED, A_KEY, STUMP_GRID, drop=A_DROP, max_bins=EXACT)
    return _rounded(res.scores.select("candidate", "params", "fold", "mae"), ["mae"], 5)


def q_forest_tree(spark, d):
    """M4: one tree of a forest on all rows of ``part`` (no bootstrap), two levels deep, and what it says of each size."""
    raw = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_retailprice").alias("label"), "p_size")
    tree = Forest(["p_size"], n_estimators=1, max_depth=2, bootstrap=False).fit(raw)
    return _rounded(tree.transform(raw.select("p_size").distinct()), ["prediction"], 6)


def _fold_scores(spark, d) -> DataFrame:
    """Fold scores of fixed predictors (5 to 9 characters a word) on the training rows."""
    rows = k_fold(train_test_split(_a_filled(_a(spark, d)), A_KEY, 0.2, SEED).where(F.col("split") == TRAIN), A_KEY, 5, FOLD_SEED)
    cands = F.array(*[F.struct(F.lit(i).alias("candidate"), F.lit(5.0 + i).alias("rate")) for i in range(5)])
    rows = rows.withColumn("c", F.explode(cands)).select("c.*", "fold", "label", "n_words")
    error = F.abs(F.col("label") - F.col("rate") * F.col("n_words"))
    return rows.groupBy("candidate", F.format_string("{\"rate\": %.1f}", "rate").alias("params"), "fold").agg(F.avg(error).alias("mae"))


def q_fold_means(spark, d):
    """Mean score of each fixed predictor over the folds."""
    return _rounded(mean_scores(_fold_scores(spark, d)), ["cv_mae"], 6)


def q_fold_best(spark, d):
    """The predictor of the lowest mean score."""
    return _rounded(best_candidate(_fold_scores(spark, d)), ["cv_mae"], 6)


def q_inspect_run(spark, d):
    """Strict drop, unscaled preparation, leaf-wise boosting, the best and worst five."""
    from .plans.runs import inspect_run

    return inspect_run(_a(spark, d), LEAFWISE, A_KEY, drop=A_DROP)[1]


def q_inspect_search(spark, d):
    """E5: the same after the reference's boosted grid search."""
    from .plans.runs import inspect_search

    return inspect_search(_a(spark, d), BOOSTED, A_KEY, REFERENCE_GRIDS[BOOSTED], drop=A_DROP)[1]


def q_lines_linear(spark, d):
    """Frame L (volume): default linear run over all line items; rows of one order line share a split."""
    from .plans.runs import default_run

    return _rounded_scores(default_run(frame_l(spark, d, by_line=True), LINEAR, "row_key", drop=[]).summary())


QUERIES = {
    "csv_scan": q_csv_scan,
    "drop_lenient": q_drop_lenient,
    "drop_strict": q_drop_strict,
    "label_split": q_label_split,
    "column_roles": q_column_roles,
    "feature_names": q_feature_names,
    "assemble": q_assemble,
    "fit_median": q_fit_median,
    "fit_mode": q_fit_mode,
    "fit_scale": q_fit_scale,
    "category_domain": q_category_domain,
    "fill_median": q_fill_median,
    "fill_mode": q_fill_mode,
    "standard_scale": q_standard_scale,
    "one_hot": q_one_hot,
    "prepare": q_prepare,
    "prepare_unscaled": q_prepare_unscaled,
    "train_test_split": q_train_test_split,
    "train_test_exact": q_train_test_exact,
    "k_fold": q_k_fold,
    "metrics": q_metrics,
    "residuals": q_residuals,
    "best_k": q_best_k,
    "worst_k": q_worst_k,
    "ideal_line": q_ideal_line,
    "format_fields": q_format_fields,
    "report_tables": q_report_tables,
    "best_and_worst": q_best_and_worst,
    "boosted_rounds": q_boosted_rounds,
    "linear_one": q_linear_one,
    "linear_fit": q_linear_fit,
    "gbt_fit": q_gbt_fit,
    "forest_fit": q_forest_fit,
    "leafwise_fit": q_leafwise_fit,
    "predict": q_predict,
    "importances": q_importances,
    "importances_top": q_importances_top,
    "default_run": q_default_run,
    "lines_linear": q_lines_linear,
    "stump_split": q_stump_split,
    "boosted_stumps": q_boosted_stumps,
    "search_stumps": q_search_stumps,
    "forest_tree": q_forest_tree,
    "fold_means": q_fold_means,
    "fold_best": q_fold_best,
    "cv_scores": q_cv_scores,
    "cv_best": q_cv_best,
    "search_run": q_search_run,
    "params_roundtrip": q_params_roundtrip,
    "tuned_run": q_tuned_run,
    "run_log": q_run_log,
    "inspect_run": q_inspect_run,
    "inspect_search": q_inspect_search,
}


# ---------------------------------------------------------------- oracle SQL (DuckDB)

FRAME_A_SQL = """a AS (
  SELECT doc_id, CAST(n_chars AS DOUBLE) AS label,
         CASE WHEN doc_id % 7 = 0 THEN NULL
              ELSE CAST(length(text) - length(replace(text, ' ', '')) + 1 AS DOUBLE) END AS n_words,
         CASE WHEN doc_id % 11 = 0 THEN NULL ELSE lang END AS lang,
         source
  FROM documents)"""

FRAME_B_SQL = """b AS (
  SELECT p_partkey, p_retailprice AS label,
         CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_size END AS p_size,
         p_brand,
         CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_type END AS p_type,
         p_name
  FROM part)"""

FILLED_SQL = FRAME_A_SQL + """,
med AS (SELECT median(n_words) AS m FROM a),
modes AS (
  SELECT feature, value AS mode FROM (
    SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY n DESC, value) AS rn
    FROM (SELECT feature, value, count(*) AS n FROM (
            SELECT 'lang' AS feature, lang AS value FROM a UNION ALL SELECT 'source', source FROM a)
          WHERE value IS NOT NULL GROUP BY feature, value))
  WHERE rn = 1),
f AS (
  SELECT doc_id, label, coalesce(n_words, (SELECT m FROM med)) AS n_words,
         coalesce(lang, (SELECT mode FROM modes WHERE feature = 'lang')) AS lang,
         coalesce(source, (SELECT mode FROM modes WHERE feature = 'source')) AS source
  FROM a)"""


def _hash_sql(seed: int) -> str:
    return f"('0x' || substr(md5(CAST(doc_id AS VARCHAR) || ':{seed}'), 1, 8))::BIGINT"


SPLIT_SQL = f"CASE WHEN {_hash_sql(SEED)} < 0.2 * 4294967296 THEN 'test' ELSE 'train' END"

FIXED_PRED_SQL = FILLED_SQL + f""",
t AS (SELECT doc_id, label, 7.0 * n_words AS prediction FROM f WHERE {SPLIT_SQL} = 'test')"""

# The category domains of frame A at the oracle scale, for writing dummy columns in SQL.
LANGS = ["de", "en", "es", "fr"]
SOURCES = [f"src{i}" for i in range(20)]


def _dummies_sql(lang_col="lang", source_col="source") -> str:
    parts = [f"CASE WHEN {lang_col} = '{v}' THEN 1 ELSE 0 END AS lang_{v}" for v in LANGS]
    parts += [f"CASE WHEN {source_col} = '{v}' THEN 1 ELSE 0 END AS source_{v}" for v in SOURCES]
    return ",\n         ".join(parts)


ORACLE_SQL = {
    "csv_scan": f"WITH {FRAME_B_SQL} SELECT p_partkey, label, CAST(p_size AS BIGINT) AS p_size, p_brand, p_type FROM b",
    "drop_lenient": f"WITH {FRAME_B_SQL} SELECT p_partkey, label, p_size, p_brand, p_type FROM b",
    "drop_strict": f"WITH {FRAME_B_SQL} SELECT p_partkey, label, p_size, p_brand, p_type FROM b",
    "label_split": f"WITH {FRAME_B_SQL} SELECT p_partkey, label, p_size, p_brand, p_type FROM b",
    "column_roles": f"""WITH {FRAME_B_SQL}
        SELECT 'p_size' AS feature, 'numeric' AS role, count(*) - count(p_size) AS n_missing FROM b
        UNION ALL SELECT 'p_brand', 'categorical', count(*) - count(p_brand) FROM b
        UNION ALL SELECT 'p_type', 'categorical', count(*) - count(p_type) FROM b""",
    "feature_names": f"""WITH {FRAME_A_SQL},
        d AS (SELECT DISTINCT 'lang' AS f, 1 AS o, lang AS v FROM a WHERE lang IS NOT NULL
              UNION ALL SELECT DISTINCT 'source', 2, source FROM a WHERE source IS NOT NULL)
        SELECT 0 AS pos, 'n_words' AS name
        UNION ALL SELECT CAST(row_number() OVER (ORDER BY o, v) AS INTEGER), f || '_' || v FROM d""",
    "fit_median": f"WITH {FRAME_A_SQL} SELECT 'n_words' AS feature, median(n_words) AS median FROM a",
    "fit_mode": f"WITH {FILLED_SQL} SELECT feature, mode FROM modes",
    "fit_scale": f"""WITH {FILLED_SQL}
        SELECT 'n_words' AS feature, round(avg(n_words), 6) AS mean, round(stddev_pop(n_words), 6) AS std FROM f""",
    "category_domain": f"""WITH {FRAME_A_SQL}
        SELECT DISTINCT 'lang' AS feature, lang AS value FROM a WHERE lang IS NOT NULL
        UNION ALL SELECT DISTINCT 'source', source FROM a WHERE source IS NOT NULL""",
    "fill_median": f"WITH {FILLED_SQL} SELECT doc_id, n_words FROM f",
    "fill_mode": f"WITH {FILLED_SQL} SELECT doc_id, lang, source FROM f",
    "standard_scale": f"""WITH {FILLED_SQL}, s AS (SELECT avg(n_words) AS m, stddev_pop(n_words) AS sd FROM f)
        SELECT doc_id, round((n_words - (SELECT m FROM s)) / (SELECT sd FROM s), 9) AS n_words FROM f""",
    "one_hot": f"WITH {FRAME_A_SQL} SELECT doc_id, {_dummies_sql()} FROM a",
    "prepare": f"""WITH {FILLED_SQL}, s AS (SELECT avg(n_words) AS m, stddev_pop(n_words) AS sd FROM f)
        SELECT doc_id, label, round((n_words - (SELECT m FROM s)) / (SELECT sd FROM s), 9) AS n_words,
         {_dummies_sql()} FROM f""",
    "prepare_unscaled": f"WITH {FILLED_SQL} SELECT doc_id, label, n_words, {_dummies_sql()} FROM f",
    "train_test_split": f"SELECT doc_id, {SPLIT_SQL} AS split FROM documents",
    "train_test_exact": f"""WITH h AS (SELECT doc_id, {_hash_sql(SEED)} AS h FROM documents),
        r AS (SELECT doc_id, row_number() OVER (ORDER BY h, doc_id) AS rn, count(*) OVER () AS n FROM h)
        SELECT doc_id, CASE WHEN rn <= ceil(0.2 * n) THEN 'test' ELSE 'train' END AS split FROM r""",
    "k_fold": f"""SELECT doc_id, CAST({_hash_sql(FOLD_SEED)} % 5 AS INTEGER) AS fold
        FROM documents WHERE {SPLIT_SQL} = 'train'""",
    "metrics": f"""WITH {FIXED_PRED_SQL}
        SELECT count(*) AS n, round(avg(abs(label - prediction)), 6) AS mae,
               round(1 - sum((label - prediction) * (label - prediction)) / (var_pop(label) * count(*)), 9) AS r2
        FROM t""",
    "residuals": f"""WITH {FIXED_PRED_SQL}
        SELECT doc_id, label, prediction, label - prediction AS residual, abs(label - prediction) AS abs_error FROM t""",
    "best_k": f"""WITH {FIXED_PRED_SQL}
        SELECT doc_id, label, prediction, label - prediction AS residual, abs(label - prediction) AS abs_error
        FROM t ORDER BY abs_error, doc_id LIMIT 5""",
    "worst_k": f"""WITH {FIXED_PRED_SQL}
        SELECT doc_id, label, prediction, label - prediction AS residual, abs(label - prediction) AS abs_error
        FROM t ORDER BY abs_error DESC, doc_id LIMIT 5""",
    "ideal_line": f"""WITH {FIXED_PRED_SQL}
        SELECT least(min(label), min(prediction)) AS line_min, greatest(max(label), max(prediction)) AS line_max FROM t""",
    "format_fields": f"""WITH {FRAME_A_SQL}
        SELECT doc_id, format('{{:.4f}}', label / 7.0) AS fixed4, format('{{:,.2f}}', label / 7.0) || ' $' AS money,
               format('{{:,.0f}}', label * 13.5) AS grouped,
               '%' || format('{{:.0f}}', label / (label + 1000.0) * 100.0) AS percent,
               strftime(TIMESTAMP '2025-11-12 00:07:00' + to_seconds(doc_id * 61), '%Y-%m-%d %H:%M') AS run_date
        FROM a""",
    "linear_one": f"""WITH {FILLED_SQL}
        SELECT count(*) AS n, round(regr_slope(label, n_words), 6) AS slope,
               round(regr_intercept(label, n_words), 4) AS intercept
        FROM f WHERE {SPLIT_SQL} = 'train'""",
    "stump_split": """WITH h AS (SELECT p_size AS v, sum(p_retailprice) AS g, count(*) AS n FROM part GROUP BY p_size),
        c AS (SELECT v, sum(g) OVER (ORDER BY v) AS gl, sum(n) OVER (ORDER BY v) AS nl,
                     sum(g) OVER () AS gt, sum(n) OVER () AS nt FROM h),
        s AS (SELECT v, gl, nl, gt - gl AS gr, nt - nl AS nr, gt, nt FROM c WHERE nl >= 20 AND nt - nl >= 20)
        SELECT 'p_size' AS feature, CAST(v AS DOUBLE) AS threshold, CAST(nl AS BIGINT) AS n_left,
               CAST(nr AS BIGINT) AS n_right, round(gl / nl - gt / nt, 6) AS left_value,
               round(gr / nr - gt / nt, 6) AS right_value,
               round(gl * gl / nl + gr * gr / nr - gt * gt / nt, 2) AS gain
        FROM s ORDER BY gl * gl / nl + gr * gr / nr - gt * gt / nt DESC, v LIMIT 1""",
}
# ---- least squares: normal equations without the last category of each text column, by elimination
_SCALED_SQL = FILLED_SQL + """,
s AS (SELECT avg(n_words) AS m, stddev_pop(n_words) AS sd FROM f)"""


def _solved_sql(rows: str) -> str:
    """The least-squares coefficients ``beta`` of the rows ``(label, v)``, v a list that starts with 1."""
    return f"""q AS (SELECT list_append(v, label) AS v FROM ({rows})),
    pairs AS (SELECT i, j, sum(v[i] * v[j]) AS a FROM q, (SELECT unnest(range(1, len(v) + 1)) AS i FROM (SELECT v FROM q LIMIT 1)) x,
              (SELECT unnest(range(1, len(v) + 1)) AS j FROM (SELECT v FROM q LIMIT 1)) y WHERE i < len(v) GROUP BY i, j),
    lines AS (SELECT i, list(a ORDER BY j) AS line FROM pairs GROUP BY i),
    e AS (SELECT 1 AS k, list(line ORDER BY i) AS a FROM lines
          UNION ALL SELECT k + 1, list_transform(a, lambda line, i: CASE WHEN i = k THEN list_transform(line, lambda x: x / line[k])
              ELSE list_transform(line, lambda x, j: x - line[k] * a[k][j] / a[k][k]) END) FROM e WHERE k <= len(a)),
    beta AS (SELECT list_transform(a, lambda line: line[len(line)]) AS b FROM e WHERE k > len(a))"""


def _design_sql(numeric: list[str], text: dict[str, list[str]]) -> str:
    """Constant, numbers and dummies of a row, without the last category of each column."""
    return "[1.0, " + ", ".join(numeric + [f"CASE WHEN {c} = '{v}' THEN 1.0 ELSE 0.0 END" for c, vs in text.items() for v in vs[:-1]]) + "]"


_A_DESIGN = _design_sql(["(n_words - (SELECT m FROM s)) / (SELECT sd FROM s)"], {"lang": LANGS, "source": SOURCES})
_A_SOLVED = f"""WITH RECURSIVE {_SCALED_SQL}, {_solved_sql(f"SELECT label, {_A_DESIGN} AS v FROM f WHERE {SPLIT_SQL} = 'train'")}"""
_SUMMARY_SQL = """count(*) AS n_test, round(avg(abs(label - p)), 5) AS mae,
    round(1 - sum((label - p) * (label - p)) / (var_pop(label) * count(*)), 8) AS r2"""
_A_TESTED = f"SELECT label, list_dot_product({_A_DESIGN}, b) AS p FROM f, beta WHERE {SPLIT_SQL} = 'test'"
ORACLE_SQL["linear_fit"] = f"{_A_SOLVED} SELECT 'LR_Default' AS model, {_SUMMARY_SQL} FROM ({_A_TESTED})"
# Of all solutions the one of least norm: within a text column the coefficients have mean 0.
_A_IMPORTANCES = f"""c AS (SELECT [b[2]] || list_transform(l, lambda x: x - list_avg(l)) || list_transform(z, lambda x: x - list_avg(z)) AS c FROM (
        SELECT b, list_append(b[3:{len(LANGS) + 1}], 0.0) AS l, list_append(b[{len(LANGS) + 2}:], 0.0) AS z FROM beta)),
    names AS (SELECT list_prepend('n_words', list_concat({["lang_" + v for v in LANGS]}, list_transform(list_sort({SOURCES}), lambda v: 'source_' || v))) AS names),
    imp AS (SELECT CAST(pos - 1 AS INTEGER) AS pos, names[pos] AS feature, round(abs(c[1 + CASE WHEN pos <= {len(LANGS) + 1} THEN pos - 1
              ELSE {len(LANGS)} + list_position({SOURCES}, substr(names[pos], 8)) END]), 5) AS importance
            FROM c, names, (SELECT unnest(range(1, {len(LANGS) + len(SOURCES) + 2})) AS pos))"""
ORACLE_SQL["importances_top"] = f"{_A_SOLVED}, {_A_IMPORTANCES} SELECT * FROM imp ORDER BY importance DESC, feature LIMIT 20"
ORACLE_SQL["report_tables"] = f"""{_A_SOLVED}, {_A_IMPORTANCES},
    t AS (SELECT doc_id, label, 7.0 * n_words AS prediction FROM f WHERE {SPLIT_SQL} = 'test')
    SELECT 'residuals' AS chart, CAST(doc_id AS VARCHAR) AS name, label AS x, label - prediction AS y FROM t
    UNION ALL SELECT 'ideal_line', NULL, least(min(label), min(prediction)), greatest(max(label), max(prediction)) FROM t
    UNION ALL SELECT 'importances', feature, importance, NULL FROM imp"""
_L_TEXT = {"l_returnflag": ["A", "N", "R"], "l_linestatus": ["F", "O"]}    # fixed values: the domains of these columns
_L_DESIGN = _design_sql([f"({c} - m_{c}) / d_{c}" for c in ("l_quantity", "l_discount", "l_tax")], _L_TEXT)
_L_HASH = f"('0x' || substr(md5(CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) || ':{SEED}'), 1, 8))::BIGINT < 0.2 * 4294967296"
_L_STATS = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS d_{c}" for c in ("l_quantity", "l_discount", "l_tax"))
ORACLE_SQL["lines_linear"] = f"""WITH RECURSIVE st AS (SELECT {_L_STATS} FROM lineitem),
    l AS (SELECT l_extendedprice AS label, {_L_DESIGN} AS v, {_L_HASH} AS test FROM lineitem, st),
    {_solved_sql("SELECT label, v FROM l WHERE NOT test")}
    SELECT 'LR_Default' AS model, {_SUMMARY_SQL} FROM (SELECT label, list_dot_product(v, b) AS p FROM l, beta WHERE test)"""
_SLOTS = [f"CASE WHEN lang = '{v}' THEN 1.0 ELSE 0.0 END" for v in LANGS] + [f"CASE WHEN source = '{v}' THEN 1.0 ELSE 0.0 END" for v in sorted(SOURCES)]
ORACLE_SQL["assemble"] = f"""WITH {_SCALED_SQL},
    v AS (SELECT doc_id, [round((n_words - (SELECT m FROM s)) / (SELECT sd FROM s), 9), {", ".join(_SLOTS)}]::DOUBLE[] AS slots FROM f)
    SELECT doc_id, CAST(i - 1 AS INTEGER) AS slot, slots[i] AS value FROM v, (SELECT unnest(range(1, {len(_SLOTS) + 2})) AS i)"""
ORACLE_SQL["params_roundtrip"] = f"""WITH {FRAME_A_SQL}, p AS (SELECT source, count(*) AS n, max(label) AS top FROM a GROUP BY source)
    SELECT 1.0::DOUBLE / (1.0::DOUBLE + n) AS learning_rate, CASE WHEN n % 2 = 0 THEN CAST(top % 7 AS INTEGER) END AS max_depth, CAST(n AS INTEGER) AS n_estimators,
           CASE WHEN n % 2 = 1 THEN CAST(top % 31 AS INTEGER) END AS num_leaves, NULL::INTEGER AS min_samples_leaf, NULL::INTEGER AS min_child_samples FROM p"""
_FOLDS_SQL = f"""{FILLED_SQL},
    sc AS (SELECT CAST(c AS INTEGER) AS candidate, format('{{{{"rate": {{:.1f}}}}}}', 5.0 + c) AS params, {_hash_sql(FOLD_SEED)} % 5 AS fold, avg(abs(label - (5.0 + c) * n_words)) AS mae
           FROM f, (SELECT unnest(range(0, 5)) AS c) WHERE {SPLIT_SQL} = 'train' GROUP BY ALL),
    me AS (SELECT candidate, params, avg(mae) AS cv_mae FROM sc GROUP BY candidate, params)"""
ORACLE_SQL["fold_means"] = f"WITH {_FOLDS_SQL} SELECT candidate, params, round(cv_mae, 6) AS cv_mae FROM me"
ORACLE_SQL["fold_best"] = f"WITH {_FOLDS_SQL} SELECT candidate, params, round(cv_mae, 6) AS cv_mae FROM me ORDER BY me.cv_mae, candidate LIMIT 1"


# ---- boosted stumps over all features of frame A, for several models (k: rate, rows that they see)
def _stumps_sql(models: str, seen: str) -> str:
    """``p2``: for each model k and row the predictions after one and after two rounds. A feature's
    place in the order of names settles ties, then the lower value."""
    out = f"""{_SCALED_SQL}, models AS ({models}),
    names AS (SELECT feature, row_number() OVER (ORDER BY o, feature) AS place FROM (
        SELECT DISTINCT 'lang_' || lang AS feature, 1 AS o FROM f UNION SELECT DISTINCT 'source_' || source, 2 FROM f)),
    x AS (SELECT doc_id, 0 AS place, (n_words - (SELECT m FROM s)) / (SELECT sd FROM s) AS v FROM f
          UNION ALL SELECT doc_id, place, CASE WHEN feature IN ('lang_' || lang, 'source_' || source) THEN 1.0 ELSE 0.0 END FROM f, names),
    base AS (SELECT k, rate, doc_id, label, {seen} AS seen FROM f, models),
    p0 AS (SELECT k, rate, doc_id, label, seen, avg(label) FILTER (seen) OVER (PARTITION BY k) AS p FROM base)"""
    for r in (1, 2):
        out += f""",
    h{r} AS (SELECT k, place, v, sum(label - p) AS g, CAST(count(*) AS DOUBLE) AS n FROM p{r - 1} JOIN x USING (doc_id) WHERE seen GROUP BY k, place, v),
    c{r} AS (SELECT k, place, v, sum(g) OVER w AS gl, sum(n) OVER w AS nl, sum(g) OVER (PARTITION BY k, place) AS gt, sum(n) OVER (PARTITION BY k, place) AS nt
             FROM h{r} WINDOW w AS (PARTITION BY k, place ORDER BY v)),
    b{r} AS (SELECT k, place, v AS cut, gl / nl AS lo, (gt - gl) / (nt - nl) AS hi FROM c{r} WHERE nl < nt
             QUALIFY row_number() OVER (PARTITION BY k ORDER BY round(gl * gl / nl + (gt - gl) * (gt - gl) / (nt - nl) - gt * gt / nt, 3) DESC, place, v) = 1),
    p{r} AS (SELECT p{r - 1}.* EXCLUDE (p), p + rate * CASE WHEN v <= cut THEN lo ELSE hi END AS p{"" if r == 2 else ", p + rate * CASE WHEN v <= cut THEN lo ELSE hi END AS once"}
             FROM p{r - 1} JOIN b{r} USING (k) JOIN x USING (doc_id, place))"""
    return out


_STUMPS = _stumps_sql("SELECT 0 AS k, 0.1 AS rate", f"{SPLIT_SQL} = 'train'")
ORACLE_SQL["boosted_stumps"] = f"WITH {_STUMPS} SELECT doc_id, label, round(p, 5) AS prediction FROM p2 WHERE NOT seen"
ORACLE_SQL["run_log"] = f"""SELECT model, mae, r2, NULL::VARCHAR AS params, NULL::DOUBLE AS cv_mae, true AS timed FROM ({ORACLE_SQL["linear_fit"]})
    UNION ALL SELECT 'GBR_Stumps', mae, r2, '{json.dumps(STUMPS, sort_keys=True)}', NULL, true FROM (WITH {_STUMPS} SELECT {_SUMMARY_SQL} FROM p2 WHERE NOT seen)"""
_GRID_STUMPS = _stumps_sql(f"SELECT c * 5 + fold AS k, c, fold, CASE c WHEN 0 THEN 0.1 ELSE 0.5 END AS rate FROM (SELECT unnest([0, 1]) AS c), (SELECT unnest(range(0, 5)) AS fold)",
                           f"{SPLIT_SQL} = 'train' AND {_hash_sql(FOLD_SEED)} % 5 <> k % 5")
ORACLE_SQL["search_stumps"] = f"""WITH {_GRID_STUMPS}
    SELECT CAST(2 * (k // 5) + rounds - 1 AS INTEGER) AS candidate, format('{{{{"learning_rate": {{}}, "max_depth": 1, "n_estimators": {{}}}}}}', CASE WHEN k < 5 THEN '0.1' ELSE '0.5' END, rounds) AS params,
           CAST(k % 5 AS INTEGER) AS fold, round(avg(abs(label - CASE rounds WHEN 1 THEN once ELSE p END)), 5) AS mae
    FROM p2, (SELECT unnest([1, 2]) AS rounds) WHERE {SPLIT_SQL} = 'train' AND NOT seen GROUP BY k, rounds"""


def _level_sql(k: int) -> str:
    """One level of a tree on ``p_size``: the best split of each node of ``n{k}`` (node, v, g, n), and the nodes below."""
    return f"""c{k} AS (SELECT *, sum(g) OVER w AS gl, sum(n) OVER w AS nl, sum(g) OVER (PARTITION BY node) AS gt, sum(n) OVER (PARTITION BY node) AS nt FROM n{k} WINDOW w AS (PARTITION BY node ORDER BY v)),
    b{k} AS (SELECT node, v AS cut FROM c{k} WHERE nl < nt AND gl * gl / nl + (gt - gl) * (gt - gl) / (nt - nl) > gt * gt / nt
             QUALIFY row_number() OVER (PARTITION BY node ORDER BY gl * gl / nl + (gt - gl) * (gt - gl) / (nt - nl) DESC, v) = 1),
    n{k + 1} AS (SELECT 2 * node + CASE WHEN v <= cut THEN 0 ELSE 1 END AS node, v, g, n FROM n{k} LEFT JOIN b{k} USING (node))"""


ORACLE_SQL["forest_tree"] = f"""WITH n0 AS (SELECT 1 AS node, p_size AS v, sum(p_retailprice - 1000) AS g, CAST(count(*) AS DOUBLE) AS n FROM part GROUP BY p_size),
    {_level_sql(0)}, {_level_sql(1)}
    SELECT v AS p_size, round(1000 + sum(g) OVER (PARTITION BY node) / sum(n) OVER (PARTITION BY node), 6) AS prediction FROM n2"""
ORACLE_SQL["best_and_worst"] = f"""SELECT *, 'best' AS kind FROM ({ORACLE_SQL["best_k"]})
    UNION ALL SELECT *, 'worst' AS kind FROM ({ORACLE_SQL["worst_k"]})"""


def _round_sql(k: int) -> str:
    """One boosting round in SQL: the best split of the residual sums in ``r{k}`` and its leaf
    values, then the residual sums after the shrunk update."""
    return f"""c{k} AS (SELECT v, g, n, sum(g) OVER (ORDER BY v) AS gl, sum(n) OVER (ORDER BY v) AS nl, sum(g) OVER () AS gt, sum(n) OVER () AS nt FROM r{k}),
    b{k} AS (SELECT v AS cut, gl / nl AS lo, (gt - gl) / (nt - nl) AS hi FROM c{k} WHERE nl < nt
             ORDER BY gl * gl / nl + (gt - gl) * (gt - gl) / (nt - nl) DESC, v LIMIT 1),
    r{k + 1} AS (SELECT v, g - n * 0.1 * CASE WHEN v <= cut THEN lo ELSE hi END AS g, n,
                 p + 0.1 * CASE WHEN v <= cut THEN lo ELSE hi END AS p FROM r{k}, b{k})"""


ORACLE_SQL["boosted_rounds"] = f"""WITH h AS (SELECT p_size AS v, sum(p_retailprice) AS g, CAST(count(*) AS DOUBLE) AS n FROM part GROUP BY p_size),
    m AS (SELECT sum(g) / sum(n) AS m FROM h), r1 AS (SELECT v, g - n * m AS g, n, m AS p FROM h, m),
    {_round_sql(1)}, {_round_sql(2)}
    SELECT v AS p_size, round(p, 6) AS prediction FROM r3"""


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLE_SQL)
