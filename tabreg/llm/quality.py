"""Operator 8, quality classifier: a sparse rule ensemble.

Statistics of the whole text (counts of bytes, words and lines; no id, source or language) feed a
forest of shallow trees. Every path from a root is a conjunctive rule; an L1-penalised logistic
regression weighs the rules, most get weight 0, and those left are compiled into one Spark column
expression, which scores any frame that has the statistics.

The forest and the weights are fitted on about ``TRAIN_ROWS`` labelled rows, chosen by hash of the
id; all rows are scored. Rows whose crc32(id) mod 5 is 0 are never learned from.

Defined results: a null text is scored like an empty one; rows with null labels or ids are not
learned from; of several labels of an id the smallest counts; with one class only, or none, every
score is that class's share, or 0.5; repeated rows are scored each on its own; other columns pass.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import chunks, free_name, id_and_bytes, map_columns, table, written
from .language_id import held_out

TRAIN_ROWS = 20_000
TREES, DEPTH = 24, 3
PENALTY = 0.001
THRESHOLD = 0.3
STATS_COL = "__statistics"

#: Bytes by kind, for the shares.
_KINDS = {"upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)), "digit": bytes(range(48, 58)), "space": b" \t",
          "line": b"\n", "stop": b".,;:?", "bang": b"!", "bar": b"|", "mark": b"#$%&*+=@^_~<>\\/{}[]", "quote": b"\"'`()-",
          "high": bytes(range(128, 256))}
_KIND_OF = np.zeros(256, dtype=np.int64)
for _i, _bytes in enumerate(_KINDS.values(), 1):
    _KIND_OF[list(_bytes)] = _i
STATISTICS = (*(f"share_{k}" for k in _KINDS), "log_chars", "log_words", "word_length", "distinct_words", "top_word", "distinct_lines",
              "line_words", "marked_words", "upper_words")


def statistics(text: bytes | None) -> list[float]:
    text = text or b""
    n = len(text)
    kinds = np.bincount(_KIND_OF, weights=np.bincount(np.frombuffer(text, np.uint8), minlength=256), minlength=len(_KINDS) + 1)
    words, lines = text.split(), [x for x in text.split(b"\n") if x.strip()]
    w = max(len(words), 1)
    seen = Counter(words)
    marked = sum(c for x, c in seen.items() if x[-1] in b"#$%&*!|")
    upper = sum(c for x, c in seen.items() if len(x) > 1 and x.isupper())
    return [*(kinds[1:] / max(n, 1)).tolist(), float(np.log1p(n)), float(np.log1p(len(words))), sum(len(x) * c for x, c in seen.items()) / w,
            len(seen) / w, max(seen.values(), default=0) / w, len(set(lines)) / max(len(lines), 1), float(np.log1p(w / max(len(lines), 1))),
            marked / w, upper / w]


def with_statistics(docs: DataFrame, text_col: str = "text", name: str = STATS_COL) -> DataFrame:
    """``docs`` with a struct of the text's statistics as the last column."""
    at = docs.columns.index(text_col)
    struct = StructType([StructField(s, DoubleType()) for s in STATISTICS])
    arrow = pa.struct([(s, pa.float64()) for s in STATISTICS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.append_column("__bytes", batch.column(at).cast(pa.binary()))
            for part, texts in chunks(iter([rows]), "__bytes"):
                values = np.array([statistics(t) for t in texts]).T
                stats = pa.StructArray.from_arrays([pa.array(v) for v in values], fields=list(arrow))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], stats], names=[*batch.schema.names, f"c{len(batch.schema)}"])

    return map_columns(docs, run, StructType([*docs.schema.fields, StructField(name, struct)]))


Rule = tuple[tuple[int, str, float], ...]


def tree_rules(text: str) -> list[Rule]:
    """The conditions on every path of a tree's printed form, each as (feature, <= or >, value)."""
    rules, path = [], []
    for line in text.splitlines():
        if m := re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) ([-+.\dEe]+)\)", line):
            del path[len(m[1]) - 1:]
            path += [None] * (len(m[1]) - 1 - len(path)) + [(int(m[2]), m[3], float(m[4]))]
            tight: dict[tuple[int, str], float] = {}
            for feature, sign, value in filter(None, path):
                old = tight.get((feature, sign), value)
                tight[feature, sign] = min(old, value) if sign == "<=" else max(old, value)
            rules.append(tuple(sorted((f, s, v) for (f, s), v in tight.items())))
    return rules


def rule_sql(rule: Rule, stats: str = STATS_COL) -> str:
    return " AND ".join(f"{stats}.{STATISTICS[f]} {sign} {value!r}D" for f, sign, value in rule)


def _training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, limit: int) -> DataFrame:
    """``label`` and the statistics of about ``limit`` labelled rows."""
    q = lambda c: F.col("`" + c.replace("`", "``") + "`")
    known = labels.select(q(id_col).cast("long").alias("__id"), q(label_col).cast("int").alias("label")).where("label IN (0, 1) AND __id IS NOT NULL")
    known = known.where(~held_out("__id")).groupBy("__id").agg(F.min("label").alias("label"))
    n = known.count()
    share = min(1.0, limit / max(n, 1))
    drawn = known.where(F.pmod(F.xxhash64("__id"), F.lit(1 << 30)) < share * (1 << 30))
    # drawn has about ``limit`` rows of two numbers, whatever the tables' sizes
    rows = id_and_bytes(docs, id_col, text_col).join(F.broadcast(drawn), "__id").dropDuplicates(["__id"])
    return with_statistics(rows, "__text").select("label", STATS_COL)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          limit: int = TRAIN_ROWS) -> str:
    """The score (0 to 1, higher: label 1 likelier) as SQL over the statistics."""
    rows = written(_training_rows(docs, labels, id_col, text_col, label_col, limit).coalesce(8), "quality-training")
    n, ones = rows.agg(F.count("*"), F.sum("label")).first()
    if not n or ones in (0, n):
        return f"{(ones / n) if n else 0.5!r}D"
    features = rows.select(F.col("label").cast("double").alias("label"), array_to_vector(F.array(*[F.col(f"{STATS_COL}.{s}") for s in STATISTICS])).alias("features"), STATS_COL)
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, minInstancesPerNode=max(2, n // 500), subsamplingRate=0.6, maxBins=128, seed=7).fit(features)
    rules = sorted({r for t in forest.trees for r in tree_rules(t.toDebugString)})
    if not rules:
        return f"{ones / n!r}D"
    held = [F.expr(f"IF({rule_sql(r)}, 1D, 0D)") for r in rules]
    fitted = LogisticRegression(elasticNetParam=1.0, regParam=PENALTY, maxIter=60).fit(features.select("label", array_to_vector(F.array(*held)).alias("features")))
    terms = [f"IF({rule_sql(r)}, {float(w)!r}D, 0D)" for r, w in zip(rules, fitted.coefficients.toArray(), strict=True) if abs(w) > 1e-9]
    return f"1D / (1D + exp(-({' + '.join([f'{float(fitted.intercept)!r}D', *terms])})))"


def score(docs: DataFrame, model: str, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with its score as the last column (it replaces a column of that name)."""
    scratch = free_name(docs, STATS_COL)
    scored = with_statistics(docs, text_col, scratch).withColumn(name, F.expr(model.replace(STATS_COL, scratch)))
    return scored.drop(scratch)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs, table(spark, sf_dir, "labels"))
    scored = score(id_and_bytes(docs, "doc_id", "text"), model, "__text")
    return scored.select(F.col("__id").alias("doc_id"), held_out("__id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op8_quality_classifier": op8_quality_classifier}
ORACLE_SQL: dict[str, str] = {}
