"""A training corpus from raw documents, in five stages; each calls one operator of ``tabreg.llm``.

1. quality classifier: documents predicted to be of low quality go;
2. n-gram Jaccard join: one document of each near-duplicate group stays (the smallest id);
3. substring dedup: words inside repeated windows go; the text is then its other words;
4. benchmark decontamination: documents of which a twentieth or more is benchmark text go;
5. packing: the rest is packed; one row per piece of a document, with its token ids.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows its predecessor kept; all but the
last return the columns of ``docs``. Between stages the rows are written in the shared folder, so
a lost executor costs no more than the stage at hand.

Defined results: a null text is scored as an empty one and then has no words; repeated rows are
near duplicates (one stays); extra columns pass through; an empty table gives empty stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabreg.llm import decontamination, ngram_join, packing, quality, substring_dedup
from tabreg.llm.common import free_name, table, written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    name = free_name(docs, "__score")
    return quality.score(docs, model, name=name).where(F.col(name) >= quality.THRESHOLD).drop(name)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.without_duplicates(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring_dedup.cut_documents(docs, size_col="n_chars" if "n_chars" in docs.columns else None)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.without_contaminated(docs, decontamination.automata(table(spark, sf_dir, "benchmark")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed_documents(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("substrings", cut_repeated_passages),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: Classifier weights and token ids are beyond SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
