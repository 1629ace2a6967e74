"""Modelling frames over the driver tables (see FIXTURES.md).

The driver tables hold no gaps, so gaps are injected by fixed formulas that DuckDB can repeat in
the oracle SQL. Every frame reads only the columns it needs, so the parquet scan is pruned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Spaces + 1, over the whole text."""
    return (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + F.lit(1)).cast("double")


def frame_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles: label ``n_chars``; ``n_words`` and ``lang`` carry injected gaps; ``text`` is dropped later."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id"),
        F.col("n_chars").cast("double").alias("label"),
        F.when(F.col("doc_id") % 7 == 0, F.lit(None).cast("double")).otherwise(word_count(F.col("text"))).alias("n_words"),
        F.when(F.col("doc_id") % 11 == 0, F.lit(None).cast("string")).otherwise(F.col("lang")).alias("lang"),
        F.col("source"),
        F.col("text"),
    )


def frame_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts: key ``p_partkey``, label ``p_retailprice``; gaps in ``p_size`` and ``p_type``."""
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey"),
        F.col("p_retailprice").alias("label"),
        F.when(F.col("p_partkey") % 7 == 0, F.lit(None).cast("int")).otherwise(F.col("p_size")).alias("p_size"),
        F.col("p_brand"),
        F.when(F.col("p_partkey") % 11 == 0, F.lit(None).cast("string")).otherwise(F.col("p_type")).alias("p_type"),
        F.col("p_name"),
    )


L_FEATURES = ["l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


def frame_l(spark: SparkSession, sf_dir: str, by_line: bool = False) -> DataFrame:
    """Line items, volume only. ``(l_orderkey, l_linenumber)`` is not unique, so the row key hashes
    every column: exact copies share a key and therefore always land in the same split. ``by_line``
    takes order and line number as the key, which SQL can repeat."""
    li = table(spark, sf_dir, "lineitem")
    key = F.concat_ws("-", "l_orderkey", "l_linenumber") if by_line else F.xxhash64(*[F.col(c) for c in li.columns])
    return li.select(
        key.alias("row_key"),
        F.col("l_extendedprice").alias("label"),
        *[F.col(c) for c in L_FEATURES],
    )
