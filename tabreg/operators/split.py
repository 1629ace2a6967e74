"""Reproducible sampling (X1-X3) by a seeded hash of the row key.

``randomSplit`` draws per partition, so its rows change with the partitioning and cannot be
repeated in SQL. Here the split of a row depends only on its key and the seed: the same rows land
in the test set on any cluster size and in DuckDB. All three operators are per-row expressions
(no shuffle); the exact-count split adds one distributed order statistic to find its threshold.
"""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import DuplicateKeys
from ..names import column
from .stats import order_statistics

TEST = "test"
TRAIN = "train"
HASHES = 1 << 32


def row_key(key: str) -> Column:
    """The key as text; a row without one is known by all its values, so null keys spread over
    the splits and folds like any other."""
    return F.coalesce(column(key).cast("string"), F.to_json(F.struct("*")))


def key_hash(key: Column, seed: int) -> Column:
    """0 .. 2^32-1 from the first 8 hex digits of md5("<key>:<seed>").

    DuckDB: ``('0x' || substr(md5(key::varchar || ':<seed>'), 1, 8))::bigint``.
    """
    s = F.concat(key.cast("string"), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("bigint")


def hash_bucket(key: Column, seed: int, buckets: int = 100) -> Column:
    return key_hash(key, seed) % F.lit(buckets)


def train_test_split(df: DataFrame, key: str, test_size: float = 0.2, seed: int = 42,
                     out: str = "split") -> DataFrame:
    """Tag every row ``train``/``test``: test when the seeded key hash is below ``test_size`` of
    its range, so any share holds. Expected, not exact, test share; see ``train_test_exact``."""
    test = key_hash(row_key(key), seed) < F.lit(test_size * HASHES)
    return df.withColumn(out, F.when(test, F.lit(TEST)).otherwise(F.lit(TRAIN)))


def train_test_exact(df: DataFrame, key: str, test_size: float = 0.2, seed: int = 42,
                     out: str = "split") -> DataFrame:
    """Exactly ``ceil(test_size * n)`` test rows: the rows with the smallest (hash, key).

    The threshold hash is the k-th smallest hash, found by the distributed order statistic (no
    global sort, no single-partition limit). Rows tied on that hash (about n / 2^32 of them) are
    ordered by key with a top-k over just the tied rows. Rows without a key count, by their
    values. If equal keys stand on both sides of the cut, no rule by key can give the exact count,
    and ``DuplicateKeys`` is raised.
    """
    # The narrow (key, hash) frame feeds a few small jobs; persist it instead of rehashing the source.
    hashed = df.select(row_key(key).alias("_k")).withColumn("_h", key_hash(F.col("_k"), seed))
    hashed = hashed.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n = hashed.count()
        n_test = math.ceil(test_size * n)
        if n_test == 0 or n_test >= n:
            return df.withColumn(out, F.lit(TRAIN if n_test == 0 else TEST))
        found = order_statistics(hashed, {"_h": [n_test - 1]}, {"_h": (n, 0.0, float(HASHES - 1))}, below=True)
        t, n_below = int(found["_h", n_test - 1][0]), found["_h", n_test - 1][1]
        cut = hashed.where(F.col("_h") == t)
        tied = cut.orderBy("_k").limit(n_test - n_below).agg(F.max("_k")).first()[0]
        if cut.where(F.col("_k") <= tied).count() != n_test - n_below:
            raise DuplicateKeys(f"rows that share the key {tied!r} stand on both sides of the cut")
    finally:
        hashed.unpersist()
    own, h = row_key(key), key_hash(row_key(key), seed)
    is_test = (h < F.lit(t)) | ((h == F.lit(t)) & (own <= F.lit(tied)))
    return df.withColumn(out, F.when(is_test, F.lit(TEST)).otherwise(F.lit(TRAIN)))


def k_fold(df: DataFrame, key: str, k: int = 5, seed: int = 43, out: str = "fold") -> DataFrame:
    """Fold number 0..k-1 from a second seeded key hash (disjoint, covering, partition-independent)."""
    return df.withColumn(out, hash_bucket(row_key(key), seed, k).cast("int"))
