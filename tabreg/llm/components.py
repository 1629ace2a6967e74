"""Distributed connected components, and the small tools that the pair operators share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reachable) of every node in ``edges`` (``a, b``, long).

    Every round gives each node, and its parent, the smallest parent among its neighbours, then
    replaces parents by their parents, so rounds grow with the logarithm of the longest path. All
    state stays in tables; a round ends in a written one, and only a sum reaches the driver. Nodes
    with very many neighbours are met by partial aggregation and by joins that Spark can split.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = written(both.where("a <> b").distinct(), "edges")
    parents = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("parent")), "parents")
    total = F.sum(F.col("parent").cast("decimal(38,0)"))
    before = parents.agg(total).first()[0]
    while before is not None:
        near = both.join(parents.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("parent").alias("near"))
        hooked = parents.join(near, "node").select(F.explode(F.array(
            F.struct("node", F.least("parent", "near").alias("parent")),
            F.struct(F.col("parent").alias("node"), F.least("parent", "near").alias("parent")))).alias("x")).select("x.*")
        hooked = written(hooked.groupBy("node").agg(F.min("parent").alias("parent")), "hooked")
        up = hooked.select(F.col("node").alias("parent"), F.col("parent").alias("grandparent"))
        parents = written(hooked.join(up, "parent").select("node", F.col("grandparent").alias("parent")), "parents")
        after = parents.agg(total).first()[0]
        if after == before:
            break
        before = after
    return parents.withColumnRenamed("parent", "component")


def pair_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of ``n`` rows the first row that it is joined with by the pairs, directly or not."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        old = root.copy()
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        np.minimum.at(root, old[i], low)
        np.minimum.at(root, old[j], low)
        root = root[root]
        if np.array_equal(root, old):
            break
    return root


def tile_count(size: F.Column, limit: int) -> F.Column:
    """Work units that each row of a group of ``size`` rows goes to."""
    return F.when(size <= limit, F.lit(1)).otherwise(F.ceil(size / F.lit(limit // 2))).cast("int")


def tiles(size: F.Column, hashed: F.Column, limit: int) -> F.Column:
    """Work units of a row in a group of ``size`` rows: one if the group fits ``limit`` rows, else
    the group is dealt into tiles of about half that, and the row goes to each pair of tiles that
    has its own. A unit is (smaller, larger, own) tile."""
    n = tile_count(size, limit)
    own = F.pmod(hashed, n).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda t: F.struct(F.least(t, own).alias("low"), F.greatest(t, own).alias("high"), own.alias("own")))
