"""Operator 3, embedding near-duplicates: random-hyperplane sign hashing in several tables.

Equal vectors of a label are one class first, so copies are never paired. Each class gets ``tables``
signatures of ``bits`` signs; classes with an equal signature in some table are candidates, and
their cosine is verified in double precision. A pair counts in the first table where it meets, so it
is counted once though it may meet in many. Buckets beyond ``UNIT_ROWS`` rows are dealt into pairs of
tiles; nothing is capped. A unit of work returns a row per vector (links, and the first vector it is
joined with), never pairs; connected components over those rows give the groups. Classes go by a
written number (``key``), since an id may stand on several; ids are only reported.

``bits`` follows the number of classes and ``tables`` follows from ``bits``, the threshold and
``RECALL``, the chance that a pair exactly at the threshold meets at all (closer pairs: more).

Defined results: null labels, null ids, and vectors that are null, empty, zero or hold null or
non-finite components link with nothing (component: own id, kept); vectors of different length never
link; rows of equal label and vector are copies of each other, whatever their ids; rows with equal ids
but another label or vector are rows like any others, each with its own links, component and decision;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import record_batch, table, written
from .components import connected_components, pair_roots, tiles

THRESHOLD = 0.98
RECALL = 0.99999
UNIT_ROWS = 1024
SEED = 20_24


def hash_shape(classes: int, threshold: float, recall: float) -> tuple[int, int]:
    """Bits a signature (about eight random vectors a bucket) and tables for the recall."""
    bits = max(12, math.ceil(math.log2(max(classes, 2))) - 3)
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - agree))


def _signatures(classes: DataFrame, bits: int, tables: int) -> DataFrame:
    out = pa.schema([("key", pa.int64()), ("label", pa.string()), ("copies", pa.int64()), ("unit_vector", pa.binary()),
                     ("signs", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            rows = batch.to_pydict()
            unit, signs = [], []
            for v in rows["embedding"]:
                x = np.array(v, dtype=np.float64)
                x = x / np.abs(x).max()  # no overflow in the norm
                x /= np.linalg.norm(x)
                if len(x) not in planes:
                    planes[len(x)] = np.random.default_rng(SEED).standard_normal((tables * bits, len(x)))
                unit.append(x.tobytes())
                signs.append(((planes[len(x)] @ x > 0).reshape(tables, bits) @ weights).tolist())
            yield record_batch(out, rows["key"], rows["label"], rows["copies"], unit, signs)

    return classes.mapInArrow(run, "key long, label string, copies long, unit_vector binary, signs array<long>")


def _verified(units: DataFrame, threshold: float) -> DataFrame:
    """``key, root, links`` of each row of each unit with a link; rows come ordered by unit."""
    out = pa.schema([("key", pa.int64()), ("root", pa.int64()), ("links", pa.int64())])

    def unit(rows: list[dict]) -> tuple[list, list, list]:
        x = np.stack([np.frombuffer(r["unit_vector"]) for r in rows])
        signs = np.array([r["signs"] for r in rows])
        own, t = np.array([r["own"] for r in rows]), rows[0]["t"]
        copies = np.array([r["copies"] for r in rows])
        i, j = np.nonzero(np.triu(x @ x.T >= threshold, 1))
        keep = (signs[i, t] == signs[j, t]) & ~(signs[i, :t] == signs[j, :t]).any(axis=1)
        if rows[0]["low"] != rows[0]["high"]:
            keep &= own[i] != own[j]
        i, j = i[keep], j[keep]
        links = np.bincount(i, copies[j], len(rows)) + np.bincount(j, copies[i], len(rows))
        root, at = pair_roots(len(rows), i, j), np.flatnonzero(links)
        keys = np.array([r["key"] for r in rows])
        return keys[at].tolist(), keys[root[at]].tolist(), links[at].astype(np.int64).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for batch in batches:
            for r in batch.to_pylist():
                k = (r["t"], r["bucket"], r["low"], r["high"])
                if k != key:
                    if len(rows) > 1:
                        yield record_batch(out, *unit(rows))
                    key, rows = k, []
                rows.append(r)
        if len(rows) > 1:
            yield record_batch(out, *unit(rows))

    return units.mapInArrow(run, "key long, root long, links long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                    threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row: the other rows linked directly, the smallest
    id reachable by links, and whether the row is that one (of the component's vectors of that id, one)."""
    q = lambda c: F.col("`" + c.replace("`", "``") + "`")
    rows = vectors.select(q(id_col).cast("long").alias("vec_id"), q(label_col).cast("string").alias("label"), q(vector_col).cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("usable", usable)
    classes = written(rows.where("usable").groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")).withColumn("key", F.monotonically_increasing_id()), "vector-classes")
    bits, tables = hash_shape(classes.count(), threshold, recall)

    signed = written(_signatures(classes.repartition("key").select("key", "label", "copies", "embedding"), bits, tables), "signatures")
    # the text form of a signature's place: label, length and table keep vectors apart that can't link
    spot = F.xxhash64("label", F.octet_length("unit_vector"), "t", F.col("sign"))
    places = signed.select("key", "label", "unit_vector", F.posexplode("signs").alias("t", "sign")).select("key", "t", spot.alias("bucket"))
    full = places.groupBy("t", "bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = written(places.join(full, ["t", "bucket"]), "bucket-members")
    units = members.select("key", "t", "bucket", F.explode(tiles(F.col("size"), F.xxhash64("key"), UNIT_ROWS)).alias("u")).select("key", "t", "bucket", "u.*")
    loaded = written(units, "units").join(signed.drop("label"), "key")
    dealt = loaded.repartition("t", "bucket", "low", "high").sortWithinPartitions("t", "bucket", "low", "high")
    found = written(_verified(dealt, threshold), "vector-links")

    groups = connected_components(found.where("key <> root").select(F.col("key").alias("a"), F.col("root").alias("b")))
    # the first class of each component: the smallest id, then the vector's hash
    place = F.struct("rep", F.xxhash64("embedding").alias("mark"), "key")
    joined = groups.withColumnRenamed("node", "key")
    firsts = joined.join(classes.select("key", place.alias("place")), "key").groupBy("component").agg(F.min("place").alias("first"))
    joined = joined.join(firsts, "component").select("key", "first")
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    known = classes.join(links, "key", "left").join(joined, "key", "left").select(
        "label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("first.rep", "rep").alias("component_id"), F.coalesce(F.col("first.key") == F.col("key"), F.lit(True)).alias("leads"))
    return rows.join(written(known, "vector-groups"), ["label", "embedding"], "left").select(
        "vec_id", F.when(F.col("usable"), F.col("n_links")).otherwise(0).cast("long").alias("n_links"),
        F.when(F.col("usable"), F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"),
        (~F.col("usable") | F.col("leads")).alias("leads")).select(
        "vec_id", "n_links", "component_id", (F.col("leads") & F.col("vec_id").eqNullSafe(F.col("component_id"))).alias("kept"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES = {"op3_embedding_dedup": op3_embedding_dedup}
ORACLE_SQL = {"op3_embedding_dedup": """
    WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    u AS (SELECT * FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
          AND len(list_filter(e, lambda x: x <> 0)) > 0),
    l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
          WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
    r AS (SELECT a AS node, a AS reach FROM l UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.reach),
    c AS (SELECT node, min(reach) AS component_id FROM r GROUP BY node),
    n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
    SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, vec_id) AS component_id,
           vec_id = coalesce(component_id, vec_id) AS kept
    FROM v LEFT JOIN c ON c.node = vec_id LEFT JOIN n ON n.a = vec_id"""}
