"""Operator 13, ranked lexical search: bag deduplication.

All documents are ranked for each item by a weighted term score in whole numbers. A document's
score depends on two things only: how often it holds each word of the items' vocabulary, and a number
``m`` that follows from its length. Documents with the same such vector and ``m`` are one class:

1. Each document is reduced to its vector over the vocabulary (packed term numbers and counts) and
   its number of terms; totals and document frequencies are summed from these.
2. Documents are grouped by a hash of vector and ``m``, and by vector and ``m`` themselves, which
   verifies the hash. A class keeps its ``k`` smallest ids: more can never be in a result. The rank within
   a class is limited before the shuffle, so a class that holds a third of all rows is no burden.
3. Each class is scored once for all items that share a term with it; a task keeps the ``k`` best
   classes of each item (equal scores: smallest id), and only those are merged.
4. The best ``k`` classes of an item are expanded by ascending id, and the ``k`` first documents stay.
   A document among the first k has fewer than k classes before its own, so none is lost.

The items' terms are sent to the tasks in shards: as many as it takes for a shard to have at most
``SHARD_TERMS`` terms or one item (whose terms a cell of text bounds); each is a pass over the documents.

Defined results: null, empty and termless texts count nowhere and are never returned; repeated rows
(also of one id) are documents of their own; a document with a null id counts, and comes last among
equal scores; repeated item ids are items of their own; items without a known term have no rows; an empty
table gives no rows; other columns are not read. A very long text is split into words in parts.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import _NORMAL, chunks, id_and_bytes, record_batch, table, written

K = 10
#: Terms of items in a shard.
SHARD_TERMS = 200_000
#: Bytes of text that are split into words at a time, and scores that a task holds at a time.
PART, CELLS = 1 << 20, 1 << 21
# Fixed values of the score.
SCALE, SLOPE, UNIT = 1_000_000_000, 90, 1000
_NO_ID = np.iinfo(np.int64).max

_VECTORS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("vector", pa.binary())])
_BEST = pa.schema([("item", pa.int64()), ("score", pa.int64()), ("first_id", pa.int64()), ("class", pa.int64())])


def term_parts(text: bytes | None) -> Iterator[list[bytes]]:
    """The terms (runs of letters, digits and non-ASCII characters; A-Z lower-cased), in parts."""
    plain, a = (text or b"").translate(_NORMAL), 0
    while a < len(plain):
        b = plain.find(b" ", a + PART)
        b = len(plain) if b < 0 else b
        yield plain[a:b].split()
        a = b


def _item_terms(items: DataFrame) -> DataFrame:
    """``item, term``: each term of each item once."""
    schema = pa.schema([("item", pa.int64()), ("term", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in chunks(batches):
            for item, text in zip(batch.column(0).to_pylist(), found, strict=True):
                terms = sorted({t for part in term_parts(text) for t in part})
                yield record_batch(schema, [item] * len(terms), terms)

    return items.select("item", "__text").mapInArrow(run, "item long, term binary")


def _shards(terms: DataFrame) -> int:
    """The least power of two of shards that all have ``SHARD_TERMS`` terms at most, or one item."""
    n = 1
    while True:
        sized = terms.groupBy(F.pmod(F.xxhash64("item"), F.lit(n)).alias("shard")).agg(F.count("*").alias("n"), F.min("item").alias("a"), F.max("item").alias("b"))
        if sized.where((F.col("n") > SHARD_TERMS) & (F.col("a") < F.col("b"))).isEmpty():
            return n
        n *= 2


def _vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """``doc_id, n, vector`` of the documents with a term; little-endian (term, count) pairs."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = sent.value.get
        for batch, found in chunks(batches):
            ids, sizes, vectors = [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), found, strict=True):
                held, n = Counter(), 0
                for part in term_parts(text):
                    held.update(map(number, part))
                    n += len(part)
                if n:
                    held.pop(None, None)
                    ids.append(doc_id)
                    sizes.append(n)
                    vectors.append(np.array(sorted(held.items()), "<u4").tobytes())
            yield record_batch(_VECTORS, ids, sizes, vectors)

    return docs.mapInArrow(run, "doc_id long, n long, vector binary")


def _frequencies(vectors: DataFrame, terms: int) -> np.ndarray:
    """Of each vocabulary term the number of documents that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(terms, np.int64)
        for batch in batches:
            pairs = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u4")
            found += np.bincount(pairs[::2], minlength=terms)
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(found[at])], names=["term", "df"])

    counted = vectors.select("vector").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toPandas()
    out = np.zeros(terms, np.int64)
    out[counted["term"].to_numpy(np.int64)] = counted["df"].to_numpy(np.int64)
    return out


def _classes(vectors: DataFrame, documents: int, total: int, k: int) -> DataFrame:
    """``class, vector, m, ids``: ids are the class's ``k`` smallest, in order (null ids last)."""
    m = F.expr(f"CAST((CAST(n AS DECIMAL(19, 0)) * CAST({SLOPE * documents} AS DECIMAL(19, 0))) div {total} AS BIGINT) + {100 - SLOPE}")
    rows = vectors.where("length(vector) > 0").select("doc_id", "vector", m.alias("m"))
    rows = rows.withColumn("hash", F.xxhash64("vector", "m"))
    key = ["hash", "vector", "m"]
    first = Window.partitionBy(*key).orderBy(F.col("doc_id").asc_nulls_last())
    kept = rows.withColumn("place", F.row_number().over(first)).where(F.col("place") <= k)
    members = F.array_sort(F.collect_list(F.struct("place", "doc_id")))
    kept = kept.groupBy(*key).agg(F.transform(members, lambda x: x["doc_id"]).alias("ids"))
    return written(kept.select(F.monotonically_increasing_id().alias("class"), "vector", "m", "ids"), "bag-classes")


def _best_classes(classes: DataFrame, weights: np.ndarray, items: np.ndarray, edges: np.ndarray, term_items: np.ndarray, k: int) -> DataFrame:
    """``item, score, first_id, class``: each task's ``k`` best classes of each item. ``term_items``
    lists places in ``items``, those of term t between ``edges[t]`` and ``edges[t + 1]``."""
    sent = classes.sparkSession.sparkContext.broadcast((weights, items, edges, term_items))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, items, edges, term_items = sent.value
        fan = np.diff(edges)
        held = np.zeros((0, 4), np.int64)        # place in items, score, first id, class
        least = np.ones(len(items), np.int64)    # what a class must reach to be among the best
        step = max(1, CELLS // len(items))
        for whole in batches:
            for a in range(0, whole.num_rows, step):
                batch = whole.slice(a, step)
                raw = batch.column(1).to_pylist()
                pairs = np.frombuffer(b"".join(raw), "<u4").astype(np.int64)
                terms, tf = pairs[::2], pairs[1::2]
                row = np.repeat(np.arange(len(raw)), [len(v) // 8 for v in raw])
                m = batch.column(2).to_numpy()[row]
                value = weights[terms] * ((SCALE * tf) // (UNIT * tf + 8 * m))
                scores = np.zeros(len(raw) * len(items), np.int64)
                # postings are spread over the items of their term, so many at a time
                spread = np.cumsum(fan[terms])
                i = 0
                while i < len(terms):
                    j = max(i + 1, int(np.searchsorted(spread, (spread[i - 1] if i else 0) + CELLS, side="right")))
                    n = fan[terms[i:j]]
                    inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    item = term_items[np.repeat(edges[terms[i:j]], n) + inner]
                    np.add.at(scores, np.repeat(row[i:j] * len(items), n) + item, np.repeat(value[i:j], n))
                    i = j
                scores = scores.reshape(len(raw), len(items))
                at, item = np.nonzero(scores >= least)
                first = batch.column(3).fill_null(_NO_ID).to_numpy()
                new = np.stack([item, scores[at, item], first[at], batch.column(0).to_numpy()[at]], axis=1)
                held = np.concatenate([held, new])
                held = held[np.lexsort((held[:, 2], -held[:, 1], held[:, 0]))]
                begins = np.searchsorted(held[:, 0], np.arange(len(items) + 1))
                place = np.arange(len(held)) - begins[held[:, 0]]
                held, place = held[place < k], place[place < k]
                least[held[place == k - 1, 0]] = held[place == k - 1, 1]
        yield record_batch(_BEST, items[held[:, 0]], held[:, 1], held[:, 2], held[:, 3])

    rows = classes.select("class", "vector", "m", F.col("ids")[0].alias("first_id"))
    return rows.mapInArrow(run, "item long, score long, first_id long, class long")


def _search_shard(docs: DataFrame, pairs: list[tuple[int, bytes]], k: int) -> DataFrame | None:
    """``item, rank, doc_id, score`` for the items whose (item, term) pairs these are."""
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, t in pairs}))}
    items = np.unique(np.array([i for i, _ in pairs], np.int64))
    vectors = written(_vectors(docs, vocabulary), "bag-vectors")
    documents, total = vectors.agg(F.count("*"), F.sum("n")).first()
    if not documents:
        return None
    weights = [math.floor(1000 * math.log((2 * documents + 2) / (2 * int(df) + 1))) for df in _frequencies(vectors, len(vocabulary))]
    term = np.array([vocabulary[t] for _, t in pairs])
    order = np.argsort(term, kind="stable")
    places = np.searchsorted(items, np.array([i for i, _ in pairs], np.int64))[order]
    edges = np.searchsorted(term[order], np.arange(len(vocabulary) + 1))
    classes = _classes(vectors, documents, total, k)
    best = written(_best_classes(classes, np.array(weights, np.int64), items, edges, places, k), "bag-best")
    order = [F.col("score").desc(), F.col("first_id").asc()]
    best = best.withColumn("place", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("place") <= k)
    found = best.join(classes.select("class", "ids"), "class").select("item", "score", F.explode("ids").alias("doc_id"))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    return written(found.select("item", "rank", "doc_id", "score"), "bag-found")


def search(docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of each item."""
    plain = "`" + item_col.replace("`", "``") + "`"
    text = "`" + item_text_col.replace("`", "``") + "`"
    named = written(items.select(F.monotonically_increasing_id().alias("item"), F.col(plain).alias("item_id"),
                                 F.col(text).cast("string").cast("binary").alias("__text")), "bag-items")
    terms = written(_item_terms(named), "bag-terms")
    texts, shards, out = id_and_bytes(docs, id_col, text_col), _shards(terms), None
    for shard in range(shards):
        pairs = [(r["item"], bytes(r["term"])) for r in terms.where(F.pmod(F.xxhash64("item"), F.lit(shards)) == shard).toLocalIterator()]
        found = _search_shard(texts, pairs, k) if pairs else None
        if found is not None:
            out = found if out is None else out.unionByName(found)
    if out is None:
        out = named.sparkSession.createDataFrame([], "item long, rank int, doc_id long, score long")
    return out.join(named.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op13_lexical_search": op13_lexical_search}
_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE_SQL = {"op13_lexical_search": f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS terms FROM documents WHERE text IS NOT NULL),
    s AS (SELECT count(*) AS docs, sum(len(terms)) AS total FROM d WHERE len(terms) > 0),
    i AS (SELECT DISTINCT q, item_id, unnest(terms) AS term FROM (
            SELECT row_number() OVER () AS q, item_id, {_TERMS} AS terms FROM benchmark WHERE text IS NOT NULL)),
    p AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(terms) AS n, unnest(terms) AS term FROM d) GROUP BY ALL),
    f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
    w AS (SELECT q, item_id, term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS w FROM i JOIN f USING (term), s),
    c AS (SELECT q, item_id, r, doc_id, CAST(sum(w * (({SCALE} * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // total)))) AS BIGINT) AS score
          FROM w JOIN p USING (term), s GROUP BY q, item_id, r, doc_id),
    o AS (SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM c WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM o WHERE rank <= {K}"""}
