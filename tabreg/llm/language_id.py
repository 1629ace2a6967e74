"""Operator 10, language identification: nearest of several centroids per language.

A text's vector holds the sublinear counts of its letters' byte 2-grams and 3-grams (hashed to
``DIMENSIONS`` bins), weighted by inverse document frequency and scaled to length 1. Document
frequencies come from all learnable rows. Per language, spherical k-means over a sample of about
``SAMPLE`` rows (chosen by hash; the bound does not grow with the table) gives ``CLUSTERS``
centroids and the distance within which the sample lies. A text takes the language of the centroid
of largest cosine; it is ``rejected`` if it lies farther away than that language's limit.

What reaches the driver is bounded: one number per bin and language, and ``CLUSTERS`` centroids per
language (``MAX_LANGUAGES`` at most; more is an error).

Defined results: null texts and texts without a letter get ``und`` and score 0, so does everything
if nothing can be learned; rows with a null id or null lang are never learned from (null ids count
as held out); equal cosines go to the language first in order; repeated rows are sampled once;
other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, id_and_bytes, record_batch, table, written

DIMENSIONS = 4096
_PAIRS = 1024
SAMPLE = 1000
CLUSTERS = 4
MAX_LANGUAGES = 4096
UNKNOWN = "und"
#: Text and rows (each with a vector) that a task handles at a time.
SLICE_BYTES, SLICE_ROWS = 2 << 20, 256

_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 97 <= b <= 122 else 32 for b in range(256))
_ANY_ASCII = re.compile(rb"[A-Za-z]").search


def held_out(id_col: str) -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(True))


def has_letter(text: bytes | None) -> bool:
    return bool(text) and (bool(_ANY_ASCII(text)) or any(c.isalpha() for c in text.decode("utf-8", "ignore")))


def _bins(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    two = (b[:-1] << np.uint32(8)) | b[1:]
    three = (two[:-1] << np.uint32(8)) | b[2:]
    golden = np.uint32(2654435761)
    return (two * golden) >> np.uint32(22), _PAIRS + ((three * golden) >> np.uint32(8)) % np.uint32(DIMENSIONS - _PAIRS)


def counts(texts: list[bytes | None]) -> np.ndarray:
    """A row of 2-gram and 3-gram counts a text; long texts are counted block by block."""
    out = np.zeros((len(texts), DIMENSIONS), dtype=np.float32)
    for i, text in enumerate(texts):
        data = b" " + b" ".join(text.translate(_LETTERS).split()) + b" " if text else b""
        for a in range(0, max(len(data) - 1, 0), SLICE_BYTES):
            two, three = _bins(data[a: a + SLICE_BYTES + 2])
            both = np.concatenate((two[: SLICE_BYTES], three))
            out[i] += np.bincount(both, minlength=DIMENSIONS)
    return out


def vectors(texts: list[bytes | None], idf: np.ndarray) -> np.ndarray:
    v = counts(texts)
    np.log1p(v, out=v)
    v *= idf
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    return v


def _learnable(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    q = lambda c: F.col("`" + c.replace("`", "``") + "`")
    rows = docs.select(q(id_col).cast("long").alias("__id"), q(text_col).cast("string").cast("binary").alias("__text"), q(lang_col).cast("string").alias("__lang"))
    return rows.where(~held_out("__id") & F.col("__lang").isNotNull() & F.col("__text").isNotNull())


def corpus_statistics(rows: DataFrame) -> tuple[np.ndarray, dict[str, int]]:
    """Inverse document frequencies and the languages' row counts, over all learnable rows."""
    out = pa.schema([("kind", pa.int32()), ("bin", pa.int32()), ("lang", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, langs = np.zeros(DIMENSIONS, dtype=np.int64), Counter()
        for batch, texts in chunks(batches, limit=SLICE_BYTES, rows=SLICE_ROWS):
            seen += (counts(texts) > 0).sum(axis=0)
            langs.update(batch.column(batch.schema.get_field_index("__lang")).to_pylist())
        yield record_batch(out, np.zeros(DIMENSIONS, np.int32), np.arange(DIMENSIONS, dtype=np.int32), [None] * DIMENSIONS, seen)
        yield record_batch(out, np.ones(len(langs), np.int32), [-1] * len(langs), list(langs), list(langs.values()))

    sums = rows.mapInArrow(run, "kind int, bin int, lang string, n long").groupBy("kind", "bin", "lang").agg(F.sum("n").alias("n"))
    found = sums.limit(DIMENSIONS + MAX_LANGUAGES + 1).collect()
    langs = {r["lang"]: r["n"] for r in found if r["kind"] == 1}
    if len(found) > DIMENSIONS + MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} values of the language column")
    seen = np.zeros(DIMENSIONS)
    for r in found:
        if r["kind"] == 0:
            seen[r["bin"]] = r["n"]
    return (np.log((1 + sum(langs.values())) / (1 + seen)) + 1).astype(np.float32), langs


def _clustered(x: np.ndarray, k: int, rounds: int = 20) -> np.ndarray:
    """Spherical k-means; begins with the mean's farthest rows, so equal rows give equal results."""
    chosen = [int(np.argmin(x @ x.mean(axis=0)))]
    while len(chosen) < min(k, len(x)):
        far = (x @ x[chosen].T).max(axis=1)
        if far.min() > 1 - 1e-6:
            break
        chosen.append(int(np.argmin(far)))
    c = x[chosen].copy()
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        new = np.stack([x[own == j].sum(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        new /= np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-12)
        if np.allclose(new, c):
            break
        c = new
    return c


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE,
          clusters: int = CLUSTERS) -> dict:
    """``langs`` and ``limits`` (one entry a centroid), ``centroids``, ``idf``."""
    rows = _learnable(docs, id_col, text_col, lang_col)
    idf, sizes = corpus_statistics(rows)
    model = {"idf": idf, "langs": [], "limits": np.zeros(0), "centroids": np.zeros((0, DIMENSIONS), np.float32)}
    if not sizes:
        return model
    share = F.coalesce(F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, sample / n))])[F.col("__lang")], F.lit(0.0))
    hashed = rows.withColumn("__h", F.xxhash64("__id", "__text"))
    drawn = hashed.where(F.pmod("__h", F.lit(1 << 30)) < share * (1 << 30)).dropDuplicates(["__lang", "__h"])
    sketch = pa.schema([("lang", pa.string()), ("h", pa.int64()), ("v", pa.binary())])

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, limit=SLICE_BYTES, rows=SLICE_ROWS):
            get = lambda c: batch.column(batch.schema.get_field_index(c))
            yield record_batch(sketch, get("__lang"), get("__h"), [v.tobytes() for v in vectors(texts, idf).astype(np.float32)])

    def cluster(rows: pd.DataFrame) -> pd.DataFrame:
        x = np.stack([np.frombuffer(v, np.float32) for v in rows.sort_values("h")["v"]])
        c = _clustered(x, clusters).astype(np.float32)
        limit = float(np.quantile(1 - (x @ c.T).max(axis=1), 0.99)) * 1.5 + 0.02
        return pd.DataFrame({"lang": rows["lang"].iloc[0], "rank": range(len(c)), "limit": limit, "v": [v.tobytes() for v in c]})

    drawn = written(drawn.mapInArrow(embed, "lang string, h long, v binary"), "language-sample")
    found = sorted(drawn.groupBy("lang").applyInPandas(cluster, "lang string, rank int, limit double, v binary").collect(), key=lambda r: (r["lang"], r["rank"]))
    return model | {"langs": [r["lang"] for r in found], "limits": np.array([r["limit"] for r in found]),
                    "centroids": np.stack([np.frombuffer(r["v"], np.float32) for r in found])}


def predict(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, rejected`` of every row; score: the largest cosine."""
    out = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])
    fitted = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, limits, centroids, idf = (fitted.value[k] for k in ("langs", "limits", "centroids", "idf"))
        for batch, texts in chunks(batches, limit=SLICE_BYTES, rows=SLICE_ROWS):
            letters = np.array([has_letter(t) for t in texts]) & bool(langs)
            near = vectors(texts, idf) @ centroids.T if langs else np.zeros((len(texts), 1), np.float32)
            best = near.argmax(axis=1)
            score = np.where(letters, np.clip(near.max(axis=1), 0, 1), 0.0).astype(np.float64)
            names = [langs[b] if ok else UNKNOWN for b, ok in zip(best, letters, strict=True)]
            far = ~letters | (1 - score > (limits[best] if langs else 0))
            yield record_batch(out, batch.column(0), names, score, far)

    return id_and_bytes(docs, id_col, text_col).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predict(docs, learn(docs))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "rejected")


QUERIES = {"op10_language_id": op10_language_id}
ORACLE_SQL: dict[str, str] = {}
