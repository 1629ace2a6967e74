"""Operator 4, substring deduplication: level-wise doubling.

A window is ``window`` consecutive words. Windows are first judged by shorter ones: at each level
(half, or a quarter, and so on, of the window) only anchors are counted, the runs of that length
with the smallest hash among those inside some window. Equal windows have equal anchors, so a window
can only be repeated if its anchor is; the windows left are extended to twice the length, until
the level is the window itself (its own anchor) or no candidate survives. The first
level thus counts about one run in ten, and later levels see only texts with candidates.

Every level is a count by hash (aggregated before the shuffle) and a semi-join back, which Spark can
split where a run is very common; nothing is ever listed by run. Equal texts are one class, counted
once in all levels but the first; a class of two or more whole texts is repeated from end to end.
Runs are compared by 64-bit hashes: a window is taken for a repeated one by chance with odds of the
number of candidate windows in 2^64.

Defined results: null texts and texts shorter than the window keep all their words; repeated rows
are copies of each other, whatever their ids; null ids stay null; overlapping repeats of a window in
one text count; an empty table gives no rows; other columns are not read (``cut_documents`` keeps
them).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, gram_hashes, hash_words, id_and_bytes, map_columns, plain_words, record_batch, table, written

WINDOW = 35
#: No level is shorter than this.
FIRST = 18
_NOTHING = hashlib.sha256(b"").hexdigest()

_INFO = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("key", pa.binary()), ("n_words", pa.int64()), ("kept_sha256", pa.string()),
                   ("hashes", pa.list_(pa.int64())), ("places", pa.list_(pa.int32()))])
_CANDIDATES = pa.schema([("rid", pa.int64()), ("text", pa.binary()), ("hashes", pa.list_(pa.int64())), ("places", pa.list_(pa.int32()))])
_CUT = pa.schema([("rid", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])


def level_lengths(window: int, first: int = FIRST) -> list[int]:
    out = [window]
    while first <= (out[0] + 1) // 2 < out[0]:
        out.insert(0, (out[0] + 1) // 2)
    return out


def _slide(op, x: np.ndarray, width: int) -> np.ndarray:
    """``op`` over each ``width`` consecutive values, by doubling."""
    size, out = 1, x
    while 2 * size <= width:
        out, size = op(out[:-size], out[size:]), 2 * size
    n = len(x) - width + 1
    return op(out[:n], out[width - size: width - size + n])


def anchors(words: np.ndarray, window: int, length: int, candidate: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the anchors of this length in the candidate windows (None: all)."""
    if len(words) < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    runs, width = gram_hashes(words, length), window - length + 1
    least = _slide(np.minimum, runs, width)
    if candidate is not None:
        least = np.where(candidate, least, np.uint64(0))
    edge = np.zeros(width - 1, np.uint64)
    at = np.flatnonzero((_slide(np.maximum, np.concatenate((edge, least, edge)), width) == runs) & (runs != 0))
    return runs[at], at


def surviving_windows(words: np.ndarray, window: int, length: int, survivors: np.ndarray) -> np.ndarray:
    """Of each window whether its anchor of this length survives."""
    if len(words) < window:
        return np.zeros(0, bool)
    runs, width = gram_hashes(words, length), window - length + 1
    left = np.full(len(runs), np.iinfo(np.uint64).max)
    left[survivors] = runs[survivors]
    return _slide(np.minimum, left, width) == _slide(np.minimum, runs, width)


def covered(n: int, starts: np.ndarray, window: int) -> np.ndarray:
    steps = np.zeros(n + 1, np.int64)
    starts = np.asarray(starts, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + window, -1)
    return np.cumsum(steps[:n]) > 0


def kept_words(text: bytes | None, starts: np.ndarray, window: int) -> tuple[list[bytes], int]:
    words = plain_words(text)
    gone = covered(len(words), starts, window)
    return [w for w, g in zip(words, gone.tolist(), strict=True) if not g], int(gone.sum())


def _first_level(texts: DataFrame, window: int, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid = TaskContext.get().partitionId() << 33
        for batch, found in chunks(batches):
            sizes, shas, hashes, places = [], [], [], []
            for text in found:
                words = plain_words(text)
                h, p = anchors(hash_words(words), window, length)
                sizes.append(len(words))
                shas.append(hashlib.sha256(b" ".join(words)).hexdigest())
                hashes.append(h.view(np.int64))
                places.append(p.astype(np.int32))
            yield record_batch(_INFO, np.arange(rid, rid + len(found)), batch.column(0), batch.column(2), sizes, shas, hashes, places)
            rid += len(found)

    return texts.mapInArrow(run, "rid long, doc_id long, key binary, n_words long, kept_sha256 string, hashes array<long>, places array<int>")


def _next_level(texts: DataFrame, window: int, before: int, length: int) -> DataFrame:
    """Anchors of the next length of ``rid, __text, survivors`` rows that still have candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in chunks(batches):
            out: list[list] = [[], [], [], []]
            for rid, text, survivors in zip(batch.column(0).to_pylist(), found, batch.column(2), strict=True):
                words = hash_words(plain_words(text))
                alive = surviving_windows(words, window, before, survivors.values.to_numpy())
                if alive.any():
                    h, p = anchors(words, window, length, alive)
                    for column, value in zip(out, (rid, text, h.view(np.int64), p.astype(np.int32)), strict=True):
                        column.append(value)
            yield record_batch(_CANDIDATES, *out)

    return texts.select("rid", "__text", "survivors").mapInArrow(run, "rid long, text binary, hashes array<long>, places array<int>")


def _survivors(rows: DataFrame) -> DataFrame:
    """``rid, survivors``: the places of the rows' runs that occur more than once."""
    runs = rows.select("rid", F.explode(F.arrays_zip("hashes", "places")).alias("a")).select("rid", F.col("a.hashes").alias("hash"), F.col("a.places").alias("place"))
    repeated = written(runs.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"), "repeated-runs")
    left = runs.join(repeated, "hash", "left_semi")
    return written(left.groupBy("rid").agg(F.array_sort(F.collect_list("place")).alias("survivors")), "survivors")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return id_and_bytes(docs, id_col, text_col).withColumn("key", F.unhex(F.md5("__text")))


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                     first: int = FIRST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All rows (``doc_id, key, n_words, kept_sha256``: of all words); for each text (``key``) with
    repeated windows ``rid, starts, whole``; and the texts that may have some (``rid, __text``)."""
    levels = level_lengths(window, first)
    texts = _texts(docs, id_col, text_col)
    info = written(_first_level(texts, window, levels[0]), "first-level")
    classes = written(info.where("key IS NOT NULL").groupBy("key").agg(
        F.min("rid").alias("rid"), F.min("doc_id").alias("rep"), (F.count("*") > 1).alias("copied"), F.first("n_words").alias("n_words")), "text-classes")
    survivors = _survivors(info).join(classes.select("rid", "key", "rep"), "rid")
    # one row of each text goes on; equal texts stand at the same key and only the smallest id passes
    survivors = written(survivors, "first-survivors")
    candidates = texts.join(survivors, "key").where(F.col("__id").eqNullSafe(F.col("rep"))).select("rid", "__text", "survivors")
    for before, length in zip(levels, levels[1:], strict=False):
        rows = written(_next_level(candidates, window, before, length), "candidates")
        survivors = _survivors(rows)
        candidates = rows.select("rid", F.col("text").alias("__text")).join(survivors, "rid")
    starts = survivors.select("rid", F.col("survivors").alias("starts"))
    whole = (F.col("copied") & (F.col("n_words") >= window)).alias("whole")
    found = written(classes.select("rid", "key", whole).join(starts, "rid", "left").where("whole OR starts IS NOT NULL"), "repeated-windows")
    return info.select("doc_id", "key", "n_words", "kept_sha256"), found, candidates.select("rid", "__text")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, found, texts = repeated_windows(table(spark, sf_dir, "documents"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, part in chunks(batches):
            cut = [kept_words(t, s.values.to_numpy(), WINDOW) for t, s in zip(part, batch.column(2), strict=True)]
            yield record_batch(_CUT, batch.column(0), [n for _, n in cut], [hashlib.sha256(b" ".join(w)).hexdigest() for w, _ in cut])

    parts = found.where("NOT whole").select("rid", "starts")
    cut = texts.join(parts, "rid").select("rid", "__text", "starts").mapInArrow(run, "rid long, n_removed long, kept_sha256 string")
    cut = found.select("rid", "key", "whole").join(cut.withColumnRenamed("kept_sha256", "cut_sha256"), "rid", "left").select("key", "whole", "n_removed", "cut_sha256")
    return rows.join(written(cut, "cut"), "key", "left").select(
        "doc_id", "n_words", F.when(F.col("whole"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(F.col("whole"), F.lit(_NOTHING)).otherwise(F.coalesce("cut_sha256", "kept_sha256")).alias("kept_sha256"))


def cut_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = None, window: int = WINDOW,
                  first: int = FIRST) -> DataFrame:
    """``docs`` with the words of repeated windows removed: a text that loses some is its other
    words joined by one space, the others are unchanged. ``size_col`` gets the text's characters."""
    _, found, _ = repeated_windows(docs, id_col, text_col, window, first)
    q = F.col("`" + text_col.replace("`", "``") + "`")
    keyed = docs.select(F.struct("*").alias("row"), F.unhex(F.md5(q.cast("binary"))).alias("key"))
    starts = F.when(F.col("whole"), F.sequence(F.lit(0), F.lit(0))).otherwise(F.col("starts"))
    joined = keyed.join(found.select("key", "whole", starts.alias("starts")), "key", "left").select("row.*", F.col("whole").alias("__whole"), F.col("starts").alias("__starts"))
    at, schema = docs.columns.index(text_col), docs.schema
    size_at = docs.columns.index(size_col) if size_col else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.append_column("__bytes", batch.column(at).cast(pa.binary()))
            for part, texts in chunks(iter([rows]), "__bytes"):
                columns, new = part.columns[: len(schema)], []
                sizes = None if size_at is None else columns[size_at].to_pylist()
                for i, (text, whole, starts) in enumerate(zip(texts, part.column(len(schema)).to_pylist(), part.column(len(schema) + 1), strict=True)):
                    if text is not None and starts.is_valid:
                        text = b"" if whole else b" ".join(kept_words(text, starts.values.to_numpy(), window)[0])
                        if sizes is not None:
                            sizes[i] = len(text.decode("utf-8", "replace"))
                    new.append(None if text is None else text.decode("utf-8", "replace"))
                columns[at] = pa.array(new, columns[at].type)
                if sizes is not None:
                    columns[size_at] = pa.array(sizes, columns[size_at].type)
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[: len(schema)])

    return map_columns(joined, run, schema)


QUERIES = {"op4_substring_dedup": op4_substring_dedup}
ORACLE_SQL = {"op4_substring_dedup": r"""
    WITH w AS (SELECT doc_id, row_number() OVER () AS r, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents),
    p AS (SELECT r, unnest(range(1, len(words) - 33)) AS s FROM w WHERE len(words) >= 35),
    h AS (SELECT p.r, s, array_to_string(words[s:s + 34], ' ') AS run FROM p JOIN w USING (r)),
    d AS (SELECT run FROM h GROUP BY run HAVING count(*) > 1),
    x AS (SELECT DISTINCT r, unnest(range(s, s + 35)) AS i FROM h JOIN d USING (run)),
    g AS (SELECT r, list(i) AS gone, count(*) AS n FROM x GROUP BY r)
    SELECT doc_id, len(words) AS n_words, coalesce(n, 0) AS n_removed,
           sha256(CASE WHEN n IS NULL THEN array_to_string(words, ' ') WHEN n = len(words) THEN '' ELSE array_to_string(
               list_transform(list_filter(range(1, len(words) + 1), lambda i: NOT list_contains(gone, i)), lambda i: words[i]), ' ') END) AS kept_sha256
    FROM w LEFT JOIN g USING (r)"""}
