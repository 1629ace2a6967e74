"""Operator 6, packing: concatenate and cut.

Two passes. The first encodes every document once, ends it with the separator id and writes the
packed ids with their offset inside the partition; a sum of each partition's tokens gives, as
prefix sums over the partitions, where each partition starts in the one endless sequence. The
second pass adds both offsets and cuts at every multiple of the window, so a document that crosses
a boundary gives one piece on either side. Only partition totals meet in one place, no text is
shuffled, and the last sequence alone is not full (its end is padded up to a power of two).

Defined results: a null or empty text is the separator alone (one piece, or part of none other);
rows with the same id are packed each on its own; null ids stay null; an empty table gives no
rows; other columns are not read. Order is that of the input's partitions and rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import chunks, id_and_bytes, record_batch, table, written

WINDOW = 4096
SEPARATOR = 2

_STREAM = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("at", pa.int64()), ("ids", pa.binary())])
_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
                     ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()),
                     ("offset", pa.int64())])


def token_stream(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
                 separator: int = SEPARATOR) -> DataFrame:
    """``part, doc_id, at, ids``: each document's packed uint16 ids with the separator, and the
    number of tokens before it in its partition."""
    path = tokenizer or tokens.default_tokenizer()
    last = separator.to_bytes(2, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, at = tokens.encoder(path).encode, TaskContext.get().partitionId(), 0
        for batch, texts in chunks(batches):
            ids = [encode(t) + last for t in texts]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 2
            ends = at + np.cumsum(sizes)
            yield record_batch(_STREAM, np.full(len(ids), part, np.int32), batch.column(0), ends - sizes, ids)
            at = int(ends[-1])

    return id_and_bytes(docs, id_col, text_col).mapInArrow(run, "part int, doc_id long, at long, ids binary")


def partition_starts(stream: DataFrame) -> dict[int, int]:
    """Prefix sums over the partitions' token totals: one number a partition, whatever the rows."""
    totals = stream.groupBy("part").agg(F.sum(F.expr("octet_length(ids) div 2")).alias("n")).collect()
    starts, at = {}, 0
    for r in sorted(totals, key=lambda r: r["part"]):
        starts[r["part"]] = at
        at += r["n"]
    return starts


def pack(stream: DataFrame, window: int = WINDOW, with_ids: bool = True) -> DataFrame:
    """Pieces of a written ``token_stream``: every window's documents with start, length, place.
    ``ids`` are little-endian uint32 (null unless ``with_ids``)."""
    starts = partition_starts(stream)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part, doc, at, packed = (c.to_pylist() for c in batch.slice(a, 512).columns)
                out: list[list] = [[] for _ in _PIECES]
                for p, d, t, b in zip(part, doc, at, packed, strict=True):
                    n, place, start = len(b) // 2, starts[p] + t, 0
                    wide = np.frombuffer(b, "<u2").astype("<u4").tobytes()
                    while start < n:
                        sequence, offset = divmod(place + start, window)
                        size = min(window - offset, n - start)
                        piece = wide[4 * start: 4 * (start + size)]
                        for column, value in zip(out, (d, start, size, piece if with_ids else None, zlib.crc32(piece), n, sequence, offset), strict=True):
                            column.append(value)
                        start += size
                yield record_batch(_PIECES, *out)

    schema = "doc_id long, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return stream.mapInArrow(run, schema)


def packed_documents(docs: DataFrame, with_ids: bool = True, **options) -> DataFrame:
    return pack(written(token_stream(docs, **options), "tokens"), with_ids=with_ids)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"), with_ids=False).drop("ids")


QUERIES = {"op6_packing": op6_packing}
ORACLE_SQL: dict[str, str] = {}
