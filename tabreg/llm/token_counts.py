"""Operator 1, token counts: separator scan over flat, unindexed token files.

A token file is nothing but little-endian ids, one document after the other, each ended by an
end-of-document id. ``count_tokens`` deals fixed blocks of all files to tasks; a task reads its
byte range and finds the separators with one vectorised comparison. A document may begin blocks
before the one that ends it, so blocks are stitched by a prefix scan of (separators so far, place of
the last separator): first inside groups of blocks, then over the groups of a file. No file, however
large, goes to one task.

``write_token_files`` makes such files from a table. Each task streams into a file of its own
attempt; only rows of attempts that succeed name files, so lost executors leave no wrong data.

Defined results: null and empty texts are documents of 0 tokens; ids may repeat or be null; an
empty table gives no rows; other columns are not read; tokens after the last separator of a file
belong to no document and are reported by ``tail_tokens``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .common import chunks, id_and_bytes, record_batch, scratch_path, table, written

#: <|endoftext|> of word_bpe_49k.json; its string inside a text is ordinary text.
END_OF_DOCUMENT = 49407
BLOCK_TOKENS = 1 << 20
#: Blocks that a task scans.
BLOCKS_A_TASK = 8
#: Blocks in a group of the two-level prefix scan.
GROUP = 1024

_WRITTEN = pa.schema([("file", pa.string()), ("bytes", pa.int64()), ("ordinal", pa.int64()), ("doc_id", pa.int64())])
_SCANNED = pa.schema([("file", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("last", pa.int64()),
                      ("ends", pa.list_(pa.int64()))])


def _filesystem(path: str):
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def write_token_files(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text",
                      tokenizer: str | None = None, end: int = END_OF_DOCUMENT) -> DataFrame:
    """Flat uint16 files below ``folder``; returns ``file, bytes, ordinal, doc_id``: a row per
    document in file order, and one row a file with its size and a null ordinal."""
    path, last = tokenizer or tokens.default_tokenizer(), end.to_bytes(2, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, out, size, n = tokens.encoder(path).encode, TaskContext.get(), None, 0, 0
        name = f"{folder}/tokens-{task.partitionId():07d}-{task.taskAttemptId()}.bin"
        for batch, texts in chunks(batches):
            if out is None:
                where, local = _filesystem(name)
                where.create_dir(local.rpartition("/")[0], recursive=True)
                out = where.open_output_stream(local)
            data = b"".join([encode(t) + last for t in texts])
            out.write(data)
            size += len(data)
            yield record_batch(_WRITTEN, [name] * len(texts), [None] * len(texts), np.arange(n, n + len(texts)), batch.column(0))
            n += len(texts)
        if out is not None:
            out.close()
            yield record_batch(_WRITTEN, [name], [size], [None], [None])

    return written(id_and_bytes(docs, id_col, text_col).mapInArrow(run, "file string, bytes long, ordinal long, doc_id long"), "token-files")


def _scan_blocks(files: DataFrame, end: int, block_tokens: int, width: int) -> DataFrame:
    """``file, block, n, last, ends``: the separators of each block (token positions in the file)."""
    step = block_tokens * width
    blocks = files.where("bytes > 0").select("file", "bytes", F.explode(F.expr(f"sequence(0L, (bytes - 1) div {step})")).alias("block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, size, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                where, local = _filesystem(name)
                with where.open_input_file(local) as f:
                    f.seek(block * step)
                    data = f.read(min(step, size - block * step))
                ids = np.frombuffer(data, f"<u{width}", len(data) // width)
                ends = np.flatnonzero(ids == end) + block * block_tokens
                yield record_batch(_SCANNED, [name], [block], [len(ends)], [int(ends[-1]) if len(ends) else None], [ends])

    # a set number of tasks: by the few bytes of their names adaptive execution would put all blocks in one
    found = files.where("bytes > 0").agg(F.sum(F.expr(f"(bytes - 1) div {step} + 1"))).first()[0] or 0
    tasks = max(1, -(-int(found) // BLOCKS_A_TASK))
    return blocks.repartition(tasks, "file", "block").mapInArrow(run, "file string, block long, n long, last long, ends array<long>")


def _stitched(scan: DataFrame) -> DataFrame:
    """For each block: separators before it in its file and the place of the last one (-1: none)."""
    small = scan.select("file", "block", F.expr(f"block div {GROUP}").alias("grp"), "n", "last")
    inside = Window.partitionBy("file", "grp").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy("file").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    groups = small.groupBy("file", "grp").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    groups = groups.select("file", "grp", F.sum("n").over(over).alias("n_before"), F.max("last").over(over).alias("last_before"))
    blocks = small.select("file", "grp", "block", F.sum("n").over(inside).alias("n_in"), F.max("last").over(inside).alias("last_in"))
    return blocks.join(groups, ["file", "grp"]).select(
        "file", "block", (F.coalesce("n_in", F.lit(0)) + F.coalesce("n_before", F.lit(0))).alias("first_ordinal"),
        F.coalesce("last_in", "last_before", F.lit(-1)).alias("previous"))


def count_tokens(files: DataFrame, end: int = END_OF_DOCUMENT, block_tokens: int = BLOCK_TOKENS, width: int = 2) -> DataFrame:
    """``file, ordinal, start, n_tokens`` of every document in ``files`` (``file, bytes``); the
    separator isn't counted. ``width``: bytes an id."""
    scan = written(_scan_blocks(files, end, block_tokens, width), "separators")
    # a block starts where its previous separator ends; inside it each document follows the last
    lengths = F.expr("transform(ends, (e, i) -> struct(first_ordinal + i AS ordinal, IF(i = 0, previous, ends[i - 1]) + 1 AS start, e - IF(i = 0, previous, ends[i - 1]) - 1 AS n_tokens))")
    return scan.where("n > 0").join(_stitched(scan), ["file", "block"]).select("file", F.explode(lengths).alias("d")).select("file", "d.*")


def tail_tokens(files: DataFrame, end: int = END_OF_DOCUMENT, block_tokens: int = BLOCK_TOKENS, width: int = 2) -> DataFrame:
    """``file, tail``: tokens after the last separator of each file (0 in a whole file)."""
    scan = _scan_blocks(files, end, block_tokens, width).groupBy("file").agg(F.max("last").alias("last"))
    return files.join(scan, "file", "left").select("file", F.expr(f"bytes div {width} - coalesce(last, -1) - 1").alias("tail"))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' token counts, read from flat files of their ids."""
    rows = write_token_files(table(spark, sf_dir, "documents"), scratch_path(spark, "flat"))
    counts = count_tokens(rows.where("ordinal IS NULL").select("file", "bytes"))
    return rows.where("ordinal IS NOT NULL").select("file", "ordinal", "doc_id").join(counts, ["file", "ordinal"], "left").select("doc_id", "n_tokens")


QUERIES = {"op1_token_counts": op1_token_counts}
ORACLE_SQL: dict[str, str] = {}
