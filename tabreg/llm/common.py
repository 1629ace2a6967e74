"""Helpers shared by the operators: tables, scratch tables, words, hashes, temporary column names."""

from __future__ import annotations

import gc
import os
import uuid
import weakref
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tabreg.session import delete_dir, shared_dir

#: Bytes of text that one step inside a task handles at a time.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder below the session's ``spark.checkpoint.dir``."""
    return os.path.join(shared_dir(spark), "llm", f"{name}-{uuid.uuid4().hex[:16]}")


def written(df: DataFrame, name: str, plain: bool = False) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read again: the lineage ends
    there, so a lost executor costs no recomputation of what came before. ``plain``: the columns
    are mostly hashes, on which dictionaries are lost effort."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    out = df.write.option("parquet.enable.dictionary", "false") if plain else df.write
    out.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[id(out)] = (weakref.ref(out, lambda _, key=id(out): _WRITTEN.pop(key, None)), path)
    return out


#: Where the frames that ``written`` returned are stored.
_WRITTEN: dict[int, tuple] = {}


def discard(*frames: DataFrame) -> None:
    """Delete the tables of frames from ``written`` that no later step reads, and ``tidy``: let Spark drop
    the shuffle files of the steps before; its cleaner does so when the driver's JVM collects garbage."""
    for df in frames:
        delete_dir(df.sparkSession, _WRITTEN.pop(id(df))[1])
    tidy(frames[0].sparkSession)


def tidy(spark: SparkSession) -> None:
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it as long as the frame has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def map_columns(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
                schema: StructType) -> DataFrame:
    """``mapInArrow`` for frames with any column names: the function sees and returns ``c0, c1, ...``."""
    plain = StructType([StructField(f"c{i}", f.dataType) for i, f in enumerate(schema.fields)])
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]).mapInArrow(fn, plain).toDF(*schema.names)


def id_and_bytes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``__id`` (long) and ``__text`` (UTF-8 bytes, null for null text): all that the tasks need of
    a table, so that other columns are never read and their names cannot clash."""
    q = lambda c: F.col("`" + c.replace("`", "``") + "`")
    return df.select(q(id_col).cast("long").alias("__id"), q(text_col).cast("string").cast("binary").alias("__text"))


def chunks(batches: Iterator[pa.RecordBatch], col: str = "__text",
           limit: int = BATCH_BYTES, rows: int = 1 << 30) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Slices of the batches of about ``limit`` bytes of text and ``rows`` rows (at least one row),
    each with its texts; a very long text is a slice of its own."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(col))
        sizes = np.zeros(len(column) + 1, dtype=np.int64)
        np.cumsum([0 if not v.is_valid else len(v.as_buffer()) for v in column], out=sizes[1:])
        a = 0
        while a < len(column):
            b = max(a + 1, int(np.searchsorted(sizes, sizes[a] + limit, side="right")) - 1)
            b = min(b, a + rows)
            yield batch.slice(a, b - a), column.slice(a, b - a).to_pylist()
            a = b


#: Bytes that are part of a normalised word: digits, a-z (A-Z become a-z) and all above 0x7F.
_NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def plain_words(text: bytes | None) -> list[bytes]:
    """Runs of bytes other than 0x20 and 0x09-0x0D, unchanged."""
    return text.split() if text else []


def normal_words(text: bytes | None) -> list[bytes]:
    """Lower-case (A-Z only) runs of ASCII letters, digits and non-ASCII characters."""
    return text.translate(_NORMAL).split() if text else []


def word_bounds(text: bytes) -> list[tuple[int, int]]:
    """Byte ranges of ``normal_words``."""
    inside = np.frombuffer(text.translate(_NORMAL), np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))).tolist()
    return list(zip(edges[::2], edges[1::2], strict=True))


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def gram_hashes(h: np.ndarray, k: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hash of every run of ``k`` consecutive word hashes (Horner's rule by doubling: a run of
    2m is a run of m followed by another, so log2(k) vector steps do for any k)."""
    n = len(h)
    if n < k:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        out, done, power = None, 0, h
        width, factor, rest = 1, base | 1, k
        while rest:
            if rest & 1:
                if out is None:
                    out, done, scale = power[: n - width + 1], width, factor
                else:
                    m = n - (done + width) + 1
                    out = mix(out[:m] * np.uint64(factor & 0xFFFFFFFFFFFFFFFF)) + power[done: done + m]
                    done += width
            rest >>= 1
            if rest:
                m = n - 2 * width + 1
                power = mix(power[:m] * np.uint64(factor & 0xFFFFFFFFFFFFFFFF)) + power[width: width + m]
                width *= 2
                factor = (factor * 0xD1342543DE82EF95 + 2 * width + 1) & 0xFFFFFFFFFFFFFFFF | 1
        return mix(out)


def starts_of(lengths: np.ndarray) -> np.ndarray:
    out = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def record_batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
