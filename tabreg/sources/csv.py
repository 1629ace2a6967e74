"""CSV scan (S1) with a missing-source guard (S2) and a set of NA markers.

Spark's CSV reader takes a single ``nullValue``; the reference's reader treats several texts as
missing. So the file is read as text, every marker is mapped to NULL with one projection, and
each column is then cast to its declared type, or to the narrowest of long/double/boolean that
holds every non-missing value (one aggregate job, all columns at once).
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import RaggedRows, SourceNotFound
from ..names import column as _q
from ..names import quoted

# Texts read as missing (pandas' default NA set).
NA_MARKERS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
              "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


#: A plain decimal number: no type suffix, hexadecimal or blanks.
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^[+-]?(inf|infinity)$"


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, na_values=NA_MARKERS,
             infer: bool = True, multi_line: bool = False, strict: bool = True) -> DataFrame:
    """Header CSV -> typed DataFrame with NA markers as NULL. A missing path raises ``SourceNotFound``.

    Quotes inside quoted fields are doubled. ``multi_line`` allows line breaks inside quoted fields; files
    are still read in blocks (``quoted_records``). A row with more or fewer fields than the header raises
    ``RaggedRows`` (one more pass); with ``strict=False`` missing fields are NULL and extra ones are lost.
    """
    def reader(**more):
        options = {"header": True, "quote": '"', "escape": '"', **more}
        return spark.read.options(**options)

    try:
        raw = _parsed(spark, path) if multi_line else reader(inferSchema=False).csv(path)
        cols = raw.columns
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            raise SourceNotFound(f"source not found: {path}") from e
        raise
    if multi_line:
        *cols, bad = cols
        if strict and (ragged := raw.where(_q(bad).isNotNull()).count()):
            raise RaggedRows(f"{ragged} rows of {path} don't have the header's {len(cols)} fields")
    elif strict:
        bad = free = "_bad"
        while bad in cols:
            bad += free
        kept = T.StructType([*raw.schema.fields, T.StructField(bad, T.StringType())])
        n = reader(mode="PERMISSIVE", columnNameOfCorruptRecord=bad).schema(kept).csv(path).cache()
        try:
            ragged = n.where(_q(bad).isNotNull()).count()
        finally:
            n.unpersist()
        if ragged:
            raise RaggedRows(f"{ragged} rows of {path} don't have the header's {len(cols)} fields")
    markers = F.array(*[F.lit(m) for m in na_values])
    clean = raw.select(*[F.when(F.array_contains(markers, _q(c)) | _q(c).isNull(), F.lit(None))
                         .otherwise(_q(c)).alias(c) for c in cols])
    if schema is not None:
        return clean.select(*[_q(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
    if not infer:
        return clean
    return clean.select(*[_q(c).cast(t).alias(c) for c, t in infer_types(clean, cols).items()])


def quoted_records(spark: SparkSession, path: str) -> DataFrame:
    """``record, header`` of CSV files with line breaks inside quoted fields; ``header``: a file's first.

    Files are read in blocks like any text. Whether a block begins inside quotes is the parity of the
    quotes in all blocks before it, a prefix sum over one row a block; a line then begins a record if the
    parity up to it is even. What lies before a block's first record goes to the last record of the
    blocks before, so only one record a block is shuffled."""
    lines = spark.read.option("lineSep", "\n").text(path).select("_metadata.file_path", "_metadata.file_block_start", "value").toDF("file", "start", "line")
    quotes = F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))
    blocks = lines.groupBy("file", "start").agg((F.sum(quotes) % 2).alias("odd"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "start", (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2).cast("int").alias("inside"))
    known = lines.join(F.broadcast(blocks), ["file", "start"]).select("file", "start", "inside", "line")
    out = pa.schema([("file", pa.string()), ("start", pa.int64()), ("part", pa.int32()), ("header", pa.bool_()), ("record", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, inside, held, first, rows = None, 0, [], True, []

        def close(part: int) -> None:
            """Pass the held lines on: 0 a whole record, 1 the end of an earlier one, 2 the block's last."""
            if held:
                rows.append((*at, 1 if first else part, not first and at[1] == 0 and head[0], "\n".join(held)))
                if not first:
                    head[0] = False

        head = [True]
        for batch in batches:
            for file, start, odd, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (file, start) != at:
                    close(2)
                    at, inside, held, first, head = (file, start), odd, [], True, [True]
                if not inside:
                    close(0)
                    held, first = [], False
                held.append(line)
                inside = (inside + line.count('"')) % 2
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 5, out, strict=True)], schema=out)
            rows.clear()
        close(2)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 5, out, strict=True)], schema=out)

    pieces = known.mapInArrow(run, "file string, start long, part int, header boolean, record string")
    order = Window.partitionBy("file").orderBy("start", "part")
    edges = pieces.where("part > 0").withColumn("n", F.sum(F.when(F.col("part") == 2, 1).otherwise(0)).over(order))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "part", "record"))), lambda x: x["record"]), "\n")
    stitched = edges.groupBy("file", "n").agg(F.max("header").alias("header"), text.alias("record"))
    found = pieces.where("part = 0").select("record", "header").unionByName(stitched.select("record", "header"))
    return found.withColumn("record", F.regexp_replace("record", "\r$", "")).where(F.col("record") != "")


def _parsed(spark: SparkSession, path: str) -> DataFrame:
    """The records' fields as text, and a last column that is not null in ragged rows."""
    records = quoted_records(spark, path)
    header = records.where("header").agg(F.min("record")).first()[0]
    if header is None:
        return spark.createDataFrame([], "`_bad` string")
    cols = next(csv.reader([header]))
    bad = "_bad"
    while bad in cols:
        bad += "_bad"
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*cols, bad]])
    fields = F.from_csv("record", _ddl(schema), {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad})
    return records.where("NOT header").select(fields.alias("f")).select(*[F.col("f").getField(c).alias(c) for c in schema.names])


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"{quoted(n)} STRING" for n in schema.names)


def infer_types(df: DataFrame, cols: list[str]) -> dict[str, str]:
    """Per column: ``bigint`` if every value is an integer in its range, else ``double`` if every
    value is a decimal number, else ``boolean`` for true/false text, else ``string``."""
    aggs = []
    for i, c in enumerate(cols):
        v = _q(c)
        present = v.isNotNull()
        integer = v.rlike(r"^[+-]?\d+$") & F.expr(f"try_cast({quoted(c)} AS bigint)").isNotNull()
        aggs += [
            F.count(F.when(present & ~integer, 1)).alias(f"ni{i}"),
            F.count(F.when(present & ~F.lower(v).rlike(NUMBER), 1)).alias(f"nd{i}"),
            F.count(F.when(present & ~F.lower(v).isin("true", "false"), 1)).alias(f"nb{i}"),
            F.count(v).alias(f"n{i}"),
        ]
    row = df.agg(*aggs).collect()[0]
    out = {}
    for i, c in enumerate(cols):
        if row[f"n{i}"] == 0:
            out[c] = "double"
        elif row[f"ni{i}"] == 0:
            out[c] = "bigint"
        elif row[f"nd{i}"] == 0:
            out[c] = "double"
        elif row[f"nb{i}"] == 0:
            out[c] = "boolean"
        else:
            out[c] = "string"
    return out


def write_csv(df: DataFrame, path: str, na: str = "NA") -> None:
    """Header CSV with gaps written as ``na`` (so a round trip exercises the marker mapping)."""
    df.write.mode("overwrite").option("header", True).option("nullValue", na).option("emptyValue", "").option("quote", '"').option("escape", '"').csv(path)
