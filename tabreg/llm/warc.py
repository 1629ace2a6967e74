"""Operator 5, WARC archives and an external merge of their capture indexes.

``write_archives`` writes one gzip member per record; of the pages with equal payloads the one with
the largest id is a response, the others are revisits that refer to it. ``read_runs`` reads archives
back, one task a file, and sorts each file's captures by URL key and time: a run. ``merge_runs``
deals the runs by key range, so that each task holds one short slice of every run, and merges its
slices with a loser tree; the ranges follow one another, so the whole is ordered and ``position`` is
the place in it.

Archives are rolled at ``FILE_BYTES``. Files are named by attempt and only attempts that succeed
name theirs, so a lost executor leaves no wrong data.

Defined results: null html is the empty payload; empty payloads are compared like any other; a null
url has an empty key; if all ids of a payload are null, or equal, its records are all responses; a
null id beside others is a revisit; an empty table gives no rows; other columns are not read. The
capture time, which pages lack, is ``EPOCH`` plus the id in seconds (modulo ten years).
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import record_batch, scratch_path, table, written
from .token_counts import _filesystem

FILE_BYTES = 256 << 20
READ_BYTES = 1 << 16
EPOCH = datetime(2024, 1, 1, tzinfo=UTC)
_URN = "urn:x-page:"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_FILES = pa.schema([("file", pa.string()), ("records", pa.int64())])
_CAPTURES = pa.schema([("url_key", pa.string()), ("captured", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()),
                       ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("file", pa.string()),
                       ("offset", pa.int64()), ("length", pa.int64()), ("seq", pa.int64())])
_CAPTURES_DDL = "url_key string, captured string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, offset long, length long, seq long"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_key(url: str | None) -> str:
    """Host labels from the top level down, then path and query; no scheme, fragment or www."""
    try:
        parts = urlsplit((url or "").strip())
        host = (parts.hostname or "").removeprefix("www.")
    except ValueError:
        return (url or "").lower()
    if not host:
        return (url or "").lower()
    return f"{','.join(reversed(host.split('.')))}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def _time(page_id: int | None) -> str:
    return (EPOCH + timedelta(seconds=(page_id or 0) % (3650 * 86400))).strftime("%Y-%m-%dT%H:%M:%SZ")


def _urn(page_id: int | None) -> str:
    return f"<{_URN}{'' if page_id is None else page_id}>"


def _page(urn: str | None) -> int | None:
    return int(m[1]) if urn and (m := re.fullmatch(rf"<{_URN}(-?\d+)>", urn)) else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response, or with ``refers_to`` a revisit: the HTTP head alone, with the full length in it."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _urn(page_id)), ("WARC-Date", _time(page_id)),
            ("WARC-Payload-Digest", f"sha1:{sha1_base32(payload)}"), ("Content-Type", "application/http; msgtype=response"),
            ("Content-Length", str(len(block)))]
    if url is not None:  # control characters would end the line
        head.append(("WARC-Target-URI", re.sub(r"[\x00-\x20%\x7f-\xa0]", lambda m: quote(m[0]), url)))
    if revisit:
        head += [("WARC-Refers-To", _urn(refers_to)), ("WARC-Profile", _PROFILE)]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    return text.encode() + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    c = zlib.compressobj(4, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def members(stream) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and content of each gzip member; at most one member is held."""
    offset, data = 0, b""
    while data or (data := stream.read(READ_BYTES)):
        d, parts, used = zlib.decompressobj(31), [], 0
        while True:
            parts.append(d.decompress(data))
            used += len(data) - len(d.unused_data)
            data = d.unused_data
            if d.eof:
                break
            if not (data := stream.read(READ_BYTES)):
                raise ValueError(f"the archive ends inside the record at {offset}")
        yield offset, used, b"".join(parts)
        offset += used


def parse(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """WARC fields, HTTP head, payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    return fields, http, payload


def _pages(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    q = lambda c: F.col("`" + c.replace("`", "``") + "`")
    html = F.coalesce(q(html_col).cast("string"), F.lit("")).cast("binary")
    return pages.select(q(id_col).cast("long").alias("page_id"), q(url_col).cast("string").alias("url"), html.alias("payload"), F.sha1(html).alias("digest"))


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   file_bytes: int = FILE_BYTES) -> DataFrame:
    """Archives below ``folder``; returns ``file, records``."""
    rows = _pages(pages, id_col, url_col, html_col)
    owners = written(rows.groupBy("digest").agg(F.max("page_id").alias("owner")), "payload-owners")
    # many pages may share a digest; the join is one that Spark can split where it is skewed
    joined = rows.join(owners, "digest").select("page_id", "url", "payload", "owner")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, out, n, size, count = TaskContext.get(), None, 0, 0, 0
        name = ""
        for batch in batches:
            for page_id, url, payload, owner in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name = f"{folder}/pages-{task.partitionId():07d}-{task.taskAttemptId()}-{count:05d}.warc.gz"
                    where, local = _filesystem(name)
                    where.create_dir(local.rpartition("/")[0], recursive=True)
                    out, n, size, count = where.open_output_stream(local), 0, 0, count + 1
                data = gzip_member(record(page_id, url, payload, None if owner is None or page_id == owner else owner))
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= file_bytes:
                    out.close()
                    out = None
                    yield record_batch(_FILES, [name], [n])
        if out is not None:
            out.close()
            yield record_batch(_FILES, [name], [n])

    return written(joined.mapInArrow(run, "file string, records long"), "archives")


def _key(row: tuple) -> tuple:
    """Order of captures: URL key, time, page, place."""
    return (row[0], row[1], row[2] is not None, row[2] or 0, row[7], row[8])


def read_runs(files: DataFrame) -> DataFrame:
    """The captures in each archive, numbered in their order inside the file (``seq``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                where, local = _filesystem(name)
                rows = []
                with where.open_input_stream(local) as stream:
                    for offset, length, data in members(stream):
                        fields, http, payload = parse(data)
                        full = int(re.search(rb"Content-Length: (\d+)", http)[1])
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        if fields["WARC-Type"] == "response" and (len(payload) != full or sha1_base32(payload) != digest):
                            raise ValueError(f"{name}: the record at {offset} is damaged")
                        url = fields.get("WARC-Target-URI")
                        rows.append((url_key(None if url is None else unquote(url)), fields["WARC-Date"], _page(fields["WARC-Record-ID"]), full, digest, fields["WARC-Type"], _page(fields.get("WARC-Refers-To")), name, offset, length))
                rows.sort(key=_key)
                for a in range(0, len(rows), 10_000):
                    part = rows[a: a + 10_000]
                    yield record_batch(_CAPTURES, *map(list, zip(*part, strict=True)), list(range(a, a + len(part))))

    # a set number of tasks: by the few bytes of their names adaptive execution would put all files in one
    return files.select("file").repartition(max(1, files.count()), "file").mapInArrow(run, _CAPTURES_DDL)


def loser_tree(runs: list[list]) -> Iterator[int]:
    """The numbers of the runs in the order in which their sorted items are taken, smallest first."""
    k = len(runs)
    heads, tree = [0] * k, [-1] * k

    def before(a: int, b: int) -> bool:
        """Whether run a's head comes first; a run at its end loses, and equal heads go by run."""
        if heads[b] >= len(runs[b]):
            return True
        if heads[a] >= len(runs[a]):
            return False
        x, y = runs[a][heads[a]], runs[b][heads[b]]
        return x < y or (x == y and a < b)

    def play(winner: int) -> int:
        """From the run's leaf to the root: each node keeps the loser; -1 is a node not yet met."""
        node = (winner + k) // 2
        while node:
            if tree[node] < 0:
                tree[node] = winner
                return -1
            if not before(winner, tree[node]):
                winner, tree[node] = tree[node], winner
            node //= 2
        return winner

    top = 0
    for r in range(k - 1, -1, -1):
        top = play(r) if k > 1 else r
    while heads[top] < len(runs[top]):
        yield top
        heads[top] += 1
        top = play(top) if k > 1 else top


#: Captures of a key range, which a task holds to merge their runs; there are as many ranges as this asks for.
RANGE_ROWS = 200_000


def merge_runs(runs: DataFrame, partitions: int | None = None) -> DataFrame:
    """All captures in order of URL key, time and page; ``position`` counts from 0."""
    spark = runs.sparkSession
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-runs.count() // RANGE_ROWS))
    dealt = runs.repartitionByRange(n, "url_key", "captured", F.col("page_id").asc_nulls_first(), "file", "offset").sortWithinPartitions("file", "seq")
    out = pa.schema([*_CAPTURES, ("part", pa.int32()), ("place", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if not got:
            return
        rows = pa.Table.from_batches(got)      # slices of runs, one after the other
        keys = list(map(_key, zip(*(c.to_pylist() for c in rows.columns), strict=True)))
        files = rows.column("file").to_pylist()
        starts = [i for i, f in enumerate(files) if not i or f != files[i - 1]]
        slices = [keys[a:b] for a, b in zip(starts, [*starts[1:], len(keys)], strict=True)]
        heads, order = list(starts), []
        for r in loser_tree(slices):
            order.append(heads[r])
            heads[r] += 1
        part = TaskContext.get().partitionId()
        merged = rows.take(order)
        for a in range(0, merged.num_rows, 10_000):
            piece = merged.slice(a, 10_000)
            columns = [pa.concat_arrays(c.chunks) for c in piece.columns]
            yield record_batch(out, *columns, [part] * piece.num_rows, list(range(a, a + piece.num_rows)))

    merged = written(dealt.mapInArrow(run, _CAPTURES_DDL + ", part int, place long"), "merged-index")
    totals = sorted((r["part"], r["n"]) for r in merged.groupBy("part").agg(F.count("*").alias("n")).collect())  # one row a range
    starts, at = [], 0
    for part, size in totals:
        starts.append((part, at))
        at += size
    first = spark.createDataFrame(starts, "part int, first long")
    return merged.join(F.broadcast(first), "part").withColumn("position", F.col("first") + F.col("place")).drop("part", "place", "first", "seq")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_archives(table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))
    captures = merge_runs(written(read_runs(files), "capture-runs"))
    return captures.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured", "position")


QUERIES = {"op5_warc": op5_warc}
ORACLE_SQL: dict[str, str] = {}
