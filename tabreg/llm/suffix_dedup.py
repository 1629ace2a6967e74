"""Operator 12, suffix-array dedup: bucket-pointer refinement of byte suffixes.

A byte goes if a ``window``-byte string (50) over it also starts in a document of smaller id. The
suffixes are sorted only as deep as ``window``, by refining buckets, and a suffix alone in its bucket
(no second document) leaves at once, so that each level is smaller than the one before:

1. *Initial buckets*: 16-byte grams. Of each window the gram with the least hash stands for it (its
   anchor), so one position in about 17 is a bucket member and equal windows have equal anchors.
   A bucket of a single document is done; windows with another anchor go on, cut out of their
   texts as pieces.
2. *Runs of buckets, reused*: the text from an anchor to the fourth anchor after it is named by
   the bucket identifiers at the offsets between, by doubling (one gap, two gaps, four gaps). If the
   least document of such a run is a smaller one, all windows in it are decided, and neither sorted
   nor counted again: the smaller document has them too.
3. *Depth 32*: the buckets of anchors that still have an undecided window are refined by the bucket
   identifier 16 bytes later (for windows that start up to 17 bytes before the anchor) or earlier.
4. *Depth 50*: the windows left, by the identifiers at offsets 0, 16, 32 and 34.

Members travel in blocks. A block is the anchors of one slice of texts (about ``BATCH_BYTES``): its distinct identifiers
are sorted, each with its least document there, and cut at ranges of the identifier. A range gathers one
packed row of each block, sorts it in arrays, and sends back a bit for each identifier. So a bucket that holds a third of all
rows is one identifier of each block, a range holds about ``RANGE_IDS`` identifiers however many there
are, and a member costs some 12 bytes of shuffle instead of a row of its own. Equal texts are one class: the smallest id is judged, the others lose everything (from 50 bytes on). A window is
wrongly removed only if two 64-bit identifiers collide: candidate windows / 2^64.

Defined results: null text is empty text; texts under 50 bytes keep all; rows with equal ids are one
document, whatever their texts, so they never remove each other's bytes; a row with a null id neither loses
bytes nor removes any; an empty table gives no rows; other columns are not read. A very long text is
worked on in parts of ``PART`` bytes (windows across a cut belong to the part they start in); only
its places, not its arrays, are held at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, discard, id_and_bytes, mix, record_batch, table, tidy, written

WINDOW = 50
GRAM = 16
#: Gaps between anchors in a run of level 2 (a power of two).
GAPS = 4
#: Bytes of text on which the vector steps work at a time.
PART = 512 << 10
_NOTHING = hashlib.sha256(b"").hexdigest()
_SALT = [np.uint64(s) for s in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]

#: Identifiers that one range of buckets holds, about, and the least number of ranges.
RANGE_IDS = 500_000
LEAST_RANGES = 1024
#: A block stands on the first of its rows (others: null), whose keys are consecutive: the anchors'
#: identifiers and places, one row's after the other's, and each row's document and number of anchors.
_BLOCK = [("ids", pa.binary()), ("places", pa.binary()), ("docs", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64()))]
_BLOCK_SQL = "ids binary, places binary, docs array<long>, sizes array<long>"
_INFO = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("key", pa.binary()), ("n_bytes", pa.int64()), ("sha", pa.string()), *_BLOCK])
#: Pieces of texts, a block a row: the pieces' bytes, a zero byte after each, and by piece its text, document,
#: offset there, length and number of anchors; places and ends count in the block's bytes.
_PIECES = pa.schema([("block", pa.int64()), ("rids", pa.list_(pa.int64())), ("bases", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())),
                     ("bytes", pa.binary()), ("ends", pa.binary()), *_BLOCK])
_PIECES_SQL = "block long, rids array<long>, bases array<long>, lengths array<long>, bytes binary, ends binary, " + _BLOCK_SQL
#: The same with a bit for each open window, and ranges decided, one list a text.
_HALVES = pa.schema([*_PIECES, ("open", pa.binary()), ("rid", pa.list_(pa.int64())), ("begin", pa.list_(pa.list_(pa.int64()))), ("end", pa.list_(pa.list_(pa.int64())))])
_HALVES_SQL = _PIECES_SQL + ", open binary, rid array<long>, begin array<array<long>>, end array<array<long>>"
_WINDOWS = pa.schema([("block", pa.int64()), ("rids", pa.list_(pa.int64())), ("bases", pa.list_(pa.int64())), *_BLOCK])
_RANGES = pa.schema([("rid", pa.int64()), ("begins", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))])
_ASKED = pa.schema([("range", pa.int64()), ("block", pa.int64()), ("hashes", pa.binary()), ("least", pa.binary()), ("several", pa.binary())])
_TOLD = pa.schema([("range", pa.int64()), ("block", pa.int64()), ("bits", pa.binary())])
_DECIDED = pa.schema([("rid", pa.int64()), ("decided", pa.list_(pa.int32()))])
_CUT = pa.schema([("key", pa.binary()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("cut_sha", pa.string())])


def gram_ids(data: np.ndarray) -> np.ndarray:
    """Identifier (odd, so never 0) of the 16 bytes at every place of ``data``."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    words = np.empty(len(data) - 7, np.uint64)
    for r in range(min(8, len(words))):
        count = (len(data) - r) // 8
        words[r::8] = data[r: r + 8 * count].view("<u8")
    with np.errstate(over="ignore"):
        return mix(mix(words[:n] + _SALT[0]) * _SALT[1] + words[8: 8 + n]) | np.uint64(1)


def chain(*ids: np.ndarray) -> np.ndarray:
    """One identifier for several, in order."""
    with np.errstate(over="ignore"):
        out = mix(ids[0] + _SALT[2])
        for x in ids[1:]:
            out = mix(out * _SALT[3] + x)
        return out


def _slide(op, x: np.ndarray, width: int) -> np.ndarray:
    size, out = 1, x
    while 2 * size <= width:
        out, size = op(out[:-size], out[size:]), 2 * size
    n = len(x) - width + 1
    return op(out[:n], out[width - size: width - size + n])


_WIDTH = WINDOW - GRAM + 1


def _anchors(grams: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of the grams that are the least of some wanted window."""
    least = np.where(wanted, _slide(np.minimum, grams, _WIDTH), np.uint64(0))
    edge = np.zeros(_WIDTH - 1, np.uint64)
    return np.flatnonzero(_slide(np.maximum, np.concatenate((edge, least, edge)), _WIDTH) == grams)


def _parts(texts: list[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts, one after the other, in parts of about ``PART`` bytes: bytes, and for each text in it
    its number, the place in the part where it begins, and its offset there in the text."""
    held, size = [], 0
    for number, text in enumerate(texts):
        if not text or len(text) < WINDOW:
            continue
        at = 0
        while at == 0 or at + WINDOW <= len(text):
            piece = text[at: at + PART + WINDOW - 1]
            if size and size + len(piece) > PART:
                yield _joined(held)
                held, size = [], 0
            held.append((number, piece, at))
            size += len(piece)
            at += PART
    if held:
        yield _joined(held)


def _joined(held: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    starts = np.cumsum([0] + [len(p) for _, p, _ in held])
    return np.frombuffer(b"".join([p for _, p, _ in held]), np.uint8), starts, np.array([n for n, _, _ in held]), np.array([a for _, _, a in held])


def _inside(starts: np.ndarray, size: int) -> np.ndarray:
    """Of each window of a part whether it lies in one text."""
    n = size - WINDOW + 1
    return np.arange(WINDOW, WINDOW + n) <= np.repeat(starts[1:], np.diff(starts))[:n]


def _first_level(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid = TaskContext.get().partitionId() << 33
        for batch, found in chunks(batches):
            empty = np.zeros(0, np.int64)
            ids: list[list] = [[] for _ in found]
            places: list[list] = [[] for _ in found]
            with_id = [t if v else None for t, v in zip(found, batch.column(0).is_valid().to_pylist(), strict=True)]
            for data, starts, numbers, offsets in _parts(with_id):
                grams = gram_ids(data)
                at = _anchors(grams, _inside(starts, len(data)))
                edges = np.searchsorted(at, starts)
                for k, number in enumerate(numbers.tolist()):
                    mine = at[edges[k]: edges[k + 1]]
                    ids[number].append(grams[mine].view(np.int64))
                    places[number].append(mine - starts[k] + offsets[k])
            sizes = [sum(map(len, x)) for x in ids]
            ids, places = (np.concatenate([empty, *[x for row in rows for x in row]]) for rows in (ids, places))
            yield record_batch(_INFO, np.arange(rid, rid + len(found)), batch.column(0), batch.column(2), [len(t or b"") for t in found],
                               [hashlib.sha256(t or b"").hexdigest() for t in found], *_block(ids, places, batch.column(0).fill_null(0).to_numpy(), sizes, rows=len(found)))
            rid += len(found)

    return texts.mapInArrow(run, "rid long, doc_id long, key binary, n_bytes long, sha string, " + _BLOCK_SQL)


def _block(ids: np.ndarray, places: np.ndarray, docs: np.ndarray, sizes: list | np.ndarray, rows: int) -> list[pa.Array]:
    """The columns of ``_BLOCK``, on the first of ``rows`` rows, for the documents ``docs`` with ``sizes`` anchors each."""
    values = (ids.astype(np.int64).tobytes(), places.astype(np.int32).tobytes(), docs, sizes)
    return [pa.array([v, *[None] * (rows - 1)], kind) for v, (_, kind) in zip(values, _BLOCK, strict=True)]


class _Members:
    """The anchors of a block by distinct identifier: ``hashes``, sorted, with the ``least`` and
    ``largest`` document of each; ``of`` leads back from an anchor; ``ranges`` are cut at ``edges``."""

    def __init__(self, ids: bytes, docs: list[int], sizes: list[int], n_ranges: int):
        self.docs = np.repeat(np.array(docs, np.int64), sizes)
        hashes = mix(np.frombuffer(ids, np.uint64))
        order = np.argsort(hashes)
        hashes, docs = hashes[order], self.docs[order]
        new = np.concatenate(([True], hashes[1:] != hashes[:-1]))[: len(hashes)]
        first = np.flatnonzero(new)
        self.of = np.empty(len(order), np.int64)
        self.of[order] = np.cumsum(new) - 1
        self.hashes = hashes[first]
        self.least = np.minimum.reduceat(docs, first) if len(first) else docs
        self.largest = np.maximum.reduceat(docs, first) if len(first) else docs
        number = ((self.hashes >> np.uint64(32)) * np.uint64(n_ranges) >> np.uint64(32)).astype(np.int64)
        starts = np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1]))[: len(number)])
        self.ranges, self.edges = number[starts], np.append(starts, len(number))


def _slices(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    """One binary value for each range between ``edges``."""
    offsets = (edges * values.itemsize).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())])


def _ask(blocks: DataFrame, n_ranges: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block, ids, docs, sizes = (c[row].as_py() for c in batch.columns[:4])
                m = _Members(ids, docs, sizes, n_ranges)
                several = (m.least < m.largest).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([
                    pa.array(m.ranges), pa.array(np.full(len(m.ranges), block)), _slices(m.hashes, m.edges), _slices(m.least, m.edges), _slices(several, m.edges)], schema=_ASKED)

    return blocks.select("block", "ids", "docs", "sizes").mapInArrow(run, "range long, block long, hashes binary, least binary, several binary")


def _tell(asked: DataFrame, smaller: bool) -> DataFrame:
    """For each row asked a bit for each identifier: whether its bucket has a document smaller than
    the least of the block (``smaller``), or several documents."""

    def run(rows: pa.Table) -> pa.Table:
        hashes, least, several = (np.frombuffer(b"".join(rows.column(c).to_pylist()), t) for c, t in (("hashes", np.uint64), ("least", np.int64), ("several", np.uint8)))
        edges = np.cumsum([0] + [len(v) for v in rows.column("several").to_pylist()])
        order = np.argsort(hashes, kind="stable")
        new = np.concatenate(([True], hashes[order][1:] != hashes[order][:-1]))
        first, bucket = np.flatnonzero(new), np.cumsum(new) - 1
        low = np.minimum.reduceat(least[order], first)
        if smaller:
            found = low[bucket] < least[order]
        else:
            found = ((low < np.maximum.reduceat(least[order], first)) | (np.maximum.reduceat(several[order], first) > 0))[bucket]
        told = np.empty(len(order), bool)
        told[order] = found
        bits = [np.packbits(told[a:b]).tobytes() if told[a:b].any() else None for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
        out = pa.Table.from_arrays([rows.column("range"), rows.column("block"), pa.array(bits, pa.binary())], schema=_TOLD)
        return out.filter(out.column("bits").is_valid())

    return asked.groupBy("range").applyInArrow(run, "range long, block long, bits binary")


def _answered(blocks: DataFrame, smaller: bool) -> tuple[DataFrame, DataFrame, int]:
    """Blocks with the answers to them in ``told``, the table of the answers, and the number of ranges."""
    total = blocks.select(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda x, y: x + y))).first()[0] or 0
    n_ranges = max(LEAST_RANGES, -(-total // RANGE_IDS))
    told = written(_tell(_ask(blocks, n_ranges), smaller), "told")
    tidy(blocks.sparkSession)
    # a block has one row on either side
    answers = told.groupBy("block").agg(F.collect_list(F.struct("range", "bits")).alias("told")).hint("shuffle_hash")
    return blocks.join(answers, "block", "left"), told, n_ranges


def _decided(row: dict, n_ranges: int, smaller: bool) -> np.ndarray:
    """Of each anchor of a block whether its bucket has several documents; ``smaller``: a smaller one."""
    m = _Members(row["ids"], row["docs"], row["sizes"], n_ranges)
    flags = np.zeros(len(m.hashes), bool)
    for answer in row["told"] or ():
        i = np.searchsorted(m.ranges, answer["range"])
        a, b = m.edges[i: i + 2]
        flags[a:b] = np.unpackbits(np.frombuffer(answer["bits"], np.uint8), count=b - a)
    return flags[m.of] | (m.docs > m.least[m.of]) if smaller else flags[m.of]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for row in range(batch.num_rows):
            yield {name: column[row].as_py() for name, column in zip(batch.schema.names, batch.columns, strict=True)}


def _by_text(rids: np.ndarray, *values: np.ndarray) -> list:
    """The texts of a block in their order, and for each the list of its values (its rows are neighbours)."""
    edges = np.flatnonzero(np.concatenate(([True], rids[1:] != rids[:-1]))[: len(rids)])
    return [rids[edges], *[_lists(v, np.append(edges, len(rids)), pa.int64()) for v in values]]


def _first_decided(info: DataFrame) -> DataFrame:
    """``rid, decided``: places of the anchors whose bucket has several documents."""
    blocks = info.where("ids IS NOT NULL").select(F.col("rid").alias("block"), *[n for n, _ in _BLOCK])
    joined, told, n_ranges = _answered(blocks, smaller=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            mine = _decided(row, n_ranges, smaller=False)
            owner, places = np.repeat(np.arange(len(row["sizes"])), row["sizes"])[mine], np.frombuffer(row["places"], np.int32)[mine]
            order = np.lexsort((places, owner))
            use, decided = _by_text(owner[order], places[order])
            yield pa.RecordBatch.from_arrays([pa.array(row["block"] + use), decided.cast(pa.list_(pa.int32()))], schema=_DECIDED)

    out = written(joined.mapInArrow(run, "rid long, decided array<int>"), "decided")
    del joined
    discard(told)
    return out


def _stretches(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).astype(np.int8)))
    return edges[::2], edges[1::2]


def _lists(values: np.ndarray, edges: np.ndarray, kind: pa.DataType) -> pa.Array:
    """One list for each range between ``edges``."""
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(values, kind))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column (null: no values), one after the other, and the row of each."""
    sizes = np.array(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(column)), sizes)


def run_ids(grams: np.ndarray, at: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Identifier, begin and end of the runs from each anchor to the ``GAPS``-th after it: the gaps'
    buckets (identifiers at offsets 0, 16, 32 and at the next anchor), then by doubling. ``same``
    tells whether an anchor and the next one stand in one text."""
    if len(at) <= GAPS:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = at[:-1], at[1:]
    gap = b - a
    ids = chain(gap.astype(np.uint64), grams[a], grams[np.minimum(a + GRAM, b)], grams[np.minimum(a + 2 * GRAM, b)], grams[b])
    ids, width = np.where(same & (gap <= 3 * GRAM), ids, np.uint64(0)), 1
    while width < GAPS:
        x, y = ids[:-width], ids[width:]
        ids, width = np.where((x > 0) & (y > 0), chain(x, y), np.uint64(0)), 2 * width
    use = np.flatnonzero(ids)
    return ids[use], at[use], at[use + GAPS] + GRAM


def _run_level(texts: DataFrame) -> DataFrame:
    """Pieces of ``key, rid, __id, __text, decided`` rows (places of the anchors left), with runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 33
        for batch, found in chunks(batches):
            rids, docs = (batch.column(i).to_numpy() for i in (0, 1))
            decided, owner = _flat(batch.column(3))
            for data, starts, numbers, offsets in _parts(found):
                grams, wanted = gram_ids(data), _inside(starts, len(data))
                left = np.full(len(grams), np.iinfo(np.uint64).max)
                for k, number in enumerate(numbers.tolist()):
                    i, j = np.searchsorted(owner, (number, number + 1))
                    mine = decided[i:j] - offsets[k]
                    mine = mine[(mine >= 0) & (mine <= starts[k + 1] - starts[k] - GRAM)] + starts[k]
                    left[mine] = grams[mine]
                wanted &= _slide(np.minimum, left, _WIDTH) == _slide(np.minimum, grams, _WIDTH)
                first, last = _stretches(wanted)
                of = np.searchsorted(starts, first, side="right") - 1
                at = _anchors(grams, wanted)
                text_of = np.searchsorted(starts, at, side="right")
                ids, begins, ends = run_ids(grams, at, text_of[1:] == text_of[:-1])
                # a run belongs to the stretch in which it begins, if it ends there too
                home = np.searchsorted(first, begins, side="right") - 1
                use = ends <= last[home] + WINDOW - 1 if len(begins) else np.zeros(0, bool)
                ids, begins, ends, home = ids[use], begins[use], ends[use], home[use]
                if len(first):
                    lengths, raw, mine = last - first + WINDOW - 1, data.tobytes(), numbers[of]
                    shift = _starts(lengths) - first
                    sizes = np.diff(np.searchsorted(home, np.arange(len(first) + 1)))
                    joined = b"\0".join([*[raw[i: j + WINDOW - 1] for i, j in zip(first.tolist(), last.tolist(), strict=True)], b""])
                    yield record_batch(_PIECES, [block], [rids[mine]], [first - starts[of] + offsets[of]], [lengths], [joined],
                                       [(ends + shift[home]).astype(np.int32).tobytes()], *_block(ids, begins + shift[home], docs[mine], sizes, rows=1))
                    block += 1

    return texts.select("rid", "__id", "__text", "decided").mapInArrow(run, _PIECES_SQL)


def _own_anchor(grams: np.ndarray) -> np.ndarray:
    """The first place of the least gram of each window, by doubling."""
    least, place, size = grams, np.arange(len(grams)), 1

    def better(value, where, other, there):
        right = other < value
        return np.where(right, other, value), np.where(right, there, where)

    while 2 * size <= _WIDTH:
        (least, place), size = better(least[:-size], place[:-size], least[size:], place[size:]), 2 * size
    n, step = len(grams) - _WIDTH + 1, _WIDTH - size
    return better(least[:n], place[:n], least[step: step + n], place[step: step + n])[1]


def _side(anchor: np.ndarray) -> np.ndarray:
    """For each window: twice its anchor, plus 1 if it is refined by the gram before the anchor."""
    return 2 * anchor + (anchor - np.arange(len(anchor)) > WINDOW - 2 * GRAM - 1)


def _side_ids(grams: np.ndarray, places: np.ndarray) -> np.ndarray:
    at, before = places // 2, places % 2
    return chain(grams[at - GRAM * before], grams[at + GRAM * (1 - before)], before.astype(np.uint64))


def _starts(lengths: np.ndarray) -> np.ndarray:
    """Where pieces of these lengths begin in a row, a byte after each."""
    return np.cumsum(lengths + 1) - lengths - 1


def _inside_pieces(first: np.ndarray, lengths: np.ndarray, size: int) -> np.ndarray:
    """Of each window of a row of pieces whether it lies in one piece."""
    n = max(0, size - WINDOW + 1)
    return np.arange(WINDOW, WINDOW + n) <= np.repeat(first + lengths, lengths + 1)[:n]


def _half_level(pieces: DataFrame, n_ranges: int) -> DataFrame:
    """Depth 32 for pieces with an undecided window; what is decided goes out as ranges of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            data, lengths = np.frombuffer(row["bytes"], np.uint8), np.array(row["lengths"])
            rids, bases, docs = (np.array(row[c]) for c in ("rids", "bases", "docs"))
            first, mine = _starts(lengths), _decided(row, n_ranges, smaller=True)
            begins, ends = (np.frombuffer(row[c], np.int32)[mine].astype(np.int64) for c in ("places", "ends"))
            fits = ends - begins >= WINDOW
            begins, ends = begins[fits], ends[fits]
            still, size = _inside_pieces(first, lengths, len(data)), len(data) + 1
            inner = np.bincount(begins, minlength=size) - np.bincount(ends - WINDOW + 1, minlength=size)
            gone = np.bincount(begins, minlength=size) - np.bincount(ends, minlength=size)
            still &= np.cumsum(inner[: len(still)]) == 0          # windows that lie in no decided run
            lo, hi = _stretches(np.cumsum(gone[:-1]) > 0)
            of = np.searchsorted(first, lo, side="right") - 1
            texts, *ranges = _by_text(rids[of], lo - first[of] + bases[of], hi - first[of] + bases[of])
            grams = gram_ids(data)
            sides = np.unique(_side(_own_anchor(grams))[still])
            sizes = np.diff(np.searchsorted(sides, 2 * np.append(first, len(data))))
            opened = sizes > 0                                     # only these pieces go on
            keep = np.repeat(opened, lengths + 1)
            moved = 2 * (np.cumsum(keep) - 1)[sides // 2] + sides % 2
            bits = np.concatenate((still, np.zeros(len(data) - len(still), bool)))[keep]
            yield record_batch(_HALVES, [row["block"]], [rids[opened]], [bases[opened]], [lengths[opened]], [data[keep].tobytes()], [b""],
                               *_block(_side_ids(grams, sides), moved, docs[opened], sizes[opened], rows=1), [np.packbits(bits).tobytes()],
                               [texts], *[_lists_of(r, _HALVES.field("begin").type) for r in ranges])

    return pieces.select(*_PIECES.names, "told").mapInArrow(run, _HALVES_SQL)


def _lists_of(values: pa.ListArray, kind: pa.DataType) -> pa.Array:
    """One row that holds all these lists."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values).cast(kind)


def _window_level(halves: DataFrame, n_ranges: int) -> DataFrame:
    """Depth 50 for the undecided windows whose bucket of depth 32 has several documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            data, first = np.frombuffer(row["bytes"], np.uint8), _starts(np.array(row["lengths"]))
            still = np.unpackbits(np.frombuffer(row["open"], np.uint8), count=len(data))
            kept = np.zeros(2 * len(data), bool)
            kept[np.frombuffer(row["places"], np.int32)[_decided(row, n_ranges, smaller=False)]] = True
            grams, at = gram_ids(data), np.flatnonzero(still)
            at = at[kept[_side(_own_anchor(grams))[at]]]
            sizes = np.diff(np.searchsorted(at, np.append(first, len(data))))
            ids = chain(grams[at], grams[at + GRAM], grams[at + 2 * GRAM], grams[at + WINDOW - GRAM])
            places = at - np.repeat(first, sizes)
            yield record_batch(_WINDOWS, [row["block"]], [row["rids"]], [row["bases"]], *_block(ids, places, row["docs"], sizes, rows=1))

    names = ["block", "lengths", "bytes", "open", "rids", "bases", "ids", "places", "docs", "sizes", "told"]
    return halves.select(*names).mapInArrow(run, "block long, rids array<long>, bases array<long>, " + _BLOCK_SQL)


def _last_ranges(windows: DataFrame, n_ranges: int) -> DataFrame:
    """``rid, begins, ends``: the decided windows, put together where they meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            mine = _decided(row, n_ranges, smaller=True)
            rids, bases = (np.repeat(np.array(row[c], np.int64), row["sizes"])[mine] for c in ("rids", "bases"))
            at = np.frombuffer(row["places"], np.int32)[mine] + bases
            new = np.flatnonzero(np.concatenate(([True], (rids[1:] != rids[:-1]) | (np.diff(at) > WINDOW) | (np.diff(at) < 0)))[: len(at)])
            last = np.append(new[1:], len(at))[: len(new)] - 1
            texts, begins, ends = _by_text(rids[new], at[new], at[last] + WINDOW)
            yield pa.RecordBatch.from_arrays([pa.array(texts), begins, ends], schema=_RANGES)

    return windows.mapInArrow(run, "rid long, begins array<long>, ends array<long>")


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """All rows (``doc_id, key, n_bytes, sha``: of the whole text), and for each text with bytes to
    remove ``key, rep, begins, ends``: ranges, which may overlap."""
    texts = id_and_bytes(docs, id_col, text_col).withColumn("key", F.unhex(F.md5(F.coalesce("__text", F.lit("").cast("binary")))))
    info = written(_first_level(texts), "suffix-info", plain=True)
    classes = info.where("doc_id IS NOT NULL").groupBy("key").agg(F.min(F.struct("doc_id", "rid")).alias("least"))
    classes = written(classes.select("key", F.col("least.doc_id").alias("rep"), F.col("least.rid").alias("rid")), "suffix-classes")
    rows = written(info.select("doc_id", "key", "n_bytes", "sha"), "suffix-rows")
    decided = _first_decided(info)
    discard(info)
    left = decided.join(classes, "rid")
    # one row of each text goes on: equal texts meet at the same key, and only the smallest id passes
    wanted = texts.join(left, "key").where(F.col("__id") == F.col("rep"))
    pieces = written(_run_level(wanted), "suffix-pieces")
    del left, wanted
    discard(decided)
    joined, told, n_ranges = _answered(pieces, smaller=True)
    halves = written(_half_level(joined, n_ranges), "suffix-halves")
    del joined
    discard(pieces, told)
    joined, told, n_ranges = _answered(halves.where("length(bytes) > 0"), smaller=False)
    windows = written(_window_level(joined, n_ranges), "suffix-windows")
    del joined
    discard(told)
    joined, told, n_ranges = _answered(windows, smaller=True)
    last = _last_ranges(joined, n_ranges)
    runs = halves.select(F.inline(F.arrays_zip("rid", "begin", "end"))).toDF("rid", "begins", "ends")
    ranges = last.unionByName(runs).groupBy("rid").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("begins", "ends")])
    ranges = written(ranges.join(classes, "rid").select("key", "rep", "begins", "ends"), "suffix-ranges")
    del joined, last, runs
    discard(halves, windows, told)
    return rows, ranges


def kept_ranges(n: int, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The removed and the kept ranges of ``n`` bytes: maximal, in order."""
    order = np.argsort(begins, kind="stable")
    begins, ends = begins[order], np.maximum.accumulate(ends[order])
    new = np.concatenate(([True], begins[1:] > ends[:-1]))
    lo, hi = begins[new], ends[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(ends) - 1]))]
    return lo, hi, np.concatenate(([0], hi)), np.concatenate((lo, [n]))


def op12_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows, ranges = repeated_bytes(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in chunks(batches):
            out = []
            for key, text, begins, ends in zip(batch.column(0).to_pylist(), found, batch.column(2), batch.column(3), strict=True):
                lo, hi, a, b = kept_ranges(len(text), begins.values.to_numpy(), ends.values.to_numpy())
                sha = hashlib.sha256()
                for i, j in zip(a.tolist(), b.tolist(), strict=True):
                    sha.update(memoryview(text)[i:j])
                out.append((key, int((hi - lo).sum()), len(lo), sha.hexdigest()))
            yield record_batch(_CUT, *[list(c) for c in zip(*out, strict=True)])

    texts = id_and_bytes(docs, "doc_id", "text").withColumn("key", F.unhex(F.md5("__text")))
    cut = texts.join(ranges, "key").where(F.col("__id") == F.col("rep")).select("key", "__text", "begins", "ends")
    cut = written(cut.mapInArrow(run, "key binary, n_removed long, n_spans long, cut_sha string"), "suffix-cut")
    # equal rows give equal cuts; every class has its smallest id here, and what that id loses, if anything
    least = rows.where("doc_id IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("rep"))
    kept = least.join(cut.dropDuplicates(["key"]), "key", "left")
    copy = (F.col("doc_id") > F.col("rep")) & (F.col("n_bytes") >= WINDOW)
    own = F.col("doc_id") == F.col("rep")
    return rows.join(kept, "key", "left").select(
        "doc_id", "n_bytes", F.when(copy, F.col("n_bytes")).when(own, F.coalesce("n_removed", F.lit(0))).otherwise(0).cast("long").alias("n_removed"),
        F.when(copy, 1).when(own, F.coalesce("n_spans", F.lit(0))).otherwise(0).cast("long").alias("n_spans"),
        F.when(copy, F.lit(_NOTHING)).when(own, F.coalesce("cut_sha", "sha")).otherwise(F.col("sha")).alias("kept_sha256"))


QUERIES = {"op12_suffix_array_dedup": op12_suffix_array_dedup}
ORACLE_SQL = {"op12_suffix_array_dedup": f"""
    WITH t AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
    p AS (SELECT r, doc_id, unnest(range(0, length(x) // 2 - {WINDOW - 1})) AS s FROM t WHERE length(x) >= {2 * WINDOW} AND doc_id IS NOT NULL),
    h AS (SELECT p.r, p.doc_id, s, md5_number(substr(x, 2 * s + 1, {2 * WINDOW})) AS w FROM p JOIN t USING (r)),
    m AS (SELECT w, min(doc_id) AS least FROM h GROUP BY w HAVING min(doc_id) < max(doc_id)),
    g AS (SELECT r, s, s > lag(s) OVER (PARTITION BY r ORDER BY s) + {WINDOW} AS fresh FROM h JOIN m USING (w) WHERE least < doc_id),
    i AS (SELECT r, s, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY s) AS k FROM g),
    c AS (SELECT r, k, min(s) AS lo, max(s) + {WINDOW} AS hi FROM i GROUP BY r, k),
    n AS (SELECT r, lo, hi, lead(lo) OVER (PARTITION BY r ORDER BY lo) AS following, row_number() OVER (PARTITION BY r ORDER BY lo) AS k FROM c),
    a AS (SELECT r, sum(hi - lo) AS gone, count(*) AS spans,
                 string_agg((CASE WHEN k = 1 THEN substr(x, 1, 2 * lo) ELSE '' END) || substr(x, 2 * hi + 1, 2 * (coalesce(following, length(x)) - hi)), '' ORDER BY lo) AS kept
          FROM n JOIN t USING (r) GROUP BY r)
    SELECT doc_id, length(x) // 2 AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans,
           sha256(unhex(coalesce(kept, x))) AS kept_sha256
    FROM t LEFT JOIN a USING (r)"""}
