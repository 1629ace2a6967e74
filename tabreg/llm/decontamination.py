"""Operator 9, benchmark decontamination: a generalised suffix automaton of the test items.

The items' normalised words become one automaton that holds every run of words of every item.
Training words are streamed through it while the longest matching length is tracked: wherever that
length reaches a window (``window`` words, or a whole shorter item), the window's words are hit and
its items are known from the state. Only stretches whose neighbouring words all follow one another
in some item can hold a match of two words or more, so the others are stepped over with array
operations and the automaton walks the rest.

The items are dealt to shards of about ``SHARD_WORDS`` words; an item of many words is cut into parts
that overlap by ``window - 1`` words, so each window stays whole. A task builds the automaton of a shard and
stores it below ``spark.checkpoint.dir``; the driver gets the names of the files only. A task that searches
loads one shard at a time (a single one stays loaded), and the hits are merged per document, so that
memory is bounded whatever the benchmark's size; time grows with the number of shards.

Defined results: null texts, and texts without a word, have no words and no hits; null item texts
never match; null item ids match but are not listed; equal item ids count once; rows with equal
document ids are judged each on its own; empty tables give no rows, or no hits; other columns pass.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BATCH_BYTES, chunks, id_and_bytes, map_columns, normal_words, record_batch, scratch_path, table, word_bounds, written
from .token_counts import _filesystem

WINDOW = 13
#: A document is contaminated if hit words are at least one in so many.
ONE_IN = 20
#: Item words of one automaton, about (a worker peaked at 3 kB a word).
SHARD_WORDS = 125_000

_FOUND = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()),
                    ("spans", pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))),
                    ("items", pa.list_(pa.int64()))])


_PARTS = pa.schema([("item", pa.int64()), ("part", pa.int64()), ("words", pa.binary()), ("n", pa.int64())])


class ItemAutomaton:
    """Suffix automaton over word numbers, with the items of each window."""

    def __init__(self, items: Iterable[tuple[int | None, list[bytes]]], window: int):
        self.window = window
        self.words: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        coded = []
        for item, words in items:
            ids = [self.words.setdefault(w, len(self.words) + 1) for w in words]
            if ids:
                coded.append((item, ids))
                last = 0
                for c in ids:
                    last = self._add(last, c)
        pairs = {(a, b) for _, ids in coded for a, b in zip(ids, ids[1:], strict=False)}
        self.base = len(self.words) + 1
        self.pairs = np.array(sorted(a * self.base + b for a, b in pairs), dtype=np.int64)
        self.shortest = min((len(ids) for _, ids in coded), default=window)
        self.shortest = min(self.shortest, window)
        own: dict[tuple[int, int], set | frozenset] = {}
        alone = {item: frozenset((item,)) for item, _ in coded}   # most windows have one item; they share its set
        for item, ids in coded:
            size, state = min(window, len(ids)), 0
            for i, c in enumerate(ids):
                state = self.next[state][c]
                if i + 1 >= size:
                    while self.len[self.link[state]] >= size:
                        state = self.link[state]
                    names = own.setdefault((state, size), alone[item])
                    if item not in names:
                        if isinstance(names, frozenset):
                            own[state, size] = {*names, item}
                        else:
                            names.add(item)
        # of each state: the windows that are suffixes of it, shortest first
        at: dict[int, list[tuple[int, frozenset]]] = {}
        while own:
            (state, size), names = own.popitem()
            at.setdefault(state, []).append((size, frozenset(names)))
        self.windows: list[tuple] = [()] * len(self.len)
        same: dict[tuple, tuple] = {}
        for state in sorted(range(1, len(self.len)), key=self.len.__getitem__):
            found = self.windows[self.link[state]] + tuple(sorted(at.pop(state, ()), key=lambda x: x[0]))
            self.windows[state] = same.setdefault(found, found)

    def _split(self, p: int, q: int, c: int) -> int:
        """The state of ``p``'s longest string followed by ``c``, parted from ``q``."""
        if self.len[q] == self.len[p] + 1:
            return q
        clone = len(self.len)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.len.append(self.len[p] + 1)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _add(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, self.next[last][c], c)
        new = len(self.len)
        self.next.append({})
        self.link.append(0)
        self.len.append(self.len[last] + 1)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, self.next[p][c], c)
        return new

    def _stretches(self, ids: np.ndarray) -> Iterator[tuple[int, int]]:
        """Stretches of words that may hold a window."""
        if self.shortest == 1:
            linked = ids > 0
            at_least, more = 1, 0
        else:
            linked = (ids[:-1] > 0) & (ids[1:] > 0)
            near = np.flatnonzero(linked)
            codes = ids[near] * self.base + ids[near + 1]
            if len(self.pairs):
                where = np.minimum(np.searchsorted(self.pairs, codes), len(self.pairs) - 1)
                linked[near] = self.pairs[where] == codes
            else:
                linked[:] = False
            at_least, more = self.shortest - 1, 1
        edges = np.flatnonzero(np.diff(np.concatenate(([False], linked, [False])).astype(np.int8)))
        first, end = edges[::2], edges[1::2]
        keep = end - first >= at_least
        return zip(first[keep].tolist(), (end[keep] + more).tolist(), strict=True)

    def search(self, docs: list[list[bytes]]) -> list[tuple[list[tuple[int, int]], set]]:
        """Of each document: hit stretches of words, in order and apart, and the items found."""
        sizes = np.fromiter(map(len, docs), np.int64, len(docs)) + 1
        begins = np.concatenate(([0], np.cumsum(sizes)))
        ids = np.zeros(int(begins[-1]), dtype=np.int64)  # a 0 after each document parts it from the next
        for words, a in zip(docs, begins.tolist(), strict=False):
            ids[a: a + len(words)] = np.fromiter(map(self.words.get, words, repeat(0)), np.int64, len(words))
        found: list[tuple[list[tuple[int, int]], set]] = [([], set()) for _ in docs]
        if not len(ids):
            return found
        nexts, links, lens, windows = self.next, self.link, self.len, self.windows
        for a, b in self._stretches(ids):
            doc = int(np.searchsorted(begins, a, side="right")) - 1
            shift, (spans, items), state, size = int(begins[doc]), found[doc], 0, 0
            for i, c in enumerate(ids[a:b].tolist(), a - shift):
                while state and c not in nexts[state]:
                    state = links[state]
                    size = lens[state]
                if c in nexts[state]:
                    state, size = nexts[state][c], size + 1
                for length, names in windows[state]:
                    if length > size:
                        break
                    items |= names
                    first = i + 1 - length
                    while spans and spans[-1][1] >= first:  # touching stretches become one
                        first = min(first, spans.pop()[0])
                    spans.append((first, i + 1))
        return found


class Shard:
    """The stored automaton of a part of the items."""

    loaded: tuple[str, ItemAutomaton] | None = None

    def __init__(self, path: str):
        self.path = path

    def automaton(self) -> ItemAutomaton:
        if Shard.loaded is None or Shard.loaded[0] != self.path:
            Shard.loaded = None  # the one before goes first
            where, local = _filesystem(self.path)
            with where.open_input_file(local) as f:
                Shard.loaded = self.path, pickle.loads(f.read_buffer())
        return Shard.loaded[1]


def _item_parts(items: DataFrame, window: int, step: int) -> DataFrame:
    """``item, part, words, n``: items with words, cut after ``step`` windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            for item, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                words = normal_words(text)
                for part, at in enumerate(range(0, max(1, len(words) - window + 1), step) if words else ()):
                    mine = words[at: at + step + window - 1]
                    yield record_batch(_PARTS, [item], [part], [b" ".join(mine)], [len(mine)])

    return items.mapInArrow(run, "item long, part long, words binary, n long")


def automata(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW,
             shard_words: int = SHARD_WORDS) -> list[Shard]:
    """The benchmark's automata, built in tasks."""
    spark = benchmark.sparkSession
    items = id_and_bytes(benchmark, id_col, text_col).dropDuplicates()
    parts = written(_item_parts(items, window, max(window, shard_words // 16)), "benchmark-parts")
    total = parts.agg(F.sum("n")).first()[0] or 0
    # dealt by hash, so a shard gets a little more or less than its share
    n_shards = 1 if total <= shard_words else -(-5 * total // (4 * shard_words))
    folder = scratch_path(spark, "automata")

    def build(rows: pa.Table) -> pa.Table:
        made = ItemAutomaton([(item, words.split()) for item, words in zip(rows.column("item").to_pylist(), rows.column("words").to_pylist(), strict=True)], window)
        path = f"{folder}/{uuid.uuid4().hex}"
        where, local = _filesystem(path)
        where.create_dir(local.rpartition("/")[0], recursive=True)
        with where.open_output_stream(local) as f:
            pickle.dump(made, f, protocol=5)
        return pa.table({"path": [path]})

    dealt = parts.withColumn("shard", F.pmod(F.xxhash64("item", "part", "words"), F.lit(n_shards)))
    return [Shard(r["path"]) for r in dealt.groupBy("shard").applyInArrow(build, "path string").collect()]


def _merged(parts: list[list[tuple[int, int]]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, end in sorted(s for p in parts for s in p):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((first, end))
    return out


def _search(shards: list[Shard], texts: list[bytes | None]) -> list[tuple[int, list[tuple[int, int]], set]]:
    docs = [normal_words(t) for t in texts]
    found = []
    for shard in shards:
        found.append(shard.automaton().search(docs))
    return [(len(words), _merged([f[i][0] for f in found]), set().union(*(f[i][1] for f in found))) for i, words in enumerate(docs)]


def _slice_bytes(shards: list[Shard]) -> int:
    return BATCH_BYTES if len(shards) <= 1 else 16 * BATCH_BYTES


def find_items(docs: DataFrame, shards: list[Shard], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_hit, spans, items`` of every document (spans: first word, end)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, limit=_slice_bytes(shards)):
            found = _search(shards, texts)
            yield record_batch(_FOUND, batch.column(0), [n for n, _, _ in found], [sum(b - a for a, b in s) for _, s, _ in found],
                               [[{"first": a, "end": b} for a, b in s] for _, s, _ in found],
                               [sorted(x for x in items if x is not None) for _, _, items in found])

    return id_and_bytes(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_words long, n_hit long, spans array<struct<first: long, end: long>>, items array<long>")


def without_contaminated(docs: DataFrame, shards: list[Shard], text_col: str = "text", one_in: int = ONE_IN) -> DataFrame:
    """``docs`` without the rows in which at least one word in ``one_in`` is hit; others unchanged."""
    at, schema = docs.columns.index(text_col), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.append_column("__text", batch.column(at).cast(pa.binary()))
            for part, texts in chunks(iter([rows]), limit=_slice_bytes(shards)):
                found = _search(shards, texts)
                hits = [sum(b - a for a, b in s) for _, s, _ in found]
                clean = pa.array([h == 0 or one_in * h < n for h, (n, _, _) in zip(hits, found, strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays(part.columns[:-1], schema=batch.schema).filter(clean)

    return map_columns(docs, run, schema)


def cut_spans(docs: DataFrame, shards: list[Shard], id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
              one_in: int = ONE_IN) -> DataFrame:
    """``doc_id, text, n_removed``: the original text without hit stretches of at least ``window``
    words, or without any hit stretch where hits are one word in ``one_in`` or more."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_removed", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, limit=_slice_bytes(shards)):
            out: list = []
            for text, (n, spans, _) in zip(texts, _search(shards, texts), strict=True):
                whole = spans and one_in * sum(b - a for a, b in spans) >= n
                gone = [(a, b) for a, b in spans if whole or b - a >= window]
                if gone:
                    bounds, kept, at = word_bounds(text), [], 0
                    for a, b in gone:
                        kept.append(text[at: bounds[a][0]])
                        at = bounds[b - 1][1]
                    text = b"".join([*kept, text[at:]])
                out.append((text, sum(b - a for a, b in gone)))
            yield record_batch(schema, batch.column(0), [None if t is None else t.decode("utf-8", "replace") for t, _ in out], [n for _, n in out])

    return id_and_bytes(docs, id_col, text_col).mapInArrow(run, "doc_id long, text string, n_removed long")


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = automata(table(spark, sf_dir, "benchmark"))
    names = F.expr("concat_ws(',', array_sort(transform(items, i -> cast(i AS string))))")
    return find_items(table(spark, sf_dir, "documents"), shards).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.col("n_hit") * ONE_IN >= F.col("n_words"))).alias("contaminated"))


QUERIES = {"op9_benchmark_decontamination": op9_benchmark_decontamination}
_SQL_WORDS = r"""coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"""
ORACLE_SQL = {"op9_benchmark_decontamination": f"""
    WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_SQL_WORDS} AS words FROM documents),
    i AS (SELECT item_id, words, least(13, len(words)) AS n FROM (SELECT item_id, {_SQL_WORDS} AS words FROM benchmark) WHERE len(words) > 0),
    s AS (SELECT item_id, words, n, unnest(range(1, len(words) - n + 2)) AS s FROM i),
    g AS (SELECT DISTINCT item_id, n, array_to_string(words[s:s + n - 1], ' ') AS run FROM s),
    p AS (SELECT r, words, n, unnest(range(1, len(words) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM i) WHERE len(words) >= n),
    h AS (SELECT r, s, p.n, item_id FROM p JOIN g ON g.n = p.n AND g.run = array_to_string(words[s:s + p.n - 1], ' ')),
    w AS (SELECT r, count(DISTINCT i) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS i FROM h) GROUP BY r),
    t AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
          FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item_id FROM h WHERE item_id IS NOT NULL) GROUP BY r)
    SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
    FROM d LEFT JOIN w USING (r) LEFT JOIN t USING (r)"""}
