"""Trees as Spark jobs (M2, M3, M4 and the grid search): many models over the same rows at once.

* **Rows, once.** Bins are told from all rows (one for each value up to ``max_bin`` values, else the bounds of
  equal shares, found by counting value ranges; never by a sample or a sketch that depends on partitions),
  rows are packed in blocks of cells and persisted. Columns may be named ones or one sparse vector, which
  is never unfolded.
* **Groups, for boosting.** Rows of equal cells always share a leaf: they are shuffled together by a hash of the
  cells, and each (cells, fold) becomes one weighted row, with the labels behind it for the scores. Trees are the
  same as from single rows; rounds cost as many steps as there are different rows of cells. Bootstraps draw
  single rows, so forests read the blocks.
* **Large nodes.** One job makes the histograms that all models want next: a task routes its rows through
  the trees as known, adds up whole numbers per (model, node, cell) and emits each cell once;
  ``groupBy(cell)`` adds the tasks' sums.
* **Small nodes.** Rows of a node with at most ``UNIT_BYTES`` of them are dealt by (model, node) to a task
  that grows all below it; the driver replays best-first growth with the gains that come back. A model
  whose rows all fit goes to one task with all its rounds (boosting) or tree by tree (forest).
  Sums are whole numbers and growth is the same code, so neither bound changes a tree by a bit.
* **Rounds.** Trees since the last checkpoint travel with each job; every ``CHECKPOINT`` rounds the blocks are
  written with all models' predictions, and the blocks written before are deleted.

The driver holds trees and the histograms of ``TASK_CELLS`` cells at a time. A forest of unbounded depth
has as many leaves as rows; beyond ``MAX_NODES`` nodes in all it is an error that asks for a bound.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..names import column
from ..session import delete_dir, fresh_dir
from . import trees as T
from .trees import Growth, Layout, Limits, Tree

#: Rows of one node, or of one model, that a single task may take.
UNIT_BYTES = 32 << 20
#: Rows shuffled to one partition of groups (as planned), and groups in a block of them.
PART_BYTES, BLOCK_GROUPS = 8 << 20, 1 << 13
#: Rows in a block, rounds between checkpoints, nodes of all trees of a fit.
BLOCK_ROWS, CHECKPOINT, MAX_NODES = 1 << 16, 10, 50_000_000

_BLOCK = "n int, cells binary, y binary, fold binary, key binary, p binary"
#: The same for groups of ``w`` rows: ``s`` sums their whole-number labels.
_GROUPS = "n int, cells binary, s binary, fold binary, w binary, p binary"
_TREE_SQL = "unit long, tree int, cell array<int>, left array<int>, right array<int>, value array<double>, gain array<double>, n array<long>, depth array<int>"
_TREE = pa.schema([("unit", pa.int64()), ("tree", pa.int32()), ("cell", pa.list_(pa.int32())), ("left", pa.list_(pa.int32())), ("right", pa.list_(pa.int32())),
                   ("value", pa.list_(pa.float64())), ("gain", pa.list_(pa.float64())), ("n", pa.list_(pa.int64())), ("depth", pa.list_(pa.int32()))])
_SUB_SQL = "unit long, cell array<int>, left array<int>, gain array<double>, n array<long>, g array<long>"
_SUB = pa.schema([("unit", pa.int64()), ("cell", pa.list_(pa.int32())), ("left", pa.list_(pa.int32())), ("gain", pa.list_(pa.float64())), ("n", pa.list_(pa.int64())),
                  ("g", pa.list_(pa.int64()))])


@dataclass(frozen=True)
class Spec:
    """A model to grow: boosting at ``rate``, or a forest (None); ``held_out``: the fold it doesn't see."""

    limits: Limits
    trees: int
    rate: float | None = None
    held_out: int = -1
    bootstrap: bool = True


class TreeRows:
    """Training rows as persisted blocks of cells."""

    def __init__(self, df: DataFrame, features: list[str], label: str = "label", fold: str | None = None, key: str | None = None, max_bin: int = 255):
        self.features = list(features)
        vector = "features" in df.columns and "features" not in self.features
        named = [] if vector else [column(c).cast("double").alias(f"x{i}") for i, c in enumerate(self.features)]
        by = column(key).cast("string") if key else F.to_json(F.struct(*([F.col("features")] if vector else [column(c) for c in self.features]), column(label)))
        rows = df.select(column(label).cast("double").alias("y"), (column(fold) if fold else F.lit(0)).cast("int").alias("fold"),
                         F.xxhash64(by).alias("key"), *([F.col("features")] if vector else named))
        self._read = _vector_entries if vector else _column_entries
        low, high, self.n, values, stored = self._values(rows, max_bin)
        self.middle = low / 2 + high / 2
        self.scale = T.scale_of(low, high, self.n)
        self.layout = Layout(self._edges(rows, values, stored, max_bin))
        self.blocks = self._packed(rows).persist(StorageLevel.MEMORY_AND_DISK)
        self.row_bytes, self.folds = self._folds()
        self._groups = None

    def release(self) -> None:
        self.blocks.unpersist()
        if self._groups is not None:
            self._groups.unpersist()

    def _values(self, rows: DataFrame, max_bin: int) -> tuple[float, float, int, dict, dict]:
        """Label bounds, row count, and for each feature its values other than 0 (more than ``max_bin``
        of them: some) and how many rows have one."""
        read, nf, most = self._read, len(self.features), max_bin + 1

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: list[np.ndarray] = [np.zeros(0)] * nf
            stored, low, high, n = np.zeros(nf, np.int64), np.inf, -np.inf, 0
            for batch in batches:
                y = batch.column(0).to_numpy(zero_copy_only=False)
                if len(y):
                    low, high, n = min(low, y.min()), max(high, y.max()), n + len(y)
                _, f, v = read(batch)
                stored += np.bincount(f, minlength=nf)
                order = np.lexsort((v, f))
                f, v = f[order], v[order]
                new = np.ones(len(f), bool)
                new[1:] = (f[1:] != f[:-1]) | (v[1:] != v[:-1])
                new &= ~np.isnan(v)
                f, v = f[new], v[new]
                edges = np.searchsorted(f, np.arange(nf + 1))
                for i in np.flatnonzero(np.diff(edges)).tolist():
                    if len(seen[i]) < most:
                        seen[i] = np.union1d(seen[i], v[edges[i]: edges[i + 1]])[:most]
            at = np.flatnonzero(stored)
            f = [np.full(len(seen[i]) or 1, i) for i in at]
            v = [seen[i] if len(seen[i]) else np.array([np.nan]) for i in at]
            counts = [np.concatenate(([stored[i]], np.zeros(max(0, len(seen[i]) - 1), np.int64))) for i in at]
            if n:
                f, v, counts = [*f, np.array([-1, -1])], [*v, np.array([low, high])], [*counts, np.array([n, 0])]
            if f:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(f), pa.int32()), pa.array(np.concatenate(v)), pa.array(np.concatenate(counts), pa.int64())], names=["f", "v", "n"])

        found = rows.mapInArrow(run, "f int, v double, n long").groupBy("f").agg(
            F.min("v").alias("low"), F.max(F.when(~F.isnan("v"), F.col("v"))).alias("high"), F.sum("n").alias("n"),
            F.slice(F.array_sort(F.collect_set(F.when(~F.isnan("v"), F.col("v")))), 1, most).alias("values")).collect()
        head = next((r for r in found if r["f"] == -1), None)
        if head is None:
            raise ValueError("no training rows")
        rest = [r for r in found if r["f"] >= 0]
        return head["low"], head["high"], head["n"], {r["f"]: np.array(r["values"] or []) for r in rest}, {r["f"]: r["n"] for r in rest}

    def _edges(self, rows: DataFrame, values: dict, stored: dict, max_bin: int) -> list[np.ndarray]:
        edges = []
        for f in range(len(self.features)):
            own = values.get(f, np.zeros(0))
            if stored.get(f, 0) < self.n:
                own = np.union1d(own, [0.0])
            edges.append(own if len(own) else np.zeros(1))
        many = np.array([f for f, e in enumerate(edges) if len(e) > max_bin], np.int64)
        if len(many):
            for f, e in self._shares(rows, many, stored, max_bin).items():
                edges[f] = e
        return edges

    def _shares(self, rows: DataFrame, many: np.ndarray, stored: dict, max_bin: int) -> dict[int, np.ndarray]:
        """Bounds of about ``max_bin`` equal shares of the rows: values are counted by ranges (the high
        bits of their order), and ranges with too many rows by finer ones."""
        read, nf = self._read, len(self.features)
        goal = max(1, self.n // max_bin)
        ranges = {int(f): {} for f in many}        # feature -> {(shift, range): (rows, largest value)}
        heavy = {int(f): None for f in many}         # ranges to be cut finer; None: all values
        for shift, before in ((48, 64), (36, 48), (24, 36), (12, 24), (0, 12)):
            if not heavy:
                break

            def run(batches: Iterator[pa.RecordBatch], heavy=heavy, shift=shift, before=before) -> Iterator[pa.RecordBatch]:
                parts = {f: [] for f in heavy}
                for batch in batches:
                    _, f, v = read(batch)
                    for i, kept in heavy.items():
                        x = v[(f == i) & ~np.isnan(v)]
                        bits = _ordered(x)
                        if kept is not None:
                            use = np.isin(bits >> np.uint64(before), kept)
                            x, bits = x[use], bits[use]
                        parts[i].append(_counted(bits >> np.uint64(shift), np.ones(len(x), np.int64), x))
                for i, found in parts.items():
                    if found:
                        k, n, top = _counted(*(np.concatenate(c) for c in zip(*found, strict=True)))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), i), pa.int32()), pa.array(k.view(np.int64)), pa.array(n), pa.array(top)], names=["f", "k", "n", "top"])

            found = rows.mapInArrow(run, "f int, k long, n long, top double").groupBy("f", "k").agg(F.sum("n").alias("n"), F.max("top").alias("top")).toPandas()
            nxt = {}
            for i, part in found.groupby("f"):
                k, n, top = part["k"].to_numpy(np.int64).view(np.uint64), part["n"].to_numpy(np.int64), part["top"].to_numpy(np.float64)
                finer = (n > goal) & (shift > 0)
                ranges[int(i)] |= {(shift, int(a)): (int(b), float(c)) for a, b, c in zip(k[~finer], n[~finer], top[~finer], strict=True)}
                if finer.any():
                    nxt[int(i)] = np.sort(k[finer])
            heavy = nxt
        out = {}
        for i, found in ranges.items():
            zeros = self.n - stored.get(i, 0)
            pairs = sorted([(top, n) for n, top in found.values()] + ([(0.0, zeros)] if zeros else []))
            total, sofar, edges = sum(n for _, n in pairs), 0, []
            for top, n in pairs:
                if (sofar + n) * max_bin // total > sofar * max_bin // total:
                    edges.append(top)
                sofar += n
            out[i] = np.unique(edges)
        return out

    def _packed(self, rows: DataFrame) -> DataFrame:
        read, layout = self._read, self.layout

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for a in range(0, whole.num_rows, BLOCK_ROWS):
                    batch = whole.slice(a, BLOCK_ROWS)
                    row, f, v = read(batch)
                    cells = T.pack_rows(layout, row, f, v, batch.num_rows)
                    columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
                    packed = [cells.tobytes(), columns[0].astype(np.float64).tobytes(), columns[1].astype(np.int32).tobytes(), columns[2].tobytes(), b""]
                    yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int32()), *[pa.array([x], pa.binary()) for x in packed]], names=["n", "cells", "y", "fold", "key", "p"])

        return rows.mapInArrow(run, _BLOCK)

    def _folds(self) -> tuple[int, dict[int, tuple[int, int]]]:
        """Bytes of the widest row, and for each fold its rows and the sum of their whole-number labels."""
        middle, scale, kind = self.middle, self.scale, self.layout.kind

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for cells, y, fold, _key, _p in _blocks(batches, kind):
                for f in np.unique(fold).tolist():
                    own = fold == f
                    yield pa.RecordBatch.from_arrays([pa.array([f], pa.int32()), pa.array([int(own.sum())]), pa.array([int(T.whole(y[own] - middle, scale).sum())]),
                                                      pa.array([cells.shape[1] * cells.itemsize + 24], pa.int64())], names=["fold", "n", "s", "bytes"])

        found = self.blocks.mapInArrow(run, "fold int, n long, s long, bytes long").groupBy("fold").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.max("bytes").alias("bytes")).collect()
        return max(r["bytes"] for r in found), {r["fold"]: (r["n"], r["s"]) for r in found}

    @property
    def groups(self) -> DataFrame:
        """Blocks of groups: rows of equal cells and fold, with their labels one group after the other (``y``)."""
        if self._groups is None:
            self._groups = self._grouped().persist(StorageLevel.MEMORY_AND_DISK)
        return self._groups

    def boosting_blocks(self) -> DataFrame:
        return self.groups.select("n", "cells", "s", "fold", "w", F.lit(b"").alias("p"))

    def _grouped(self) -> DataFrame:
        layout, middle, scale, most = self.layout, self.middle, self.scale, 4 * PART_BYTES
        spark = self.blocks.sparkSession
        parts = min(4096, max(spark.sparkContext.defaultParallelism, -(-self.n * self.row_bytes // PART_BYTES)))
        columns, kinds = ["y", "fold"], [np.float64, np.int32]

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for cells, y, fold, _key, _p in _blocks(batches, layout.kind):
                to = (_hashed(cells, layout.cells) % np.uint64(parts)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                edges = np.searchsorted(to[order], np.arange(parts + 1))
                used = np.flatnonzero(np.diff(edges))
                rows = [order[edges[i]: edges[i + 1]] for i in used]
                packed = [[x[r].tobytes() for r in rows] for x in (cells, y, fold)]
                yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([len(r) for r in rows], pa.int32()), *(pa.array(x, pa.binary()) for x in packed)], names=["part", "n", "cells", *columns])

        def together(pieces: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cells, y, fold = _joined(layout.kind, layout.cells, pa.Table.from_batches(pieces), columns, kinds)
            order, first = T.grouped(cells, fold)
            y, ends = y[order], np.append(first, len(order))
            s, w = np.add.reduceat(T.whole(y - middle, scale), first), np.diff(ends)
            for a in range(0, len(first), BLOCK_GROUPS):
                b = min(a + BLOCK_GROUPS, len(first))
                own = order[first[a:b]]
                packed = (cells[own], s[a:b], fold[own], w[a:b], y[ends[a]: ends[b]])
                yield pa.RecordBatch.from_arrays([pa.array([b - a], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in packed)], names=["n", "cells", "s", "fold", "w", "y"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pieces, size = [], 0
            for batch in batches:
                if batch.num_rows:
                    pieces.append(batch)
                    size += batch.nbytes
                if size > most:
                    yield from together(pieces)
                    pieces, size = [], 0
            if pieces:
                yield from together(pieces)

        sent = self.blocks.mapInArrow(send, "part int, n int, cells binary, y binary, fold binary")
        return sent.repartitionById(parts, F.col("part")).mapInArrow(run, "n int, cells binary, s binary, fold binary, w binary, y binary")

    def boosting_bytes(self) -> dict[int, int]:
        """For each fold the bytes of its groups."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for fold in batch.column(0).to_pylist():
                    f, n = np.unique(np.frombuffer(fold, np.int32), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(f, pa.int32()), pa.array(n, pa.int64())], names=["fold", "n"])

        found = self.groups.select("fold").mapInArrow(run, "fold int, n long").groupBy("fold").agg(F.sum("n").alias("n")).collect()
        return {r["fold"]: r["n"] * self.row_bytes for r in found}

    def seen(self, spec: Spec) -> tuple[int, int]:
        """Rows that a model sees, and the sum of their whole-number labels."""
        own = [v for f, v in self.folds.items() if f != spec.held_out]
        return sum(n for n, _ in own), sum(s for _, s in own)

    def start(self, spec: Spec) -> float:
        n, total = self.seen(spec)
        return T.start_of(total, n, self.middle, self.scale)


def _column_entries(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value) of the values other than 0, by rows; a null is NaN."""
    x = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.float64) for i in range(3, batch.num_columns)], axis=1) if batch.num_columns > 3 else np.zeros((batch.num_rows, 0))
    row, f = np.nonzero(x)
    return row, f, x[row, f]


def _vector_entries(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same out of a vector column (fields type, size, indices, values; no indices if dense)."""
    vector = batch.column(3)
    kind, at, values = vector.field(0).to_numpy(zero_copy_only=False), vector.field(2), vector.field(3)
    sizes = values.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(batch.num_rows), sizes)
    place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    f, v = place, values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    f[kind[row] == 0] = at.flatten().to_numpy(zero_copy_only=False)
    keep = v != 0
    return row[keep], f[keep], v[keep]


def _ordered(x: np.ndarray) -> np.ndarray:
    """Unsigned numbers in the order of the doubles."""
    bits = (x + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def _counted(k: np.ndarray, n: np.ndarray, top: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((top, k))
    k, n, top = k[order], n[order], top[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(k)), bool), k[1:] != k[:-1])))
    return k[first], np.add.reduceat(n, first) if len(first) else n, top[np.append(first[1:], len(k)) - 1] if len(first) else top


def _hashed(cells: np.ndarray, pad: int) -> np.ndarray:
    """A number for each row of cells, whatever its padding."""
    out = np.zeros(len(cells), np.uint64)
    for column in cells.T:
        x = (out ^ column.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out = np.where(column != pad, x ^ (x >> np.uint64(29)), out)
    return out


def _blocks(batches: Iterator[pa.RecordBatch], kind: type) -> Iterator[tuple]:
    """cells, label, fold, key, predictions (models x rows, or empty) of each block; of groups, their sums
    and sizes in place of label and key."""
    for batch in batches:
        number = np.int64 if batch.schema.names[2] == "s" else np.float64
        for n, cells, y, fold, key, p in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            p = np.frombuffer(p)
            yield np.frombuffer(cells, kind).reshape(n, -1), np.frombuffer(y, number), np.frombuffer(fold, np.int32), np.frombuffer(key, np.int64), p.reshape(-1, n) if len(p) else None


def _joined(kind: type, pad: int, table: pa.Table, names: list[str], kinds: list) -> list[np.ndarray]:
    """The cells (of one width) and other columns of a unit's packed rows."""
    rows = [np.frombuffer(b, kind).reshape(n, -1) for n, b in zip(table["n"].to_pylist(), table["cells"].to_pylist(), strict=True)]
    width = max(r.shape[1] for r in rows)
    cells = np.concatenate([np.pad(r, ((0, 0), (0, width - r.shape[1])), constant_values=pad) for r in rows])
    return [cells, *(np.frombuffer(b"".join(table[c].to_pylist()), k) for c, k in zip(names, kinds, strict=True))]


def _dealt(rows: DataFrame, units: int) -> DataFrame:
    """Units dealt to tasks, one each as far as 4,096 go: a hash would put several models in one task."""
    rows = rows.withColumn("unit", F.col("unit").cast("int"))
    return (rows.repartitionById(units, F.col("unit")) if units <= 4096 else rows.repartition(4096, "unit")).groupBy("unit")


def fit_models(data: TreeRows, specs: list[Spec], seed: int = 42) -> list[list[Tree]]:
    """The trees of each model."""
    out: list[list[Tree]] = [[] for _ in specs]
    groups = data.boosting_bytes() if any(s.rate is not None for s in specs) else {}
    fits = [(data.seen(s)[0] * data.row_bytes if s.rate is None else sum(b for f, b in groups.items() if f != s.held_out)) <= UNIT_BYTES for s in specs]
    for boosted in (True, False):
        mine = [i for i, s in enumerate(specs) if (s.rate is not None) == boosted]
        small, large = [i for i in mine if fits[i]], [i for i in mine if not fits[i]]
        if small:
            _whole_models(data, specs, small, seed, out)
        if large:
            (_boost_rounds if boosted else _forest_trees)(data, specs, large, seed, out)
    return out


def _whole_models(data: TreeRows, specs: list[Spec], mine: list[int], seed: int, out: list[list[Tree]]) -> None:
    """Each model (boosting) or tree (forest) in one task."""
    layout, middle, scale = data.layout, data.middle, data.scale
    boosted = specs[mine[0]].rate is not None
    units = [(i, t) for i in mine for t in (range(1) if specs[i].rate is not None else range(specs[i].trees))]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cells, y, fold, key, _ in _blocks(batches, layout.kind):
            for u, (i, t) in enumerate(units):
                use, w = fold != specs[i].held_out, b""
                if boosted:
                    w = key[use].tobytes()
                elif specs[i].bootstrap:
                    w = T.bootstrap_weights(key, t, seed)
                    use, w = use & (w > 0), w[use & (w > 0)].tobytes()
                n = int(use.sum())
                if n:
                    yield pa.RecordBatch.from_arrays([pa.array([u]), pa.array([n], pa.int32()), *(pa.array([x], pa.binary()) for x in (cells[use].tobytes(), y[use].tobytes(), w))], names=["unit", "n", "cells", "y", "w"])

    def run(table: pa.Table) -> pa.Table:
        unit = table["unit"][0].as_py()
        spec = specs[units[unit][0]]
        cells, y, w = _joined(layout.kind, layout.cells, table, ["y", "w"], [np.int64 if boosted else np.float64, np.int64])
        if boosted:
            grown = T.boost(layout, cells, y, w, spec.limits, spec.trees, spec.rate, middle, scale)
        else:
            grown = [T.grow(layout, cells, T.whole(y - middle, scale) * (w if len(w) else 1), w if len(w) else None, spec.limits)[0].tree(layout, scale)]
        columns = [[getattr(t, c) for t in grown] for c in ("cell", "left", "right", "value", "gain", "n", "depth")]
        return pa.table([pa.array([unit] * len(grown), pa.int64()), pa.array(range(len(grown)), pa.int32()), *(pa.array(c, f.type) for c, f in zip(columns, list(_TREE)[2:], strict=True))], schema=_TREE)

    sent = (data.boosting_blocks() if boosted else data.blocks).mapInArrow(send, "unit long, n int, cells binary, y binary, w binary")
    found = _dealt(sent, len(units)).applyInArrow(run, _TREE_SQL)
    nodes, grown = 0, []
    for batch in found.toArrow().to_batches():
        for k in range(batch.num_rows):
            grown.append((batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), _tree(layout, *(batch.column(c)[k].values.to_numpy() for c in range(2, 9)))))
            nodes = _counted_nodes(nodes, grown[-1][2])
    for unit, _, tree in sorted(grown, key=lambda x: x[:2]):
        i = units[unit][0]
        out[i].append(tree if specs[i].rate is not None else _shifted(tree, middle))


def _counted_nodes(nodes: int, tree: Tree) -> int:
    if nodes + len(tree.cell) > MAX_NODES:
        raise ValueError(f"the trees have more than {MAX_NODES} nodes; set max_depth or min_samples_leaf")
    return nodes + len(tree.cell)


def _tree(layout: Layout, cell, left, right, value, gain, n, depth) -> Tree:
    inner = np.flatnonzero(cell >= 0)
    feature, bin_, threshold = np.full(len(cell), -1), np.zeros(len(cell), np.int64), np.zeros(len(cell))
    feature[inner] = layout.feature_of[cell[inner]]
    bin_[inner] = cell[inner] - layout.offsets[feature[inner]]
    threshold[inner] = [layout.edges[f][b] for f, b in zip(feature[inner].tolist(), bin_[inner].tolist(), strict=True)]
    return Tree(cell.astype(np.int64), feature, bin_, threshold, left.astype(np.int64), right.astype(np.int64), value, gain, n, depth)


def _shifted(tree: Tree, middle: float) -> Tree:
    """A forest's tree predicts labels: its sums are of labels less the middle."""
    tree.value = tree.value + middle
    return tree


# ---------------------------------------------------------------- models whose rows are too many for a task

@dataclass
class _Growing:
    """A tree being grown: of which model, its number, and the model's trees since the last checkpoint."""

    model: int
    number: int
    growth: Growth
    recent: list[Tree]


def _row_state(data: TreeRows, specs: list[Spec], jobs: list[_Growing], starts: list[float], place: dict[int, int], seed: int) -> Callable:
    """A function (cells, y, fold, key, p, job) -> (rows the model sees, residuals, weights, node)."""
    layout, middle, scale = data.layout, data.middle, data.scale
    cuts = [j.growth.cuts() for j in jobs]

    def state(cells, y, fold, key, p, k):
        job, spec = jobs[k], specs[jobs[k].model]
        use, w = fold != spec.held_out, None
        if spec.rate is None:
            if spec.bootstrap:
                w = T.bootstrap_weights(key, job.number, seed)
                use = use & (w > 0)
            g = T.whole(y - middle, scale) * (1 if w is None else w)
        else:
            at = p[place[job.model]] if p is not None else np.full(len(y), starts[job.model])
            for tree in job.recent:
                at = at + spec.rate * tree.value[T.route(layout, cells, tree.cell, tree.left, tree.right)]
            w, g = key, T.residuals(y, key, at, middle, scale)
        cut, left = cuts[k]
        return use, g, w, T.route(layout, cells, cut, left, left + 1)

    return state


def _grow_together(data: TreeRows, blocks: DataFrame, specs: list[Spec], jobs: list[_Growing], starts: list[float], place: dict[int, int], seed: int) -> int:
    """Grow all trees in lockstep; returns the number of Spark jobs."""
    layout, count = data.layout, 0
    rows_of_unit = max(1, UNIT_BYTES // data.row_bytes)
    step = max(1, T.TASK_CELLS // (layout.cells + 1))
    while True:
        large, small = [], []
        for k, job in enumerate(jobs):
            for node in job.growth.wanted():
                (small if job.growth.n[node] <= rows_of_unit else large).append((k, node))
        if not large and not small:
            return count
        for i in range(0, len(large), step):
            _score_large(data, blocks, specs, jobs, starts, place, seed, large[i: i + step])
            count += 1
        if small:
            _grow_small(data, blocks, specs, jobs, starts, place, seed, small)
            count += 1


def _by_job(targets: list[tuple[int, int]], jobs: list[_Growing]) -> dict[int, np.ndarray]:
    """For each job the slot of each of its nodes (-1: none)."""
    out = {}
    for slot, (k, node) in enumerate(targets):
        out.setdefault(k, np.full(len(jobs[k].growth.cell), -1))[node] = slot
    return out


def _score_large(data, blocks, specs, jobs, starts, place, seed, targets) -> None:
    layout, slots, size = data.layout, len(targets), data.layout.cells + 1
    state, slot_of, kind = _row_state(data, specs, jobs, starts, place, seed), _by_job(targets, jobs), data.layout.kind

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((slots, size), np.int64), np.zeros((slots, size), np.int64)
        for block in _blocks(batches, kind):
            for k, own in slot_of.items():
                use, g, w, at = state(*block, k)
                slot = np.where(use, own[at], -1)
                s, c, total = T.histograms(layout, block[0], slot, g, w, slots)
                sums[:, :-1] += s
                counts[:, :-1] += c
                sums[:, -1] += total[:, 0]
                counts[:, -1] += total[:, 1]
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums.ravel()[at]), pa.array(counts.ravel()[at])], names=["cell", "g", "n"])

    merged = blocks.mapInArrow(run, "cell long, g long, n long").groupBy("cell").agg(F.sum("g").alias("g"), F.sum("n").alias("n")).toPandas()
    sums, counts = np.zeros(slots * size, np.int64), np.zeros(slots * size, np.int64)
    sums[merged["cell"]], counts[merged["cell"]] = merged["g"], merged["n"]
    sums, counts = sums.reshape(slots, size), counts.reshape(slots, size)
    total = np.stack([sums[:, -1], counts[:, -1]], axis=1)
    sums, counts = sums[:, :-1].copy(), counts[:, :-1].copy()
    T.complete(layout, sums, counts, total)
    found = T.best_splits(layout, sums, counts, total, np.array([max(1, jobs[k].growth.limits.min_child) for k, _ in targets]))
    for (k, node), (g, n), *split in zip(targets, total.tolist(), *(x.tolist() for x in found), strict=True):
        growth = jobs[k].growth
        if node == 0:
            growth.n[0], growth.g[0] = n, g
        growth.score(node, *split)


def _grow_small(data, blocks, specs, jobs, starts, place, seed, targets) -> None:
    layout, kind = data.layout, data.layout.kind
    state, slot_of = _row_state(data, specs, jobs, starts, place, seed), _by_job(targets, jobs)
    limits = []
    for k, node in targets:
        own, depth = jobs[k].growth.limits, jobs[k].growth.depth[node]
        limits.append(Limits(own.num_leaves, None if own.max_depth is None else own.max_depth - depth, own.min_child))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, kind):
            for k, own in slot_of.items():
                use, g, w, at = state(*block, k)
                slot = np.where(use, own[at], -1)
                rows = np.argsort(slot, kind="stable")
                rows = rows[np.searchsorted(slot[rows], 0):]
                edges = np.flatnonzero(np.concatenate(([True], slot[rows][1:] != slot[rows][:-1], [True]))) if len(rows) else []
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    part = rows[a:b]
                    packed = (block[0][part].tobytes(), g[part].tobytes(), b"" if w is None else w[part].tobytes())
                    yield pa.RecordBatch.from_arrays([pa.array([int(slot[part[0]])]), pa.array([b - a], pa.int32()), *(pa.array([x], pa.binary()) for x in packed)], names=["unit", "n", "cells", "g", "w"])

    def run(table: pa.Table) -> pa.Table:
        unit = table["unit"][0].as_py()
        cells, g, w = _joined(kind, layout.cells, table, ["g", "w"], [np.int64, np.int64])
        grown = T.grow(layout, cells, g, w if len(w) else None, limits[unit])[0]
        return pa.table([pa.array([unit]), *(pa.array([getattr(grown, c)], f.type) for c, f in zip(("cell", "left", "gain", "n", "g"), list(_SUB)[1:], strict=True))], schema=_SUB)

    sent = blocks.mapInArrow(send, "unit long, n int, cells binary, g binary, w binary")
    found = _dealt(sent, len(targets)).applyInArrow(run, _SUB_SQL).toArrow().to_batches()
    for batch in found:
        for r in range(batch.num_rows):
            k, node = targets[batch.column(0)[r].as_py()]
            jobs[k].growth.attach(node, {c: batch.column(i)[r].values.to_numpy() for i, c in enumerate(("cell", "left", "gain", "n", "g"), 1)})


def _boost_rounds(data: TreeRows, specs: list[Spec], mine: list[int], seed: int, out: list[list[Tree]]) -> None:
    starts = [data.start(s) for s in specs]
    place, recent, blocks, written = {i: k for k, i in enumerate(mine)}, {i: [] for i in mine}, data.boosting_blocks(), None
    try:
        for number in range(max(specs[i].trees for i in mine)):
            going = [i for i in mine if number < specs[i].trees and (not out[i] or len(out[i][-1].cell) > 1)]
            if not going:
                break
            if number and number % CHECKPOINT == 0:
                blocks, written = _with_predictions(data, blocks, written, specs, mine, recent, starts)
                recent = {i: [] for i in mine}
            jobs = [_Growing(i, number, Growth(specs[i].limits, data.seen(specs[i])[0], 0), recent[i]) for i in going]
            _grow_together(data, blocks, specs, jobs, starts, place, seed)
            for job in jobs:
                tree = job.growth.tree(data.layout, data.scale)
                out[job.model].append(tree)
                recent[job.model].append(tree)
    finally:
        if written:
            blocks.unpersist()
            delete_dir(blocks.sparkSession, written)


def _with_predictions(data: TreeRows, blocks: DataFrame, before: str | None, specs: list[Spec], mine: list[int], recent: dict[int, list[Tree]], starts: list[float]) -> tuple[DataFrame, str]:
    """The blocks with all models' predictions, in a folder of their own."""
    layout, spark = data.layout, blocks.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = []
            for cells, y, _fold, _key, p in _blocks(iter([batch]), layout.kind):
                rows = []
                for k, i in enumerate(mine):
                    at = p[k] if p is not None else np.full(len(y), starts[i])
                    for tree in recent[i]:
                        at = at + specs[i].rate * tree.value[T.route(layout, cells, tree.cell, tree.left, tree.right)]
                    rows.append(at)
                new.append(np.stack(rows).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(new, pa.binary())], names=batch.schema.names)

    path = fresh_dir(spark, "predictions")
    blocks.mapInArrow(run, _GROUPS).write.parquet(path)
    if before:
        blocks.unpersist()
        delete_dir(spark, before)
    return spark.read.schema(blocks.schema).parquet(path).persist(StorageLevel.MEMORY_AND_DISK), path


def _forest_trees(data: TreeRows, specs: list[Spec], mine: list[int], seed: int, out: list[list[Tree]]) -> None:
    """All trees of the forests in lockstep."""
    jobs = [_Growing(i, t, Growth(specs[i].limits, data.seen(specs[i])[0], 0), []) for i in mine for t in range(specs[i].trees)]
    for job in jobs:       # how many rows a bootstrap draws is told by its root's histogram
        job.growth.n[0] = max(job.growth.n[0], UNIT_BYTES // data.row_bytes + 1)
    _grow_together(data, data.blocks, specs, jobs, [0.0] * len(specs), {}, seed)
    nodes = 0
    for job in jobs:
        tree = job.growth.tree(data.layout, data.scale)
        nodes = _counted_nodes(nodes, tree)
        out[job.model].append(_shifted(tree, data.middle))


# ---------------------------------------------------------------- scores on held-out rows

def held_out_errors(data: TreeRows, specs: list[Spec], grown: list[list[Tree]], stages: list[list[int]]) -> dict[tuple[int, int], float]:
    """(model, trees used) -> mean absolute error on the rows of the fold that the model didn't see.
    Errors are added as whole numbers, so means do not depend on partitions. Boosted models predict once
    for a group."""
    layout, scale = data.layout, data.scale
    starts = [data.start(s) for s in specs]

    def errors(mine: list[int], cells: np.ndarray, fold: np.ndarray, w: np.ndarray | None, y: np.ndarray) -> pa.RecordBatch:
        rows = []
        for i in mine:
            spec, own = specs[i], fold == specs[i].held_out
            if not own.any():
                continue
            values, label = T.leaf_values(layout, cells[own], grown[i]), y[own if w is None else np.repeat(own, w)]
            for stage in stages[i]:
                used = values[:, :stage]
                p = used.mean(axis=1) if spec.rate is None else starts[i] + spec.rate * used.sum(axis=1)
                p = p if w is None else np.repeat(p, w[own])
                rows.append((i, stage, int(T.whole(np.abs(label - p), scale).sum()), len(label)))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 4)], names=["model", "stage", "error", "n"])

    out = {}
    for boosted in (True, False):
        mine = [i for i, s in enumerate(specs) if (s.rate is not None) == boosted]
        if not mine:
            continue

        def run(batches: Iterator[pa.RecordBatch], mine=mine, boosted=boosted) -> Iterator[pa.RecordBatch]:
            if not boosted:
                for cells, y, fold, _key, _p in _blocks(batches, layout.kind):
                    yield errors(mine, cells, fold, None, y)
                return
            for batch in batches:
                for n, cells, fold, w, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    yield errors(mine, np.frombuffer(cells, layout.kind).reshape(n, -1), np.frombuffer(fold, np.int32), np.frombuffer(w, np.int64), np.frombuffer(y))

        rows = data.groups.select("n", "cells", "fold", "w", "y") if boosted else data.blocks
        found = rows.mapInArrow(run, "model long, stage long, error long, n long").groupBy("model", "stage").agg(F.sum("error").alias("error"), F.sum("n").alias("n")).collect()
        out |= {(r["model"], r["stage"]): r["error"] / scale / r["n"] for r in found}
    return out
