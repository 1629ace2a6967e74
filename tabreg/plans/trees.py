"""Regression trees by histograms: one growth rule, run in tasks on small row sets and as Spark jobs on large ones.

Published bases: Ke et al. (NeurIPS 2017) for best-first histogram trees and exclusive features, Panda et al.
(VLDB 2009) for handing small nodes to single tasks.

* **Cells.** Every (feature, bin) is a cell. A row is the list of its cells, without those of the value
  0: dummies cost one entry for each text column, not one for each category. What a node's histogram
  lacks in a feature's cells is in the bin of 0.
* **Whole numbers.** Labels and predictions are scaled to integers once for a fit, so a histogram is the same
  whatever order its parts arrive in, and trees do not depend on partitions or on where they were grown.
* **Groups.** Rows of equal cells come to the same leaf of every tree, so boosting needs their number and the sum
  of their whole-number labels only; a group's residual is exactly the sum of its rows' ones.
* **Growth.** ``Growth`` holds the nodes known so far and replays best-first growth over them; it names
  the nodes whose histograms it needs next, for several leaves at once.

A split needs ``min_child`` rows on each side and a positive gain ``G_l^2/n_l + G_r^2/n_r - G^2/n``. Ties go
to the lowest feature, then the lowest bin, then the node made first.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np

#: Cells of histograms (two int64 arrays) that a task, or the driver, holds at a time.
TASK_CELLS = 4_000_000
#: Residuals have at most this many bits; the sum over all rows must fit 62.
BITS = 40


def scale_of(low: float, high: float, n: int) -> float:
    """The power of two by which residuals of labels between ``low`` and ``high`` become integers."""
    bits = min(BITS, 62 - int(n).bit_length())
    width = high / 2 - low / 2
    return 2.0 ** min(1000, bits - 3 - int(np.ceil(np.log2(width)))) if width > 0 else 1.0


def whole(x: np.ndarray, scale: float) -> np.ndarray:
    return np.rint(x * scale).astype(np.int64)


def residuals(s: np.ndarray, w: np.ndarray, p: np.ndarray, middle: float, scale: float) -> np.ndarray:
    """Whole-number residuals of groups of ``w`` rows with one prediction ``p`` and labels that sum to ``s``."""
    return s - w * whole(p - middle, scale)


@dataclass
class Layout:
    """Edges of each feature's bins: ``x`` is in the first bin whose edge is not below it, a gap in the
    last one."""

    edges: list[np.ndarray]

    def __post_init__(self):
        sizes = np.array([len(e) + 1 for e in self.edges], np.int64)
        self.offsets = np.concatenate(([0], np.cumsum(sizes)))
        self.cells = int(self.offsets[-1])
        self.default = np.array([np.searchsorted(e, 0.0) for e in self.edges], np.int64)
        self.feature_of = np.repeat(np.arange(len(self.edges)), sizes)
        self.last = np.zeros(self.cells, bool)
        self.last[self.offsets[1:] - 1] = True
        self.kind = np.uint16 if self.cells < 65_535 else np.int32

    def split_of(self, cell: int) -> tuple[int, int, float]:
        f = int(self.feature_of[cell])
        b = int(cell - self.offsets[f])
        return f, b, float(self.edges[f][b])


def pack_rows(layout: Layout, rows: np.ndarray, features: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """The cells of ``n`` rows from their (row, feature, value) entries, rows in order: a matrix,
    padded with the number of cells."""
    bins = np.empty(len(values), np.int64)
    order = np.argsort(features, kind="stable")
    edges = np.searchsorted(features[order], np.arange(len(layout.edges) + 1))
    for f in np.flatnonzero(np.diff(edges)):
        at = order[edges[f]: edges[f + 1]]
        bins[at] = np.searchsorted(layout.edges[f], values[at], side="left")
    cells = layout.offsets[features] + bins
    keep = bins != layout.default[features]
    rows, cells = rows[keep], cells[keep]
    counts = np.bincount(rows, minlength=n)
    place = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
    out = np.full((n, max(1, int(counts.max(initial=0)))), layout.cells, layout.kind)
    out[rows, place] = cells
    return out


def _sums(at: np.ndarray, g: np.ndarray, size: int) -> np.ndarray:
    """Integer sums by place: high and low parts are exact in the doubles of ``bincount``."""
    high = g >> 20
    return (np.bincount(at, high, size).astype(np.int64) << 20) + np.bincount(at, g - (high << 20), size).astype(np.int64)


def histograms(layout: Layout, cells: np.ndarray, slot: np.ndarray, g: np.ndarray, w: np.ndarray | None, slots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of ``g`` and of weights (exact in doubles, as rows are fewer than 2^53) in (slot, cell) without the bins of 0, and (slot, 2) totals. Rows
    without a slot have -1."""
    use = slot >= 0
    if not use.all():
        cells, slot, g, w = cells[use], slot[use], g[use], None if w is None else w[use]
    width, stride = cells.shape[1], layout.cells + 1
    at = (slot[:, None] * stride + cells).ravel()
    total = np.stack([_sums(slot, g, slots), np.bincount(slot, w, slots).astype(np.int64) if w is not None else np.bincount(slot, minlength=slots)], axis=1)
    sums = _sums(at, np.repeat(g, width), slots * stride).reshape(slots, stride)[:, :-1]
    counts = (np.bincount(at, np.repeat(w, width), slots * stride).astype(np.int64) if w is not None else np.bincount(at, minlength=slots * stride)).reshape(slots, stride)[:, :-1]
    return sums, counts, total


def complete(layout: Layout, sums: np.ndarray, counts: np.ndarray, total: np.ndarray) -> None:
    """What the totals have beyond the other bins is in the bins of 0."""
    at, first = layout.offsets[:-1] + layout.default, layout.offsets[:-1]
    for part, whole_ in ((sums, total[:, 0]), (counts, total[:, 1])):
        part[:, at] += whole_[:, None] - np.add.reduceat(part, first, axis=1)


def best_splits(layout: Layout, sums: np.ndarray, counts: np.ndarray, total: np.ndarray, min_child: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each slot the cell of the best split, its gain (minus infinity: none), and rows and sum on the left."""
    first = layout.offsets[:-1][layout.feature_of]
    gl, nl = np.cumsum(sums, axis=1), np.cumsum(counts, axis=1)
    gl, nl = gl - (gl - sums)[:, first], nl - (nl - counts)[:, first]
    g, n = total[:, :1], total[:, 1:]
    nr = n - nl
    fits = (nl >= min_child[:, None]) & (nr >= min_child[:, None]) & (nl > 0) & (nr > 0) & ~layout.last
    a, b, whole_ = gl.astype(np.float64), (g - gl).astype(np.float64), g.astype(np.float64)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(fits, a * a / nl + b * b / nr - whole_ * whole_ / n, -np.inf)
    cell = np.argmax(gain, axis=1)
    rows = np.arange(len(cell))
    return cell, gain[rows, cell], nl[rows, cell], gl[rows, cell]


def goes_left(layout: Layout, cells: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Whether each row's bin, in the feature of the cell ``cut``, is that cell's or a lower one."""
    f = layout.feature_of[cut]
    cells = cells.astype(np.int64)
    within = (cells >= layout.offsets[f][:, None]) & (cells < layout.offsets[f + 1][:, None])
    low = (within & (cells <= cut[:, None])).any(axis=1)
    return low | (~within.any(axis=1) & (layout.default[f] <= cut - layout.offsets[f]))


@dataclass(frozen=True)
class Limits:
    num_leaves: int | None = None     # None: no limit
    max_depth: int | None = None
    min_child: int = 1


class Growth:
    """The nodes of a tree that are known: an unscored node has ``cell`` -1, one that cannot be split -2."""

    def __init__(self, limits: Limits, n: int, g: int):
        self.limits = limits
        self.cell, self.gain, self.n, self.g, self.depth, self.left, self.fresh = [], [], [], [], [], [], []
        self._add(n, g, 0)

    def _close(self, i: int) -> None:
        deep = self.limits.max_depth is not None and self.depth[i] >= self.limits.max_depth
        if deep or self.n[i] < 2 * max(1, self.limits.min_child):
            self.cell[i] = -2

    def _add(self, n: int, g: int, depth: int) -> None:
        for column, value in ((self.cell, -1), (self.gain, -np.inf), (self.n, n), (self.g, g), (self.depth, depth), (self.left, -1)):
            column.append(value)
        self._close(len(self.cell) - 1)
        if self.cell[-1] == -1:
            self.fresh.append(len(self.cell) - 1)

    def score(self, i: int, cell: int, gain: float, n_left: int, g_left: int) -> None:
        if not gain > 0:
            self.cell[i] = -2
            return
        self.cell[i], self.gain[i], self.left[i] = cell, gain, len(self.cell)
        self._add(n_left, g_left, self.depth[i] + 1)
        self._add(self.n[i] - n_left, self.g[i] - g_left, self.depth[i] + 1)

    def replay(self) -> tuple[list[int], list[int], dict[int, tuple[int, int]]]:
        """Best-first growth as far as it is known: nodes in the order they are made, those to be scored
        next, and the children (places in the order) of the nodes that were split."""
        order, split, most = [0], {}, self.limits.num_leaves
        if self.cell[0] == -1:
            return order, [0], split
        heap = [(-self.gain[0], 0, 0)] if self.cell[0] >= 0 else []
        leaves, unknown = 1, []
        while heap and (most is None or leaves < most):
            if unknown and most is not None:
                break          # the best leaf may be one that is not scored yet
            _, place, i = heapq.heappop(heap)
            split[place] = (len(order), len(order) + 1)
            for child in (self.left[i], self.left[i] + 1):
                if self.cell[child] >= 0:
                    heapq.heappush(heap, (-self.gain[child], len(order), child))
                elif self.cell[child] == -1:
                    unknown.append(child)
                order.append(child)
            leaves += 1
        if most is None or not unknown:
            return order, unknown, split
        ahead = [i for _, _, i in heapq.nsmallest(most - leaves, heap)]
        wanted = unknown + [c for i in ahead for c in (self.left[i], self.left[i] + 1) if self.cell[c] == -1]
        return order, wanted if leaves < most else [], split

    def wanted(self) -> list[int]:
        """The nodes to be scored next; without a limit of leaves those are all that are not."""
        if self.limits.num_leaves is not None:
            return self.replay()[1]
        self.fresh = [i for i in self.fresh if self.cell[i] == -1]
        return list(self.fresh)

    def owners(self) -> np.ndarray:
        """The place in the tree of each known node: its own, or that of the leaf it would be below."""
        order, _, _ = self.replay()
        owner = np.full(len(self.cell), -1)
        owner[order] = np.arange(len(order))
        for i, left in enumerate(self.left):      # children come after their parents
            if left >= 0 and owner[left] < 0:
                owner[left] = owner[left + 1] = owner[i]
        return owner

    def cuts(self) -> tuple[np.ndarray, np.ndarray]:
        """For routing: the cell at which each node is split (-1: not), and its left child."""
        cell = np.array(self.cell)
        return np.where(cell >= 0, cell, -1), np.array(self.left)

    def attach(self, i: int, sub: dict[str, np.ndarray]) -> None:
        """Nodes below ``i`` that a task grew, by its own numbers (0 is ``i``)."""
        todo = [(i, 0)]
        while todo:
            mine, theirs = todo.pop()
            cell, left = int(sub["cell"][theirs]), int(sub["left"][theirs])
            if cell == -1:
                continue
            if cell == -2:
                self.cell[mine] = -2
                continue
            self.score(mine, cell, float(sub["gain"][theirs]), int(sub["n"][left]), int(sub["g"][left]))
            todo += [(self.left[mine] + 1, left + 1), (self.left[mine], left)]

    def tree(self, layout: Layout, scale: float) -> Tree:
        order, _, split = self.replay()
        cell = np.array([self.cell[i] if p in split else -1 for p, i in enumerate(order)])
        left = np.array([split.get(p, (p, p))[0] for p in range(len(order))])
        right = np.array([split.get(p, (p, p))[1] for p in range(len(order))])
        n, g = np.array([self.n[i] for i in order]), np.array([self.g[i] for i in order])
        gain = np.array([self.gain[i] if p in split else 0.0 for p, i in enumerate(order)]) / scale / scale
        value = np.divide(g / scale, n, out=np.zeros(len(n)), where=n > 0)
        inner = np.flatnonzero(cell >= 0)
        feature, bin_, threshold = np.full(len(cell), -1), np.zeros(len(cell), np.int64), np.zeros(len(cell))
        feature[inner] = layout.feature_of[cell[inner]]
        bin_[inner] = cell[inner] - layout.offsets[feature[inner]]
        threshold[inner] = [layout.edges[f][b] for f, b in zip(feature[inner].tolist(), bin_[inner].tolist(), strict=True)]
        return Tree(cell, feature, bin_, threshold, left, right, value, gain, n, np.array([self.depth[i] for i in order]))


@dataclass
class Tree:
    """A grown tree as arrays over its nodes; a leaf has feature -1 and is its own child."""

    cell: np.ndarray
    feature: np.ndarray
    bin: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    gain: np.ndarray
    n: np.ndarray
    depth: np.ndarray

    @property
    def splits(self) -> dict:
        """node -> (feature, bin, threshold, left, right)"""
        rows = zip(self.feature.tolist(), self.bin.tolist(), self.threshold.tolist(), self.left.tolist(), self.right.tolist(), strict=True)
        return {i: r for i, r in enumerate(rows) if r[0] >= 0}

    @property
    def leaves(self) -> dict:
        return {i: v for i, (f, v) in enumerate(zip(self.feature.tolist(), self.value.tolist(), strict=True)) if f < 0}

    @property
    def gains(self) -> dict:
        return {i: float(self.gain[i]) for i in np.flatnonzero(self.feature >= 0)}

    @property
    def counts(self) -> dict:
        return dict(enumerate(self.n.tolist()))


def route(layout: Layout, cells: np.ndarray, cut: np.ndarray, left: np.ndarray, right: np.ndarray, row: np.ndarray | None = None, at: np.ndarray | None = None) -> np.ndarray:
    """The node that each row comes to, or each of ``row`` that starts at the node ``at``."""
    row = np.arange(len(cells)) if row is None else row
    at = np.zeros(len(row), np.int64) if at is None else at
    moving = np.flatnonzero(cut[at] >= 0)
    while len(moving):
        node = at[moving]
        to_left = goes_left(layout, cells[row[moving]], cut[node])
        at[moving] = np.where(to_left, left[node], right[node])
        moving = moving[cut[at[moving]] >= 0]
    return at


def stacked(trees: list[Tree], *names: str) -> tuple[np.ndarray, ...]:
    """The trees' roots, and arrays of theirs one after the other; children are places in these."""
    roots = np.concatenate(([0], np.cumsum([len(t.cell) for t in trees])[:-1])).astype(np.int64)
    return roots, *(np.concatenate([getattr(t, n) + (r if n in ("left", "right") else 0) for t, r in zip(trees, roots, strict=True)]) for n in names)


def leaf_values(layout: Layout, cells: np.ndarray, trees: list[Tree]) -> np.ndarray:
    """The value of each row's leaf in each tree."""
    roots, cut, left, right, value = stacked(trees, "cell", "left", "right", "value")
    used = np.unique(layout.feature_of[cut[cut >= 0]])
    place = np.zeros(len(layout.edges) + 1, np.int64)
    place[used] = np.arange(len(used))
    column = np.where(cut >= 0, place[layout.feature_of[np.maximum(cut, 0)]], 0)
    out, step = np.empty((len(cells), len(trees))), max(1, TASK_CELLS // 4 // max(len(trees), len(used)))
    for i in range(0, len(cells), step):
        part = _dense(layout, cells[i: i + step], used)
        row, at = np.repeat(np.arange(len(part)) * part.shape[1], len(trees)), np.tile(roots, len(part))
        part, moving = part.ravel(), np.flatnonzero(cut[at] >= 0)
        while len(moving):
            node = at[moving]
            at[moving] = np.where(part[row[moving] + column[node]] <= cut[node], left[node], right[node])
            moving = moving[cut[at[moving]] >= 0]
        out[i: i + step] = value[at].reshape(-1, len(trees))
    return out


def _dense(layout: Layout, cells: np.ndarray, used: np.ndarray) -> np.ndarray:
    """The cell of each row in each used feature."""
    out = np.tile((layout.offsets[:-1] + layout.default)[used], (len(cells), 1))
    place = np.full(len(layout.edges), -1)
    place[used] = np.arange(len(used))
    of_cell = np.append(place[layout.feature_of], -1)     # the last: padding
    for column in cells.T:
        to = of_cell[column]
        rows = np.flatnonzero(to >= 0)
        out[rows, to[rows]] = column[rows]
    return out


def grouped(cells: np.ndarray, fold: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows in an order that puts those of equal cells and fold together, and where each group begins in it."""
    parts = [np.ascontiguousarray(cells).view(np.uint8).reshape(len(cells), -1)]
    if fold is not None:
        parts.append(np.ascontiguousarray(fold).view(np.uint8).reshape(len(cells), -1))
    size = sum(x.shape[1] for x in parts)
    words = np.concatenate([*parts, np.zeros((len(cells), -size % 8), np.uint8)], axis=1).view(np.uint64)
    order = np.lexsort(words.T)
    words = words[order]
    return order, np.flatnonzero(np.concatenate((np.ones(min(1, len(cells)), bool), (words[1:] != words[:-1]).any(axis=1))))


def boost(layout: Layout, cells: np.ndarray, s: np.ndarray, w: np.ndarray, limits: Limits, trees: int, rate: float, middle: float, scale: float) -> list[Tree]:
    """All rounds of boosting over groups of rows in memory; growth ends with a tree that can't be split."""
    order, first = grouped(cells)       # the same cells in several folds
    cells, s, w = cells[order[first]], np.add.reduceat(s[order], first), np.add.reduceat(w[order], first)
    p, out = np.full(len(s), start_of(int(s.sum()), int(w.sum()), middle, scale)), []
    while len(out) < trees:
        growth, at = grow(layout, cells, residuals(s, w, p, middle, scale), w, limits)
        tree = growth.tree(layout, scale)
        out.append(tree)
        if len(tree.cell) == 1:
            break
        p = p + rate * tree.value[growth.owners()[at]]
    return out


def start_of(total: int, n: int, middle: float, scale: float) -> float:
    """The mean label, from the sum of whole-number labels."""
    return middle + (total / n / scale if n else 0.0)


def grow(layout: Layout, cells: np.ndarray, g: np.ndarray, w: np.ndarray | None, limits: Limits) -> tuple[Growth, np.ndarray]:
    """Grow a tree over rows in memory; with it the known node that each row stands in. Histograms
    are made for all wanted nodes together, ``TASK_CELLS`` cells at a time."""
    growth = Growth(limits, int(w.sum()) if w is not None else len(g), int(g.sum()))
    at = np.zeros(len(g), np.int64)
    step = max(1, TASK_CELLS // (layout.cells + 1))
    min_child = max(1, limits.min_child)
    while wanted := growth.wanted():
        slot_of = np.full(len(growth.cell), -1)
        done = len(growth.cell)
        for i in range(0, len(wanted), step):
            part = np.array(wanted[i: i + step])
            slot_of[:] = -1
            slot_of[part] = np.arange(len(part))
            slot = np.where(at < done, slot_of[np.minimum(at, done - 1)], -1)
            sums, counts, total = histograms(layout, cells, slot, g, w, len(part))
            complete(layout, sums, counts, total)
            found = best_splits(layout, sums, counts, total, np.full(len(part), min_child))
            for node, *split in zip(part.tolist(), *(x.tolist() for x in found), strict=True):
                growth.score(node, *split)
            cut, left = growth.cuts()
            mine = np.flatnonzero((slot >= 0) & (cut[at] >= 0))
            at[mine] = np.where(goes_left(layout, cells[mine], cut[at[mine]]), left[at[mine]], left[at[mine]] + 1)
    return growth, at


#: Chance that a Poisson(1) draw is 0, at most 1, and so on.
_POISSON = np.cumsum(np.exp(-1.0) / np.concatenate(([1.0], np.cumprod(np.arange(1.0, 20.0)))))


def bootstrap_weights(keys: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row is drawn for a tree: Poisson(1) from a hash of the row's key and the tree's number."""
    with np.errstate(over="ignore"):
        x = keys.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64((seed * 1_000_003 + tree + 1) & 0xFFFFFFFFFFFFFFFF)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x = x ^ (x >> np.uint64(31))
    return np.searchsorted(_POISSON, (x >> np.uint64(11)) * 2.0**-53, side="right").astype(np.int64)
