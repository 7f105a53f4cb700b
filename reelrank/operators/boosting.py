"""Histogram gradient boosting of regression trees (I3), its scores (I4) and
its explanations (I5).

Features are binned once into bytes.  One tree a round is grown level by level
for *every* model key (a person, or one key for all) at once: histograms of
residuals are keyed by (key, node, bin), the larger child's histogram is its
parent's less its sibling's, and a split's gain is regularised by ``l2``:

    gain = GL^2 / (nL + l2) + GR^2 / (nR + l2) - G^2 / (n + l2)

Keys of at most ``rows_a_task`` rows are grown whole inside a task, some
thousand rows at a time.  The rows of a larger key lie over many tasks.  If all
of these can run at once, they are one barrier stage: each task keeps its rows
for all rounds, and the tasks sum the histograms of the smaller children through
files of the shared folder (:class:`Together`; ``allGather`` waits a second each
time, five a tree) and pick the same splits.  Otherwise, or where the folder is
no local path or answers slowly, the rows are cached in blocks, a job a level
sums those histograms (bins x nodes of each task, whatever the rows) and the
driver picks the splits.

Trees are rows (key, tree, node, feature, threshold, left, right, value), the
root being node 0.  A node's value is the shrunk mean of its residuals, so the
change of value along a row's path credits the features that split there, and
the credits of a path depend on its leaf alone (:func:`leaf_credits`).
"""

from __future__ import annotations

import math
import os
import time
import uuid
from collections.abc import Callable, Iterator
from functools import partial
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import RDD, BarrierTaskContext, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, ship_package

BOOST = {"rounds": 500, "rate": 0.03, "depth": 5, "least": 12, "l2": 0.5}
NODES = ("key string, tree int, node int, feature int, threshold double, left int, right int, value double, n long")
ROWS_A_TASK = 50_000
CHUNK = 1 << 15           # rows that a histogram pass unpacks at a time
BLOCK = 1 << 16           # rows of a cached block of a key over many tasks
MOST_A_TASK = 1_000_000   # rows of such keys
JOINT = 1024              # values of a code that joins several features' bins
REFRESH = 5               # trees that a task walks before the cached predictions take them up
KEYS_AT_ONCE = 8
WAIT = 0.25             # seconds a sum over tasks may take at most, else a job a level is no slower
LOST = 900              # seconds after which a task that says nothing is taken for lost
BASE_TREE = -1          # the row of this tree number holds a key's base value


# ------------------------------------------------------------------ bins

def bin_edges(rows: DataFrame, features: str = "x", bins: int = 64, accuracy: int = 2000) -> list[list[float]]:
    """Ascending inner edges of every slot of the ``features`` arrays: at most
    ``bins`` - 1 of its quantiles, each once.  A value belongs to the first bin
    whose edge is not below it.  The result is slots x bins doubles at most.

    Tasks count a slot's values (:class:`Ranks`); of more than twice
    ``accuracy`` different ones they say as many, so that a rank is off by one
    in ``accuracy`` at most."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Ranks] = []
        for b in batches:
            for i in range(0, b.num_rows, CHUNK // 2):
                _count_slots(held, b.column("x").slice(i, CHUNK // 2), accuracy)
        for f, ranks in enumerate(held):
            values, n = ranks.end()
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), f, np.int32)), pa.array(values), pa.array(n)],
                                             ["slot", "value", "n"])

    def edges_of(some: pa.Table) -> pa.Table:
        values, n = _counted(some["value"].to_numpy(), some["n"].to_numpy())
        below = np.cumsum(n)
        at = np.searchsorted(below, np.ceil(below[-1] * np.arange(1, bins) / bins))
        edges = sorted({float(values[0]), *values[at].tolist()})
        edges = [e for e in edges if e < values[-1]][:bins - 1]
        return pa.table({"slot": some["slot"][:1], "edges": pa.array([edges], pa.list_(pa.float64()))})
    ship_package(rows.sparkSession)
    found = (rows.select(F.col(features).alias("x")).where(F.col("x").isNotNull()).mapInArrow(count, "slot int, value double, n long")
             .groupBy("slot").applyInArrow(edges_of, "slot int, edges array<double>").collect())
    out = {r.slot: list(r.edges) for r in found}
    return [out.get(i, []) for i in range(max(out, default=-1) + 1)]


class Ranks:
    """Values and how often each came, or as many of them as tell a rank.  Sets
    of some size are thinned, four thinned sets are made one and thinned, and so
    on, so that what a rank is off by grows with their logarithm alone."""

    def __init__(self, accuracy: int):
        self.accuracy, self.levels, self.size = accuracy, [[]], 0

    def add(self, values: np.ndarray) -> None:
        self.levels[0].append(_counted(values))
        self.size += len(self.levels[0][-1][0])
        if self.size > 64 * self.accuracy:
            self.levels[0] = [_merged(self.levels[0])]
            self.size = len(self.levels[0][0][0])
            at = 0
            while self.size > 32 * self.accuracy and (not at or len(self.levels[at]) == 4):
                if at + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[at + 1].append(_thinned(*_merged(self.levels[at]), 8 * self.accuracy))
                self.levels[at] = []
                at += 1
            self.size = sum(len(v) for v, _ in self.levels[0])

    def end(self) -> tuple[np.ndarray, np.ndarray]:
        some = [x for level in self.levels for x in level]
        return _thinned(*_merged(some), 2 * self.accuracy) if some else (np.empty(0), np.empty(0, np.int64))


def _count_slots(held: list[Ranks], x: pa.ListArray, accuracy: int) -> None:
    """The values of each slot of ``x`` added to ``held``."""
    widths = pc.list_value_length(x).to_numpy(zero_copy_only=False)
    flat = x.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    width = int(widths.max(initial=0))
    held.extend(Ranks(accuracy) for _ in range(width - len(held)))
    even = (widths == width).all()
    table = np.ascontiguousarray(flat.reshape(-1, width).T) if even and width else None
    place = None if even else np.arange(len(flat)) - np.repeat(np.cumsum(widths) - widths, widths)
    for f in range(width):
        values = table[f] if even else flat[place == f]
        values = values[~np.isnan(values)]
        if len(values):
            held[f].add(values)


def _merged(some: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    return some[0] if len(some) == 1 else _counted(*(np.concatenate(c) for c in zip(*some)))


def _counted(values: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Different values, ascending, and how often each stands there."""
    if n is None:
        if values.min() == values.max():
            return values[:1] + 0.0, np.array([len(values)])
        return np.unique(values + 0.0, return_counts=True)
    order = np.argsort(values, kind="stable")
    values, n = values[order], n[order]
    first = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.empty(0, np.int64)
    return values[first], np.add.reduceat(n, first) if len(values) else n


def _thinned(values: np.ndarray, n: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``most`` of the values and the first and last, each with the
    rows after the one before it."""
    if len(values) <= most:
        return values, n
    below = np.cumsum(n)
    at = np.unique(np.append([0, len(values) - 1], np.searchsorted(below, below[-1] * np.arange(1, most) / most)))
    return values[at], np.diff(below[at], prepend=0)


def binned(x: np.ndarray, edges: list[list[float]]) -> np.ndarray:
    out = np.zeros(x.shape, np.uint8)
    for f, e in enumerate(edges):
        if e:
            out[:, f] = np.searchsorted(np.array(e), x[:, f], "left")
    return out


# ------------------------------------------------------------------ growing

class Grower:
    """Trees of some keys over their rows."""

    def __init__(self, x: np.ndarray, edges: list[list[float]], key: np.ndarray, n_keys: int, y: np.ndarray,
                 params: dict, begin: np.ndarray | None = None):
        self.p, self.key, self.n_keys, self.edges = params, key, n_keys, edges
        self.sizes = np.array([len(e) + 1 for e in edges])
        self.start = np.concatenate(([0], np.cumsum(self.sizes)))
        self.bins = int(self.start[-1])
        self.x, self.y = x, y
        # two-valued features need one sum each, which a matrix product gives
        self.two = np.flatnonzero(self.sizes == 2)
        self.many = np.flatnonzero(self.sizes > 2)
        self.flags, self.codes = x[:, self.two], x[:, self.many]
        ends = np.zeros(self.bins, bool)
        ends[self.start[1:] - 1] = True
        self.is_end = ends
        self.feature_of = np.repeat(np.arange(len(edges)), self.sizes)
        total, count = np.bincount(key, y, n_keys), np.bincount(key, minlength=n_keys)
        self.base = total / np.maximum(count, 1)
        self.f = self.base[key] if begin is None else begin.copy()

    def bins_of(self, rows: np.ndarray, feature: np.ndarray) -> np.ndarray:
        """The bin of each row in the feature given for it."""
        return self.x[rows, feature]

    def histograms(self, rows: np.ndarray, node: np.ndarray, n_nodes: int, g: np.ndarray) -> list[np.ndarray]:
        """Residual sums and counts by (node, bin) of ``rows``."""
        sums, counts = np.zeros((n_nodes, self.bins)), np.zeros((n_nodes, self.bins))
        total, size = np.bincount(node[rows], g[rows], n_nodes), np.bincount(node[rows], minlength=n_nodes)
        ones, width = self.start[self.two] + 1, len(self.many)
        for i in range(0, len(rows), CHUNK):
            some = rows[i:i + CHUNK]
            at, slopes = node[some], g[some]
            if width:
                flat = (self.codes[some] + (self.start[self.many] + (at * self.bins)[:, None])).ravel()
                sums += np.bincount(flat, np.repeat(slopes, width), n_nodes * self.bins).reshape(n_nodes, -1)
                counts += np.bincount(flat, minlength=n_nodes * self.bins).reshape(n_nodes, -1)
            order = np.argsort(at, kind="stable")
            first = np.flatnonzero(np.append(True, np.diff(at[order]) > 0))
            for a, b in zip(first, np.append(first[1:], len(order))):
                flags = self.flags[some[order[a:b]]].astype(np.float64)
                sums[at[order[a]], ones] += slopes[order[a:b]] @ flags
                counts[at[order[a]], ones] += flags.sum(0)
        sums[:, ones - 1] = total[:, None] - sums[:, ones]
        counts[:, ones - 1] = size[:, None] - counts[:, ones]
        single = self.start[:-1][self.sizes == 1]
        sums[:, single], counts[:, single] = total[:, None], size[:, None]
        return [sums, counts]

    def level_histograms(self, rows: np.ndarray, node: np.ndarray, number: np.ndarray, n_nodes: int,
                         g: np.ndarray) -> list[np.ndarray]:
        """Histograms of the level's nodes that have a ``number``."""
        some = rows[number[node[rows]] >= 0]
        renamed = np.full(len(node), -1)
        renamed[some] = number[node[some]]
        return self.histograms(some, renamed, n_nodes, g)

    def best_splits(self, sums: np.ndarray, counts: np.ndarray, g: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        """Best bin of each node to split after (-1: none), and the residual
        sum and count left of it; ties go to the first feature and bin."""
        l2, least = self.p["l2"], self.p["least"]

        def left(h):
            run = np.cumsum(h, axis=1)
            before = np.concatenate((np.zeros((len(h), 1)), run[:, self.start[1:-1] - 1]), axis=1)
            return run - np.repeat(before, self.sizes, axis=1)
        g, n = g[:, None], n[:, None]
        gl, nl = left(sums), left(counts)
        gain = gl * gl / (nl + l2) + (g - gl) ** 2 / (n - nl + l2) - g * g / (n + l2)
        gain[(nl < least) | (n - nl < least) | self.is_end] = 0
        at, row = gain.argmax(1), np.arange(len(sums))
        return np.where(gain[row, at] > 1e-9, at, -1), gl[row, at], nl[row, at]

    def tree(self) -> dict[str, np.ndarray]:
        """One more tree of every key; rows move by their leaf's value."""
        rate, l2, least, depth = self.p["rate"], self.p["l2"], self.p["least"], self.p["depth"]
        g = self.y - self.f
        node = self.key.astype(np.int64)                    # of this level
        rows = np.arange(len(self.y))
        out = {c: [] for c in ("key", "node", "feature", "bin", "left", "right", "value", "n")}
        keys, ids = np.arange(self.n_keys), np.zeros(self.n_keys, np.int64)      # of the level's nodes
        next_id = np.ones(self.n_keys, np.int64)
        self.steps: list[tuple[np.ndarray, ...]] = []       # value, feature, bin and left child by node, of each level
        sums, counts = self.level_histograms(rows, node, np.arange(self.n_keys), self.n_keys, g)
        total, size = sums[:, :self.sizes[0]].sum(1), counts[:, :self.sizes[0]].sum(1)
        opened = (size >= 2 * least) & (depth > 0)          # nodes that may split; the others keep no histogram
        sums, counts = sums[opened], counts[opened]
        value_of = np.zeros(len(self.y))
        for level in range(depth + 1):
            value = rate * total / (size + l2)
            split, gl, nl = np.full(len(keys), -1), np.zeros(len(keys)), np.zeros(len(keys))
            slot = np.full(len(keys), -1)
            if opened.any():
                slot[opened] = np.arange(len(sums))
                split[opened], gl[opened], nl[opened] = self.best_splits(sums, counts, total[opened], size[opened])
            parents = np.flatnonzero(split >= 0)
            left, right = np.full(len(keys), -1), np.full(len(keys), -1)
            for k in np.unique(keys[parents]):
                mine = parents[keys[parents] == k]
                left[mine] = next_id[k] + 2 * np.arange(len(mine))
                right[mine] = left[mine] + 1
                next_id[k] += 2 * len(mine)
            feature = np.where(split >= 0, self.feature_of[split], -1)
            bins = np.where(split >= 0, split - self.start[feature], -1)
            for c, v in zip(out, (keys, ids, feature, bins, left, right, value, size)):
                out[c].append(v)
            value_of[rows] = value[node[rows]]
            child = np.full(len(keys), -1)
            child[parents] = np.arange(len(parents)) * 2
            self.steps.append((value, feature, bins, child))
            if not len(parents):
                break
            rows = rows[split[node[rows]] >= 0]
            at = node[rows]
            node[rows] = child[at] + (self.bins_of(rows, feature[at]) > bins[at])
            # the smaller child's histogram is counted, the other's is what is left of the parent's
            both = np.stack((nl[parents], size[parents] - nl[parents]), 1)
            opened = ((both >= 2 * least) & (level + 1 < depth)).ravel()
            pairs = np.flatnonzero(opened.reshape(-1, 2).any(1))
            if len(pairs):
                small = 2 * pairs + (both[pairs, 0] > both[pairs, 1])
                number = np.full(2 * len(parents), -1)
                number[small] = np.arange(len(small))
                part = self.level_histograms(rows, node, number, len(small), g)
                kept = []
                for whole, one in zip((sums, counts), part):
                    h = np.empty((2 * len(parents), self.bins))
                    h[small] = one
                    h[small ^ 1] = whole[slot[parents[pairs]]] - one
                    kept.append(h[opened])
                sums, counts = kept
            total, size = np.stack((gl[parents], total[parents] - gl[parents]), 1).ravel(), both.ravel()
            keys, ids = np.repeat(keys[parents], 2), np.stack((left[parents], right[parents]), 1).ravel()
        self.f += value_of
        return {c: np.concatenate(v) for c, v in out.items()}

    def grow(self, names: np.ndarray, first: int, rounds: int) -> Iterator[pa.RecordBatch]:
        for t in range(first, first + rounds):
            tree = self.tree()
            thresholds = [self.edges[f][b] if f >= 0 else None for f, b in zip(tree["feature"], tree["bin"])]
            yield _nodes(names[tree["key"]], t, tree["node"], tree["feature"], thresholds, tree["left"], tree["right"],
                         tree["value"], tree["n"])


def _nodes(key, tree, node, feature, threshold, left, right, value, n) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(key, pa.string()), pa.array(np.full(len(node), tree, np.int32)),
         *(pa.array(np.asarray(c).astype(np.int32)) for c in (node, feature)), pa.array(threshold, pa.float64()),
         *(pa.array(np.asarray(c).astype(np.int32)) for c in (left, right)),
         pa.array(np.asarray(value, np.float64)), pa.array(np.asarray(n).astype(np.int64))],
        ["key", "tree", "node", "feature", "threshold", "left", "right", "value", "n"])


class Joint:
    """Bins of several features in one code of at most ``JOINT`` values, whose
    histogram holds theirs as its margins; features of one bin are in none."""

    def __init__(self, sizes: np.ndarray):
        self.sizes, self.groups, values = sizes, [], 0
        for f in np.flatnonzero(sizes > 1).tolist():
            if not self.groups or values * sizes[f] > JOINT:
                self.groups.append([])
                values = 1
            self.groups[-1].append(f)
            values *= int(sizes[f])
        self.start = np.concatenate(([0], np.cumsum(sizes)))
        self.group_of, self.stride = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64)
        for i, group in enumerate(self.groups):
            self.group_of[group] = i
            self.stride[group] = np.append(np.cumprod(sizes[group][:0:-1])[::-1], 1)

    def codes(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.groups), len(x)), np.uint16)
        for code, group in zip(out, self.groups):
            for f in group:
                code += x[:, f] * np.uint16(self.stride[f])
        return out

    def bins(self, codes: np.ndarray, rows: np.ndarray, feature: np.ndarray) -> np.ndarray:
        """The bin of each row in the feature given for it."""
        return codes[self.group_of[feature], rows] // self.stride[feature] % self.sizes[feature]

    def walk(self, codes: np.ndarray, key: np.ndarray, steps: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows that the steps of a tree move to a next level, every row's node
        there or where it stays, and every row's value."""
        node, rows, values = key.astype(np.int64), np.arange(len(key)), np.zeros(len(key))
        for value, feature, cut, child in steps:
            values[rows] = value[node[rows]]
            rows = rows[feature[node[rows]] >= 0]
            at = node[rows]
            node[rows] = child[at] + (self.bins(codes, rows, feature[at]) > cut[at])
        return rows, node, values

    def histograms(self, blocks: list[tuple], n_nodes: int) -> tuple[np.ndarray, np.ndarray]:
        """Sums and counts by (node, bin) of blocks of codes, rows, their nodes and residuals."""
        sums, counts = np.zeros((n_nodes, self.start[-1])), np.zeros((n_nodes, self.start[-1]))
        total, size = np.zeros(n_nodes), np.zeros(n_nodes)
        for _, _, node, g in blocks:
            total += np.bincount(node, g, n_nodes)
            size += np.bincount(node, minlength=n_nodes)
        single = self.start[:-1][self.sizes == 1]
        sums[:, single], counts[:, single] = total[:, None], size[:, None]
        for i, group in enumerate(self.groups):
            shape = self.sizes[group].tolist()
            width = math.prod(shape)
            joint = np.zeros((2, n_nodes * width))
            for codes, rows, node, g in blocks:
                flat = node * width
                flat += codes[i].take(rows)
                joint[0] += np.bincount(flat, g, n_nodes * width)
                joint[1] += np.bincount(flat, minlength=n_nodes * width)
            joint = joint.reshape(2, n_nodes, *shape)
            for place, f in enumerate(group):
                margin = joint.sum(tuple(a for a in range(2, 2 + len(shape)) if a != 2 + place))
                sums[:, self.start[f]:self.start[f + 1]], counts[:, self.start[f]:self.start[f + 1]] = margin
        return sums, counts


def _advance(joint: Joint, trees: list[list], block: tuple) -> tuple:
    """A block (key, codes, y, predictions) with the trees' values added."""
    key, codes, y, f = block
    for steps in trees:
        f = f + joint.walk(codes, key, steps)[2]
    return key, codes, y, f


def _partition_histograms(joint: Joint, trees: list[list], steps: list[tuple], number: np.ndarray,
                          blocks: Iterator[tuple]) -> Iterator[tuple]:
    """Of the numbered nodes that a task's rows reach: numbers, sums, counts."""
    found = []
    for block in blocks:
        key, codes, y, f = _advance(joint, trees, block)
        rows, node, _ = joint.walk(codes, key, steps)
        rows = rows[number[node[rows]] >= 0]
        found.append((codes, rows, number[node[rows]], (y - f)[rows]))
    if any(len(rows) for _, rows, _, _ in found):
        present = np.unique(np.concatenate([n for _, _, n, _ in found]))
        found = [(codes, rows, np.searchsorted(present, n), g) for codes, rows, n, g in found if len(rows)]
        yield (present, *joint.histograms(found, len(present)))


class WideGrower(Grower):
    """Trees of keys whose rows lie in cached blocks over many tasks."""

    def __init__(self, blocks: RDD, joint: Joint, edges: list[list[float]], n_keys: int, params: dict):
        none = np.empty(0)
        super().__init__(np.empty((0, len(edges)), np.uint8), edges, np.empty(0, np.int64), n_keys, none, params, none)
        self.first = self.blocks = blocks.persist(StorageLevel.MEMORY_AND_DISK)
        self.joint, self.trees, self.taken, self.stale = joint, [], 0, []

    def level_histograms(self, rows, node, number, n_nodes, g) -> list[np.ndarray]:
        work = partial(_partition_histograms, self.joint, self.trees[self.taken:], self.steps, number)
        sums, counts = np.zeros((n_nodes, self.bins)), np.zeros((n_nodes, self.bins))
        for present, some, held in self.blocks.mapPartitions(work).collect():
            sums[present] += some
            counts[present] += held
        for old in self.stale:
            old.unpersist()
        self.stale = []
        return [sums, counts]

    def tree(self) -> dict[str, np.ndarray]:
        out = super().tree()
        self.trees.append(self.steps)
        if len(self.trees) - self.taken == REFRESH:
            if self.blocks is not self.first:
                self.stale.append(self.blocks)
            # now and then from the first blocks, which keeps the lineage short
            again = len(self.trees) % (10 * REFRESH) == 0
            begin, more = (self.first, self.trees) if again else (self.blocks, self.trees[self.taken:])
            self.blocks = begin.map(partial(_advance, self.joint, list(more))).persist(StorageLevel.MEMORY_AND_DISK)
            self.taken = len(self.trees)
        return out

    def release(self) -> None:
        for held in (*self.stale, self.blocks, self.first):
            held.unpersist()


class Together:
    """Sums of arrays over all tasks of a barrier stage, through files of a
    folder that they share: each task sums one part of all tasks' arrays, in
    the tasks' order, and all read the sums."""

    def __init__(self, folder: str, rank: int, tasks: int):
        self.folder, self.rank, self.tasks, self.step = folder, rank, tasks, 0
        os.makedirs(folder, exist_ok=True)

    def _put(self, name: str, values: np.ndarray) -> None:
        to = f"{self.folder}/{name}-{self.rank}"
        values.tofile(to + "~")
        os.rename(to + "~", to)

    def _get(self, name: str, rank: int, first: int, n: int) -> np.ndarray:
        begun, pause = time.monotonic(), 2e-4
        while True:
            try:
                return np.fromfile(f"{self.folder}/{name}-{rank}", np.float64, n, offset=8 * first)
            except FileNotFoundError:
                if time.monotonic() - begun > LOST:
                    raise TimeoutError(f"task {rank} said nothing for {LOST} s") from None
                time.sleep(pause)
                pause = min(pause * 1.2, 0.02)

    def total(self, values: np.ndarray) -> np.ndarray:
        ends = np.linspace(0, len(values), self.tasks + 1).astype(int)
        first, n = ends[self.rank], ends[self.rank + 1] - ends[self.rank]
        said, summed = f"{self.step}a", f"{self.step}b"
        self._put(said, values)
        mine = np.zeros(n)
        for rank in range(self.tasks):
            mine += self._get(said, rank, first, n)
        # all have said this, so nobody reads what was said before
        for name in (f"{self.step - 1}a", f"{self.step - 1}b") if self.step else ():
            os.unlink(f"{self.folder}/{name}-{self.rank}")
        self._put(summed, mine)
        out = np.concatenate([self._get(summed, rank, 0, ends[rank + 1] - ends[rank]) for rank in range(self.tasks)])
        self.step += 1
        return out

    def is_slow(self) -> bool:
        """Whether a sum takes too long here; all tasks say the same."""
        self.total(np.zeros(1))
        begun, times = time.monotonic(), 5
        for _ in range(times):
            self.total(np.zeros(self.tasks))
        return self.total(np.full(self.tasks, time.monotonic() - begun))[0] > WAIT * times * self.tasks


class TogetherGrower(Grower):
    """Trees of keys whose rows lie in all tasks of a barrier stage: every task
    grows the same trees, and has its own rows' part of the histograms."""

    def __init__(self, blocks: list[tuple], joint: Joint, edges: list[list[float]], n_keys: int, params: dict, together: Together):
        empty = [np.empty(0, np.int32), np.empty((len(joint.groups), 0), np.uint16), np.empty(0), np.empty(0)]
        key, codes, y, f = (np.concatenate(c, axis=-1) for c in zip(*blocks)) if blocks else empty
        super().__init__(np.empty((0, len(edges)), np.uint8), edges, key.astype(np.int64), n_keys, y, params, f)
        self.joint, self.joined, self.together = joint, codes, together

    def bins_of(self, rows, feature):
        return self.joint.bins(self.joined, rows, feature)

    def level_histograms(self, rows, node, number, n_nodes, g) -> list[np.ndarray]:
        at = number[node[rows]]
        wanted = at >= 0
        rows, at = rows[wanted], at[wanted]
        mine = self.joint.histograms([(self.joined, rows, at, g[rows])], n_nodes)
        return list(self.together.total(np.concatenate([h.ravel() for h in mine])).reshape(2, n_nodes, -1))


def _grow_together(blocks: RDD, joint: Joint, edges: list[list[float]], names: np.ndarray, first: int, p: dict,
                   folder: str) -> list[pa.RecordBatch] | None:
    """Trees of ``names`` by one barrier stage over ``blocks``; None if the folder answers slowly."""
    def run(rows: Iterator[tuple]) -> Iterator[list[pa.RecordBatch] | None]:
        context = BarrierTaskContext.get()
        rank, held = context.partitionId(), list(rows)
        # another attempt takes another folder
        at = context.allGather(uuid.uuid4().hex)
        together = Together(f"{folder}/{at[0]}", rank, len(at))
        if together.is_slow():
            found = None
        else:
            grower = TogetherGrower(held, joint, edges, len(names), p, together)
            held.clear()
            found = list(grower.grow(names, first, p["rounds"]))
        if rank == 0:
            yield found
    return blocks.barrier().mapPartitions(run).collect()[0]


def _shared_folder(spark) -> str | None:
    """A new folder below the shared one, if that is a local path."""
    at = urlparse(ensure_checkpoint_dir(spark))
    return f"{unquote(at.path).rstrip('/')}/together-{uuid.uuid4().hex}" if at.scheme in ("", "file") and not at.netloc else None


def _slots(spark) -> int:
    """Tasks that can run at once, as a barrier stage needs it; 0 if that may change."""
    if spark.conf.get("spark.dynamicAllocation.enabled", "false").lower() == "true":
        return 0
    sc = spark.sparkContext._jsc.sc()
    return sc.maxNumConcurrentTasks(sc.resourceProfileManager().defaultResourceProfile())


def _grow_wide(slim: DataFrame, edges: list[list[float]], keys: list[tuple[str, float]], n_rows: int, rows_a_task: int,
               first: int, begin: str | None, p: dict) -> Iterator[pa.RecordBatch]:
    """Grow ``keys`` (name, mean), whose ``n_rows`` rows lie in many tasks, in step."""
    spark = slim.sparkSession
    joint, names, base = Joint(np.array([len(e) + 1 for e in edges])), np.array([k for k, _ in keys]), np.array([b for _, b in keys])
    place = {k: i for i, k in enumerate(names.tolist())}
    tasks = max(-(-n_rows // MOST_A_TASK), min(spark.sparkContext.defaultParallelism, -(-2 * n_rows // rows_a_task)))
    by, mine = ["key", F.xxhash64("o"), "o"], slim.where(F.col("key").isin(list(place)))
    folder = _shared_folder(spark) if tasks <= _slots(spark) else None
    dealt = (mine.repartitionByRange(tasks, *by) if folder is None else mine.repartition(tasks, "o")).sortWithinPartitions(*by)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def block() -> pa.RecordBatch:
            key, codes, y, f = (np.concatenate(c, axis=-1) for c in zip(*held))
            return pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(c).tobytes()], pa.binary()) for c in (key, codes, y, f)],
                                              ["key", "codes", "y", "f"])
        for b in batches:
            key = np.array([place[k] for k in b.column("key").to_pylist()], np.int32)
            x = binned(b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1), edges)
            f = base[key] if begin is None else b.column("f").to_numpy()
            held.append((key, joint.codes(x), b.column("y").to_numpy(), f))
            size += b.num_rows
            if size >= BLOCK:
                yield block()
                held, size = [], 0
        if size:
            yield block()

    def unpack(row) -> tuple:
        key = np.frombuffer(row.key, np.int32)
        return (key, np.frombuffer(row.codes, np.uint16).reshape(-1, len(key)), np.frombuffer(row.y), np.frombuffer(row.f))

    blocks = dealt.mapInArrow(pack, "key binary, codes binary, y binary, f binary").rdd.map(unpack)
    if begin is None:
        yield _bases(names, base)
    if folder is not None and blocks.getNumPartitions() <= _slots(spark):
        try:
            trees = _grow_together(blocks, joint, edges, names, first, p, folder)
        finally:
            _remove(spark, folder)
        if trees is not None:
            yield from trees
            return
    grower = WideGrower(blocks, joint, edges, len(names), p)
    yield from grower.grow(names, first, p["rounds"])
    grower.release()


def _sizes(slim: DataFrame) -> DataFrame:
    return slim.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean"))


def key_sizes(rows: DataFrame, *, key: str, label: str, order: str, features: str = "x") -> DataFrame:
    """Rows that :func:`fit` takes, and their mean label, of every key."""
    return _sizes(rows.select(F.col(key).cast("string").alias("key"), F.col(features).alias("x"),
                              F.col(label).cast("double").alias("y"), F.col(order).cast("string").alias("o")).dropna())


def fit(rows: DataFrame, *, key: str, label: str, order: str, features: str = "x", edges: list[list[float]] | None = None,
        rows_a_task: int = ROWS_A_TASK, batch_rows: int = 20_000, first: int = 0, begin: str | None = None,
        sizes: DataFrame | None = None, **params) -> DataFrame:
    """Nodes of the trees of every ``key``, as a DataFrame; write it before use.

    ``features`` is an array of doubles of one width without nulls; ``order``
    a column that tells the rows of a key apart.  Keys of over ``rows_a_task``
    rows are grown by this call, ``KEYS_AT_ONCE`` together, each level a job;
    their trees alone pass the driver.  Rows without a key, label or features
    are left out.

    To go on from a saved stage, ``first`` is the number of its trees and
    ``begin`` the column of their predictions; the base value is not repeated.
    ``sizes``: what :func:`key_sizes` says of the rows, if it is known.
    """
    spark = rows.sparkSession
    ship_package(spark)
    p = {**BOOST, **params}
    slim = rows.select(F.col(key).cast("string").alias("key"), F.col(features).alias("x"), F.col(label).cast("double").alias("y"),
                       F.col(order).cast("string").alias("o"),
                       (F.lit(0.0) if begin is None else F.col(begin)).cast("double").alias("f")).dropna()
    edges = bin_edges(slim) if edges is None else edges
    sizes = _sizes(slim).persist() if sizes is None else sizes
    wide = sizes.where(F.col("n") > rows_a_task).orderBy("key").collect()       # rows / rows_a_task at most
    few = sizes.where(F.col("n") <= rows_a_task).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    tasks = max(1, -(-few // rows_a_task))
    alone = slim.where(~F.col("key").isin([r.key for r in wide])) if wide else slim
    shared_edges = spark.sparkContext.broadcast(edges)
    dealt = (alone.repartition(1) if tasks == 1 else alone.repartition(tasks, "key")).sortWithinPartitions(
        "key", F.xxhash64("o"), "o")

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = shared_edges.value
        names, xs, ys, fs = [], [], [], []
        for b in batches:
            names.append(np.array(b.column("key").to_pylist(), object))
            xs.append(binned(b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1), edges))
            ys.append(b.column("y").to_numpy())
            fs.append(b.column("f").to_numpy())
        if not names:
            return
        name, x, y, f = (np.concatenate(c) for c in (names, xs, ys, fs))
        del names, xs, ys, fs
        if begin is None:
            f = None
        keys, number = np.unique(name.astype(str), return_inverse=True)
        alone = list(range(len(keys)))
        sizes = np.bincount(number, minlength=len(keys))
        while alone:
            some, held_rows = [], 0
            while alone and (not some or held_rows + sizes[alone[-1]] <= batch_rows):
                held_rows += sizes[alone[-1]]
                some.append(alone.pop())
            place = np.full(len(keys), -1)
            place[some] = np.arange(len(some))
            mine = np.flatnonzero(place[number] >= 0)
            grower = Grower(x[mine], edges, place[number[mine]], len(some), y[mine], p, f if f is None else f[mine])
            if f is None:
                yield _bases(keys[some], grower.base)
            yield from grower.grow(keys[some], first, p["rounds"])

    batches = []
    for at in range(0, len(wide), KEYS_AT_ONCE):
        some = wide[at:at + KEYS_AT_ONCE]
        batches.extend(_grow_wide(slim, edges, [(r.key, r.mean) for r in some], sum(r.n for r in some), rows_a_task, first, begin, p))
    small = dealt.mapInArrow(grow, NODES)
    if not batches:
        return small
    large = spark.createDataFrame(pa.Table.from_batches(batches), NODES)
    return small.unionByName(large) if few else large


def _bases(names: np.ndarray, base: np.ndarray) -> pa.RecordBatch:
    n = len(names)
    return _nodes(names, BASE_TREE, np.zeros(n), np.full(n, -1), [None] * n, np.full(n, -1), np.full(n, -1), base, np.zeros(n))


def _remove(spark, folder: str) -> None:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path("file://" + folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


# ------------------------------------------------------------------ scoring and explaining

class Forest:
    """The trees of one key as flat arrays, for many rows at once."""

    def __init__(self, nodes: pa.Table):
        nodes = nodes.sort_by([("tree", "ascending"), ("node", "ascending")])
        col = {c: nodes[c].to_numpy() for c in ("tree", "node", "feature", "threshold", "left", "right", "value")}
        is_base = col["tree"] == BASE_TREE
        self.base = float(col["value"][is_base].sum()) if is_base.any() else math.nan
        col = {c: v[~is_base] for c, v in col.items()}
        self.root = np.flatnonzero(col["node"] == 0)
        start = np.repeat(self.root, np.diff(np.append(self.root, len(col["node"]))))
        self.feature, self.value = col["feature"].astype(np.int64), col["value"]
        self.threshold = np.nan_to_num(col["threshold"].astype(np.float64))
        self.is_leaf = self.feature < 0
        here = np.arange(len(start))
        self.left = np.where(self.is_leaf, here, start + col["left"])
        self.right = np.where(self.is_leaf, here, start + col["right"])

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree."""
        at = np.broadcast_to(self.root, (len(x), len(self.root))).copy()
        row = np.arange(len(x))[:, None]
        while True:
            inner = ~self.is_leaf[at]
            if not inner.any():
                return at
            goes_left = x[row, np.maximum(self.feature[at], 0)] <= self.threshold[at]
            at = np.where(goes_left, self.left[at], self.right[at])

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.base + self.value[self.leaves(x)].sum(1)

    def credits(self) -> tuple[np.ndarray, np.ndarray]:
        """For every node, the features that split above it and the change of
        value that each brings: rows of equal width, padded with feature -1."""
        parent = np.full(len(self.value), -1)
        inner = np.flatnonzero(~self.is_leaf)
        parent[self.left[inner]] = inner
        parent[self.right[inner]] = inner
        features, changes, at = [], [], np.arange(len(self.value))
        while (parent[at] >= 0).any():
            up = parent[at]
            real = up >= 0
            features.append(np.where(real, self.feature[np.maximum(up, 0)], -1))
            changes.append(np.where(real, self.value[at] - self.value[np.maximum(up, 0)], 0.0))
            at = np.where(real, up, at)
        if not features:
            return np.full((len(self.value), 1), -1), np.zeros((len(self.value), 1))
        return np.stack(features, 1), np.stack(changes, 1)

    def root_value(self) -> float:
        """Base of the explanations: the prediction before any split."""
        return self.base + float(self.value[self.root].sum())


def leaf_credits(nodes: DataFrame) -> DataFrame:
    """(key, tree, leaf, feature, credit): the leaf table of I5.  A row's
    explanation is the sum of the credits of its leaves."""
    def expand(left: pa.Table) -> pa.Table:
        forest = Forest(left)
        if not len(forest.root):
            return pa.table({"key": pa.array([], pa.string()), "tree": pa.array([], pa.int32()), "leaf": pa.array([], pa.int32()),
                             "feature": pa.array([], pa.int32()), "credit": pa.array([], pa.float64())})
        features, changes = forest.credits()
        real = left.filter(pc.greater_equal(left["tree"], 0)).sort_by([("tree", "ascending"), ("node", "ascending")])
        row, place = np.nonzero((features >= 0) & forest.is_leaf[:, None])
        return pa.table({"key": real["key"].take(pa.array(row)), "tree": real["tree"].take(pa.array(row)),
                         "leaf": real["node"].take(pa.array(row)), "feature": pa.array(features[row, place].astype(np.int32)),
                         "credit": pa.array(changes[row, place])})
    ship_package(nodes.sparkSession)
    found = nodes.groupBy("key").applyInArrow(expand, "key string, tree int, leaf int, feature int, credit double")
    return found.groupBy("key", "tree", "leaf", "feature").agg(F.sum("credit").alias("credit"))


def _apply(rows: DataFrame, nodes: DataFrame, key: str | None, features: str, keep: list[str], schema: str,
           work: Callable[[Forest, np.ndarray, pa.Table], pa.Table], block_rows: int) -> DataFrame:
    """``work`` on blocks of at most about ``block_rows`` rows of a key beside
        trees of that key.  Trees of one key alone go to all tasks: they are
    bounded by rounds and depth.  Rows of a key without trees get what an
    empty forest gives: no prediction."""
    spark = rows.sparkSession
    ship_package(spark)
    columns = [f.name for f in rows.select(*keep).schema.fields]
    if key is None:
        shared = spark.sparkContext.broadcast(nodes.toArrow())

        def run(batches):
            forest = Forest(shared.value)
            for b in batches:
                yield from work(forest, _matrix(b.column("_x")), pa.table(
                    {c: b.column(c) for c in columns})).to_batches()
        return rows.select(*keep, F.col(features).alias("_x")).mapInArrow(run, schema)

    # a key's rows are dealt to as many blocks as they fill, and its trees go to each
    sizes = rows.groupBy(F.col(key).cast("string").alias("_k")).agg(
        F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("_blocks"))
    dealt = (rows.select(*keep, F.col(features).alias("_x"), F.col(key).cast("string").alias("_k")).join(sizes, "_k")
             .withColumn("_b", F.pmod(F.xxhash64(*keep), F.col("_blocks")).cast("int")))
    trees = nodes.join(sizes, nodes["key"] == sizes["_k"]).withColumn("_b", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))

    def pair(some: pa.Table, trees: pa.Table) -> pa.Table:
        if not some.num_rows:
            return to_arrow.empty_table()
        return work(Forest(trees), _matrix(some["_x"].combine_chunks()), some.select(columns))
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string
    to_arrow = to_arrow_schema(_parse_datatype_string(schema))
    return (dealt.drop("_blocks").groupBy("_k", "_b").cogroup(
        trees.select("_k", "_b", "tree", "node", "feature", "threshold", "left", "right", "value").groupBy("_k", "_b"))
        .applyInArrow(pair, schema))


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def _kinds(rows: DataFrame, keep: list[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema.fields)


def predict(rows: DataFrame, nodes: DataFrame, *, keep: list[str], key: str | None = None, features: str = "x",
            block_rows: int = 50_000) -> DataFrame:
    """I4: ``keep`` and ``prediction`` of every row, by the trees of its
    ``key`` (None: the nodes are of one key, which serves all rows)."""
    def work(forest, x, some):
        out = np.concatenate([forest.predict(x[i:i + 512]) for i in range(0, len(x), 512)] or [np.empty(0)])
        return some.append_column("prediction", pa.array(out, mask=np.isnan(out)))
    return _apply(rows, nodes, key, features, keep, f"{_kinds(rows, keep)}, prediction double", work, block_rows)


def explain(rows: DataFrame, nodes: DataFrame, *, keep: list[str], key: str | None = None, features: str = "x",
            block_rows: int = 50_000) -> DataFrame:
    """``keep``, feature_index, value, contrib, base, walk_pred: for every
    row the features that its leaves credit.

    A row's contributions are the sparse sums of its leaves' entries in the
    leaf table; base plus contributions is the prediction.  A row that no
    feature moves keeps a zero for feature 0; a row of a key without trees has
    no explanation.
    """
    def work(forest, x, some):
        features_of, change_of = forest.credits()
        base, width = forest.root_value(), x.shape[1]
        parts = []
        if math.isnan(forest.base):
            x = x[:0]
        for i in range(0, max(1, len(x)), 256):
            piece = x[i:i + 256]
            leaves = forest.leaves(piece)
            f, c = features_of[leaves], change_of[leaves]
            code = (np.arange(len(piece))[:, None, None] * width + f)[f >= 0]
            sums = np.bincount(code, c[f >= 0], len(piece) * width).astype(np.float64)
            seen = np.bincount(code, minlength=len(piece) * width) > 0
            at = np.flatnonzero(seen & (sums != 0))
            still = np.setdiff1d(np.arange(len(piece)), at // width) * width
            at = np.sort(np.concatenate((at, still)))
            walk = forest.base + forest.value[leaves].sum(1)
            parts.append((i + at // width, at % width, piece[at // width, at % width], sums[at], walk[at // width]))
        row, feature, value, credit, walk = (np.concatenate(c) for c in zip(*parts))
        out = some.take(pa.array(row))
        for name, c in (("feature_index", pa.array(feature.astype(np.int32))), ("value", pa.array(value)),
                        ("contrib", pa.array(credit)), ("base", pa.array(np.full(len(row), base))), ("walk_pred", pa.array(walk))):
            out = out.append_column(name, c)
        return out
    schema = f"{_kinds(rows, keep)}, feature_index int, value double, contrib double, base double, walk_pred double"
    return _apply(rows, nodes, key, features, keep, schema, work, block_rows)
