"""Boosted trees for several classes, all classes and folds grown together.

Rows are blocks of small numbers (bins of the features' values). A round grows one tree for each model (all rows, and all
but one fold) and class, level by level: each level is one aggregation, in which a task sums rows, residuals and curvatures by
model, class, node, feature and bin. Only those sums reach the driver; their size doesn't depend on the rows. Residuals
are rounded to whole numbers and leaves to a fixed grid, so sums don't depend on their order, nor trees on the partitions.
Blocks carry their margins, renewed every few rounds; a lost block is made again from the written table and the trees.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.tables import kept

#: Bins of a feature; rows of a partition of blocks; rounds between two renewals of margins; parts merged by tasks first.
BINS, PART_ROWS, RENEW, MERGED = 32, 1 << 16, 8, 32
#: Values of the cuts' sketch: cuts are exact up to as many rows, and may depend on partitions beyond.
ACCURACY = 10_000
#: Residuals are whole multiples of 1 / RESIDUAL, leaves of 1 / LEAF.
RESIDUAL, LEAF = float(1 << 24), float(1 << 40)
#: Cut of a node that isn't split: all its rows go left.
WHOLE = 255
BLOCK = "bins binary, label binary, fold binary, draw binary"


def cuts_of(rows: DataFrame, features: list[str]) -> list[list[float]]:
    """Rising cuts of each feature, BINS - 1 at most."""
    grid = [k / BINS for k in range(1, BINS)]
    found = rows.agg(*[F.percentile_approx(c, grid, ACCURACY).alias(c) for c in features]).first()
    return [sorted(set(found[c] or [])) for c in features]


def binned(table: pa.Table | pa.RecordBatch, cuts: list[list[float]], features: list[str]) -> np.ndarray:
    """Rows by features: the number of cuts that lie below the value."""
    values = [table.column(c).to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch) else table.column(c).to_numpy() for c in features]
    return np.stack([np.searchsorted(k, v, side="left") for k, v in zip(cuts, values, strict=True)], axis=1).astype(np.uint8)


def descend(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
    """The node that each row (last axis) reaches in each tree; nodes are in heap order, the last axis of ``feature``."""
    at, row = np.zeros(feature.shape[:-1] + (len(bins),), np.int64), np.arange(len(bins))
    for _ in range(levels):
        f, k = np.take_along_axis(feature, at, -1), np.take_along_axis(cut, at, -1)
        at = 2 * at + 1 + (bins[row, f] > k)
    return at


@dataclass
class Trees:
    """``base`` (models, classes) margins; each round has ``feature`` and ``cut`` of nodes, ``leaf`` values, and ``cover``, the
    training rows of nodes and leaves, all by models and classes."""

    depth: int
    base: np.ndarray
    rounds: list[dict] = field(default_factory=list)

    def reached(self, bins: np.ndarray, one: dict) -> np.ndarray:
        return descend(bins, one["feature"], one["cut"], self.depth) - (2**self.depth - 1)

    def added(self, bins: np.ndarray, margins: np.ndarray, rounds: list[dict]) -> np.ndarray:
        """``margins`` (models, classes, rows) with those of ``rounds``."""
        for one in rounds:
            margins = margins + np.take_along_axis(one["leaf"], self.reached(bins, one), -1)
        return margins

    def first(self) -> Trees:
        """The model of all rows alone."""
        return Trees(self.depth, self.base[:1], [{k: v[:1] for k, v in one.items()} for one in self.rounds])

    def margins(self, bins: np.ndarray) -> np.ndarray:
        return self.added(bins, np.repeat(self.base[:, :, None], len(bins), -1), self.rounds)

    def with_other(self, own: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Features, classes, rows: the first model's margins if one feature's bins came from ``other``. Only the trees that use the
        feature are passed again; margins are multiples of a grid, so that differences are exact."""
        out = np.repeat(self.margins(own)[:1], own.shape[1], 0)
        for one in self.rounds:
            for c in range(len(self.base[0])):
                feature, cut, leaf = one["feature"][0, c], one["cut"][0, c], one["leaf"][0, c]
                used = np.unique(feature[cut != WHOLE])
                if not len(used):
                    continue
                before = leaf[descend(own, feature, cut, self.depth) - len(feature)]
                for f in used:
                    mixed = own.copy()
                    mixed[:, f] = other[:, f]
                    out[f, c] += leaf[descend(mixed, feature, cut, self.depth) - len(feature)] - before
        return out

    def paths(self, one: dict, c: int) -> list[tuple[float, float, dict]]:
        """For each leaf with a value: value, share of the training rows, and by feature the share of rows that its nodes send
        this way, with the nodes and sides."""
        feature, cut, leaf, cover = one["feature"][0, c], one["cut"][0, c], one["leaf"][0, c], one["cover"][0, c]
        out = []
        for i in np.flatnonzero(leaf):
            at, by = int(i) + len(feature), {}
            while at:
                up = (at - 1) // 2
                if cut[up] != WHOLE:
                    share, nodes = by.get(int(feature[up]), (1.0, []))
                    by[int(feature[up])] = (share * float(cover[at] / cover[up]), [*nodes, (up, at % 2 == 0)])
                at = up
            out.append((float(leaf[i]), math.prod(s for s, _ in by.values()), by))
        return out

    def shapley(self, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected margins by class, and the exact Shapley values (classes, rows, features) of the first model. A feature that is
        not known sends a row both ways, by the shares of the training rows. A leaf's part depends on the features of its path
        alone, ``depth`` at most, whose subsets are all gone through."""
        expected, out = self.base[0].copy(), np.zeros((self.base.shape[1], *bins.shape))
        for one in self.rounds:
            for c in range(len(expected)):
                feature, cut = one["feature"][0, c], one["cut"][0, c]
                right = [bins[:, f] > k for f, k in zip(feature, cut, strict=True)]
                for value, share, by in self.paths(one, c):
                    expected[c] += value * share
                    fits = {f: np.logical_and.reduce([right[n] == side for n, side in nodes]).astype(float) for f, (_, nodes) in by.items()}
                    for f, (sent, _) in by.items():
                        others = [g for g in by if g != f]
                        weight = np.zeros(len(bins))
                        for size in range(len(others) + 1):
                            for known in combinations(others, size):
                                part = math.factorial(size) * math.factorial(len(others) - size) / math.factorial(len(by))
                                weight += part * math.prod([fits[g] if g in known else by[g][0] for g in others])
                        out[c, :, f] += value * (fits[f] - sent) * weight
        return expected, out


def _drawn(draw: np.ndarray, k: int, share: float) -> np.ndarray:
    """Rows drawn in round ``k``, by their hash alone."""
    z = draw + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(32)) < share * 2**32


def _residuals(trees: Trees, block: dict, rounds: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    margins = trees.added(block["bins"], block["margins"], rounds)
    p = np.exp(margins - margins.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    return (block["label"] == np.arange(p.shape[1])[:, None]) - p, p * (1 - p)


def _sums(trees: Trees, block: dict, rounds: list[dict], growing: dict, level: int, k: int, share: float) -> np.ndarray:
    """(3, models, classes, nodes of the level, features, BINS): rows, residuals and curvatures of a block."""
    bins = block["bins"]
    m, c, n = block["margins"].shape
    nodes, width = 2**level, bins.shape[1]
    taken = _drawn(block["draw"], k, share) & (block["fold"] != np.arange(-1, m - 1)[:, None])
    g, h = _residuals(trees, block, rounds)
    at = descend(bins, growing["feature"], growing["cut"], level) - (nodes - 1)
    at += np.arange(m * c).reshape(m, c, 1) * nodes
    which = np.broadcast_to(taken[:, None, :], at.shape)
    row, at = np.broadcast_to(np.arange(n), at.shape)[which], at[which] * BINS
    g, h = np.rint(g[which] * RESIDUAL), np.rint(h[which] * RESIDUAL)
    out = np.empty((3, m * c * nodes, width, BINS), np.int64)
    for f in range(width):
        cell = at + bins[row, f]
        for i, w in enumerate((None, g, h)):
            out[i, :, f] = np.bincount(cell, w, minlength=m * c * nodes * BINS).reshape(-1, BINS)
    return out.reshape(3, m, c, nodes, width, BINS)


def _split(sums: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each node the feature and cut that part its residuals best (the first of equal ones), and the sums left and right."""
    left = sums.cumsum(-1)
    total = left[..., :1, -1:]
    right = total - left
    with np.errstate(divide="ignore", invalid="ignore"):
        apart = left[1] / left[0] - right[1] / right[0]
        gain = left[0] * (right[0] / total[0]) * (apart / RESIDUAL) ** 2
    gain = np.where((left[0] > 0) & (right[0] > 0) & (gain > 1e-12), gain, 0.0)
    flat = gain.reshape(*gain.shape[:-2], -1)
    best = flat.argmax(-1)
    none = flat.max(-1) == 0
    at = best[None, ..., None]
    parts = np.stack([np.take_along_axis(x.reshape(*x.shape[:-2], -1), at, -1)[..., 0] for x in (left, right)], -1)
    whole = np.stack([total[..., 0, 0], np.zeros_like(total[..., 0, 0])], -1)
    feature, cut = np.where(none, 0, best // BINS), np.where(none, WHOLE, best % BINS)
    return feature, cut, total[0, ..., 0, 0], np.where(none[None, ..., None], whole, parts)


def _reduced(sums: RDD) -> np.ndarray:
    return sums.treeReduce(np.add) if sums.getNumPartitions() > MERGED else sums.reduce(np.add)


def blocks(rows: DataFrame, cuts: list[list[float]], features: list[str], n: int) -> DataFrame:
    """``features``, ``label``, ``fold`` and ``draw`` of rows (``n`` of them) as blocks of a written table."""

    def packed(batches):
        for batch in batches:
            columns = [binned(batch, cuts, features), *[batch.column(c).to_numpy().astype(t) for c, t in (("label", np.int16), ("fold", np.int16), ("draw", np.int64))]]
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in columns], ["bins", "label", "fold", "draw"])

    return kept(rows.select(*features, "label", "fold", "draw").repartition(-(-n // PART_ROWS)).mapInArrow(packed, BLOCK))


def fit(table: DataFrame, base: np.ndarray, width: int, rounds: int, depth: int, step: float, share: float) -> tuple[Trees, np.ndarray]:
    """Trees over ``blocks`` of ``width`` features, starting with margins ``base`` (models, classes); and for each model the rows it
    is tried on (all rows for the first one, the left-out fold for each other) and how many of them it gets right."""
    models, classes = base.shape
    grid = lambda x: np.rint(x * LEAF) / LEAF
    trees = Trees(depth, grid(base))
    empty = Trees(depth, trees.base)

    def opened(row) -> dict:
        label = np.frombuffer(row.label, np.int16)
        bins = np.frombuffer(row.bins, np.uint8).reshape(len(label), width)
        return {"bins": bins, "label": label, "fold": np.frombuffer(row.fold, np.int16), "draw": np.frombuffer(row.draw, np.uint64), "margins": empty.margins(bins)}

    held = table.rdd.map(opened).persist(StorageLevel.MEMORY_AND_DISK)
    spent, waiting = [], []
    for k in range(rounds):
        one = {"feature": np.zeros((models, classes, 2**depth - 1), np.int64), "cut": np.full((models, classes, 2**depth - 1), WHOLE), "cover": np.zeros((models, classes, 2 ** (depth + 1) - 1), np.int64)}
        for level in range(depth):
            now = (list(waiting), {k: v.copy() for k, v in one.items()}, level, k, share)
            sums = _reduced(held.map(lambda block, now=now: _sums(empty, block, *now)))
            for old in spent:
                old.unpersist()
            spent = []
            nodes = slice(2**level - 1, 2 ** (level + 1) - 1)
            one["feature"][..., nodes], one["cut"][..., nodes], one["cover"][..., nodes], parts = _split(sums)
        parts = parts.reshape(3, models, classes, -1)
        one["cover"][..., 2**depth - 1 :] = parts[0]
        one["leaf"] = grid(step * (classes - 1) / classes * np.divide(parts[1], parts[2], out=np.zeros(parts.shape[1:]), where=parts[2] > 0))
        trees.rounds.append(one)
        waiting.append(one)
        if len(waiting) == RENEW:
            newer = held.map(lambda block, more=list(waiting): block | {"margins": empty.added(block["bins"], block["margins"], more)}).persist(StorageLevel.MEMORY_AND_DISK)
            spent, held, waiting = [held], newer, []

    def right(block: dict) -> np.ndarray:
        found = empty.added(block["bins"], block["margins"], waiting).argmax(1) == block["label"]
        tried = np.vstack([np.ones((1, len(block["fold"])), bool), block["fold"] == np.arange(models - 1)[:, None]])
        return np.stack([tried.sum(1), (found & tried).sum(1)])

    counted = _reduced(held.map(right))
    for old in [*spent, held]:
        old.unpersist()
    return trees, counted
