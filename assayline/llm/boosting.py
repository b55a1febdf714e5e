"""Small gradient-boosted trees on binned features, from an array or from all rows of a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Gradients are summed as integers of this unit, so sums do not depend on the partitioning.
UNIT = 1 << 20
#: Most tasks of a pass over stored rows; each sends its sums to the driver.
TASKS = 64


def tally(rows: DataFrame, width: int, sums: Callable, names: tuple[str, str]) -> DataFrame:
    """Sums (k, *names) over a table (x binary, y, n, ...): ``sums`` gives for the features (int16),
    labels and weights of a batch the cells k < ``width`` and two numbers for each cell. A
    task holds one number per cell."""
    one, two = names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, width), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.frombuffer(b"".join(batch.column("x").to_pylist()), "<i2")
            y, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "n"))
            for cells, *numbers in sums(x.reshape(batch.num_rows, -1), y, n):
                if len(cells):
                    low = cells.min()
                    for at, number in enumerate(numbers):
                        part = np.rint(np.bincount(cells - low, number)).astype(np.int64)
                        held[at, low : low + len(part)] += part
        k = np.flatnonzero(held.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), *map(pa.array, held[:, k])], ["k", one, two])

    return rows.select("x", "y", "n").mapInArrow(run, f"k long, {one} long, {two} long")


def _summed(rows: DataFrame, width: int, sums: Callable) -> np.ndarray:
    """The two sums of every cell; a task sends one row per cell it has met."""
    out = np.zeros((2, width), np.int64)
    for batch in tally(rows, width, sums, ("a", "b")).toArrow().to_batches():
        k = batch.column("k").to_numpy()
        np.add.at(out[0], k, batch.column("a").to_numpy())
        np.add.at(out[1], k, batch.column("b").to_numpy())
    return out


def _quantiles(values: np.ndarray, counts: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """``np.quantile`` of values that stand ``counts`` times each."""
    ends = counts.cumsum()
    at = grid * (ends[-1] - 1)
    low, high = (values[np.searchsorted(ends, f(at), "right")] for f in (np.floor, np.ceil))
    return low + (high - low) * (at - np.floor(at))


class Boosted:
    """Logistic boosting; each tree is full of depth ``depth`` and split on bin numbers."""

    def __init__(self, trees=30, depth=3, rate=0.3, bins=32, l2=1.0):
        self.trees, self.depth, self.rate, self.bins, self.l2 = trees, depth, rate, bins, l2

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(self.edges)], 1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        grid = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.edges = [np.unique(np.quantile(x[:, j], grid)) for j in range(x.shape[1])]
        b = self._binned(x)
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        f, self.model = np.full(len(y), self.base), []
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-f))
            tree, leaf = self._tree(b, y - p, p * (1 - p))
            f += tree[1][leaf]
            self.model.append(tree)
        return self

    def fit_rows(self, rows: DataFrame) -> Boosted:
        """Trees over every row of a stored table: features ``x`` (int16 bytes), label ``y`` and
        weight ``n``. The edges are exact quantiles. A level of a tree is one pass, in
        which a task sums gradients by node, feature and bin; only these sums are collected."""
        grid, bins = np.linspace(0, 1, self.bins + 1)[1:-1], self.bins
        values = [[] for _ in range(len(rows.select("x").first()[0]) // 2)]
        width = len(values)

        def each_value(x, y, n):
            for j in range(width):
                yield x[:, j].astype(np.int64) + 32768 + (j << 16), n, n * y

        per_value = tally(rows, width << 16, each_value, ("n", "ones")).groupBy("k")
        per_value = per_value.agg(F.sum("n").alias("n"), F.sum("ones").alias("ones")).orderBy("k").toArrow()
        k, n, ones = (per_value.column(c).to_numpy() for c in ("k", "n", "ones"))
        self.edges = []
        for j in range(width):
            own = k >> 16 == j
            self.edges.append(np.unique(_quantiles((k[own] & 65535) - 32768.0, n[own], grid)))
        share = np.clip(ones[k >> 16 == 0].sum() / n[k >> 16 == 0].sum(), 1e-3, 1 - 1e-3)
        self.base, self.model = float(np.log(share / (1 - share))), []
        for _ in range(self.trees):
            splits = []
            for level in range(self.depth):
                nodes, model = 1 << level, self

                def gradients(x, y, n):
                    b, p = model._binned(x), model.score(x)
                    node = np.zeros(len(x), np.int64)
                    for level_splits in splits:  # noqa: B023 - used within this turn
                        node = model._step(b, node, level_splits)
                    g, h = np.rint((y - p) * UNIT) * n, np.rint(p * (1 - p) * UNIT) * n
                    for j in range(width):
                        yield (node * width + j) * bins + b[:, j], g, h

                cells = _summed(rows, nodes * width * bins, gradients) / UNIT
                gs, hs = cells.reshape(2, nodes, width, bins).cumsum(3)
                level_splits, leaves = [], []
                for node in range(nodes):
                    g, h = gs[node, 0, -1], hs[node, 0, -1]
                    left, weight = gs[node], hs[node]
                    gain = left**2 / (weight + self.l2) + (g - left) ** 2 / (h - weight + self.l2) - g * g / (h + self.l2)
                    j, at = divmod(int(gain.argmax()), bins)
                    if gain[j, at] > 1e-12:
                        level_splits.append((j, at))
                        leaves += [(left[j, at], weight[j, at]), (g - left[j, at], h - weight[j, at])]
                    else:  # all rows to the left
                        level_splits.append((0, bins))
                        leaves += [(g, h), (0.0, 0.0)]
                splits.append(level_splits)
            g, h = np.array(leaves).T
            self.model.append((splits, self.rate * g / (h + self.l2)))
        return self

    def _tree(self, b, grad, hess):
        node, splits = np.zeros(len(b), np.int64), []
        for level in range(self.depth):
            width, level_splits = 1 << level, []
            for k in range(width):
                rows = np.flatnonzero(node == k)
                best = (0.0, 0, self.bins)  # all rows to the left
                g, h = grad[rows].sum(), hess[rows].sum()
                for j in range(b.shape[1]):
                    gs = np.bincount(b[rows, j], grad[rows], self.bins).cumsum()
                    hs = np.bincount(b[rows, j], hess[rows], self.bins).cumsum()
                    gain = (
                        gs**2 / (hs + self.l2)
                        + (g - gs) ** 2 / (h - hs + self.l2)
                        - g * g / (h + self.l2)
                    )
                    at = int(gain.argmax())
                    if gain[at] > best[0] + 1e-12:
                        best = (float(gain[at]), j, at)
                level_splits.append(best[1:])
            splits.append(level_splits)
            node = self._step(b, node, level_splits)
        size = 1 << self.depth
        g, h = np.bincount(node, grad, size), np.bincount(node, hess, size)
        return (splits, self.rate * g / (h + self.l2)), node

    @staticmethod
    def _step(b, node, level_splits):
        feature = np.array([s[0] for s in level_splits])[node]
        limit = np.array([s[1] for s in level_splits])[node]
        return node * 2 + (b[np.arange(len(b)), feature] > limit)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1."""
        b = self._binned(x)
        f = np.full(len(x), self.base)
        for splits, values in self.model:
            node = np.zeros(len(x), np.int64)
            for level_splits in splits:
                node = self._step(b, node, level_splits)
            f += values[node]
        return 1 / (1 + np.exp(-f))
