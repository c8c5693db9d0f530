"""Boosting over all rows of the cluster on sparse rows: histograms of every feature, a pass for each level of a tree.

A row counts only in the bins of its dense features and of the categories it holds, so a pass follows the entries of the rows,
not the number of category columns. Squared error as in pyspark.ml: the first tree fits the target, each later one
twice the residual of a drawn share of the rows and counts by the step.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.operators.quantiles import quantiles

#: Bins of a dense feature.
BINS = 64


@dataclass
class Layout:
    """Places of a sparse row: `first` numbers, then categories, then `last` flags; every row holds all numbers and flags."""

    first: int
    last: int
    width: int
    edges: list[np.ndarray] = field(default_factory=list)  # of the numbers, then of the flags: a value is in the bin of the first edge not below it

    @property
    def dense(self) -> list[int]:
        return [*range(self.first), *range(self.width - self.last, self.width)]


@dataclass
class Rows:
    dense: np.ndarray  # (rows, numbers and flags)
    at: np.ndarray  # row of each held category
    column: np.ndarray  # its place

    @classmethod
    def of(cls, features: pa.StructArray, lay: Layout) -> "Rows":
        places, values = features.field("indices"), features.field("values")
        ends = np.asarray(places.offsets)
        ends, place, value = ends - ends[0], np.asarray(places.flatten()), np.asarray(values.flatten(), dtype=float)
        begin, stop = ends[:-1, None], ends[1:, None]
        dense = np.concatenate([value[begin + np.arange(lay.first)], value[stop - lay.last + np.arange(lay.last)]], axis=1)
        held = (place >= lay.first) & (place < lay.width - lay.last)
        return cls(dense, np.repeat(np.arange(len(features)), np.diff(ends))[held], place[held])


@dataclass
class LevelTree:
    """Nodes in heap order from 1; feature -1 where a node is not split."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def nodes(self, rows: Rows, lay: Layout) -> np.ndarray:
        node, dense = np.ones(len(rows.dense), dtype=np.int64), {c: i for i, c in enumerate(lay.dense)}
        for i in range(1, len(self.feature) // 2):
            f = int(self.feature[i])
            if f < 0:
                continue
            if f in dense:
                right = rows.dense[:, dense[f]] > self.threshold[i]
            else:
                right = np.zeros(len(node), bool)
                right[rows.at[rows.column == f]] = True
            node[(node == i) & right] += i + 1
            node[node == i] *= 2
        return node


@dataclass
class Boosted:
    lay: Layout
    step: float
    trees: list[LevelTree] = field(default_factory=list)

    def predict(self, rows: Rows) -> np.ndarray:
        out = np.zeros(len(rows.dense))
        for k, t in enumerate(self.trees):
            out += (self.step if k else 1.0) * t.value[t.nodes(rows, self.lay)]
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        """(row_id, label, prediction) of every row."""
        model = self

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(model.predict(Rows.of(b.column(2), model.lay)))], names=["row_id", "label", "prediction"])

        return df.select(F.col("row_id").cast("bigint"), F.col("label").cast("double"), "features").mapInArrow(run, "row_id bigint, label double, prediction double")


def _taken(ids: np.ndarray, seed: int, tree: int, share: float) -> np.ndarray:
    """The drawn rows of a tree, by a hash of the row's id: the same however rows are spread."""
    with np.errstate(over="ignore"):
        z = ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(1 + tree + 1_000_003 * seed)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return (z >> np.uint64(11)).astype(float) / 2.0**53 < share


def edges_of(df: DataFrame, lay: Layout, bins: int = BINS) -> list[np.ndarray]:
    """Upper edges of all bins but the last: between all values of a feature of at most `bins`, else its quantiles over all rows."""
    n = lay.first + lay.last

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [np.zeros(0)] * n
        for b in batches:
            if b.num_rows:
                dense = Rows.of(b.column(0), lay).dense
                seen = [s if len(s) > bins else np.unique(np.append(s, dense[:, j])) for j, s in enumerate(seen)]
        yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array([s[: bins + 1].tolist() for s in seen], pa.list_(pa.float64()))], names=["j", "v"])

    found = [np.zeros(0)] * n
    for r in df.select("features").mapInArrow(run, "j int, v array<double>").collect():  # at most bins + 1 values a task and feature
        found[r.j] = np.unique(np.append(found[r.j], r.v))
    many = [j for j in range(n) if len(found[j]) > bins]
    values = {str(j): F.element_at("features.values", j + 1 if j < lay.first else j - n) for j in many}
    q = quantiles(df, values, [i / bins for i in range(1, bins)])
    return [np.unique(q[str(j)]) if len(v) > bins else (v[1:] + v[:-1]) / 2 for j, v in enumerate(found)]


def _sums(df: DataFrame, model: Boosted, tree: LevelTree, depth: int, seed: int, share: float) -> tuple[np.ndarray, ...]:
    """(node, place, bin, rows, sum of the fitted value) of every filled bin of the nodes of a level, over all drawn rows."""
    lay, k = model.lay, len(model.trees)
    places, low = np.array(lay.dense), 1 << depth

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nd, w = len(places), lay.width
        count, total = (np.zeros(low * nd * BINS) for _ in range(2))
        one, sums = (np.zeros(low * w) for _ in range(2))
        for b in batches:
            if not b.num_rows:
                continue
            rows, y = Rows.of(b.column(2), lay), np.asarray(b.column(1), dtype=float)
            g = y if not k else 2 * (y - model.predict(rows))
            node = tree.nodes(rows, lay) - low
            ok = (node >= 0) & (_taken(np.asarray(b.column(0)), seed, k, share) if share < 1 else True)
            binned = np.stack([np.searchsorted(e, rows.dense[:, j]) for j, e in enumerate(lay.edges)], axis=1)
            key = ((node[ok, None] * nd + np.arange(nd)) * BINS + binned[ok]).ravel()
            count += np.bincount(key, minlength=len(count))
            total += np.bincount(key, np.repeat(g[ok], nd), len(total))
            held = ok[rows.at]
            key = node[rows.at[held]] * w + rows.column[held]
            one += np.bincount(key, minlength=len(one))
            sums += np.bincount(key, g[rows.at[held]], len(sums))
        a, c = np.nonzero(count)[0], np.nonzero(one)[0]
        node, place, place_bin = np.append(a // BINS // nd, c // w), np.append(places[a // BINS % nd], c % w), np.append(a % BINS, np.full(len(c), -1))
        arrays = [node.astype(np.int32), place.astype(np.int32), place_bin.astype(np.int32), np.append(count[a], one[c]), np.append(total[a], sums[c])]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["node", "place", "bin", "n", "s"])

    part = df.select(F.col("row_id").cast("bigint"), F.col("label").cast("double"), "features").mapInArrow(run, "node int, place int, bin int, n double, s double")
    t = part.groupBy("node", "place", "bin").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).toArrow()  # as many rows as bins
    got = [np.asarray(c) for c in t.columns]
    order = np.lexsort(got[2::-1])
    return tuple(c[order] for c in got)


def fit(df: DataFrame, first: int, last: int, width: int, trees: int = 20, depth: int = 3, step: float = 0.1, share: float = 0.75, seed: int = 42) -> Boosted:
    """df: row_id, label and features (sparse rows of FeatureEncoder.transform_sparse). Every split that the bins allow is
    judged by the squared error it removes; of splits as good as each other the first in order of places and values counts."""
    lay = Layout(first, last, width)
    lay.edges = edges_of(df, lay)
    model = Boosted(lay, step)
    edges = dict(zip(lay.dense, lay.edges))
    for _ in range(trees):
        size = 2 << depth
        t = LevelTree(np.full(size, -1), np.zeros(size), np.zeros(size))
        for level in range(depth):
            node, place, at, n, s = _sums(df, model, t, level, seed, share)
            split = False
            for i in np.unique(node):
                own, heap = node == i, (1 << level) + int(i)
                p, b, c, g = place[own], at[own], n[own], s[own]
                ref = p == p[b >= 0][0] if (b >= 0).any() else None
                if ref is None:
                    raise ValueError("rows need a number or flag")
                all_n, all_s = c[ref].sum(), g[ref].sum()
                if level == 0:
                    t.value[heap] = all_s / all_n
                # left of a dense split: the bins up to it; left of a category: the rows without it
                start = np.append(True, p[1:] != p[:-1])
                base = np.nonzero(start)[0][np.cumsum(start) - 1]
                cn, cs = np.cumsum(c), np.cumsum(g)
                left_n = np.where(b >= 0, cn - cn[base] + c[base], all_n - c)
                left_s = np.where(b >= 0, cs - cs[base] + g[base], all_s - g)
                right_n = all_n - left_n
                fine = np.nonzero((left_n > 0.5) & (right_n > 0.5))[0]
                if not len(fine):
                    continue
                ln, ls, rn = left_n[fine], left_s[fine], right_n[fine]
                gain = ls**2 / ln + (all_s - ls) ** 2 / rn - all_s**2 / all_n
                if gain.max() <= 1e-12 * max(1.0, all_s**2 / all_n):
                    continue
                j = np.nonzero(gain >= gain.max() * (1 - 1e-9))[0][0]
                x = fine[j]
                t.feature[heap], t.threshold[heap] = p[x], edges[int(p[x])][b[x]] if b[x] >= 0 else 0.5
                t.value[2 * heap], t.value[2 * heap + 1] = ls[j] / ln[j], (all_s - ls[j]) / rn[j]
                split = True
            if not split:
                break
        model.trees.append(t)
    return model
