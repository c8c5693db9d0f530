"""Exact path-dependent Shapley values of sums of trees.

A leaf's value reaches a row through the features on its path. For each leaf the Shapley weights depend
only on which of those features the row satisfies, at most 2^m patterns, so they are tabled once a leaf
and rows only look them up.
"""

from __future__ import annotations

from math import factorial

import numpy as np

from spindrift.models.estimators import trees_of
from spindrift.models.matrix import Coded
from spindrift.models.trees import Tree


def _paths(t: Tree):
    """(leaf, {feature: (low, high, share of cover)}) of every leaf; low < value <= high follows the path."""
    stack = [(0, {})]
    while stack:
        i, path = stack.pop()
        f = int(t.feature[i])
        if f < 0:
            yield i, path
            continue
        lo, hi, z = path.get(f, (-np.inf, np.inf, 1.0))
        for child, bounds in ((t.left[i], (lo, min(hi, t.threshold[i]))), (t.right[i], (max(lo, t.threshold[i]), hi))):
            share = t.cover[child] / t.cover[i] if t.cover[i] > 0 else 0.0
            stack.append((int(child), path | {f: (*bounds, z * share)}))


def _table(z: np.ndarray) -> np.ndarray:
    """(2^m, m): contribution, for a leaf value of 1, of each path feature under each pattern of satisfied ones."""
    m = len(z)
    out = np.zeros((1 << m, m))
    weight = [factorial(s) * factorial(m - s - 1) / factorial(m) for s in range(m)]
    for pattern in range(1 << m):
        one = [(pattern >> j) & 1 for j in range(m)]
        for i in range(m):
            poly = np.array([1.0])  # coefficient s: sum over subsets of size s of the others
            for j in range(m):
                if j != i:
                    poly = np.append(poly * z[j], 0.0) + np.append(0.0, poly * one[j])
            out[pattern, i] = (one[i] - z[i]) * float(np.dot(poly, weight))
    return out


def base_value(model: dict) -> float:
    """Expected prediction over the trees' own covers."""
    return float(model["base"] + sum(s * sum(t.value[i] * np.prod([z for *_, z in p.values()]) for i, p in _paths(t)) for t, s in zip(trees_of(model), model["scale"])))


def asked(model: dict) -> np.ndarray:
    """Columns that the trees ask for, in order; the Shapley values of all others are zero."""
    return np.unique(model["feature"][model["feature"] >= 0]).astype(np.int64)


def shap_values(model: dict, x: np.ndarray | Coded) -> np.ndarray:
    """(rows, features), or (rows, columns of asked()) of a Coded matrix: sums with base_value() to the prediction, row by row."""
    if model["kind"] != "sum":
        raise ValueError("Shapley values need a sum of trees")
    if isinstance(x, Coded):
        used = asked(model)
        own = np.where(model["feature"] >= 0, np.searchsorted(used, model["feature"]), -1).astype(np.int32)
        return shap_values(model | {"feature": own}, x.columns(used))
    out = np.zeros(x.shape)
    for t, s in zip(trees_of(model), model["scale"]):
        for leaf, path in _paths(t):
            if not path:
                continue
            feats = list(path)
            table = _table(np.array([path[f][2] for f in feats])) * (s * t.value[leaf])
            pattern = np.zeros(len(x), dtype=np.int64)
            for j, f in enumerate(feats):
                lo, hi, _ = path[f]
                pattern |= ((x[:, f] > lo) & (x[:, f] <= hi)).astype(np.int64) << j
            for j, f in enumerate(feats):
                out[:, f] += table[pattern, j]
    return out
