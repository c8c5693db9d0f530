"""Regression trees grown level by level with an exact, vectorised split search.

Used inside single tasks. Columns of many values
are sorted once; a level sorts those orders stably by open node, so that each node's values lie in order and every
split point is one running sum. Levels of many rows and few values (`counted`) add up the rows of each value of each node instead, which
gives the same split points, as every value has a place of its own. Columns of two values (encoded categories) are only counted where they
hold the larger one. The work of a level thus follows the rows, not the nodes or the values. models.native grows the same
trees, sum by sum, on a JVM where there is one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from spindrift.models import native
from spindrift.models.matrix import Coded

#: Most nodes of a tree that is evaluated for all rows at once.
SMALL = 63
#: Fewest rows of a level that is counted by values.
MANY_ROWS = 8192


@dataclass
class Columns:
    """A matrix prepared for growing trees."""

    x: Coded
    many: np.ndarray  # numbers of the columns of more than two values
    order: np.ndarray  # rows in the order of each of them
    two: np.ndarray  # numbers of the columns of two values
    ends: np.ndarray  # (2, len(two)): the values
    hot: tuple[np.ndarray, np.ndarray]  # (row, place in two) wherever they hold the larger one
    values: list[np.ndarray]  # of each column of more than two values, in order
    place: list[np.ndarray]  # of each of these columns: the place of each row's value among them

    @classmethod
    def of(cls, x: np.ndarray | Coded) -> "Columns":
        x = Coded.of(x)
        d, n = x.dense, len(x)
        lo, hi = (d.min(0), d.max(0)) if n else (np.zeros(d.shape[1]), np.zeros(d.shape[1]))
        pair = np.array([bool(((v == a) | (v == b)).all()) and a < b for v, a, b in zip(d.T, lo, hi)], bool)
        number = np.empty(d.shape[1], np.int64)
        number[x.slot[x.slot >= 0]] = np.nonzero(x.slot >= 0)[0]
        own, flags = np.nonzero((lo < hi) & ~pair)[0], np.nonzero(pair)[0]
        held = np.bincount(x.codes[x.codes >= 0], minlength=x.shape[1])
        two = np.sort(np.append(number[flags], np.nonzero((held > 0) & (held < n))[0])).astype(np.int64)
        ends = np.stack([np.zeros(len(two)), np.ones(len(two))])
        at = np.searchsorted(two, number[flags])
        ends[0, at], ends[1, at] = lo[flags], hi[flags]
        to = np.full(x.shape[1] + 1, -1, np.int32)  # the last one is that of code -1
        to[two] = np.arange(len(two))
        hot = np.stack([*(np.where(d[:, f] == hi[f], to[number[f]], -1).astype(np.int32) for f in flags), *(to[c] for c in x.codes)], axis=1) if len(flags) + len(x.codes) else np.zeros((n, 0), np.int32)
        row, col = np.nonzero(hot >= 0)
        values, place, order = [], [], np.empty((len(own), n), np.int32)
        for i, f in enumerate(own):
            order[i] = np.argsort(d[:, f], kind="stable")
            v = d[order[i], f]
            new = np.append(True, v[1:] != v[:-1])
            values.append(v[new])
            place.append(np.empty(n, np.uint16 if new.sum() <= 1 << 16 else np.int32))
            place[i][order[i]] = np.cumsum(new) - 1
        return cls(x, number[own], order, two, ends, (row.astype(np.int32), hot[row, col]), values, place)


def counted(rows: int, nodes: int, values: int, columns: int) -> bool:
    """Whether a level adds up its rows by values."""
    return rows >= MANY_ROWS and 2 * nodes * values <= rows * columns


@dataclass
class Tree:
    feature: np.ndarray  # -1 at leaves
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    fitted: np.ndarray | None = None  # values of the rows that it was grown on, if at hand

    def leaves(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), dtype=np.int32)
        rows = np.arange(len(x))
        while len(rows):
            a = at[rows]
            f = self.feature[a]
            inner = f >= 0
            if not inner.all():
                rows, a, f = rows[inner], a[inner], f[inner]
            at[rows] = np.where(x[rows, f] <= self.threshold[a], self.left[a], self.right[a])
        return at

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Small trees choose between the values below each node for all rows at once, from the last node up (children are
        numbered after their parents); large ones deal their rows out node by node. Columns of x lie in one piece
        for speed (order F)."""
        if len(self.feature) <= SMALL:
            below: list = list(self.value)
            for i in range(len(self.feature) - 1, -1, -1):
                if self.feature[i] >= 0:
                    below[i] = np.where(x[:, self.feature[i]] <= self.threshold[i], below[self.left[i]], below[self.right[i]])
            return below[0] if isinstance(below[0], np.ndarray) else np.full(len(x), self.value[0])
        out, stack = np.empty(len(x)), [(0, np.arange(len(x)))]
        feature, threshold, left, right = self.feature.tolist(), self.threshold.tolist(), self.left.tolist(), self.right.tolist()
        while stack:
            i, rows = stack.pop()
            if feature[i] < 0:
                out[rows] = self.value[i]
                continue
            low = x[:, feature[i]][rows] <= threshold[i]
            for child, own in ((left[i], rows[low]), (right[i], rows[~low])):
                if len(own):
                    stack.append((child, own))
        return out


@dataclass
class Growth:
    max_depth: int | None = 3
    min_leaf: int = 1
    min_split: int = 2
    max_features: float = 1.0  # share of features tried at each node
    l1: float = 0.0
    l2: float = 0.0
    min_gain: float = 0.0
    min_weight: float = 0.0
    random_cuts: bool = False  # one random cut a feature instead of the best


def grow(data: Columns, target: np.ndarray, weight: np.ndarray, p: Growth, rng: np.random.Generator, use: np.ndarray | None = None, fitted: bool = True) -> Tree:
    """Tree that fits the weighted mean of target on the columns `use` (default all); rows with weight 0 are left out.
    With l1, l2, min_gain and min_weight it is the second-order step of regularised boosting (unit hessian)."""
    keep = weight > 0
    g, h = np.where(keep, target * weight, 0.0), weight.astype(float)
    allowed = np.zeros(data.x.shape[1], bool)
    allowed[slice(None) if use is None else use] = True
    on_many, on_two = np.nonzero(allowed[data.many])[0], allowed[data.two]
    n_cols = int(allowed.sum())
    k = max(1, int(p.max_features * n_cols + 1e-9))
    least, enough = max(1, p.min_leaf), max(p.min_split, 2 * max(1, p.min_leaf))
    floor = max(p.min_gain, 1e-12 * float(g @ g) + 1e-12)
    if (made := native.grow(data, g, h, allowed, p, least, enough, k, n_cols, floor, rng, fitted)) is not None:
        return Tree(*made[:6], made[6] if fitted else None)
    many, n_many, n_two = data.many[on_many], len(on_many), len(data.two)
    row = col = None  # made for the first level that is not counted
    values = [data.values[c] for c in on_many]
    n_values = sum(map(len, values))
    hot_row, hot_col = data.hot
    take = keep[hot_row] & on_two[hot_col]
    hot_row, hot_col = hot_row[take], hot_col[take]
    soft = (lambda s: np.sign(s) * np.maximum(np.abs(s) - p.l1, 0.0)) if p.l1 else (lambda s: s)
    score = lambda s, w: soft(s) ** 2 / np.maximum(w + p.l2, 1e-300)
    value_of = lambda s, w: soft(s) / np.maximum(w + p.l2, 1e-300)
    gt, ht, ct = np.array([g.sum()]), np.array([h.sum()]), np.array([keep.sum()])
    parts = {"feature": [np.array([-1])], "threshold": [np.zeros(1)], "left": [np.array([-1])], "right": [np.array([-1])], "value": [value_of(gt, ht)], "cover": [ht]}
    size, depth = 1, 0
    node = np.where(keep, 0, -1) if ct[0] >= enough else np.full(len(keep), -1)
    opened = np.array([0]) if ct[0] >= enough else np.zeros(0, np.int64)  # numbers of the open nodes
    splits: list[tuple] = []
    while len(opened) and n_many + n_two and (p.max_depth is None or depth < p.max_depth):
        m = len(opened)
        by_value = not p.random_cuts and counted(int(ct.sum()), m, n_values, n_many)
        if not by_value:
            if row is None:
                row, col = data.order[on_many].ravel(), np.repeat(np.arange(n_many, dtype=np.int32), data.x.shape[0])
            a = node[row]
            if (a < 0).any():
                row, col, a = row[a >= 0], col[a >= 0], a[a >= 0]
        chosen = None
        if k < n_cols:
            chosen = np.zeros((m, data.x.shape[1]), bool)
            drawn = np.argpartition(rng.random((m, n_cols)), k - 1, axis=1)[:, :k]
            chosen[np.arange(m)[:, None], np.nonzero(allowed)[0][drawn]] = True
        gain, feature, cut = np.full(m, -np.inf), np.full(m, -1), np.zeros(m)
        gl, hl, cl = np.zeros(m), np.zeros(m), np.zeros(m, np.int64)
        if n_many and by_value:
            at = np.nonzero(node >= 0)[0]
            for c in range(n_many):
                v, asked = values[c], np.arange(m) if chosen is None else np.nonzero(chosen[:, many[c]])[0]
                key = node[at] * len(v) + data.place[on_many[c]][at]
                tg, th, tc = (np.bincount(key, w, m * len(v)).reshape(m, -1)[asked] for w in (g[at], h[at], None))
                there = tc > 0
                tg, th, tc = tg.cumsum(1), th.cumsum(1), tc.cumsum(1)
                all_g, all_h, all_c = gt[asked, None], ht[asked, None], ct[asked, None]
                ok = there & (tc < all_c) & (tc >= least) & (all_c - tc >= least)
                if p.min_weight:
                    ok &= (th >= p.min_weight) & (all_h - th >= p.min_weight)
                won = np.where(ok, score(tg, th) + score(all_g - tg, all_h - th) - score(all_g, all_h), -np.inf)
                j = won.argmax(1)
                i = np.arange(len(asked))
                better = won[i, j] > gain[asked]
                for one, k1, k2 in zip(asked[better], i[better], j[better]):
                    after = k2 + 1 + there[k1, k2 + 1 :].argmax()  # the next value in the node
                    gain[one], feature[one], cut[one] = won[k1, k2], many[c], (v[k2] + v[after]) / 2
                    gl[one], hl[one], cl[one] = tg[k1, k2], th[k1, k2], tc[k1, k2]
        elif n_many:
            r, key = row, col.astype(np.int64) * m + a
            if chosen is not None:
                in_it = chosen[:, many][a, col]
                r, key = r[in_it], key[in_it]
            if len(r):
                o = np.argsort(key.astype(np.int16 if n_many * m < 32_000 else np.int32), kind="stable")
                r, key = r[o], key[o]
                v = data.x.at(r, many[key // m])
                new = np.empty(len(r), bool)
                new[0], new[1:] = True, key[1:] != key[:-1]
                starts, seg = np.nonzero(new)[0], np.cumsum(new) - 1
                gs, hs = np.concatenate([[0.0], np.cumsum(g[r])]), np.concatenate([[0.0], np.cumsum(h[r])])
                if p.random_cuts:
                    last = np.append(starts[1:], len(r)) - 1
                    lo, hi = v[starts], v[last]
                    at = lo + (hi - lo) * rng.random(len(starts))
                    t = starts + np.add.reduceat(v <= at[seg], starts) - 1
                    fine = (hi > lo) & (t < last)
                    t, where = t[fine], at[fine]
                else:
                    t = np.nonzero(~new[1:] & (v[1:] > v[:-1]))[0]
                    where = (v[t] + v[t + 1]) / 2
                s = seg[t]
                b = key[starts[s]] % m
                tg, th, tc = gs[t + 1] - gs[starts[s]], hs[t + 1] - hs[starts[s]], t + 1 - starts[s]
                ok = (tc >= least) & (ct[b] - tc >= least)
                if p.min_weight:
                    ok &= (th >= p.min_weight) & (ht[b] - th >= p.min_weight)
                if ok.any():
                    s, b, tg, th, tc, where = s[ok], b[ok], tg[ok], th[ok], tc[ok], where[ok]
                    won = score(tg, th) + score(gt[b] - tg, ht[b] - th) - score(gt, ht)[b]
                    best = np.full(m, -np.inf)
                    np.maximum.at(best, b, won)
                    top = np.nonzero(won == best[b])[0]
                    nodes, first = np.unique(b[top], return_index=True)
                    top = top[first]
                    gain[nodes], feature[nodes], cut[nodes] = won[top], many[key[starts[s[top]]] // m], where[top]
                    gl[nodes], hl[nodes], cl[nodes] = tg[top], th[top], tc[top]
        if n_two:
            a2 = node[hot_row]
            if (a2 < 0).any():
                hot_row, hot_col, a2 = hot_row[a2 >= 0], hot_col[a2 >= 0], a2[a2 >= 0]
            idx = a2 * n_two + hot_col
            rg, rh, rc = (np.bincount(idx, w, m * n_two).reshape(m, n_two) for w in (g[hot_row], h[hot_row], None))
            ok = (rc >= least) & (ct[:, None] - rc >= least) & on_two
            if p.min_weight:
                ok &= (rh >= p.min_weight) & (ht[:, None] - rh >= p.min_weight)
            if chosen is not None:
                ok &= chosen[:, data.two]
            won = np.where(ok, score(rg, rh) + score(gt[:, None] - rg, ht[:, None] - rh) - score(gt, ht)[:, None], -np.inf)
            j = won.argmax(1)
            i = np.arange(m)
            better = won[i, j] > gain
            gain = np.where(better, won[i, j], gain)
            feature = np.where(better, data.two[j], feature)
            low, high = data.ends[:, j]
            cut = np.where(better, low + (high - low) * (rng.random(m) if p.random_cuts else 0.5), cut)
            gl, hl, cl = np.where(better, gt - rg[i, j], gl), np.where(better, ht - rh[i, j], hl), np.where(better, ct - rc[i, j], cl)
        good = np.nonzero(gain > floor)[0]
        if not len(good):
            break
        w = len(good)
        splits.append((opened[good], feature[good], cut[good], size + np.arange(w), size + w + np.arange(w)))
        ng, nh, nc = (np.concatenate([x[good], y[good] - x[good]]) for x, y in ((gl, gt), (hl, ht), (cl, ct)))
        for name, v in (("feature", np.full(2 * w, -1)), ("threshold", np.zeros(2 * w)), ("left", np.full(2 * w, -1)), ("right", np.full(2 * w, -1)), ("value", value_of(ng, nh)), ("cover", nh)):
            parts[name].append(v)
        going = np.nonzero(nc >= enough)[0]
        number = np.full(2 * w, -1)
        number[going] = np.arange(len(going))
        child = np.full((2, m), -1)
        child[0, good], child[1, good] = number[:w], number[w:]
        at = np.nonzero(node >= 0)[0]
        a = node[at]
        node[at] = child[(data.x.at(at, feature[a]) > cut[a]).astype(int), a]
        opened, gt, ht, ct = size + going, ng[going], nh[going], nc[going]
        size, depth = size + 2 * w, depth + 1
    t = Tree(*(np.concatenate(parts[c]).astype(k) for c, k in (("feature", np.int32), ("threshold", float), ("left", np.int32), ("right", np.int32), ("value", float), ("cover", float))))
    for i, f, c, left, right in splits:
        t.feature[i], t.threshold[i], t.left[i], t.right[i] = f, c, left, right
    return t
