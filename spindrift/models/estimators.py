"""Model families fitted in single tasks: tree ensembles, boosting, AdaBoost.R2, SVR.

A fitted model is a dict of plain arrays and numbers, so it travels as .npz bytes (no pickle).
"""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterable, Iterator

import numpy as np

from spindrift.models import native
from spindrift.models.matrix import Coded
from spindrift.models.trees import Columns, Growth, Tree, grow

#: Bytes of kernel rows that an SVR fit holds: all rows if they are no more, else the last ones that it used.
KERNEL_BYTES = 128 << 20
#: Rows whose kernels an SVR holds at a time when it predicts, and support vectors that it meets at a time.
BLOCK, MET = 512, 16_384
#: Nodes of trees that fit_predict holds.
HELD_NODES = 500_000


def _pack(trees: list[Tree]) -> dict[str, np.ndarray]:
    out = {"offset": np.cumsum([0] + [len(t.feature) for t in trees]).astype(np.int64)}
    for name in ("feature", "threshold", "left", "right", "value", "cover"):
        out[name] = np.concatenate([getattr(t, name) for t in trees]) if trees else np.zeros(0)
    return out


def trees_of(model: dict) -> list[Tree]:
    o = model["offset"]
    names = ("feature", "threshold", "left", "right", "value", "cover")
    return [Tree(*(model[k][o[i] : o[i + 1]] for k in names)) for i in range(len(o) - 1)]


def to_bytes(model: dict) -> bytes:
    """As np.savez_compressed, at the quickest level."""
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z:
        for k, v in model.items():
            with z.open(f"{k}.npy", "w") as f:
                np.lib.format.write_array(f, np.asarray(v), allow_pickle=False)
    return buf.getvalue()


def from_bytes(data: bytes) -> dict:
    with np.load(io.BytesIO(data), allow_pickle=False) as z:
        return {k: (z[k] if z[k].ndim else z[k].item()) for k in z.files}


def kind_of(data: bytes) -> str:
    with np.load(io.BytesIO(data), allow_pickle=False) as z:
        return z["kind"].item()


def _growth(p: dict, **more) -> Growth:
    return Growth(max_depth=p.get("max_depth", 3), min_leaf=p.get("min_samples_leaf", 1), min_split=p.get("min_samples_split", 2), max_features=p.get("max_features", 1.0), **more)


def _fitted(t: Tree, x: np.ndarray) -> np.ndarray:
    values, t.fitted = t.fitted, None
    if values is not None:
        return values
    used = np.unique(t.feature[t.feature >= 0])
    return Tree(np.where(t.feature >= 0, np.searchsorted(used, t.feature), -1), t.threshold, t.left, t.right, t.value, t.cover).predict(Coded.of(x).columns(used))


def fit_boosting(x, y, p, seed) -> dict:
    """Squared-error boosting from the mean; every tree sees a fresh subsample."""
    rng = np.random.default_rng(seed)
    data, base, trees = Columns.of(x), float(y.mean()), []
    f = np.full(len(y), base)
    g, take = _growth(p), max(1, int(p.get("subsample", 1.0) * len(y)))
    for _ in range(p["n_estimators"]):
        w = np.zeros(len(y))
        w[rng.permutation(len(y))[:take]] = 1.0
        t = grow(data, y - f, w, g, rng)
        f += p["learning_rate"] * _fitted(t, x)
        trees.append(t)
    return _pack(trees) | {"kind": "sum", "base": base, "scale": np.full(len(trees), p["learning_rate"])}


def fit_second_order(x, y, p, seed) -> dict:
    """Regularised second-order boosting: l1, l2, minimal gain and child weight, column subsample a tree."""
    rng = np.random.default_rng(seed)
    base, trees, f = float(y.mean()), [], np.full(len(y), float(y.mean()))
    data = Columns.of(x)
    # the gain of the second-order objective is half the score difference
    g = Growth(p["max_depth"], 1, 2, 1.0, p.get("reg_alpha", 0.0), p.get("reg_lambda", 1.0), 2 * p.get("gamma", 0.0), p.get("min_child_weight", 1.0))
    cols = max(1, int(p.get("colsample_bytree", 1.0) * x.shape[1]))
    for _ in range(p["n_estimators"]):
        use = np.sort(rng.permutation(x.shape[1])[:cols])
        w = (rng.random(len(y)) < p.get("subsample", 1.0)).astype(float)
        t = grow(data, y - f, w, g, rng, use)
        f += p["learning_rate"] * _fitted(t, x)
        trees.append(t)
    return _pack(trees) | {"kind": "sum", "base": base, "scale": np.full(len(trees), p["learning_rate"])}


def forest_trees(x, y, p, seed, random_cuts=False) -> Iterator[Tree]:
    rng = np.random.default_rng(seed)
    data = Columns.of(x)
    g = _growth(p, random_cuts=random_cuts)
    for _ in range(p["n_estimators"]):
        w = np.bincount(rng.integers(0, len(y), len(y)), minlength=len(y)).astype(float) if p.get("bootstrap", True) else np.ones(len(y))
        yield grow(data, y, w, g, rng, fitted=False)


def _mean(trees: list[Tree], n: int) -> dict:
    return _pack(trees) | {"kind": "sum", "base": 0.0, "scale": np.full(len(trees), 1.0 / n)}


def fit_forest(x, y, p, seed, random_cuts=False) -> dict:
    """Random forest (bootstrap, features drawn at each node) or extra trees (random cuts)."""
    return _mean(list(forest_trees(x, y, p, seed, random_cuts)), p["n_estimators"])


def fit_bagging(x, y, p, seed) -> dict:
    """Bagged trees: rows with replacement, features without, both drawn for each tree."""
    return _mean(list(bagged_trees(x, y, p, seed)), p["n_estimators"])


def bagged_trees(x, y, p, seed) -> Iterator[Tree]:
    rng = np.random.default_rng(seed)
    data = Columns.of(x)
    rows, cols = max(1, int(p.get("max_samples", 1.0) * len(y))), max(1, int(p.get("max_features", 1.0) * x.shape[1]))
    g = _growth({k: v for k, v in p.items() if k != "max_features"})
    for _ in range(p["n_estimators"]):
        use = np.sort(rng.permutation(x.shape[1])[:cols])
        w = np.bincount(rng.integers(0, len(y), rows), minlength=len(y)).astype(float)
        yield grow(data, y, w, g, rng, use, fitted=False)


def fit_adaboost(x, y, p, seed) -> dict:
    """AdaBoost.R2: weighted resampling, losses relative to the largest, weighted median of the trees."""
    rng = np.random.default_rng(seed)
    data, w, trees, scale = Columns.of(x), np.full(len(y), 1.0 / len(y)), [], []
    g = _growth(p)
    for _ in range(p["n_estimators"]):
        t = grow(data, y, np.bincount(rng.choice(len(y), len(y), p=w), minlength=len(y)).astype(float), g, rng)
        err = np.abs(_fitted(t, x) - y)
        worst = err.max()
        if worst <= 0:
            trees.append(t)
            scale.append(1.0)
            break
        loss = err / worst
        loss = loss**2 if p["loss"] == "square" else 1 - np.exp(-loss) if p["loss"] == "exponential" else loss
        mean = float((w * loss).sum())
        if mean >= 0.5:
            if not trees:
                trees.append(t)
                scale.append(1.0)
            break
        beta = mean / (1 - mean)
        trees.append(t)
        scale.append(p["learning_rate"] * np.log(1 / beta))
        w = w * beta ** ((1 - loss) * p["learning_rate"])
        w /= w.sum()
    return _pack(trees) | {"kind": "median", "base": 0.0, "scale": np.array(scale)}


def _rbf(a, b, gamma):
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :]
    d -= 2 * a @ b.T
    np.maximum(d, 0.0, out=d)
    d *= -gamma
    return np.exp(d, out=d)


def _near(a: Coded, b: Coded) -> np.ndarray:
    """Squared distances of all rows of a to all rows of b."""
    d = ((a.dense * a.dense).sum(1) + (a.codes >= 0).sum(0))[:, None] + ((b.dense * b.dense).sum(1) + (b.codes >= 0).sum(0))[None, :]
    d -= 2 * a.dense @ b.dense.T
    for p, q in zip(a.codes, b.codes):
        d -= 2.0 * ((p[:, None] == q[None, :]) & (p >= 0)[:, None])
    return np.maximum(d, 0.0, out=d)


class KernelRows:
    """Rows of the kernel matrix of an SVR fit, made when they are asked for; the last ones asked for are held."""

    def __init__(self, x: Coded, gamma: float, room: int):
        self.x, self.gamma, self.most, self.held = x, gamma, max(2, room // (8 * len(x))), {}
        self.size = (x.dense * x.dense).sum(1) + (x.codes >= 0).sum(0)

    def __getitem__(self, i: int) -> np.ndarray:
        if (row := self.held.pop(i, None)) is None:
            x = self.x
            d = self.size + self.size[i] - 2 * (x.dense @ x.dense[i])
            for c in x.codes:
                if c[i] >= 0:
                    d[c == c[i]] -= 2.0
            np.maximum(d, 0.0, out=d)
            d[i] = 0.0
            d *= -self.gamma
            row = np.exp(d, out=d)
            if len(self.held) >= self.most:
                del self.held[next(iter(self.held))]
        self.held[i] = row  # the last one in the order
        return row


def fit_svr(x, y, p, seed, tol=1e-3, most_steps=None) -> dict:
    """Epsilon-insensitive regression with an RBF kernel, on all rows. The dual, in one signed coefficient a row that sum
    to zero, is lowered along the pair that violates optimality most, until none does by more than tol; the model
    holds the violation left as gap. Of the kernel matrix at most KERNEL_BYTES are held. most_steps: the default grows with the rows."""
    whole = isinstance(x, np.ndarray)
    x = Coded.of(x)
    most_steps = most_steps or max(1_000_000, 100 * len(y))
    gamma = p["gamma"]
    if gamma == "scale":
        gamma = 1.0 / (x.shape[1] * max(x.var(), 1e-12))
    elif gamma == "auto":
        gamma = 1.0 / x.shape[1]
    c, eps = p["C"], p["epsilon"]
    gap = 0.0
    b, g = np.zeros(len(y)), -y.astype(float)  # coefficients and gradient of the smooth part
    up = down = np.zeros(0)
    if 8 * len(y) ** 2 <= min(native.KERNEL, KERNEL_BYTES):
        k = _near(x, x)
        k *= -gamma
        np.exp(k, out=k)
        if (done := native.svr(k, c, eps, tol, most_steps, b, g)) is not None:
            b, gap, up, down = done[0], done[1], np.array(done[2]), np.array(done[3])
            most_steps = 0
    else:
        k = KernelRows(x, gamma, KERNEL_BYTES)
    for _ in range(most_steps):
        up = np.where(b < c, g + np.where(b >= 0, eps, -eps), np.inf)
        down = np.where(b > -c, g + np.where(b > 0, eps, -eps), -np.inf)
        i, j = int(up.argmin()), int(down.argmax())
        gap = down[j] - up[i]
        if gap <= tol:
            break
        ki, kj = k[i], k[j]
        t = min(gap / max(ki[i] + kj[j] - 2 * ki[j], 1e-12), c - b[i], b[j] + c)
        if b[i] < 0:
            t = min(t, -b[i])
        if b[j] > 0:
            t = min(t, b[j])
        b[i] += t
        b[j] -= t
        g += t * (ki - kj)
    sv = np.nonzero(np.abs(b) > 1e-12)[0]
    v = x[sv]
    return {"kind": "kernel", "base": float(-(up.min() + down.max()) / 2), "gamma": float(gamma), "gap": float(gap), "vectors": v.dense, "coef": b[sv]} | ({} if whole else {"slot": v.slot, "codes": v.codes})


def vectors_of(model: dict) -> Coded:
    return Coded(model["vectors"], model["slot"], model["codes"]) if "codes" in model else Coded.of(model["vectors"])


def fit(family: str, x: np.ndarray, y: np.ndarray, p: dict, seed: int = 42) -> dict:
    if family == "Gradient Boosting":
        return fit_boosting(x, y, p, seed)
    if family == "XGBoost":
        return fit_second_order(x, y, p, seed)
    if family == "Random Forest":
        return fit_forest(x, y, p, seed)
    if family == "Extra Trees":
        return fit_forest(x, y, p, seed, random_cuts=True)
    if family == "Bagging":
        return fit_bagging(x, y, p, seed)
    if family == "AdaBoost":
        return fit_adaboost(x, y, p, seed)
    if family == "SVR":
        return fit_svr(x, y, p, seed)
    raise ValueError(f"unknown family {family}")


def fit_predict(family: str, x: np.ndarray | Coded, y: np.ndarray, p: dict, seed: int, others: list) -> list[np.ndarray]:
    """Predictions of the fitted model for each of the others. Of trees that are fitted apart from each other only some are held at a
    time: no more than HELD_NODES nodes, and those of one more tree."""
    made = {"Random Forest": forest_trees, "Extra Trees": lambda *a: forest_trees(*a, random_cuts=True), "Bagging": bagged_trees}.get(family)
    if made is None:
        m = fit(family, x, y, p, seed)
        return [predict(m, z) for z in others]
    out, held, size = [np.zeros(len(z)) for z in others], [], 0
    trees = made(x, y, p, seed)
    while True:
        t = next(trees, None)
        if held and (t is None or size > HELD_NODES):
            m = _mean(held, p["n_estimators"])
            for o, z in zip(out, others):
                o += predict(m, z)
            held, size = [], 0
        if t is None:
            return out
        held.append(t)
        size += len(t.feature)


def predict(model: dict, x: np.ndarray | Coded) -> np.ndarray:
    if model["kind"] == "kernel":
        if isinstance(x, Coded) or "codes" in model:
            return Kernels([model]).predict(x)[:, 0]
        parts = [_rbf(x[b : b + BLOCK], model["vectors"], model["gamma"]) @ model["coef"] for b in range(0, len(x), BLOCK)]
        return np.concatenate([np.zeros(0), *parts]) + model["base"]
    if isinstance(x, Coded):  # only the columns that the trees ask for are filled in, for so many rows at a time as there is room
        used = np.unique(model["feature"][model["feature"] >= 0])
        model = model | {"feature": np.where(model["feature"] >= 0, np.searchsorted(used, model["feature"]), -1).astype(np.int32)}
        step = max(256, min(native.BLOCK, native.BLOCK_BYTES // (8 * max(1, len(used)))))
        return np.concatenate([np.zeros(0), *(predict(model, x[at : at + step].columns(used)) for at in range(0, len(x), step))])
    if (done := native.predict(model, x)) is not None:
        return done
    trees, scale, x = trees_of(model), model["scale"], np.asfortranarray(x)
    if model["kind"] == "median":
        p = np.stack([t.predict(x) for t in trees], axis=1)
        order = p.argsort(1, kind="stable")
        cum = scale[order].cumsum(1)
        pick = (cum >= 0.5 * cum[:, -1:]).argmax(1)
        return p[np.arange(len(x)), order[np.arange(len(x)), pick]]
    out = np.full(len(x), float(model["base"]))
    for t, s in zip(trees, scale):
        out += s * t.predict(x)
    return out


class Kernels:
    """SVR models of one encoding: the distances to the vectors of all of them are taken once, the kernels once a gamma."""

    def __init__(self, models: Iterable[dict]):
        place: dict[bytes, int] = {}
        held, parts = [], []  # of each model, without its vectors; the vectors that no earlier one has
        for m in models:
            v = vectors_of(m)
            own, new = np.empty(len(v), np.int64), []
            for i, key in enumerate(a.tobytes() + c.tobytes() for a, c in zip(np.ascontiguousarray(v.dense), np.ascontiguousarray(v.codes.T))):
                if key not in place:
                    place[key] = len(place)
                    new.append(i)
                own[i] = place[key]
            held.append((m["gamma"], m["base"], m["coef"], own))
            if new or not parts:
                parts.append(v[np.array(new, np.int64)])
        self.base, self.of = np.array([base for _, base, _, _ in held]), {}
        self.vectors = Coded(np.concatenate([v.dense for v in parts]), parts[0].slot, np.concatenate([v.codes for v in parts], axis=1)) if parts else None
        for gamma in sorted({g for g, *_ in held}):
            own = [i for i, (g, *_) in enumerate(held) if g == gamma]
            coef = np.zeros((len(place), len(own)))
            for j, i in enumerate(own):
                np.add.at(coef[:, j], held[i][3], held[i][2])  # repeated rows are one vector
            self.of[gamma] = own, coef

    def predict(self, x: np.ndarray | Coded, block: int = BLOCK) -> np.ndarray:
        """(rows, models)"""
        x, out = Coded.of(x), np.zeros((len(x), len(self.base)))
        for b in range(0, len(x), block):
            rows = x[b : b + block]
            for v in range(0, len(self.vectors), MET):
                d = _near(rows, self.vectors[v : v + MET])
                k = np.empty_like(d)
                for gamma, (own, coef) in self.of.items():
                    np.multiply(d, -gamma, out=k)
                    out[b : b + block, own] += np.exp(k, out=k) @ coef[v : v + MET]
        return out + self.base


def importances(model: dict, n_features: int) -> np.ndarray:
    """Share of the impurity that each feature's splits remove; zeros for models without trees."""
    out = np.zeros(n_features)
    if model["kind"] == "kernel":
        return out
    for t in trees_of(model):
        own, inner = np.zeros(n_features), np.nonzero(t.feature >= 0)[0]
        for i in inner:
            a, b = t.left[i], t.right[i]
            own[t.feature[i]] += t.cover[a] * (t.value[a] - t.value[i]) ** 2 + t.cover[b] * (t.value[b] - t.value[i]) ** 2
        if own.sum() > 0:
            out += own / own.sum()
    return out / out.sum() if out.sum() > 0 else out


def params_text(p: dict) -> str:
    return json.dumps(p, sort_keys=True)
