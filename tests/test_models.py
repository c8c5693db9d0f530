import numpy as np
import pandas as pd
import pytest

from spindrift import domain as D
from spindrift.models import estimators as E
from spindrift.models import matrix as M
from spindrift.models import shapley
from spindrift.models.trees import Columns, Growth, grow
from spindrift.plans.project import tsne

PARAMS = {
    "Gradient Boosting": D.LOCKED_PARAMS["Gradient Boosting"] | {"n_estimators": 80}, "XGBoost": D.LOCKED_PARAMS["XGBoost"] | {"n_estimators": 150, "reg_lambda": 5.0},
    "Random Forest": D.LOCKED_PARAMS["Random Forest"] | {"n_estimators": 30}, "Extra Trees": D.LOCKED_PARAMS["Extra Trees"] | {"n_estimators": 40},
    "AdaBoost": {"max_depth": 4, "min_samples_leaf": 3, "n_estimators": 40, "learning_rate": 0.1, "loss": "square"},
    "Bagging": {"max_depth": None, "min_samples_leaf": 2, "n_estimators": 20, "max_samples": 0.85, "max_features": 0.8}, "SVR": {"C": 30.0, "epsilon": 0.5, "gamma": "scale"},
}


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 10))
    x[:, 5:] = x[:, 5:] > 0.3
    return x, 50 + 10 * x[:, 0] + 6 * np.sin(2 * x[:, 1]) + 5 * x[:, 6] + rng.normal(size=400)


@pytest.mark.parametrize("family", list(PARAMS))
def test_families_learn(data, family):
    x, y = data
    m = E.fit(family, x[:300], y[:300], PARAMS[family])
    again = E.from_bytes(E.to_bytes(m))
    p = E.predict(again, x[300:])
    assert np.allclose(p, E.predict(m, x[300:]))
    assert 1 - ((y[300:] - p) ** 2).sum() / ((y[300:] - y[300:].mean()) ** 2).sum() > 0.6
    imp = E.importances(m, 10)
    assert (imp == 0).all() if family == "SVR" else imp.argmax() == 0 and abs(imp.sum() - 1) < 1e-9


def test_best_split_is_exact():
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 20, size=(60, 3)).astype(float), rng.normal(size=60)
    t = grow(Columns.of(x), y, np.ones(60), Growth(max_depth=1, min_leaf=5), rng)
    best = min((((y[l] - y[l].mean()) ** 2).sum() + ((y[~l] - y[~l].mean()) ** 2).sum(), j, c) for j in range(3) for c in np.unique(x[:, j])[:-1] for l in [x[:, j] <= c] if 5 <= l.sum() <= 55)
    l = t.leaves(x)
    got = sum(((y[l == k] - y[l == k].mean()) ** 2).sum() for k in np.unique(l))
    assert abs(got - best[0]) < 1e-9


def test_svr_optimality(data):
    x, y = data[0][:80], data[1][:80]
    p = {"C": 5.0, "epsilon": 0.3, "gamma": 0.1}
    m = E.fit("SVR", x, y, p)
    r = y - E.predict(m, x)
    assert abs(m["coef"].sum()) < 1e-6 and np.abs(m["coef"]).max() <= 5 + 1e-9
    inside = np.abs(r) < 0.3 - 1e-2
    assert not inside[[np.where((x == v).all(1))[0][0] for v in m["vectors"]]].any()  # rows inside the tube carry no weight


def test_shapley_is_exact(data):
    from itertools import combinations
    from math import factorial

    x, y = data
    m = E.fit("Gradient Boosting", x[:, :4], y, {"n_estimators": 4, "max_depth": 3, "learning_rate": 0.3})
    s = shapley.shap_values(m, x[:20, :4])
    assert np.allclose(s.sum(1) + shapley.base_value(m), E.predict(m, x[:20, :4]))

    def expect(row, known):
        def walk(t, i):
            f = t.feature[i]
            if f < 0:
                return t.value[i]
            if f in known:
                return walk(t, t.left[i] if row[f] <= t.threshold[i] else t.right[i])
            return (t.cover[t.left[i]] * walk(t, t.left[i]) + t.cover[t.right[i]] * walk(t, t.right[i])) / t.cover[i]

        return m["base"] + sum(k * walk(t, 0) for t, k in zip(E.trees_of(m), m["scale"]))

    for row, got in zip(x[:3, :4], s):
        for f in range(4):
            rest = [j for j in range(4) if j != f]
            want = sum(factorial(k) * factorial(3 - k) / 24 * (expect(row, {*c, f}) - expect(row, set(c))) for k in range(4) for c in combinations(rest, k))
            assert abs(want - got[f]) < 1e-9


def test_matrix():
    df = pd.DataFrame({"x": [1.0, np.nan, 10, 3, 2], "c": ["a", "a", "b", None, "a"], "b": [1, 0, np.nan, 1, 1]})
    s = M.fit_matrix(df, ["x"], ["c"], ["b"], 2, True)
    assert M.matrix_names(s) == ["num__x", "num__missingindicator_x", "cat__c_a", "cat__c_infrequent", "bin__b"]
    assert M.apply_matrix(M.loads(M.dumps(s)), df).shape == (5, 5)
    assert M.apply_matrix(s, df.iloc[:0]).shape == (0, 5)


def test_tsne_separates():
    rng = np.random.default_rng(0)
    lab = rng.integers(0, 4, 200)
    y = tsne(rng.normal(size=(4, 12))[lab] * 8 + rng.normal(size=(200, 12)), 20, 300)
    d = ((y[:, None] - y[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    assert np.isfinite(y).all() and (lab[d.argmin(1)] == lab).mean() > 0.97
    assert tsne(np.zeros((2, 3)), 5).shape == (2, 2) and np.isfinite(tsne(np.zeros((12, 3)), 5, 50)).all()


def test_encoding_time_does_not_grow_with_categories():
    import time

    rng = np.random.default_rng(3)
    df = pd.DataFrame({"c": [f"v{i}" for i in rng.integers(0, 4000, 40_000)]})
    s = M.fit_matrix(df, [], ["c"], [], 8)
    few = df.iloc[:5000]
    began = time.thread_time()
    x = M.apply_matrix(s, few)
    took = time.thread_time() - began
    often, rare = s["categorical"][0][1:]
    v = few["c"].to_numpy()
    assert len(rare) and all(np.array_equal(x[:, i], v == c) for i, c in enumerate(often[::50]) for i in [i * 50]) and np.array_equal(x[:, -1], np.isin(v, rare))
    began = time.thread_time()
    one_by_one = np.stack([*((v == c).astype(float) for c in often), np.isin(v, rare).astype(float)], axis=1)
    assert np.array_equal(x, one_by_one) and took < 0.5 * (time.thread_time() - began)


@pytest.mark.parametrize("depth", [0, 3, None])
def test_tree_predictions_are_the_leaves_values(data, depth):
    x, y = data
    t = grow(Columns.of(x), y, np.ones(len(y)), Growth(max_depth=depth), np.random.default_rng(0))
    z = np.where(np.random.default_rng(1).random(x.shape) < 0.1, np.nan, x)
    for rows in (x, z, np.asfortranarray(z), x[:0]):
        assert np.array_equal(t.predict(rows), t.value[t.leaves(rows)])


def _categories(n: int) -> tuple[M.Coded, np.ndarray]:
    rng = np.random.default_rng(5)
    num, flag = np.round(rng.normal(size=(n, 4)), 2), rng.random(n) < 0.3
    codes = np.stack([rng.integers(0, 60, n) + 4, rng.integers(0, 9, n) + 64]).astype(np.int32)
    slot = np.concatenate([np.arange(4), np.full(60, -1), np.full(9, -2), [4]]).astype(np.int32)
    y = 5 * num[:, 0] + 4 * np.sin(3 * num[:, 1]) + codes[0] % 7 + rng.normal(size=n)
    return M.Coded(np.asfortranarray(np.column_stack([num, flag])), slot, codes), y


@pytest.mark.parametrize("family", list(PARAMS))
def test_a_matrix_without_zeros_gives_the_same_models(family, monkeypatch):
    """On the JVM and without it, with levels that are counted by values and sorted ones."""
    from spindrift.models import trees

    monkeypatch.setattr(trees, "MANY_ROWS", 400)
    x, y = _categories(1500)
    dense, p = x.columns(np.arange(x.shape[1])), PARAMS[family] | ({"n_estimators": 4} if family != "SVR" else {})
    got, made = [], []
    for on in ("1", "0"):
        monkeypatch.setenv("SPINDRIFT_NATIVE", on)
        made += [E.fit(family, x, y, p), E.fit(family, dense, y, p)]
        got += [E.predict(made[-2], x), E.predict(made[-1], dense), E.fit_predict(family, x, y, p, 42, [x])[0]]
    assert np.allclose(got, got[0], rtol=0, atol=1e-6)
    if family != "SVR":
        assert all(np.array_equal(m[k], made[0][k]) for m in made for k in made[0])


def test_levels_counted_by_values_are_as_good_as_sorted_ones(monkeypatch):
    from spindrift.models import trees

    x, y = _categories(2000)
    out = []
    for rows in (100, 10**9):
        monkeypatch.setattr(trees, "MANY_ROWS", rows)
        monkeypatch.setenv("SPINDRIFT_NATIVE", "0")
        out.append(E.predict(E.fit("XGBoost", x, y, PARAMS["XGBoost"] | {"n_estimators": 10}), x))
    assert np.allclose(*out, rtol=0, atol=1e-9)


def test_svr_uses_all_rows(monkeypatch):
    """More rows than an SVR once saw; the same model with few kernel rows held as with all."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3200, 3))
    y = x[:, 0] + rng.normal(size=3200)
    p = {"C": 0.01, "epsilon": 1e-6, "gamma": 0.1}
    m = E.fit("SVR", x, y, p)
    assert len(m["vectors"]) > 3100 and m["gap"] <= 1e-3
    few, all_rows = [], [E.fit("SVR", x[:150], y[:150], {"C": 3.0, "epsilon": 0.1, "gamma": "scale"})]
    monkeypatch.setattr(E, "KERNEL_BYTES", 8 * 150 * 7)
    few = [E.fit("SVR", x[:150], y[:150], {"C": 3.0, "epsilon": 0.1, "gamma": "scale"})]
    assert np.allclose(E.predict(few[0], x), E.predict(all_rows[0], x), atol=1e-2) and few[0]["gap"] <= 1e-3
