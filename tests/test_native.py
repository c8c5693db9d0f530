import numpy as np
import pytest

from spindrift.models import estimators as E
from spindrift.models import native
from tests.test_models import PARAMS, data  # noqa: F401


@pytest.fixture
def numpy_only(monkeypatch):
    def off(on: bool) -> None:
        monkeypatch.setenv("SPINDRIFT_NATIVE", "0" if on else "1")

    return off


@pytest.mark.parametrize("family", list(PARAMS))
def test_the_jvm_makes_the_same_models(data, numpy_only, family):  # noqa: F811
    x, y = data
    numpy_only(False)
    assert native.loops() is not None
    p = PARAMS[family] | ({"n_estimators": 15} if "n_estimators" in PARAMS[family] else {})
    m = E.fit(family, x[:300], y[:300], p)
    got = E.predict(m, x)
    numpy_only(True)
    assert native.loops() is None
    n = E.fit(family, x[:300], y[:300], p)
    assert m.keys() == n.keys() and all(np.array_equal(m[k], n[k]) for k in m)
    assert np.array_equal(got, E.predict(n, x))


def test_svr_models_share_distances(data):  # noqa: F811
    x, y = data
    models = [E.fit("SVR", x[:200], y[:200], {"C": c, "epsilon": e, "gamma": g}) for c, e, g in ((3.0, 0.5, 0.1), (30.0, 5.0, 0.1), (3.0, 2.0, "scale"), (1.0, 1e6, "auto"))]
    assert len(models[3]["vectors"]) == 0  # no vectors: the base alone
    got = E.Kernels(models).predict(x, 64)
    assert np.allclose(got, np.stack([E.predict(m, x) for m in models], axis=1), rtol=0, atol=1e-9)
    assert E.Kernels(models[3:]).predict(x[:3]).shape == (3, 1) and E.kind_of(E.to_bytes(models[0])) == "kernel"


def test_many_trees_take_a_small_part_of_the_time(data, numpy_only):  # noqa: F811
    import time

    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(2500, 15)), rng.random((2500, 60)) < 0.05], axis=1)
    y, took = x[:, 0] + x[:, 20] + rng.normal(size=2500), {}
    for off in (False, True):
        numpy_only(off)
        for _ in range(2):  # the second time code is compiled
            began = time.perf_counter()
            E.predict(E.fit("Bagging", x, y, PARAMS["Bagging"] | {"n_estimators": 30}), x)
            took[off] = time.perf_counter() - began
    assert took[False] < 0.7 * took[True]


def test_without_the_jvm_numpy_goes_on(data):  # noqa: F811
    x, y = data
    want = E.predict(E.fit("AdaBoost", x, y, PARAMS["AdaBoost"]), x)
    native.loops().jvm.kill()
    native.loops().jvm.wait()
    assert np.array_equal(want, E.predict(E.fit("AdaBoost", x, y, PARAMS["AdaBoost"]), x)) and native.loops() is not None


def test_places_of_values_lead_to_the_same_leaves(data, numpy_only):  # noqa: F811
    """Deep trees; rows at thresholds, beyond all values, minus zero, constant columns, more rows than one evaluation takes."""
    x, y = data
    numpy_only(False)
    m = E.fit("Bagging", x[:300], y[:300], PARAMS["Bagging"] | {"n_estimators": 12, "max_depth": None, "min_samples_leaf": 1})
    inner = m["feature"] >= 0
    at = x[np.arange(inner.sum()) % len(x)].copy()
    at[np.arange(inner.sum()), m["feature"][inner]] = m["threshold"][inner]
    rows = np.concatenate([at, x, x * 1e9, -x, np.full((3, x.shape[1]), -0.0)])
    many = np.tile(rows, (native.BLOCK // len(rows) + 2, 1))
    got, all_rows, alone = E.predict(m, rows), E.predict(m, many), E.predict(m, rows[:1])
    numpy_only(True)
    want = E.predict(m, rows)
    assert np.array_equal(got, want) and np.array_equal(alone, want[:1])
    assert np.array_equal(all_rows, np.resize(want, len(many)))


def test_scored_batches_are_joined_whole_and_in_order():
    import pandas as pd

    from spindrift.models import lane

    parts = [pd.DataFrame({"a": np.arange(n) + i * 100}) for i, n in enumerate((4, 4, 4, 30, 1, 2))]
    out = list(lane._joined(iter(parts), 10))
    assert [len(p) for p in out] == [8, 4, 30, 3]
    assert pd.concat(out)["a"].tolist() == pd.concat(parts)["a"].tolist()
    assert list(lane._joined(iter(()), 10)) == []
