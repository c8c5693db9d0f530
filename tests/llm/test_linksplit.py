import itertools
import random
from collections import Counter, defaultdict

import pytest

from spindrift.llm import linksplit as L

TARGETS = [("train", 0.8), ("validation", 0.1), ("test", 0.1)]


def roots(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        up[find(a)] = find(b)
    g = defaultdict(set)
    for x in up:
        g[find(x)].add(x)
    return {x: min(v) for v in g.values() for x in v}


@pytest.mark.parametrize("bound", [2_000_000, 5])
def test_components(spark, bound):
    rng = random.Random(2)
    edges = [(f"n{rng.randrange(300)}", f"n{rng.randrange(300)}") for _ in range(180)] + [(f"c{i}", f"c{i + 1}") for i in range(120)] + [("z", "z")]
    got = dict(map(tuple, L.components(spark.createDataFrame(edges, "a string, b string").repartition(9), bound).collect()))
    assert got == roots([e for e in edges if e[0] != e[1]])
    assert L.components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_pairs(spark):
    df = spark.createDataFrame([("A.pdf", "id-1"), ("b.pdf", "ID 1"), ("b.pdf", "id2"), ("C.pdf", "id2"), ("d.pdf", "unknown"), ("e.pdf", "unknown"), ("f.pdf", None), (None, "id2"), ("a_PDF", "id9"), ("g", "id9")], "s string, e string")
    got = sorted(map(tuple, L.linked_pairs(L.linked_groups(df, "s", "e")).collect()))
    assert got == sorted(itertools.combinations(["apdf", "bpdf", "cpdf", "g"], 2))
    assert got == sorted(map(tuple, L.linked_pairs(L.linked_groups(df, "s", "e"), 1).collect()))  # every member a block
    groups = {r.source: (r.representative, r.n_sources) for r in L.linked_groups(df, "s", "e").collect()}
    assert groups == {k: ("apdf", 4) for k in ("apdf", "bpdf", "cpdf", "g")} | {k: (k, 1) for k in ("dpdf", "epdf", "fpdf")}
    assert L.linked_pairs(L.linked_groups(df.limit(0), "s", "e")).count() == 0


def test_split_keeps_groups(spark):
    rng = random.Random(1)
    rows = [(i, f"s{min(int(rng.expovariate(0.02)), 199)}" if i % 50 else None, f"id{rng.randrange(900)}" if rng.random() < 0.3 else "n/a") for i in range(3000)]
    df = spark.createDataFrame(rows, "row_id long, s string, e string")
    got = dict(map(tuple, L.grouped_split(df, "row_id", "s", "e", TARGETS).collect()))
    assert len(got) == 3000
    by = defaultdict(set)
    for i, s, e in rows:
        for k in ("s" + s if s else None, "e" + e if any(c.isdigit() for c in e) else None):
            if k:
                by[k].add(got[i])
    assert all(len(v) == 1 for v in by.values())
    assert got == dict(map(tuple, L.grouped_split(df.repartition(7), "row_id", "s", "e", TARGETS).collect()))
    assert L.grouped_split(df.limit(0), "row_id", "s", "e", TARGETS).count() == 0


def test_hot_source(spark):
    df = spark.createDataFrame([(i, "big" if i < 1000 else f"s{i}", None) for i in range(3000)], "row_id long, s string, e string")
    n = {r.split: r.n_records for r in L.split_report(L.grouped_split(df, "row_id", "s", "e", TARGETS), TARGETS).collect()}
    assert n == {"train": 2400, "validation": 300, "test": 300}


def greedy(hist, targets):
    total = sum(s * n for s, n in hist)
    lack = [total * t for _, t in targets]
    out = {}
    for s, n in sorted(hist, reverse=True):
        out[s] = [0] * len(lack)
        for _ in range(n):
            i = max(range(len(lack)), key=lambda j: (lack[j], -j))
            lack[i] -= s
            out[s][i] += 1
    return out, lack


def test_bulk_greedy_is_greedy():
    rng = random.Random(4)
    for _ in range(200):
        hist = [(s, rng.randrange(1, 40)) for s in rng.sample(range(1, 60), rng.randrange(1, 8))]
        got, (want, lack) = L.apportion(hist, TARGETS), greedy(hist, TARGETS)
        total = sum(s * n for s, n in hist)
        mine = [total * t - sum(s * got[s][i] for s in got) for i, (_, t) in enumerate(TARGETS)]
        assert all(sum(got[s]) == n for s, n in hist)
        assert Counter(round(x, 6) for x in mine) == Counter(round(x, 6) for x in lack) or max(map(abs, mine)) <= max(map(abs, lack)) + 1e-6, (hist, got, want)
