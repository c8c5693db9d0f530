import random

import regex
from pyspark.sql import functions as F

from spindrift.llm import overlap as O


def pairs(df):
    return sorted((r.id_train, r.id_eval) for r in O.cross_split_pairs(*O.cross_split_classes(df, "id", "src", "cat", "t", "set")).collect())


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, src string, cat string, t double, set string")


def test_rules(spark):
    df = frame(spark, [
        (1, "A.pdf", "Ni2.5/MgO monolith", 300.0, "Train"), (2, "a pdf", "NI2.5-MgO (monolith)", 302.0, "Test"), (3, "A.pdf", "Ni25/MgO monolith", 300.0, "Test"), (4, "A.pdf", "Ni2.5/MgO mnolith", 299.0, "Validation"),
        (5, "A.pdf", "Ni2.5/MnO monolith", 300.0, "Test"), (6, "A.pdf", "Ni2.5/MgO monolith", 302.1, "Test"), (7, "B.pdf", "Ni2.5/MgO monolith", 300.0, "Test"), (8, "A.pdf", "Ni2.5/MgO mtnolihh", 300.0, "Test"),
        (9, "A.pdf", "Ni2.5/MgO monolith", 300.0, "Train"), (10, None, "x", 1.0, "Test"), (11, None, "x", 1.0, "Train"), (12, "A.pdf", "Ni2.5/MgO monolith", None, "Test"), (13, "A.pdf", "Ni2.5/MgO monolihtt", 300.0, "Test"),
        (14, "A.pdf", "Ni2.5/MgO omnolith", 300.0, "Test"), (15, "A.pdf", "Ni2.5/MgO monolithe", 300.0, "Test"),
    ])
    assert pairs(df) == sorted((t, e) for t in (1, 9) for e in (2, 4, 14, 15))
    links, members = O.cross_split_classes(df, "id", "src", "cat", "t", "set")
    assert members.count() == 12 and links.agg(F.sum(F.col("n_train") * F.col("n_eval"))).first()[0] == 8
    rep = {(r.split, r.source): (r.n_records, r.n_overlapping, r.n_pairs) for r in O.overlap_report(links, df, "src", "set").collect()}
    assert rep[("Validation", "apdf")] == (1, 1, 2) and rep[("Test", "bpdf")] == (1, 0, 0) and rep[("Test", "apdf")][1:] == (3, 6)
    assert pairs(df.limit(0)) == []


def test_against_brute_force(spark):
    """Random one-letter changes in every place, repeated letters included, against comparison of all pairs."""
    rng = random.Random(7)
    words = ["monolith", "washcoated", "regenerated", "MgO", "calcined", "aaaaaaa", "abababab"]
    rows = []
    for i in range(320):
        w = rng.choice(words)
        if rng.random() < 0.7:
            k, c = rng.randrange(len(w)), rng.choice("abmo")
            w = rng.choice([w[:k] + c + w[k + 1 :], w[:k] + w[k + 1 :], w[:k] + c + w[k:], w[:k] + w[k + 1 : k + 2] + w[k : k + 1] + w[k + 2 :]])
        rows.append((i, rng.choice(["s1", "S-1", "s2"]), f"{rng.choice(['2.5', '25'])} wt% Ni/{rng.choice(['ZrO2', 'CeO2'])} {w}", float(rng.choice([300, 301.5, 303])), rng.choice(["Train", "Train", "Test"])))
    got = pairs(frame(spark, rows))

    def key(s):
        return regex.sub(r"[^a-z0-9§]", "", regex.sub(r"(?<=\d)\.(?=\d)", "§", s.lower()))

    def near(a, b):
        ka, kb = key(a), key(b)
        if ka == kb:
            return True
        wa, wb = a.lower().split(" ")[-1], b.lower().split(" ")[-1]
        if ka[: len(ka) - len(wa)] != kb[: len(kb) - len(wb)] or max(len(wa), len(wb)) < 6 or min(len(wa), len(wb)) < 5:
            return False
        edits = {wa[:i] + c + wa[i + 1 :] for i in range(len(wa)) for c in "abcdefghijklmnopqrstuvwxyz"} | {wa[:i] + wa[i + 1 :] for i in range(len(wa))}
        edits |= {wa[:i] + c + wa[i:] for i in range(len(wa) + 1) for c in "abcdefghijklmnopqrstuvwxyz"} | {wa[:i] + wa[i + 1] + wa[i] + wa[i + 2 :] for i in range(len(wa) - 1)}
        return wb in edits

    want = sorted((x[0], y[0]) for x in rows for y in rows if x[4] == "Train" != y[4] and key(x[1]) == key(y[1]) and abs(x[3] - y[3]) <= 2 and near(x[2], y[2]))
    assert got == want and len(want) > 50


def test_shingles_are_distinct(spark):
    assert sorted(map(len, spark.range(1).select(O.shingles(F.lit("aaaa"))).first()[0])) == [3] * 5


def test_many_copies_are_one_link(spark):
    """A class of thousands of copies on both sides is one link; the report counts its pairs without making them."""
    rows = [(i, "A", "Ni monolith", 300.0, "Train" if i % 2 else "Test") for i in range(6000)]
    df = frame(spark, rows)
    links, _ = O.cross_split_classes(df, "id", "src", "cat", "t", "set")
    assert [(r.n_train, r.n_eval) for r in links.collect()] == [(3000, 3000)]
    assert [(r.n_records, r.n_overlapping, r.n_pairs) for r in O.overlap_report(links, df, "src", "set").collect()] == [(3000, 3000, 9_000_000)]


def test_long_label(spark):
    label = "Ni monolith " + "word " * 4000
    df = frame(spark, [(1, "A", label, 1.0, "Train"), (2, "a", label.replace("monolith", "monolth"), 3.0, "Test")])
    assert pairs(df) == [(1, 2)]
