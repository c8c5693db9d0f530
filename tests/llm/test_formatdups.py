import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from spindrift.llm import formatdups as fd
from spindrift.tables import load


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, cap string, src string, cat string, prom string, a string, b string")


def found(df):
    return sorted(map(tuple, fd.format_copies(df, "id", "src", "cat", "prom", ("cap",)).collect()))


def test_rules(spark):
    df = frame(spark, [
        (1, "t1", "A_1.pdf", "Ni2.5/Al2O3 (x)", "Cu, Ce", "p", None), (2, "t2", " a-1.PDF", "ni2.5 al2o3 [X]", "ce;CU", "p", None), (3, "t", "A_1.pdf", "Ni25/Al2O3 (x)", "Cu, Ce", "p", None),
        (4, "t", "A_1.pdf", "Ni2.5/Al2O3 (x)", "Cu, Ce", "P", None), (5, "t", "A_1.pdf", "Ni2.5/Al2O3 (x)", "Cu, Ce", "p", ""), (6, "t", "A_1.pdf", "Ni2.5/Al2O3 (x)", None, "p", None),
        (7, "t", "a1pdf", "Ni2.5/Al2O3 x", None, "p", None), (8, None, None, None, None, None, None), (9, "z", None, None, None, None, None), (10, "z", "", None, None, None, None),
    ])
    assert found(df) == [(1, 2), (6, 7), (8, 9)]
    n = {r.id: r.n_copies for r in fd.copy_counts(fd.format_copies(df, "id", "src", "cat", "prom", ("cap",)), df, "id").collect()}
    assert n == {1: 2, 3: 1, 4: 1, 5: 1, 6: 2, 8: 2, 10: 1}
    assert found(df.limit(0)) == []


def test_crowded_keys_over_many_partitions(spark):
    rows = [(i, "t", "S_1.pdf" if i % 2 else "s-1 PDF", "Ni1.5", "Cu", "x", None) for i in range(3000)] + [(3000 + i, "t", f"S{i}", "c", None, "x", None) for i in range(1500)]
    rows += [(5000 + i, "t", "T", "Ni2", "Cu", "x", None) for i in range(900)]
    random.Random(1).shuffle(rows)
    df = frame(spark, rows).repartition(6)
    want = [(0, i) for i in range(1, 3000)] + [(5000, 5000 + i) for i in range(1, 900)]
    for size in (100, 1000, fd.ROWS):
        out = fd.format_copies(df, "id", "src", "cat", "prom", ("cap",), size)
        assert sorted(map(tuple, out.collect())) == want
    keyed = lambda d: fd.canonical_keys(d, "id", ["a", "b"], "src", "cat", "prom").select(F.col("k").cast("binary").alias("k"), "i")
    placed, base, more = fd._placed(df, keyed, 100)
    assert base == 54 and more > 30 and max(r["count"] for r in placed.groupBy("p").count().collect()) < 400


def test_repeated_ids_and_clashing_names(spark):
    df = frame(spark, [(1, "t", "s", "c", None, "x", None)] * 3).withColumnRenamed("a", "keep_id").withColumnRenamed("b", "pid")
    assert sorted(map(tuple, fd.format_copies(df, "id", "src", "cat", "prom", ("cap",)).collect())) == [(1, 1), (1, 1)]


def test_against_brute_force(spark, small):
    df = load(spark, small, "dataset_all")
    got = set(map(tuple, fd.format_copies(df, "raw_row_id", "Source_File", "Catalyst", "Promoter_Metal", ("extra_01",)).collect()))
    rest = [c for c in df.columns if c not in ("raw_row_id", "extra_01", "Source_File", "Catalyst", "Promoter_Metal")]
    import regex

    from spindrift.operators.packed import split_packed

    bare = lambda s: None if s is None else regex.sub(r"[^\p{L}\p{N}]", "", s.lower())
    dec = lambda s: None if s is None else regex.sub(r"[^\p{L}\p{N}§]", "", regex.sub(r"(?<=\p{N})\.(?=\p{N})", "§", regex.sub(r"\s", "", s.lower())))
    g = defaultdict(list)
    for r in df.withColumn("__l", split_packed(F.col("Promoter_Metal"), keep_placeholders=True)).collect():
        g[(bare(r.Source_File), dec(r.Catalyst), None if r["__l"] is None else "".join(sorted(map(bare, r["__l"]))), *(r[c] for c in rest))].append(r.raw_row_id)
    assert got == {(min(v), i) for v in g.values() for i in v if i != min(v)} and got


@pytest.mark.parametrize("a,b,same", [("Cu, Ce", "Ce & cu", True), ("Ce-La", "La-Ce", False), ("Cu (5 wt%); Zn", "zn, CU (5wt%)", True), ("Cu", "Gd", False), (None, "none", False), ("[Cu, Zn]", "Zn+Cu", True)])
def test_list_key(spark, a, b, same):
    r = spark.createDataFrame([(a, b)], "a string, b string").select(fd.list_key(F.col("a")).eqNullSafe(fd.list_key(F.col("b")))).first()[0]
    assert r is same


def test_separators_in_data(spark):
    rows = [(1, "t", "s", "c", None, "x\u001f", "y"), (2, "t", "s", "c", None, "x", "\u001fy"), (3, "t", "S", "c", None, "x", "\u001fy"), (4, "t", "s", "c", None, None, "y"), (5, "t", "s", "c", None, "\u001e", "y")]
    assert found(frame(spark, rows)) == [(2, 3)]
