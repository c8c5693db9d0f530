import pytest
from pyspark.sql import functions as F

from spindrift.operators.packed import explode_packed, split_packed

CASES = [
    ("Cu, Ce", ["Cu", "Ce"]),
    ("Ce (imp., 10 wt%);Cu", ["Ce (imp., 10 wt%)", "Cu"]),
    ("Ce-La & Zn", ["Ce-La", "Zn"]),
    ("Cu 1,6%, La", ["Cu 1,6%", "La"]),
    ("Ce3++Cu2+", ["Ce3+", "Cu2+"]),
    ("Zn2+ + Cu+La", ["Zn2+", "Cu", "La"]),
    ("'Ga, Cu mixed oxide' and Zn", ["Ga, Cu mixed oxide", "Zn"]),
    ('"a ""b"", c"; d', ['a ""b"", c', "d"]),
    ("['Cu (10 wt%)','samarium']", ["Cu (10 wt%)", "samarium"]),
    ("[Sn + Sm]", ["Sn", "Sm"]),
    ("Zn;;Co//La\t K\nGa、Sn；Pt，Mg|Fe", ["Zn", "Co", "La", "K", "Ga", "Sn", "Pt", "Mg", "Fe"]),
    ("Cu, N/A, none, La", ["Cu", "La"]),
    ("La, La", ["La", "La"]),
    (" ,Cu,", ["Cu"]),
    ("Zn ,  Ce", ["Zn", "Ce"]),
    ("Sandy Land", ["Sandy Land"]),
    ("Ce (Ce/Ni = 0.5) AND Cu", ["Ce (Ce/Ni = 0.5)", "Cu"]),
    ('Cu "; Zn', ['Cu "', "Zn"]),
    ("0, Cu", ["0", "Cu"]),  # the marker characters themselves are data
    ("", []),
    ("nan", []),
    ("a((b,c),d);e", ["a((b,c),d)", "e"]),
    ("a(1,(2,(3,(4,(5,6),7),8),9),0);e", ["a(1,(2,(3,(4,(5,6),7),8),9),0)", "e"]),
    ("a (b, (c, d), e; f", ["a (b", "(c, d)", "e", "f"]),
    ("a), (b, (c, d)), e); f", ["a)", "(b, (c, d))", "e)", "f"]),
    ('x ("p (q", r); s', ['x ("p (q", r)', "s"]),
]


@pytest.mark.parametrize("cell,want", CASES)
def test_split(spark, cell, want):
    got = spark.createDataFrame([(cell,)], "c string").select(split_packed(F.col("c"))).first()[0]
    assert got == want


def test_explode(spark):
    df = spark.createDataFrame([(1, "Cu, Ce", "x", 9), (2, None, "y", 9), (3, "Cu", "z", 9), (4, "", "", 0), (1, "Cu, Ce", "x", 9)], "id long, cell string, value string, pos int")
    got = sorted(map(tuple, explode_packed(df, "id", "cell").collect()))
    assert got == [(1, 1, "Cu"), (1, 1, "Cu"), (1, 2, "Ce"), (1, 2, "Ce")]
    assert explode_packed(df.limit(0), "id", "cell").count() == 0


def test_long_cell(spark):
    cell = ", ".join(f"v{i}" for i in range(20_000))
    assert explode_packed(spark.createDataFrame([(1, cell)], "id long, cell string"), "id", "cell").count() == 20_000


@pytest.mark.parametrize("span", ['"%s"', "(%s)", "((((%s))))", '("%s" (x))'])
def test_spans_of_a_megabyte(spark, span):
    cell = (span % ("value, " * 150_000)) + "; Cu"
    got = spark.createDataFrame([(cell,)], "c string").select(split_packed(F.col("c")).alias("v")).select(F.size("v"), F.element_at("v", -1)).first()
    assert tuple(got) == (2, "Cu")


def test_many_brackets_and_blanks(spark):
    cells = ["(a, (b, c))" * 5000 + "; Cu", "(" * 50_000 + "; Cu", ")" * 50_000 + "; Cu", "Zn" + " " * 300_000 + "; Cu", '"' * 99_999 + "; Cu", '"a""' * 20_000 + "; Cu"]
    got = spark.createDataFrame([(c,) for c in cells], "c string").select(F.element_at(split_packed(F.col("c")), -1)).collect()
    assert [r[0] for r in got] == ["Cu"] * len(cells)
