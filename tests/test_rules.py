import pytest
from pyspark.sql import functions as F

from spindrift import domain as D
from spindrift.functions import rules as R


def one(spark, expr, **values):
    cols = list(values)
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{c} string" for c in cols))
    return df.select(expr).first()[0]


@pytest.mark.parametrize("text,want", [(None, "Unknown"), ("", "Unknown"), ("unknown", "Unknown"), ("not specified", "Other"), ("ceo2-tio2", "TiO2-CeO2"), ("activated carbon", "Carbon"), ("CNTs", "CNTs"),
    ("carbon nitride", "Carbon"), ("Al₂O₄", "Al2O4"), ("gamma Alumina", "Al2O3"), ("CeO₂ nano", "CeO2"), ("ZrO2", "ZrO2"), ("Ti-O", "TiO2"), ("ZnO", "ZnO"), ("Mg/Al", "MgAl"), ("MgO", "MgO"), ("alpha-MoC", "Mo2C"),
    ("g-C3N4", "CN"), (" cn ", "CN"), ("boron nitride", "h-BN"), ("SnO2", "SnO2"), ("LaMnO3", "Perovskite"), ("spinel x", "Spinel"), ("hydrotalcite", "LDH"), ("NaF", "NaF"), ("clay", "Cement-Clay"), ("quartz", "Other")])
def test_support(spark, text, want):
    assert one(spark, R.classify_support(F.col("x"), D.SUPPORT_RULES, D.NO_LABELS), x=text) == want


@pytest.mark.parametrize("value,label,want", [("Co-precipitation", None, "Co-precipitation"), (None, "sol gel Ni", "Sol-gel"), ("wetness", "x", "Impregnation"), ("", "hydrotalcite Ni", "Hydrothermal"),
    ("ball mill", None, "Ball milling"), ("ball pressed", None, "Other"), ("milled in a Ball", None, "Ball milling"), ("polyol", None, "Polyol"), (None, None, "Unknown"), ("Unknown", None, "Other"), (" ", None, "Unknown")])
def test_method(spark, value, label, want):
    assert one(spark, R.classify_method(F.col("v"), F.col("l"), D.METHOD_RULES), v=value, l=label) == want


@pytest.mark.parametrize("text,want", [("1.5", 1.5), (" -3e2 ", -300.0), (".5", 0.5), ("1d", None), ("2f", None), ("nan", None), ("inf", None), ("12 C", None), ("", None), (None, None), ("1.", 1.0), (" 7 ", 7.0)])
def test_number(spark, text, want):
    assert one(spark, R.parse_number(F.col("x")), x=text) == want


@pytest.mark.parametrize("text,want", [("TRUE", True), (" yes ", True), ("0", False), ("", False), (None, False), ("none", False), ("1.0", None), ("maybe", None)])
def test_bool(spark, text, want):
    assert one(spark, R.parse_bool(F.col("x"), D.TRUE_WORDS, D.FALSE_WORDS), x=text) is want


@pytest.mark.parametrize("text,want", [("Ni, Cu; Zn", "Cu,Zn"), ("N/A,Cu", "A,Cu"), ("N/A", None), ("Ni", None), ("Cu/Cu", "Cu,Cu"), (" ; ", None), (None, None), ("Zn,Cu", "Zn,Cu")])
def test_tokens(spark, text, want):
    assert one(spark, R.token_list(F.col("x"), D.NOT_A_PROMOTER, D.NO_LABELS), x=text) == want


@pytest.mark.parametrize("text,want", [("10 wt% Ni/Al2O3", 10.0), ("Ni15/CeO2", 15.0), ("90 wt% Ni5", None), ("Cu", None), (None, None), ("ni 0", None)])
def test_label_value(spark, text, want):
    assert one(spark, R.first_number(F.col("x"), D.LABEL_LOADING_PATTERNS, *D.LABEL_LOADING_RANGE), x=text) == want


def test_ranges(spark):
    df = spark.createDataFrame([(1, 5.0, "x"), (2, 100.0, None), (3, None, "y"), (4, 0.0, "z")], "id int, `a%` double, other string")
    got = {r.id: (r["a%"], r["a%_range_flag"]) for r in R.guard_ranges(df, {"a%": (0.0, 10.0)}).collect()}
    assert got == {1: (5.0, 0), 2: (None, 1), 3: (None, 0), 4: (0.0, 0)}


def test_small_ones(spark):
    assert one(spark, R.recode(F.col("x"), D.PRECURSOR_NAMES), x="NITRATE") == "Nitrate"
    assert one(spark, R.recode(F.col("x"), D.PRECURSOR_NAMES), x="Sulfate") == "sulfate"
    assert one(spark, R.default_text(F.col("x")), x="  ") == "Unknown"
    assert one(spark, R.trailing_number(F.col("x")), x="Ni/ZrO2 (12.5) ") == 12.5
    assert one(spark, R.trailing_number(F.col("x")), x="Ni/ZrO2") is None
    assert one(spark, R.relabel(F.col("x"), D.LABEL_PREFIXES + D.LABEL_NAMES), x="num__Ni_Loading_wt%") == "Ni loading (wt%)"
    df = spark.createDataFrame([(None, None), (1.0, None)], "a double, b double")
    assert [r[0] for r in df.select(R.row_sum([F.col("a"), F.col("b")])).collect()] == [None, 1.0]
    assert [r[0] for r in df.select(R.clip(F.col("a"), 2.0, 3.0)).collect()] == [None, 2.0]
