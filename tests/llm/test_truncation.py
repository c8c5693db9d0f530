import random

import pytest
from pyspark.sql import functions as F

from spindrift.llm import truncation as K

SUBJECTS = ["The committee", "Our region", "The Minister", "Every small town", "The auditor", "This House"]
VERBS = ["has promised", "will support", "never mentioned", "ought to withdraw", "continues to ignore"]
OBJECTS = ["the ferry subsidy", "the school programme", "the housing amendment", "the review of land registration", "the winter fuel scheme"]
ENDS = ["before the recess", "in good faith", "for the next generation", "at a time of rising prices", "whatever the weather"]


def corpus():
    rng = random.Random(5)

    def sentence():
        return f"{rng.choice(SUBJECTS)} {rng.choice(VERBS)} {rng.choice(OBJECTS)} {rng.choice(ENDS)}{rng.choice('...!?')}"

    rows, cut = [], set()
    for i in range(900):
        t = " ".join(sentence() for _ in range(rng.randrange(2, 14)))
        kind, src = i % 30, "limited" if i % 3 else "free"
        if kind == 1:
            t += "\nQuestion put and agreed to"
        elif kind == 2:
            t += f" Ayes {rng.randrange(500)}, Noes {rng.randrange(500)}"
        elif kind == 3:
            t += " That is simply not what I —"
        elif kind == 4:
            t += " We all know how that story ended…"
        elif kind == 5:
            t += " (Interruption.)"
        elif kind == 6:
            t, full = t[: rng.randrange(40, len(t))], t
            while t.rstrip()[-1] in ".!?":
                t = t[:-3]
            cut.add(i)
        elif kind == 7:
            t += " (Applause from the"
            cut.add(i)
        if src == "limited" and len(t) > 420 and i not in cut:
            t = t[:420]
            if t.rstrip()[-1] not in ".!?)…—":
                t = t[:-1] + "…" if i % 2 else t + "  \n" if i % 7 == 0 else t
                cut.add(i)
        rows.append((i, t, src))
    return rows, cut


def test_planted_cuts(spark):
    rows, cut = corpus()
    extra = [(2000, None, "free"), (2001, "", "free"), (2002, " \n", "free"), (2003, "Torn charact�", "free"), (2004, "Whole.", None)]
    df = spark.createDataFrame(rows + extra, "doc_id long, text string, source string")
    got = K.find_truncated(df, "doc_id", "text", "source").collect()
    assert len(got) == 902 and len({r.doc_id for r in got}) == 902
    hit = {r.doc_id for r in got if r.truncated}
    assert 2003 in hit and 2004 not in hit
    hit -= {2003}
    assert len(cut) > 150 and len(hit & cut) >= 0.95 * len(cut) and len(hit - cut) <= 0.03 * len(hit), (sorted(hit - cut), sorted(cut - hit))
    rates = {r.source: r for r in K.truncation_rates(K.find_truncated(df, "doc_id", "text", "source")).collect()}
    assert rates["limited"].share_truncated > rates["free"].share_truncated > 0 and rates["limited"].n_at_limit > 20 and rates[None].n_texts == 1
    h = K.length_hazards(df.filter("length(trim(text)) > 0").select(F.col("source").alias("src"), F.length("text").alias("chars"), F.octet_length("text").alias("octets"))).filter("significant and unit = 'chars'").collect()
    assert any(r.src == "limited" and r.len == 420 for r in h) and not any(r.src == "free" for r in h)


def test_empty_and_clashing(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string, kind string, row long")
    assert K.find_truncated(df, "doc_id", "text", "source").count() == 0
    df = spark.createDataFrame([(1, "A whole one.", "s", "x", 3)] * 2, "doc_id long, text string, source string, kind string, row long")
    assert [(r.doc_id, r.truncated) for r in K.find_truncated(df, "doc_id", "text", "source").collect()] == [(1, False)] * 2


@pytest.mark.parametrize("text", ["a (" + "long remark, " * 60 + "b.", "a (b\nc.", "Ja (Zuruf des Abg. X [SPD]", "Ja [Beifall (SPD)"])
def test_brackets_are_counted_over_the_whole_text(spark, text):
    df = spark.createDataFrame([(1, text, "s"), (2, text.replace("(", "").replace("[", "") + " a) b.", "s")], "doc_id long, text string, source string")
    got = {r.doc_id: (r.kind, r.truncated) for r in K.find_truncated(df, "doc_id", "text", "source").collect()}
    assert got == {1: ("open", True), 2: ("sign", False)}


def test_very_long_text(spark):
    df = spark.createDataFrame([(1, "This is a sentence. " * 20_000, "s"), (2, "word " * 50_000, "s")], "doc_id long, text string, source string")
    assert {r.doc_id: r.kind for r in K.find_truncated(df, "doc_id", "text", "source").collect()} == {1: "sign", 2: "bare"}


@pytest.mark.parametrize("text,kind", [("a.", "sign"), ("a…", "dots"), ("a ...", "dots"), ("a —", "dash"), ("a (b", "open"), ("(b) a", "bare"), ("a [x]", "closed"), ("Ja-", "bare"), ('He said "no."', "sign"), ("x�", "broken")])
def test_kinds(spark, text, kind):
    assert spark.range(1).select(K.ending_kind(F.lit(text))).first()[0] == kind
