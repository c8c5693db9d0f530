"""Problem 4: same or almost same records across splits.

Records are reduced to classes of equal keys; classes of the evaluation splits and of training are
joined by an exact prefix filter: the shingles of a label are ordered from rare to frequent, two
labels one edit apart must share one of their first few shingles, so only those are indexed and
probed, with the source in the join key. Length and position filters drop candidates before the
exact check. Linked classes are compared by their distinct measures with the number of records of each, so
copies cost nothing; pairs of records are written out only where they are asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions.text import POINT, bare, bare_decimal
from spindrift.session import cut

#: Length of a shingle (characters of the label's key).
Q = 3
#: One edit spoils at most Q + 1 shingles (a swap of neighbours touches Q + 1 windows), so at most as many distinct ones.
SPOILT = Q + 1


def shingles(key: Column) -> Column:
    """Distinct padded character shingles of a key."""
    pad = F.concat(F.lit("\ue010" * (Q - 1)), key, F.lit("\ue011" * (Q - 1)))
    grams = lambda x: F.transform(F.slice(x, F.lit(1), F.size(x) - (Q - 1)), lambda c, i: F.concat(c, *(F.get(x, i + k) for k in range(1, Q))))
    return F.array_distinct(F.transform(F.array(_characters(pad)), grams)[0])


def _characters(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0))


def word_runs(label: Column) -> Column:
    """The letters of a label split into words as written: lower-case letter runs, digits and
    decimal points as runs of their own; joined without separators they give bare_decimal(label)."""
    s = F.regexp_replace(F.lower(label), r"(?<=\p{N})\s*\.\s*(?=\p{N})", POINT)
    return F.regexp_extract_all(s, F.lit(rf"\p{{L}}+|[\p{{N}}{POINT}]+"), F.lit(0))


def _classes(df: DataFrame) -> DataFrame:
    """One row for each (source key, label key): the spelling with the most words, and on which
    sides of the split it occurs. Copies are combined before the shuffle."""
    return df.groupBy("s", "c").agg(
        F.max(F.struct(F.size(word_runs(F.col("label"))).alias("n"), F.col("label"))).getField("label").alias("label"),
        F.max("ev").alias("ev"), F.max(~F.col("ev")).alias("tr"),
    )


def _word_length_at(words: Column, at: Column) -> Column:
    """Length of the letter word that covers character `at` (from 1) of the joined words; 0 for digits."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("hit"))

    def step(acc: Column, w: Column) -> Column:
        end = acc["end"] + F.length(w)
        inside = (at > acc["end"]) & (at <= end) & w.rlike(r"^\p{L}+$")
        return F.struct(end.alias("end"), F.when(inside, F.length(w)).otherwise(acc["hit"]).alias("hit"))

    return F.aggregate(words, start, step)["hit"]


def one_letter_apart(a: Column, b: Column, wa: Column, wb: Column, least: int = 6) -> Column:
    """Keys a and b (with their words) differ by one wrong, missing, extra or swapped letter inside
    a word of `least` or more letters."""
    # first position from the left at which they differ; past the shorter text when it is a prefix
    same = F.zip_with(_characters(a), _characters(b), lambda x, y: F.coalesce(x == y, F.lit(False)))
    at = F.array_position(same, False).cast("int")
    return F.transform(F.array(F.when(at > 0, at).otherwise(F.length(a) + 1)), lambda first: _apart_at(first, a, b, wa, wb, least))[0]


def _apart_at(first: Column, a: Column, b: Column, wa: Column, wb: Column, least: int) -> Column:
    la, lb = F.length(a), F.length(b)
    rest = lambda c, skip: F.substring(c, first + skip, F.lit(1 << 30))
    ca, cb = F.substring(a, first, F.lit(1)), F.substring(b, first, F.lit(1))
    na, nb = F.substring(a, first + 1, F.lit(1)), F.substring(b, first + 1, F.lit(1))
    letter = lambda c: c.rlike(r"^\p{L}$")
    wrong = (la == lb) & (rest(a, 1) == rest(b, 1)) & letter(ca) & letter(cb)
    swap = (la == lb) & (ca == nb) & (cb == na) & (rest(a, 2) == rest(b, 2)) & letter(ca) & letter(cb)
    extra_a = (la == lb + 1) & (rest(a, 1) == rest(b, 0)) & letter(ca)
    extra_b = (lb == la + 1) & (rest(a, 0) == rest(b, 1)) & letter(cb)
    # at a word's end the shorter side's word lies before the position
    in_a = F.greatest(_word_length_at(wa, first), F.when(extra_b, _word_length_at(wa, first - 1)).otherwise(0))
    in_b = F.greatest(_word_length_at(wb, first), F.when(extra_a, _word_length_at(wb, first - 1)).otherwise(0))
    return (a != b) & (wrong | swap | extra_a | extra_b) & (F.greatest(in_a, in_b) >= least) & (F.least(in_a, in_b) >= least - 1)


def near_classes(classes: DataFrame) -> DataFrame:
    """(s, c_train, c_eval) of different label keys of one source that are one letter apart."""
    # only a label with a long enough word can take part
    able = classes.filter(F.col("label").rlike(r"\p{L}{5}")).select("s", "c", "label", "ev", "tr", shingles(F.col("c")).alias("g"))
    # a source without evaluation classes, or without training classes, has no pairs
    both = able.groupBy("s").agg(F.max("ev").alias("a"), F.max("tr").alias("b")).filter("a and b").select("s")
    able = cut(able.join(both, "s", "left_semi"))
    rows = able.select("s", "c", "ev", "tr", F.explode("g").alias("g"))
    df = rows.groupBy("s", "g").agg(F.count(F.lit(1)).alias("df"))
    ranked = (
        rows.join(df, ["s", "g"])
        .groupBy("s", "c").agg(F.sort_array(F.collect_list(F.struct("df", "g"))).alias("o"), F.max("ev").alias("ev"), F.max("tr").alias("tr"))  # one label's shingles
    )
    prefix = ranked.select("s", "c", "ev", "tr", F.size("o").alias("n"), F.posexplode(F.slice("o", 1, SPOILT + 1)).alias("i", "t"))
    prefix = cut(prefix.select("s", "c", "ev", "tr", "n", (F.col("i") + 1).alias("i"), F.col("t.g").alias("g")))
    probe = prefix.filter("tr").select("s", "g", F.col("c").alias("ct"), F.col("n").alias("nt"), F.col("i").alias("it"))
    index = prefix.filter("ev").select("s", "g", F.col("c").alias("ce"), F.col("n").alias("ne"), F.col("i").alias("ie"))
    cand = (
        probe.join(index, ["s", "g"])
        .filter("ct <> ce and abs(length(ct) - length(ce)) <= 1")  # length filter
        .filter(f"least(it, ie) + least(nt - it, ne - ie) >= greatest(nt, ne) - {SPOILT}")  # position filter
        .select("s", "ct", "ce").distinct()
    )
    words = able.select("s", "c", word_runs(F.col("label")).alias("w"))
    full = (
        cand.join(words.select("s", F.col("c").alias("ct"), F.col("w").alias("wt")), ["s", "ct"])
        .join(words.select("s", F.col("c").alias("ce"), F.col("w").alias("we")), ["s", "ce"])
    )
    return full.filter(one_letter_apart(F.col("ct"), F.col("ce"), F.col("wt"), F.col("we"))).select("s", "ct", "ce")


def _prepared(df: DataFrame, row_id: str, source: str, label: str, measure: str, split: str, train: str) -> DataFrame:
    q = lambda c: F.col(f"`{c}`")
    out = df.select(
        q(row_id).cast("bigint").alias("id"), bare(q(source)).alias("s"), bare_decimal(q(label)).alias("c"), q(label).alias("label"),
        q(measure).cast("double").alias("m"), q(split).alias("split"), (q(split) != train).alias("ev"),
    )
    return out.dropna(subset=["id", "s", "c", "m", "split"]).filter("not isnan(m)")


def cross_split_classes(
    df: DataFrame, row_id: str, source: str, label: str, measure: str, split: str, train: str = "Train", within: float = 2.0
) -> tuple[DataFrame, DataFrame]:
    """(links, members): overlaps of training and evaluation without writing out pairs of records.

    links: (s, ct, mt, ce, me, split, n_train, n_eval) of each training class (key of source and label, measure) and
    evaluation class with the same source, the same or an almost same label and measures at most
    `within` apart, with the number of their records. members: (id, s, c, m, split, ev) of each record.
    A null in any of the five columns matches nothing. Records of the same split are never linked.
    """
    rows = cut(_prepared(df, row_id, source, label, measure, split, train))
    classes = cut(_classes(rows))
    # a class that occurs on one side only can still have a near partner, so all classes take part
    same = classes.filter("ev and tr").select("s", F.col("c").alias("ct"), F.col("c").alias("ce"))
    linked = cut(same.unionByName(near_classes(classes)))
    band = lambda c: F.floor(c / F.lit((float(within) or 1.0) * (1 + 1e-6))).cast("bigint")
    # copies are counted before any join, so a class of many copies is one row a measure
    t = rows.filter("not ev").groupBy("s", F.col("c").alias("ct"), F.col("m").alias("mt")).agg(F.count(F.lit(1)).alias("n_train"))
    e = rows.filter("ev").groupBy("s", F.col("c").alias("ce"), F.col("m").alias("me"), "split").agg(F.count(F.lit(1)).alias("n_eval"))
    t = t.join(linked, ["s", "ct"]).withColumn("b", band(F.col("mt")))
    e = e.withColumn("b", F.explode(F.array(*(band(F.col("me")) + k for k in (-1, 0, 1)))))  # evaluation is the smaller side
    # differences of decimal readings: a hair over the limit in binary is still the limit
    links = t.join(e, ["s", "ce", "b"]).filter(F.abs(F.col("mt") - F.col("me")) <= within + 1e-9)
    return links.select("s", "ct", "mt", "ce", "me", "split", "n_train", "n_eval"), rows.select("id", "s", "c", "m", "split", "ev")


def cross_split_pairs(links: DataFrame, members: DataFrame) -> DataFrame:
    """(id_train, id_eval, split, s): the pairs of records of cross_split_classes. Several copies are all paired; what
    is joined is spread over source, label and measure, and a class of very many copies by adaptive
    skew splitting."""
    t = members.filter("not ev").select("s", F.col("c").alias("ct"), F.col("m").alias("mt"), F.col("id").alias("id_train"))
    e = members.filter("ev").select("s", F.col("c").alias("ce"), F.col("m").alias("me"), "split", F.col("id").alias("id_eval"))
    return links.join(e, ["s", "ce", "me", "split"]).join(t, ["s", "ct", "mt"]).select("id_train", "id_eval", "split", "s")


def overlap_report(links: DataFrame, df: DataFrame, source: str, split: str, train: str = "Train") -> DataFrame:
    """(split, source, n_records, n_overlapping, n_pairs) of each evaluation split and source key,
    those without overlap too; a null source is reported under its null key. Counted on classes."""
    total = df.filter(F.col(f"`{split}`") != train).groupBy(F.col(f"`{split}`").alias("split"), bare(F.col(f"`{source}`")).alias("source")).agg(F.count(F.lit(1)).alias("n_records"))
    per_class = links.groupBy("split", F.col("s").alias("source"), "ce", "me").agg(F.max("n_eval").alias("n"), F.sum(F.col("n_train") * F.col("n_eval")).alias("p"))
    hit = per_class.groupBy("split", "source").agg(F.sum("n").alias("n_overlapping"), F.sum("p").alias("n_pairs"))
    return total.join(hit, ["split", "source"], "left").na.fill(0, ["n_overlapping", "n_pairs"])
