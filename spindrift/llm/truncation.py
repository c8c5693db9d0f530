"""Problem 8: text cut off by field limits or on its way.

Lengths: for each source the discrete hazard of every length (share of the texts reaching it that end
there) is set against the hazard of the neighbouring lengths, in characters, bytes and bands of characters, and
significant lengths are kept at a controlled false-discovery rate. cut_at_limits flags the incomplete
endings at significant lengths; how sure an ending must be to count as complete follows from the share of
the texts there that the hazard does not explain. cut_elsewhere is the second operator, for texts cut at no
particular length: it has the endings alone. How complete an ending is comes from word counts over
the whole corpus: how often the last words of a text end a sentence or line, and how much of their mass
goes on (the word continues, or another follows). find_truncated unites both and names the evidence.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions.text import BLANKS
from spindrift.session import cut

#: False-discovery rate of significant lengths (for each source and unit), the neighbours on each
#: side that a length is tested against, fewest texts at a length, and the width of a band.
FDR, NEIGHBOURS, LEAST, BAND = 0.01, 30, 4, 16
#: An ending is whole if at least this share of its occurrences end there; at a significant length the share grows
#: with the excess of its hazard, up to the second. SUPPORT: occurrences a context needs besides the text's own.
SHARE, SHARE_AT_LIMIT, SUPPORT = 0.25, 0.35, 4
#: A closing formula may also open longer sentences; it counts as one where it ends a text this many
#: times more often than texts end without a sign after any word.
OVER_CHANCE = 20.0

_W = r"(?:\p{N}[\p{N}.,:/ ]*\p{N}|[\p{L}\p{M}\p{N}'’\-]*[\p{L}\p{M}\p{N}])"
_TAIL = r"[^\p{L}\p{M}\p{N}]*+"
_MARK = r"[.!?…)\]»”\"(\[]"
#: Signs put between words, between a word and what follows it, and at the end of a text.
_NEXT, _PART, _LAST = "\u0001", "\u0002", "\u0003"


def _parts(t: Column) -> Column:
    """Words of a text, each with what follows it: word, _PART, signs; the last one ends in _LAST. One pass of one pattern."""
    own = F.concat(F.lower(t), F.lit(_LAST))
    clean = F.when(t.contains(_NEXT) | t.contains(_PART) | t.contains(_LAST), F.concat(F.translate(F.lower(t), _NEXT + _PART + _LAST, "   "), F.lit(_LAST))).otherwise(own)
    each = F.split(F.regexp_replace(clean, rf"(?:^{_TAIL})?({_W})({_TAIL})", f"$1{_PART}$2{_NEXT}"), _NEXT, -1)
    return F.slice(each, 1, F.size(each) - 1)


def _word(x: Column) -> Column:
    w = F.substring_index(x, _PART, 1)
    number = (F.substring(w, 1, 1) <= "9") & w.rlike(r"^\p{N}[\p{N}.,:/ ]*$")
    return F.when(number, "#").otherwise(w)


def _goes_on(x: Column) -> Column:
    """Whether the sentence goes on after a word: nothing but blanks and light signs follow, or a full stop after a
    very short word, which may be an abbreviation."""
    tail = F.substring_index(x, _PART, -1)
    short = (F.length(F.substring_index(x, _PART, 1)) <= 4) & tail.rlike(r"^\.[  ]+$")
    return (tail == " ") | short | ~tail.rlike(rf"{_MARK}|[\r\n]")


def _end(x: Column) -> Column:
    """How a word ends: T sentence sign or bracket (or a full stop after a very short word), D dots, U the line or the
    text ends without a sign, C it goes on."""
    tail = F.substring_index(x, _PART, -1)
    short = (F.length(F.substring_index(x, _PART, 1)) <= 4) & tail.rlike(r"^\.[  ]+$")
    return F.when(tail == " ", "C").when(tail.rlike(r"…|\.\s*\."), "D").when(short | tail.rlike(_MARK), "T").when(tail.rlike(rf"[\r\n{_LAST}]"), "U").otherwise("C")


def _context(x: Column, p1: Column, p2: Column) -> tuple[Column, Column, Column]:
    """(w1, w2, w3): a word with the two words before it inside its sentence, '^' where the sentence begins."""
    on1, on2 = F.coalesce(_goes_on(p1), F.lit(False)), F.coalesce(_goes_on(p2), F.lit(False))
    return F.when(on1 & on2, _word(p2)).otherwise("^"), F.when(on1, _word(p1)).otherwise("^"), _word(x)


def _last_context(t: Column) -> Column:
    """(w1, w2, w3) of the last word; the last few blank-separated pieces hold it, else the whole text is read."""
    few = _parts(F.substring_index(t, " ", -6))
    at = lambda ws: F.struct(*(c.alias(n) for c, n in zip(_context(F.get(ws, F.size(ws) - 1), F.get(ws, F.size(ws) - 2), F.get(ws, F.size(ws) - 3)), ("w1", "w2", "w3"))))
    return F.transform(F.array(few), lambda ws: F.when(F.size(ws) > 3, at(ws)).otherwise(F.transform(F.array(_parts(t)), lambda all_: F.when(F.size(all_) > 0, at(all_)))[0]))[0]


def _unclosed(t: Column) -> Column:
    """Whether a round or square bracket of the whole text is never closed; a closing one without its opening one
    counts for nothing."""
    signs = F.regexp_extract_all(t, F.lit(r"[(\[)\]]"), F.lit(0))

    def deep(opening: str, closing: str) -> Column:
        step = lambda n, x: F.greatest(F.lit(0), n + F.when(x == opening, 1).when(x == closing, -1).otherwise(0))
        return F.aggregate(signs, F.lit(0), step) > 0

    return (t.contains("(") & deep("(", ")")) | (t.contains("[") & deep("[", "]"))


def ending_kind(t: Column, whole: Column | None = None) -> Column:
    """How a right-stripped text ends: open (bracket never closed), broken (a torn character), closed
    (bracketed remark), dash, dots, sign, or bare. t may be its end only, from its last word on; brackets are counted in whole."""
    return (
        F.when(t.rlike(r"�\s*[.…\s]*$"), "broken")
        .when(_unclosed(t if whole is None else whole), "open")
        .when(t.rlike(r"[)\]]$"), "closed")
        .when(t.rlike(r"(?:…|\.\s*\.)[.…\s]*[»”\"']*$"), "dots")
        .when(t.rlike(r"[.!?][»”\"'’]*$"), "sign")
        .when(t.rlike(r"[—–―]$|\s-+$"), "dash")
        .otherwise("bare")
    )


def length_hazards(df: DataFrame) -> DataFrame:
    """df (src, chars, octets) -> (src, unit, len, n, at_risk, hazard, expected, log_p, significant)."""
    n = df.select("src", F.explode(_lengths()).alias("x")).groupBy("src", "x.unit", "x.len").agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy("src", "unit").orderBy("len")  # one row for each length, not for each text
    near, lo = by.rangeBetween(-NEIGHBOURS, NEIGHBOURS), F.greatest(F.col("len") - NEIGHBOURS, F.lit(1))
    risk = n.withColumn("at_risk", F.sum("n").over(by.rangeBetween(0, Window.unboundedFollowing)))
    # texts at risk at each neighbouring length, those at which none ends too: a text that ends inside the
    # neighbourhood is at risk from its lower edge to its own length, a longer one at all of them
    longer = F.coalesce(F.sum("n").over(by.rangeBetween(NEIGHBOURS + 1, Window.unboundedFollowing)), F.lit(0))
    inside, mass = F.sum("n").over(near), F.sum(F.col("n") * F.col("len")).over(near)
    risk = risk.withColumn("near_n", inside - F.col("n")).withColumn("near_risk", mass - inside * (lo - 1) + longer * (F.col("len") + NEIGHBOURS - lo + 1) - F.col("at_risk"))
    risk = risk.withColumn("hazard", F.col("n") / F.col("at_risk")).withColumn("expected", (F.col("near_n") + 0.5) / F.greatest("near_risk", F.lit(1)))
    lam = F.col("expected") * F.col("at_risk")
    # Chernoff's bound of the Poisson tail: conservative, and closed in form
    risk = risk.withColumn("log_p", F.when(F.col("n") > lam, -(F.col("n") * F.log(F.col("n") / lam) - F.col("n") + lam)).otherwise(0.0))
    order = Window.partitionBy("src", "unit").orderBy("log_p")
    m = F.count(F.lit(1)).over(Window.partitionBy("src", "unit"))
    risk = risk.withColumn("ok", F.col("log_p") <= math.log(FDR) + F.log(F.rank().over(order) / m))
    # Benjamini-Hochberg: all lengths up to the last one under the line
    risk = risk.withColumn("worst", F.min(F.when(F.col("ok"), -F.col("log_p"))).over(Window.partitionBy("src", "unit")))
    return risk.withColumn("significant", F.coalesce((-F.col("log_p") >= F.col("worst")) & (F.col("n") >= LEAST), F.lit(False))).drop("ok", "worst", "near_n", "near_risk")


_SUMS = ["nt", "nd", "nu", "nc"]


def _corpus_counts(texts: DataFrame) -> DataFrame:
    """Ends of every word of the corpus by its context. Words are exploded with the two before them, so all the rest
    is plain columns."""
    ws = texts.select(_parts(F.col("t")).alias("a"))
    none = F.lit(None).cast("string")
    before = lambda k: F.slice(F.concat(F.array(*[none] * k), F.col("a")), F.lit(1), F.size("a"))
    rows = ws.select(F.explode(F.arrays_zip(F.col("a"), before(1).alias("b"), before(2).alias("c"))).alias("x")).select("x.*").toDF("a", "b", "c")
    g = rows.select(*(c.alias(n) for c, n in zip(_context(F.col("a"), F.col("b"), F.col("c")), ("w1", "w2", "w3"))), _end(F.col("a")).alias("end"))
    return g.groupBy("w1", "w2", "w3").agg(*(F.sum((F.col("end") == k).cast("bigint")).alias(s) for k, s in zip("TDUC", _SUMS)))


def _evidence(cand: DataFrame, counts: DataFrame) -> DataFrame:
    """cand (doc, w1, w2, w3, kind) with, for contexts of three, two and one words and for the two words
    before (any last word): e<k> ended alike, t<k> all occurrences, longer words included; the
    text's own occurrence is left out."""
    counts = counts.withColumn("all", F.col("nt") + F.col("nd") + F.col("nu") + F.col("nc"))
    out, sizes = cand, sorted(r[0] for r in cand.select(F.length("w3")).distinct().collect())  # lengths of last words
    for k, keys in ((3, ["w1", "w2"]), (2, ["w2"]), (1, [])):
        own = out.select(*keys, "w3").distinct()
        table = counts if k == 3 else counts.groupBy(*keys, "w3").agg(*(F.sum(c).alias(c) for c in (*_SUMS, "all")))
        exact = table.select(*keys, "w3", *(F.col(c).alias(f"{c}{k}") for c in (*_SUMS, "all")))
        # words that begin with the last word: prefixes only of words whose context occurs among the candidates
        pool = table.join(own.select(*keys).distinct(), keys, "left_semi") if keys else table
        longer = (
            pool.filter("length(w3) > 1")
            .select(*keys, "all", F.explode(F.transform(F.filter(F.array(*map(F.lit, sizes)).cast("array<int>"), lambda n: n < F.length("w3")), lambda n: F.substring("w3", F.lit(1), n))).alias("w3"))
            .groupBy(*keys, "w3").agg(F.sum("all").alias(f"x{k}"))
        )
        known = own.join(exact, [*keys, "w3"], "left").join(longer, [*keys, "w3"], "left").na.fill(0)
        out = out.join(known, [*keys, "w3"], "left")
    before = counts.groupBy("w1", "w2").agg(F.sum("nu").alias("nub"), F.sum("all").alias("allb"))
    return out.join(before, ["w1", "w2"], "left").na.fill(0, ["nub", "allb"])


def _share(part: str, k: int) -> Column:
    """Share of part among all occurrences of the k-word ending, without the text's own; null if unseen."""
    total = F.col(f"all{k}") + F.col(f"x{k}") - 1
    return F.when(total >= SUPPORT, (sum((F.col(f"{p}{k}") for p in part.split("+")), F.lit(0)) - 1) / total)


def find_truncated(df: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(id_col, source, kind, at_limit, evidence, truncated) of every text that is neither null, empty nor blank.

    truncated: the text ends before its last sentence or bracketed remark is complete. at_limit: its
    length is significant in its source. evidence: length (flagged by cut_at_limits), ending (by
    cut_elsewhere) or null. Rows repeating an id are judged each on its own text; a null source is a
    source of its own; an empty table gives no rows. Very long texts are read whole.
    """
    judged = judged_endings(df, id_col, text_col, source_col)
    out = judged.withColumn("evidence", F.when(cut_at_limits(), "length").when(cut_elsewhere(), "ending"))
    return out.select(F.col("doc").alias(id_col), F.col("src").alias("source"), "kind", "at_limit", "evidence", F.col("evidence").isNotNull().alias("truncated"))


def _incomplete(need: Column, dots_may_finish: bool) -> Column:
    """Whether an ending judged by judged_endings is incomplete: a bracket never closed, a torn character, or last words
    that end fewer than `need` of their occurrences."""
    # an ending nowhere else seen: a name (capital) or a number ends a heading, another word is cut
    bare_whole = F.coalesce(F.greatest(F.col("ended"), F.coalesce("placed", F.lit(0.0))) >= need, F.col("upper") | (F.col("w3") == "#"))
    dots_whole = F.coalesce(F.col("dotted") >= need, F.lit(False)) | (F.lit(dots_may_finish) & F.coalesce(F.col("finished") >= 0.2, F.lit(False)))
    return (
        F.when(F.col("kind").isin("open", "broken"), True)
        .when(F.col("kind") == "bare", F.col("w3").isNotNull() & ~bare_whole & ~F.col("formula"))
        .when(F.col("kind") == "dots", F.col("w3").isNotNull() & ~dots_whole)
        .otherwise(False)
    )


def cut_at_limits() -> Column:
    """Flag of the rows of judged_endings that end incomplete at a significant length. The excess of the hazard there over
    its neighbours' is the share of the texts that the limit cut, so it sets how whole an ending must look."""
    return F.col("at_limit") & _incomplete(SHARE + (SHARE_AT_LIMIT - SHARE) * F.col("excess"), False)


def cut_elsewhere() -> Column:
    """Flag of the rows of judged_endings that end incomplete at no significant length: lost on their way. Only the
    ending speaks."""
    return ~F.col("at_limit") & _incomplete(F.lit(SHARE), True)


def _lengths() -> Column:
    return F.array(
        F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("len")),
        F.struct(F.lit("bytes").alias("unit"), F.col("octets").alias("len")),
        F.struct(F.lit("band").alias("unit"), F.ceil(F.col("chars") / BAND).cast("int").alias("len")),
    )


def judged_endings(df: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """Every text with its length's significance (at_limit, excess) and the figures of its ending."""
    q = lambda c: F.col(f"`{c}`")
    base = df.select(q(id_col).alias("doc"), q(source_col).cast("string").alias("src"), q(text_col).cast("string").alias("raw"))
    # trimmed from the right by a set of characters: no pattern runs over the whole text
    base = base.withColumn("t", F.rtrim(F.col("raw"), F.lit(BLANKS))).filter("t <> ''")
    end = F.substring("t", -64, 64)
    kind = ending_kind(F.when(end.rlike(r"[\p{L}\p{N}]"), end).otherwise(F.col("t")), F.col("t"))  # what follows the last word decides
    docs = base.withColumn("kind", kind).select(
        F.monotonically_increasing_id().alias("row"), "doc", "src", "kind", F.length("raw").alias("chars"), F.octet_length("raw").alias("octets"),
        F.when(F.col("kind").isin("bare", "dots"), _last_context(F.col("t"))).alias("e"), F.substring_index("t", " ", -1).rlike(r"\p{Lu}[^\s]*$").alias("upper"),
    ).select("row", "doc", "src", "kind", "chars", "octets", "upper", "e.w1", "e.w2", "e.w3")
    docs = cut(docs)
    counts = cut(_corpus_counts(base))

    sig = length_hazards(docs).filter("significant").select("src", "unit", "len", (1 - F.col("expected") / F.col("hazard")).alias("x"))
    keys = docs.select("row", "src", F.explode(_lengths()).alias("x")).select("row", "src", "x.*")
    at = keys.join(sig, (keys.src.eqNullSafe(sig.src)) & (keys.unit == sig.unit) & (keys.len == sig.len)).groupBy("row").agg(F.max("x").alias("excess"))
    cand = docs.filter("kind in ('bare', 'dots') and w3 is not null")
    ev = _evidence(cand.select("row", "w1", "w2", "w3"), counts)
    ended = F.coalesce(*(_share("nu", k) for k in (3, 2, 1)))
    dotted = F.coalesce(*(_share("nd", k) for k in (3, 2)))
    finished = (F.col("nt2") + F.col("nd2") + F.col("nu2") - 1) / (F.col("all2") + F.col("x2"))
    placed = F.when(F.col("allb") > 1, (F.col("nub") - 1) / (F.col("allb") - 1))
    chance = (cand.filter("kind = 'bare'").count() + 1) / (counts.agg(F.sum(sum((F.col(c) for c in _SUMS), F.lit(0)))).first()[0] or 1)
    formula = (F.col("nu3") - 1 >= SUPPORT) & ((F.col("nu3") - 1) / (F.col("all3") + F.col("x3")) >= OVER_CHANCE * chance)
    ev = ev.select("row", ended.alias("ended"), dotted.alias("dotted"), finished.alias("finished"), placed.alias("placed"), formula.alias("formula"))
    out = docs.join(at, "row", "left").join(ev, "row", "left")
    return out.withColumn("at_limit", F.col("excess").isNotNull()).withColumn("excess", F.coalesce("excess", F.lit(0.0))).withColumn("formula", F.coalesce("formula", F.lit(False)))


def truncation_rates(found: DataFrame) -> DataFrame:
    """(source, n_texts, n_truncated, n_at_limit, share_truncated)."""
    hit = F.col("truncated").cast("bigint")
    return found.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_texts"), F.sum(hit).alias("n_truncated"), F.sum((F.col("truncated") & F.col("at_limit")).cast("bigint")).alias("n_at_limit"),
        F.round(F.avg(hit), 6).alias("share_truncated"),
    )
