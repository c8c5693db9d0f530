"""Problem 3: mapping freely typed values to a canonical list.

Work is done once for each distinct cell, and inside that once for each distinct token: tokens
(words and runs of neighbouring words) are repaired against the vocabulary of the reference list
by an edit-distance join on deletion variants, then the repaired tokens are combined by soft
TF-IDF to rank complete entries. Only entries whose rarest words a cell holds are scored, which loses none.
Plain joins and aggregates only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions.text import is_placeholder
from spindrift.session import cut

# Signs that look like Latin letters or stand for digits, and what they stand for.
LOOKALIKE = {
    "Cyrillic": ("авсеһіјкмнорѕтухԁӏ", "abcehijkmhopstuxdl"),
    "Greek": ("αεικνοπρτυχ", "aeiknopptux"),
    "subscripts": ("₀₁₂₃₄₅₆₇₈₉", "0123456789"),
    "superscripts": ("⁰¹²³⁴⁵⁶⁷⁸⁹", "0123456789"),
    "accents": ("áàâäãåéèêëíìîïóòôöõøúùûüçñý", "aaaaaaeeeeiiiioooooouuuucny"),
}
#: A word may be repaired by one edit (wrong, missing, extra or swapped letter) if it has this many letters: in an entry
#: of several words, and alone. Words with digits are formulas, in which an edit names something else: only signs
#: taken for each other are repaired there.
MIN_EDIT, MIN_EDIT_ALONE = 4, 5
#: Share of an entry's squared word weights, each times the likeness of its repair, that a cell must hold to name it.
ACCEPT = 0.8


def folded(c: Column) -> Column:
    """Lower case, without markup, look-alike signs replaced."""
    s = F.lower(F.regexp_replace(c, r"<[^<>]*>", ""))
    return F.translate(s, "".join(a for a, _ in LOOKALIKE.values()), "".join(b for _, b in LOOKALIKE.values()))


def confusable(c: Column) -> Column:
    """Digits and letters that are easily taken for each other become one."""
    return F.translate(c, "01i|", "olll")


def words(c: Column) -> Column:
    return F.regexp_extract_all(folded(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def short_words(c: Column) -> Column:
    """Words ended by a full stop: they may be cut short."""
    return F.regexp_extract_all(folded(c), F.lit(r"([\p{L}]{3,})\."), F.lit(1))


def runs(ws: Column, longest: int) -> Column:
    """Each run of 1..longest neighbouring words, written together."""
    n = F.size(ws)
    each = F.transform(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
        lambda i: F.transform(F.sequence(F.lit(1), F.greatest(F.least(F.lit(longest), n - i + 1), F.lit(1))), lambda k: F.array_join(F.slice(ws, i, k), "")),
    )
    return F.array_distinct(F.filter(F.flatten(each), lambda t: F.length(t) > 0))


def deletions(t: Column) -> Column:
    """The token and all texts made by leaving one character out."""
    gone = F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.lit(1 << 30))))
    return F.array_distinct(F.concat(F.array(t), gone))


def one_edit(a: Column, b: Column) -> Column:
    """At most one wrong, missing, extra or swapped character."""
    swap = F.exists(
        F.sequence(F.lit(1), F.greatest(F.length(a) - 1, F.lit(1))),
        lambda i: F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, F.lit(1 << 30))) == b,
    )
    return (F.levenshtein(a, b, 1) >= 0) | ((F.length(a) == F.length(b)) & swap)


def entry_forms(canon: DataFrame) -> DataFrame:
    """(field_name, canon_id, form, vtoken, weight, rare, norm, alone, word, unseen): each name of each entry, once as a bag of
    words weighted by rarity and once written together. rare: the rarest words of the form, without all of
    which a cell falls short of ACCEPT. word: vtoken is one word. unseen: the weight of a word that is in no name."""
    names = canon.select(
        "field_name", "canon_id", F.explode(F.concat(F.array("canonical"), F.split(F.coalesce("alt_names", F.lit("")), ";"))).alias("name")
    ).withColumn("name", F.trim("name")).filter("name <> ''").distinct()
    named = names.select("field_name", "canon_id", "name", words(F.col("name")).alias("ws")).filter(F.size("ws") > 0)
    n = named.select("field_name", "name").distinct().groupBy("field_name").agg(F.count(F.lit(1)).alias("n"))
    w = named.select("field_name", "canon_id", "name", "ws", F.explode(F.array_distinct("ws")).alias("vtoken"))
    k = w.groupBy("field_name", "vtoken").agg(F.count(F.lit(1)).alias("k"))
    w = w.join(k, ["field_name", "vtoken"]).join(n, "field_name").withColumn("weight", F.log1p(F.col("n") / F.col("k")))
    by = w.groupBy("field_name", "canon_id", "name", "ws", F.log1p("n").alias("unseen")).agg(F.sort_array(F.collect_list(F.struct("weight", "vtoken")), asc=False).alias("o"))  # one name's words
    by = by.withColumn("norm", F.sqrt(F.aggregate("o", F.lit(0.0), lambda t, x: t + x["weight"] * x["weight"])))
    before = lambda i: F.aggregate(F.slice("o", 1, i), F.lit(0.0), lambda t, x: t + x["weight"] * x["weight"])
    rare = F.transform("o", lambda x, i: F.struct(x["weight"].alias("weight"), x["vtoken"].alias("vtoken"), (before(i) <= (1 - ACCEPT) * F.col("norm") * F.col("norm")).alias("rare")))
    plain = F.forall("ws", lambda x: (F.length(x) >= 2) & x.rlike(r"\p{L}")) & (F.size("o") > 1)
    bags = by.filter(plain).select("field_name", "canon_id", F.concat(F.lit("b:"), "name").alias("form"), F.explode(rare).alias("x"), "norm", F.lit(False).alias("alone"), F.lit(True).alias("word"), "unseen")
    whole = F.struct(F.col("norm").alias("weight"), F.array_join("ws", "").alias("vtoken"), F.lit(True).alias("rare"))
    wholes = by.select("field_name", "canon_id", F.concat(F.lit("w:"), "name").alias("form"), whole.alias("x"), "norm", F.lit(True).alias("alone"), (F.size("ws") == 1).alias("word"), "unseen")
    return bags.unionByName(wholes).select("field_name", "canon_id", "form", "x.*", "norm", "alone", "word", "unseen")


def repaired_tokens(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """(field_name, token, short, vtoken, sim): each distinct token with the vocabulary tokens it may stand
    for. tokens: (field_name, token, short); vocab: (field_name, vtoken, alone, word). A word cut short stands
    for words only, not for the beginning of several words written together."""
    letters = lambda c: c.rlike(r"^\p{L}+$")
    keys = lambda t, extra: F.array_distinct(F.concat(F.array(F.concat(F.lit("f:"), confusable(t))), extra))
    edits = lambda t: F.when(letters(t) & (F.length(t) >= MIN_EDIT - 1), F.transform(deletions(t), lambda x: F.concat(F.lit("d:"), x))).otherwise(F.array().cast("array<string>"))
    prefixes = F.when(
        F.col("word") & letters(F.col("vtoken")) & (F.length("vtoken") >= 5),
        F.transform(F.sequence(F.lit(3), F.greatest(F.length("vtoken") - 1, F.lit(3))), lambda n: F.concat(F.lit("p:"), F.substring(F.col("vtoken"), F.lit(1), n))),
    ).otherwise(F.array().cast("array<string>"))
    left = tokens.withColumn(
        "key", F.explode(keys(F.col("token"), F.concat(edits(F.col("token")), F.when(F.col("short"), F.array(F.concat(F.lit("p:"), "token"))).otherwise(F.array().cast("array<string>")))))
    )
    right = vocab.withColumn("key", F.explode(keys(F.col("vtoken"), F.concat(edits(F.col("vtoken")), prefixes))))
    t, v = F.col("token"), F.col("vtoken")
    enough = F.length(v) >= F.when(F.col("alone"), MIN_EDIT_ALONE).otherwise(MIN_EDIT)
    sim = (
        F.when(t == v, 1.0)
        .when(confusable(t) == confusable(v), 0.98)
        .when(enough & letters(t) & letters(v) & one_edit(t, v), 1 - 1 / F.length(v))
        .when(F.col("short") & F.col("word") & v.startswith(t), 0.85)
    )
    return left.join(right, ["field_name", "key"]).withColumn("sim", sim).filter("sim is not null").groupBy("field_name", "token", "short", "vtoken").agg(F.max("sim").alias("sim"))


def ranked_entries(cells: DataFrame, canon: DataFrame) -> DataFrame:
    """(field_name, cell, canon_id, form, held, score) of the entries that each distinct (field_name, cell) names.

    held: share of the form's squared weights that the cell's repaired words hold, at least ACCEPT. score: soft
    TF-IDF of cell and form; words of the cell that are in no name count in its length, so they lower it.
    """
    forms = cut(entry_forms(canon))
    size = forms.agg(F.max(F.size(F.split("form", r"[^\p{L}\p{N}]+"))).alias("words"), F.max(F.length("vtoken")).alias("letters")).first()
    ws = words(F.col("cell"))
    typed = cells.select("field_name", "cell", F.explode(runs(ws, int(size.words or 1))).alias("token"), short_words(F.col("cell")).alias("sw"), F.size(F.array_distinct(ws)).alias("n_words"))
    # a repair changes the length by one at most
    typed = typed.filter(F.length("token") <= (size.letters or 0) + 1)
    typed = cut(typed.select("field_name", "cell", "token", F.array_contains("sw", F.col("token")).alias("short"), "n_words"))
    fixed = repaired_tokens(typed.select("field_name", "token", "short").distinct(), forms.groupBy("field_name", "vtoken").agg(F.min("alone").alias("alone"), F.max("word").alias("word")))
    hits = cut(typed.join(fixed, ["field_name", "token", "short"]).groupBy("field_name", "cell", "vtoken").agg(F.max("sim").alias("sim"), F.max("n_words").alias("n_words")))
    maybe = hits.join(forms.filter("rare").select("field_name", "vtoken", "canon_id", "form"), ["field_name", "vtoken"]).select("field_name", "cell", "n_words", "canon_id", "form").distinct()
    w2 = F.col("weight") * F.col("weight")
    scored = (
        maybe.join(forms.drop("rare"), ["field_name", "canon_id", "form"])
        .join(hits.drop("n_words"), ["field_name", "cell", "vtoken"], "left")
        .groupBy("field_name", "cell", "canon_id", "form")
        .agg(
            F.sum(w2 * F.coalesce("sim", F.lit(0.0))).alias("dot"), F.sum(F.when(F.col("sim").isNotNull(), w2)).alias("own"), F.count("sim").alias("n"), F.first("norm").alias("norm"),
            F.first("alone").alias("alone"), F.first("n_words").alias("n_words"), F.first("unseen").alias("unseen"),
        )
        .withColumn("held", F.col("dot") / (F.col("norm") * F.col("norm"))).filter(F.col("held") >= ACCEPT - 1e-9)
    )
    # length of the cell: the words held by the form with their weights, each other one as a word never seen
    others = F.greatest(F.col("n_words") - F.when(F.col("alone"), F.size(words(F.col("form"))) - 1).otherwise(F.col("n")), F.lit(0))
    return scored.select("field_name", "cell", "canon_id", "form", "held", (F.col("dot") / (F.col("norm") * F.sqrt(F.col("own") + others * F.col("unseen") * F.col("unseen")))).alias("score"))


def map_cells(cells: DataFrame, canon: DataFrame) -> DataFrame:
    """(field_name, cell, canon_id) for distinct (field_name, cell); canon_id 0 where the cell names
    no entry, the smallest where it names several equally well."""
    hits = ranked_entries(cells, canon)
    best = hits.groupBy("field_name", "cell").agg(F.max(F.struct(F.round("score", 9).alias("score"), (-F.col("canon_id")).alias("neg"))).alias("b"))
    found = best.select("field_name", "cell", (-F.col("b.neg")).alias("canon_id"))
    return cells.select("field_name", "cell").join(found, ["field_name", "cell"], "left").select("field_name", "cell", F.coalesce("canon_id", F.lit(0)).cast("bigint").alias("canon_id"))


def map_to_canonical(df: DataFrame, id_col: str, fields: list[str], canon: DataFrame) -> DataFrame:
    """(id_col, field_name, canon_id) of every cell of `fields` that is neither null, a placeholder
    nor exactly a canonical of its field; 0 where it names no entry.

    Copies are combined before any shuffle. A frequent cell is joined back by a skew-aware join to
    a table with one row for each distinct cell. An empty table, or an empty list, gives defined
    results (no rows; all 0).
    """
    exact = canon.select("field_name", F.col("canonical").alias("cell")).distinct()
    stacked = df.select(
        F.col(f"`{id_col}`").alias("__id"), F.explode(F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f"`{f}`").cast("string").alias("cell")) for f in fields))).alias("x")
    ).select("__id", "x.field_name", "x.cell").filter(~is_placeholder(F.col("cell")))
    distinct = stacked.select("field_name", "cell").distinct().join(exact, ["field_name", "cell"], "left_anti")
    mapped = cut(map_cells(cut(distinct), canon))
    return stacked.join(mapped, ["field_name", "cell"]).select(F.col("__id").alias(id_col), "field_name", "canon_id")


def unmatched_report(mapped: DataFrame) -> DataFrame:
    """(field_name, n_cells, n_unmatched, share_unmatched)."""
    return mapped.groupBy("field_name").agg(
        F.count(F.lit(1)).alias("n_cells"), F.sum((F.col("canon_id") == 0).cast("bigint")).alias("n_unmatched"), F.round(F.avg((F.col("canon_id") == 0).cast("double")), 6).alias("share_unmatched")
    )
