"""Several values packed in one field: split them into one row per value, position kept.

Spans that must not be cut (quoted text, round brackets at any depth) are swapped for indexed placeholders,
the rest is split at the delimiters, the spans come back by array lookup, and the list is
exploded with its positions. Everything is a Spark expression: the operator is one narrow
stage without shuffle or Python, so skewed sources cost nothing extra.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions.text import is_placeholder, strip

#: Marks around the number of a quoted and of a bracketed span, and stand-ins for brackets that part nothing.
_O, _C, _OB, _CB, _IO, _IC = "\ue000", "\ue001", "\ue002", "\ue003", "\ue004", "\ue005"
_WORD = r"\p{L}\p{N}"
#: Quoted text, N/A, and the marks themselves should the data hold them (so no placeholder can collide
#: with data). Every repetition is possessive or over one class: the match needs no stack, however long a
#: span is. Adjacent quoted texts are one span, so doubled quotes inside a quoted text do not end it.
_QUOTES = (
    rf"""(?<![{_WORD}])(?:"[^"]*+"(?![{_WORD}]))++"""
    rf"""|(?<![{_WORD}])'[^']*'(?![{_WORD}])"""
    r"""|“[^”]*”|«[^»]*»|‘[^’]*’"""
    rf"""|(?i:(?<![{_WORD}])n/a(?![{_WORD}]))"""
    rf"""|[{_O}{_C}{_OB}{_CB}{_IO}{_IC}]"""
)
#: Round brackets without others inside; deeper ones have become stand-ins before.
_BRACKETS = r"\([^()]*+\)"
#: Delimiters: list signs, line ends and tabs; a comma unless between two digits; a plus unless
#: it is the sign of a charge (right after letter and digits, not before a further letter or digit);
#: the word "and".
_DELIM = (
    r"[;；|、，/&\t\n\r\u000b\u000c\u0085\u2028\u2029]"
    r"|(?<!\p{N}),|,(?!\p{N})"
    rf"|(?<!\p{{L}}\p{{N}}{{1,2}})\+|(?<=\p{{L}}\p{{N}}{{1,2}})\+(?=[{_WORD}])"
    rf"|(?i:(?<![{_WORD}\-])and(?![{_WORD}\-]))"
)
_QUOTED = r"""(?s)^(?:"(.*)"|'(.*)'|“(.*)”|«(.*)»|‘(.*)’)$"""


def split_packed(c: Column, keep_placeholders: bool = False) -> Column:
    """Array of the values of one cell, in written order, repeated values kept.

    Null gives null. Empty places are dropped; placeholder words (NA, None, ...) too unless
    keep_placeholders. Square brackets around the whole list go; quotes around a value go;
    an unclosed quote or bracket is ordinary text.
    """
    # a cell of letters, digits and hyphens alone is one value; most cells are
    plain = F.filter(F.array(c), lambda v: (F.length(v) > 0) if keep_placeholders else ~is_placeholder(v))
    return F.when(c.rlike(r"^[\p{L}\p{N}\-]*\z"), plain).otherwise(_split_full(c, keep_placeholders))


def _outermost(s: Column) -> Column:
    """s with all brackets but the outermost closed ones as stand-ins, at any depth: closing brackets without their
    opening one are found from the left, opening ones without their closing one from the right."""
    signs, state = F.regexp_extract_all(s, F.lit(r"[()]"), F.lit(0)), F.struct(F.lit(0).alias("deep"), F.lit("").alias("out"))

    def from_left(a: Column, x: Column) -> Column:
        deep, out = a["deep"], a["out"]
        return F.when(x == "(", F.struct((deep + 1).alias("deep"), F.concat(out, F.lit("(")).alias("out"))).otherwise(
            F.struct(F.greatest(deep - 1, F.lit(0)).alias("deep"), F.concat(out, F.when(deep > 0, ")").otherwise("-")).alias("out"))
        )

    def from_right(a: Column, x: Column) -> Column:
        deep, out = a["deep"], a["out"]
        closing = F.struct((deep + 1).alias("deep"), F.concat(out, F.when(deep == 0, ")").otherwise(_IC)).alias("out"))
        opening = F.struct(F.greatest(deep - 1, F.lit(0)).alias("deep"), F.concat(out, F.when(deep == 1, "(").otherwise(_IO)).alias("out"))
        return F.when(x == ")", closing).when(x == "(", opening).otherwise(F.struct(deep.alias("deep"), F.concat(out, F.lit(_IC)).alias("out")))

    each = lambda c: F.regexp_extract_all(c, F.lit("."), F.lit(0))
    left = F.aggregate(signs, state, from_left)["out"]
    kinds = F.reverse(each(F.aggregate(F.reverse(each(left)), state, from_right)["out"]))
    part = F.transform(F.array(F.struct(F.split(s, r"[()]", -1).alias("p"), kinds.alias("k"))), lambda z: F.array_join(F.transform(z["p"], lambda p, i: F.concat(F.coalesce(F.get(z["k"], i - 1), F.lit("")), p)), ""))[0]
    return F.when(s.rlike(r"\([^()]*+\("), part).otherwise(s)


def _taken_out(s: Column, pattern: str, opening: str, closing: str) -> tuple[Column, Column]:
    """(spans, s with each span as its number between the marks)."""
    numbered = F.transform(F.split(s, pattern, -1), lambda p, i: F.concat(F.when(i > 0, F.concat(F.lit(opening), i - 1, F.lit(closing))).otherwise(""), p))
    return F.regexp_extract_all(s, F.lit(pattern), F.lit(0)), F.array_join(numbered, "")


def _put_back(s: Column, spans: Column, opening: str, closing: str) -> Column:
    ids = F.regexp_extract_all(s, F.lit(rf"{opening}(\d+){closing}"), F.lit(1))
    text = F.split(s, rf"{opening}\d+{closing}", -1)
    at = lambda z, p, i: F.concat(F.when(i > 0, F.get(spans, F.get(z["i"], i - 1).cast("int"))).otherwise(""), p)
    back = _bound(F.struct(ids.alias("i"), text.alias("t")), lambda z: F.array_join(F.transform(z["t"], lambda p, i: at(z, p, i)), ""))
    return F.when(s.contains(opening), back).otherwise(s)


def _bound(value: Column, then) -> Column:
    """then(value), value computed once."""
    return F.transform(F.array(value), then)[0]


def _split_full(c: Column, keep_placeholders: bool) -> Column:
    s = F.regexp_replace(strip(c), r"(?s)^[\s,;]*+\[([^\[\]]*+)\][\s,;]*+$", "$1")

    def brackets(quoted: Column) -> Column:
        spans, marked = _taken_out(quoted["s"], _BRACKETS, _OB, _CB)
        return F.struct(quoted["q"].alias("q"), F.when(quoted["s"].contains("("), spans).otherwise(F.array().cast("array<string>")).alias("b"), F.when(quoted["s"].contains("("), marked).otherwise(quoted["s"]).alias("s"))

    def quotes(t: Column) -> Column:
        spans, marked = _taken_out(t, _QUOTES, _O, _C)
        return F.struct(spans.alias("q"), _bound(marked, _outermost).alias("s"))

    return _bound(_bound(_bound(s, quotes), brackets), lambda st: _restore(st, keep_placeholders))


def _restore(st: Column, keep: bool) -> Column:
    def one(part: Column) -> Column:
        whole = strip(F.translate(_put_back(_put_back(part, st["b"], _OB, _CB), st["q"], _O, _C), _IO + _IC, "()"))
        # one quoted span and nothing else: the quotes around the value go
        return F.when(part.contains(_O) & strip(part).rlike(rf"^{_O}\d+{_C}$"), strip(F.regexp_replace(whole, _QUOTED, "$1$2$3$4$5"))).otherwise(whole)

    values = F.transform(F.split(st["s"], _DELIM, -1), one)
    return F.filter(values, lambda v: (F.length(v) > 0) if keep else ~is_placeholder(v))


def explode_packed(df: DataFrame, id_col: str, cell_col: str, out_col: str = "value", at_least: int = 2) -> DataFrame:
    """(id_col, pos, out_col) of every cell with at least `at_least` values; pos counts from 1.

    Null and placeholder cells give no rows; rows that repeat an id give their values again;
    other columns of df are neither needed nor read.
    """
    # plain names inside, so that columns of df called pos or value cannot clash
    cells = df.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{cell_col}`").alias("__cell")).filter(~is_placeholder(F.col("__cell")))
    lists = cells.select("__id", split_packed(F.col("__cell")).alias("__vals")).filter(F.size("__vals") >= at_least)
    return lists.select("__id", F.posexplode("__vals").alias("__p", "__v")).select(
        F.col("__id").alias(id_col), (F.col("__p") + 1).cast("int").alias("pos"), F.col("__v").alias(out_col)
    )
