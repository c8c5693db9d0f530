"""Row-local rules compiled to columns: parsing, guards, classifiers, list cells, row sums.

None of them needs a Python function on rows; they run unchanged on batches and streams.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from spindrift.functions.text import strip

_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def parse_bool(c: Column, true: Iterable[str], false: Iterable[str]) -> Column:
    """Three-valued: a true word, a false word (null counts as ""), else null."""
    w = F.lower(strip(F.coalesce(c, F.lit(""))))
    return F.when(w.isin(*true), True).when(w.isin(*false), False)


def parse_number(c: Column) -> Column:
    """Plain decimal or scientific notation; anything else (units, "1d", NaN, inf) gives null."""
    s = strip(c)
    return F.when(s.rlike(_NUMBER), s.try_cast("double"))


def out_of_range(c: Column, low: float, high: float) -> Column:
    """1 where a value is present and outside the inclusive range, else 0."""
    return (c.isNotNull() & ~F.coalesce(c.between(low, high), F.lit(False))).cast("int")


def within_or_null(c: Column, low: float, high: float) -> Column:
    return F.when(c.between(low, high), c)


def guard_ranges(df, ranges: Mapping[str, tuple[float, float]], suffix: str = "_range_flag"):
    """Every named column nulled outside its range, with a flag column each, in one projection."""
    flags = {f"{c}{suffix}": out_of_range(quoted(c), *r) for c, r in ranges.items()}
    kept = [within_or_null(quoted(c), *ranges[c]).alias(c) if c in ranges else quoted(c) for c in df.columns if c not in flags]
    return df.select(*kept, *(f.alias(n) for n, f in flags.items()))


def first_match(text: Column, rules: Sequence[tuple[str, Sequence]], default: Column) -> Column:
    """Label of the first rule with an alternative that occurs in text; an alternative is a
    substring or a tuple of substrings that must all occur."""

    def holds(alt) -> Column:
        parts = (alt,) if isinstance(alt, str) else alt
        return reduce(lambda a, b: a & b, (F.instr(text, p) > 0 for p in parts))

    out = None
    for label, alternatives in rules:
        cond = reduce(or_, (holds(a) for a in alternatives))
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return default if out is None else out.otherwise(default)


def classify_support(c: Column, rules, no_labels: Sequence[str]) -> Column:
    """Ordered support classifier: subscripts read as digits, white space ignored; null is Unknown,
    other texts that match no rule are Other. The bare abbreviation CN is a label too, at the place
    of its rule in the order."""
    digits = F.translate(c, "₂₃₄", "234")
    s = F.regexp_replace(F.lower(digits), r"(?U)\s+", "")
    at = [label for label, _ in rules].index("CN")
    rest = first_match(s, rules[at + 1 :], F.when(s.isin(*no_labels), "Unknown").otherwise("Other"))
    cn = F.when(F.upper(strip(digits)) == "CN", "CN").otherwise(rest)
    return F.when(c.isNull(), "Unknown").otherwise(first_match(s, rules[: at + 1], cn))


def classify_method(c: Column, label: Column, rules) -> Column:
    """Ordered method classifier over value and label together; blank text is Unknown, else Other."""
    parts = F.concat_ws(" ", F.when(c != "", c), F.when(label != "", label))
    s = F.lower(parts)
    return first_match(s, rules, F.when(F.length(strip(s)) == 0, "Unknown").otherwise("Other"))


def token_list(c: Column, invalid: Sequence[str], no_labels: Sequence[str], delimiters: str = "[,/;]", sep: str = ",") -> Column:
    """Items of a list cell without blanks and invalid items, order and repeats kept, joined again;
    null where nothing is left or the whole cell is a "not given" word."""
    items = F.transform(F.split(c, delimiters), strip)
    kept = F.filter(items, lambda x: (F.length(x) > 0) & ~F.lower(x).isin(*invalid))
    return F.when(~F.lower(strip(c)).isin(*no_labels), F.nullif(F.array_join(kept, sep), F.lit("")))


def first_number(c: Column, patterns: Sequence[str], low: float, high: float) -> Column:
    """Number of the first pattern that occurs, if above low and at most high; a rejected number does
    not fall through to the next pattern."""
    out = None
    for p in patterns:
        v = F.regexp_extract(c, p, 1).try_cast("double")
        out = F.when(c.rlike(p), v) if out is None else out.when(c.rlike(p), v)
    return F.when((out > low) & (out <= high), out)


def trailing_number(c: Column) -> Column:
    """Number in round brackets at the end of a label, else null."""
    return F.nullif(F.regexp_extract(c, r"\((\d+(?:\.\d+)?)\)\s*$", 1), F.lit("")).try_cast("double")


def default_text(c: Column, default: str = "Unknown") -> Column:
    return F.coalesce(F.nullif(strip(c), F.lit("")), F.lit(default))


def recode(c: Column, names: Mapping[str, str]) -> Column:
    """Whole values looked up in lower case; unknown ones stay in lower case."""
    low = F.lower(c)
    pairs = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    return F.coalesce(F.try_element_at(pairs, low), low)


def row_sum(cols: Sequence[Column]) -> Column:
    """Sum that skips nulls; null only if all are null."""
    return F.when(F.coalesce(*cols).isNotNull(), reduce(lambda a, b: a + b, (F.coalesce(c, F.lit(0.0)) for c in cols)))


def null_count(cols: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, (c.isNull().cast("int") for c in cols))


def clip(c: Column, low, high) -> Column:
    """Into [low, high]; null stays null."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def near_bound(c: Column, low: Column, high: Column, share: float = 0.02) -> Column:
    """Within a share of the span of either bound."""
    span = F.greatest(high - low, F.lit(1e-9))
    return ((c - low) / span <= share) | ((high - c) / span <= share)


def penalised(raw: Column, within: Column, out_of_bounds: Column, outside: float = 100.0, beyond: float = 200.0) -> Column:
    return raw - F.when(within, 0.0).otherwise(outside) - F.when(out_of_bounds, beyond).otherwise(0.0)


def relabel(c: Column, steps: Sequence[tuple[str, str]]) -> Column:
    """Ordered literal replacements."""
    for old, new in steps:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c
