"""Column functions on text; all of them stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that stand for "no value", in any letter case.
PLACEHOLDERS = ("", "na", "n/a", "none", "nan", "null")

# White space of Unicode, zero-width signs included.
BLANKS = " \t\n\r\u000b\u000c\u001c\u001d\u001e\u001f\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u200b\u2028\u2029\u202f\u205f\u3000\ufeff"

#: Stands for a decimal point while signs are dropped; a private-use character, removed from data first.
POINT = "\ue000"


def strip(c: Column) -> Column:
    """Outer white space off, Unicode white space included (Spark's trim knows only the blank)."""
    return F.trim(c, F.lit(BLANKS))


def is_placeholder(c: Column) -> Column:
    """True for null, blank and the placeholder words."""
    return c.isNull() | F.lower(strip(c)).isin(*PLACEHOLDERS)


def bare(c: Column) -> Column:
    """Lower-case letters and digits only; null stays null."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")


def bare_decimal(c: Column) -> Column:
    """As bare(), but a point between two digits counts ("2.5" and "25" differ)."""
    s = F.regexp_replace(F.lower(c), rf"(?U)[\s\u00a0\u200b\ufeff{POINT}]+", "")
    s = F.regexp_replace(s, r"(?<=\p{N})\.(?=\p{N})", POINT)
    return F.regexp_replace(s, rf"[^\p{{L}}\p{{N}}{POINT}]+", "")
