"""Routing, exclusion logs and fail-fast guards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def holds(c: Column) -> Column:
    """A condition with unknown read as false, so that it and its negation split the rows."""
    return F.coalesce(c, F.lit(False))


def first_reason(reasons: Sequence[tuple[str, Column]]) -> Column:
    """Name of the first condition that holds; null where none does."""
    out = None
    for name, cond in reasons:
        out = F.when(holds(cond), name) if out is None else out.when(holds(cond), name)
    return F.lit(None).cast("string") if out is None else out


def route(df: DataFrame, flag: Column) -> tuple[DataFrame, DataFrame]:
    """Rows with the flag, rows without it (unknown counts as without)."""
    return df.filter(holds(flag)), df.filter(~holds(flag))


def exclusion_log(parts: Sequence[tuple[DataFrame, str | Column]], id_columns: Sequence[str]) -> DataFrame:
    """One log of all parts: the id columns and the reason of each excluded row."""
    out = None
    for df, reason in parts:
        p = df.select(*(F.col(f"`{c}`") for c in id_columns), (F.lit(reason) if isinstance(reason, str) else reason).alias("Reason"))
        out = p if out is None else out.unionByName(p)
    if out is None:
        raise ValueError("no parts")
    return out


def check(df: DataFrame, rules: dict[str, Column]) -> None:
    """Raise if any row breaks a rule; all rules are counted in one pass."""
    bad = df.agg(*(F.sum((~holds(c)).cast("bigint")).alias(f"r{i}") for i, c in enumerate(rules.values()))).first()
    broken = {name: n for name, n in zip(rules, bad) if n}
    if broken:
        raise ValueError(f"rows breaking rules: {broken}")


def require_columns(df: DataFrame, names: Sequence[str], arity: int | None = None) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    if arity is not None and len(df.columns) != arity:
        raise ValueError(f"expected {arity} columns, found {len(df.columns)}")
