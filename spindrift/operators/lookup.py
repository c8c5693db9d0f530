"""Dimension lookups and checked joins."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A dimension with more rows is joined by shuffle instead of broadcast.
MAX_BROADCAST_ROWS = 50_000


def lookup(df: DataFrame, key: str, dim: DataFrame, dim_key: str, defaults: Mapping[str, object]) -> DataFrame:
    """df with the columns `defaults` of dim, its default where the key is null or unknown. The first
    of several dim rows with one key counts (dimensions should have one)."""
    cols = list(defaults)
    small = dim.select(F.col(f"`{dim_key}`").alias("__dk"), *(F.col(f"`{c}`").alias(f"__d_{c}") for c in cols)).dropDuplicates(["__dk"])
    if small.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS:
        small = F.broadcast(small)
    out = df.join(small, F.col(f"`{key}`") == F.col("__dk"), "left")
    kept = [c for c in df.columns if c not in cols]
    found = [(F.col(f"`__d_{c}`") if d is None else F.coalesce(F.col(f"`__d_{c}`"), F.lit(d))).alias(c) for c, d in defaults.items()]
    return out.select(*(F.col(f"`{c}`") for c in kept), *found)


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(F.col(f"`{key}`").alias(key)).count().filter("count > 1")


def join_one_to_one(left: DataFrame, right: DataFrame, key: str, check: bool = True) -> DataFrame:
    """Left join on a key that must be unique on both sides."""
    if check:
        for name, df in (("left", left), ("right", right)):
            if not duplicate_keys(df, key).isEmpty():
                raise ValueError(f"{key} is not unique on the {name} side")
    return left.join(right, key, "left")


def key_coverage(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side) of keys that only one side holds; empty if the key sets are equal."""
    x, y = a.select(key).distinct(), b.select(key).distinct()
    return x.join(y, key, "left_anti").withColumn("side", F.lit("left")).unionByName(y.join(x, key, "left_anti").withColumn("side", F.lit("right")))
