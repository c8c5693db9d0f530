"""Group-wise filling and collision resolution.

Group figures come from aggregates (combined before the shuffle) joined back, not from windows, so a
group that holds a third of all rows is never sorted in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def same_keys(a: DataFrame, b: DataFrame, left: Sequence[str], right: Sequence[str]) -> Column:
    """Null-safe equality of key lists."""
    return reduce(lambda x, y: x & y, (a[f"`{p}`"].eqNullSafe(b[f"`{q}`"]) for p, q in zip(left, right)))


def propagate_unique(df: DataFrame, value: str, outer: str, inner: str) -> DataFrame:
    """Nulls of value filled with the only distinct value of (outer, inner), else with the only one of
    outer. Null keys are groups of their own.

    The inner pass only adds values that the outer group already holds, so both passes are
    decided from the original column: one aggregate, rolled up once.
    """
    fine = df.groupBy(_q(outer).alias("__o"), _q(inner).alias("__i")).agg(F.min(_q(value)).alias("__lo"), F.max(_q(value)).alias("__hi"))
    coarse = fine.groupBy(F.col("__o").alias("__oo")).agg(F.min("__lo").alias("__clo"), F.max("__hi").alias("__chi"))
    only = fine.join(coarse, F.col("__o").eqNullSafe(F.col("__oo")))
    fill = F.when(F.col("__lo") == F.col("__hi"), F.col("__lo")).when(F.col("__clo") == F.col("__chi"), F.col("__clo"))
    only = only.select("__o", "__i", fill.alias("__fill")).filter("__fill is not null")
    joined = df.join(only, _q(outer).eqNullSafe(F.col("__o")) & _q(inner).eqNullSafe(F.col("__i")), "left")
    return joined.select(*(F.coalesce(_q(c), F.col("__fill")).alias(c) if c == value else _q(c) for c in df.columns))


def collision_groups(df: DataFrame, keys: Sequence[str], target: str, row_id: str, limit: float) -> DataFrame:
    """One row for each key: first id, size, target range, median, and whether it is unresolved (more than one
    row and a range above limit). Null keys are equal."""
    t = _q(target)
    return df.groupBy(*(_q(k).alias(f"__k{i}") for i, k in enumerate(keys))).agg(
        F.min(_q(row_id)).alias("__first"), F.count(F.lit(1)).cast("int").alias("__n"), (F.max(t) - F.min(t)).alias("__range"), F.median(t).alias("__median")
    ).withColumn("__clash", (F.col("__n") > 1) & F.coalesce(F.col("__range") > limit, F.lit(False)))


#: Most ids that one text lists; larger groups are told in full by collision_members.
LISTED = 1_000_000


def collision_members(df: DataFrame, keys: Sequence[str], row_id: str) -> DataFrame:
    """(row_id, first_id, n) of every row in a group of more than one: the group's first row and size. One row a
    member, so a group of any size is spread over tasks."""
    g = df.groupBy(*(_q(k).alias(f"__k{i}") for i, k in enumerate(keys))).agg(F.min(_q(row_id)).alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    cond = reduce(lambda x, y: x & y, (_q(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)))
    return df.select(_q(row_id), *(_q(k) for k in keys if k != row_id)).join(g, cond).select(_q(row_id), "first_id", "n")


def resolve_collisions(df: DataFrame, keys: Sequence[str], target: str, row_id: str, limit: float = 5.0, listed: int = LISTED) -> tuple[DataFrame, DataFrame]:
    """(kept, audit).

    kept: groups of one as they are, and of each larger group whose target range is at most limit its first
    row (smallest row_id) with the group's median as target; plus Replicate_Count,
    Replicate_Target_Range and Original_Row_IDs (";"-joined ids of merged groups, else null; groups of more than
    `listed` rows have the first id and a count, collision_members has their ids).
    audit: every row of the other groups, with Collision_Target_Range and Collision_Reason.
    """
    g = collision_groups(df, keys, target, row_id, limit)
    ks = [f"__k{i}" for i in range(len(keys))]
    cond = reduce(lambda x, y: x & y, (_q(k).eqNullSafe(F.col(n)) for k, n in zip(keys, ks)))
    members = df.join(g, cond)
    row = F.struct(*(_q(c) for c in df.columns))
    ids = F.array_sort(F.collect_list(F.when((F.col("__n") > 1) & (F.col("__n") <= listed), _q(row_id))))
    one = members.filter("not __clash").groupBy(*ks).agg(
        F.min_by(row, _q(row_id)).alias("__row"), *(F.max(c).alias(c) for c in ("__n", "__range", "__median")), ids.alias("__ids")
    )
    many = F.col("__n") > 1
    kept = one.select(
        *(F.when(many, F.col("__median")).otherwise(F.col(f"__row.`{c}`")).alias(c) if c == target else F.col(f"__row.`{c}`").alias(c) for c in df.columns),
        F.col("__n").alias("Replicate_Count"), F.when(many, F.col("__range")).otherwise(0.0).alias("Replicate_Target_Range"),
        F.when(F.col("__n") > listed, F.concat(F.col(f"__row.`{row_id}`").cast("string"), F.lit(" and "), (F.col("__n") - 1).cast("string"), F.lit(" more")))
        .when(many, F.array_join(F.transform("__ids", lambda x: x.cast("string")), ";")).alias("Original_Row_IDs"),
    )
    audit = members.filter("__clash").select(
        *(_q(c) for c in df.columns), F.col("__range").alias("Collision_Target_Range"), F.lit("same_recorded_conditions_target_range_above_limit").alias("Collision_Reason")
    )
    return kept, audit
