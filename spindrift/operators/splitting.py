"""Strata, reproducible splits, folds and subsets.

Order is drawn by md5 of seed and row id: independent of partitioning, and the same in any SQL engine.
"""

from __future__ import annotations

import itertools
import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.operators.ranking import global_index, position_in_group


def draw(seed: int | Column, row_id: str) -> Column:
    s = F.lit(str(seed)) if isinstance(seed, int) else seed.cast("string")
    return F.md5(F.concat_ws("|", s, F.col(row_id).cast("string")))


def strata(df: DataFrame, column: str, least: int = 4, rare: str = "rare_sources", out: str = "Source_Stratum") -> DataFrame:
    """df with the column's value, or `rare` where fewer than `least` rows share it; null is counted as a value."""
    n = df.groupBy(F.col(f"`{column}`").alias("__s")).agg(F.count(F.lit(1)).alias("__n"))
    j = df.join(n, F.col(f"`{column}`").eqNullSafe(F.col("__s")))
    return j.withColumn(out, F.when(F.col("__n") >= least, F.col(f"`{column}`")).otherwise(rare)).drop("__s", "__n")


def largest_remainder(counts: DataFrame, key: str, n: str, share: float, out: str = "quota") -> DataFrame:
    """counts with integer quotas: ceil(share * total) places in all, each key its whole part, the rest to the
    largest remainders (the smaller key on ties)."""
    total = counts.agg(F.sum(n).cast("bigint").alias("t")).first().t or 0
    places = -(-round(total * share * 1_000_000) // 1_000_000)
    exact = F.col(n) * F.lit(places) / F.lit(max(total, 1))
    c = counts.withColumn("__whole", F.floor(exact).cast("bigint")).withColumn("__rest", F.round(exact - F.floor(exact), 9))
    given = c.agg(F.sum("__whole").cast("bigint").alias("g")).first().g or 0
    at = global_index(c, [F.desc("__rest"), key], "__at")
    return at.withColumn(out, F.col("__whole") + (F.col("__at") < places - given).cast("bigint")).drop("__whole", "__rest", "__at")


def stratified_split(df: DataFrame, row_id: str, stratum: str, share: float = 0.2, seed: int = 42, out: str = "Set") -> DataFrame:
    """df with out = Test or Train: exactly ceil(share * rows) test rows, in proportion to the strata."""
    quota = largest_remainder(df.groupBy(F.col(stratum).alias("__st")).agg(F.count(F.lit(1)).alias("n")), "__st", "n", share)
    placed = position_in_group(df.withColumn("__h", draw(seed, row_id)), stratum, ["__h", row_id], "__pos")
    j = placed.join(quota.select("__st", "quota"), F.col(stratum).eqNullSafe(F.col("__st")))
    return j.withColumn(out, F.when(F.col("__pos") < F.col("quota"), "Test").otherwise("Train")).drop("__h", "__pos", "__st", "quota")


def repeated_splits(df: DataFrame, row_id: str, stratum: str, seeds: list[int], share: float = 0.2) -> DataFrame:
    """stratified_split for every seed, with a column Split_Seed."""
    out = None
    for s in seeds:
        one = stratified_split(df, row_id, stratum, share, s).withColumn("Split_Seed", F.lit(s))
        out = one if out is None else out.unionByName(one)
    return out


def folds(df: DataFrame, row_id: str, k: int = 5, seed: int = 42, out: str = "fold") -> DataFrame:
    """df with out = 0..k-1: rows in drawn order, dealt in turn, so folds differ by one row at most."""
    at = global_index(df.withColumn("__h", draw(seed, row_id)), ["__h", row_id], "__at")
    return at.withColumn(out, F.pmod("__at", F.lit(k)).cast("int")).drop("__h", "__at")


def subset_sizes(n: int, shares: list[float]) -> list[int]:
    return [int(n * s + 1e-9) for s in shares]


def draw_grid(space: dict[str, list], n: int, seed: int = 42) -> list[dict]:
    """n points of a finite grid without repetition, in drawn order (all, if it has fewer)."""
    keys = list(space)
    points = [dict(zip(keys, v)) for v in itertools.product(*space.values())]
    return sorted(points, key=lambda p: hashlib.md5(f"{seed}|{sorted(p.items())}".encode()).hexdigest())[:n]
