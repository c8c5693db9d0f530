"""Global numbering and ranking without a single-partition sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.session import cut


def global_index(df: DataFrame, order: list[str | Column], out: str) -> DataFrame:
    """df with out = 0, 1, 2, ... in the given total order.

    Range-partitioned sort, then one offset for each partition: only the partitions' row counts
    reach the driver. The order must end in a unique column for a reproducible result.
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    sorted_ = cut(df.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn("__m", F.monotonically_increasing_id()))
    pid = F.shiftright("__m", 33)
    counts = dict(sorted_.groupBy(pid.alias("p")).count().collect())
    offsets, at = [], 0
    for p in sorted(counts):
        offsets.append((p, at))
        at += counts[p]
    table = F.broadcast(df.sparkSession.createDataFrame(offsets, "__p bigint, __o bigint"))  # one row a partition
    return (
        sorted_.withColumn("__p", pid).join(table, "__p").withColumn(out, F.col("__o") + F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))).drop("__p", "__o", "__m")
    )


def position_in_group(df: DataFrame, group: str, order: list[str | Column], out: str) -> DataFrame:
    """df with out = 0, 1, 2, ... inside each group (null is a group). The sort is range-partitioned over
    group and order together, so a hot group is spread over several tasks."""
    at = global_index(df, [F.col(f"`{group}`"), *order], "__at")
    first = at.groupBy(F.col(f"`{group}`").alias("__g")).agg(F.min("__at").alias("__lo"))
    return at.join(first, F.col(f"`{group}`").eqNullSafe(F.col("__g"))).withColumn(out, F.col("__at") - F.col("__lo")).drop("__g", "__lo", "__at")


def running_max(df: DataFrame, group: str, order: list[str | Column], value: str, out: str) -> DataFrame:
    """df with out = the largest value so far inside its group (null is a group; null values count for nothing). The
    sort is range-partitioned over group and order together, and each partition hands on one maximum a group,
    so a hot group is spread over several tasks."""
    cols = [F.col(f"`{group}`"), *(F.col(c) if isinstance(c, str) else c for c in order)]
    s = cut(df.repartitionByRange(*cols).select("*", F.spark_partition_id().alias("__p"), F.struct(*cols).alias("__o")))
    q, g = F.col(f"`{value}`"), F.col(f"`{group}`")
    inside = Window.partitionBy("__p", g).orderBy("__o").rowsBetween(Window.unboundedPreceding, 0)  # a partition's part of a group
    tops = s.groupBy("__p", g.alias("__g")).agg(F.max(q).alias("__m"))
    before = Window.partitionBy("__g").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition of a group
    tops = tops.select(F.col("__p").alias("__q"), "__g", F.max("__m").over(before).alias("__carry")).filter("__carry is not null")
    j = s.join(tops, (F.col("__p") == F.col("__q")) & g.eqNullSafe(F.col("__g")), "left")
    return j.withColumn(out, F.greatest(F.max(q).over(inside), F.col("__carry"))).drop("__p", "__o", "__q", "__g", "__carry")


def competition_rank(df: DataFrame, value: str, row_id: str, out: str) -> DataFrame:
    """Descending rank, equal values share the smallest rank."""
    at = global_index(df, [F.desc(value), row_id], "__at")
    first = at.groupBy(F.col(value).alias("__v")).agg(F.min("__at").alias("__lo"))
    return at.join(first, F.col(value).eqNullSafe(F.col("__v"))).withColumn(out, F.col("__lo") + 1).drop("__v", "__lo", "__at")


def top_k(df: DataFrame, group: str, order: list[Column], k: int, out: str = "Rank") -> DataFrame:
    """First k rows of each group. Spark cuts each partition to k rows a group before the shuffle."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col(out) <= k)


def largest_by_count(counts: DataFrame, count: str, tie: list[str], least: int, fallback: int = 5) -> DataFrame:
    """Rows with at least `least`; if there are none, the `fallback` largest (first on ties)."""
    enough = counts.filter(F.col(count) >= least)
    any_enough = enough.limit(1).agg((F.count(F.lit(1)) > 0).alias("__any"))  # one row
    largest = counts.orderBy(F.desc(count), *tie).limit(fallback).crossJoin(F.broadcast(any_enough)).filter("not __any").drop("__any")
    return enough.unionByName(largest)
