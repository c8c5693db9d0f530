"""Exact quantiles of whole columns without one task that sees every distinct value.

Spark's exact percentile keeps a map of all distinct values of a group in memory. Up to LARGE_ROWS rows (counted, not
fetched) that is the faster plan; beyond, values are counted (combined map-side), numbered by a range-partitioned
running count, and only the two values around each wanted rank are taken. Both are exact and interpolate
linearly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.session import cut

LARGE_ROWS = 1_000_000


def quantiles(df: DataFrame, columns: dict[str, Column], probs: Sequence[float], large: int = LARGE_ROWS) -> dict[str, list[float | None]]:
    """{name: one value for each prob}; None where a column has no value. Nulls are left out."""
    if not columns:
        return {}
    names = list(columns)
    if df.count() <= large:
        row = df.agg(*(F.percentile(columns[n].cast("double"), F.array(*(F.lit(float(p)) for p in probs))).alias(f"q{i}") for i, n in enumerate(names))).first()
        return {n: (list(row[f"q{i}"]) if row[f"q{i}"] is not None else [None] * len(probs)) for i, n in enumerate(names)}
    long = df.select(F.explode(F.array(*(F.struct(F.lit(i).alias("c"), columns[n].cast("double").alias("v")) for i, n in enumerate(names)))).alias("x")).select("x.*")
    counts = long.filter("v is not null").groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"))
    # running count: inside a range partition by window over its own number, before it by its offset
    part = counts.repartitionByRange("c", "v").withColumn("p", F.spark_partition_id())
    part = cut(part)
    sums = sorted(part.groupBy("p", "c").agg(F.sum("n").alias("s")).collect())  # one row a partition and column
    before, offsets, total = {}, [], {}
    for p, c, s in sums:
        offsets.append((p, c, before.get(c, 0)))
        before[c] = total[c] = before.get(c, 0) + s
    table = df.sparkSession.createDataFrame(offsets or [(-1, -1, 0)], "p int, c int, o bigint")
    w = Window.partitionBy("p", "c").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a partition's share of the distinct values
    at = part.withColumn("upto", F.sum("n").over(w)).join(F.broadcast(table), ["p", "c"]).withColumn("upto", F.col("upto") + F.col("o"))
    wanted = []
    for c, n in total.items():
        for k, p in enumerate(probs):
            pos = p * (n - 1)
            wanted += [(c, k, 0, int(pos)), (c, k, 1, min(int(pos) + 1, n - 1))]
    ranks = df.sparkSession.createDataFrame(wanted or [(-1, 0, 0, 0)], "c int, k int, side int, r bigint")
    hits = at.join(F.broadcast(ranks), "c").filter((F.col("r") < F.col("upto")) & (F.col("r") >= F.col("upto") - F.col("n"))).select("c", "k", "side", "v").collect()
    got = {(h.c, h.k, h.side): h.v for h in hits}
    out = {}
    for c, n in enumerate(names):
        vals: list[float | None] = []
        for k, p in enumerate(probs):
            if c not in total:
                vals.append(None)
                continue
            pos = p * (total[c] - 1)
            lo, hi = got[c, k, 0], got[c, k, 1]
            vals.append(lo + (hi - lo) * (pos - int(pos)))
        out[n] = vals
    return out
