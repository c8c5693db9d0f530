"""Problem 7: mix sources to target shares of the total size.

The total is cut into blocks of equal tokens; blocks are given to sources by highest quotients
(Sainte-Lague), no source beyond what it holds times its allowed repeats. Each source is spread over
shards by a hash of its records; its blocks are given to its shards the same way, in one small task a
source, and every shard takes its blocks from a seeded order of its records: blocks are stretches of that
order, so the first ones are a seeded choice. One row for each target source reaches the driver;
a source that holds a third of all rows is as many tasks as it has shards.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.llm.tokens import count_tokens
from spindrift.session import cut

#: Most tokens of a block, and fewest blocks of a mixture (smaller mixtures have smaller blocks).
BLOCK, BLOCKS = 512, 20_000
#: Tokens a shard should hold; most shards of one source; most target sources (one row each reaches the driver).
SHARD_TOKENS, MAX_SHARDS, MAX_SOURCES = 2_000_000, 65_536, 1_000_000
#: A target is met if the share reached differs from it by at most this part of it.
TOLERANCE = 0.01


def sainte_lague(weights: list[float], seats: int, caps: list[int]) -> list[int]:
    """Seats by highest quotients w / (2k + 1), none beyond its cap; the earlier of equal quotients
    first. The divisor is found by bisection, so time does not grow with the number of seats."""
    w, top = np.asarray(weights, dtype=float), np.asarray(caps, dtype=np.int64)
    seats = min(seats, int(top[w > 0].sum()))
    if seats <= 0:
        return [0] * len(weights)
    at = lambda d: np.where(w > 0, np.minimum(top, np.floor(np.minimum(w / d, 4e18) + 0.5).astype(np.int64)), 0)
    lo, hi = 0.0, 2.1 * float(w.max())  # at(hi) gives none
    for _ in range(300):
        mid = (lo + hi) / 2
        if mid in (lo, hi):
            break
        if int(at(mid).sum()) <= seats:
            hi = mid
        else:
            lo = mid
    got = at(hi * (1 + 1e-9)).tolist()  # equal quotients at the edge are left to the exact comparison below
    heap = [(-x / (2 * g + 1), i) for i, (x, g, c) in enumerate(zip(weights, got, caps)) if x > 0 and g < c]
    heapq.heapify(heap)
    left = seats - sum(got)
    while left and heap:
        _, i = heapq.heappop(heap)
        got[i] += 1
        left -= 1
        if got[i] < caps[i]:
            heapq.heappush(heap, (-weights[i] / (2 * got[i] + 1), i))
    return got


def _shard_quotas(pdf: pd.DataFrame) -> pd.DataFrame:
    """Tokens that each shard of one source (at most MAX_SHARDS rows) gives: its blocks, the last of which may be short."""
    pdf = pdf.sort_values("shard")
    t, r, block = pdf["t"], pdf["r"], int(pdf["block"].iloc[0])
    k = sainte_lague(t.astype(float).tolist(), int(pdf["seats"].iloc[0]), (-(-t * r // block)).tolist())
    tokens = np.minimum(np.asarray(k, dtype=np.int64) * block, t * r)
    return pd.DataFrame({"source": pdf["source"], "shard": pdf["shard"], "whole": (tokens // t).astype("int32"), "rest": tokens % t})


def mix(
    df: DataFrame, id_col: str, text_col: str, source_col: str, targets: DataFrame, total_tokens: int | None = None,
    seed: int = 42, block: int | None = None, vocab_path: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(mixture, report).

    mixture: (id_col, source, n_tokens, n_uses) of each record used at least once. report: (source,
    target_share, max_repeats, available_tokens, mixed_tokens, actual_share, target_met) of each
    target. targets: (source, target_share, max_repeats).

    total_tokens defaults to the tokens of all records of the targeted sources. Where a source cannot
    reach its share even with all repeats, it is used to its limit, the others keep their
    proportions, and the report shows the shares reached; target_met allows TOLERANCE of the target.
    A source of fewer tokens than a block is used like any other. block defaults to the total over
    BLOCKS, at most BLOCK. Records of other or null sources and records without tokens are not used; a target
    without records is reported with 0. Shares need not sum to 1; those of a source named twice are added, its larger
    number of repeats holds.
    """
    spark = df.sparkSession
    rows = targets.filter("source is not null").groupBy("source").agg(F.sum(F.greatest(F.col("target_share").cast("double"), F.lit(0.0))).alias("w"), F.greatest(F.max(F.col("max_repeats").cast("int")), F.lit(0)).alias("r"))
    want = sorted(rows.limit(MAX_SOURCES + 1).collect(), key=lambda x: x.source)
    if len(want) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    names = spark.createDataFrame([(x.source,) for x in want], "source string")
    wanted = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").cast("string").alias("source"), F.col(f"`{text_col}`").alias("text"))
    wanted = wanted.join(F.broadcast(names), "source", "left_semi")  # at most MAX_SOURCES names
    sized = cut(count_tokens(wanted, "text", ["id", "source"], vocab_path).filter("n_tokens > 0"))

    held = {r.source: r.t for r in sized.groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}
    shards = {s: max(1, min(MAX_SHARDS, -(-t // SHARD_TOKENS))) for s, t in held.items()}
    table = F.broadcast(spark.createDataFrame([(s, n) for s, n in shards.items()] or [("", 1)], "source string, shards int"))
    placed = sized.join(table, "source").withColumn("h", F.xxhash64(F.lit(seed), "id"))
    # repeated ids lie together, so the order inside a shard is settled by size
    placed = placed.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), "id"), F.col("shards")).cast("int")).drop("shards")
    total = total_tokens if total_tokens is not None else sum(held.values())
    block = block or max(1, min(BLOCK, total // BLOCKS))
    caps = [-(-held.get(x.source, 0) * (x.r or 0) // block) for x in want]  # a last block may be short
    seats = sainte_lague([(x.w or 0.0) for x in want], -(-total // block), caps)
    given = spark.createDataFrame([(x.source, n, (x.r or 0), block) for x, n in zip(want, seats) if n] or [("", 0, 0, 1)], "source string, seats bigint, r bigint, block bigint")
    per_shard = placed.groupBy("source", "shard").agg(F.sum("n_tokens").alias("t")).join(F.broadcast(given), "source")  # at most MAX_SOURCES rows
    quota = per_shard.groupBy("source").applyInPandas(_shard_quotas, "source string, shard int, whole int, rest bigint")
    order = Window.partitionBy("source", "shard").orderBy("h", "id", "n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    picked = placed.withColumn("end", F.sum("n_tokens").over(order)).join(quota, ["source", "shard"])
    # the rest of a quota takes the first records of the seeded order; a record over its edge counts
    # if at least half of it lies inside
    uses = F.col("whole") + (F.col("end") * 2 - F.col("n_tokens") <= F.col("rest") * 2).cast("int")
    mixture = cut(picked.select("id", "source", "n_tokens", uses.alias("n_uses")).filter("n_uses > 0"))

    used = mixture.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("n_uses")).alias("mixed_tokens"))
    share = sum((x.w or 0.0) for x in want) or 1.0
    base = spark.createDataFrame([(x.source, (x.w or 0.0) / share, (x.r or 0), held.get(x.source, 0)) for x in want], "source string, target_share double, max_repeats int, available_tokens bigint")
    rep = base.join(used, "source", "left").na.fill(0, ["mixed_tokens"])
    total_mixed = F.broadcast(rep.agg(F.sum("mixed_tokens").alias("__all")))  # one row
    rep = rep.crossJoin(total_mixed).withColumn("actual_share", F.when(F.col("__all") > 0, F.col("mixed_tokens") / F.col("__all")).otherwise(0.0)).drop("__all")
    rep = rep.withColumn("target_met", F.abs(F.col("actual_share") - F.col("target_share")) <= TOLERANCE * F.col("target_share"))
    rep = rep.withColumn("target_share", F.round("target_share", 6)).withColumn("actual_share", F.round("actual_share", 6))
    return mixture.withColumnRenamed("id", id_col), rep
