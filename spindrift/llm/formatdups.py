"""Problem 2: duplicates hidden by formatting differences.

Every record gets a full canonical key. Records are partitioned by ranges of the key's hash and externally
sorted by (hash, key, id), then each partition is scanned once: neighbours with equal full keys form a run,
whose first record is the representative. Ranges of a hash are even without sampling the keys; only keys that hold
more rows than a partition should, found in a small sample, are spread over partitions of their own, and
their runs are stitched by a join on the full key, one row for each such partition.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions.text import bare, bare_decimal
from spindrift.operators.packed import split_packed
from spindrift.session import cut

#: Rows of a partition; sampled rows, and those for each partition, from which crowded keys are told; fewest of one key.
ROWS, SAMPLE, SAMPLE_EACH, CROWD = 250_000, 20_000, 50, 25


def list_key(c: Column) -> Column:
    """Key of a list cell, whatever its delimiters and the order of its values: the letters and digits of
    its sorted values. Signs do not count, those between values neither."""
    return F.array_join(F.array_sort(F.transform(split_packed(c, keep_placeholders=True), bare)), "")


def canonical_keys(df: DataFrame, id_col: str, exact: list[str], source: str, label: str, listed: str) -> DataFrame:
    """(i, k): id and full key of every record, the key as one text.

    Parts are joined by a separator and null has a mark of its own; a record that holds one of these
    signs itself has each part written with its length instead, so no two records with different parts
    share a key. Parts of source, label and list are their letters and digits alone, as asked.
    """
    q = lambda c: F.col(f"`{c}`").cast("string")
    parts = [f"e{i}" for i in range(len(exact))]
    wide = df.select(
        F.col(f"`{id_col}`").cast("bigint").alias("i"), bare(q(source)).alias("c0"), bare_decimal(q(label)).alias("c1"), list_key(q(listed)).alias("c2"),
        *(q(c).alias(p) for c, p in zip(exact, parts)),
    )
    every = ["c0", "c1", "c2", *parts]
    fast = F.concat_ws("\u001f", F.lit("f"), *(F.coalesce(p, F.lit("\u001e")) for p in every))
    safe = F.concat(F.lit("s"), *(F.coalesce(F.concat(F.length(p), F.lit(":"), p), F.lit("-")) for p in every))
    every_part = F.concat_ws("", *parts)
    clash = every_part.contains("\u001e") | every_part.contains("\u001f") if parts else F.lit(False)  # the other three are letters and digits
    return wide.select("i", F.when(clash, safe).otherwise(fast).alias("k"))


_OUT = "pid int, keep_id bigint, copy_id bigint, k binary"


def _scan(base: int):
    """Scan of sorted partitions: pairs (first of run, later of run); in partitions from `base` on, those of crowded
    keys, also each run's first id with its key (copy_id null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        key = start = None

        def rows(keep, copy, k) -> pa.RecordBatch:
            n = len(keep)
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, pid, np.int32)), pa.array(keep, pa.int64()), copy, k], names=["pid", "keep_id", "copy_id", "k"])

        for b in batches:
            k, i = b.column(0), b.column(1).to_numpy(zero_copy_only=False)
            if not len(i):
                continue
            fresh = np.ones(len(i), bool)
            fresh[1:] = ~pc.equal(k.slice(1), k.slice(0, len(i) - 1)).to_numpy(zero_copy_only=False)
            fresh[0] = key is None or k[0].as_py() != key
            heads = np.nonzero(fresh)[0]
            run_of = np.cumsum(fresh) - 1  # -1: goes on from the last batch
            firsts = np.append(i[heads], start if start is not None else i[0])  # at -1
            later = ~fresh
            if later.any():
                yield rows(firsts[run_of[later]], pa.array(i[later], pa.int64()), pa.nulls(int(later.sum()), pa.binary()))
            if pid >= base and len(heads):
                yield rows(i[heads], pa.nulls(len(heads), pa.int64()), k.take(pa.array(heads)).cast(pa.binary()))
            key, start = k[len(i) - 1].as_py(), firsts[run_of[-1]]

    return run


def _placed(df: DataFrame, keyed, rows: int) -> tuple[DataFrame, int, int]:
    """(keyed(df) with the number of its partition, ordinary partitions, partitions of crowded keys)."""
    spark, total = df.sparkSession, df.count()
    base = max(spark.sparkContext.defaultParallelism, -(-total // rows))
    want = max(SAMPLE, SAMPLE_EACH * base)
    part = df.sample(min(1.0, want / total), seed=42) if total > want else df
    seen = cut(keyed(part).groupBy(F.xxhash64("k").alias("h")).agg(F.count(F.lit(1)).alias("c")))
    sampled = seen.agg(F.sum("c")).first()[0] or 0
    # each holds two partitions' worth of rows, so there are at most base / 2 of them
    crowded = sorted((r.h, r.c) for r in seen.filter((F.col("c") >= CROWD) & (F.col("c") * base >= 2 * sampled)).collect())
    table, at = [], base
    for h, c in crowded:
        pieces = math.ceil(c * base / sampled)
        table.append((h, at, pieces))
        at += pieces
    k = keyed(df).withColumn("h", F.xxhash64("k"))
    own = F.shiftright(F.shiftrightunsigned("h", 33) * F.lit(base), 31).cast("int")
    if not table:
        return k.withColumn("p", own), base, 0
    spread = F.broadcast(spark.createDataFrame(table, "h bigint, at int, pieces int"))  # at most base / 2 rows
    return k.join(spread, "h", "left").withColumn("p", F.coalesce(F.col("at") + F.pmod(F.xxhash64("i"), F.col("pieces")).cast("int"), own)), base, at - base


def format_copies(df: DataFrame, id_col: str, source: str, label: str, listed: str, ignore: tuple[str, ...] = (), rows: int = ROWS) -> DataFrame:
    """(keep_id, copy_id): each record that equals an earlier one but for formatting, with the
    smallest id of its group.

    All columns except id, `ignore` and the three named ones count as written (null equals null);
    source and label agree apart from white space, case and signs (a decimal point in label
    counts), listed also apart from the order of its values. Nulls: null and blank differ. Ids
    must not be null; rows repeating an id are copies of each other. Groups of one give no row.
    """
    exact = [c for c in df.columns if c not in {id_col, source, label, listed, *ignore}]

    def keyed(part: DataFrame) -> DataFrame:
        return canonical_keys(part, id_col, exact, source, label, listed).select(F.col("k").cast("binary").alias("k"), "i")

    placed, base, more = _placed(df, keyed, rows)
    ordered = placed.select("k", "i", "h", "p").repartitionById(base + more, "p").sortWithinPartitions("h", "k", "i").select("k", "i")
    found = ordered.mapInArrow(_scan(base), _OUT)
    if not more:
        return found.select("keep_id", "copy_id")
    found = cut(found)
    # one row for each partition of a crowded key (and key of equal hash): the true first of the key
    heads = found.filter("copy_id is null").select("pid", "k", F.col("keep_id").alias("first_id"))
    true = cut(heads.join(heads.groupBy("k").agg(F.min("first_id").alias("true_id")), "k").select("pid", "first_id", "true_id"))
    pairs = found.filter("copy_id is not null").select("pid", F.col("keep_id").alias("first_id"), "copy_id")
    stitched = pairs.join(true, ["pid", "first_id"], "left").select(F.coalesce("true_id", "first_id").alias("keep_id"), "copy_id")
    return stitched.unionByName(true.filter("first_id <> true_id").select(F.col("true_id").alias("keep_id"), F.col("first_id").alias("copy_id")))


def copy_counts(pairs: DataFrame, df: DataFrame, id_col: str) -> DataFrame:
    """(id_col, n_copies): one representative of each group, single records too, with the number
    of records it stands for. Counts are combined before the shuffle, so one large group is cheap."""
    n = pairs.groupBy(F.col("keep_id").alias("__id")).agg((F.count(F.lit(1)) + 1).alias("__n"))
    gone = pairs.select(F.col("copy_id").alias("__id"))
    ids = df.select(F.col(f"`{id_col}`").cast("bigint").alias("__id")).distinct()
    return ids.join(gone, "__id", "left_anti").join(n, "__id", "left").select(F.col("__id").alias(id_col), F.coalesce("__n", F.lit(1)).cast("bigint").alias("n_copies"))
