"""Exact nearest neighbours of a stated query set against all rows, in blocks.

Queries are taken in blocks of bounded bytes; for each block every partition of the data keeps its k best for
each query in numpy, and the partitions' candidates are merged by an aggregate. The data are read once a
block and never shuffled; what is shuffled is k rows for each query and partition. A block's result is written before
the next block starts, so neither plan nor driver grows with the number of queries.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.session import cut

#: Bytes of one block's vectors (sent to every task), and rows and queries compared at a time.
BLOCK_BYTES, ROWS, QUERIES = 64 << 20, 4096, 1024


def _vectors(col: pa.Array) -> np.ndarray:
    a = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return np.asarray(a.flatten(), dtype=np.float64).reshape(len(a), -1)


def _best(qid: np.ndarray, qv: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int, best_d: np.ndarray, best_i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The k best of (best_d, best_i) and of rows (ids, v), by distance and id. A matrix product finds the rows that can
    count; their distances are summed directly, without cancellation between near vectors."""
    vv, qq = (v * v).sum(1), (qv * qv).sum(1)
    near = qq[:, None] + vv[None, :] - 2 * qv @ v.T
    near[qid[:, None] == ids[None, :]] = np.inf
    kept = best_d.shape[1]
    edge = np.partition(near, k - 1, axis=1)[:, k - 1] if near.shape[1] > k else np.full(len(qid), np.inf)
    if kept == k:
        edge = np.minimum(edge, best_d[:, -1] ** 2)
    r, c = np.nonzero(near <= (edge + 1e-9 * (qq + vv.max()))[:, None])
    r, c = (a[np.isfinite(near[r, c])] for a in (r, c))
    d = np.sqrt(((v[c] - qv[r]) ** 2).sum(1))
    r = np.concatenate([np.repeat(np.arange(len(qid)), kept), r])
    d, i = np.concatenate([best_d.ravel(), d]), np.concatenate([best_i.ravel(), ids[c]])
    o = np.lexsort((i, d, r))
    r, d, i = r[o], d[o], i[o]
    place = np.arange(len(r)) - np.searchsorted(r, r)
    out_d, out_i = np.full((len(qid), k), np.inf), np.full((len(qid), k), -1)
    take = place < k
    out_d[r[take], place[take]], out_i[r[take], place[take]] = d[take], i[take]
    return out_d, out_i


def nearest(data: DataFrame, queries: DataFrame, id_col: str, vec_col: str, k: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, id, distance) of the k nearest rows of each query by Euclidean distance, the smaller id on
    ties; a query is no neighbour of itself (same id). Null vectors are left out; all must have one
    length. Fewer than k rows give fewer neighbours."""
    spark, schema = data.sparkSession, "query_id bigint, id bigint, distance double"
    plain = lambda df: df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).filter("v is not null")
    src, qs = plain(data), cut(plain(queries))
    size = qs.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("w")).first()
    blocks = max(1, -(-size.n * (size.w or 1) * 8 // block_bytes))

    def run_block(b: int) -> DataFrame:
        own = qs.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toArrow()  # about block_bytes
        shared = spark.sparkContext.broadcast((np.asarray(own.column(0), dtype=np.int64), _vectors(own.column(1))))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qid, qv = shared.value
            best_d, best_i = np.full((len(qid), k), np.inf), np.full((len(qid), k), -1)
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    s = batch.slice(at, ROWS)
                    ids, v = np.asarray(s.column(0), dtype=np.int64), _vectors(s.column(1))
                    for q in range(0, len(qid), QUERIES):
                        t = slice(q, q + QUERIES)
                        best_d[t], best_i[t] = _best(qid[t], qv[t], ids, v, k, best_d[t], best_i[t])
            r, c = np.nonzero(np.isfinite(best_d))
            yield pa.RecordBatch.from_arrays([pa.array(qid[r]), pa.array(best_i[r, c]), pa.array(best_d[r, c])], names=["query_id", "id", "distance"])

        out = src.mapInArrow(scan, schema)
        lists = out.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("distance", "id"))), 1, k).alias("n"))  # k rows a partition
        best = lists.select("query_id", F.explode("n").alias("x")).select("query_id", "x.id", "x.distance")
        if blocks == 1:
            return best
        best = cut(best)
        shared.destroy()
        return best

    if not size.n:
        return spark.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, (run_block(b) for b in range(blocks)))


def mean_distance(neigh: DataFrame) -> DataFrame:
    return neigh.groupBy("query_id").agg(F.avg("distance").alias("mean_distance"))


def domain_threshold(mean: DataFrame, q: float = 0.95) -> DataFrame:
    """One row: the quantile of the mean distances (linear interpolation)."""
    return mean.agg(F.percentile("mean_distance", F.lit(q)).alias("threshold"))
