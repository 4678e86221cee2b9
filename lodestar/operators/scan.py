"""Exact scans: queries in bounded blocks against all vectors, with a local top-k in each task before any shuffle."""

from __future__ import annotations

from collections.abc import Iterator
from math import fma

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import check_metric
from ..shared import Scratch
from ..shipping import ship

#: Queries sent to the tasks at once; more of them go in further passes over the vectors.
QUERY_BLOCK = 8192
CANDIDATES = "qid long, vec_id long, dist double"


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column as a double matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), dim)


def distances(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """Query by row; inner products are negated, so that less is nearer for both metrics."""
    if metric == "ip":
        return -(q @ x.T)
    return np.maximum(0, (q * q).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * (q @ x.T))


def exact(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """Distances of paired rows without cancellation."""
    return -np.einsum("ij,ij->i", x, q) if metric == "ip" else np.square(x - q).sum(1)


def rounding(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """How far rough distances of each query may lie from the exact ones."""
    return 16 * (x.shape[1] + 4) * np.finfo(np.float64).eps * ((q * q).sum(1) + (x * x).sum(1).max())


def sql_l2(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distances of paired rows to the bit as DuckDB's list_distance gives them: fused sums in the order of the components, then a root.

    Where real distances are equal, their last bits or the root's rounding decide, so SQL's choice needs SQL's bits.
    """
    out = exact(x, q, "l2")
    for i in np.flatnonzero(np.isfinite(out)).tolist():
        total = 0.0
        for v in (x[i] - q[i]).tolist():
            total = fma(v, v, total)
        out[i] = total
    return np.sqrt(out)


def level(d: np.ndarray, least: np.ndarray, dim: int) -> np.ndarray:
    """Whether exact squared distances are so near to the least one that the order of their sums, or a root, may decide."""
    return d <= least * (1 + 4 * (dim + 4) * np.finfo(np.float64).eps)


def nearest(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """The row of ``x`` nearest to each query, the first of equally near ones; rough distances only rule rows out."""
    rough = distances(x, q, metric)
    near = rough.argmin(1)
    close = rough <= (rough.min(1) + rounding(x, q))[:, None]
    several = np.flatnonzero(close.sum(1) > 1)
    if len(several):
        # Of equal rows, only the first.
        _, first = np.unique(x, axis=0, return_index=True)
        alone = np.zeros(len(x), bool)
        alone[first] = True
        qi, xi = np.nonzero(close[several] & alone)
        d = exact(x[xi], q[several[qi]], metric)
        if metric == "l2":
            least = np.minimum.reduceat(d, np.searchsorted(qi, np.arange(len(several))))
            at = np.flatnonzero(level(d, least[qi], x.shape[1]))
            qi, xi = qi[at], xi[at]
            more = np.bincount(qi, minlength=len(several))[qi] > 1
            d = np.zeros(len(at))
            d[more] = sql_l2(x[xi[more]], q[several[qi[more]]])
        order = np.lexsort((xi, d, qi))
        near[several] = xi[order][np.searchsorted(qi, np.arange(len(several)))]
    return near


def local_topk(x: np.ndarray, ids: np.ndarray, q: np.ndarray, qids: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(qid, id, dist) of the k nearest rows of each query; ties by id.

    Rough distances only rule rows out: every row whose rough distance is within the rounding error of the k-th is
    measured exactly, however many are equally far.
    """
    if not len(x) or not len(q):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    if k >= len(x):
        qi, xi = np.repeat(np.arange(len(q)), len(x)), np.tile(np.arange(len(x)), len(q))
    else:
        rough = distances(x, q, metric)
        limit = np.partition(rough, k - 1, axis=1)[:, k - 1] + rounding(x, q)
        qi, xi = np.nonzero(rough <= limit[:, None])
    d = exact(x[xi], q[qi], metric)
    order = np.lexsort((ids[xi], d, qi))
    first = np.searchsorted(qi, np.arange(len(q)))
    order = order[np.arange(len(order)) - first[qi] < k]
    return qids[qi[order]], ids[xi[order]], d[order]


def routed_scan(vectors: DataFrame, routed: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """Candidates (qid, vec_id, dist) of ``vectors(vec_id, shard_id, embedding)`` for ``routed(qid, shard_id, embedding)``.

    Each task keeps the k best of its rows for each query. The vectors aren't shuffled; of the queries QUERY_BLOCK at
    most are sent at once.
    """
    check_metric(metric)
    if k < 1:
        raise ValueError("k must be positive")
    spark = vectors.sparkSession
    ship(spark)
    total = routed.select("qid").distinct().count()
    n = max(1, -(-total // QUERY_BLOCK))
    if n > 1:
        routed = Scratch(spark, "routed").save(routed.withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(n)).cast("int")), by=("block",))
    out = spark.createDataFrame([], CANDIDATES)
    for block in range(n):
        rows = (routed.where(F.col("block") == block) if n > 1 else routed).select("qid", "shard_id", "embedding").collect()
        if not rows:
            continue
        place = {}
        for r in rows:
            place.setdefault(r.qid, len(place))
        q = np.zeros((len(place), len(rows[0].embedding)))
        by_shard: dict[int, set[int]] = {}
        for r in rows:
            q[place[r.qid]] = r.embedding
            by_shard.setdefault(r.shard_id, set()).add(place[r.qid])
        sent = spark.sparkContext.broadcast((q, np.array(list(place), np.int64), {s: np.array(sorted(i)) for s, i in by_shard.items()}))

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            q, qids, by_shard = sent.value
            best = None
            for b in batches:
                ids, shard = b.column(0).to_numpy(), b.column(1).to_numpy()
                x = matrix(b.column(2), q.shape[1])
                parts = [] if best is None else [best]
                for s in np.unique(shard):
                    if (i := by_shard.get(int(s))) is not None:
                        at = shard == s
                        for c in range(0, len(i), 1024):
                            parts.append(local_topk(x[at], ids[at], q[i[c : c + 1024]], qids[i[c : c + 1024]], k, metric))
                if parts:
                    a, v, d = (np.concatenate(c) for c in zip(*parts, strict=True))
                    # A vector and its replica are one result; then the nearest of each query.
                    order = np.lexsort((d, v, a))
                    a, v, d = a[order], v[order], d[order]
                    once = np.r_[True, (a[1:] != a[:-1]) | (v[1:] != v[:-1])] if len(a) else np.zeros(0, bool)
                    a, v, d = a[once], v[once], d[once]
                    order = np.lexsort((v, d, a))
                    a, v, d = a[order], v[order], d[order]
                    first = np.r_[True, a[1:] != a[:-1]] if len(a) else np.zeros(0, bool)
                    rank = np.arange(len(a)) - np.maximum.accumulate(np.where(first, np.arange(len(a)), 0))
                    best = a[rank < k], v[rank < k], d[rank < k]
            if best is not None:
                yield pa.RecordBatch.from_arrays([pa.array(best[0]), pa.array(best[1]), pa.array(best[2])], names=["qid", "vec_id", "dist"])

        out = out.unionByName(vectors.where(F.col("shard_id").isin([int(s) for s in by_shard])).select(F.col("vec_id").cast("long"), F.col("shard_id").cast("int"), "embedding").mapInArrow(scan, CANDIDATES))
    return out


def merge_topk(candidates: DataFrame, k: int) -> DataFrame:
    """(qid, rank, vec_id, dist): distinct ids, nearest first, ties by id. A replica is one result, not two."""
    one = candidates.groupBy("qid", "vec_id").agg(F.min("dist").alias("dist"))
    w = Window.partitionBy("qid").orderBy("dist", "vec_id")
    return one.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("qid", "rank", "vec_id", "dist")


def exact_knn(base: DataFrame, queries: DataFrame, k: int = 10, metric: str = "l2") -> DataFrame:
    """Exact k nearest of ``base(vec_id, embedding)`` for each of ``queries(qid, embedding)``. ``dist`` is -ip for 'ip'."""
    zero = F.lit(0).alias("shard_id")
    return merge_topk(routed_scan(base.select("vec_id", zero, "embedding"), queries.select("qid", zero, "embedding"), k, metric), k)


def pad_topk(results: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Exactly k rows for each query; missing ones have vec_id -1 and the largest float as distance."""
    want = queries.select("qid").distinct().select("qid", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("rank"))
    return want.join(results, ["qid", "rank"], "left").select("qid", "rank", F.coalesce("vec_id", F.lit(-1).cast("long")).alias("vec_id"), F.coalesce("dist", F.lit(3.4028234663852886e38)).alias("dist"))
