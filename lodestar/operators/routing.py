"""Boundaries, replicas and routers: which shards a vector or a query belongs to."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship
from .clustering import assign, id_hash, lloyd_groups
from .scan import distances, exact, level, matrix, nearest, rounding, sql_l2


def boundary(vectors: DataFrame, means: np.ndarray, tau: float = 1.01) -> DataFrame:
    """(vec_id, first_id, second_id, ratio) of vectors almost as near to a second shard mean.

    ``ratio`` is that of squared distances, below ``tau`` and defined where the nearest one isn't 0.
    """
    two = assign(vectors, means, top=2).where(F.col("dist") > 0)
    ratio = (F.col("second_dist") / F.col("dist")).alias("ratio")
    return two.select("vec_id", F.col("cluster_id").alias("first_id"), "second_id", ratio).where(F.col("ratio") < tau)


def replicas(edge: DataFrame, primary: DataFrame) -> DataFrame:
    """(vec_id, shard_id, is_replica): a copy in the second shard, or the first if the second is the primary one."""
    both = edge.join(primary.select("vec_id", F.col("shard_id").alias("own")), "vec_id")
    target = F.when(F.col("second_id") == F.col("own"), F.col("first_id")).otherwise(F.col("second_id"))
    return both.select("vec_id", target.cast("int").alias("shard_id"), F.lit(True).alias("is_replica")).where(F.col("shard_id") != both["own"])


def with_replicas(primary: DataFrame, copies: DataFrame) -> DataFrame:
    return primary.select("vec_id", F.col("shard_id").cast("int").alias("shard_id"), F.lit(False).alias("is_replica")).unionByName(copies)


def subcluster_router(vectors: DataFrame, per_shard: int = 500, iterations: int = 10) -> DataFrame:
    """(shard_id, centroid): up to ``per_shard`` k-means centroids of each shard, fitted on all its rows."""
    rows = [(int(g), c.tolist()) for g, some in lloyd_groups(vectors, per_shard, iterations).items() for c in some]
    return vectors.sparkSession.createDataFrame(rows, "shard_id int, centroid array<double>")


def sample_router(vectors: DataFrame, per_shard: int = 500, seed: int = 142, raw: bool = False) -> DataFrame:
    """(shard_id, centroid): ``per_shard`` vectors of each shard in the order of a hash of their ids."""
    # Only ids whose hash lies below a bound that leaves about twice as many as asked for reach the window.
    n = F.broadcast(vectors.groupBy("shard_id").agg(F.count("*").alias("_n")))
    some = vectors.withColumn("_h", id_hash(seed)).join(n, "shard_id").where(F.col("_h") < (F.lit(2 * per_shard + 100) / F.col("_n") * (1 << 32)))
    w = Window.partitionBy("shard_id").orderBy("_h", "vec_id")
    drawn = some.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= per_shard).drop("_r", "_h", "_n")
    return drawn if raw else drawn.select("shard_id", F.col("embedding").cast("array<double>").alias("centroid"))


def route(queries: DataFrame, shard_of: np.ndarray, centroids: np.ndarray, nprobe: int = 1, metric: str = "l2") -> DataFrame:
    """(qid, shard_id, embedding): the ``nprobe`` distinct shards with the nearest centroids; lower shards win ties.

    More probes than shards mean all shards; fewer than one are an error. The centroids go to every task.
    """
    if nprobe < 1:
        raise ValueError("nprobe must be positive")
    spark = queries.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast((np.asarray(shard_of, np.int64), np.asarray(centroids, np.float64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard_of, c = sent.value
        ids = np.unique(shard_of)
        take = min(nprobe, len(ids))
        for b in batches:
            q = matrix(b.column(1), c.shape[1])
            d = distances(c, q, metric)
            best = np.stack([d[:, shard_of == s].min(1) for s in ids], 1)
            # Rough distances decide only where their rounding cannot.
            unsure = np.flatnonzero((np.diff(np.sort(best, axis=1)[:, : take + 1], axis=1) <= rounding(c, q)[:, None]).any(1))
            for i in range(0, len(unsure), 1024):
                best[unsure[i : i + 1024]] = _to_shards(shard_of, ids, c, q[unsure[i : i + 1024]], metric)
            near = np.argsort(best, axis=1, kind="stable")[:, :take]
            at = np.repeat(np.arange(len(q)), take)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(ids[near].ravel().astype(np.int32)), b.column(1).take(pa.array(at))], names=["qid", "shard_id", "embedding"])

    return queries.select(F.col("qid").cast("long"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(run, "qid long, shard_id int, embedding array<double>")


def _to_shards(shard_of: np.ndarray, ids: np.ndarray, c: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """Distance of each query to the nearest centroid of each shard; in a row whose shards are level, distances as SQL has them."""
    row = np.stack([r[nearest(c[r], q, metric)] for r in (np.flatnonzero(shard_of == s) for s in ids)], 1)
    d = np.stack([exact(c[at], q, metric) for at in row.T], 1)
    if metric == "l2":
        up = np.sort(d, axis=1)
        for i in np.flatnonzero(level(up[:, 1:], up[:, :-1], c.shape[1]).any(1)):
            d[i] = sql_l2(c[row[i]], np.broadcast_to(q[i], (len(ids), q.shape[1])))
    return d


def route_all(queries: DataFrame, shards: int) -> DataFrame:
    """Every query to every shard, in shard order."""
    return queries.select("qid", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<int>")).alias("shard_id"), "embedding")


def queries_per_shard(routed: DataFrame) -> DataFrame:
    return routed.groupBy("shard_id").agg(F.countDistinct("qid").alias("n_queries"))
