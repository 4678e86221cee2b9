"""Partitions of a vector set: hashing, Lloyd's k-means, nearest and second-nearest centroids, sizes and means."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship
from .numbering import row_numbers
from .scan import distances, exact, matrix, nearest


def random_partition(vectors: DataFrame, shards: int, seed: int = 42) -> DataFrame:
    """(vec_id, shard_id) by a hash of the id, the same on every run and for every partitioning."""
    if shards < 1:
        raise ValueError("shards must be positive")
    return vectors.select("vec_id", hash_shard(shards, seed).alias("shard_id"))


def hash_shard(shards: int, seed: int = 42) -> Column:
    """The shard of a vec_id."""
    return (id_hash(seed) % shards).cast("int")


def id_hash(seed: int) -> Column:
    """32 bits of an MD5 of the seed and the vec_id, which other SQL engines give as well."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def initial_centroids(vectors: DataFrame, k: int) -> np.ndarray:
    """The vectors of the k smallest ids."""
    rows = vectors.orderBy("vec_id").limit(k).select("embedding").collect()
    if len(rows) < k:
        raise ValueError(f"{k} clusters of {len(rows)} vectors")
    return np.array([r.embedding for r in rows], np.float64)


def sample(vectors: DataFrame, most: int, seed: int = 42) -> DataFrame:
    """About ``most`` vectors by a hash of their ids, the same on every run; all of them if there are no more."""
    n = vectors.count()
    return vectors if n <= most else vectors.where(F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1 << 30)) < int(most / n * (1 << 30)))


def lloyd(vectors: DataFrame, k: int, iterations: int = 25, start: np.ndarray | None = None, metric: str = "l2", tolerance: float = 0.0) -> np.ndarray:
    """Centroids after Lloyd iterations; an empty cluster keeps its centroid.

    Tasks add up sums for each cluster; only the k centroids come to the driver in each round.
    """
    centroids = initial_centroids(vectors, k) if start is None else np.array(start, np.float64)
    return _rounds(vectors.select(F.lit(0).alias("g"), "embedding"), {0: centroids}, iterations, metric, tolerance)[0]


def lloyd_groups(vectors: DataFrame, k: int, iterations: int, group: str = "shard_id") -> dict[int, np.ndarray]:
    """Centroids of each ``group`` of ``vectors(vec_id, group, embedding)`` after Lloyd iterations over all its rows.

    A group starts from its k lowest ids and has fewer centroids if it has fewer rows.
    """
    rows = vectors.select(F.col(group).cast("int").alias("g"), "vec_id", "embedding").where("g is not null")
    w = Window.partitionBy("g").orderBy("vec_id")
    low = rows.select("g", "vec_id").withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("g", "vec_id")
    start: dict[int, list] = {}
    for r in rows.join(F.broadcast(low.distinct()), ["g", "vec_id"]).collect():
        start.setdefault(r.g, []).append((r.vec_id, r.embedding))
    first = {g: np.array([x for _, x in sorted(some)[:k]], np.float64) for g, some in start.items()}
    return _rounds(rows.select("g", "embedding"), first, iterations) if first else {}


def _rounds(rows: DataFrame, centroids: dict[int, np.ndarray], iterations: int, metric: str = "l2", tolerance: float = 0.0) -> dict[int, np.ndarray]:
    """Lloyd iterations over ``rows(g, embedding)`` in each group of ``centroids``, in one pass for all groups a round."""
    spark = rows.sparkSession
    ship(spark)
    for _ in range(iterations):
        sent = spark.sparkContext.broadcast(centroids)

        def sums(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            total = {g: (np.zeros_like(c), np.zeros(len(c), np.int64)) for g, c in sent.value.items()}
            for b in batches:
                group = b.column(0).to_numpy()
                x = matrix(b.column(1), next(iter(sent.value.values())).shape[1])
                for g in np.unique(group).tolist():
                    at, c = np.flatnonzero(group == g), sent.value[g]
                    for i in range(0, len(at), 4096):
                        part = x[at[i : i + 4096]]
                        near = nearest(c, part, metric)
                        np.add.at(total[g][0], near, part)
                        total[g][1][:] += np.bincount(near, minlength=len(c))
            for g, (t, n) in total.items():
                has, d = np.flatnonzero(n), t.shape[1]
                cols = [np.full(len(has) * d, g, np.int32), np.repeat(has, d), np.tile(np.arange(d), len(has)), t[has].ravel(), np.repeat(n[has], d)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["g", "c", "j", "s", "n"])

        means = rows.mapInArrow(sums, "g int, c long, j long, s double, n long").groupBy("g", "c", "j").agg((F.sum("s") / F.sum("n")).alias("m")).collect()
        after = {g: c.copy() for g, c in centroids.items()}
        for r in means:
            after[r.g][r.c, r.j] = r.m
        moved = max(np.abs(after[g] - c).max() for g, c in centroids.items())
        centroids = after
        if moved <= tolerance:
            break
    return centroids


def assign(vectors: DataFrame, centroids: np.ndarray, metric: str = "l2", top: int = 1) -> DataFrame:
    """(vec_id, cluster_id, dist) for top 1; for top 2 also second_id and second_dist. The lowest id wins ties."""
    spark = vectors.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(np.array(centroids, np.float64))
    if top not in (1, 2) or len(centroids) < top:
        raise ValueError(f"the nearest {top} of {len(centroids)} centroids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        for b in batches:
            x = matrix(b.column(1), c.shape[1])
            best = (lambda q: nearest(c, q, metric)[:, None]) if top == 1 else (lambda q: np.argsort(distances(c, q, metric), axis=1, kind="stable")[:, :2])
            order = np.concatenate([best(x[at : at + 2048]) for at in range(0, len(x), 2048)]) if len(x) else np.zeros((0, top), int)
            cols = [b.column(0)]
            for t in range(top):
                i = order[:, t]
                cols += [pa.array(i.astype(np.int32)), pa.array(-np.einsum("ij,ij->i", c[i], x) if metric == "ip" else np.square(c[i] - x).sum(1))]
            yield pa.RecordBatch.from_arrays(cols, names=["vec_id", "cluster_id", "dist", "second_id", "second_dist"][: 1 + 2 * top])

    return vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(run, "vec_id long, cluster_id int, dist double" + ", second_id int, second_dist double" * (top == 2))


def cluster_sizes(assigned: DataFrame, k: int, cluster: str = "cluster_id") -> DataFrame:
    """(cluster_id, size) for all k clusters, empty ones with 0."""
    ids = assigned.sparkSession.range(k).select(F.col("id").cast("int").alias("cluster_id"))
    n = assigned.groupBy(F.col(cluster).cast("int").alias("cluster_id")).agg(F.count("*").alias("size"))
    return ids.join(F.broadcast(n), "cluster_id", "left").select("cluster_id", F.coalesce("size", F.lit(0).cast("long")).alias("size"))


def cluster_stats(sizes: DataFrame) -> DataFrame:
    """Smallest, largest and whole average size."""
    return sizes.agg(F.min("size").alias("min_size"), F.max("size").alias("max_size"), F.floor(F.sum("size") / F.count("*")).cast("long").alias("avg_size"))


def group_means(vectors: DataFrame, group: str, weight: str | None = None) -> DataFrame:
    """(group, mean): mean vector of each group, weighted by ``weight`` if given.

    Tasks add up sums for each group of a batch; those, not the vectors' components, are shuffled.
    """
    ship(vectors.sparkSession)
    w = F.col(weight) if weight else F.lit(1)
    rows = vectors.select(F.col(group).alias("g"), w.cast("double").alias("w"), F.col("embedding").cast("array<double>").alias("x"))
    kind = rows.schema["g"].dataType.simpleString()

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column(2), len(b.column(2)[0]))
            code = b.column(0).dictionary_encode()
            at, w = code.indices.to_numpy(zero_copy_only=False), b.column(1).to_numpy()
            n, d = len(code.dictionary), x.shape[1]
            total = np.zeros((n, d))
            np.add.at(total, at, x * w[:, None])
            weights = np.bincount(at, w, n)
            yield pa.RecordBatch.from_arrays([code.dictionary.take(pa.array(np.repeat(np.arange(n), d))), pa.array(np.tile(np.arange(d), n)), pa.array(total.ravel()), pa.array(np.repeat(weights, d))], names=["g", "j", "s", "w"])

    parts = rows.where("g is not null").mapInArrow(sums, f"g {kind}, j long, s double, w double")
    means = parts.groupBy("g", "j").agg((F.sum("s") / F.sum("w")).alias("m"))
    return means.groupBy(F.col("g").alias(group)).agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "m"))), lambda s: s["m"]).alias("mean"))


def means_matrix(vectors: DataFrame, shards: int, dim: int) -> np.ndarray:
    """Mean of each shard, a zero vector for an empty one; ``shards`` rows come to the driver."""
    out = np.zeros((shards, dim))
    for r in group_means(vectors, "shard_id").collect():
        out[r.shard_id] = r["mean"]
    return out


def farthest_pair(centroids: DataFrame) -> DataFrame:
    """(a, b, dist): the two centroids with the greatest distance, the first such pair by ids. Input is one row a cluster."""
    from ..functions.vectors import l2

    a = centroids.select(F.col("cluster_id").alias("a"), F.col("centroid").alias("x"))
    b = centroids.select(F.col("cluster_id").alias("b"), F.col("centroid").alias("y"))
    # As many rows as clusters, which the driver holds as well; never vectors.
    pairs = a.join(F.broadcast(b), F.col("a") < F.col("b")).select("a", "b", l2("x", "y").alias("dist"))
    return pairs.agg(F.min(F.struct((-F.col("dist")).alias("d"), "a", "b")).alias("m")).where("m is not null").select("m.a", "m.b", (-F.col("m.d")).alias("dist"))


def local_ids(assignments: DataFrame) -> DataFrame:
    """``assignments(vec_id, shard_id, is_replica)`` with local_id: primaries in id order, then replicas."""
    kinds = row_numbers(assignments, ["shard_id", "is_replica"], "vec_id", "local_id")
    # One row a shard.
    first = assignments.groupBy("shard_id").agg(F.count_if(~F.col("is_replica")).alias("_primary"))
    out = kinds.join(F.broadcast(first), "shard_id")
    return out.select(*assignments.columns, F.when(F.col("is_replica"), F.col("local_id") + F.col("_primary")).otherwise(F.col("local_id")).alias("local_id"))


def with_shard(vectors: DataFrame, centroids: np.ndarray, shard_of: np.ndarray, metric: str = "l2") -> DataFrame:
    """``vectors(vec_id, embedding)`` with the shard of their nearest centroid; no shuffle."""
    ship(vectors.sparkSession)
    sent = vectors.sparkSession.sparkContext.broadcast((np.asarray(centroids, np.float64), np.asarray(shard_of, np.int32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, shard = sent.value
        for b in batches:
            x = matrix(b.column(1), c.shape[1])
            near = np.concatenate([nearest(c, x[at : at + 2048], metric) for at in range(0, len(x), 2048)]) if len(x) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shard[near]), b.column(1)], names=["vec_id", "shard_id", "embedding"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    return rows.mapInArrow(run, f"vec_id long, shard_id int, embedding {rows.schema['embedding'].dataType.simpleString()}")


def with_copies(own: DataFrame, means: np.ndarray, tau: float) -> DataFrame:
    """``own(vec_id, shard_id, embedding)`` with is_replica, and a copy of each vector almost as near to another shard's mean.

    The rule of ``routing.boundary`` and ``routing.replicas``, in one pass without a join.
    """
    ship(own.sparkSession)
    sent = own.sparkSession.sparkContext.broadcast(np.asarray(means, np.float64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        for b in batches:
            x, shard = matrix(b.column(2), c.shape[1]), b.column(1).to_numpy()
            two = np.argsort(distances(c, x, "l2"), axis=1, kind="stable")[:, :2]
            near, far = exact(c[two[:, 0]], x, "l2"), exact(c[two[:, 1]], x, "l2")
            at = np.flatnonzero((near > 0) & (far < tau * near))
            target = np.where(two[at, 1] == shard[at], two[at, 0], two[at, 1]).astype(np.int32)
            both = pa.array(np.concatenate([np.arange(len(x)), at]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(both), pa.array(np.concatenate([shard, target]).astype(np.int32)), pa.array(np.arange(len(both)) >= len(x)), b.column(2).take(both)],
                names=["vec_id", "shard_id", "is_replica", "embedding"],
            )

    return own.select("vec_id", "shard_id", "embedding").mapInArrow(run, f"vec_id long, shard_id int, is_replica boolean, embedding {own.schema['embedding'].dataType.simpleString()}")
