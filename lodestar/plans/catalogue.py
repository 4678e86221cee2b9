"""Queries over the embeddings table, with the SQL that gives the same rows.

Queries are the vectors whose id is divisible by EVERY, searched for among all vectors, themselves included. Where a query needs shards without k-means, labels 0 to 4 are
shard 0 and the rest shard 1, and labels serve as fine clusters.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import clustering, evaluation, merging, routing
from ..operators.scan import exact_knn, merge_topk, pad_topk, routed_scan
from ..shared import shared_dir
from ..sources.fvecs import export_shards, read_fvecs, write_fvecs
from ..sources.results import write_csv
from ..streaming.batches import batched_search, run_batches, stream_search
from .index import Options, ShardedIndex

EVERY, K, CLUSTERS, ROUNDS, POWER = 100, 10, 4, 3, 120
#: Added to the ids of vectors that are appended; copies of each vector and results in the query of ties; a squared radius.
NEW_IDS, COPIES, TIED, RADIUS = 1_000_000_000, 32, 40, 1.5
SHARD = "CASE WHEN label < 5 THEN 0 ELSE 1 END"


def _all(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding", "label", F.expr(f"CAST({SHARD} AS INT)").alias("shard_id"))


def _base(spark: SparkSession, d: str) -> DataFrame:
    return _all(spark, d)


def _queries(spark: SparkSession, d: str) -> DataFrame:
    return _all(spark, d).where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("qid"), "embedding")


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if c in cols else F.col(c) for c in df.columns])


def _means(spark: SparkSession, d: str) -> np.ndarray:
    base = _base(spark, d)
    return clustering.means_matrix(base, 2, V.check_dimension(base))


def _exploded(df: DataFrame, key: str) -> DataFrame:
    return df.select(key, F.posexplode("mean").alias("dim", "value")).select(key, "dim", F.round("value", 6).alias("value"))


# Searches


def knn_exact_l2(spark, d):
    return _rounded(exact_knn(_base(spark, d), _queries(spark, d), K), "dist")


def _scaled(df: DataFrame) -> DataFrame:
    """Vectors of different lengths, for which the two metrics disagree."""
    return df.withColumn("embedding", F.transform("embedding", lambda x: x.cast("double") * (1 + F.col("label"))))


def knn_exact_ip(spark, d):
    out = exact_knn(_scaled(_base(spark, d)), _queries(spark, d), K, "ip")
    return out.select("qid", "rank", "vec_id", F.round(-F.col("dist"), 6).alias("ip"))


def knn_ties(spark, d):
    """Every vector under many ids, so that the k-th result is one of equals: the lowest ids win."""
    ids = F.transform(F.sequence(F.lit(0), F.lit(COPIES - 1)), lambda c: F.col("vec_id") + c.cast("long") * NEW_IDS)
    many = _base(spark, d).select(F.explode(ids).alias("vec_id"), "embedding")
    return _rounded(exact_knn(many, _queries(spark, d), TIED), "dist")


def topk_padded(spark, d):
    """Results within a radius, padded to K."""
    q = _queries(spark, d)
    out = pad_topk(exact_knn(_base(spark, d), q, K).where(F.col("dist") < RADIUS), q, K)
    return out.select("qid", "rank", "vec_id", F.when(F.col("vec_id") >= 0, F.round("dist", 6)).alias("dist"))


def range_filter(spark, d):
    """Vectors within a squared distance of vector 0, by the column expressions alone."""
    one = _all(spark, d).where("vec_id = 0").first()
    out = _base(spark, d).select("vec_id", V.squared_l2("embedding", V.literal(one.embedding)).alias("dist"))
    return _rounded(out.where("dist < 1.8"), "dist")


def vector_functions(spark, d):
    one = V.literal(_all(spark, d).where("vec_id = 0").first().embedding)
    out = _base(spark, d).select(
        "vec_id", V.squared_l2("embedding", one).alias("sq"), V.l2("embedding", one).alias("l2"), V.inner_product("embedding", one).alias("ip"), V.norm("embedding").alias("norm"),
        V.project("embedding", one, one).alias("proj"), F.element_at(V.normalize(V.center("embedding", one)), 1).alias("unit0"),
    )
    return _rounded(out, "sq", "l2", "ip", "norm", "proj", "unit0")


def query_limit(spark, d):
    """The first three queries."""
    return _rounded(exact_knn(_base(spark, d), _queries(spark, d).orderBy("qid").limit(3), 3), "dist")


# Clusters and partitions


def shard_means(spark, d):
    return _exploded(clustering.group_means(_base(spark, d), "shard_id"), "shard_id")


def weighted_mean(spark, d):
    labels = clustering.group_means(_base(spark, d), "label").join(_base(spark, d).groupBy("label").count(), "label")
    rows = labels.select(F.lit(0).alias("shard_id"), F.col("mean").alias("embedding"), "count")
    return _exploded(clustering.group_means(rows, "shard_id", "count"), "shard_id")


def kmeans_lloyd(spark, d):
    c = clustering.lloyd(_base(spark, d), CLUSTERS, ROUNDS)
    rows = [(i, j, float(v)) for i, x in enumerate(c) for j, v in enumerate(x)]
    return spark.createDataFrame(rows, "cluster_id int, dim int, value double").withColumn("value", F.round("value", 6))


def nearest_centroid(spark, d):
    c = clustering.lloyd(_base(spark, d), CLUSTERS, ROUNDS)
    return _rounded(clustering.assign(_base(spark, d), c), "dist")


def cluster_sizes(spark, d):
    return clustering.cluster_sizes(_base(spark, d), 12, "label")


def cluster_stats(spark, d):
    return clustering.cluster_stats(clustering.cluster_sizes(_base(spark, d), 10, "label"))


def _labels(spark, d) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows = sorted((r.label, r["mean"]) for r in clustering.group_means(_base(spark, d), "label").collect())
    n = {r.label: r["count"] for r in _base(spark, d).groupBy("label").count().collect()}
    return np.array([x for x, _ in rows]), np.array([m for _, m in rows]), np.array([n[x] for x, _ in rows])


def farthest_pair(spark, d):
    means = clustering.group_means(_base(spark, d), "label").select(F.col("label").alias("cluster_id"), F.col("mean").alias("centroid"))
    return _rounded(clustering.farthest_pair(means), "dist")


def _merged(spark, d, shard) -> DataFrame:
    ids, _, sizes = _labels(spark, d)
    return spark.createDataFrame([(int(i), int(n), int(s)) for i, n, s in zip(ids, sizes, shard, strict=True)], "cluster_id int, size long, shard_id int")


def pca_bisection(spark, d):
    _, means, sizes = _labels(spark, d)
    b = merging.pca_bisection(means, sizes, steps=POWER, stop=0.0)
    return _merged(spark, d, b.shard)


def greedy_min(spark, d):
    _, means, sizes = _labels(spark, d)
    return _merged(spark, d, merging.greedy_merge(means, sizes, linkage="min"))


def greedy_centroid(spark, d):
    _, means, sizes = _labels(spark, d)
    return _merged(spark, d, merging.greedy_merge(means, sizes, linkage="centroid"))


def hash_partition(spark, d):
    return clustering.random_partition(_base(spark, d), 4)


def cluster_to_shard(spark, d):
    _, means, sizes = _labels(spark, d)
    own = _merged(spark, d, merging.pca_bisection(means, sizes, steps=POWER, stop=0.0).shard)
    return _base(spark, d).select("vec_id", F.col("label").alias("cluster_id")).join(F.broadcast(own), "cluster_id").select("vec_id", "shard_id")


def shard_sizes(spark, d):
    return _base(spark, d).groupBy("shard_id").agg(F.count("*").alias("n_vectors"))


# Boundaries, routing and sharded search


def assign_top2(spark, d):
    return _rounded(clustering.assign(_base(spark, d), _means(spark, d), top=2), "dist", "second_dist")


def boundary_vectors(spark, d):
    return _rounded(routing.boundary(_base(spark, d), _means(spark, d), 1.05), "ratio")


def _with_replicas(spark, d, tau: float = 1.05) -> DataFrame:
    base = _base(spark, d)
    return routing.with_replicas(base, routing.replicas(routing.boundary(base, _means(spark, d), tau), base))


def boundary_replicas(spark, d):
    return _with_replicas(spark, d)


def local_global_ids(spark, d):
    return clustering.local_ids(_with_replicas(spark, d))


def _route(spark, d, nprobe: int) -> DataFrame:
    return routing.route(_queries(spark, d), np.arange(2), _means(spark, d), nprobe)


def route_nprobe1(spark, d):
    return _route(spark, d, 1).select("qid", "shard_id")


def route_nprobe2(spark, d):
    return _route(spark, d, 2).select("qid", "shard_id")


def route_fine(spark, d):
    ids, means, _ = _labels(spark, d)
    return routing.route(_queries(spark, d), (ids >= 5).astype(int), means, 1).select("qid", "shard_id")


def route_all(spark, d):
    return routing.route_all(_queries(spark, d), 2).select("qid", "shard_id")


def queries_per_shard(spark, d):
    return routing.queries_per_shard(_route(spark, d, 1))


def _sharded(spark, d, nprobe: int, members: DataFrame | None = None) -> DataFrame:
    return merge_topk(routed_scan(_base(spark, d) if members is None else members, _route(spark, d, nprobe), K), K)


def sharded_knn_nprobe1(spark, d):
    return _rounded(_sharded(spark, d, 1), "dist")


def sharded_knn_nprobe2(spark, d):
    return _rounded(_sharded(spark, d, 2), "dist")


def sharded_knn_nested(spark, d):
    members = _with_replicas(spark, d).join(_base(spark, d).select("vec_id", "embedding"), "vec_id")
    return _rounded(_sharded(spark, d, 1, members), "dist")


def shard_candidates(spark, d):
    """The best of each shard before the merge."""
    base = _base(spark, d)
    out = None
    for s in (0, 1):
        one = merge_topk(routed_scan(base.where(F.col("shard_id") == s), routing.route_all(_queries(spark, d), 2), 3), 3).withColumn("shard_id", F.lit(s))
        out = one if out is None else out.unionByName(one)
    return _rounded(out, "dist")


def recall_at_k(spark, d):
    q = _queries(spark, d)
    return _rounded(evaluation.recall_at_k(_sharded(spark, d, 1), exact_knn(_base(spark, d), q, K), q.count(), K), "recall")


def batched_knn(spark, d):
    return _rounded(batched_search(_label_index(spark, d), _queries(spark, d), 2, K, 1), "dist")


def _label_index(spark, d) -> ShardedIndex:
    """Shards by labels, routed by their means."""
    base = _base(spark, d)
    return ShardedIndex(Options(), V.check_dimension(base), base.withColumn("is_replica", F.lit(False)), np.arange(2), _means(spark, d))


def timing(spark, d):
    """The timing sums of a search in batches of two."""
    timings = [t for _, t in run_batches(_label_index(spark, d), _queries(spark, d), 2, K, 1)]
    report = evaluation.timing_report(spark.createDataFrame(timings, "batch_id long, n_queries long, seconds double, idle double"))
    return report.select("batches", "queries", (F.col("seconds") > 0).alias("timed"), (F.abs(F.col("avg_seconds") * F.col("batches") - F.col("seconds")) < 1e-9).alias("mean_fits"))


def csv_log(spark, d):
    """Search results written as CSV with a header and read again."""
    folder = _folder(spark)
    write_csv(_label_index(spark, d).search(_queries(spark, d), K, 2), folder)
    back = spark.read.option("header", True).schema("query_id long, rank int, label long, distance double").csv(folder)
    return _rounded(back, "distance")


def incremental_add(spark, d):
    """The queries' vectors appended under new ids to the shards whose mean is nearest."""
    base = _base(spark, d)
    index = ShardedIndex(Options(), V.check_dimension(base), base.select("vec_id", "shard_id", F.lit(False).alias("is_replica"), "embedding"), np.arange(2), _means(spark, d))
    new = _queries(spark, d).select((F.col("qid") + NEW_IDS).alias("vec_id"), "embedding")
    return index.append(new).counts()


# Whole models


def _fit(spark, d, **kw) -> ShardedIndex:
    base = _base(spark, d)
    return ShardedIndex.fit(base, Options(num_fine_clusters=20, niter=5), **kw)


def _production(vectors: DataFrame) -> ShardedIndex:
    """The drivers' own settings, but for fewer fine clusters where the table has few rows, and replicas for a recall of 0.9."""
    return ShardedIndex.fit(vectors, num_fine_clusters=min(Options().num_fine_clusters, max(2, vectors.count() // 2)), nested=True, boundary_tau=1.1)


def flagship(spark, d):
    return _production(_base(spark, d)).search(_queries(spark, d), K, 1)


def index_recall(spark, d):
    """Recall of the index against brute force: every hundredth vector against the whole table."""
    vectors, q = _all(spark, d), _queries(spark, d)
    found = _production(vectors).search(q, K, 1)
    return _rounded(evaluation.recall_at_k(found, exact_knn(vectors, q, K), q.count(), K), "recall")


def index_search(spark, d):
    return _rounded(flagship(spark, d), "dist")


def index_greedy(spark, d):
    return _fit(spark, d, merge="greedy").counts()


def index_kmeans(spark, d):
    return _fit(spark, d, partitioner="kmeans", num_shards=4).counts()


def index_subcluster_router(spark, d):
    return _fit(spark, d, router="subcluster", router_samples=8).route(_queries(spark, d), 1).select("qid", "shard_id")


def index_sample_router(spark, d):
    return _fit(spark, d, router="sample", router_samples=8).route(_queries(spark, d), 1).select("qid", "shard_id")


def _folder(spark: SparkSession) -> str:
    """A new folder in the shared one."""
    return f"{shared_dir(spark)}/lodestar-{uuid.uuid4().hex}"


def index_save_load(spark, d):
    path = _folder(spark)
    _production(_base(spark, d)).save(path)
    return _rounded(ShardedIndex.load(spark, path).search(_queries(spark, d), K, 1), "dist")


def hnsw_knn(spark, d):
    return _rounded(_fit(spark, d, hnsw_m=16).search(_queries(spark, d), K, 2, "hnsw"), "dist")


def fvecs_roundtrip(spark, d):
    path = _folder(spark).removeprefix("file://")
    vectors = _all(spark, d)
    write_fvecs(vectors, path)
    back = read_fvecs(spark, path)
    same = back.withColumnRenamed("embedding", "x").join(vectors, "vec_id").where("x = embedding")
    return same.agg(F.count("*").alias("n_same"))


def shard_export(spark, d):
    """Primary vectors of each shard written as its fvecs folder, read back and counted, with the sum of their components."""
    folder, vectors = _folder(spark).removeprefix("file://"), _base(spark, d)
    paths = export_shards(vectors.select("vec_id", "embedding"), _with_replicas(spark, d), folder, "base", 0.5)
    out = None
    for p in paths:
        shard = int(p.rsplit("_", 2)[1])
        total = F.sum(F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, x: a + x))
        one = read_fvecs(spark, p).agg(F.lit(shard).alias("shard_id"), F.count("*").alias("n_vectors"), F.round(total, 4).alias("total"))
        out = one if out is None else out.unionByName(one)
    return out


#: Calls that must be refused before any job of theirs runs.
REFUSED = {
    "dimension": lambda base, q: V.check_dimension(q.withColumn("embedding", F.slice("embedding", 1, 3)), expect=64),
    "fine clusters above vectors": lambda base, q: Options(num_fine_clusters=1 << 40).check(base.count()),
    "fine clusters below shards": lambda base, q: Options(num_fine_clusters=1).check(base.count()),
    "k": lambda base, q: exact_knn(base, q, 0),
    "merge": lambda base, q: Options(merge="nearest").check(1000),
    "metric": lambda base, q: exact_knn(base, q, 1, "cosine"),
    "no vectors": lambda base, q: Options().check(0),
    "nprobe": lambda base, q: routing.route(q, np.arange(2), np.zeros((2, 64)), 0),
    "partitioner": lambda base, q: Options(partitioner="grid").check(1000),
    "router": lambda base, q: Options(router="all").check(1000),
    "shards": lambda base, q: Options(num_shards=3).check(1000),
}


def validation(spark, d):
    """Whether each wrong argument is refused."""
    rows = []
    for name, call in REFUSED.items():
        try:
            call(_base(spark, d), _queries(spark, d))
            rows.append((name, False))
        except ValueError:
            rows.append((name, True))
    return spark.createDataFrame(rows, "argument string, refused boolean")


def index_reset(spark, d):
    """Rows before, after a reset, and after the queries' vectors are appended to what is left."""
    full = _fit(spark, d, nested=True, boundary_tau=1.05)
    before = full.members.where("not is_replica").agg(F.lit("fit").alias("state"), F.count("*").alias("n_vectors")).collect()
    empty = full.reset()
    new = empty.append(_queries(spark, d).select(F.col("qid").alias("vec_id"), "embedding"))
    rows = [(r.state, r.n_vectors) for r in before] + [("reset", empty.members.count()), ("append", new.members.count())]
    return spark.createDataFrame(rows, "state string, n_vectors long")


def stream_knn(spark, d):
    folder = _folder(spark)
    _queries(spark, d).repartition(3).write.parquet(f"{folder}/queries")
    stream = spark.readStream.schema("qid long, embedding array<float>").option("maxFilesPerTrigger", 1).parquet(f"{folder}/queries")
    query, _ = stream_search(_label_index(spark, d), stream, f"{folder}/out", f"{folder}/state", K, 1)
    query.awaitTermination()
    return _rounded(spark.read.parquet(f"{folder}/out").select("qid", "rank", "vec_id", "dist"), "dist")


_BASE = f"""e AS (SELECT vec_id, label, CAST({SHARD} AS INT) AS shard_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
b AS (SELECT * FROM e), q AS (SELECT vec_id AS qid, v FROM e WHERE vec_id % {EVERY} = 0)"""
_LABELS = """, lm AS (SELECT label, any_value(n) AS n, list(m ORDER BY j) AS c FROM (SELECT label, j, avg(v[j]) AS m, count(*) AS n FROM b, range(1, 65) t(j) GROUP BY ALL) GROUP BY label)"""


def _means_sql(b: str = "b") -> str:
    return f", sm AS (SELECT shard_id, list(m ORDER BY j) AS c FROM (SELECT shard_id, j, avg(v[j]) AS m FROM {b}, range(1, 65) t(j) GROUP BY ALL) GROUP BY shard_id)"


def _top2_sql(b: str = "b", tau: float = 1.05) -> str:
    return f""", d2 AS (SELECT vec_id, {b}.shard_id AS own, sm.shard_id AS s, pow(list_distance(v, c), 2) AS d, row_number() OVER (PARTITION BY vec_id ORDER BY list_distance(v, c), sm.shard_id) AS r FROM {b}, sm),
    t2 AS (SELECT x.vec_id, x.own, x.s AS cluster_id, x.d AS dist, y.s AS second_id, y.d AS second_dist FROM d2 x JOIN d2 y USING (vec_id) WHERE x.r = 1 AND y.r = 2),
    bd AS (SELECT vec_id, own, cluster_id AS first_id, second_id, second_dist / dist AS ratio FROM t2 WHERE dist > 0 AND second_dist / dist < {tau}),
    wr AS (SELECT vec_id, shard_id, false AS is_replica FROM {b} UNION ALL SELECT vec_id, CASE WHEN second_id = own THEN first_id ELSE second_id END, true FROM bd)"""


_MEANS, _TOP2 = _means_sql(), _top2_sql()
_ROUTE = """, rt AS (SELECT qid, sm.shard_id, q.v, row_number() OVER (PARTITION BY qid ORDER BY list_distance(q.v, c), sm.shard_id) AS r FROM q, sm)"""


def _knn(pairs: str, k: int = K, extra: str = "", cols: str = "qid, CAST(rank AS INT) AS rank, vec_id, round(dist, 6) AS dist") -> str:
    return f"WITH {_BASE}{extra}, p AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, vec_id) AS rank FROM ({pairs})) SELECT {cols} FROM p WHERE rank <= {k}"


def _sharded_sql(nprobe: int, members: str = "b") -> str:
    return f"SELECT DISTINCT qid, m.vec_id, pow(list_distance(rt.v, m.v), 2) AS dist FROM rt JOIN {members} m USING (shard_id) WHERE r <= {nprobe}"


def _lloyd_sql(clusters: int | str = CLUSTERS, rounds: int = ROUNDS, b: str = "b", name: str = "", group: str = "") -> str:
    """Rounds of k-means from the vectors of the lowest ids, of the whole table or of each ``group``."""
    g, over = (f"{group}, ", f"PARTITION BY {group} ") if group else ("", "")
    same = f"USING ({group})" if group else "ON true"
    first = f"row_number() OVER ({over}ORDER BY vec_id)"
    out = f", {name}c0 AS MATERIALIZED (SELECT {g}CAST({first} - 1 AS INT) AS cluster_id, v AS c FROM {b} QUALIFY {first} <= {clusters})"
    for i in range(rounds):
        out += f""", {name}a{i} AS MATERIALIZED (SELECT {g}vec_id, v, cluster_id FROM {b} JOIN {name}c{i} {same} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY list_distance(v, c), cluster_id) = 1),
        {name}n{i} AS (SELECT {g}cluster_id, list(m ORDER BY j) AS c FROM (SELECT {g}cluster_id, j, avg(v[j]) AS m FROM {name}a{i}, range(1, 65) t(j) GROUP BY ALL) GROUP BY ALL),
        {name}c{i + 1} AS MATERIALIZED (SELECT {g}o.cluster_id, coalesce(n.c, o.c) AS c FROM {name}c{i} o LEFT JOIN {name}n{i} n USING ({g}cluster_id))"""
    return out


def _fine_sql(clusters: int | str, rounds: int) -> str:
    """Fine clusters as the table lm, and each vector's."""
    return f"""{_lloyd_sql(clusters, rounds)}, fa AS MATERIALIZED (SELECT vec_id, v, cluster_id FROM b, c{rounds} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY list_distance(v, c), cluster_id) = 1),
    lm AS MATERIALIZED (SELECT o.cluster_id AS label, count(fa.vec_id) AS n, any_value(o.c) AS c FROM c{rounds} o LEFT JOIN fa USING (cluster_id) GROUP BY o.cluster_id)"""


def _greedy_sql(clusters: int = 10, linkage: str = "min") -> str:
    """Seeds, then a round for each other cluster of lm: the nearest free one joins its shard within the limits."""
    out = """, t AS MATERIALIZED (SELECT CAST(sum(n) AS BIGINT) AS total, CAST(floor(sum(n) * 0.5) AS BIGINT) AS goal FROM lm),
    sd AS MATERIALIZED (SELECT x.label AS a, y.label AS z FROM lm x, lm y WHERE x.label < y.label ORDER BY list_distance(x.c, y.c) DESC, a, z LIMIT 1),
    s0 AS MATERIALIZED (SELECT a AS label, 0 AS shard FROM sd UNION ALL SELECT z, 1 FROM sd)"""
    for i in range(clusters - 2):
        to = f"s{i} s JOIN lm y USING (label)"
        if linkage == "centroid":
            out += f", m{i} AS MATERIALIZED (SELECT shard, list(m ORDER BY j) AS c FROM (SELECT shard, j, sum(n * c[j]) / sum(n) AS m FROM s{i} JOIN lm USING (label), range(1, 65) t(j) GROUP BY ALL) GROUP BY shard)"
            to = f"m{i} y"
        out += f""", l{i} AS (SELECT sum(CASE WHEN shard = 0 THEN n END) AS n0, sum(CASE WHEN shard = 1 THEN n END) AS n1 FROM s{i} JOIN lm USING (label)),
        f{i} AS (SELECT x.label, any_value(x.n) AS n, min(CASE WHEN shard = 0 THEN list_distance(x.c, y.c) END) AS d0, min(CASE WHEN shard = 1 THEN list_distance(x.c, y.c) END) AS d1
            FROM lm x, {to} WHERE x.label NOT IN (SELECT label FROM s{i}) GROUP BY x.label),
        p{i} AS (SELECT f.*, CASE WHEN d0 < d1 THEN CASE WHEN n0 + n > goal * 1.06 THEN 1 ELSE 0 END ELSE CASE WHEN n1 + n > (total - goal) * 1.06 THEN 0 ELSE 1 END END AS shard FROM f{i} f, l{i}, t),
        s{i + 1} AS MATERIALIZED (SELECT label, shard FROM s{i} UNION ALL (SELECT label, shard FROM p{i} ORDER BY CASE WHEN shard = 0 THEN d0 ELSE d1 END, label LIMIT 1))"""
    return out


def _pca_sql(steps: int = POWER, stop: float = 0.0) -> str:
    """Shards of the clusters of lm; the principal axis by power steps, written as a recursive query over one vector."""
    return f""", w AS MATERIALIZED (SELECT j, sum(n * c[j]) / sum(n) AS m FROM lm, range(1, 65) t(j) GROUP BY j),
    x AS MATERIALIZED (SELECT label, any_value(n) AS n, list(c[j] - m ORDER BY j) AS x FROM lm, w GROUP BY label),
    co AS MATERIALIZED (SELECT i, list(s ORDER BY j) AS r FROM (SELECT i, j, sum(n * x[i] * x[j]) AS s FROM x, range(1, 65) a(i), range(1, 65) z(j) GROUP BY i, j) GROUP BY i),
    cm AS MATERIALIZED (SELECT list(r ORDER BY i) AS m FROM co),
    pw AS (SELECT 0 AS step, list_transform(x, lambda y: y / sqrt(list_inner_product(x, x))) AS v, false AS done FROM x WHERE label = (SELECT min(label) FROM x)
        UNION ALL SELECT step + 1, y, abs(abs(list_inner_product(y, v)) - 1) < {stop} FROM
            (SELECT step, v, list_transform(u, lambda y: y / sqrt(list_inner_product(u, u))) AS y FROM (SELECT step, v, list_transform(m, lambda r: list_inner_product(r, v)) AS u FROM pw, cm WHERE step < {steps} AND NOT done))),
    pr AS MATERIALIZED (SELECT label, n, list_inner_product(x, v) AS p FROM x, (SELECT v FROM pw ORDER BY step DESC LIMIT 1)),
    cu AS (SELECT label, n, row_number() OVER o AS i, sum(n) OVER o AS cum, (SELECT CAST(floor(sum(n) * 0.5) AS BIGINT) FROM lm) AS goal FROM pr WINDOW o AS (ORDER BY p, label ROWS UNBOUNDED PRECEDING)),
    ct AS (SELECT greatest(1, least((SELECT count(*) FROM lm) - 1, CASE WHEN i > 1 AND abs(cum - n - goal) < abs(cum - goal) THEN i - 1 ELSE i END)) AS cut FROM cu WHERE cum >= goal ORDER BY i LIMIT 1),
    me AS MATERIALIZED (SELECT label AS cluster_id, n AS size, CAST(CASE WHEN i <= cut THEN 0 ELSE 1 END AS INT) AS shard_id FROM cu, ct)"""


def _index_sql(clusters: int | str, rounds: int) -> str:
    """The vectors of a fitted index as the table ib, as the merge by principal axis deals them."""
    return f"WITH RECURSIVE {_BASE}{_fine_sql(clusters, rounds)}{_pca_sql(100, 1e-6)}, ib AS MATERIALIZED (SELECT vec_id, v, shard_id FROM fa JOIN me USING (cluster_id))"


def _routed_sql(router: str) -> str:
    """The shard of each query's nearest row of ``router(shard_id, c)``."""
    return f"SELECT qid, shard_id FROM q, {router} r QUALIFY row_number() OVER (PARTITION BY qid ORDER BY list_distance(q.v, r.c), shard_id) = 1"


def _hash_sql(seed: int) -> str:
    return f"('0x' || substr(md5('{seed}:' || vec_id), 1, 8))::BIGINT"


#: The production index: fine clusters and iterations as the catalogue sets them, replicas of tau 1.1, the nearest shard.
_INDEX = _index_sql("(SELECT least(1000, count(*) // 2) FROM e)", 25) + _means_sql("ib") + _top2_sql("ib", 1.1) + _ROUTE
_FOUND = f"""SELECT qid, vec_id, dist, row_number() OVER (PARTITION BY qid ORDER BY dist, vec_id) AS rank FROM
    (SELECT qid, wr.vec_id, min(pow(list_distance(rt.v, ib.v), 2)) AS dist FROM rt JOIN wr USING (shard_id) JOIN ib ON ib.vec_id = wr.vec_id WHERE rt.r = 1 GROUP BY ALL)"""
_SMALL = _index_sql(20, 5)

_W = f"WITH {_BASE}"
_ALL_PAIRS = "SELECT qid, vec_id, pow(list_distance(q.v, b.v), 2) AS dist FROM q, b"
_ONE = "(SELECT v AS o FROM e WHERE vec_id = 0)"

ORACLES: dict[str, str] = {
    "knn_exact_l2": _knn(_ALL_PAIRS),
    "knn_exact_ip": _knn("SELECT qid, vec_id, -list_inner_product(q.v, b.v) * (1 + label) AS dist FROM q, b", cols="qid, CAST(rank AS INT) AS rank, vec_id, round(-dist, 6) AS ip"),
    "knn_ties": _knn(f"SELECT qid, vec_id + c * {NEW_IDS} AS vec_id, pow(list_distance(q.v, b.v), 2) AS dist FROM q, b, range({COPIES}) t(c)", TIED),
    "topk_padded": f"{_W}, p AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, vec_id) AS rank FROM ({_ALL_PAIRS}) WHERE dist < {RADIUS}), w AS (SELECT qid, rank FROM q, range(1, {K + 1}) t(rank)) SELECT qid, CAST(rank AS INT) AS rank, coalesce(vec_id, -1) AS vec_id, round(dist, 6) AS dist FROM w LEFT JOIN p USING (qid, rank)",
    "range_filter": f"{_W} SELECT vec_id, round(pow(list_distance(v, o), 2), 6) AS dist FROM b, {_ONE} WHERE pow(list_distance(v, o), 2) < 1.8",
    "vector_functions": f"{_W} SELECT vec_id, round(pow(list_distance(v, o), 2), 6) AS sq, round(list_distance(v, o), 6) AS l2, round(list_inner_product(v, o), 6) AS ip, round(sqrt(list_inner_product(v, v)), 6) AS norm, round(list_inner_product(v, o) - list_inner_product(o, o), 6) AS proj, round(CASE WHEN list_distance(v, o) > 0 THEN (v[1] - o[1]) / list_distance(v, o) ELSE 0 END, 6) AS unit0 FROM b, {_ONE}",
    "query_limit": _knn(_ALL_PAIRS + " WHERE qid IN (SELECT qid FROM q ORDER BY qid LIMIT 3)", 3),
    "shard_means": f"{_W} SELECT shard_id, CAST(j - 1 AS INT) AS dim, round(avg(v[j]), 6) AS value FROM b, range(1, 65) t(j) GROUP BY shard_id, j",
    "weighted_mean": f"{_W} SELECT 0 AS shard_id, CAST(j - 1 AS INT) AS dim, round(avg(v[j]), 6) AS value FROM b, range(1, 65) t(j) GROUP BY j",
    "kmeans_lloyd": f"{_W}{_lloyd_sql()} SELECT cluster_id, CAST(j - 1 AS INT) AS dim, round(c[j], 6) AS value FROM c{ROUNDS}, range(1, 65) t(j)",
    "nearest_centroid": f"{_W}{_lloyd_sql()} SELECT vec_id, cluster_id, round(pow(list_distance(v, c), 2), 6) AS dist FROM b, c{ROUNDS} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY list_distance(v, c), cluster_id) = 1",
    "cluster_sizes": f"{_W} SELECT CAST(i AS INT) AS cluster_id, count(vec_id) AS size FROM range(12) t(i) LEFT JOIN b ON label = i GROUP BY i",
    "cluster_stats": f"{_W}, s AS (SELECT label, count(*) AS n FROM b GROUP BY label) SELECT min(n) AS min_size, max(n) AS max_size, CAST(floor(sum(n) / count(*)) AS BIGINT) AS avg_size FROM s",
    "farthest_pair": f"{_W}{_LABELS} SELECT x.label AS a, y.label AS b, round(list_distance(x.c, y.c), 6) AS dist FROM lm x, lm y WHERE x.label < y.label ORDER BY list_distance(x.c, y.c) DESC, 1, 2 LIMIT 1",
    "pca_bisection": f"WITH RECURSIVE {_BASE}{_LABELS}{_pca_sql()} SELECT cluster_id, size, shard_id FROM me",
    "cluster_to_shard": f"WITH RECURSIVE {_BASE}{_LABELS}{_pca_sql()} SELECT vec_id, me.shard_id FROM b JOIN me ON cluster_id = label",
    "greedy_min": f"{_W}{_LABELS}{_greedy_sql()} SELECT label AS cluster_id, n AS size, CAST(shard AS INT) AS shard_id FROM s8 JOIN lm USING (label)",
    "greedy_centroid": f"{_W}{_LABELS}{_greedy_sql(linkage='centroid')} SELECT label AS cluster_id, n AS size, CAST(shard AS INT) AS shard_id FROM s8 JOIN lm USING (label)",
    "hash_partition": f"SELECT vec_id, CAST({_hash_sql(42)} % 4 AS INT) AS shard_id FROM embeddings",
    "index_search": f"{_INDEX} SELECT qid, CAST(rank AS INT) AS rank, vec_id, round(dist, 6) AS dist FROM ({_FOUND}) WHERE rank <= {K}",
    "index_save_load": f"{_INDEX} SELECT qid, CAST(rank AS INT) AS rank, vec_id, round(dist, 6) AS dist FROM ({_FOUND}) WHERE rank <= {K}",
    "index_recall": f"{_INDEX}, g AS (SELECT qid, vec_id FROM ({_FOUND}) WHERE rank <= {K}), tr AS (SELECT qid, vec_id FROM ({_ALL_PAIRS}) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY dist, vec_id) <= {K}) SELECT count(*) AS hits, round(count(*) / ({K}.0 * (SELECT count(*) FROM q)), 6) AS recall FROM g JOIN tr USING (qid, vec_id)",
    "index_greedy": f"{_W}{_fine_sql(20, 5)}{_greedy_sql(20, 'centroid')} SELECT CAST(shard AS INT) AS shard_id, CAST(sum(n) AS BIGINT) AS n_vectors, CAST(sum(n) AS BIGINT) AS n_rows_physical FROM s18 JOIN lm USING (label) GROUP BY shard",
    "index_kmeans": f"{_W}{_fine_sql(4, 5)} SELECT label AS shard_id, n AS n_vectors, n AS n_rows_physical FROM lm WHERE n > 0",
    "index_subcluster_router": f"{_SMALL}{_lloyd_sql(8, 10, 'ib', 'r', 'shard_id')} {_routed_sql('rc10')}",
    "index_sample_router": f"{_SMALL}, sr AS (SELECT shard_id, v AS c FROM ib QUALIFY row_number() OVER (PARTITION BY shard_id ORDER BY {_hash_sql(142)}, vec_id) <= 8) {_routed_sql('sr')}",
    "shard_sizes": f"{_W} SELECT shard_id, count(*) AS n_vectors FROM b GROUP BY shard_id",
    "assign_top2": f"{_W}{_MEANS}{_TOP2} SELECT vec_id, cluster_id, round(dist, 6) AS dist, second_id, round(second_dist, 6) AS second_dist FROM t2",
    "boundary_vectors": f"{_W}{_MEANS}{_TOP2} SELECT vec_id, first_id, second_id, round(ratio, 6) AS ratio FROM bd",
    "boundary_replicas": f"{_W}{_MEANS}{_TOP2} SELECT * FROM wr",
    "local_global_ids": f"{_W}{_MEANS}{_TOP2} SELECT *, row_number() OVER (PARTITION BY shard_id ORDER BY is_replica, vec_id) - 1 AS local_id FROM wr",
    "route_nprobe1": f"{_W}{_MEANS}{_ROUTE} SELECT qid, shard_id FROM rt WHERE r = 1",
    "route_nprobe2": f"{_W}{_MEANS}{_ROUTE} SELECT qid, shard_id FROM rt WHERE r <= 2",
    "route_fine": f"{_W}{_LABELS} SELECT qid, CAST(CASE WHEN label < 5 THEN 0 ELSE 1 END AS INT) AS shard_id FROM q, lm QUALIFY row_number() OVER (PARTITION BY qid ORDER BY list_distance(q.v, c), label) = 1",
    "route_all": f"{_W} SELECT qid, CAST(s AS INT) AS shard_id FROM q, range(2) t(s)",
    "queries_per_shard": f"{_W}{_MEANS}{_ROUTE} SELECT shard_id, count(DISTINCT qid) AS n_queries FROM rt WHERE r = 1 GROUP BY shard_id",
    "sharded_knn_nprobe1": _knn(_sharded_sql(1), extra=_MEANS + _ROUTE),
    "sharded_knn_nprobe2": _knn(_sharded_sql(2), extra=_MEANS + _ROUTE),
    "sharded_knn_nested": _knn(_sharded_sql(1, "(SELECT wr.vec_id, wr.shard_id, b.v FROM wr JOIN b USING (vec_id))"), extra=_MEANS + _TOP2 + _ROUTE),
    "shard_candidates": f"{_W}, p AS (SELECT qid, vec_id, shard_id, pow(list_distance(q.v, b.v), 2) AS dist, row_number() OVER (PARTITION BY qid, shard_id ORDER BY list_distance(q.v, b.v), vec_id) AS rank FROM q, b) SELECT qid, CAST(rank AS INT) AS rank, vec_id, round(dist, 6) AS dist, shard_id FROM p WHERE rank <= 3",
    "recall_at_k": f"{_W}{_MEANS}{_ROUTE}, g AS (SELECT qid, vec_id FROM ({_sharded_sql(1)}) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY dist, vec_id) <= {K}), t AS (SELECT qid, vec_id FROM ({_ALL_PAIRS}) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY dist, vec_id) <= {K}) SELECT count(*) AS hits, round(count(*) / ({K}.0 * (SELECT count(*) FROM q)), 6) AS recall FROM g JOIN t USING (qid, vec_id)",
    "batched_knn": _knn(_sharded_sql(1), extra=_MEANS + _ROUTE, cols="(SELECT CAST(floor((count(*) - 1) / 2) AS BIGINT) FROM q WHERE q.qid <= p.qid) AS batch_id, qid, CAST(rank AS INT) AS rank, vec_id, round(dist, 6) AS dist"),
    "timing": f"{_W} SELECT CAST(ceil(count(*) / 2) AS BIGINT) AS batches, count(*) AS queries, true AS timed, true AS mean_fits FROM q",
    "csv_log": _knn(_sharded_sql(2), extra=_MEANS + _ROUTE, cols="qid AS query_id, CAST(rank AS INT) AS rank, vec_id AS label, round(dist, 6) AS distance"),
    "stream_knn": _knn(_sharded_sql(1), extra=_MEANS + _ROUTE),
    "incremental_add": f"{_W}{_MEANS}{_ROUTE} SELECT shard_id, count(*) AS n_vectors, count(*) AS n_rows_physical FROM (SELECT shard_id FROM b UNION ALL SELECT shard_id FROM rt WHERE r = 1) GROUP BY shard_id",
    "shard_export": f"{_W} SELECT shard_id, count(*) AS n_vectors, round(sum(list_sum(v)), 4) AS total FROM b GROUP BY shard_id",
    "validation": "SELECT argument, true AS refused FROM (VALUES " + ", ".join(f"('{x}')" for x in REFUSED) + ") t(argument)",
    "index_reset": f"{_W} SELECT 'fit' AS state, count(*) AS n_vectors FROM b UNION ALL SELECT 'reset', 0 UNION ALL SELECT 'append', count(*) FROM q",
    "fvecs_roundtrip": "SELECT count(*) AS n_same FROM embeddings",
}

QUERIES = {
    f.__name__: f
    for f in (
        knn_exact_l2, knn_exact_ip, knn_ties, topk_padded, range_filter, vector_functions, query_limit, shard_means, weighted_mean, kmeans_lloyd, nearest_centroid, cluster_sizes, cluster_stats,
        farthest_pair, pca_bisection, cluster_to_shard, greedy_min, greedy_centroid, hash_partition, shard_sizes, assign_top2, boundary_vectors, boundary_replicas, local_global_ids,
        route_nprobe1, route_nprobe2, route_fine, route_all, queries_per_shard, sharded_knn_nprobe1, sharded_knn_nprobe2, sharded_knn_nested, shard_candidates, recall_at_k, batched_knn, timing, csv_log,
        incremental_add, index_search, index_recall, index_greedy, index_kmeans, index_subcluster_router, index_sample_router, index_save_load, index_reset, validation, hnsw_knn, fvecs_roundtrip, shard_export, stream_knn,
    )
}
