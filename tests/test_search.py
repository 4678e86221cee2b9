"""Sharded search: operators against brute force, and one test for each decision on odd behaviour."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.functions import vectors as V
from lodestar.operators import clustering, evaluation, merging, routing
from lodestar.operators.hnsw import Graph, build_graphs, hnsw_search, nearest_segments
from lodestar.operators.numbering import row_numbers
from lodestar.operators.scan import exact_knn, merge_topk, pad_topk, routed_scan
from lodestar.plans.index import Options, ShardedIndex, evaluate
from lodestar.sources import fvecs
from lodestar.streaming.batches import batched_search, run_batches, stream_search


def frame(spark, x, first=0, name="vec_id"):
    return spark.createDataFrame([(first + i, [float(v) for v in r]) for i, r in enumerate(x)], f"{name} long, embedding array<float>").repartition(3)


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 12)).astype(np.float32)
    x[7] = x[8]
    q = rng.normal(size=(20, 12)).astype(np.float32)
    return x, q, frame(spark, x).cache(), frame(spark, q, name="qid").cache()


def brute(x, q, k, metric="l2"):
    x, q = x.astype(np.float64), q.astype(np.float64)
    d = -(q @ x.T) if metric == "ip" else ((q[:, None] - x[None]) ** 2).sum(2)
    return [np.lexsort((np.arange(len(x)), r))[:k].tolist() for r in d]


def ids(df):
    out = {}
    for r in df.orderBy("qid", "rank").collect():
        out.setdefault(r.qid, []).append(r.vec_id)
    return [out.get(i, []) for i in range(max(out) + 1)] if out else []


@pytest.mark.parametrize("metric", ["l2", "ip"])
def test_exact(data, metric):
    x, q, base, queries = data
    assert ids(exact_knn(base, queries, 10, metric)) == brute(x, q, 10, metric)


def test_exact_in_query_blocks(data, monkeypatch):
    from lodestar.operators import scan

    x, q, base, queries = data
    monkeypatch.setattr(scan, "QUERY_BLOCK", 7)
    assert ids(exact_knn(base, queries, 5)) == brute(x, q, 5)


@pytest.mark.parametrize("metric", ["l2", "ip"])
def test_ties_go_to_the_lowest_ids(spark, metric):
    rng = np.random.default_rng(9)
    some = rng.normal(size=(6, 8)).astype(np.float32)
    x = some[rng.integers(0, 6, 900)] * 3
    order = rng.permutation(len(x))
    q = np.concatenate([some[:3] * 3, rng.normal(size=(4, 8)).astype(np.float32)])
    base = spark.createDataFrame([(int(i), [float(v) for v in x[i]]) for i in order], "vec_id long, embedding array<float>")
    for parts in (1, 5):
        assert ids(exact_knn(base.repartition(parts), frame(spark, q, name="qid"), 7, metric)) == brute(x, q, 7, metric)


def test_row_numbers_of_ranges(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), int(rng.integers(0, 3)), bool(rng.integers(0, 2))) for i in rng.permutation(500)]
    df = spark.createDataFrame(rows, "vec_id long, shard_id int, is_replica boolean").repartition(4)
    for size in (1_000_000, 37):
        got = row_numbers(df, ["shard_id"], "vec_id", "at", size).collect()
        want = {r: sum(s == r[1] and i < r[0] for i, s, _ in rows) for r in rows}
        assert len(got) == 500 and all(r["at"] == want[r.vec_id, r.shard_id, r.is_replica] for r in got)
    assert row_numbers(df.limit(0), ["shard_id"], "vec_id", "at").count() == 0


def test_padding(spark, data):
    _, _, base, queries = data
    few = base.where("vec_id < 3")
    rows = pad_topk(exact_knn(few, queries, 5), queries, 5).collect()
    assert len(rows) == 100 and sum(r.vec_id == -1 for r in rows) == 40
    assert pad_topk(exact_knn(base.limit(0), queries, 2), queries, 2).where("vec_id = -1").count() == 40


def test_validation(spark, data):
    _, _, base, queries = data
    with pytest.raises(ValueError):
        exact_knn(base, queries, 0)
    with pytest.raises(ValueError):
        exact_knn(base, queries, 1, "cosine")
    with pytest.raises(ValueError):
        V.check_dimension(base.unionByName(spark.createDataFrame([(999, [1.0])], base.schema)))
    with pytest.raises(ValueError):
        routing.route(queries, np.arange(2), np.zeros((2, 12)), 0)
    for bad in ({"merge": "x"}, {"num_shards": 3}, {"num_fine_clusters": 1}, {"num_fine_clusters": 301}, {"partitioner": "x"}, {"router": "x"}):
        with pytest.raises(ValueError):
            ShardedIndex.fit(base, **({"num_fine_clusters": 5, "niter": 1} | bad))


def test_kmeans_and_small_inputs(spark, data):
    x, _, base, _ = data
    c = x[:4].astype(np.float64)
    for _ in range(5):
        near = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
        c = np.array([x[near == i].mean(0) if (near == i).any() else c[i] for i in range(4)], np.float64)
    assert np.allclose(clustering.lloyd(base, 4, 5), c, atol=1e-5)
    small = frame(spark, x[:5])
    for merge in ("pca", "greedy", "greedy_min"):
        assert ShardedIndex.fit(small, num_fine_clusters=4, niter=2, merge=merge).counts().agg(F.sum("n_vectors")).first()[0] == 5
    one = ShardedIndex.fit(small, partitioner="random", num_shards=1, nested=True)
    assert one.counts().first().n_rows_physical == 5


def test_merges():
    rng = np.random.default_rng(3)
    for n in (2, 3, 8, 30):
        c, s = rng.normal(size=(n, 5)), rng.integers(1, 50, n)
        b = merging.pca_bisection(c, s)
        order = np.argsort(b.projection)
        assert (np.diff(b.shard[order]) >= 0).all() and set(b.shard) == {0, 1}
        cut = int((b.shard == 0).sum())
        off = [abs(s[order][:k].sum() - int(s.sum() * 0.5)) for k in range(1, n)]
        assert off[cut - 1] == min(off)
        w = c - (c * s[:, None]).sum(0) / s.sum()
        top = np.linalg.eigh((w * s[:, None]).T @ w)[1][:, -1]
        assert abs(merging.principal_axis(w, s.astype(float), 5000, 0) @ top) == pytest.approx(1, abs=1e-3)
        for linkage in ("min", "centroid"):
            assert set(merging.greedy_merge(c, s, linkage=linkage)) == {0, 1}
    # A midpoint is equally far from both seeds and goes to shard 1.
    assert merging.greedy_merge(np.array([[0.0], [2.0], [1.0]]), np.array([5, 5, 1]), linkage="min").tolist() == [0, 1, 1]
    with pytest.raises(ValueError):
        merging.pca_bisection(np.zeros((1, 2)), [3])


def test_boundary_and_replicas(spark):
    x = np.array([[0.0, 0], [0.1, 0], [2, 0], [2.1, 0], [1.05, 0], [0, 0]], np.float32)
    base = frame(spark, x)
    means = np.array([[0.0, 0], [2.1, 0]])
    got = {r.vec_id: r for r in routing.boundary(base, means, 1.05).collect()}
    assert set(got) == {4}  # vectors on a mean have no ratio
    primary = base.select("vec_id", F.lit(1).alias("shard_id"))
    assert [(r.vec_id, r.shard_id) for r in routing.replicas(routing.boundary(base, means, 1.05), primary).collect()] == [(4, 0)]
    rows = clustering.local_ids(routing.with_replicas(primary, routing.replicas(routing.boundary(base, means, 1.05), primary))).collect()
    assert sorted((r.shard_id, r.local_id) for r in rows) == [(0, 0), *[(1, i) for i in range(6)]]


def test_replicas_and_twice_routed_shards_give_no_duplicates(data):
    x, q, base, queries = data
    index = ShardedIndex.fit(base, num_fine_clusters=10, niter=3, nested=True, boundary_tau=3.0)
    assert index.members.where("is_replica").count() > 0
    rows = index.search(queries, 10, 2).collect()
    assert len({(r.qid, r.vec_id) for r in rows}) == len(rows)
    assert ids(index.search(queries, 10, 2)) == brute(x, q, 10)
    shard, c = np.array([0, 0, 1]), np.array([x[0], x[0] + 0.01, -x[0]], np.float64)
    routed = routing.route(queries, shard, c, 2).collect()
    assert len(routed) == 2 * len(q) and len({(r.qid, r.shard_id) for r in routed}) == len(routed)
    assert routing.route(queries, shard, c, 9).count() == 2 * len(q)


@pytest.mark.parametrize("router", ["means", "fine", "subcluster", "sample"])
def test_routers_and_full_probe(data, router):
    x, q, base, queries = data
    index = ShardedIndex.fit(base, num_fine_clusters=8, niter=2, router=router, router_samples=5)
    assert ids(index.search(queries, 5, 2)) == brute(x, q, 5)
    e1 = evaluate(index, base, queries, 5, 1)
    assert 0 < e1["recall"] <= 1 and e1["qps"] > 0


def test_inner_product_index(data):
    x, q, base, queries = data
    index = ShardedIndex.fit(base, num_fine_clusters=8, niter=2, metric="ip")
    assert ids(index.search(queries, 5, 2)) == brute(x, q, 5, "ip")


def test_recall_grows_with_tau(data):
    _, q, base, queries = data
    truth = exact_knn(base, queries, 5)
    last = 0
    for tau in (1.0001, 1.3, 4.0):
        index = ShardedIndex.fit(base, num_fine_clusters=10, niter=3, nested=True, boundary_tau=tau)
        r = evaluation.recall_at_k(index.search(queries, 5, 1), truth, len(q), 5).first().recall
        assert r >= last
        last = r


def test_append_keeps_ids(spark, data):
    x, q, base, queries = data
    index = ShardedIndex.fit(base, num_fine_clusters=6, niter=2).append(frame(spark, q, first=5000))
    assert index.counts().agg(F.sum("n_vectors")).first()[0] == 320
    got = ids(index.search(queries, 1, 1))
    assert got == [[5000 + i] for i in range(20)]


def test_fit_deals_without_a_join_and_reset_empties(data):
    _, q, base, queries = data
    index = ShardedIndex.fit(base, num_fine_clusters=6, niter=2, nested=True, boundary_tau=1.2)
    dealt = clustering.with_copies(clustering.with_shard(base, index.router_centroids, np.arange(2)), index.router_centroids, 1.2)
    plan = dealt._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]
    assert plan.count("MapInArrow") == 2 and "Exchange" not in plan and "Join" not in plan
    # The one-pass copies are those of the boundary rule.
    own = index.members.where("not is_replica")
    copies = routing.replicas(routing.boundary(own, index.router_centroids, 1.2), own)
    pairs = lambda df: sorted((r.vec_id, r.shard_id) for r in df.collect())
    assert pairs(copies) == pairs(index.members.where("is_replica"))
    empty = index.reset()
    assert empty.counts().count() == 0 and empty.search(queries, 3, 1).count() == 0
    assert empty.append(frame(base.sparkSession, q)).counts().agg(F.sum("n_vectors")).first()[0] == 20
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|FileNotFound|FAILED_READ_FILE"):
        index.members.count()


def test_kmeans_sample_is_bounded(spark, data):
    _, _, base, _ = data
    assert clustering.sample(base, 1000).count() == 300
    assert 30 <= clustering.sample(base, 60).count() <= 90


def test_fit_takes_all_vectors_and_the_first_of_equal_centroids(spark):
    """More vectors than 256 a centroid; two of the first four are equal."""
    rng = np.random.default_rng(4)
    x = rng.integers(-9, 10, (2400, 6)).astype(np.float32)
    x[2] = x[1]
    index = ShardedIndex.fit(frame(spark, x), partitioner="kmeans", num_shards=4, niter=3)
    c = x[:4].astype(np.float64)
    for _ in range(3):
        near = ((x[:, None].astype(np.float64) - c) ** 2).sum(2).argmin(1)
        c = np.array([x[near == i].astype(np.float64).mean(0) if (near == i).any() else c[i] for i in range(4)])
    assert np.allclose(index.router_centroids, c, rtol=0, atol=1e-12)
    few = ShardedIndex.fit(frame(spark, x), partitioner="kmeans", num_shards=4, niter=3, points_per_centroid=64)
    assert not np.allclose(few.router_centroids, c) and few.members.count() == 2400

def test_save_and_load(data, tmp_path):
    _, _, base, queries = data
    index = ShardedIndex.fit(base, num_fine_clusters=6, niter=2, nested=True, graphs=True)
    index.save(str(tmp_path / "i"))
    back = ShardedIndex.load(base.sparkSession, str(tmp_path / "i"))
    assert back.options == index.options and back.graphs is not None
    assert ids(back.search(queries, 7, 1)) == ids(index.search(queries, 7, 1))
    m = base.sparkSession.read.parquet(str(tmp_path / "i" / "manifest")).first()
    assert m.n_vectors == 300 and m.n_rows_physical == index.members.count()
    plan = back.members.where("shard_id = 0")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(shard_id" in plan


def test_hnsw(data):
    x, q, base, queries = data
    g = Graph(x.astype(np.float64), m=8).build()
    want = brute(x, q, 5)
    got = [[v for _, v in g.query(r.astype(np.float64), 5, 64)] for r in q]
    assert np.mean([len(set(a) & set(b)) / 5 for a, b in zip(got, want, strict=True)]) >= 0.95
    index = ShardedIndex.fit(base, num_fine_clusters=6, niter=2, hnsw_m=8, graphs=True)
    assert evaluate(index, base, queries, 5, 2, "hnsw")["recall"] >= 0.95
    assert index.graphs.where("level = 0").agg(F.max(F.size("neighbors"))).first()[0] <= 16
    # What is appended is found through graphs beside those that are there.
    more = index.append(frame(base.sparkSession, q, first=5000))
    assert more.graphs.where("level = 0").count() == 320 and more.graphs.join(index.graphs, ["shard_id", "segment"], "left_anti").where("level = 0").count() == 20
    assert ids(more.search(queries, 1, 2, "hnsw")) == [[5000 + i] for i in range(20)]


def test_hnsw_visits_the_nearest_segments(spark):
    rng = np.random.default_rng(5)
    x = (rng.normal(size=(12, 8))[rng.integers(0, 12, 1200)] * 6 + rng.normal(size=(1200, 8))).astype(np.float32)
    q = x[::60] + 0.1
    base, queries = frame(spark, x), frame(spark, q, name="qid")
    graphs = build_graphs(base.withColumn("shard_id", F.lit(0)), m=8, segment=100).cache()
    sizes = graphs.where("level = 0").groupBy("segment").count().collect()
    assert len(sizes) >= 12 and sum(r["count"] for r in sizes) == 1200 and max(r["count"] for r in sizes) <= 150
    routed = queries.withColumn("shard_id", F.lit(0))
    asked = nearest_segments(graphs, routed, visited=3)
    assert asked.groupBy("qid").count().agg(F.max("count")).first()[0] < len(sizes) / 2
    want = brute(x, q, 5)
    for visited, least in ((3, 0.9), (100, 0.97)):
        got = ids(hnsw_search(graphs, routed, 5, 64, visited=visited))
        assert np.mean([len(set(a) & set(b)) / 5 for a, b in zip(got, want, strict=True)]) >= least


def test_batches_and_stream_equal_one_search(spark, data, tmp_path):
    _, _, base, queries = data
    index = ShardedIndex.fit(base, num_fine_clusters=6, niter=2)
    want = ids(index.search(queries, 4, 1))
    rows = batched_search(index, queries, 6, 4)
    assert ids(rows) == want and rows.where("batch_id <> floor(qid / 6)").count() == 0
    each = list(run_batches(index, queries, 6, 4))
    assert [t[:2] for _, t in each] == [(0, 6), (1, 6), (2, 6), (3, 2)]
    assert [[r.vec_id for r in rows if r.qid == i] for rows, _ in each for i in sorted({r.qid for r in rows})] == want
    queries.repartition(3).write.parquet(str(tmp_path / "q"))
    stream = spark.readStream.schema(queries.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "q"))
    run, timings = stream_search(index, stream, str(tmp_path / "out"), str(tmp_path / "state"), 4)
    run.awaitTermination()
    assert ids(spark.read.parquet(str(tmp_path / "out"))) == want
    t = evaluation.timing_report(spark.createDataFrame(timings, "batch_id long, n_queries long, seconds double, idle double")).first()
    assert t.queries == 20 and t.batches == len(timings) and t.seconds > 0


def test_fvecs(spark, data, tmp_path):
    x, _, base, _ = data
    path = str(tmp_path / "v")
    fvecs.write_fvecs(base, path)
    back = fvecs.read_fvecs(spark, path)
    assert np.array_equal(np.array([r.embedding for r in back.orderBy("vec_id").collect()], np.float32), x)
    raw = tmp_path / "one.fvecs"
    raw.write_bytes(fvecs.encode(x[:10]))
    assert fvecs.read_fvecs(spark, str(raw)).count() == 10
    raw.write_bytes(fvecs.encode(x[:10])[:-4])
    with pytest.raises(Exception, match="whole number"):
        fvecs.read_fvecs(spark, str(raw)).count()
    index = ShardedIndex.fit(base, num_fine_clusters=6, niter=2)
    folders = fvecs.export_shards(base, index.members.select("vec_id", "shard_id", "is_replica"), str(tmp_path), "base", 0.5)
    assert len(set(folders)) == 2 and sum(fvecs.read_fvecs(spark, f).count() for f in folders) == 300


def test_command_line(spark, data, tmp_path, capsys):
    from lodestar.cli import main

    x, q, base, _ = data
    base.write.parquet(str(tmp_path / "b"))
    (tmp_path / "q.fvecs").write_bytes(fvecs.encode(q))
    main(["build", "--base", str(tmp_path / "b"), "--index", str(tmp_path / "i"), "--num-fine-clusters", "6", "--niter", "2", "--nested"])
    main(["search", "--base", str(tmp_path / "b"), "--query", str(tmp_path / "q.fvecs"), "--index", str(tmp_path / "i"), "--nq", "5", "--nprobe", "2", "--csv", str(tmp_path / "c")])
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["recall"] == 1
    for more in (["--bs", "2"], ["--bs", "2", "--pipeline"]):
        main(["search", "--base", str(tmp_path / "b"), "--query", str(tmp_path / "q.fvecs"), "--index", str(tmp_path / "i"), "--nq", "5", *more])
        t = json.loads(capsys.readouterr().out.strip().splitlines()[-2])
        assert (t["batches"], t["queries"]) == (3, 5)
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns == ["query_id", "rank", "label", "distance"]


def test_merge_keeps_the_nearest_of_equal_ids(spark):
    df = spark.createDataFrame([(0, 5, 1.0), (0, 5, 1.0), (0, 6, 0.5), (0, 4, 1.0)], "qid long, vec_id long, dist double")
    assert [(r.rank, r.vec_id) for r in merge_topk(df, 2).orderBy("rank").collect()] == [(1, 6), (2, 4)]


def test_scan_does_not_shuffle_vectors(data):
    _, _, base, queries = data
    zero = F.lit(0).alias("shard_id")
    plan = routed_scan(base.select("vec_id", zero, "embedding"), queries.select("qid", zero, "embedding"), 5)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan.split("InMemoryRelation")[0]


def test_options_default_to_the_drivers():
    o = Options()
    assert (o.num_shards, o.num_fine_clusters, o.niter, o.partition_ratio, o.boundary_tau, o.hnsw_m, o.ef_construction, o.ef_search) == (2, 1000, 25, 0.5, 1.01, 32, 40, 64)


def test_subcluster_router_takes_all_rows_of_a_shard(spark):
    """More rows than the 50,000 of a sample that the centroids of a shard were fitted on."""
    rows = spark.range(64_000).select(F.col("id").alias("vec_id"), F.expr("CAST(id % 16 = 0 AS INT)").alias("shard_id"), F.expr("transform(sequence(1, 3), i -> CAST(xxhash64(id, i) % 997 AS FLOAT))").alias("embedding"))
    got = {}
    for r in routing.subcluster_router(rows, 5, 4).collect():
        got.setdefault(r.shard_id, []).append(r.centroid)
    table = rows.orderBy("vec_id").toPandas()
    for s in (0, 1):
        x = np.array(table[table.shard_id == s].embedding.tolist(), np.float64)
        c = x[:5].copy()
        for _ in range(4):
            near = ((x[:, None] - c) ** 2).sum(2).argmin(1)
            c = np.array([x[near == i].mean(0) for i in range(5)])
        assert np.allclose(np.sort(got[s], 0), np.sort(c, 0), rtol=0, atol=1e-9)
    assert routing.subcluster_router(rows.limit(0), 5).count() == 0
