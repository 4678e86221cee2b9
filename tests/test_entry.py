"""The driver contract, and SQL results for every query that has an SQL form."""

import os

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_names_agree():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["qid", "rank", "vec_id", "dist"] and df.count() == 50


def test_index_recall_is_production_grade(spark):
    from lodestar.plans import catalogue

    assert catalogue.QUERIES["index_recall"](spark, SF).first().recall >= 0.9


def _names():
    from lodestar.plans import catalogue

    return sorted(catalogue.ORACLES)


@pytest.mark.parametrize("name", _names())
def test_query_equals_sql(spark, name):
    import duckdb

    from lodestar.plans import catalogue

    df = catalogue.QUERIES[name](spark, SF)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    res = con.sql(catalogue.ORACLES[name])
    cols = sorted(df.columns)
    assert sorted(res.columns) == cols
    at = [res.columns.index(c) for c in cols]
    want = sorted(tuple(str(r[i]) for i in at) for r in res.fetchall())
    assert sorted(tuple(str(r[c]) for c in cols) for r in df.collect()) == want


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """A folder with 9,000 vectors, more than any query's 256 for each cluster."""
    folder = str(tmp_path_factory.mktemp("many"))
    spark.read.parquet(f"{SF}/embeddings.parquet").createOrReplaceTempView("small")
    n = spark.table("small").count()
    spark.sql(f"""SELECT vec_id + c * {n} AS vec_id, label, transform(embedding, (v, i) -> CAST(v + (conv(substr(md5(concat(vec_id, ' ', c, ' ', i)), 1, 4), 16, 10) / 65536 - 0.5) * least(c, 1) / 2 AS FLOAT)) AS embedding
        FROM small, (SELECT explode(sequence(0, {9000 // n - 1})) AS c)""").repartition(3).write.parquet(f"{folder}/embeddings.parquet")  # fmt: skip
    return folder


def _same(spark, name, folder):
    import duckdb

    from lodestar.plans import catalogue

    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet/*.parquet'")
    df = catalogue.QUERIES[name](spark, folder)
    res = con.sql(catalogue.ORACLES[name])
    at = [res.columns.index(c) for c in df.columns]
    return sorted(tuple(r) for r in df.collect()) == sorted(tuple(r[i] for i in at) for r in res.fetchall())


def test_index_greedy_of_many_vectors_equals_sql(spark, many):
    assert _same(spark, "index_greedy", many)


def test_index_kmeans_of_many_vectors_equals_sql(spark, many):
    assert _same(spark, "index_kmeans", many)


def test_index_sample_router_of_many_vectors_equals_sql(spark, many):
    assert _same(spark, "index_sample_router", many)


def test_index_subcluster_router_of_many_vectors_equals_sql(spark, many):
    assert _same(spark, "index_subcluster_router", many)


@pytest.fixture(scope="module")
def tenths(spark, tmp_path_factory, many):
    """The same vectors in tenths: many are equally far from two centroids, but for the last bits of sums."""
    folder = str(tmp_path_factory.mktemp("tenths"))
    spark.read.parquet(f"{many}/embeddings.parquet").selectExpr("vec_id", "label", "transform(embedding, v -> CAST(round(v, 1) AS FLOAT)) AS embedding").write.parquet(f"{folder}/embeddings.parquet")
    return folder


def test_index_kmeans_of_equally_near_centroids_equals_sql(spark, tenths):
    assert _same(spark, "index_kmeans", tenths)


def test_index_sample_router_far_from_the_origin_equals_sql(spark, tmp_path, many):
    """Squares of such components leave no digits for distances that are told apart by norms and products."""
    moved = spark.read.parquet(f"{many}/embeddings.parquet").selectExpr("vec_id", "label", "transform(embedding, v -> CAST(10 * v + 30000000 AS FLOAT)) AS embedding")
    moved.write.parquet(f"{tmp_path}/embeddings.parquet")
    assert _same(spark, "index_sample_router", str(tmp_path))
