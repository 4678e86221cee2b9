"""Commands: ``python -m lodestar.cli build|search``."""

from __future__ import annotations

import argparse
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.evaluation import timing_report
from .plans.index import Options, ShardedIndex, evaluate
from .shared import shared_dir
from .sources.fvecs import export_shards, read_fvecs
from .sources.results import write_csv
from .streaming.batches import in_batches, run_batches, stream_search


def load(spark: SparkSession, path: str) -> DataFrame:
    return read_fvecs(spark, path) if ".fvecs" in path else spark.read.parquet(path).select("vec_id", "embedding")


def batched(index: ShardedIndex, queries: DataFrame, size: int, k: int, nprobe: int, method: str, stream: bool) -> dict[str, float]:
    """Timing sums of a search in batches, one after the other or as a stream."""
    spark = queries.sparkSession
    if stream:
        folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
        numbered = in_batches(queries, size).persist()
        batches = numbered.agg(F.max("batch_id")).first()[0] or 0
        numbered.repartitionByRange(int(batches) + 1, "batch_id").select("qid", "embedding").write.parquet(f"{folder}/queries")
        source = spark.readStream.schema(numbered.select("qid", "embedding").schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/queries")
        run, timings = stream_search(index, source, f"{folder}/out", f"{folder}/state", k, nprobe, method)
        run.awaitTermination()
        numbered.unpersist()
    else:
        timings = [t for _, t in run_batches(index, queries, size, k, nprobe, method)]
    return timing_report(spark.createDataFrame(timings, "batch_id long, n_queries long, seconds double, idle double")).first().asDict()


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="lodestar")
    sub = p.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build")
    b.add_argument("--base", required=True)
    b.add_argument("--index", required=True)
    b.add_argument("--export", default="")
    b.add_argument("--graphs", action="store_true")
    for name, value in Options().__dict__.items():
        flag = f"--{name.replace('_', '-')}"
        b.add_argument(flag, action="store_true") if isinstance(value, bool) else b.add_argument(flag, type=type(value), default=value)
    s = sub.add_parser("search")
    for name in ("--base", "--query", "--index"):
        s.add_argument(name, required=True)
    s.add_argument("--nq", type=int, default=1000)
    s.add_argument("--k", type=int, default=10)
    s.add_argument("--nprobe", type=int, default=1)
    s.add_argument("--method", default="exact")
    s.add_argument("--ef-search", type=int, default=0)
    s.add_argument("--bs", type=int, default=0, help="queries a batch, each batch a search of its own; 0: one search")
    s.add_argument("--pipeline", action="store_true", help="batches as a stream")
    s.add_argument("--csv", default="")
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    base = load(spark, a.base)
    if a.command == "build":
        o = Options(**{k: getattr(a, k) for k in Options().__dict__})
        index = ShardedIndex.fit(base, o, graphs=a.graphs)
        index.save(a.index)
        if a.export:
            export_shards(base, index.members.select("vec_id", "shard_id", "is_replica"), a.export, "base", o.partition_ratio)
        print(json.dumps([r.asDict() for r in index.counts().orderBy("shard_id").collect()]))
        return
    index = ShardedIndex.load(spark, a.index)
    queries = load(spark, a.query).select(F.col("vec_id").alias("qid"), "embedding").where(F.col("vec_id") < a.nq)
    if a.bs or a.pipeline:
        print(json.dumps(batched(index, queries, max(1, a.bs), a.k, a.nprobe, a.method, a.pipeline)))
    print(json.dumps(evaluate(index, base, queries, a.k, a.nprobe, a.method, a.ef_search or None)))
    if a.csv:
        write_csv(index.search(queries, a.k, a.nprobe, a.method), a.csv)


if __name__ == "__main__":
    main()
