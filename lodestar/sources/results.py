"""Search results as files for other tools."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(results: DataFrame, path: str) -> None:
    """``results(qid, rank, vec_id, dist)`` as CSV with the header query_id, rank, label, distance."""
    named = results.select(F.col("qid").alias("query_id"), "rank", F.col("vec_id").alias("label"), F.col("dist").alias("distance"))
    named.write.mode("overwrite").option("header", True).csv(path)
