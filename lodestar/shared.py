"""Tables in the folder that driver and executors share: they end lineage, and a lost executor loses none of them."""

from __future__ import annotations

import gc
import tempfile
import uuid
from contextlib import suppress
from functools import cache

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Where it names none, a local master gets a folder of its own on its one machine; on a cluster that is an error.
    """
    place = spark.conf.get("spark.checkpoint.dir", None)
    if place:
        return place
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return own_dir()


@cache
def own_dir() -> str:
    """A temporary folder of this process, for sessions that run in it alone."""
    return "file://" + tempfile.mkdtemp(prefix="lodestar-")


class Scratch:
    """Tables written to the shared folder.

    ``save`` writes and rereads a table; ``drop`` deletes tables that no later step reads and lets Spark's
    cleaner remove shuffle files whose plans are out of reach.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def save(self, df: DataFrame, compression: str = "zstd", by: tuple[str, ...] = (), few: bool = False) -> DataFrame:
        """``df`` as written; ``by`` are columns that its folders are named after, so that filters on them read less.

        With ``few``, for tables of keys and counts that Spark alone makes, a file takes eight of the shuffle's
        partitions, one after the other: hundreds of files of a few rows cost the file system more than the rows do.
        """
        if few:
            n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            df = df.coalesce(max(min(n, 4), n // 8))
        path = f"{self.root}/{self.n}"
        self.n += 1
        df.write.option("compression", compression).partitionBy(*by).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path).select(*df.columns)
        out.scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        for frame in frames:
            path = jvm.org.apache.hadoop.fs.Path(frame.scratch_path)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def sweep(self) -> None:
        """Free shuffle files of finished steps now; otherwise they stay until the driver happens to collect garbage.

        What holds the plans of finished steps goes first: frames that Python has dropped, which its gateway gives up
        only about once a second, and the last query's end, which the threads of listeners hold until another one comes.
        """
        gc.collect()
        context = self.spark.sparkContext
        waiting = getattr(context._gateway._gateway_client, "finalizer_deque", None)
        while waiting:
            try:
                client, target = waiting.pop()
            except IndexError:  # the gateway's own thread was faster
                break
            client.garbage_collect_object(target, False)
        self.spark.sql("SELECT 1").collect()
        with suppress(Py4JJavaError):  # a busy queue only leaves the files for the next time
            context._jsc.sc().listenerBus().waitUntilEmpty(5_000)
        context._jvm.System.gc()
