"""Shared helpers: columns set aside, texts in blocks, text expressions, connected components."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import Scratch as Scratch

#: ASCII white space, the only separators of words in this package.
SPACE = " \t\n\x0b\f\r"


class Aside:
    """Columns that go through an operator untouched, under names that it does not use.

    ``columns`` select them, ``names`` are what they are called inside, and ``back`` gives a result with them under their
    own names, before the columns ``results``. A column named like a result, in any case, is replaced by the result.
    """

    def __init__(self, keep: tuple[str, ...]):
        self.own = tuple(dict.fromkeys(keep))
        self.names = [f"_keep{i}" for i in range(len(self.own))]
        self.columns = [F.col(f"`{c}`").alias(n) for c, n in zip(self.own, self.names, strict=True)]

    def back(self, out: DataFrame, *results: str) -> DataFrame:
        made = {c.lower() for c in results}
        return out.select(*[F.col(n).alias(c) for c, n in zip(self.own, self.names, strict=True) if c.lower() not in made], *results)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, after which a worker gives free memory back to the system.

    Workers stay for later tasks of any operator; what each kept of its largest task would add up on an executor.
    """

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # the C library of Linux has it
                trim(0)

    return tidied


def text_blocks(texts: pa.Array, most: int = 4_000_000) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts) of runs of rows with up to about ``most`` bytes, one row at least, nulls as empty texts."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) + 16)
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, texts.slice(at, stop - at)
        at = stop


def words_of(text: Column) -> Column:
    """Maximal runs of anything but ASCII white space; null and empty texts give an empty array."""
    clean = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, "[ \\t\\n\\x0B\\f\\r]+"))


def components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)``: one row ``(v, root)`` for each vertex that has an edge.

    Each round maps every vertex to the smallest of itself and its neighbours in the order of a hash, renames the
    edges and drops those inside a vertex. The order is random to the data, so that long chains shrink by a constant
    factor a round. ``root`` names the component; it is not its smallest vertex. Every round reads and writes tables
    in the shared folder, never a growing plan.
    """
    edges = scratch.save(edges.select("a", "b").where("a <> b").distinct(), few=True)
    labels = None
    key = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
    for _ in range(max_rounds):
        both = edges.select("a", key("b").alias("k")).unionByName(edges.select(F.col("b").alias("a"), key("a").alias("k")))
        step = both.groupBy("a").agg(F.min("k").alias("k")).select(F.col("a").alias("v"), F.least("k", key("a"))["v"].alias("m"))
        step = scratch.save(step, few=True)
        if labels is None:
            labels = step.withColumnRenamed("m", "root")
        else:
            old = labels
            labels = scratch.save(old.join(step.withColumnRenamed("v", "root"), "root", "left").select("v", F.coalesce("m", "root").alias("root")), few=True)
        a, b = step.select(F.col("v").alias("a"), F.col("m").alias("x")), step.select(F.col("v").alias("b"), F.col("m").alias("y"))
        after = edges.join(a, "a").join(b, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        edges = scratch.save(after, few=True)
        if edges.isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
