"""Embedding near-duplicates: collision-counting projections.

Every vector is projected on many one-dimensional directions. Tables of several projections, cut into cells, bring near
vectors together; how many tables there are follows from the recall asked for at the threshold. Inside a cell the rows
are sorted by a projection, each row's window on it gives its partners, and for each pair the query-centred windows over
an orthonormal set of projections are counted. Squared differences over such a set add up to the squared distance, so
that a pair at the threshold leaves at most ``distance / width^2`` windows: the count that every link reaches is known,
and no link is lost there. Pairs that reach it are verified in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import Scratch, components, tidy

#: Cells of more rows are dealt into blocks of about half as many, and each pair of blocks is a group of its own.
MAX_CELL = 1024


@dataclass(frozen=True)
class Plan:
    """``tables`` of ``per_table`` projections cut into cells of ``width``; windows of ``reach``, ``least`` of them shared."""

    dim: int
    tables: int
    per_table: int
    width: float
    reach: float
    least: int
    threshold: float

    @staticmethod
    def make(dim: int, n: int, threshold: float = 0.93, recall: float = 0.995) -> Plan:
        """For ``n`` vectors in the largest label: unrelated pairs meet about n times in all, links with ``recall``."""
        width = 1.6 / math.sqrt(dim)
        gap = math.sqrt((2 - 2 * threshold) / dim)
        near = 1 - gap * math.sqrt(2 / math.pi) / width
        per_table = max(3, math.ceil(math.log(max(8, n)) / math.log(1 / 0.45)) + 1)
        tables = math.ceil(math.log(1 - recall) / math.log(1 - near**per_table))
        reach = 0.8 / math.sqrt(dim)
        least = dim - int((2 - 2 * threshold + 1e-6) / reach**2)
        return Plan(dim, tables, per_table, width, reach, least, threshold)

    def directions(self) -> tuple[np.ndarray, np.ndarray]:
        r = np.random.default_rng(20240229)
        d = r.normal(size=(self.dim, self.tables * self.per_table))
        return d / np.linalg.norm(d, axis=0), r.uniform(0, self.width, self.tables * self.per_table)

    def basis(self) -> np.ndarray:
        return np.linalg.qr(np.random.default_rng(17).normal(size=(self.dim, self.dim)))[0]

    def keys(self, x: np.ndarray, directions: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """One 64-bit cell number for each row and table."""
        cell = np.floor((x @ directions[0] + directions[1]) / self.width).astype(np.int64).astype(np.uint64)
        h = np.zeros((len(x), self.tables), np.uint64)
        cell = cell.reshape(len(x), self.tables, self.per_table)
        for k in range(self.per_table):
            h = (h ^ cell[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return h.view(np.int64)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by their largest component first, so that no square is lost."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def matched(x: np.ndarray, keys: np.ndarray, side: np.ndarray, table: int, plan: Plan, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links inside one group of unit rows that this table is the first to bring together.

    ``side`` is 0 and 1 for a pair of blocks, whose rows are compared across only, else all 0.
    """
    p = x @ basis
    order = np.argsort(p[:, 0], kind="stable")
    p, sd = p[order], side[order]
    far = math.sqrt(2 - 2 * plan.threshold) + 1e-9
    ends = np.searchsorted(p[:, 0], p[:, 0] + far, "right")
    across = bool(sd.any())
    left, right = [], []
    for at in range(0, len(p), 128):
        stop = min(len(p), at + 128)
        hi = int(ends[at:stop].max())
        near = np.zeros((stop - at, hi - at), np.int16)
        for j in range(plan.dim):
            near += np.abs(p[at:stop, j, None] - p[None, at:hi, j]) <= plan.reach
        a, b = np.nonzero(near >= plan.least)
        a, b = a + at, b + at
        ok = a < b
        if across:
            ok &= sd[a] != sd[b]
        left.append(order[a[ok]])
        right.append(order[b[ok]])
    a, b = np.concatenate(left), np.concatenate(right)
    if table:
        first = ~(keys[a, :table] == keys[b, :table]).any(1)
        a, b = a[first], b[first]
    good = np.einsum("ij,ij->i", x[a], x[b]) >= plan.threshold
    return a[good], b[good]


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.93, recall: float = 0.995) -> DataFrame:
    """One row for each row: id, n_links, component_id (smallest id reachable) and kept (id = component_id).

    Only vectors of one label and one length are compared. Null labels, null or zero vectors and vectors with null or
    non-finite components link with nothing; their component is their own id. Equal vectors are one vertex with a
    count and link with each other. Rows with a null id count as links and name no component.
    """
    spark = vectors.sparkSession
    ship(spark)
    scratch = Scratch(spark, "vectors")
    v = F.col(vector).cast("array<double>")
    # One pass inside the row: the largest component. A null one makes it null; NaN is larger than infinity.
    top = F.aggregate(v, F.lit(0.0), lambda a, x: F.when(a.isNull() | x.isNull(), F.lit(None)).otherwise(F.greatest(a, F.abs(x))))
    valid = F.coalesce(F.col(label).isNotNull() & (top > 0) & (top < float("inf")), F.lit(False))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label).alias("label"), F.col(vector).alias("x"), valid.alias("valid"))
    good = rows.where("valid").groupBy("label", "x").agg(F.min("id").alias("first"), F.count("*").alias("copies"))
    good = scratch.save(good.withColumn("v", F.monotonically_increasing_id()))
    lone = rows.where("not valid").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    dims = [(r.d, r.n) for r in good.groupBy("label", F.size("x").alias("d")).count().groupBy("d").agg(F.max("count").alias("n")).collect()]
    parts = [_links(good.where(F.size("x") == d), Plan.make(d, n, threshold, recall), scratch) for d, n in sorted(dims)]
    empty = spark.createDataFrame([], "v long, links long, root long")
    found = empty
    for p in parts:
        found = found.unionByName(p)
    found = scratch.save(found)
    counts = found.groupBy("v").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("v").alias("a"), F.col("root").alias("b")), scratch)
    member = good.select("v", "first", "copies", "label", "x").join(roots, "v", "left").join(counts, "v", "left")
    member = scratch.save(member.withColumn("root", F.coalesce("root", "v")))
    names = member.groupBy("root").agg(F.min("first").alias("component_id"))
    known = member.select("root", "label", "x", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    known = scratch.save(known.join(names, "root").select("label", "x", "n_links", "component_id"))
    linked = rows.where("valid").join(known, ["label", "x"]).select("id", "n_links", "component_id")
    out = linked.unionByName(lone)
    return out.select(F.col("id").alias(id_col), F.col("n_links").cast("long").alias("n_links"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _links(good: DataFrame, plan: Plan, scratch: Scratch) -> DataFrame:
    """(v, links, root): for each group, what it adds to a vector's links, and an edge that joins it to them."""
    spark = good.sparkSession
    shared = spark.sparkContext.broadcast(plan)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        directions = plan.directions()
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                x = unit(np.asarray(part.column(2).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(part.num_rows, plan.dim))
                keys = plan.keys(x, directions)
                v = np.repeat(part.column(0).to_numpy(), plan.tables)
                which = part.column(1).take(pa.array(np.repeat(np.arange(part.num_rows), plan.tables)))
                yield pa.RecordBatch.from_arrays([pa.array(v), which, pa.array(np.tile(np.arange(plan.tables, dtype=np.int32), part.num_rows)), pa.array(keys.ravel())], names=["v", "label", "table", "key"])

    kind = good.schema["label"].dataType.simpleString()
    posted = scratch.save(good.select("v", "label", "x").mapInArrow(tidy(post), f"v long, label {kind}, table int, key long"))
    cells = scratch.save(posted.groupBy("label", "table", "key").agg(F.count("*").alias("n")).where("n > 1"))
    met = posted.join(cells, ["label", "table", "key"])
    blocks = F.when(F.col("n") <= MAX_CELL, F.lit(1)).otherwise(F.ceil(2 * F.col("n") / MAX_CELL)).cast("int")
    met = met.withColumn("blocks", blocks).withColumn("b", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int"))
    met = met.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("v", "table", F.xxhash64("label", "table", "key", F.least("b", "o"), F.greatest("b", "o")).alias("cell"), ((F.col("o") < F.col("b"))).cast("int").alias("side"))
    full = met.join(good.select("v", "x", "copies"), "v").repartition("cell").sortWithinPartitions("cell", "v")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        directions, basis = plan.directions(), plan.basis()
        wait: list[pa.RecordBatch] = []

        def groups(t: pa.Table) -> pa.RecordBatch:
            t = t.combine_chunks()
            cell, v = t["cell"].to_numpy(), t["v"].to_numpy()
            table, side, copies = t["table"].to_numpy(), t["side"].to_numpy(), t["copies"].to_numpy()
            x = unit(np.asarray(t["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(v), plan.dim))
            cut = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)]
            out: tuple[list, list, list] = ([], [], [])
            for i, j in zip(cut, cut[1:], strict=False):
                if j - i < 2:
                    continue
                if j - i == 2 and x[i] @ x[i + 1] < plan.threshold:
                    continue
                a, b = matched(x[i:j], plan.keys(x[i:j], directions), side[i:j], int(table[i]), plan, basis)
                if not len(a):
                    continue
                n = np.bincount(a, copies[i:j][b], j - i) + np.bincount(b, copies[i:j][a], j - i)
                root = np.arange(j - i)
                while True:
                    low = root.copy()
                    np.minimum.at(low, a, root[b])
                    np.minimum.at(low, b, root[a])
                    low = low[low]
                    if (low == root).all():
                        break
                    root = low
                has = np.flatnonzero(n)
                out[0].append(v[i:j][has])
                out[1].append(n[has].astype(np.int64))
                out[2].append(v[i:j][root[has]])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(o) if o else np.zeros(0, np.int64), pa.int64()) for o in out], names=["v", "links", "root"])

        for b in batches:
            wait.append(b)
            if sum(w.num_rows for w in wait) < 4096:
                continue
            t = pa.Table.from_batches(wait)
            cell = t["cell"].to_numpy()
            # The last cell may go on in the next batch.
            last = int(np.searchsorted(cell, cell[-1], "left"))
            if last:
                yield groups(t.slice(0, last))
            wait = t.slice(last).to_batches()
        if wait:
            yield groups(pa.Table.from_batches(wait))

    return full.select("v", "table", "cell", "side", "copies", "x").mapInArrow(tidy(link), "v long, links long, root long")
