"""Sharding: minimax contiguous partition of atomic groups. Native: DataFrame aggregates and expressions only.

Groups (rows of equal text) lie in the order of a 64-bit hash. The smallest feasible shard capacity is found by binary
search with a greedy check. The driver never holds the groups: it holds sums over ranges of the hash, at first 2^16 of
them, and splits only ranges in which a cut falls, until the cuts are exact to the group.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Aside, Scratch

FIRST_BITS, STEP_BITS = 16, 8
#: Rows of a shard are numbered in so many buckets side by side.
SLOT_BUCKETS = 1024


class Ranges:
    """Sums over ranges of the group key in ascending order; ``split`` refines ranges by one query."""

    def __init__(self, groups: DataFrame):
        self.groups = groups
        key = F.shiftright("key", 64 - FIRST_BITS)
        rows = groups.groupBy(key.alias("b")).agg(F.sum("size").alias("s"), F.count("*").alias("n")).collect()
        self._set(sorted((r.b << (64 - FIRST_BITS), 64 - FIRST_BITS, r.s, r.n) for r in rows))

    def _set(self, parts: list[tuple[int, int, int, int]]) -> None:
        self.parts, self.start = parts, [0]
        for p in parts:
            self.start.append(self.start[-1] + p[2])
        self.total = self.start[-1]

    def split(self, which: set[int]) -> None:
        """Replace the parts in ``which`` by at most 2^STEP_BITS parts each."""
        keys = {self.parts[i][0]: self.parts[i][1] for i in sorted(which)}
        asked, rows = None, []
        for shift in set(keys.values()):
            low = [k for k, v in keys.items() if v == shift]
            inside = F.shiftleft(F.shiftright("key", shift), shift).isin(low)
            step = max(0, shift - STEP_BITS)
            one = self.groups.where(inside).groupBy(F.shiftleft(F.shiftright("key", step), step).alias("b")).agg(F.sum("size").alias("s"), F.count("*").alias("n")).withColumn("shift", F.lit(step))
            asked = one if asked is None else asked.unionByName(one)
        rows = [(r.b, r["shift"], r.s, r.n) for r in asked.collect()]
        self._set(sorted([p for i, p in enumerate(self.parts) if i not in which] + rows))


def _reach(r: Ranges, target: int) -> tuple[int, int | None]:
    """The last part boundary at or before ``target``, and the part that hides a nearer one if there may be one."""
    i = bisect_right(r.start, target) - 1
    hidden = i if i < len(r.parts) and r.start[i] < target and r.parts[i][3] > 1 else None
    return i, hidden


def _feasible(r: Ranges, capacity: int, shards: int) -> tuple[bool, bool, set[int]]:
    """Whether a greedy walk certainly fits, whether it possibly fits, and the parts in doubt."""
    doubt: set[int] = set()
    sure = 0
    for _ in range(shards):
        i, hidden = _reach(r, sure + capacity)
        doubt |= {hidden} - {None}
        if r.start[i] == sure:
            break
        sure = r.start[i]
    hope = 0
    for _ in range(shards):
        i, hidden = _reach(r, hope + capacity)
        doubt |= {hidden} - {None}
        nxt = hope + capacity if hidden is not None else r.start[i]
        if nxt == hope:
            break
        hope = min(nxt, r.total)
    return sure >= r.total, hope >= r.total, doubt


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[list[int], int]:
    """Group keys at which shards 1, 2, ... begin, and the smallest capacity; ``groups(key, size)``, sizes positive.

    Fewer groups than shards leave shards empty. Within the smallest capacity each cut lies as near to an even share of
    the rest as the shards after it allow.
    """
    r = Ranges(groups)
    if not r.parts:
        return [], 0
    biggest = groups.agg(F.max("size")).first()[0]
    low, high = max(-(-r.total // shards), biggest), -(-r.total // shards) + biggest
    while low < high:
        mid = (low + high) // 2
        fits, may, doubt = _feasible(r, mid, shards)
        if fits:
            high = mid
        elif not may:
            low = mid + 1
        else:
            r.split(doubt)
    capacity = low
    while True:
        # latest[k]: the first boundary from which k shards of the capacity hold the rest.
        doubt: set[int] = set()
        need = [r.total]
        for _ in range(shards):
            want = max(0, need[-1] - capacity)
            i = bisect_left(r.start, want)
            if i and r.start[i] > want and r.parts[i - 1][3] > 1:
                doubt.add(i - 1)
            need.append(r.start[i])
        at, cuts = 0, []
        for k in range(shards - 1, 0, -1):
            even = at + (r.total - at) / (k + 1)
            top, hidden = _reach(r, at + capacity)
            doubt |= {hidden} - {None}
            i = bisect_left(r.start, even)
            for j in (i - 1, i):
                if 0 <= j < len(r.parts) and r.start[j] < even < r.start[j + 1] and r.parts[j][3] > 1:
                    doubt.add(j)
            j = min((x for x in (i - 1, i) if 0 <= x < len(r.start)), key=lambda x: abs(r.start[x] - even))
            j = min(max(j, bisect_left(r.start, need[k])), top)
            at = r.start[j]
            cuts.append(r.parts[j][0] if j < len(r.parts) else None)
        if not doubt:
            return [c for c in cuts if c is not None], capacity
        r.split(doubt)


def shard_documents(docs: DataFrame, shards: int = 24, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with size, text_crc32, law, shard and slot (gapless from 0 in each shard).

    Size is the UTF-8 length of the text (null: none) plus 8. Equal texts are one group and never parted, so a group
    larger than an even share sets the capacity alone. Null texts count as empty ones. Repeated rows and null ids are
    rows like any other. An empty table gives no rows.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "sharding")
    t = F.coalesce(F.col(text), F.lit(""))
    aside = Aside(keep)
    rows = docs.select(*aside.columns, (F.octet_length(t) + 8).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"), F.xxhash64(t).alias("_s_key"), F.lit("bytes").alias("law"))
    # Copies are summed before the shuffle; a group of a third of all rows is one row of each task.
    groups = scratch.save(rows.groupBy(F.col("_s_key").alias("key")).agg(F.sum("size").alias("size")))
    cuts, _ = minimax_cuts(groups, shards)
    scratch.drop(groups)
    shard = F.lit(0)
    for c in cuts:
        shard = shard + F.when(F.col("_s_key") >= F.lit(c), 1).otherwise(0)
    bucket = F.pmod(F.xxhash64(*aside.names, "_s_key", F.lit(3)), F.lit(SLOT_BUCKETS)).cast("int")
    rows = rows.select(*aside.names, "size", "text_crc32", "law", shard.cast("int").alias("shard"), bucket.alias("_s_bucket"))
    # One count for each (shard, bucket): at most shards * SLOT_BUCKETS rows, whatever the input.
    counts = rows.groupBy("shard", "_s_bucket").count().groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("_s_bucket", "count"))).alias("c"))
    before = F.transform("c", lambda x, i: F.struct(x["_s_bucket"].alias("_s_bucket"), F.aggregate(F.slice("c", 1, i), F.lit(0).cast("long"), lambda a, y: a + y["count"]).alias("_s_before")))
    base = counts.select("shard", F.inline(before))
    w = Window.partitionBy("shard", "_s_bucket").orderBy(*aside.names)
    out = rows.withColumn("_s_n", F.row_number().over(w)).join(F.broadcast(base), ["shard", "_s_bucket"])
    out = out.withColumn("slot", (F.col("_s_before") + F.col("_s_n") - 1).cast("long")).withColumn("grown_shard", F.lit(None).cast("int"))
    return aside.back(out, "size", "text_crc32", "law", "shard", "slot", "grown_shard")
