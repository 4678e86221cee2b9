"""SimHash near-duplicates: byte-position inverted index with count filtering.

A fingerprint has eight bytes at fixed positions. Two fingerprints that differ in at most two bits differ in at most
two bytes, so they share at least six positional bytes. The index posts each distinct fingerprint under positional
byte groups: the positions are dealt into four pairs, two differing bytes spoil at most two of them, so every link is
found under one of the six couples of pairs. For each pair of fingerprints met in a posting the shared positional
bytes are tallied; pairs with the guaranteed minimum of six go on to the exact bit test.

Postings of more than ``max_posting`` fingerprints never emit pairs: there each fingerprint is posted again under itself
and under its 32 one-bit changes of the other four bytes. Two fingerprints of the posting differ in at most two bits
exactly if they share such a key, and no key has more than 33 members, so this way is whole and linear.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import Aside, Scratch, components, tidy

BITS, BYTES, MAX_BITS = 64, 8, 2
#: Bytes that two linked fingerprints share at least.
MIN_SHARED = BYTES - MAX_BITS
SEED, WORDS = 42, 3
COUPLES = tuple(combinations(range(4), 2))


def shingle_hashes(data: list[bytes], words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """Unsigned 64-bit XXH64 of each space-joined shingle, repeats included; fewer words than ``words`` are one shingle."""
    if not data:
        return np.zeros(0, np.uint64)
    joined, k = b" ".join(data), min(words, len(data))
    ends = np.cumsum([len(w) + 1 for w in data]) - 1
    starts = [0, *(ends[: len(data) - k] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[i:j], seed) for i, j in zip(starts, ends[k - 1 :].tolist(), strict=True)), np.uint64, len(starts))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    total = np.zeros(BITS, np.int64)
    for a in range(0, len(hashes), 1 << 16):  # the bits of a very long text in blocks
        h = hashes[a : a + (1 << 16)].astype(">u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, BYTES), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(hashes)).tobytes(), "big")


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """SimHash of a whole text: A-Z lower-cased, words between ASCII white space, shingles with repeats.

    Null or wordless texts give 0.
    """
    return majority(shingle_hashes((text or "").encode().lower().split(), words, seed))


def with_fingerprint(docs: DataFrame, text: str = "text", words: int = WORDS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``fp`` (the fingerprint's bits as a signed long). One row for each row."""
    ship(docs.sparkSession)
    aside = Aside(keep)
    rows = docs.select(*aside.columns, F.col(text).alias("_text"))
    schema = rows.drop("_text").schema.add("fp", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), words) for t in b.column(b.num_columns - 1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fp)], names=schema.names)

    return aside.back(rows.mapInArrow(tidy(run), schema), "fp")


def _byte(c: str, i: int) -> Column:
    return F.shiftrightunsigned(F.col(c), 8 * (BYTES - 1 - i)).bitwiseAND(F.lit(255))


def _posting(c: str, a: int, b: int) -> Column:
    """The four bytes of pairs a and b as one long."""
    pair = lambda k: F.shiftrightunsigned(F.col(c), 16 * (3 - k)).bitwiseAND(F.lit(65535))
    return F.shiftleft(pair(a), 16).bitwiseOR(pair(b))


def near_pairs(prints: DataFrame, scratch: Scratch, max_bits: int = MAX_BITS, max_posting: int = 512) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints ``prints(fp)``, enough of them to join every linked pair.

    In postings up to ``max_posting`` every pair within ``max_bits`` (two at most) is a link; in larger ones each
    fingerprint is linked to the smallest of every shared key, which joins the same fingerprints.
    """
    if max_bits > MAX_BITS:
        raise ValueError("the index guarantees links of at most two bits")
    posted = prints.select("fp", F.inline(F.array(*[F.struct(F.lit(n).alias("table"), _posting("fp", a, b).alias("key")) for n, (a, b) in enumerate(COUPLES)])))
    sizes = scratch.save(posted.groupBy("table", "key").count().where("count > 1"), few=True)
    small = sizes.where(F.col("count") <= max_posting).select("table", "key")
    met = posted.join(small, ["table", "key"])
    left, right = met.withColumnRenamed("fp", "a"), met.withColumnRenamed("fp", "b")
    pairs = left.join(right, ["table", "key"]).where("a < b")
    # The tally and the bit test run in the join's own stage; a pair met in several tables is taken in the first.
    shared = reduce(lambda x, y: x + y, [(_byte("a", i) == _byte("b", i)).cast("int") for i in range(BYTES)])
    first = F.coalesce(*[F.when(_posting("a", a, b) == _posting("b", a, b), F.lit(n)) for n, (a, b) in enumerate(COUPLES)])
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    links = pairs.where((shared >= BYTES - max_bits) & close & (F.col("table") == first)).select("a", "b")
    large = sizes.where(F.col("count") > max_posting).select("table", "key")
    if large.isEmpty():
        return links
    if not max_bits:
        return links  # distinct fingerprints differ
    hot = posted.join(large, ["table", "key"])
    masks = F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(BITS)])
    spread = hot.select("table", "key", "fp", F.explode(masks).alias("m")).withColumn("star", F.col("fp").bitwiseXOR(F.col("m")))
    # Changes of the posting's own four bytes would leave it.
    inside = F.coalesce(*[F.when(F.col("table") == n, _posting("star", a, b) == F.col("key")) for n, (a, b) in enumerate(COUPLES)])
    stars = spread.where(inside).groupBy("table", "key", "star").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    # Two members differ in two bits at most; one bit is the distance to the star itself, where it is a fingerprint.
    middle = F.array_min("fps") if max_bits == 2 else F.when(F.array_contains("fps", F.col("star")), F.col("star"))
    more = stars.select(middle.alias("a"), F.explode("fps").alias("b")).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return links.unionByName(more)


def near_duplicates(docs: DataFrame, text: str = "text", words: int = WORDS, max_bits: int = MAX_BITS, max_posting: int = 512, keep: tuple[str, ...] = ("doc_id",), id_col: str = "doc_id") -> DataFrame:
    """``keep`` columns, fp, fingerprint (16 hex digits), component_id (smallest id reachable), group_size, root (names the component).

    Copies share a fingerprint and are one vertex. Rows with a null id belong to their component and name none, so
    component_id is null only where no member has an id. Repeated rows stay. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    aside = Aside((*keep, id_col))
    rows = docs.select(*aside.columns, F.col(id_col).alias("_id"), F.col(text).alias("_text"))
    rows = scratch.save(with_fingerprint(rows, "_text", words, (*aside.names, "_id")))
    prints = scratch.save(rows.groupBy("fp").agg(F.min("_id").alias("first"), F.count("*").alias("n")), few=True)
    roots = components(near_pairs(prints.select("fp"), scratch, max_bits, max_posting), scratch)
    member = prints.join(roots.withColumnRenamed("v", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    member = scratch.save(member, few=True)
    total = member.groupBy("root").agg(F.min("first").alias("component_id"), F.sum("n").alias("group_size"))
    known = scratch.save(member.select("fp", "root").join(total, "root").select("fp", "root", "component_id", "group_size"), few=True)
    scratch.sweep()
    out = rows.join(known, "fp").withColumn("fingerprint", F.lower(F.lpad(F.hex("fp"), 16, "0")))
    return aside.back(out, "fp", "fingerprint", "component_id", "group_size", "root")


def keep_one(docs: DataFrame, text: str = "text", id_col: str = "doc_id", find: Callable[..., DataFrame] = near_duplicates, **kw) -> DataFrame:
    """``docs`` without the near-duplicates that ``find`` joins: one row of each component stays, that with the smallest id.

    Rows with null ids come after all others. Of several texts with that id the one with the smallest hash stays, and of
    rows equal in id and text any one; unlike texts under one id are rows of their own components. Columns are those of
    ``docs``.
    """
    aside = Aside(tuple(docs.columns))
    rows = docs.select(*aside.columns, F.col(id_col).alias("_id"), F.col(text).alias("_text"))
    rows = rows.withColumn("_t", F.xxhash64(F.coalesce("_text", F.lit("")))).withColumn("_i", F.xxhash64("_id", "_t"))
    found = find(rows.select("_id", "_t", "_i", "_text"), "_text", keep=("_id", "_t", "_i"), id_col="_id", **kw)
    best = found.groupBy("root").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_t", "_i")).alias("b"))
    kept = rows.drop("_id", "_text").join(best.select("b._t", "b._i"), ["_t", "_i"], "left_semi")
    return aside.back(kept.dropDuplicates(["_t", "_i"]))
