"""Suffix-array dedup: bytes covered by a string of ``length`` bytes that also starts elsewhere.

1. Every string of 200 bytes holds 105 windows of 96 bytes, and the smallest hash among them picks an anchor that depends
   on those bytes alone: equal strings hold equal anchors at equal places. Anchors met once cannot lie in a repeat.
2. An anchor's surroundings, 104 bytes to the left and 200 from it on, decide which of its strings repeat. Where all
   surroundings of an anchor are equal, all of them repeat. Otherwise the distinct ones go through a suffix array (linear
   grouping construction): their right and left parts, cut into blocks aligned at the anchor and named in byte order, are
   sorted as suffixes of one text; merging neighbours in descending order of their common prefix gives, to the byte, how
   far each one agrees with another to the right and to the left at once.
3. The agreeing stretches of a document are united and cut out.

An anchor with many distinct surroundings (a common passage in many settings) makes a large cell. Its strings are told
apart by how many of their bytes lie left of the anchor, and the cell is halved by that number: strings of one half agree
on the bytes that all of them hold, so that such a prefix deals the members into cells again, in which only the bytes
count that its strings reach and members equal in them are one. Cells that are small enough are sorted as above; halving
ends at the latest with one string a cell. No task holds all the surroundings of a frequent anchor.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import Aside, Scratch, text_blocks, tidy
from .gsaca import suffix_array

LENGTH, GRAM = 200, 96
REACH = LENGTH - GRAM
BLOCK = 26
#: Distinct members of a cell that are sorted together; larger cells are halved until they are as small.
MAX_CELL = 1024


def _hashes(b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of GRAM bytes, by doubling."""
    h = (b.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    size, at = 1, {}
    while size < 64:
        h = h[:-size] * np.uint64(0x9E3779B97F4A7C15 + 2 * size) + h[size:]
        h ^= h >> np.uint64(29)
        size *= 2
        at[size] = h
    n = len(b) - GRAM + 1
    h = at[64][:n] * np.uint64(0xBF58476D1CE4E5B9) + at[32][64 : 64 + n]
    h ^= h >> np.uint64(30)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _extreme(x: np.ndarray, w: int, op) -> np.ndarray:
    """``op`` over each window of ``w``, by doubling."""
    size = 1
    while 2 * size <= w:
        x = op(x[:-size], x[size:])
        size *= 2
    return op(x[: len(x) - (w - size)], x[w - size :]) if w > size else x


def anchors(data: bytes, block: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of a whole text; none if it is shorter than LENGTH."""
    n = len(data)
    if n < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    where, what = [], []
    for a in range(0, n, block):
        lo, hi = max(0, a - LENGTH), min(n, a + block + LENGTH)
        if hi - lo < LENGTH:
            continue
        h = _hashes(np.frombuffer(data, np.uint8)[lo:hi])
        w = REACH + 1
        low = _extreme(h, w, np.minimum)
        pad = np.zeros(w - 1, np.uint64)
        # A place is an anchor if it holds the minimum of any window over it.
        p = np.flatnonzero(_extreme(np.concatenate([pad, low, pad]), w, np.maximum) == h)
        p = p[(p + lo >= a) & (p + lo < a + block)]
        where.append(p + lo)
        what.append(h[p])
    return np.concatenate(where), np.concatenate(what)


def once(rid: np.ndarray, pos: np.ndarray, n: np.ndarray, h: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, ...]:
    """The first place of each surrounding of each text, with its count there; count 0 marks stretches.

    Surroundings met again in their own text repeat whatever other texts hold: their united stretches (from, to) stand
    in the places of pos and n. A run of one sign thus gives a few rows, not one a byte.
    """
    h, f = h.view(np.int64), f.view(np.int64)
    order = np.lexsort((pos, f, h, rid))
    r, k, g = rid[order], h[order], f[order]
    first = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (k[1:] != k[:-1]) | (g[1:] != g[:-1])]))
    count = np.diff(np.append(first, len(order)))
    keep = order[first]
    cols = [rid[keep], pos[keep], n[keep], h[keep], f[keep], count]
    again = order[np.repeat(count > 1, count)]
    if len(again):
        again = again[np.lexsort((pos[again], rid[again]))]
        r, lo, hi = rid[again], np.maximum(0, pos[again] - REACH), np.minimum(n[again], pos[again] + LENGTH)
        start = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (lo[1:] > hi[:-1])]))
        zero = np.zeros(len(start), np.int64)
        more = [r[start], lo[start], hi[np.append(start[1:], len(r)) - 1], zero, zero, zero]
        cols = [np.concatenate(c) for c in zip(cols, more, strict=True)]
    return tuple(cols)


def agreement(groups: list[list[tuple[bytes, bytes]]]) -> list[list[tuple[int, int]]]:
    """For each group of distinct (left part reversed, right part): how far each agrees with another member.

    The result for a member is (left, right): the widest reach to either side over the partners with which it shares at
    least LENGTH bytes, the anchor's GRAM included; (0, 0) if there is none. The parts of all groups become one text of
    block names; its suffix array sorts them.
    """
    blocks = sorted({part[i : i + BLOCK] for g in groups for member in g for part in member for i in range(0, len(part), BLOCK)})
    base = 2 * len(groups) + 1
    name = {b: base + i for i, b in enumerate(blocks)}
    text: list[int] = []
    owner: dict[int, tuple[int, int, int]] = {}
    for g, members in enumerate(groups):
        for m, member in enumerate(members):
            for side, part in enumerate(member):
                owner[len(text)] = (g, side, m)
                text.append(1 + 2 * g + side)
                text.extend([name[part[i : i + BLOCK]] for i in range(0, len(part), BLOCK)])
                text.append(0)
    order: list[tuple[list[int], list[int]]] = [([], []) for _ in groups]
    for s in suffix_array(text):
        if s in owner:
            g, side, m = owner[s]
            order[g][side].append(m)
    return [_merge(members, *order[g]) for g, members in enumerate(groups)]


def _merge(members: list[tuple[bytes, bytes]], by_left: list[int], by_right: list[int]) -> list[tuple[int, int]]:
    top = REACH
    number = [[int.from_bytes(p.ljust(top, b"\0"), "big") for p in m] for m in members]
    size = [[len(p) for p in m] for m in members]

    def common(side: int, a: int, b: int) -> int:
        x = number[a][side] ^ number[b][side]
        return min(top - (x.bit_length() + 7) // 8, size[a][side], size[b][side])

    reach = [[0, 0] for _ in members]

    def meet(a: int, b: int, right: int) -> None:
        left = common(0, a, b)
        if left + right >= top:
            for m in (a, b):
                r = reach[m]
                r[0], r[1] = max(r[0], left), max(r[1], right)

    place = {m: i for i, m in enumerate(by_left)}
    # Neighbours in the right order, longest common prefix first: each union is a node of the prefix tree.
    pairs = sorted(((common(1, a, b), a, b) for a, b in zip(by_right, by_right[1:], strict=False)), reverse=True)
    top_of = list(range(len(members)))
    inside: list[list[int]] = [[place[m]] for m in range(len(members))]

    def find(a: int) -> int:
        while top_of[a] != a:
            top_of[a] = top_of[top_of[a]]
            a = top_of[a]
        return a

    for right, a, b in pairs:
        a, b = find(a), find(b)
        if len(inside[a]) < len(inside[b]):
            a, b = b, a
        large = inside[a]
        for x in inside[b]:
            i = bisect_left(large, x)
            if i:
                meet(by_left[x], by_left[large[i - 1]], right)
            if i < len(large):
                meet(by_left[x], by_left[large[i]], right)
            large.insert(i, x)
        top_of[b], inside[b] = a, []
    return [(a, b + GRAM) if a + b >= top else (0, 0) for a, b in reach]


def repeats(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """``rows(rid, text)``: repeated stretches ``(rid, lo, hi)`` in UTF-8 bytes, overlapping ones not united."""
    ship(rows.sparkSession)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for b in batches:
            for at, texts in text_blocks(b.column(1), 2_000_000):
                rid, pos, n, h, f = [], [], [], [], []
                for i, t in zip(b.column(0)[at : at + len(texts)].to_pylist(), texts.to_pylist(), strict=True):
                    data = t.encode()
                    p, k = anchors(data)
                    if len(p):
                        rid.append(np.full(len(p), i))
                        pos.append(p)
                        n.append(np.full(len(p), len(data)))
                        h.append(k)
                        f.extend([digest(data[max(0, q - REACH) : q + LENGTH], 7) for q in p.tolist()])
                if rid:
                    cols = once(*map(np.concatenate, (rid, pos, n, h)), np.array(f, np.uint64))
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32()), strict=True)], names=["rid", "pos", "n", "h", "f", "c"])

    found = scratch.save(rows.select("rid", "text").mapInArrow(tidy(find), "rid long, pos int, n int, h long, f long, c int"))
    within = scratch.save(found.where("c = 0").select("rid", F.col("pos").alias("lo"), F.col("n").alias("hi")), few=True)
    # Map-side sums shrink frequent anchors before the shuffle; what is met once goes.
    often = found.where("c > 0").groupBy("h").agg(F.sum("c").alias("c"), F.min("f").alias("f0"), F.max("f").alias("f1")).where("c > 1")
    often = scratch.save(often.select("h", (F.col("f0") != F.col("f1")).alias("mixed")), few=True)
    scratch.sweep()
    met = scratch.save(found.where("c > 0").join(often, "h").select("rid", "pos", "n", "h", "f", "c", "mixed"), few=True)
    scratch.drop(found)
    scratch.sweep()
    lo, hi = F.greatest(F.lit(0), F.col("pos") - REACH), F.least(F.col("n"), F.col("pos") + LENGTH)
    same = met.where("not mixed").select("rid", lo.alias("lo"), hi.alias("hi"))
    mixed = met.where("mixed")
    one = mixed.groupBy("h", "f").agg(F.sum("c").alias("m"), F.min(F.struct("rid", "pos")).alias("at"))
    one = scratch.save(one.select("h", "f", "m", F.col("at.rid").alias("rid"), F.col("at.pos").alias("pos")), few=True)
    parts = scratch.save(_surroundings(rows, one), few=True)
    scratch.sweep()
    reach = scratch.save(_resolve(parts, scratch), few=True)
    scratch.drop(parts)
    scratch.sweep()
    there = mixed.join(reach, ["h", "f"]).select("rid", F.greatest(F.lit(0), F.col("pos") - F.col("left")).alias("lo"), F.least(F.col("n"), F.col("pos") + F.col("right")).alias("hi"))
    return within.unionByName(same).unionByName(there).where(F.col("hi") - F.col("lo") >= LENGTH)


def _surroundings(rows: DataFrame, one: DataFrame) -> DataFrame:
    """(h, f, m, left reversed, right beyond the anchor) for one place of each distinct surrounding."""
    want = one.groupBy("rid").agg(F.collect_list(F.struct("pos", "h", "f", "m")).alias("w"))
    both = rows.select("rid", "text").join(want, "rid").select("text", "w")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                data, want = b.column(0)[i].as_py().encode(), b.column(1)[i].as_py()
                p = [w["pos"] for w in want]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array([w[k] for w in want], pa.int64()) for k in ("h", "f", "m")), pa.array([data[max(0, q - REACH) : q][::-1] for q in p], pa.binary()), pa.array([data[q + GRAM : q + LENGTH] for q in p], pa.binary())],
                    names=["h", "f", "m", "l", "r"],
                )

    return both.mapInArrow(tidy(cut), "h long, f long, m long, l binary, r binary")


def _resolve(parts: DataFrame, scratch: Scratch) -> DataFrame:
    """(h, f, left, right) for the surroundings that repeat in part or whole."""
    # What is met twice repeats as a whole; it still is a partner of the others.
    done = lambda rows: rows.select("h", "f", F.octet_length("l").alias("left"), (F.octet_length("r") + GRAM).alias("right"))
    found, small = [done(parts.where("m > 1"))], []
    level = parts.select("h", "f", "l", "r", (F.col("m") > 1).alias("known"), F.col("h").alias("cell"), F.lit(0).alias("a"), F.lit(REACH + 1).alias("z"))
    while True:
        sizes = level.groupBy("cell").agg(F.count("*").alias("d"), F.min("known").alias("known")).where("d > 1 and not known")
        sizes = scratch.save(sizes.select("cell", "d"), few=True)
        small.append(level.join(sizes.where(F.col("d") <= MAX_CELL).select("cell"), "cell").select("h", "f", "l", "r", "cell"))
        large = sizes.where(F.col("d") > MAX_CELL).select("cell")
        if large.isEmpty():
            break
        # Of the strings with a to z-1 bytes left of the anchor, the lower and the upper half.
        middle = F.floor((F.col("a") + F.col("z")) / 2).cast("int")
        halves = F.array(F.struct(F.col("a").alias("a"), middle.alias("z")), F.struct(middle.alias("a"), F.col("z").alias("z")))
        half = level.join(large, "cell").select("h", "f", "l", "r", "known", F.col("cell").alias("above"), F.inline(halves))
        need = REACH + 1 - F.col("z")
        half = half.where("a < z").where((F.octet_length("l") >= F.col("a")) & (F.octet_length("r") >= need) & (F.octet_length("l") + F.octet_length("r") >= REACH))
        cell = F.xxhash64("above", "a", F.substring("l", F.lit(1), F.col("a")), F.substring("r", F.lit(1), need))
        half = half.select("h", "f", F.substring("l", F.lit(1), F.col("z") - 1).alias("l"), F.substring("r", F.lit(1), REACH - F.col("a")).alias("r"), "known", cell.alias("cell"), "a", "z")
        half = scratch.save(half.withColumn("part", F.xxhash64("cell", "l", "r")), few=True)
        one = scratch.save(half.groupBy("cell", "part").agg(F.count("*").alias("m"), F.max("known").alias("known"), *[F.min(c).alias(c) for c in ("h", "f", "l", "r", "a", "z")]), few=True)
        found.append(done(half.where("not known").join(one.where("m > 1").select("cell", "part"), ["cell", "part"])))
        level = one.select("h", "f", "l", "r", (F.col("known") | (F.col("m") > 1)).alias("known"), "cell", "a", "z")
    cells = small[0]
    for x in small[1:]:
        cells = cells.unionByName(x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wait: list[pa.RecordBatch] = []

        def groups(t: pa.Table) -> pa.RecordBatch:
            cell = t["cell"].to_numpy()
            h, f, left, right = (t[k].to_pylist() for k in ("h", "f", "l", "r"))
            cut = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)]
            spans = [(i, j) for i, j in zip(cut, cut[1:], strict=False) if j - i > 1]
            got = agreement([[(left[k], right[k]) for k in range(i, j)] for i, j in spans])
            rows = [(h[i + k], f[i + k], x, y) for (i, _), g in zip(spans, got, strict=True) for k, (x, y) in enumerate(g) if y]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["h", "f", "left", "right"])

        for b in batches:
            wait.append(b)
            if sum(w.num_rows for w in wait) < 8192:
                continue
            t = pa.Table.from_batches(wait)
            cell = t["cell"].to_numpy()
            last = int(np.searchsorted(cell, cell[-1], "left"))
            if last:
                yield groups(t.slice(0, last))
            wait = t.slice(last).to_batches()
        if wait:
            yield groups(pa.Table.from_batches(wait))

    found.append(cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(tidy(run), "h long, f long, left int, right int"))
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    # The stretches of one surrounding all cover the anchor, so their union reaches as far as the widest of each side.
    return out.where("left + right >= 200").groupBy("h", "f").agg(F.max("left").alias("left"), F.max("right").alias("right"))


def remove_repeats(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_text: bool = False) -> DataFrame:
    """``keep`` columns, n_bytes, n_removed, n_spans, kept_sha256 and, with ``with_text``, the rest as ``_kept`` text.

    Each byte covered by a 200-byte string that also starts anywhere else in the table goes, every copy of it. Null
    texts are empty; texts under 200 bytes stay whole. Repeated rows are copies. A cut may part a character; the kept
    bytes are exact, and the text leaves broken characters out. One row for each row.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "repeats")
    aside = Aside(keep)
    # The written rows carry a number that no later step can change.
    rows = scratch.save(docs.select(*aside.columns, F.coalesce(F.col(text), F.lit("")).alias("_text")).withColumn("_rid", F.monotonically_increasing_id()))
    spans = repeats(rows.select(F.col("_rid").alias("rid"), F.col("_text").alias("text")), scratch)
    spans = scratch.save(spans.groupBy(F.col("rid").alias("_rid")).agg(F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("_spans")), few=True)
    scratch.sweep()
    results = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *["_kept"] * with_text]
    schema = rows.select(*aside.names).schema
    for c in results:
        schema = schema.add(c, "long" if c.startswith("n_") else "string")
    k = len(aside.names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in ((b.slice(at, len(t)), t) for b in batches for at, t in text_blocks(b.column(k))):
            out: list[tuple] = []
            for t, spans in zip(texts.to_pylist(), b.column(k + 1).to_pylist(), strict=True):
                data = t.encode()
                at, gone, n, kept = 0, 0, 0, []
                end = -1
                for s in spans or ():
                    lo, hi = s["lo"], s["hi"]
                    if lo > end:
                        kept.append(data[at:lo])
                        n += 1
                        gone += hi - lo
                        end = at = hi
                    elif hi > end:
                        gone += hi - end
                        end = at = hi
                kept.append(data[at:])
                rest = b"".join(kept)
                out.append((len(data), gone, n, hashlib.sha256(rest).hexdigest(), *([rest.decode("utf-8", "ignore")] if with_text else [])))
            cols = list(zip(*out, strict=True)) if out else [[]] * (4 + with_text)
            kinds = [pa.int64()] * 3 + [pa.string()] * (1 + with_text)
            yield pa.RecordBatch.from_arrays([*b.columns[:k], *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=schema.names)

    out = rows.join(spans, "_rid", "left").select(*aside.names, "_text", "_spans").mapInArrow(tidy(cut), schema)
    return aside.back(out, *results)
