"""Toxicity by multiple-instance learning: sentence scores combined by noisy-or, trained from document labels.

A document is a bag of sentences. A sentence's probability is logistic in its words and their beginnings; the
document's is 1 - prod(1 - p). Only documents carry labels; the gradient reaches each sentence in proportion to its
share of the blame, so that the trained sentence scores locate the offending sentences.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship
from .common import Aside, Scratch, text_blocks, tidy

SENTENCE = re.compile(r"[^.!?\n]+")
PREFIXES = (4, 5, 6)
SPACE_BITS = 22


def word_of(token: str) -> str:
    """The letters of a token in lower case."""
    return "".join(filter(str.isalpha, token.lower()))


def token_features(token: str) -> list[int]:
    """Hashed features of one token: its word and the word's beginnings of 4 to 6 letters."""
    w = word_of(token)
    if not w:
        return []
    names = [w + "$", *(w[:k] for k in PREFIXES if len(w) >= k)]
    return [zlib.crc32(x.encode()) & ((1 << SPACE_BITS) - 1) for x in names]


class TokenFeatures(dict):
    """(word, features) of tokens as met, None for those without a letter; with ``known`` all other features go.

    A word none of whose features stays is the empty word. Long tokens are not kept, nor more than ``most``.
    """

    def __init__(self, known: set[int] | None = None, most: int = 200_000, longest: int = 40):
        self.known, self.most, self.longest = known, most, longest

    def __missing__(self, token: str) -> tuple[str, tuple[int, ...]] | None:
        f = tuple(token_features(token))
        out = (word_of(token), f) if f else None
        if f and self.known is not None:
            f = tuple(x for x in f if x in self.known)
            out = (out[0], f) if f else ("", ())
        if len(token) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[token] = out
        return out


def sentence_features(words: list[str], features: TokenFeatures) -> list[int] | None:
    """A feature counts once for each distinct word of the sentence that has it; None without a letter. Fit and score use this rule."""
    have = dict(filter(None, map(features.__getitem__, words)))
    return [x for f in have.values() for x in f] if have else None


@dataclass
class ToxicityModel:
    """Weights by feature id (sorted) and the sentence bias."""

    features: np.ndarray
    weights: np.ndarray
    bias: float

    def table(self) -> dict[int, float]:
        return dict(zip(self.features.tolist(), self.weights.tolist(), strict=True))


def fit(texts: list[str | None], toxic: list[int], min_docs: int = 3, steps: int = 120, rate: float = 0.15, support: float = 1.0) -> ToxicityModel:
    """Noisy-or likelihood by projected Adam over all given documents. No or one-sided labels: a constant score below 0.5.

    Weights are never negative: harmless words around an insult don't excuse it. ``support`` is an L1 penalty in
    documents, so that a feature needs more evidence than that to count at all.
    """
    y = np.array(toxic, np.float64)
    none = ToxicityModel(np.zeros(0, np.int64), np.zeros(0), -12.0)
    if not len(y) or y.sum() == 0:
        return none
    cache = TokenFeatures()
    flat: list[np.ndarray] = []
    lengths: list[int] = []
    sentences: list[int] = []
    docs_of = np.zeros(1 << SPACE_BITS, np.int32)
    for t in texts:
        n = len(flat)
        for sent in SENTENCE.findall(t or ""):
            if ids := sentence_features(sent.split(), cache):
                flat.append(np.array(ids, np.int32))
        lengths.extend(map(len, flat[n:]))
        sentences.append(len(flat) - n)
        if len(flat) > n:
            docs_of[np.unique(np.concatenate(flat[n:]))] += 1
    cache.clear()
    keep = np.array(sentences) > 0
    y, per_doc = y[keep], np.array(sentences)[keep]
    if not len(y) or y.sum() == 0:
        return none
    ids, lengths = np.concatenate(flat), np.array(lengths)
    flat.clear()
    sent_doc = np.repeat(np.arange(len(per_doc)), per_doc)
    # A feature counts if enough documents have it: rare ones would only learn their document by heart.
    known = np.flatnonzero(docs_of >= min_docs)
    to = np.full(1 << SPACE_BITS, -1, np.int32)
    to[known] = np.arange(len(known), dtype=np.int32)
    col, row = to[ids], np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    del ids
    row, col = row[col >= 0], col[col >= 0]
    if not len(known):
        return none
    w, b = np.zeros(len(known)), -4.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    n_sent = len(lengths)
    for step in range(1, steps + 1):
        z = np.clip(b + np.bincount(row, w[col], n_sent), -30, 30)
        p = 1 / (1 + np.exp(-z))
        clean = np.exp(-np.bincount(sent_doc, np.logaddexp(0, z), len(y)))
        blame = np.where(y == 1, -clean / np.maximum(1 - clean, 1e-9), 1.0)
        g = p * blame[sent_doc]
        gw, gb = (np.bincount(col, g[row], len(w)) + support) / len(y), g.sum() / len(y)
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c1, c2 = 1 - 0.9**step, 1 - 0.999**step
        w = np.maximum(0, w - rate * (m / c1) / (np.sqrt(v / c2) + 1e-6))
        b -= rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-6)
    return ToxicityModel(known[w > 0], w[w > 0], float(b))


def training_rows(docs: DataFrame, labels: DataFrame, max_labelled: int = 6_000, max_chars: int = 14_000_000, label: str = "toxic", text: str = "text") -> tuple[list, list]:
    """Texts and labels of at most about ``max_labelled`` labelled rows outside the held-out fifth and ``max_chars``.

    The held-out fifth are ids whose crc32 as text is a multiple of 5; they never reach the fit. The bounds limit the
    fit only. Null ids and labels are not used; an id labelled twice takes the larger label.
    """
    known = labels.where(f"doc_id is not null and {label} is not null").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    known = known.groupBy("doc_id").agg(F.max(label).alias("_y"))
    slots = 1 << 20
    draw = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(slots))
    share = min(1.0, max_labelled / max(1, known.count()))
    ids = known.where(draw < int(share * slots))
    # The drawn ids are bounded by max_labelled.
    scratch = Scratch(docs.sparkSession, "toxicity")
    rows = docs.select("doc_id", F.col(text).alias("_t")).join(F.broadcast(ids), "doc_id")
    rows = scratch.save(rows.withColumn("_d", draw).withColumn("_n", F.length("_t")).withColumn("_r", F.monotonically_increasing_id()))
    # In the order of the draw, as many as fit; a text that does not is left to the others.
    take, left = [], max_chars
    for r in sorted(rows.select("_d", "_r", "_n").collect()):
        if (r._n or 0) <= left:
            take.append(r._r)
            left -= r._n or 0
    picked = docs.sparkSession.createDataFrame([(r,) for r in take], "_r long")
    got = rows.join(F.broadcast(picked), "_r").orderBy("_r").select("_t", "_y").collect()
    scratch.drop(rows)
    return [r[0] for r in got], [r[1] for r in got]


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",), locate: bool = False) -> DataFrame:
    """``keep`` columns, score (0 to 1) and, with ``locate``, offending: (start, end, score) of sentences of 0.5 or more.

    Whole texts. Null, empty and wordless texts score 0, and so do sentences without a letter. One row for each row.
    """
    ship(docs.sparkSession)
    aside = Aside(keep)
    rows = docs.select(*aside.columns, F.col(text).alias("_text"))
    schema = rows.drop("_text").schema.add("score", "double")
    if locate:
        schema = schema.add("offending", T.ArrayType(T.StructType().add("start", T.IntegerType()).add("end", T.IntegerType()).add("score", "double")))
    shared = docs.sparkSession.sparkContext.broadcast((model.features, model.weights, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, weights, bias = shared.value
        table = dict(zip(features.tolist(), weights.tolist(), strict=True))
        # Features without a weight add nothing.
        cache = TokenFeatures(set(table))
        weight = table.__getitem__
        for b in batches:
            for first, texts in text_blocks(b.column(b.num_columns - 1), 2_000_000):
                part, out, where = b.slice(first, len(texts)), [], []
                for t in texts.to_pylist():
                    z, at = [], []
                    for s in SENTENCE.finditer(t):
                        if (ids := sentence_features(s.group().split(), cache)) is not None:
                            z.append(bias + sum(map(weight, ids)))
                            at.append(s.span())
                    zz = np.clip(np.array(z), -30, 30)
                    out.append(float(-np.expm1(-np.logaddexp(0, zz).sum())))
                    if locate:
                        where.append([{"start": i, "end": j, "score": float(1 / (1 + np.exp(-x)))} for (i, j), x in zip(at, zz.tolist(), strict=True) if x >= 0])
                cols = [*part.columns[:-1], pa.array(out, pa.float64())]
                if locate:
                    cols.append(pa.array(where, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))))
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return aside.back(rows.mapInArrow(tidy(run), schema), "score", *["offending"] * locate)
