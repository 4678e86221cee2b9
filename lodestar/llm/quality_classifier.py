"""Quality classifier: hierarchical empirical Bayes over documents, hosts and paths.

A logistic model over binned text features gives each document's evidence. The evidence is summed over each path and
host; a host's rate is shrunk toward the global rate and a path's toward its host's, the more the fewer documents it
has, with prior strengths fitted by moments. A document's posterior log odds are its own plus those that the other
documents of its path and host give the path, against the global ones: its own evidence counts once, so that a document
alone on its site has the global prior.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import Aside, Scratch, text_blocks, tidy

FEATURES = ("log_words", "mean_word", "symbol_rate", "distinct_rate", "stutter_rate", "dup_line_rate", "digit_rate", "upper_rate", "short_rate", "end_rate", "letter_rate", "words_per_line")
SYMBOL = re.compile(r"[#*$%&|<>{}\[\]\\^~=_@]")
DIGIT, UPPER, LETTER = re.compile(r"[0-9]"), re.compile(r"[A-Z]"), re.compile(r"[^\W\d_]")
#: Site tables up to this many rows are broadcast; larger ones meet the documents in a shuffle.
BROADCAST_SITES = 100_000


def features_of(text: str | None) -> list[float]:
    """FEATURES of a whole text; all 0 for null, empty and blank texts."""
    t = text or ""
    words = t.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    chars = sum(map(len, words))
    lines = [x for x in t.split("\n") if x and not x.isspace()]
    stutter = sum(map(str.__eq__, words, words[1:]))
    ends = t.count(".") + t.count("!") + t.count("?")
    return [
        float(np.log1p(n)), chars / n, len(SYMBOL.findall(t)) / chars, len(set(words)) / n, stutter / n, 1 - len(set(lines)) / len(lines),
        len(DIGIT.findall(t)) / chars, len(UPPER.findall(t)) / chars, sum(len(w) <= 2 for w in words) / n, ends / n, len(LETTER.findall(t)) / chars, n / len(lines),
    ]


@dataclass
class QualityModel:
    """One weight for each bin of each feature."""

    edges: list[np.ndarray]
    weights: np.ndarray
    bias: float

    def evidence(self, x: np.ndarray) -> np.ndarray:
        """Probability of quality 1 for rows of FEATURES."""
        z = np.full(len(x), self.bias)
        for j, e in enumerate(self.edges):
            z += self.weights[j, np.searchsorted(e, x[:, j], "right")]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, bins: int = 24, steps: int = 300, rate: float = 0.05, l2: float = 1e-3) -> QualityModel:
    """Logistic regression over quantile bins. Without labels of both kinds: the constant rate, or 1 without any."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0.02, 0.98, bins - 1))) if len(x) else np.zeros(0) for j in range(len(FEATURES))]
    w = np.zeros((len(FEATURES), bins))
    if not len(y) or y.min() == y.max():
        return QualityModel(edges, w, 6.0 if not len(y) or y.max() == 1 else -6.0)
    # Quantiles of the rarer label as well: junk is a few hundredths of the rows.
    rare = x[y == (0 if y.mean() > 0.5 else 1)]
    edges = [np.unique(np.concatenate([np.quantile(x[:, j], np.linspace(0.02, 0.98, bins // 2)), np.quantile(rare[:, j], np.linspace(0.05, 0.95, bins - 1 - bins // 2))])) for j in range(len(FEATURES))]
    at = np.stack([np.searchsorted(e, x[:, j], "right") + j * bins for j, e in enumerate(edges)], 1)
    b, w = float(np.log(y.mean() / (1 - y.mean()))), w.ravel()
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(b + w[at].sum(1), -30, 30)))
        g = (p - y) / len(y)
        grad = np.append(np.bincount(at.ravel(), np.repeat(g, at.shape[1]), len(w)) + l2 * w / 10, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        d = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - d[:-1], b - d[-1]
    return QualityModel(edges, w.reshape(len(FEATURES), bins), b)


def labelled_features(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most about ``max_labelled`` rows, drawn by a hash of doc_id; the bound limits the fit only."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("_y"))
    share = min(1.0, max_labelled / max(1, known.count()))
    ids = known.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 20)) < int(share * (1 << 20)))

    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, texts in text_blocks(b.column(1), 1_000_000):
                yield pa.RecordBatch.from_arrays([b.column(0)[at : at + len(texts)], pa.array([features_of(t) for t in texts.to_pylist()], pa.list_(pa.float64()))], names=["y", "x"])

    rows = docs.select("doc_id", F.col(text).alias("_t")).join(F.broadcast(ids), "doc_id")
    got = rows.select(F.col("_y").cast("int").alias("y"), "_t").mapInArrow(tidy(run), "y int, x array<double>").collect()
    x = np.array([r.x for r in got], np.float64).reshape(-1, len(FEATURES))
    return x, np.array([r.y for r in got], np.float64)


def with_evidence(docs: DataFrame, model: QualityModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``evidence``, the document's own probability of quality 1."""
    aside = Aside(keep)
    rows = docs.select(*aside.columns, F.col(text).alias("_text"))
    schema = rows.drop("_text").schema.add("evidence", "double")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            for at, texts in text_blocks(b.column(b.num_columns - 1), 2_000_000):
                x = np.array([features_of(t) for t in texts.to_pylist()], np.float64).reshape(-1, len(FEATURES))
                part = b.slice(at, len(texts))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(m.evidence(x))], names=schema.names)

    return aside.back(rows.mapInArrow(tidy(run), schema), "evidence")


def _logit(c: Column) -> Column:
    p = F.least(F.greatest(c, F.lit(1e-9)), F.lit(1 - 1e-9))
    return F.log(p / (1 - p))


def _strength(rates: DataFrame, n: str, k: str, prior: Column) -> float:
    """Prior strength by moments: what is left of the spread of rates beyond that of counting."""
    r = F.col(k) / F.col(n)
    row = rates.agg(F.sum(F.col(n) * (r - prior) ** 2).alias("a"), F.sum(prior * (1 - prior)).alias("b"), F.sum(n).alias("n"), F.count("*").alias("g")).first()
    if not row.n or row.g < 2:
        return 100.0
    spread = max(0.0, (row.a - row.b) / row.n)
    mean = row.b / row.g
    return float(min(1e6, max(1.0, mean / spread - 1))) if spread > 0 else 1e6


def posterior(scored: DataFrame, scratch: Scratch) -> DataFrame:
    """``scored(_host, _path, evidence, ...)`` with site_rate and quality, the posterior probability of quality 1.

    Null hosts and paths are sites of their own. All rates come from all rows; hot hosts are summed before the shuffle.
    """
    scored = scored.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in ("_host", "_path")})
    paths = scratch.save(scored.groupBy("_host", "_path").agg(F.count("*").alias("n"), F.sum("evidence").alias("k")), few=True)
    top = paths.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    rate = top.k / top.n if top.n else 0.5
    hosts = paths.groupBy("_host").agg(F.sum("n").alias("hn"), F.sum("k").alias("hk"))
    of_host = _strength(hosts, "hn", "hk", F.lit(rate))
    both = scratch.save(paths.join(hosts, "_host"), few=True)
    of_path = _strength(both.withColumn("host_rate", (F.col("hk") + of_host * rate) / (F.col("hn") + of_host)), "n", "k", F.col("host_rate"))
    if both.count() <= BROADCAST_SITES:
        both = F.broadcast(both)
    # The rates of the others: a document's own evidence leaves the sums of its path and host.
    e = F.col("evidence")
    host_rate = (F.col("hk") - e + of_host * rate) / (F.col("hn") - 1 + of_host)
    out = scored.join(both, ["_host", "_path"]).withColumn("site_rate", (F.col("k") - e + of_path * host_rate) / (F.col("n") - 1 + of_path))
    odds = _logit(e) + _logit(F.col("site_rate")) - _logit(F.lit(rate))
    return out.withColumn("quality", 1 / (1 + F.exp(-odds))).drop("_host", "_path", "n", "k", "hn", "hk")


def classify(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] | None = None, threshold: float = 0.5, host: str = "source", path: str = "lang", max_labelled: int = 20_000, text: str = "text") -> DataFrame:
    """Columns ``keep`` of ``docs`` (all if None) with evidence, site_rate, quality and kept (quality >= threshold).

    ``host`` and ``path`` are any two columns of which the second parts the first; ``documents`` has no addresses, so its
    source stands for the host and its language for the path. One row for each row. Blank texts are judged by their
    features, all 0. No labels: all rows are kept. Columns of ``docs`` named like an added one are replaced.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    aside = Aside(tuple(docs.columns) if keep is None else keep)
    model = fit(*labelled_features(docs, labels, max_labelled, text))
    # Sites and evidence only, and what is kept: texts are written again only if they are among it.
    rows = docs.select(*aside.columns, F.col(host).alias("_host"), F.col(path).alias("_path"), F.col(text).alias("_text"))
    scored = scratch.save(with_evidence(rows, model, "_text", (*aside.names, "_host", "_path")))
    return aside.back(posterior(scored, scratch).withColumn("kept", F.col("quality") >= threshold), "evidence", "site_rate", "quality", "kept")
