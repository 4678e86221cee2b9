"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

The automaton reads a text once. At each position the output links list every piece that ends there, longest first;
each relaxes the best score at that position from the best score at its start. A character that no single-character
piece covers may stand alone at the unknown penalty and is written as its UTF-8 bytes' pieces.
"""

from __future__ import annotations

import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship
from .common import Aside, text_blocks, tidy

SPACE = "▁"
#: Added to the lowest score for a character without a piece.
UNKNOWN_PENALTY = 10.0


class Automaton:
    """Goto, failure and output links over a set of pieces."""

    def __init__(self, pieces: dict[str, int]):
        self.goto: list[dict[str, int]] = [{}]
        self.word: list[int] = [-1]
        self.length: list[int] = [0]
        for p, i in pieces.items():
            s = 0
            for ch in p:
                nxt = self.goto[s].get(ch)
                if nxt is None:
                    nxt = self.goto[s][ch] = len(self.goto)
                    self.goto.append({})
                    self.word.append(-1)
                    self.length.append(self.length[s] + 1)
                s = nxt
            self.word[s] = i
        n = len(self.goto)
        self.fail, self.output = [0] * n, [0] * n
        queue = deque(self.goto[0].values())
        while queue:
            s = queue.popleft()
            f = self.fail[s]
            # The nearest shorter suffix that is a piece; state 0 ends the chain.
            self.output[s] = f if self.word[f] >= 0 else self.output[f]
            for ch, t in self.goto[s].items():
                queue.append(t)
                r = f
                while r and ch not in self.goto[r]:
                    r = self.fail[r]
                self.fail[t] = self.goto[r].get(ch, 0)

    def step(self, s: int, ch: str) -> int:
        goto = self.goto
        while ch not in goto[s]:
            if not s:
                return 0
            s = self.fail[s]
        return goto[s][ch]


class PieceModel:
    """Pieces, scores and ids of a SentencePiece file; ``encode`` and ``decode`` whole texts."""

    def __init__(self, path: str, max_units: int = 800_000):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        kept = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.pieces = {sp.id_to_piece(i): i for i in kept}
        self.score = [sp.get_score(i) for i in range(n)]
        self.unknown = min(self.score[i] for i in kept) - UNKNOWN_PENALTY
        self.unknown_id = sp.unk_id()
        self.bytes = {int(sp.id_to_piece(i)[1:-1], 16): i for i in range(n) if sp.is_byte(i)}
        self.text = [sp.id_to_piece(i).replace(SPACE, " ").encode() for i in range(n)]
        for b, i in self.bytes.items():
            self.text[i] = bytes([b])
        for i in range(n):
            if sp.is_control(i):
                self.text[i] = b""
        self.automaton = Automaton(self.pieces)
        # No piece holds a space after another character, so that texts fall into units that begin with their spaces.
        self.split = re.compile(f"{SPACE}*[^{SPACE}]*").findall if not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.pieces) else None
        self.max_units = max_units
        self.units: dict[str, bytes] = {}

    def viterbi(self, text: str) -> list[int]:
        """Ids of the segmentation with the largest sum of scores; of equal ones the longest last piece."""
        n = len(text)
        best, back = [0.0] + [float("-inf")] * n, [0] * (n + 1)
        used = [-1] * (n + 1)
        a, score, unknown = self.automaton, self.score, self.unknown
        word, length, output, step = a.word, a.length, a.output, a.step
        s = 0
        for e, ch in enumerate(text, 1):
            s = step(s, ch)
            top, at, which, single = float("-inf"), 0, -1, False
            t = s if word[s] >= 0 else output[s]
            while t:
                k = length[t]
                if (x := best[e - k] + score[word[t]]) > top:
                    top, at, which = x, e - k, word[t]
                single = single or k == 1
                t = output[t]
            if not single and (x := best[e - 1] + unknown) > top:
                top, at, which = x, e - 1, -1
            best[e], back[e], used[e] = top, at, which
        out: list[int] = []
        e = n
        while e:
            i = back[e]
            if used[e] >= 0:
                out.append(used[e])
            elif self.bytes:
                out.extend(self.bytes[b] for b in reversed(text[i:e].encode()))
            else:
                out.append(self.unknown_id)
            e = i
        out.reverse()
        return out

    def encode_bytes(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit numbers. An empty text has none."""
        if not text:
            return b""
        t = SPACE + text.replace(" ", SPACE)
        if self.split is None:
            return np.array(self.viterbi(t), "<u4").tobytes()
        known, out = self.units, []
        for u in self.split(t):
            ids = known.get(u)
            if ids is None:
                ids = np.array(self.viterbi(u), "<u4").tobytes()
                if len(u) <= 64:
                    if len(known) >= self.max_units:
                        known.clear()
                    known[u] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decode(self, ids) -> str:
        """The text of ids, without the space that encoding puts first. Broken bytes become U+FFFD."""
        out = b"".join(map(self.text.__getitem__, ids)).decode("utf-8", "replace")
        return out[1:] if out.startswith(" ") else out


_MODELS: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    """One for each worker process and file, so that later tasks of the worker find its units."""
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def encode(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ids. Null texts have null ids, empty ones none. One row for each row; whole texts."""
    ship(docs.sparkSession)
    aside = Aside(keep)
    rows = docs.select(*aside.columns, F.col(text).alias("_text"))
    schema = rows.drop("_text").schema.add("ids", T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for b in batches:
            null = b.column(b.num_columns - 1).is_null().to_pylist()
            for at, texts in text_blocks(b.column(b.num_columns - 1)):
                ids = [None if null[at + i] else np.frombuffer(m.encode_bytes(t), "<i4") for i, t in enumerate(texts.to_pylist())]
                yield pa.RecordBatch.from_arrays([*b.slice(at, len(ids)).columns[:-1], pa.array(ids, pa.list_(pa.int32()))], names=schema.names)

    return aside.back(rows.mapInArrow(tidy(run), schema), "ids")


def decode(encoded: DataFrame, path: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and text. Null ids have a null text."""
    ship(encoded.sparkSession)
    aside = Aside(keep)
    rows = encoded.select(*aside.columns, F.col(ids).alias("_ids"))
    schema = rows.drop("_ids").schema.add("text", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = [m.decode(x.values.to_pylist()) if x.is_valid else None for x in part.column(b.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string())], names=schema.names)

    return aside.back(rows.mapInArrow(tidy(run), schema), "text")


def round_trip(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, n_ids, ids_crc32, text_crc32 (of the decoded text) and exact (decoded equals the text).

    Encodes and decodes each text in one pass; null counts as empty. Only texts with U+2581 itself are inexact.
    """
    ship(docs.sparkSession)
    aside = Aside(keep)
    rows = docs.select(*aside.columns, F.col(text).alias("_text"))
    kinds = {"n_ids": "long", "ids_crc32": "long", "text_crc32": "long", "exact": "boolean"}
    schema = rows.drop("_text").schema
    for c, k in kinds.items():
        schema = schema.add(c, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for b in batches:
            for at, texts in text_blocks(b.column(b.num_columns - 1)):
                out = []
                for t in texts.to_pylist():
                    data = m.encode_bytes(t)
                    back = m.decode(np.frombuffer(data, "<u4").tolist())
                    out.append((len(data) // 4, zlib.crc32(data), zlib.crc32(back.encode()), back == t))
                cols = [pa.array(c, pa.bool_() if i == 3 else pa.int64()) for i, c in enumerate(zip(*out, strict=True))]
                yield pa.RecordBatch.from_arrays([*b.slice(at, len(out)).columns[:-1], *cols], names=schema.names)

    return aside.back(rows.mapInArrow(tidy(run), schema), *kinds)
