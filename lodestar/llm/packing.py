"""Best-fit packing: bounded-space online best-fit over token counts.

Texts become pieces of token ids where they lie; pieces alone, without their ids, are then dealt to packing tasks of about
``TASK_PIECES`` each, however many partitions the texts had. A packing task takes its pieces one at a time, in the order of
a hash, and never moves one again. A fixed number of bins is open; a bitset has bit ``f`` set while an open bin has ``f``
free places, so the tightest bin that fits is the lowest set bit at or above the piece's length. When too many bins are
open the fullest closes first.
"""

from __future__ import annotations

import json
import os
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import Scratch, text_blocks, tidy

SEQUENCE = 2048
#: Bins open at once, and pieces that one packing task takes.
OPEN_BINS, TASK_PIECES = 1024, 1 << 18


class OpenBins:
    """At most ``limit`` open bins of ``size`` places. ``place`` gives (bin, offset); numbers of bins count from 0."""

    def __init__(self, size: int = SEQUENCE, limit: int = OPEN_BINS):
        self.size, self.limit = size, limit
        self.bits, self.open, self.made = 0, 0, 0
        self.stacks: dict[int, list[int]] = defaultdict(list)

    def place(self, length: int) -> tuple[int, int]:
        if not 0 <= length <= self.size:
            raise ValueError(f"a piece of {length} does not fit {self.size} places")
        fits = self.bits >> length
        if fits and length:
            free = length + (fits & -fits).bit_length() - 1
            which = self._take(free)
        else:
            which, free = self.made, self.size
            self.made += 1
            if self.open == self.limit and length < free:
                self._take((self.bits & -self.bits).bit_length() - 1)
        if left := free - length:
            self.stacks[left].append(which)
            self.bits |= 1 << left
            self.open += 1
        return which, self.size - free

    def _take(self, free: int) -> int:
        stack = self.stacks[free]
        which = stack.pop()
        if not stack:
            self.bits &= ~(1 << free)
        self.open -= 1
        return which


#: Letters whose normal form and lower case are one letter each, and ASCII signs.
_LETTER, _SIGN = "[A-Za-zÀ-ÖØ-öø-įı-ɏ]", "[!-/:-@\\[-`{-~]"


class ChunkTokenizer:
    """Ids of a tokenizers file for whole texts, from the ids of their distinct chunks.

    A chunk is what lies between white space. Made for the files whose model drops white space and splits the rest into
    runs of letters, single numbers and runs of other signs, each such word ending in ``</w>``: there a text's ids are
    those of its chunks in order. All ids come from the library. Chunks of Latin letters, of ASCII signs, or of letters
    before signs go to its model in lower case and joined by spaces, for their words can be counted; every other chunk
    goes alone through the whole file; and so does, as a whole, a text with one of the four characters that only Arrow
    counts as white space. Ids of up to ``max_chunks`` chunks of up to ``max_length`` bytes are kept, as two columns;
    when there are more, those that the present block met again stay.
    """

    def __init__(self, path: str, max_chunks: int = 600_000, max_length: int = 48):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks fill the cores
        self.whole = Tokenizer.from_file(path)
        spec = json.loads(self.whole.to_str())
        vocab = spec["model"]["vocab"]
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for s, i in vocab.items() if s.endswith("</w>")]] = True
        spec |= {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "WhitespaceSplit"}, "post_processor": None, "decoder": None}
        self.model = Tokenizer.from_str(json.dumps(spec))
        # The byte-level alphabet: printable Latin-1 stands for itself, the other bytes for the signs from 256 on.
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
        self.alphabet = {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in plain) if b != 32}
        self.max_chunks, self.max_length = max_chunks, max_length
        self.chunks, self.values = pa.array([], pa.string()), pa.array([], pa.large_binary())

    def _learn(self, chunks: pa.Array) -> tuple[pa.Array, pa.Array]:
        """The chunks in another order, and the ids of each."""
        one, two = pc.match_substring_regex(chunks, f"^(?:{_LETTER}+|{_SIGN}+)$"), pc.match_substring_regex(chunks, f"^{_LETTER}+{_SIGN}+$")
        ascii = pc.string_is_ascii(chunks)
        names, values = [], []
        for which, words in ((one, 1), (two, 2)):
            for same in (ascii, pc.invert(ascii)):
                plain = chunks.filter(pc.and_(which, same))
                if not len(plain):
                    continue
                spaced = plain if words == 1 else pc.replace_substring_regex(plain, f"^({_LETTER}+)", "\\1 ")
                cut = pa.array([*range(0, len(plain), 200), len(plain)], pa.int32())
                texts = [t.lower() for t in pc.binary_join(pa.ListArray.from_arrays(cut, spaced), " ").to_pylist()]
                if same is not ascii:
                    texts = [t.encode().decode("latin-1").translate(self.alphabet) for t in texts]
                ids = np.concatenate([np.array(e.ids, "<u4") for e in self.model.encode_batch_fast(texts, add_special_tokens=False)])
                ends = np.flatnonzero(self.ends[ids]) + 1
                if len(ends) != words * len(plain):
                    raise ValueError("the model does not end each word once")
                at = np.concatenate([[0], 4 * ends[words - 1 :: words]])
                names.append(plain)
                values.append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(plain), [None, pa.py_buffer(at), pa.py_buffer(ids)]))
        odd = chunks.filter(pc.invert(pc.or_(one, two)))
        for at in range(0, len(odd), 10_000):
            names.append(odd[at : at + 10_000])
            values.append(pa.array([np.array(e.ids, "<u4").tobytes() for e in self.whole.encode_batch_fast(names[-1].to_pylist(), add_special_tokens=False)], pa.large_binary()))
        return pa.concat_arrays(names), pa.concat_arrays(values)

    def _chunk_ids(self, chunks: pa.Array) -> pa.Array:
        at = pc.index_in(chunks, self.chunks)
        if not at.null_count:
            return self.values.take(at)
        names, ids = self._learn(chunks.filter(pc.is_null(at)))
        out = pc.if_else(pc.is_null(at), pc.add(pc.index_in(chunks, names), len(self.values)), at)
        out = pa.concat_arrays([self.values, ids]).take(out)
        if len(self.chunks) + len(names) > self.max_chunks:
            met = pc.drop_null(at)
            self.chunks, self.values = self.chunks.take(met), self.values.take(met)
        keep = pc.less_equal(pc.binary_length(names), self.max_length)
        room = max(0, self.max_chunks - len(self.chunks))
        self.chunks = pa.concat_arrays([self.chunks, names.filter(keep)[:room]])
        self.values = pa.concat_arrays([self.values, ids.filter(keep)[:room]])
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and where each text's ids begin, with the end of the last."""
        split = pc.utf8_split_whitespace(texts)
        tokens = split.flatten().dictionary_encode()
        ids = self._chunk_ids(tokens.dictionary).take(tokens.indices)
        counts = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64))])
        at = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset : ids.offset + len(ids) + 1] if len(ids) else np.zeros(1, np.int64)
        data = np.frombuffer(ids.buffers()[2] or b"", "<u4") if len(ids) else np.zeros(0, "<u4")
        cut = at[counts] // 4
        odd = np.flatnonzero(pc.match_substring_regex(texts, "[\\x1c-\\x1f]").to_numpy(zero_copy_only=False))
        if len(odd):
            parts = [data[i:j] for i, j in zip(cut, cut[1:], strict=False)]
            for i in odd.tolist():
                parts[i] = np.array(self.whole.encode(texts[i].as_py(), add_special_tokens=False).ids, "<u4")
            data, cut = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return data, cut


_TOKENIZERS: dict[str, ChunkTokenizer] = {}


def tokenizer(path: str) -> ChunkTokenizer:
    """One for each worker process and file, so that later tasks of the worker find its chunks."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = ChunkTokenizer(path)
    return _TOKENIZERS[path]


PACKED = "piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def token_pieces(docs: DataFrame, tokenizer_path: str, size: int = SEQUENCE, end_id: int = 0, text: str = "text", id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """(_id, piece, start, length, ids_crc32) and, with ``with_ids``, ``_ids``: the pieces of each document, little-endian."""
    ship(docs.sparkSession)
    schema = f"_id {docs.schema[id_col].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", _ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(tokenizer_path)
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            for at, texts in text_blocks(b.column(1), 8_000_000):
                row, piece, start, length, crc, kept = [], [], [], [], [], []
                data, cut = tok.encode(texts)
                for i, (lo, hi) in enumerate(zip(cut, cut[1:], strict=False)):
                    ids = data[lo:hi].tobytes() + end
                    for n, s in enumerate(range(0, len(ids) // 4, size)):
                        part = ids[4 * s : 4 * (s + size)]
                        row.append(at + i)
                        piece.append(n)
                        start.append(s)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        if with_ids:
                            kept.append(part)
                cols = [b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(c, pa.int64()) for c in (start, length, crc))]
                yield pa.RecordBatch.from_arrays([*cols, *[pa.array(kept, pa.binary())] * with_ids], names=["_id", "piece", "start", "length", "ids_crc32", *["_ids"] * with_ids])

    return docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text")).mapInArrow(tidy(run), schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, size: int = SEQUENCE, open_bins: int = OPEN_BINS, task_pieces: int = TASK_PIECES, end_id: int = 0, text: str = "text", id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """One row for each piece: id, piece, start, length, ids_crc32, sequence_id, offset (and ids with ``with_ids``).

    A document is its ids, then ``end_id``; null and empty texts are ``end_id`` alone. Only documents of over ``size``
    tokens are cut, into pieces of ``size`` and a rest. Rows with null or repeated ids are packed like others. Extra
    columns are not read. Pieces are packed in the order of a hash of their columns, so that a packing task that runs
    again gives the same places; sequence numbers hold the task's number, so that no two tasks share one.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    pieces = scratch.save(token_pieces(docs, tokenizer_path, size, end_id, text, id_col, with_ids))
    tasks = max(1, -(-pieces.count() // task_pieces))
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, {PACKED}" + ", ids array<long>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bins, base = OpenBins(size, open_bins), TaskContext.get().partitionId() << 40
        for b in batches:
            put = [bins.place(n) for n in b.column(3).to_pylist()]
            out = [*b.columns[:5], pa.array([base + k for k, _ in put], pa.int64()), pa.array([o for _, o in put], pa.int64())]
            if with_ids:
                out.append(pa.array([np.frombuffer(d, "<u4").astype(np.int64) for d in b.column(5).to_pylist()], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(out, names=[id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * with_ids])

    order = [F.xxhash64("_id", "piece", "ids_crc32"), "_id", "piece", "ids_crc32", "length"]
    return pieces.repartition(tasks).sortWithinPartitions(*order).mapInArrow(tidy(run), schema)
