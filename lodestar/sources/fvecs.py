"""The ``fvecs`` data source: records of a little-endian int32 dimension and that many float32 values."""

from __future__ import annotations

import os
import posixpath
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..operators.scan import matrix
from ..shipping import ship

SCHEMA = "vec_id long, embedding array<float>"


def decode(data: bytes, dim: int) -> np.ndarray:
    """Rows of whole records; a record of another dimension is an error."""
    raw = np.frombuffer(data, "<i4").reshape(-1, dim + 1)
    if len(raw) and (raw[:, 0] != dim).any():
        raise ValueError(f"a record's dimension differs from {dim}")
    return raw[:, 1:].view("<f4")


def encode(rows: np.ndarray) -> bytes:
    x = np.ascontiguousarray(rows, "<f4")
    return np.concatenate([np.full((len(x), 1), x.shape[1], "<i4"), x.view("<i4")], axis=1).tobytes()


@dataclass
class Range(InputPartition):
    path: str
    start: int
    count: int
    first_id: int
    dim: int


def _place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, local or distributed, and the path there."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path.removeprefix("file:")))


def _files(path: str) -> list[fs.FileInfo]:
    """The file, or the fvecs files of the folder in the order of their names."""
    store, p = _place(path)
    info = store.get_file_info(p)
    if info.type != fs.FileType.Directory:
        return [info]
    return sorted((f for f in store.get_file_info(fs.FileSelector(p)) if f.base_name.endswith(".fvecs") and not f.base_name.startswith(".") and f.is_file), key=lambda f: f.base_name)


class FvecsReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.rows = options["path"], int(options.get("rowspertask", 100_000))

    def partitions(self) -> list[Range]:
        out, first = [], 0
        store, _ = _place(self.path)
        for info in _files(self.path):
            f, size = info.path, info.size
            if info.type == fs.FileType.NotFound:
                raise FileNotFoundError(f)
            if not size:
                continue
            with store.open_input_file(f) as fh:
                dim = struct.unpack("<i", fh.read(4))[0]
            record = 4 * (dim + 1)
            if dim < 1 or size % record:
                raise ValueError(f"{f} is not a whole number of records of {dim} values")
            n = size // record
            out += [Range(f, a, min(self.rows, n - a), first + a, dim) for a in range(0, n, self.rows)]
            first += n
        return out

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if part is None:
            return
        store, _ = _place(self.path)
        with store.open_input_file(part.path) as fh:
            fh.seek(part.start * 4 * (part.dim + 1))
            for at in range(0, part.count, 8192):
                n = min(8192, part.count - at)
                x = decode(fh.read(n * 4 * (part.dim + 1)), part.dim)
                flat = pa.array(np.ascontiguousarray(x).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * part.dim, part.dim, dtype=np.int32)), flat)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(part.first_id + at, part.first_id + at + n)), lists], names=["vec_id", "embedding"])


@dataclass
class Written(WriterCommitMessage):
    path: str
    rows: int


class FvecsWriter(DataSourceArrowWriter):
    """One file for each task, in the order of its rows; unfinished files are hidden, and old ones stay, until the job commits."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.name, self.overwrite = options["path"], options.get("name", "part"), overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        store, top = _place(self.path)
        store.create_dir(top, recursive=True)
        ctx = TaskContext.get()
        path, n = posixpath.join(top, f".{self.name}-{ctx.partitionId():05d}-{ctx.taskAttemptId()}"), 0
        with store.open_output_stream(path) as out:
            for b in batches:
                if b.num_rows:
                    lists = b.column(b.schema.get_field_index("embedding"))
                    out.write(encode(matrix(lists, len(lists[0]))))
                    n += b.num_rows
        return Written(path, n)

    def commit(self, messages) -> None:
        store, top = _place(self.path)
        if self.overwrite and store.get_file_info(top).type == fs.FileType.Directory:
            for f in _files(self.path):
                store.delete_file(f.path)
        for m in messages:
            if m and m.rows:
                name = posixpath.basename(m.path)[1:].rsplit("-", 1)[0]
                store.move(m.path, posixpath.join(top, f"{name}.fvecs"))
            elif m:
                store.delete_file(m.path)

    def abort(self, messages) -> None:
        store, _ = _place(self.path)
        for m in messages:
            if m and store.get_file_info(m.path).is_file:
                store.delete_file(m.path)


class FvecsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fvecs"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FvecsReader:
        return FvecsReader(self.options)

    def writer(self, schema, overwrite: bool) -> FvecsWriter:
        return FvecsWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(FvecsSource)


def read_fvecs(spark: SparkSession, path: str) -> DataFrame:
    """(vec_id, embedding) of a file or a folder of files; ids count records in the order of file names."""
    register(spark)
    return spark.read.format("fvecs").load(path)


def write_fvecs(vectors: DataFrame, path: str, name: str = "part") -> None:
    """All vectors in id order; files follow one another by name."""
    register(vectors.sparkSession)
    vectors.orderBy("vec_id").select("vec_id", "embedding").write.format("fvecs").option("name", name).mode("overwrite").save(path)


def export_shards(vectors: DataFrame, assignments: DataFrame, path: str, base_name: str, ratio: float) -> list[str]:
    """Primary vectors of each shard in a folder of its own, named after base, shard and ratio; the folders' paths."""
    primary = vectors.join(assignments.where(~F.col("is_replica")), "vec_id")
    out = []
    for (shard,) in sorted(primary.select("shard_id").distinct().collect()):
        out.append(f"{path}/{base_name}_Partition_{shard}_{ratio:.2f}.fvecs")
        write_fvecs(primary.where(F.col("shard_id") == shard), out[-1])
    return out
