"""Matrices in NPY files as a Spark data source: format "npy".

A file, or a folder of files, is read as rows (file, row, vector) in partitions of `rows` rows each, by byte range, so that
a file of any size is many tasks' work and only headers are read on the driver. Written vectors become one file for each
partition, which take their names when all are there. Files are opened through Arrow's file systems, by any address
that these know; a store that only Spark's own readers reach is not among them.
"""

from __future__ import annotations

import ast
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as afs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

_MAGIC = b"\x93NUMPY"
_BATCH_BYTES = 4 << 20
SCHEMA = "file string, row long, vector array<double>"


def _opened(path: str) -> tuple[afs.FileSystem, str]:
    return afs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (afs.LocalFileSystem(), path)


def header(read) -> tuple[np.dtype, tuple[int, ...], int]:
    """(type, shape, where the data begin) of an open file. Only numbers in rows are matrices here."""
    if read.read(6) != _MAGIC:
        raise ValueError("this is no NPY file")
    major = read.read(2)[0]
    size = struct.unpack("<H" if major == 1 else "<I", read.read(2 if major == 1 else 4))[0]
    told = ast.literal_eval(read.read(size).decode("latin1"))
    kind = np.dtype(told["descr"])
    if kind.kind not in "fiu" or told["fortran_order"]:
        raise ValueError(f"a matrix of numbers in row order is needed, not {told['descr']}{' in column order' if told['fortran_order'] else ''}")
    return kind, tuple(told["shape"]), 6 + 2 + (2 if major == 1 else 4) + size


@dataclass
class Rows(InputPartition):
    path: str
    begin: int  # of the data, in bytes
    first: int
    count: int
    width: int
    kind: str


class NpyReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.each = options["path"], int(options.get("rows", 100_000))
        width, total = options.get("dimension"), options.get("expected")
        self.width, self.total = int(width) if width else None, int(total) if total else None
        self.finite = options.get("finite", "true").lower() == "true"

    def partitions(self) -> list[Rows]:
        fs, root = _opened(self.path)
        if fs.get_file_info(root).type == afs.FileType.Directory:
            files = sorted(f.path for f in fs.get_file_info(afs.FileSelector(root, recursive=True)) if f.is_file and f.path.endswith(".npy") and not f.base_name.startswith((".", "_")))
        else:
            files = [root]
        out, rows = [], 0
        for file in files:
            with fs.open_input_file(file) as read:
                kind, shape, begin = header(read)
                if len(shape) != 2:
                    raise ValueError(f"{file} has shape {shape}, not rows of vectors")
                if self.width is not None and shape[1] != self.width:
                    raise ValueError(f"{file} has vectors of {shape[1]} components, not {self.width}")
                if read.size() != begin + shape[0] * shape[1] * kind.itemsize:
                    raise ValueError(f"{file} is {read.size()} bytes long, not {begin + shape[0] * shape[1] * kind.itemsize}")
            rows += shape[0]
            out += [Rows(file, begin, at, min(self.each, shape[0] - at), shape[1], kind.str) for at in range(0, shape[0], self.each)]
        if self.total is not None and rows != self.total:
            raise ValueError(f"{self.path} has {rows} vectors, not {self.total}")
        return out or [Rows("", 0, 0, 0, 0, "<f8")]

    def read(self, part: Rows) -> Iterator[pa.RecordBatch]:
        if not part.count:
            return
        fs, kind = _opened(self.path)[0], np.dtype(part.kind)
        step = max(1, _BATCH_BYTES // max(1, part.width * kind.itemsize))
        with fs.open_input_file(part.path) as read:
            for at in range(part.first, part.first + part.count, step):
                n = min(step, part.first + part.count - at)
                read.seek(part.begin + at * part.width * kind.itemsize)
                x = np.frombuffer(read.read(n * part.width * kind.itemsize), kind).reshape(n, part.width).astype(np.float64)
                if self.finite and not np.isfinite(x).all():
                    bad = at + int(np.flatnonzero(~np.isfinite(x).all(1))[0])
                    raise ValueError(f"row {bad} of {part.path} has components that are no finite numbers")
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * part.width, pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array([part.path] * n), pa.array(np.arange(at, at + n)), vectors], ["file", "row", "vector"])


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # names while writing and after


class NpyWriter(DataSourceArrowWriter):
    """A column `vector` to float32 rows. Vectors of unlike sizes, nulls and components that are no finite numbers fail."""

    def __init__(self, options: dict, schema: StructType):
        self.path, self.at = options["path"], schema.fieldNames().index("vector")

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        fs, root = _opened(self.path)
        fs.create_dir(root, recursive=True)
        name = uuid.uuid4().hex
        hidden, final, width, rows = f"{root}/.{name}.tmp", f"{root}/part-{name}.npy", None, 0
        with fs.open_output_stream(hidden) as out:
            for batch in batches:
                column = batch.column(self.at)
                sizes = set(column.value_lengths().to_pylist())
                x = column.flatten().to_numpy(zero_copy_only=False).astype("<f4")
                if len(sizes | ({width} if width else set())) > 1 or None in sizes or not np.isfinite(x).all():
                    raise ValueError("vectors to be written need one size and finite components")
                width, rows = width or next(iter(sizes), None), rows + batch.num_rows
                out.write(x.tobytes())
        if not rows:
            fs.delete_file(hidden)
            return Written([])
        with fs.open_input_stream(hidden) as body, fs.open_output_stream(hidden + "2") as out:  # the header needs the count
            told = f"{{'descr': '<f4', 'fortran_order': False, 'shape': ({rows}, {width}), }}"
            told += " " * (-(10 + len(told) + 1) % 64) + "\n"
            out.write(_MAGIC + b"\x01\x00" + struct.pack("<H", len(told)) + told.encode("latin1"))
            while chunk := body.read(_BATCH_BYTES):
                out.write(chunk)
        fs.delete_file(hidden)
        return Written([(hidden + "2", final)])

    def commit(self, messages: list[Written | None]) -> None:
        fs, _ = _opened(self.path)
        for message in messages:
            for hidden, final in message.files if message else ():
                fs.move(hidden, final)

    def abort(self, messages: list[Written | None]) -> None:
        fs, _ = _opened(self.path)
        for message in messages:
            for hidden, _ in message.files if message else ():
                fs.delete_file(hidden)


class NpySource(DataSource):
    """Options: path; rows in a partition; dimension and expected (rows), which fail where they differ; finite ("true")."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> NpyReader:
        return NpyReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> NpyWriter:
        return NpyWriter(self.options, schema)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session."""
    spark.dataSource.register(NpySource)
