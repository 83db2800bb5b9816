"""Headerless little-endian integer files: a splittable reader, whole-file bytes, a piece view, and a blob sink."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from tallow.schema import GROUP

WIDTH = {"uint8": 1, "uint16": 2, "uint32": 4}
SPLIT_GROUPS = 16384  # groups per split: 16 MB of 16-bit values


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class _Range(InputPartition):
    def __init__(self, path: str, start: int, count: int):
        self.path, self.start, self.count = path, start, count


class _RawReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.width = options["path"], WIDTH[options.get("dtype", "uint16")]
        self.dtype, self.split = f"<u{self.width}", int(options.get("splitGroups", SPLIT_GROUPS)) * GROUP
        self.suffix = options.get("suffix", "")

    def partitions(self) -> list[_Range]:
        store, root = _open(self.path)
        info = store.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info] if info.is_file else sorted((x for x in store.get_file_info(fs.FileSelector(root, recursive=True)) if x.is_file and x.path.endswith(self.suffix)), key=lambda x: x.path)
        scheme = self.path.split("://")[0] + "://" if "://" in self.path else ""
        out = []
        for x in files:
            n = x.size // self.width  # an odd byte at the end is not an element
            out += [_Range(scheme + x.path, i, min(self.split, n - i)) for i in range(0, n, self.split)]
        return out

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        store, path = _open(part.path)
        with store.open_input_file(path) as f:
            for i in range(part.start, part.start + part.count, GROUP * 128):
                n = min(GROUP * 128, part.start + part.count - i)
                val = np.frombuffer(f.read_at(n * self.width, i * self.width), self.dtype).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([part.path] * n), pa.array(np.arange(i, i + n)), pa.array(val)], ["path", "pos", "val"])


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # where it lies, and its name


class _BlobWriter(DataSourceWriter):
    """Each task writes under names of its own; the files get theirs when all tasks are done, so a task that fails or runs
    twice leaves nothing under a final name."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]

    def write(self, rows) -> _Written:
        store, root = _open(self.path)
        aside, files = f"{root.rstrip('/')}/_temporary/{uuid.uuid4().hex}", []
        store.create_dir(aside)
        for i, row in enumerate(rows):
            name = str(row["name"])
            if name.startswith("/") or ".." in name.split("/"):
                raise ValueError(f"not a name within the folder: {name!r}")
            with store.open_output_stream(f"{aside}/{i}") as out:
                out.write(bytes(row["content"]))
            files.append((f"{aside}/{i}", name))
        return _Written(files)

    def commit(self, messages) -> None:
        store, root = _open(self.path)
        root = root.rstrip("/")
        for aside, name in (f for m in messages if m for f in m.files):
            store.create_dir(f"{root}/{name}".rpartition("/")[0])
            store.move(aside, f"{root}/{name}")
        self._clean()

    def abort(self, messages) -> None:
        self._clean()

    def _clean(self) -> None:
        store, root = _open(self.path)
        if store.get_file_info(f"{root.rstrip('/')}/_temporary").type == fs.FileType.Directory:
            store.delete_dir(f"{root.rstrip('/')}/_temporary")


class RawIntegers(DataSource):
    """format("raw_integers"): options path, dtype (uint8, uint16, uint32), suffix, splitGroups; rows (path, pos, val).

    Writing takes rows (name, content) and makes one file each, replacing what has that name; a name may have folders.
    """

    @classmethod
    def name(cls) -> str:
        return "raw_integers"

    def schema(self) -> str:
        return "path string, pos bigint, val bigint"

    def reader(self, schema) -> _RawReader:
        return _RawReader(self.options)

    def writer(self, schema, overwrite: bool) -> _BlobWriter:
        return _BlobWriter(self.options)


def read_integers(spark: SparkSession, path: str, dtype: str = "uint16", suffix: str = "", split_groups: int = SPLIT_GROUPS) -> DataFrame:
    spark.dataSource.register(RawIntegers)
    return spark.read.format("raw_integers").option("path", path).option("dtype", dtype).option("suffix", suffix).option("splitGroups", split_groups).load()


def read_bytes(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(path, length, content): one whole file per row, through Spark's own file systems. A file without bytes has no row."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    reader = reader.option("pathGlobFilter", pattern) if pattern else reader
    return reader.load(path).select("path", "length", "content")


def split_pieces(files: DataFrame, size: int, limit: int = 10) -> DataFrame:
    """(path, piece, content): the first pieces of so many bytes; a file smaller than the size has none."""
    count = f"least({limit}L, (length(content) + {size - 1}) div {size})"
    rows = files.where(f"length(content) >= {size}").selectExpr("path", "content", f"explode(sequence(0L, {count} - 1)) AS piece")
    return rows.select("path", "piece", F.expr(f"substring(content, CAST(piece * {size} + 1 AS INT), {size})").alias("content"))


def write_blobs(rows: DataFrame, path: str) -> None:
    """(name, content) -> files."""
    rows.sparkSession.dataSource.register(RawIntegers)
    rows.select("name", "content").write.format("raw_integers").option("path", path).mode("append").save()
