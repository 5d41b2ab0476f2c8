"""Fixed-width float bundles as a Spark data source: vectors by key, in files that are read by seeking.

A record is a key (8 bytes), a vector and further numbers (4 bytes each, little-endian); all records of a bundle have one size, so any range of rows is
one range of bytes. A manifest names the files that count. Tasks write under names of their own in a temporary folder; the commit moves what they
wrote, and then replaces the manifest by one rename, so readers see the bundle before or after a write and never part of it. A failed write takes its folder
away (a store without folders may keep a late task's file, which no manifest names).

    register(spark)
    df.write.format("floatbundle").mode("overwrite").save(path)      # (key long, vector array<float>, further float columns)
    spark.read.format("floatbundle").load(path)
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegralType, LongType, StructField, StructType

MANIFEST = "manifest.json"
#: Records that a partition reads, and those of a batch.
SPLIT, BATCH = 1 << 20, 1 << 13


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it; a plain path is the local one."""
    for scheme in ("s3a://", "s3n://"):
        path = path.replace(scheme, "s3://", 1) if path.startswith(scheme) else path
    if path.startswith("file:/"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return (fs.LocalFileSystem(), path.rstrip("/")) if path.startswith("/") else fs.FileSystem.from_uri(path.rstrip("/"))


def _manifest(path: str) -> dict | None:
    store, root = _store(path)
    name = f"{root}/{MANIFEST}"
    if store.get_file_info(name).type != fs.FileType.File:
        return None
    with store.open_input_stream(name) as stream:
        return json.loads(stream.read())


def _record(width: int, further: list[str]) -> np.dtype:
    return np.dtype([("key", "<i8"), ("vector", "<f4", (width,)), *((f"n{k}", "<f4") for k in range(len(further)))])


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: nothing where it had no rows."""

    name: str
    rows: int
    width: int


class FloatBundle(DataSource):
    """Options: ``path``. Writing takes (integral key, array of float or double, further float or double columns), none of them null."""

    @classmethod
    def name(cls) -> str:
        return "floatbundle"

    def schema(self) -> StructType:
        found = _manifest(self.options["path"])
        if found is None:
            raise FileNotFoundError(f"no bundle in {self.options['path']}")
        return StructType([StructField(found["key"], LongType()), StructField(found["vector"], ArrayType(FloatType())), *(StructField(c, FloatType()) for c in found["further"])])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        kinds = [f.dataType for f in schema.fields]
        ok = len(kinds) >= 2 and isinstance(kinds[0], IntegralType) and isinstance(kinds[1], ArrayType) and all(isinstance(k, (FloatType, DoubleType)) for k in (kinds[1].elementType, *kinds[2:]))
        if not ok:
            raise ValueError(f"a bundle takes an integral key, an array of numbers and further float columns, not {schema.simpleString()}")
        return _Writer(self.options["path"], schema.names, overwrite)


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, names: list[str], overwrite: bool):
        self.path, self.names, self.overwrite, self.run = path, names, overwrite, uuid.uuid4().hex
        _store(path)[0].create_dir(self._folder(), recursive=True)  # by the driver alone: a task that is still at work after the write failed finds it gone

    def _folder(self) -> str:
        return f"{_store(self.path)[1]}/_temporary-{self.run}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, _ = _store(self.path)
        name, rows, width, stream = f"part-{uuid.uuid4().hex}.bundle", 0, 0, None
        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                if any(c.null_count for c in batch.columns) or batch.column(1).flatten().null_count:
                    raise ValueError("a bundle has no nulls")
                sizes = np.unique(pa.compute.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False))
                if len(sizes) != 1 or rows and sizes[0] != width:
                    raise ValueError(f"vectors of {sorted({*sizes.tolist(), *([width] if rows else [])})} numbers don't make a bundle")
                if stream is None:
                    width = int(sizes[0])
                    stream = store.open_output_stream(f"{self._folder()}/{name}")
                records = np.zeros(batch.num_rows, _record(width, self.names[2:]))
                records["key"] = batch.column(0).to_numpy(zero_copy_only=False)
                records["vector"] = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                for k in range(len(self.names) - 2):
                    records[f"n{k}"] = batch.column(k + 2).to_numpy(zero_copy_only=False)
                stream.write(records.tobytes())
                rows += batch.num_rows
        finally:
            if stream is not None:
                stream.close()
        return Written(name if rows else "", rows, width)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = _store(self.path)
        parts = [m for m in messages if m is not None and m.rows]
        before = _manifest(self.path)
        kept = [] if before is None or self.overwrite else before["files"]
        widths = {m.width for m in parts} | ({before["width"]} if kept else set())
        names = {"key": self.names[0], "vector": self.names[1], "further": self.names[2:]}
        try:
            if len(widths) > 1:
                raise ValueError(f"vectors of {sorted(widths)} numbers don't make a bundle")
            if kept and names != {k: before[k] for k in names}:
                raise ValueError(f"the bundle has other columns: {before}")
            store.create_dir(root, recursive=True)
            for m in parts:
                store.move(f"{self._folder()}/{m.name}", f"{root}/{m.name}")
            new = f"{root}/_{MANIFEST}-{self.run}"
            with store.open_output_stream(new) as stream:
                stream.write(json.dumps({**names, "width": max(widths, default=0), "files": [*kept, *({"name": m.name, "rows": m.rows} for m in parts)]}).encode())
            store.move(new, f"{root}/{MANIFEST}")
        finally:
            self.abort(messages)
        for file in before["files"] if before and self.overwrite else []:
            store.delete_file(f"{root}/{file['name']}")

    def abort(self, messages: list[Written | None]) -> None:
        store, _ = _store(self.path)
        if store.get_file_info(self._folder()).type == fs.FileType.Directory:
            store.delete_dir(self._folder())


@dataclass
class _Range(InputPartition):
    """Records [start, stop) of a file."""

    file: str
    start: int
    stop: int


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path
        self.found = _manifest(path)

    def partitions(self) -> list[_Range]:
        return [_Range(f["name"], a, min(a + SPLIT, f["rows"])) for f in self.found["files"] for a in range(0, f["rows"], SPLIT)] or [_Range("", 0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        store, root = _store(self.path)
        kind, names = _record(self.found["width"], self.found["further"]), [self.found["key"], self.found["vector"], *self.found["further"]]
        if partition.start >= partition.stop:
            return
        with store.open_input_file(f"{root}/{partition.file}") as file:
            for a in range(partition.start, partition.stop, BATCH):
                n = min(BATCH, partition.stop - a)
                records = np.frombuffer(file.read_at(n * kind.itemsize, a * kind.itemsize), kind)
                offsets = pa.array(np.arange(n + 1, dtype=np.int32) * self.found["width"])
                vectors = pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(records["vector"]).reshape(-1)))
                further = [pa.array(np.ascontiguousarray(records[f"n{k}"])) for k in range(len(names) - 2)]
                yield pa.record_batch([pa.array(np.ascontiguousarray(records["key"])), vectors, *further], names=names)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FloatBundle)
