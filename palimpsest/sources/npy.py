"""Arrays in .npy files as a Spark data source that reads row ranges.

An artifact is a folder of .npy files with a manifest that names each file's rows, dtype, shape and the SHA-256 of every
range of `range_rows` rows.  Each range is read, and held against its hash, by a task of its own; nothing reads a file as a
whole.  Writers put files under new names and the manifest last, so an artifact is whole or not there.

Rows are (row long, values array<double or long>).  Defined cases: a folder without manifest, another dtype or shape
than the manifest's, another version of the format and a range whose hash differs are refused; an empty table gives an artifact of
no rows; null or ragged vectors can't be written.
"""

from __future__ import annotations

import hashlib
import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

FORMAT, VERSION = "npy_rows", 1
RANGE_ROWS = 65_536
BATCH_ROWS = 1024


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path.replace("file:", "file://", 1) if path.startswith("file:/") and not path.startswith("file://") else path)


def _header(dtype: np.dtype, rows: int, width: int) -> bytes:
    """The .npy header of a C-ordered matrix; its length does not depend on the number of rows."""
    out = io.BytesIO()
    np.lib.format.write_array_header_1_0(out, {"descr": np.lib.format.dtype_to_descr(dtype), "fortran_order": False, "shape": (rows, width)})
    return out.getvalue()


@dataclass
class Written(WriterCommitMessage):
    partition: int
    files: list[dict]


class Writer(DataSourceArrowWriter):
    """Rows of `values`; a file for each range_rows rows of a task."""

    def __init__(self, options: dict):
        self.path, self.dtype, self.rows = options["path"].rstrip("/"), np.dtype(options.get("dtype", "<f4")), int(options.get("range_rows", RANGE_ROWS))

    def _put(self, partition: int, number: int, rows: np.ndarray) -> dict:
        where, root = _opened(self.path)
        name = f"rows-{partition:06d}-{number:06d}-{uuid.uuid4().hex}.npy"
        where.create_dir(root, recursive=True)
        data = rows.tobytes()
        with where.open_output_stream(f"{root}/{name}") as f:
            f.write(_header(self.dtype, *rows.shape) + data)
        return {"name": name, "rows": len(rows), "width": rows.shape[1], "sha256": hashlib.sha256(data).hexdigest()}

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        partition, files, held, n = TaskContext.get().partitionId(), [], [], 0
        for b in iterator:
            values = b.column(b.schema.get_field_index("values"))
            if values.null_count:
                raise ValueError("null vectors can't be written")
            widths = set(np.diff(values.offsets.to_numpy()).tolist())
            if len(widths) > 1 or held and widths and widths != {held[0].shape[1]}:
                raise ValueError("vectors of an artifact have one length")
            if widths:
                held.append(values.flatten().to_numpy(zero_copy_only=False).astype(self.dtype).reshape(len(values), widths.pop()))
                n += len(values)
            while n >= self.rows:
                rows = np.concatenate(held)
                files.append(self._put(partition, len(files), rows[: self.rows]))
                held, n = [rows[self.rows :]], n - self.rows
        if n:
            files.append(self._put(partition, len(files), np.concatenate(held)))
        return Written(partition, files)

    def commit(self, messages: list) -> None:
        files = [f for m in sorted((m for m in messages if m), key=lambda m: m.partition) for f in m.files]
        if len({f["width"] for f in files}) > 1:
            self.abort(messages)
            raise ValueError("vectors of an artifact have one length")
        where, root = _opened(self.path)
        where.create_dir(root, recursive=True)
        draft = f"{root}/manifest.{uuid.uuid4().hex}"
        with where.open_output_stream(draft) as f:
            f.write(json.dumps({"version": VERSION, "dtype": self.dtype.str, "shape": [sum(x["rows"] for x in files), files[0]["width"] if files else 0], "files": files}).encode())
        where.move(draft, f"{root}/manifest.json")

    def abort(self, messages: list) -> None:
        where, root = _opened(self.path)
        for m in messages:
            for f in m.files if m else []:
                where.delete_file(f"{root}/{f['name']}")


@dataclass
class Range(InputPartition):
    name: str
    first: int
    rows: int
    width: int
    sha256: str


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        where, root = _opened(self.path)
        with where.open_input_stream(f"{root}/manifest.json") as f:
            self.manifest = json.loads(f.read())
        if self.manifest["version"] != VERSION:
            raise ValueError(f"{self.path} has version {self.manifest['version']}, not {VERSION}")
        for name, got in (("dtype", self.manifest["dtype"]), ("rows", str(self.manifest["shape"][0])), ("width", str(self.manifest["shape"][1]))):
            if name in options and options[name] != got:
                raise ValueError(f"{self.path} has {name} {got}, not {options[name]}")

    def partitions(self) -> list[InputPartition]:
        out, at = [], 0
        for f in self.manifest["files"]:
            out.append(Range(f["name"], at, f["rows"], f["width"], f["sha256"]))
            at += f["rows"]
        return out or [Range("", 0, 0, 0, "")]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        where, root = _opened(self.path)
        dtype = np.dtype(self.manifest["dtype"])
        with where.open_input_file(f"{root}/{partition.name}") as f:
            data = f.read()
        head = _header(dtype, partition.rows, partition.width)
        if data[: len(head)] != head:
            raise ValueError(f"{partition.name} is not of the dtype and shape that the manifest says")
        if hashlib.sha256(memoryview(data)[len(head) :]).hexdigest() != partition.sha256:
            raise ValueError(f"{partition.name} does not have the hash that the manifest says")
        rows = np.frombuffer(data, dtype, offset=len(head)).reshape(partition.rows, partition.width)
        kind = np.float64 if dtype.kind == "f" else np.int64
        for at in range(0, partition.rows, BATCH_ROWS):
            some = rows[at : at + BATCH_ROWS].astype(kind)
            offsets = pa.array(np.arange(len(some) + 1) * partition.width, pa.int32())
            values = pa.ListArray.from_arrays(offsets, pa.array(some.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(partition.first + at, partition.first + at + len(some))), values], names=["row", "values"])


class NpyRows(DataSource):
    """`npy_rows`: options path, and dtype, rows, width to hold the artifact against; on writing dtype and range_rows."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        kind = np.dtype(Reader(self.options).manifest["dtype"]).kind
        return f"row long, values array<{'double' if kind == 'f' else 'bigint'}>"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return Reader(self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return Writer(self.options)


def publish(df: DataFrame, order: str, vec: str, path: str, dtype: str = "<f4", range_rows: int = RANGE_ROWS) -> None:
    """Writes the vectors in ascending order of a column: a row's number is its place in that order."""
    df.sparkSession.dataSource.register(NpyRows)
    rows = df.select(order, F.col(vec).cast("array<double>").alias("values")).repartitionByRange(order).sortWithinPartitions(order).select("values")
    rows.write.format(FORMAT).mode("append").option("dtype", dtype).option("range_rows", range_rows).save(path)


def load(spark: SparkSession, path: str, **expected) -> DataFrame:
    """(row, values) of an artifact; expected dtype, rows or width that differ are refused."""
    spark.dataSource.register(NpyRows)
    reader = spark.read.format(FORMAT)
    for name, value in expected.items():
        reader = reader.option(name, str(value))
    return reader.load(path)
