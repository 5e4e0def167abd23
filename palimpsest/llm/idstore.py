"""Token ids on disk: a zstandard frame for each document, one shared dictionary, an offset index for direct access.

Writing takes two passes.  The first encodes every text and compresses its id array (16 bits an id where the
vocabulary allows, else 32; little-endian) with a dictionary trained on the serialized arrays of about
`sample_rows` documents.  The second sorts the small frames by id and writes them as files of the data
source `palimpsest_token_ids`; a document's place in the order is then known from the files alone.

A store is a folder:

* `dictionary-<sha256>`: the shared dictionary.  Every file names its hash, and readers refuse another one;
* `ids-<partition>-<number>-<unique>`: header, the frames in ascending order of id, and the index: id (and whether
  it is null), end of the frame, ids before the document.  A trailer says where the index begins;
* `manifest`: the files that count, in order, with their documents and ids, written when all tasks are done.  A task
  that is run again writes files of other names, so lost or doubled tasks leave nothing behind that is read.

Readers take row ranges of files in parallel; filters on doc_id are pushed down and found in the index by bisection,
so a short document costs its own frame and not its neighbours.

Defined cases: a null or empty text is its end token alone; null ids come first; equal ids, also of equal rows, all
stay (their order is that of the rows as stored before the sort), and are cut over files like others; ids are integers, other kinds
are refused; other columns are ignored; an empty table gives a store without files.  With too few or too uniform
arrays to train on, the dictionary is their plain content.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)

from palimpsest.llm.common import arrow_pass, documents, shared_dir, worker_state, written
from palimpsest.llm.packing import END, Ids
from palimpsest.llm.tokens import tokenizer_path

FORMAT = "palimpsest_token_ids"
MAGIC = b"PZIDS\x00\x01\n"
_TRAILER = struct.Struct("<QQQ8s")
LEVEL = 3
DICTIONARY_BYTES = 112 << 10
#: Documents whose ids train the dictionary, pieces taken of one, and bytes of a piece: 2,000 x 4 x 4 KB at most.
SAMPLE_ROWS, PIECES, PIECE_BYTES = 2000, 4, 4096
#: A file is closed at so many bytes of frames or documents; a reading task takes about so many ids.
FILE_BYTES, FILE_DOCUMENTS = 1 << 30, 4_000_000
TASK_IDS = 8_000_000
#: Documents and bytes of a batch that a reader hands to Spark.
BATCH_ROWS, BATCH_BYTES = 1024, 4 << 20

SCHEMA = "doc_id long, start long, n_tokens long, ids binary"


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return pafs.FileSystem.from_uri(path.replace("file:", "file://", 1) if path.startswith("file:/") and not path.startswith("file://") else path)


def _read(path: str) -> bytes:
    where, name = _opened(path)
    with where.open_input_stream(name) as f:
        return f.read()


def _write(path: str, data: bytes) -> None:
    """Whole or not at all: under another name first."""
    where, name = _opened(path)
    where.create_dir(name.rsplit("/", 1)[0], recursive=True)
    draft = f"{name}.{uuid.uuid4().hex}"
    with where.open_output_stream(draft) as f:
        f.write(data)
    where.move(draft, name)


# --- the data source -------------------------------------------------------------------------------------------------


@dataclass
class Written(WriterCommitMessage):
    """A task's files: name, documents, ids, null ids, least and greatest id."""

    partition: int
    files: list[tuple]


class FrameFile:
    """A file that is being written."""

    def __init__(self, folder: str, name: str, header: dict):
        self.where, root = _opened(folder)
        self.name = name
        self.out = self.where.open_output_stream(f"{root}/{name}")
        head = MAGIC + json.dumps(header, sort_keys=True).encode() + b"\n"
        self.out.write(head)
        self.at = len(head)
        self.ids: list[np.ndarray] = []
        self.nulls = 0
        self.ends: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.documents = self.tokens = 0

    def add(self, ids: pa.Array, counts: pa.Array, frames: pa.Array) -> None:
        if not len(ids):
            return
        data = frames.to_pylist()
        self.out.write(b"".join(data))
        ends = np.cumsum([len(x) for x in data]) + self.at
        self.at = int(ends[-1])
        self.nulls += ids.null_count
        self.ids.append(ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
        self.ends.append(ends.astype("<u8"))
        self.counts.append(counts.to_numpy(zero_copy_only=False).astype("<u8"))
        self.documents += len(ids)
        self.tokens += int(self.counts[-1].sum())

    def close(self) -> tuple:
        ids = np.concatenate(self.ids)
        starts = np.cumsum(np.concatenate([[0], *self.counts])).astype("<u8")
        index = ids.tobytes() + np.concatenate(self.ends).tobytes() + starts.tobytes()
        self.out.write(index)
        self.out.write(_TRAILER.pack(self.at, self.documents, self.nulls, MAGIC))
        self.out.close()
        known = ids[self.nulls :]
        return self.name, self.documents, self.tokens, self.nulls, int(known[0]) if len(known) else None, int(known[-1]) if len(known) else None


class Writer(DataSourceArrowWriter):
    """Sorted rows of doc_id, n_tokens and frame; one or more files a task."""

    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.header = {"dictionary": options["dictionary"], "width": int(options["width"])}

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        partition, files, now = TaskContext.get().partitionId(), [], None
        for b in iterator:
            if b.num_rows:
                if now is None:
                    now = FrameFile(self.path, f"ids-{partition:08d}-{len(files):06d}-{uuid.uuid4().hex}", self.header)
                now.add(b.column("doc_id"), b.column("n_tokens"), b.column("frame"))
                if now.at >= FILE_BYTES or now.documents >= FILE_DOCUMENTS:
                    files.append(now.close())
                    now = None
        if now is not None:
            files.append(now.close())
        return Written(partition, files)

    def commit(self, messages: list) -> None:
        files = [f for m in sorted((m for m in messages if m), key=lambda m: m.partition) for f in m.files]
        _write(f"{self.path}/manifest", json.dumps(self.header | {"files": files}).encode())

    def abort(self, messages: list) -> None:
        where, root = _opened(self.path)
        for m in messages:
            for f in m.files if m else []:
                where.delete_file(f"{root}/{f[0]}")


@dataclass
class Rows(InputPartition):
    """Documents lo to hi of a file; base: ids in the files before it."""

    name: str
    base: int
    lo: int
    hi: int


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.least, self.most, self.only = None, None, None

    def _filtered(self) -> bool:
        return not self.least is self.most is self.only is None

    def partitions(self) -> list[Rows]:
        manifest, base, out = json.loads(_read(f"{self.path}/manifest")), 0, []
        for name, n, tokens, _, low, high in manifest["files"]:
            if not self._filtered() or low is not None and self._meets(low, high):
                parts = 1 if self.only is not None else max(1, min(n, -(-tokens // TASK_IDS)))
                out += [Rows(name, base, i * n // parts, (i + 1) * n // parts) for i in range(parts)]
            base += tokens
        return out or [Rows("", 0, 0, 0)]

    def _meets(self, low: int, high: int) -> bool:
        if self.least is not None and high < self.least or self.most is not None and low > self.most:
            return False
        return self.only is None or any(low <= v <= high for v in self.only)

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        where, root = _opened(self.path)
        with where.open_input_file(f"{root}/{partition.name}") as f:
            yield from self._documents(f, partition)

    def _documents(self, f: pa.NativeFile, p: Rows) -> Iterator[pa.RecordBatch]:
        size = f.size()
        index, n, nulls, magic = _TRAILER.unpack(f.read_at(_TRAILER.size, size - _TRAILER.size))
        head = f.read_at(min(4096, size), 0)
        if magic != MAGIC or not head.startswith(MAGIC):
            raise ValueError(f"{p.name} is no file of token ids")
        line = head[len(MAGIC) :].split(b"\n", 1)[0]
        header = json.loads(line)
        undo = worker_state(("zstd", self.path, header["dictionary"]), lambda: _decompressor(self.path, header["dictionary"]))
        kind = f"<u{header['width']}"
        lo, hi = p.lo, p.hi
        ids = np.frombuffer(f.read_at(8 * (hi - lo), index + 8 * lo), "<i8")
        chosen = [(lo, hi)]
        if self._filtered():
            skip = max(0, min(nulls, hi) - lo)  # null ids meet no filter
            known = ids[skip:]
            first = skip + (0 if self.least is None else int(np.searchsorted(known, self.least, "left")))
            end = skip + (len(known) if self.most is None else int(np.searchsorted(known, self.most, "right")))
            chosen = [(lo + first, lo + max(first, end))]
            if self.only is not None:
                a, b = np.searchsorted(known, self.only, "left") + skip, np.searchsorted(known, self.only, "right") + skip
                chosen = [(lo + max(int(x), first), lo + min(int(y), end)) for x, y in zip(a, b, strict=True)]
        begin = len(MAGIC) + len(line) + 1
        for x, y in chosen:
            while x < y:
                z = min(y, x + BATCH_ROWS)
                ends = np.frombuffer(f.read_at(8 * (z - x + 1), index + 8 * (n + x - 1)), "<u8").copy()  # with the end before; of the first document that is the last id
                starts = np.frombuffer(f.read_at(8 * (z - x + 1), index + 16 * n + 8 * x), "<u8")
                if not x:
                    ends[0] = begin
                z = x + max(1, int(np.searchsorted(starts - starts[0], BATCH_BYTES // 4, "right")) - 1) if starts[z - x] - starts[0] > BATCH_BYTES // 4 else z
                k = z - x
                frames = f.read_at(int(ends[k] - ends[0]), int(ends[0]))
                cuts = (ends[: k + 1] - ends[0]).astype(int)
                told = [np.frombuffer(undo.decompress(frames[a:b]), kind).astype("<u4").tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                own = ids[x - lo : z - lo]
                counts = np.diff(starts[: k + 1]).astype("<i8")
                if any(len(t) != 4 * c for t, c in zip(told, counts.tolist(), strict=True)):
                    raise ValueError(f"{p.name} holds frames that don't fit its index")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own, mask=np.arange(x, z) < nulls), pa.array(starts[:k].astype("<i8") + p.base), pa.array(counts), pa.array(told, pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )
                x = z


class FilteredReader(Reader):
    """Takes filters on doc_id; Spark refuses such a reader where filter push-down is off."""

    def pushFilters(self, filters):
        for f in filters:
            value = getattr(f, "value", None)
            whole = isinstance(value, int) and not isinstance(value, bool)
            if f.attribute != ("doc_id",):
                yield f
            elif isinstance(f, EqualTo) and whole:
                self._narrow([value])
            elif isinstance(f, In):
                self._narrow([v for v in f.value if v is not None])
            elif isinstance(f, GreaterThan | GreaterThanOrEqual) and whole:
                bound = value + isinstance(f, GreaterThan)
                self.least = bound if self.least is None else max(self.least, bound)
            elif isinstance(f, LessThan | LessThanOrEqual) and whole:
                bound = value - isinstance(f, LessThan)
                self.most = bound if self.most is None else min(self.most, bound)
            else:
                yield f

    def _narrow(self, wanted: list) -> None:
        self.only = sorted(set(wanted) & set(self.only) if self.only is not None else set(wanted))


def _decompressor(path: str, sha256: str) -> zstandard.ZstdDecompressor:
    data = _read(f"{path}/dictionary-{sha256}")
    if hashlib.sha256(data).hexdigest() != sha256:
        raise ValueError(f"the dictionary of {path} is not the one its files name")
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data))


class TokenIds(DataSource):
    """`palimpsest_token_ids`: doc_id, start (ids of the documents before), n_tokens, ids (little-endian 32-bit)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return (FilteredReader if self.options.get("push") == "true" else Reader)(self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return Writer(self.options)


# --- writing and reading a table -------------------------------------------------------------------------------------


def trained(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary of at most size bytes; plain content where there is too little to train on."""
    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, samples)) // 8)), samples, k=512, d=8).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:] or bytes(8)


def _sampled(df: DataFrame, path: str, text_col: str, width: int, sample_rows: int) -> list[bytes]:
    """Serialized ids of about sample_rows documents drawn from the whole table: of each, up to PIECES pieces spread over it."""

    def make():
        ids = Ids(path, room=50_000)

        def pieces(text: str | None) -> list[bytes]:
            data = np.frombuffer(ids.of(text), "<u4").astype(f"<u{width}").tobytes()
            starts = range(0, len(data), PIECE_BYTES)
            return [data[starts[i * len(starts) // PIECES] :][:PIECE_BYTES] for i in range(PIECES)] if len(starts) > PIECES else [data[s : s + PIECE_BYTES] for s in starts]

        return lambda columns: [[pieces(t) for t in columns[0]]]

    share = min(1.0, sample_rows / max(1, df.count()))
    drawn = df.select(F.col(text_col).cast("string").alias("ids_text")).sample(share, seed=42)
    rows = arrow_pass(drawn, ["ids_text"], [], [T.StructField("pieces", T.ArrayType(T.BinaryType()))], make).collect()
    return sorted(bytes(p) for r in rows for p in r.pieces)


def write_ids(
    df: DataFrame, where: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
    level: int = LEVEL, dictionary_bytes: int = DICTIONARY_BYTES, sample_rows: int = SAMPLE_ROWS, end_id: int = END,
) -> None:
    """Write the token ids of df's texts, end_id after each, to the folder `where`, which executors share."""
    if not isinstance(df.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} must be an integer")
    spark = df.sparkSession
    spark.dataSource.register(TokenIds)
    library = Ids(tokenizer).library
    width = 2 if max(library.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    data = trained(_sampled(df, tokenizer, text_col, width, sample_rows), dictionary_bytes)
    sha256 = hashlib.sha256(data).hexdigest()
    _write(f"{where}/dictionary-{sha256}", data)
    shared = spark.sparkContext.broadcast(data)  # dictionary_bytes at most
    end = np.array([end_id], "<u4").tobytes()

    def make():
        def state():
            known = zstandard.ZstdCompressionDict(shared.value)
            known.precompute_compress(level=level)
            return Ids(tokenizer), zstandard.ZstdCompressor(level=level, dict_data=known, write_checksum=True)

        ids, squeeze = worker_state(("idstore", tokenizer, sha256, level), state)

        def fn(columns):
            arrays = [np.frombuffer(t + end, "<u4") for t in ids.batch(columns[0])]
            return [[len(a) for a in arrays], [squeeze.compress(a.astype(f"<u{width}").tobytes()) for a in arrays]]

        return fn

    narrow = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("ids_text"))
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("frame", T.BinaryType())]
    frames = written(arrow_pass(narrow, ["ids_text"], ["doc_id"], fields, make).withColumn("uid", F.monotonically_increasing_id()), "token-frames")
    # uid parts equal ids, so no id fills a file; it is stored, so every attempt sees the same order.
    order = ["doc_id", "uid"]
    ordered = frames.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "n_tokens", "frame")
    ordered.write.format(FORMAT).mode("append").option("dictionary", sha256).option("width", width).save(where)


def read_ids(spark: SparkSession, where: str) -> DataFrame:
    """doc_id, start, n_tokens and ids of a store.  Filters on doc_id are pushed down if spark.sql.python.filterPushdown.enabled is true by now."""
    spark.dataSource.register(TokenIds)
    push = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format(FORMAT).option("push", push).load(where)


def op11_token_id_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/token-ids-{uuid.uuid4().hex}"
    write_ids(documents(spark, sf_dir), where, tokenizer_path("word_bpe_49k.json"))
    return read_ids(spark, where).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
