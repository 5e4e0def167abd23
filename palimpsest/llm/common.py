"""What the training-data operators share: shared-folder tables, Arrow passes, file names."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: Documents sent to a Python worker at once, and bytes of them: texts may be long, so batches stay small.
ARROW_ROWS = 512
ARROW_BYTES = 4 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, as in tests, a local one if all runs on one machine."""
    conf = spark.sparkContext.getConf()
    where = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = os.path.join(tempfile.gettempdir(), "palimpsest-shared")
    return where.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts lineage, and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread_join(rows: DataFrame, groups: DataFrame, key: str, size: str, hot: int = 1000) -> DataFrame:
    """rows joined with the stored table groups, one row a key, whose column size counts the key's rows.

    Keys with at least 1 / hot of all rows, and so at most `hot` of them, are broadcast; only the others are shuffled.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    often = F.col(size) * hot >= total
    large = F.broadcast(groups.filter(often))
    rest = rows.join(large.select(key), key, "left_anti").join(groups.filter(~often), key)
    return rows.join(large, key).unionByName(rest)


def fewest(rows: DataFrame, order: list, most: int) -> DataFrame:
    """The `most` rows that come first in order, whose first column is a hash that spreads over all longs.

    Rows whose hash is far from the first ones are dropped before the sort, so a task never gets more than about most rows.
    """
    first = fresh(rows, "fewest_hash")
    hashed = rows.withColumn(first, order[0])
    n = rows.count()
    wanted = 1.2 * most + 1000  # some forty standard deviations more than most
    if n > 2 * wanted:
        hashed = hashed.filter(F.col(first) < int(-(1 << 63) + (1 << 64) * (wanted / n)))
    return hashed.orderBy(first, *order[1:]).limit(most).drop(first)


def fresh(df: DataFrame, name: str) -> str:
    """name, or name with underscores if df has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch of documents can weigh in a Python worker: the session's bounds are lowered, never raised."""
    for name, most in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key).strip().rstrip("bB")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def arrow_pass(
    df: DataFrame,
    columns: Sequence[str],
    keep: Sequence[str],
    fields: Sequence[T.StructField],
    make: Callable[[], Callable[[list[list]], list[list]]],
) -> DataFrame:
    """Map batches in Python workers.

    make() runs once a task and returns fn; fn gets the value lists of `columns` and returns one
    list per field.  The result has the `keep` columns and then the fields; an input column that
    bears the name of a field is dropped in favour of the field.
    """
    names = {f.name for f in fields}
    keep = [c for c in keep if c not in names]
    wanted = list(dict.fromkeys([*keep, *columns]))
    source = df.select(*wanted)
    schema = T.StructType([source.schema[c] for c in keep] + list(fields))
    small_batches(df.sparkSession)
    arrow_types = [_arrow(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for b in batches:
            out = fn([b.column(wanted.index(c)).to_pylist() for c in columns])
            arrays = [b.column(wanted.index(c)) for c in keep]
            arrays += [pa.array(v, type=t) for v, t in zip(out, arrow_types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *(f.name for f in fields)])

    return source.mapInArrow(run, schema)


_STATE: dict = {}


def worker_state(key, build: Callable):
    """What a Python worker keeps between tasks: one thing at a time, so that stages don't add up their caches."""
    if key not in _STATE:
        _STATE.clear()
        _STATE[key] = build()
    return _STATE[key]


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
