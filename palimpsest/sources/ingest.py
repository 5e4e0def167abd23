"""Sources and sinks: nested dialogues, JSON Lines, upserts by content hash, histories, snapshots, vector tables."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Dialogue files: sessions with role-tagged messages; noise by which of two keys is there.
DIALOGUES = (
    "sessions ARRAY<STRUCT<session_id BIGINT, persona_id BIGINT, event_id STRING, turn_count INT, status STRING, "
    "messages ARRAY<STRUCT<role STRING, content STRING>>, event_info STRUCT<date STRING>, knowledge_points ARRAY<STRING>, "
    "noise_id STRING, noise_family_id STRING, family_role STRUCT<name STRING, relationship STRING>>>"
)
SPEAKERS = {"user": "Patient", "assistant": "Doctor"}


def read_json(spark: SparkSession, path: str, schema: T.StructType | str, lines: bool = True) -> DataFrame:
    """JSON, or JSON Lines, with a fixed schema; odd fields become null."""
    return spark.read.schema(schema).option("multiLine", not lines).option("mode", "PERMISSIVE").json(path)


def persona_of(path: Column) -> Column:
    return F.regexp_extract(path, r"persona_(\d+)", 1).try_cast("long")


def first_personas(df: DataFrame, persona: str, ids: Sequence[int] | None, at_most: int | None) -> DataFrame:
    """Rows of the wanted personas, then of the first at_most of them in numeric order."""
    if ids is not None:
        df = df.filter(F.col(persona).isin(list(ids)))
    if at_most is not None:
        chosen = df.select(persona).distinct().orderBy(persona).limit(at_most)
        df = df.join(F.broadcast(chosen) if at_most <= 10_000 else chosen, persona, "left_semi")
    return df


def noise_kind(noise_id: Column, family_id: Column) -> Column:
    """family wins over knowledge; neither: clean."""
    return F.when(family_id.isNotNull(), "family").when(noise_id.isNotNull(), "knowledge").otherwise("clean")


def dialogue_text(messages: Column, speakers: Mapping[str, str] = SPEAKERS) -> Column:
    """role/content messages in order as "Speaker: text", other roles dropped, a blank line between."""
    kept = F.filter(messages, lambda m: m["role"].isin(*speakers))
    name = lambda role: F.element_at(F.create_map(*[F.lit(x) for kv in speakers.items() for x in kv]), role)
    return F.array_join(F.transform(kept, lambda m: F.concat(name(m["role"]), F.lit(": "), m["content"])), "\n\n")


def sessions_of(turns: DataFrame, by: str, turn: str, role: str, text: str) -> DataFrame:
    """One row a conversation: its messages in turn order."""
    message = F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("content"))
    return turns.groupBy(by).agg(F.array_sort(F.collect_list(message)).alias("messages"))


def dynamic_sessions(raw: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """Rows (id, n, turns, date) of the keys session_<n> and session_<n>_date_time of a JSON object, by number."""
    whole = F.from_json(json_col, "map<string,string>")
    pairs = raw.select(id_col, whole.alias("m"), F.explode(whole).alias("key", "turns"))
    n = F.regexp_extract("key", r"^session_(\d+)$", 1)
    return pairs.filter(n != "").select(id_col, n.cast("int").alias("n"), "turns", F.element_at("m", F.concat("key", F.lit("_date_time"))).alias("date"))


def parse_questions(df: DataFrame, keep: Sequence[int] | None = None, no_answer: str = "No information available") -> DataFrame:
    """category, answer, evidence: category 5 gets the fixed answer, a scalar evidence becomes an array."""
    if keep is not None:
        df = df.filter(F.col("category").isin(list(keep)))
    df = df.withColumn("answer", F.when(F.col("category") == 5, F.lit(no_answer)).otherwise(F.col("answer").cast("string")))
    if not isinstance(df.schema["evidence"].dataType, T.ArrayType):
        df = df.withColumn("evidence", F.when(F.col("evidence").isNull(), F.array().cast("array<string>")).otherwise(F.array(F.col("evidence").cast("string"))))
    return df


def content_id(text: Column, prefix: str = "chunk-") -> Column:
    return F.concat(F.lit(prefix), F.md5(text))


def missing(new: DataFrame, store: DataFrame, key: str = "hash_id") -> DataFrame:
    """Rows of new whose key the store lacks."""
    return new.join(store.select(key), key, "left_anti")


def upsert_new(store: DataFrame, new: DataFrame, key: str = "hash_id") -> DataFrame:
    """The store with new rows appended, each key once; existing rows stay."""
    return store.unionByName(missing(new.dropDuplicates([key]), store, key))


def upsert_nodes(store: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by id: memory, properties and updated_at are replaced, created_at and user_name keep the first
    value, the embedding is replaced only by another one."""
    old = store.alias("o")
    both = old.join(new.alias("n"), F.col("o.id") == F.col("n.id"), "full_outer")
    hit, fresh = F.col("n.id").isNotNull(), F.col("o.id").isNull()
    take = lambda c: F.when(hit, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    first = lambda c: F.when(fresh, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    return both.select(
        F.coalesce("o.id", "n.id").alias("id"), take("memory"), take("properties"), F.coalesce("n.embedding", "o.embedding").alias("embedding"),
        first("user_name"), first("created_at"), take("updated_at"),
    )


def delete_ids(store: DataFrame, ids: DataFrame, key: str = "hash_id") -> DataFrame:
    return store.join(ids.select(key), key, "left_anti")


def scroll(df: DataFrame, keep: Column, key: str, limit: int, offset: int = 0) -> DataFrame:
    return df.filter(keep).orderBy(key).offset(offset).limit(limit)


def graph_export(nodes: DataFrame, edges: DataFrame, user: Column) -> tuple[DataFrame, DataFrame]:
    """A user's nodes, newest first, and the edges that touch any of them at either end."""
    own = nodes.filter(user)
    ids = own.select("id")
    touch = [edges.join(ids.withColumnRenamed("id", end), end, "left_semi") for end in ("source_id", "target_id")]
    return own.orderBy(F.desc("created_at"), "id"), touch[0].unionByName(touch[1]).distinct()


HISTORY = "memory_id STRING, old_memory STRING, new_memory STRING, event STRING, created_at TIMESTAMP, updated_at TIMESTAMP, is_deleted BOOLEAN"


def add_history(history: DataFrame, changes: DataFrame) -> DataFrame:
    """Append-only: changes are added, nothing is rewritten."""
    return history.unionByName(changes, allowMissingColumns=True)


def history_of(history: DataFrame, memory_id, order: Sequence[str] = ("updated_at",)) -> DataFrame:
    return history.filter(F.col("memory_id") == memory_id).orderBy(*order)


def interleave_noise(original: DataFrame, noise: DataFrame, seed: int = 42, order: str = "ix") -> DataFrame:
    """Original rows in their order with noise rows put at places drawn by a seeded hash; a new position from 0.

    A noise row goes before the original row with its place's number.
    """
    n = original.agg((F.count("*") + 1).alias("n_places"))
    placed = noise.crossJoin(F.broadcast(n)).withColumn("place", F.pmod(F.xxhash64(order, F.lit(seed)), F.col("n_places"))).drop("n_places")
    both = original.withColumn("place", F.col(order).cast("long")).withColumn("is_noise", F.lit(False)).unionByName(placed.withColumn("is_noise", F.lit(True)))
    from palimpsest.operators.ranking import running

    numbered = running(both.withColumn("kept_back", ~F.col("is_noise")), ["place", "kept_back", order], F.lit(1).cast("long"), "position")
    return numbered.withColumn("position", F.col("position") - 1).drop("kept_back")


def nested(parents: DataFrame, children: DataFrame, key: str, child_order: Sequence[str], name: str = "items") -> DataFrame:
    """Parents with their children as an array of structs, for JSON export."""
    rows = F.struct(*child_order, *[c for c in children.columns if c not in (key, *child_order)])
    return parents.join(children.groupBy(key).agg(F.array_sort(F.collect_list(rows)).alias(name)), key, "left")


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete folders path/v<n>, ascending; on any file system that Spark reads."""
    jvm = spark.sparkContext._jvm
    marks = jvm.org.apache.hadoop.fs.Path(f"{path}/v*/_SUCCESS")
    found = marks.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(marks) or []
    names = [f.getPath().getParent().getName()[1:] for f in found]
    return sorted(int(n) for n in names if n.isdigit())


def _remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _newest(spark: SparkSession, path: str) -> int:
    return max(_versions(spark, path), default=0)


def save_snapshot(tables: Mapping[str, DataFrame], path: str, version: int) -> None:
    """A Parquet set with its schema version, beside older ones; it counts from when its manifest is complete, so a crash leaves the last one."""
    spark = next(iter(tables.values())).sparkSession
    data = f"data-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{path}/{data}/{name}")
    rows = [(name, version, df.schema.json(), data) for name, df in tables.items()]
    manifest = spark.createDataFrame(rows, "name STRING, version INT, schema STRING, data STRING")
    manifest.coalesce(1).write.parquet(f"{path}/_manifest/v{_newest(spark, f'{path}/_manifest') + 1}")


def load_snapshot(spark: SparkSession, path: str, versions: Sequence[int]) -> dict[str, DataFrame]:
    """The tables of the newest snapshot; an unknown schema version is refused."""
    out = {}
    for r in spark.read.parquet(f"{path}/_manifest/v{_newest(spark, f'{path}/_manifest')}").collect():
        if r["version"] not in versions:
            raise ValueError(f"snapshot version {r['version']} of {r['name']}; known: {list(versions)}")
        out[r["name"]] = spark.read.schema(T.StructType.fromJson(json.loads(r["schema"]))).parquet(f"{path}/{r['data']}/{r['name']}")
    return out


def checksum(df: DataFrame) -> DataFrame:
    """Rows, and an order-free checksum of them; equal tables agree."""
    whole = F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256)
    return df.agg(F.count("*").alias("n"), F.sum(F.conv(F.substring(whole, 1, 12), 16, 10).cast("decimal(38,0)")).alias("checksum"))


def publish_vectors(df: DataFrame, path: str) -> None:
    """A vector artifact with its row count, checksum and schema beside it; older ones count until the new manifest is complete."""
    spark = df.sparkSession
    n = max(_newest(spark, f"{path}/vectors"), _newest(spark, f"{path}/manifest")) + 1
    df.write.parquet(f"{path}/vectors/v{n}")
    stored = spark.read.parquet(f"{path}/vectors/v{n}")
    checksum(stored).withColumn("schema", F.lit(stored.schema.json())).coalesce(1).write.parquet(f"{path}/manifest/v{n}")


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    """The newest artifact, refused if rows or schema differ from its manifest."""
    n = _newest(spark, f"{path}/manifest")
    df, want = spark.read.parquet(f"{path}/vectors/v{n}"), spark.read.parquet(f"{path}/manifest/v{n}").first()
    got = checksum(df).first()
    if (got["n"], got["checksum"], df.schema.json()) != (want["n"], want["checksum"], want["schema"]):
        raise ValueError(f"{path} does not match its manifest")
    return df


def write_report(summary: DataFrame, failures: DataFrame, answers: DataFrame, path: str) -> None:
    """JSON Lines, a folder for each part."""
    for name, df in (("summary", summary), ("failures", failures), ("answers", answers)):
        df.write.mode("overwrite").json(f"{path}/{name}")


class VectorTable:
    """A named collection of (id, vector, payload) kept as Parquet; changes are new versions, never rewrites in place."""

    COLUMNS = ("id", "vector", "payload")
    SCHEMA = "id STRING, vector ARRAY<DOUBLE>, payload STRING"

    def __init__(self, spark: SparkSession, root: str, name: str):
        self.spark, self.root, self.name = spark, root.rstrip("/"), name
        self._version = _newest(spark, self._path())
        self._rows = spark.read.schema(self.SCHEMA).parquet(self._path(self._version)) if self._version else spark.createDataFrame([], self.SCHEMA)

    def _path(self, version: int | None = None) -> str:
        return f"{self.root}/{self.name}" + ("" if version is None else f"/v{version}")

    @staticmethod
    def collections(spark: SparkSession, root: str) -> list[str]:
        """Names of the collections under root that hold a version."""
        marks = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/*/v*/_SUCCESS")
        found = marks.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(marks) or []
        return sorted({f.getPath().getParent().getParent().getName() for f in found})

    def drop(self) -> None:
        """Delete the collection with all its versions."""
        _remove(self.spark, self._path())
        self._rows, self._version = self.spark.createDataFrame([], self.SCHEMA), 0

    @property
    def rows(self) -> DataFrame:
        return self._rows

    def _keep(self, df: DataFrame) -> None:
        """A version beside the others, of the next number that no folder has: one that another writer made is never overwritten."""
        path = self._path(max(self._version, _newest(self.spark, self._path())) + 1)
        df.select(*self.COLUMNS).write.parquet(path)
        self._version = int(path.rsplit("/v", 1)[1])
        self._rows = self.spark.read.schema(self.SCHEMA).parquet(path)

    def insert(self, new: DataFrame) -> None:
        """New ids, or other rows for known ones; of several rows of an id the one with the least payload counts."""
        new = new.groupBy("id").agg(F.min(F.struct("payload", "vector")).alias("_r")).select("id", "_r.*")
        self._keep(self._rows.join(new.select("id"), "id", "left_anti").select(*self.COLUMNS).unionByName(new.select(*self.COLUMNS)))

    def update(self, changed: DataFrame) -> None:
        """Vector and payload of known ids; a null keeps what was."""
        old, new = self._rows.alias("o"), changed.alias("n")
        self._keep(old.join(new, "id", "left").select("id", F.coalesce("n.vector", "o.vector").alias("vector"), F.coalesce("n.payload", "o.payload").alias("payload")))

    def delete(self, ids: DataFrame) -> None:
        self._keep(self._rows.join(ids.select("id"), "id", "left_anti"))

    def get(self, vector_id: str) -> DataFrame:
        return self._rows.filter(F.col("id") == vector_id)

    def list(self, keep: Column | None = None, limit: int = 100) -> DataFrame:
        return (self._rows if keep is None else self._rows.filter(keep)).orderBy("id").limit(limit)

    def search(self, query: Sequence[float], k: int = 5, keep: Column | None = None) -> DataFrame:
        from palimpsest.functions.vectors import cosine

        rows = self._rows if keep is None else self._rows.filter(keep)
        score = cosine(F.col("vector"), F.array(*[F.lit(float(x)) for x in query]))
        return rows.withColumn("score", score).orderBy(F.desc("score"), "id").limit(k)

    def info(self) -> DataFrame:
        return self._rows.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dims"))
