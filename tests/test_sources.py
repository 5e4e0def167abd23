"""Round trips of files, snapshots, histories and vector tables."""

import json

import pytest
from pyspark.sql import functions as F

from palimpsest.sources import ingest


def test_dialogue_files(spark, tmp_path):
    folder = tmp_path / "persona_7" / "eval"
    folder.mkdir(parents=True)
    (folder / "d.json").write_text(json.dumps({"sessions": [{"session_id": 1, "messages": [{"role": "user", "content": "a"}, {"role": "tool", "content": "x"}, {"role": "assistant", "content": "b"}]}, {"session_id": 2, "noise_id": "n", "noise_family_id": "f"}]}))
    df = ingest.read_json(spark, str(folder / "d.json"), ingest.DIALOGUES, lines=False).withColumn("persona", ingest.persona_of(F.input_file_name()))
    rows = df.select("persona", F.explode("sessions").alias("s")).select("persona", "s.session_id", ingest.noise_kind(F.col("s.noise_id"), F.col("s.noise_family_id")).alias("kind"), ingest.dialogue_text(F.col("s.messages")).alias("t")).collect()
    assert [(r.persona, r.session_id, r.kind) for r in rows] == [(7, 1, "clean"), (7, 2, "family")]
    assert rows[0].t == "Patient: a\n\nDoctor: b"


def test_snapshot_and_version_gate(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a"], {"k": "v"})], "id long, tags array<string>, q map<string,string>")
    ingest.save_snapshot({"claims": df}, str(tmp_path), 2)
    assert ingest.load_snapshot(spark, str(tmp_path), [2])["claims"].collect() == df.collect()
    with pytest.raises(ValueError):
        ingest.load_snapshot(spark, str(tmp_path), [1])


def test_vector_artifact_is_checked(spark, tmp_path):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "id string, vector array<double>")
    ingest.publish_vectors(df, str(tmp_path))
    assert ingest.load_vectors(spark, str(tmp_path)).count() == 2
    df.limit(1).write.mode("overwrite").parquet(f"{tmp_path}/vectors/v1")
    with pytest.raises(ValueError):
        ingest.load_vectors(spark, str(tmp_path))


def test_vector_table(spark, tmp_path):
    t = ingest.VectorTable(spark, str(tmp_path), "c")
    rows = spark.createDataFrame([("a", [1.0, 0.0], "x"), ("b", [0.0, 1.0], "y")], ingest.VectorTable.SCHEMA)
    t.insert(rows)
    t.insert(rows)
    assert t.info().first()["n"] == 2
    assert t.search([0.0, 2.0], 1).first()["id"] == "b"
    t.update(spark.createDataFrame([("a", None, "z")], ingest.VectorTable.SCHEMA))
    assert t.get("a").first()["payload"] == "z" and t.get("a").first()["vector"] == [1.0, 0.0]
    t.delete(spark.createDataFrame([("b",)], "id string"))
    assert [r.id for r in t.list().collect()] == ["a"]
    again = ingest.VectorTable(spark, str(tmp_path), "c")
    assert [r.id for r in again.list().collect()] == ["a"]
    again.insert(rows.unionByName(rows))
    assert again.info().first()["n"] == 2 and ingest.VectorTable.collections(spark, str(tmp_path)) == ["c"]
    t.delete(rows.select("id"))  # of an older state: a version of its own
    assert again.rows.count() == 2 and ingest.VectorTable(spark, str(tmp_path), "c").rows.count() == 0
    again.drop()
    assert ingest.VectorTable.collections(spark, str(tmp_path)) == [] and ingest.VectorTable(spark, str(tmp_path), "c").rows.count() == 0


def test_snapshots_stand_beside_each_other(spark, tmp_path):
    for n in (1, 2):
        ingest.save_snapshot({"claims": spark.range(n)}, str(tmp_path), 2)
        ingest.publish_vectors(spark.range(n), f"{tmp_path}/vectors")
    spark.range(9).write.parquet(f"{tmp_path}/data-of-a-crash/claims")
    assert ingest.load_snapshot(spark, str(tmp_path), [2])["claims"].count() == 2 and ingest.load_vectors(spark, f"{tmp_path}/vectors").count() == 2


def test_upsert_keeps_first_owner_and_known_embedding(spark):
    schema = "id int, memory string, properties string, embedding array<double>, user_name string, created_at int, updated_at int"
    old = spark.createDataFrame([(1, "m", "{}", [1.0], "u", 1, 1)], schema)
    new = spark.createDataFrame([(1, "n", "{}", None, "v", 2, 2)], schema)
    r = ingest.upsert_nodes(old, new).first()
    assert (r.memory, r.embedding, r.user_name, r.created_at, r.updated_at) == ("n", [1.0], "u", 1, 2)


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "id int, t string")
    ingest.write_report(df, df.limit(0), df, str(tmp_path))
    assert spark.read.json(f"{tmp_path}/answers").count() == 1
