"""The .npy data source, chunk generators in SQL."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.functions import chunks
from palimpsest.sources import npy


def test_round_trip_in_independent_ranges(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(230, 5)).astype("<f4")
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "id int, v array<float>")
    npy.publish(df.repartition(7), "id", "v", f"{tmp_path}/a", range_rows=40)
    got = npy.load(spark, f"{tmp_path}/a", dtype="<f4", rows=230, width=5)
    assert got.rdd.getNumPartitions() >= 6
    assert np.array_equal(np.array([r["values"] for r in got.orderBy("row").collect()]).astype("<f4"), rows)
    held = json.load(open(f"{tmp_path}/a/manifest.json"))
    assert held["shape"] == [230, 5]
    first = held["files"][0]
    assert np.array_equal(np.load(f"{tmp_path}/a/{first['name']}"), rows[: first["rows"]])  # an ordinary .npy file


def test_refusals(spark, tmp_path):
    df = spark.createDataFrame([(i, [i, i + 1]) for i in range(20)], "id int, v array<int>")
    npy.publish(df, "id", "v", f"{tmp_path}/a", "<i8", 8)
    assert [r["values"] for r in npy.load(spark, f"{tmp_path}/a").orderBy("row").collect()] == [[i, i + 1] for i in range(20)]
    for wrong in ({"dtype": "<f4"}, {"rows": 21}, {"width": 3}):
        with pytest.raises(Exception, match="not"):
            npy.load(spark, f"{tmp_path}/a", **wrong).count()
    name = json.load(open(f"{tmp_path}/a/manifest.json"))["files"][0]["name"]
    with open(f"{tmp_path}/a/{name}", "r+b") as f:
        f.seek(-1, os.SEEK_END)
        f.write(b"?")
    with pytest.raises(Exception, match="hash"):
        npy.load(spark, f"{tmp_path}/a").collect()
    with pytest.raises(Exception, match="manifest"):
        npy.load(spark, f"{tmp_path}/none").collect()
    with pytest.raises(Exception, match="one length"):
        npy.publish(df.withColumn("v", F.when(F.col("id") < 5, F.col("v")).otherwise(F.array(F.lit(1)))), "id", "v", f"{tmp_path}/b")
    npy.publish(df.limit(0), "id", "v", f"{tmp_path}/c")
    assert npy.load(spark, f"{tmp_path}/c").count() == 0


def test_generators_in_sql_equal_the_chunkers(spark):
    docs = spark.createDataFrame([(1, "One sentence. Two of them!\n\nAnother paragraph here. And more."), (2, ""), (3, None), (4, "word " * 300)], "doc_id int, text string")
    chunks.register_generators(spark)
    got = spark.sql("SELECT doc_id, c.* FROM {d}, LATERAL paragraph_chunks(text, 4) AS c", d=docs)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, chunks.paragraphs(docs, "doc_id", "text", 4).collect()))
    got = spark.sql("SELECT doc_id, c.* FROM {d}, LATERAL simple_chunks(text, 40, 10) AS c", d=docs)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, chunks.simple(docs, "doc_id", "text", 40, 10).collect()))
    for call in ("paragraph_chunks(text, doc_id)", "paragraph_chunks(text, 0)", "paragraph_chunks(doc_id, 5)", "simple_chunks(text, 5, -1)"):
        with pytest.raises(Exception, match="must be"):
            spark.sql(f"SELECT c.* FROM {{d}}, LATERAL {call} AS c", d=docs).collect()
