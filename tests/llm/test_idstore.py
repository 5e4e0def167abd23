"""The token id store: exact round trips, offsets, direct access, refusals."""

import json
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from palimpsest.llm import idstore
from palimpsest.llm.tokens import tokenizer_path

VOCABULARY = tokenizer_path("word_bpe_49k.json")


def texts():
    rng = random.Random(3)
    words = "the quick brown fox jumps over lazy dog near old river bank été 北京 don't x9 naïve".split()
    made = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    return [None, "", " \n\t", "a", "É" * 50, "x" * 200_000, ("word " * 30_000).strip(), *made, made[0], made[0]]


def ids_of(text):
    library = Tokenizer.from_file(VOCABULARY)
    return [*library.encode(text or "", add_special_tokens=False).ids, 2]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "mine", 7, b"mine", 1) for i, t in rows], "doc_id long, text string, start string, n_tokens long, frame binary, uid long")


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    rows = list(enumerate(texts(), start=-5)) + [(None, "no id at all"), (None, "none here either"), (40, "an id that comes twice")]
    random.Random(1).shuffle(rows)
    where = f"{tmp_path_factory.mktemp('store')}/ids"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several files
    idstore.write_ids(table(spark, rows).repartition(6), where, VOCABULARY)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    return rows, where


def test_round_trip_in_order(spark, store):
    rows, where = store
    got = idstore.read_ids(spark, where).orderBy("start").collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, tuple(np.frombuffer(r.ids, "<u4"))) for r in got) == sorted((i is not None, i or 0, tuple(ids_of(t))) for i, t in rows)
    assert [(r.doc_id is not None, r.doc_id or 0) for r in got] == sorted((i is not None, i or 0) for i, _ in rows)
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) // 4
        at += r.n_tokens


@pytest.mark.parametrize("small", [True, False])
def test_files_and_batches_of_any_size(spark, store, tmp_path, monkeypatch, small):
    """Documents are found again however files, tasks and batches are cut; here the writer's parts are driven by hand."""
    rows, _ = store
    known = sorted(((i, ids_of(t)) for i, t in rows if i is not None and len(t or "") < 2000), key=lambda x: x[0])
    import pyarrow as pa
    import zstandard

    squeeze = zstandard.ZstdCompressor()
    file = idstore.FrameFile(str(tmp_path), "one", {"dictionary": "d", "width": 2})
    for k in range(0, len(known), 7):
        part = known[k : k + 7]
        file.add(pa.array([i for i, _ in part]), pa.array([len(x) for _, x in part]), pa.array([squeeze.compress(np.array(x, "<u2").tobytes()) for _, x in part]))
    name, n, tokens, nulls, low, high = file.close()
    (tmp_path / "manifest").write_text(json.dumps({"files": [(name, n, tokens, nulls, low, high)]}))
    monkeypatch.setattr(idstore, "_decompressor", lambda path, sha256: zstandard.ZstdDecompressor())
    if small:
        for what, value in (("BATCH_ROWS", 3), ("BATCH_BYTES", 200), ("TASK_IDS", 300)):
            monkeypatch.setattr(idstore, what, value)
    reader = idstore.Reader({"path": str(tmp_path)})
    parts = reader.partitions()
    assert (len(parts) > 3) == small
    batches = [b for p in parts for b in reader.read(p)]
    assert [(i, list(np.frombuffer(x, "<u4"))) for b in batches for i, x in zip(b.column("doc_id").to_pylist(), b.column("ids").to_pylist(), strict=True)] == known


def test_filters_read_only_what_they_need(spark, store):
    rows, where = store
    want = lambda f: sorted((i, tuple(ids_of(t))) for i, t in rows if i is not None and f(i))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = idstore.read_ids(spark, where)
        for column, rule in (
            (F.col("doc_id") == 40, lambda i: i == 40),
            (F.col("doc_id").isin(3, 40, 9999), lambda i: i in (3, 40)),
            ((F.col("doc_id") > 17) & (F.col("doc_id") <= 33), lambda i: 17 < i <= 33),
            ((F.col("doc_id") >= 100) & (F.col("doc_id") < 20), lambda i: False),
            ((F.col("doc_id") < -3) & (F.col("n_tokens") > 0), lambda i: i < -3),
            (F.col("doc_id").isin(3, 40) & (F.col("doc_id") > 5), lambda i: i == 40),
        ):
            assert sorted((r.doc_id, tuple(np.frombuffer(r.ids, "<u4"))) for r in df.filter(column).collect()) == want(rule)
        assert df.filter("doc_id is null").count() == 2
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    reader = idstore.FilteredReader({"path": where})
    from pyspark.sql.datasource import EqualTo

    assert list(reader.pushFilters([EqualTo(("doc_id",), 40)])) == []
    assert 1 <= len(reader.partitions()) < len(json.load(open(f"{where}/manifest"))["files"])


def test_one_shared_dictionary_whose_hash_files_name(store):
    _, where = store
    (name,) = [f for f in os.listdir(where) if f.startswith("dictionary-") and not f.endswith(".crc")]
    assert json.load(open(f"{where}/manifest"))["dictionary"] == name.removeprefix("dictionary-")
    kept = open(f"{where}/{name}", "rb").read()
    try:
        with open(f"{where}/{name}", "wb") as f:
            f.write(kept[:-1] + b"?")
        with pytest.raises(Exception, match="not the one its files name"):
            idstore._decompressor(where, name.removeprefix("dictionary-"))
    finally:
        with open(f"{where}/{name}", "wb") as f:
            f.write(kept)


def test_files_of_lost_attempts_are_not_read(spark, store):
    _, where = store
    before = idstore.read_ids(spark, where).count()
    one = next(f for f in os.listdir(where) if f.startswith("ids-"))
    with open(f"{where}/{one[:20]}-stray", "wb") as f:
        f.write(open(f"{where}/{one}", "rb").read())
    assert idstore.read_ids(spark, where).count() == before


def test_odd_tables(spark, tmp_path):
    idstore.write_ids(table(spark, []), f"{tmp_path}/none", VOCABULARY)
    assert idstore.read_ids(spark, f"{tmp_path}/none").collect() == []
    idstore.write_ids(table(spark, [(1, None)]), f"{tmp_path}/one", VOCABULARY)
    assert [(r.doc_id, r.start, r.n_tokens, bytes(r.ids)) for r in idstore.read_ids(spark, f"{tmp_path}/one").collect()] == [(1, 0, 1, b"\2\0\0\0")]
    idstore.write_ids(table(spark, [(5, "same text")] * 40), f"file://{tmp_path}/same", VOCABULARY)
    assert idstore.read_ids(spark, f"file://{tmp_path}/same").select("doc_id", "n_tokens", F.crc32("ids")).distinct().count() == 1
    with pytest.raises(TypeError):
        idstore.write_ids(table(spark, []).withColumn("doc_id", F.lit("a")), f"{tmp_path}/bad", VOCABULARY)


def test_dictionary_saves_space():
    rng = random.Random(2)
    words = [np.array([rng.randint(0, 40_000) for _ in range(3)], "<u2").tobytes() for _ in range(300)]
    samples = [b"".join(rng.choice(words) for _ in range(20)) for _ in range(400)]
    import zstandard

    data = idstore.trained(samples)
    assert len(data) <= idstore.DICTIONARY_BYTES
    size = lambda squeeze: sum(len(squeeze.compress(s)) for s in samples)
    assert size(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(data))) < 0.8 * size(zstandard.ZstdCompressor())


def test_query_equals_the_library(spark):
    from palimpsest.llm import registry

    sf_dir = "/root/testdata/sf0.001"
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in registry.QUERIES["op11_token_id_store"](spark, sf_dir).collect()}
    at, want = 0, {}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect():
        ids = ids_of(r.text)
        want[r.doc_id] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert got == want
