"""The registered back-off query scores by histories of several words."""

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from claimweave.llm import backoff, queries
from claimweave.session import settle

from .test_tables import TEXTS, brute_scores, docs


def test_registered_order(spark, tmp_path):
    texts = TEXTS + [(7, "the cat sat on the mat and the cat sat on the rug"), (8, "the cat sat on the mat"), (9, "a cat sat on a mat and the")]
    docs(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    found = queries.op8_stupid_backoff(spark, str(tmp_path)).collect()
    got = sorted(((*r[:3], round(r.log_score, 4)) for r in found), key=str)
    expected = sorted(((*r[:3], round(r[3], 4)) for r in brute_scores(texts, 5)), key=str)
    assert got == expected != sorted(((*r[:3], round(r[3], 4)) for r in brute_scores(texts, 2)), key=str)
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", texts)
    assert sorted(((*r[:3], round(r[3], 4)) for r in con.execute(queries.oracle_sql()["op8_stupid_backoff"]).fetchall()), key=str) == expected
    assert backoff.ORDER == 5


def test_totals_sum_equal_keys_of_all_packs():
    draw = np.random.default_rng(6)
    keys = [np.unique(draw.integers(0, 90, 60).astype(np.uint64) << np.uint64(57)) for _ in range(9)]
    counts = [draw.integers(1, 5, len(k)).astype(np.uint64) for k in keys]
    deltas = [backoff._to_bytes(np.diff(k, prepend=np.uint64(0))) for k in keys]
    table = pa.table({"range": [3] * 9, "pack": list(range(9)), "keys": pa.array(deltas, pa.binary()), "counts": pa.array(list(map(backoff._to_bytes, counts)), pa.binary())})
    wanted = {}
    for k, c in zip(keys, counts):
        for key, count in zip(k.tolist(), c.tolist()):
            wanted[key] = wanted.get(key, 0) + count
    for row, k in zip(backoff._totals(table)["totals"].to_pylist(), keys):
        assert backoff._from_bytes(row).tolist() == [wanted[key] for key in k.tolist()]
    order, begins, where = backoff._ranked(np.array([5, 2, 5, 9], np.uint64))
    assert begins.tolist() == [0, 1, 3] and where.tolist() == [0, 1, 1, 2] and order[0] == 1
    assert all(not len(part) for part in backoff._ranked(np.empty(0, np.uint64)))


def test_words_are_hashed_once_a_pack(monkeypatch):
    texts = [b"a b a", b"", b"b c b d", "ä a".encode(), b""]
    rows = pa.table({"doc_id": list(range(5)), "_utf8": pa.array(texts, pa.binary())})
    (pack,) = backoff._gathered(1 << 20)(iter(rows.to_batches()))
    words, lengths = backoff._hashed(texts)
    assert lengths.tolist() == [3, 0, 4, 2, 0] == pack["lengths"][0].as_py() and pack["n_words"].to_pylist() == [9]
    monkeypatch.setattr(backoff.blocks, "word_hashes", None)
    grams = backoff.Grams(pack["hashes"][0].as_py(), pack["places"][0].as_py(), lengths)
    assert grams.words.tolist() == words.tolist() and len(set(words.tolist())) == 5
    assert words[0] == words[2] == words[8] and grams.place.tolist() == [0, 1, 2, 0, 1, 2, 3, 0, 1]
    totals = np.array([words.tolist().count(key) for key in np.unique(words).tolist()], np.uint64)
    assert next(grams.counted([totals], 2)).tolist() == [3, 3, 3, 3, 1, 3, 1, 1, 3]
    for values in ([], [0], [255, 256], [1 << 63, 5, (1 << 64) - 1]):
        assert backoff._from_bytes(backoff._to_bytes(np.array(values, np.uint64))).tolist() == values
    assert len(backoff._to_bytes(np.ones(4096, np.uint64))) < len(backoff._to_bytes(np.full(4096, 1 << 60, np.uint64)))


def test_texts_without_words_make_an_empty_pack():
    rows = pa.table({"doc_id": [1, 2], "_utf8": pa.array([b" ", b""], pa.binary())})
    (pack,) = backoff._gathered(1 << 20)(iter(rows.to_batches()))
    grams = backoff.Grams(pack["hashes"][0].as_py(), pack["places"][0].as_py(), np.zeros(2, np.int64))
    assert not len(grams.words) and [len(c) for c in grams.counted([np.empty(0, np.uint64)] * 3, 2)] == [0, 0, 0]


def test_settled_tables_leave_no_shuffle_files(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: sum(str(f).split("/")[-1].startswith("shuffle_") for f in manager.getAllFiles().mkString("\n").split("\n"))
    before, known = spark.conf.get(name, None), shuffled()
    rows = settle(spark.range(100).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count(), "test")
    assert shuffled() <= known  # files of earlier tests may go meanwhile
    assert rows.count() == 7 and spark.conf.get(name, None) == before
