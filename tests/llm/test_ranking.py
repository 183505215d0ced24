"""Pairwise ranking: held-out accuracy, the fit against plain gradient descent, and odd tables."""

import math
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from claimweave.llm import queries, ranking
from claimweave.llm.common import ready

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    found = queries.op11_pairwise_ranking(spark, SF).toPandas()
    assert len(found) == pd.read_parquet(f"{SF}/documents.parquet").shape[0]
    assert found.held_out.tolist() == [zlib.crc32(str(i).encode()) % 4 == 2 for i in found.doc_id]
    assert found.score.between(0, 1).all() and (found.predicted == (found.score >= 0.7)).all()
    both = found.merge(pd.read_parquet(f"{SF}/labels.parquet"), on="doc_id")
    unseen = both[both.held_out]
    assert (unseen.predicted == unseen.quality).mean() >= 0.95
    good, bad = unseen[unseen.quality == 1].score.to_numpy(), unseen[unseen.quality == 0].score.to_numpy()
    assert (good[:, None] > bad).mean() >= 0.98


def test_labels_of_held_out_rows_are_not_read(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("quality", ranking.F.when(ranking.held_out(ranking.F.col("doc_id")), 1 - ranking.F.col("quality")).otherwise(ranking.F.col("quality")))
    ready(spark)
    one, other = ranking.train(docs, labels), ranking.train(docs, turned)
    assert one.cut == other.cut and (one.weights == other.weights).all()


def test_fit_is_the_least_loss():
    draw = np.random.default_rng(1)
    rows = draw.normal(size=(60, len(ranking.MEASURES)))
    truth = draw.normal(size=len(ranking.MEASURES))
    a, b = draw.integers(0, 60, 400), draw.integers(0, 60, 400)
    a, b = a[a != b], b[a != b]
    swap = 1 / (1 + np.exp((rows[a] - rows[b]) @ truth)) > draw.random(len(a))
    better, worse = np.where(swap, b, a), np.where(swap, a, b)
    model = ranking.fit(rows, better, worse, ridge=0.01)

    def loss(weights):
        spaced = ranking.expanded((rows - model.middle) / model.spread)
        return np.logaddexp(0, -(spaced[better] - spaced[worse]) @ weights).mean() + 0.01 * (weights**2).sum()

    least = loss(model.weights)
    for _ in range(200):
        assert least <= loss(model.weights + draw.normal(size=len(model.weights)) * 0.01) + 1e-12
    assert (model.utilities(rows)[better] > model.utilities(rows)[worse]).mean() > 0.75


def test_quantile_cut():
    assert ranking.quantile_cut(np.array([4.0, 1.0, 3.0, 2.0]), np.ones(4), 0.5) == 2.5
    assert ranking.quantile_cut(np.array([1.0, 2.0]), np.array([1.0, 3.0]), 0.25) == 1.5
    assert ranking.quantile_cut(np.array([1.0, 2.0]), np.ones(2), 0.0) == 1.0
    assert ranking.quantile_cut(np.array([1.0, 2.0]), np.ones(2), 1.0) > 2.0


def test_threshold_is_the_quantile():
    draw = np.random.default_rng(3)
    rows = draw.normal(size=(500, len(ranking.MEASURES)))
    marks = (rows[:, 3] + draw.normal(size=500) > -1).astype(int)
    model = ranking.fit(rows, *ranking.preferences(marks))
    model.cut = ranking.quantile_cut(model.utilities(rows), np.ones(500), float((marks == 0).mean()))
    assert int((model.scores(rows) < ranking.THRESHOLD).sum()) == int((marks == 0).sum())


def test_measures_of_pieces():
    rng = np.random.default_rng(2)
    text = " ".join(rng.choice(["The", "and&&&", "|", "x1!!", "Éa.", "ÉA", "long\nline", "İx"], 3000))
    whole = ranking.measures(text)
    piece, ranking.PIECE = ranking.PIECE, 97
    try:
        assert ranking.measures(text) == pytest.approx(whole, rel=1e-3)
    finally:
        ranking.PIECE = piece
    assert ranking.measures("") == ranking.measures(" \n\t ") == [0.0] * len(ranking.MEASURES)
    assert all(map(math.isfinite, ranking.measures("a" * 3_000_000))) and all(map(math.isfinite, ranking.measures("|")))


def test_odd_tables(spark):
    ready(spark)
    schema = "doc_id long, text string, score string, predicted string, measures string, quality string, _text string, _k0 string"
    rest = ("s", "p", "m", "q", "t", "k")
    good, bad = "A plain sentence of words, and one more. Then it ends.", "&&& ### | | | $$$ %%% ||| <> <> <> ###"
    rows = [(i, good if i % 2 else bad, *rest) for i in range(40)]
    rows += [(1, good, *rest), (1, bad, *rest), (None, good, *rest), (50, None, *rest), (51, "", *rest), (52, "word " * 400_000, *rest)]
    docs = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame(
        [(i, i % 2) for i in range(40)] + [(3, 1), (5, 0), (None, 1), (7, None), (99, 1)], "doc_id long, quality int"
    )
    model = ranking.train(docs, labels)
    found = ranking.scored(docs, model, ("doc_id", "measures", "_text", "_k0")).collect()
    assert len(found) == len(rows) and {(r.measures, r._text, r._k0) for r in found} == {("m", "t", "k")}
    by = {}
    for r in found:
        by.setdefault(r.doc_id, []).append(r.score)
    assert by[50] == by[51] and sorted(by[1]) == sorted([by[3][0], by[3][0], by[2][0]])
    assert by[3][0] >= 0.7 > by[2][0]
    none = ranking.train(docs, labels.where("quality = 1"))
    assert all(r.score == pytest.approx(0.7) for r in ranking.scored(docs, none).collect())
    assert ranking.scored(docs.limit(0), ranking.train(docs.limit(0), labels.limit(0))).count() == 0


def test_pairs(spark):
    ready(spark)
    texts = ["A plain sentence of words, and one more.", "Some more plain words, which end here.", "### | | $$$ |||", "&&& | ### %%%"]
    docs = spark.createDataFrame([(i, texts[i % 4]) for i in range(40)], "doc_id long, text string")
    pairs = [(i, j) for i in range(40) for j in range(40) if i % 4 < 2 <= j % 4 and (i + j) % 5 == 0]
    given = spark.createDataFrame([*pairs, *pairs, (1, 1), (None, 2), (3, 77)], "better_id long, worse_id long")
    found = ranking.scored(docs, ranking.train_on_pairs(docs, given, 0.5)).collect()
    assert all(r.predicted == (r.doc_id % 4 < 2) for r in found)
    assert {r.predicted for r in ranking.scored(docs, ranking.train_on_pairs(docs, given.limit(0), 0.5)).collect()} <= {0, 1}


def test_every_labelled_row_is_learned_from(spark):
    ready(spark)
    draw = np.random.default_rng(4)
    marks = {i: int(draw.random() < 0.9) for i in range(600)}
    texts = ["A plain sentence of words, and one more. " * int(draw.integers(1, 9)) + ("&& | " * int(draw.integers(0, 6)) if not marks[i] else "") for i in marks]
    docs = spark.createDataFrame([(i, text) for i, text in enumerate(texts)], "doc_id long, text string")
    rows = ranking.labelled(docs, spark.createDataFrame(list(marks.items()), "doc_id long, quality int"))
    taken = [i for i in marks if zlib.crc32(str(i).encode()) % 4 != 2]
    assert sorted(r.doc_id for r in rows.collect()) == taken
    sizes = {label: sum(marks[i] == label for i in taken) for label in (0, 1)}
    blocks = ranking.dealt(rows, sizes, block_rows=40, block_partners=30)
    held = blocks.collect()
    assert len(held) == math.ceil(len(taken) / 40)
    assert sum(sum(r.own) for r in held) == len(taken)
    assert min(r.marks.count(0) for r in held) >= 10 and max(len(r.marks) for r in held) < 140
    # Sums and order statistics are those of all rows.
    values = np.array([ranking.measures(texts[i]) for i in taken])
    total = ranking.summed(blocks, lambda rows, marks, own, block: rows[own].sum(axis=0))
    assert total == pytest.approx(values.sum(axis=0))
    ranks = np.arange(len(ranking.MEASURES)) * 7
    assert (ranking.order_values(blocks, lambda rows: rows - 1.5, ranks) == (np.sort(values - 1.5, axis=0)[ranks, np.arange(len(ranks))])).all()


def test_rows_beyond_the_first_thousands_count(spark):
    ready(spark)
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("some plain words "), F.repeat(F.lit("more "), (F.col("id") % 97).cast("int"))).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 97 >= 30).cast("int").alias("quality"))
    learned = ranking.labelled(docs, labels)
    assert learned.count() == labels.where(~ranking.held_out(F.col("doc_id"))).count() > 12_000
    model = ranking.train(docs, labels)
    wrong = ranking.scored(docs, model).join(labels, "doc_id").where("predicted <> quality").count()
    assert wrong < 200
