"""Toxicity: noisy-or by hand, offending sentences, held-out accuracy, edge cases."""

import math
import random

import pytest
from pyspark.sql import functions as F

from scoreweave.llm import queries, toxicity

SF = "/root/testdata/sf0.01"
MODEL = toxicity.ToxicityModel({"bad": 6.0, "nice": -2.0}, -4.0, 0)


def sigmoid(x):
    return 1 / (1 + math.exp(-x))


def test_noisy_or_and_sentences(spark):
    text = "Good day. You BAD, bad one!\n...A nice bad thing? é"
    docs = spark.createDataFrame([(1, text, "old")], "doc_id long, text string, score string")
    r = toxicity.score(docs, MODEL).first()
    p = [sigmoid(z) for z in (-4, 8, 0, -4)]
    assert r.score == pytest.approx(1 - math.prod(1 - x for x in p)) and r.n_sentences == 4
    assert [(s.sentence, text[s.start : s.stop].strip()) for s in r.offending] == [(1, "You BAD, bad one"), (2, "A nice bad thing")]


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " .!?\n"), (4, "bad"), (4, "bad"), (None, "word " * 300000), (5, "w. " * 200000)]
    out = toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), MODEL).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    assert [r.score for r in out if r.doc_id in (1, 2, 3)] == [0.0] * 3
    assert [r.predicted for r in out if r.doc_id == 4] == [1, 1]
    empty = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.detect(empty, labels).count() == 0
    docs = spark.createDataFrame([(1, "plain")], "doc_id long, text string")
    assert toxicity.detect(docs, labels).first().predicted == 0


def test_clashing_column_stays(spark):
    docs = spark.createDataFrame([(1, "a text", "mine"), (2, "vile words", "mine")], "doc_id long, text string, _toxicity string")
    labels = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int")
    assert {r["_toxicity"] for r in toxicity.detect(docs, labels).collect()} == {"mine"}


def test_learns_from_document_labels(spark):
    rng = random.Random(1)
    bag = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(400):
        sentences = [" ".join(rng.choice(bag) for _ in range(8)) for _ in range(rng.randrange(1, 12))]
        if i % 4 == 0:
            sentences.insert(rng.randrange(len(sentences) + 1), f"you {rng.choice(['oaf', 'lout'])} there")
        rows.append((i, ". ".join(sentences)))
        labels.append((i, int(i % 4 == 0)))
    labels += [(None, 1), (3, None), (9999, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = toxicity.detect(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert all(r.predicted == (r.doc_id % 4 == 0) for r in out)
    for r in out:
        assert len(r.offending) == (r.doc_id % 4 == 0)
        assert all("oaf" in r.text[s.start : s.stop] or "lout" in r.text[s.start : s.stop] for s in r.offending)


def test_held_out_accuracy(spark):
    out = queries.op9_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("held_out").collect()
    right = [r.predicted == r.toxic for r in out]
    assert len(right) > 80 and sum(right) / len(right) > 0.95


def test_training_sample_is_bounded_with_repeated_rows(spark):
    docs = spark.createDataFrame([(i % 20, f"text {i % 20} {'b' if i % 40 > 19 else 'a'}") for i in range(2000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i % 20, i % 20 // 10) for i in range(200)], "doc_id long, toxic int")
    sample = toxicity.training_sample(docs, labels, "doc_id", "text", "toxic", F.lit(True), 4, 100).collect()
    assert sorted(r._y for r in sample) == [0] * 4 + [1] * 4
    assert all(r._t.endswith("a") for r in sample) and len({r._t for r in sample}) == 8
