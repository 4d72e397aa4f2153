"""Hidden Markov language model: forward and Baum-Welch against enumeration, base scores, gain."""

import itertools
import math
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreweave.llm import hmm, queries

SF = "/root/testdata/sf0.01"


def small_model(states=2, symbols=4):
    rng = np.random.default_rng(1)
    start, step, emit = rng.uniform(0.1, 1, states), rng.uniform(0.1, 1, (states, states)), rng.uniform(0.1, 1, (symbols, states))
    return hmm.HiddenMarkov(start / start.sum(), step / step.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def paths(model, seq):
    for p in itertools.product(range(len(model.start)), repeat=len(seq)):
        x = model.start[p[0]] * model.emit[seq[0], p[0]]
        for t in range(1, len(seq)):
            x *= model.step[p[t - 1], p[t]] * model.emit[seq[t], p[t]]
        yield p, x


def test_forward_equals_enumeration():
    model = small_model()
    seqs = [np.array(s) for s in ([0], [3, 1, 2], [2, 2, 0, 1, 3, 3], [1, 0])]
    want = [math.log(sum(x for _, x in paths(model, s))) for s in seqs]
    assert hmm.log_likelihoods(model, seqs) == pytest.approx(want)


def test_expected_counts_equal_enumeration():
    model = small_model()
    seqs = [np.array(s) for s in ([0], [3, 1, 2], [2, 2, 0, 1, 3], [1, 0])]
    got = hmm.Expected(model)
    got.add(seqs, [True] * 4)
    start, step, emit = np.zeros(2), np.zeros((2, 2)), np.zeros((4, 2))
    for s in seqs:
        total = sum(x for _, x in paths(model, s))
        for p, x in paths(model, s):
            start[p[0]] += x / total
            for t, o in enumerate(s):
                emit[o, p[t]] += x / total
                if t:
                    step[p[t - 1], p[t]] += x / total
    assert np.allclose(got.start, start) and np.allclose(got.step, step) and np.allclose(got.emit, emit)


def words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split(r"[\x20\x09-\x0D]+", lower) if w] + [None]


def base(rows):
    train = Counter(w for k, t in rows if crc32(str(k).encode()) % 10 for w in words(t))
    n, v = sum(train.values()), len(train)
    return {
        k: (len(words(t)), sum(w in train for w in words(t)), n, sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words(t)))
        for k, t in rows
    }


def compared(out, want):
    for r in out:
        n_tokens, n_known, train_tokens, score = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n_tokens, n_known, train_tokens)
        assert r.base_score == pytest.approx(score, rel=1e-9)
        assert r.score < 0 and math.isfinite(r.score)


def test_base_scores_and_gain(spark, monkeypatch):
    """Few carried words, so that most of the vocabulary goes through the join."""
    monkeypatch.setattr(hmm, "CARRIED", 300)
    monkeypatch.setattr(hmm, "SYMBOLS", 100)
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(400).select("doc_id", "text").cache()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    held = F.crc32(F.col("doc_id").cast("string")) % 10 == 0
    out = hmm.language_model(docs, train=~held).collect()
    assert len(out) == len(rows)
    compared(out, base(rows))


def test_held_out_texts_are_likelier_than_under_the_base(spark):
    out = queries.op8_language_model(spark, SF)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    out = out.collect()
    compared(out, base(rows))
    held = [r for r in out if r.held_out]
    assert len(held) > 50 and sum(r.score for r in held) > sum(r.base_score for r in held) * 0.97


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "A a b"), (3, "A a b"), (None, "a c"), (4, "a " * 200000), (5, "x" * 100000)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, score int")
    out = hmm.language_model(docs).collect()
    assert sorted(r.n_tokens for r in out) == [1, 1, 2, 3, 4, 4, 200001]
    assert all(r.score < 0 and r.n_known == r.n_tokens for r in out)
    none = hmm.language_model(docs, train=F.lit(False)).collect()
    assert all(r.base_score == 0 and r.score == pytest.approx(r.n_tokens * math.log10(0.5)) for r in none)
    assert hmm.language_model(docs.limit(0)).count() == 0


def test_scores_are_probabilities(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "b"), (3, "a a b")], "doc_id long, text string")
    counts = hmm.word_counts(docs, "text")
    vocab = hmm.vocabulary(counts)
    model = hmm.fit(docs, "doc_id", "text", vocab, 1, 10, 100)
    texts = ["", "a", "b", "zz"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    out = {r.doc_id: 10**r.score for r in hmm.score(frame, model, vocab, counts, "text").collect()}
    assert 0 < sum(out.values()) < 1
