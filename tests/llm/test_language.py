"""Language identification: code lengths against a per-byte search, held-out accuracy, edge cases."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreweave.llm import language, queries

SF = "/root/testdata/sf0.01"


def brute_bits(texts, word, order=3):
    """PPM with escape method C, counted and coded byte by byte."""
    counts = defaultdict(Counter)
    for t in texts:
        for w in t.encode().split():
            s = b" " + w + b" "
            for i in range(1, len(s)):
                for k in range(min(order, i) + 1):
                    counts[s[i - k : i]][s[i]] += 1
    s, bits = b" " + word + b" ", 0.0
    for i in range(1, len(s)):
        for k in range(min(order, i), -1, -1):
            seen = counts.get(s[i - k : i])
            if seen is None:
                continue
            n, d = sum(seen.values()), len(seen)
            if s[i] in seen:
                bits -= math.log2(seen[s[i]] / (n + d))
                break
            bits -= math.log2(d / (n + d))
        else:
            bits += 8
    return bits


def test_code_lengths_equal_search(spark):
    texts = {"aa": ["der die das und", "eins zwei"], "bb": ["the and of", "one two thé"]}
    rows = [(k, t) for k, ts in texts.items() for t in ts]
    trees = language.fit(spark.createDataFrame(rows, "lang string, text string"))
    words = [b"der", b"thand", "ß€x".encode(), b"q", b"", b"unduntheone", "théa".encode()]
    got = language.code_lengths(trees, words)
    assert trees.languages == ["aa", "bb"]
    for i, w in enumerate(words):
        for j, k in enumerate(trees.languages):
            assert got[i, j] == pytest.approx(brute_bits(texts[k], w))


def test_edge_cases(spark):
    rows = [
        (1, None, "en"), (2, "", "en"), (3, "123 --", "en"), (4, "the house and the garden", "en"), (5, "das Haus und der Garten", "de"),
        (5, "das Haus und der Garten", "de"), (6, "der Garten", None), (None, "the garden", None), (7, "the " * 200000, "en"),
        (8, "x" * 300000, None),
    ]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    out = language.detect(docs).collect()
    assert len(out) == len(rows)
    by_text = {(r.doc_id, None if r.text is None else len(r.text)): r for r in out}
    assert [by_text[k].lang_pred for k in ((1, None), (2, 0), (3, 6))] == ["und"] * 3
    assert by_text[6, 10].lang_pred == "de" and by_text[None, 10].lang_pred == "en" and by_text[7, 800000].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in out)
    none = spark.createDataFrame([], docs.schema)
    assert language.detect(none).count() == 0
    assert {r.lang_pred for r in language.detect(docs, train=F.lit(False)).collect()} == {"und"}


def test_more_languages_than_the_bound(spark):
    docs = spark.createDataFrame([(i, "some text", f"l{i}") for i in range(4)], "doc_id long, text string, lang string")
    assert language.training_sample(docs, "doc_id", "text", "lang", F.lit(True), 9, 99, languages=4).count() == 4
    with pytest.raises(ValueError, match="languages"):
        language.training_sample(docs, "doc_id", "text", "lang", F.lit(True), 9, 99, languages=3)


def test_repeated_rows_do_not_swell_the_sample(spark):
    rows = [(i % 20, f"text number {i % 20}", "en") for i in range(4000)] + [(77, f"other text {i}", "en") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert 0 < language.training_sample(docs, "doc_id", "text", "lang", F.lit(True), 100, 99).count() <= 150


def test_clashing_column_stays(spark):
    docs = spark.createDataFrame([(1, "the house", "en", "mine")], "doc_id long, text string, lang string, _language string")
    assert language.detect(docs).first()["_language"] == "mine"


def test_held_out_accuracy(spark):
    out = queries.op7_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id")
    rows = out.filter("held_out AND lang_pred <> 'und'").select("lang", "lang_pred").collect()
    assert len(rows) > 200 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.97
