"""Byte-level BPE and token counts against the tiktoken library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from scoreweave.llm import bpe, lengths, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks()


@pytest.fixture(scope="module")
def reference(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec(ranks):
    return bpe.codec(bpe.serialise_model(ranks), public_tokenizers.PATTERN)


def ids(codec, text):
    return np.frombuffer(codec.encode(text), "<u4").tolist()


def test_every_entry_encodes_itself(codec, ranks):
    letters = codec.letters
    assert all(codec.model.encode("".join(letters[b] for b in t)) == [i] for t, i in ranks.items())


def test_every_code_point(codec, reference):
    points = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    for i in range(0, len(points), 512):
        text = "".join(f"a{c} {c}{c}b" for c in points[i : i + 512])
        assert ids(codec, text) == reference.encode_ordinary(text)


def test_random_texts_and_round_trip(codec, reference, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK", 50)
    rng = random.Random(1)
    letters = "aAzé '\n\t  \r\x85　\x1c1½²st'llre.,!?漢字😀​́$%"
    for _ in range(4000):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(200)))
        assert ids(codec, text) == reference.encode_ordinary(text)
        assert codec.decode(codec.encode(text)) == text.encode()


def test_forgetting_changes_nothing(ranks, reference):
    small = bpe.Codec(bpe.serialise_model(ranks), public_tokenizers.PATTERN)
    small.limit = 10
    texts = ["one two three", "", "three two one.", "four\n\nfive  six"] * 3
    assert [np.frombuffer(x, "<u4").tolist() for x in small.encode_all(texts)] == [reference.encode_ordinary(t) for t in texts]


def test_vocabulary_is_checked(ranks):
    with pytest.raises(ValueError):
        bpe.serialise_model({b"a": 0, b"b": 2})
    with pytest.raises(ValueError):
        bpe.serialise_model({b"a": 0, b"b": 1})


def test_operator(spark, reference):
    rows = [(1, None), (2, ""), (3, "x" * 200000), (4, "Hé llo\n"), (4, "Hé llo\n"), (None, " a"), (5, "w " * 100000)]
    docs = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, n_tokens int")
    out = bpe.encode_decode(docs, with_ids=True).collect()
    assert len(out) == len(rows)
    for r in out:
        want = reference.encode_ordinary(r.text or "")
        assert (r.ids, r.n_tokens) == (want, len(want))
        assert r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert bpe.encode_decode(docs.limit(0)).count() == 0


def test_clashing_column_stays(spark):
    docs = spark.createDataFrame([(1, "a text", "mine")], "doc_id long, text string, _ENCODED string")
    row = bpe.encode_decode(docs).first()
    assert row["_ENCODED"] == "mine" and row["n_tokens"] == 2


def test_whole_table(spark, reference):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op1_byte_bpe(spark, SF).collect():
        want = np.array(reference.encode_ordinary(texts[r.doc_id] or ""), "<u4").tobytes()
        assert (r.n_tokens, r.ids_sha256) == (len(want) // 4, hashlib.sha256(want).hexdigest())


def test_context_limits(spark, reference):
    rng = random.Random(4)
    texts = [None, "", *[" ".join("word" for _ in range(rng.choice([1, 2, 5, 1500, 3000]))) for _ in range(60)]]
    out = lengths.token_counts(spark.createDataFrame([(t,) for t in texts], "text string"))
    sizes = [len(reference.encode_ordinary(t or "")) for t in texts]
    rows = {r.n_tokens: r for r in out.collect()}
    assert set(rows) == set(sizes)
    for limit, r in rows.items():
        assert r.n_docs == sizes.count(limit) and r.docs_over == sum(s > limit for s in sizes)
        assert r.tokens_over == sum(s for s in sizes if s > limit)
        assert r.truncated_tokens == sum(min(s, limit) for s in sizes) and r.tokens_total == sum(sizes)
        assert r.lost_tokens == r.tokens_total - r.truncated_tokens
        assert r.quantile == pytest.approx(sum(s <= limit for s in sizes) / len(sizes))
    assert lengths.length_at_quantile(out, 0.5).first().n_tokens == sorted(sizes)[len(sizes) // 2 - 1]
    assert lengths.token_counts(spark.createDataFrame([], "text string")).count() == 0


def test_context_limits_of_the_whole_table(spark, reference):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = sorted(len(reference.encode_ordinary(r.text or "")) for r in docs.select("text").collect())
    rows = lengths.token_counts(docs).collect()
    assert {r.n_tokens: r.n_docs for r in rows} == {s: sizes.count(s) for s in sizes}
    assert all(r.tokens_over == sum(s for s in sizes if s > r.n_tokens) for r in rows)
