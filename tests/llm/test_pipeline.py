"""Pipeline: planted documents, columns, and stages against brute-force versions."""

import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline
from scoreweave.llm import bpe, language, neardup, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """Documents after each stage, each written and read again."""
    folder = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out[-1], SF).write.parquet(f"{folder}/{name}")
        out.append(spark.read.parquet(f"{folder}/{name}"))
    return out


def keys(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages_keep_the_columns(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "near_duplicates", "decontamination", "encode"]
    assert all(set(s.columns) == set(steps[0].columns) for s in steps[1:5])
    assert all(set(keys(b)) <= set(keys(a)) for a, b in zip(steps, steps[1:], strict=False))


def test_filters_equal_their_operators(spark, steps):
    toxic = toxicity.detect(steps[0], spark.read.parquet(f"{SF}/labels.parquet")).filter("predicted = 0")
    assert keys(steps[1]) == keys(toxic)
    assert keys(steps[2]) == keys(language.detect(steps[1]).filter("lang_pred <> 'und' AND score >= 0.5"))


def test_dedup_and_decontamination_equal_brute_force(spark, steps):
    def words(text, ok):
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        return "".join(c if ok(c) else " " for c in lower).split(" ")

    rows = {r.doc_id: r.text for r in steps[2].collect()}
    sets = {}
    for k, t in rows.items():
        w = [x for x in words(t, lambda c: c not in " \t\n\x0b\x0c\r") if x]
        sets[k] = {tuple(w[i : i + min(5, len(w))]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in sorted(sets):
        for b in sorted(sets):
            if b < a and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert keys(steps[3]) == sorted(k for k in sets if find(k) == k)
    plain = lambda t: [x for x in words(t, lambda c: ord(c) >= 128 or c.isalnum()) if x]
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = plain(r.text)
        windows |= {tuple(w[i : i + 10]) for i in range(len(w) - 9)}
    held = {r.doc_id: plain(r.text) for r in steps[3].collect()}
    assert keys(steps[4]) == sorted(k for k, w in held.items() if not any(tuple(w[i : i + 10]) in windows for i in range(len(w) - 9)))


def test_last_stage_encodes_what_is_left(steps):
    codec = bpe.codec(bpe.serialise_model(bpe.read_ranks()), bpe.public_tokenizers.PATTERN)
    texts = {r.doc_id: r.text for r in steps[4].collect()}
    out = steps[5].collect()
    assert {r.doc_id: r.n_tokens for r in out} == {k: len(codec.encode(t)) // 4 for k, t in texts.items()}


def test_edge_cases_pass_every_stage(spark, tmp_path):
    rows = [
        (1, None, "en", "s", 0), (2, "", None, None, None), (3, "the house and the garden of the king", "en", "s", 1), (3, "the house and the garden of the king", "en", "s", 1),
        (None, "the end of the road is here now", "en", "s", 1), (4, "das Haus und der Garten", "de", "s", 1), (5, "w " * 100000, "en", "s", 1),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, data in (("full", rows), ("empty", [])):
        sf = str(tmp_path / name)
        spark.createDataFrame(data, schema).write.parquet(f"{sf}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
        out = corpus_pipeline.run(spark, sf).collect()
        assert sorted((r.doc_id or 0) for r in out) == ([0, 3, 4, 5] if data else [])


def test_first_of_each_keeps_one_row_of_a_repeated_key(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, "a b c"), (None, "a b c"), (3, None), (3, None), (4, "x")], "doc_id long, text string")
    assert sorted((r.doc_id or 0) for r in neardup.first_of_each(docs).collect()) == [0, 1, 3, 4]


@pytest.mark.parametrize("kind", ["long", "string"])
def test_first_of_each_keeps_another_text_of_a_repeated_key(spark, kind):
    copied = [f"c{i}" for i in range(60)]
    rows = [(1, " ".join(copied)), (2, " ".join([*copied, "x"])), (2, " ".join(f"own{i}" for i in range(60))), (3, "third text stands alone here"), (3, None), (-4, "negative"), (-4, "negative")]
    docs = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, _name0 int").withColumn("doc_id", F.col("doc_id").cast(kind))
    left = sorted((int(r.doc_id), (r.text or "")[:4]) for r in neardup.first_of_each(docs).collect())
    assert left == [(-4, "nega"), (1, "c0 c"), (2, "own0"), (3, ""), (3, "thir")]
