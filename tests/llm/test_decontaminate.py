"""Benchmark decontamination against a search of every window in every text."""

import random
import re

from scoreweave.llm import decontaminate

SF = "/root/testdata/sf0.001"


def words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    lengths = {len(w) for w in windows}
    out = []
    for key, text in docs:
        w = words(text)
        hit, found = set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if own := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= own
        out.append((key, len(w), len(hit), sorted(str(x) for x in found if x is not None)))
    return sorted(out, key=str)


def check(spark, docs, items):
    d = spark.createDataFrame([(k, t, 1) for k, t in docs], "doc_id long, text string, n_hit int")
    b = spark.createDataFrame([(k, t, "x") for k, t in items], "item_id long, text string, words string")
    rows = decontaminate.contamination(d, b).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_hit, r["items"]) for r in rows], key=str) == brute(docs, items)
    assert all(r.contaminated == (r.n_hit > 0) and r.n_items == len(r["items"]) for r in rows)


def test_planted_windows(spark):
    rng = random.Random(2)
    bag = [f"w{i}" for i in range(40)]
    text = lambda n: " ".join(rng.choice(bag) for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 3, 5, 9, 10, 11, 25]))) for i in range(30) if i != 7]
    items += [(7, None), (40, ""), (41, "..."), (9, "Doppelt, doppelt"), (9, "noch eins"), (None, text(12)), (50, items[3][1])]
    docs = [(i, text(rng.choice([0, 3, 12, 60]))) for i in range(40)]
    docs += [(100 + i, f"{text(5)}; {items[i][1] or ''}! {text(4)}") for i in range(30)]
    docs += [(200, None), (201, ""), (202, "—!"), (202, items[5][1]), (None, items[6][1]), (100, docs[40][1])]
    docs += [(300, " ".join(str(x) for x in range(30000)) + " " + items[-2][1]), (301, "DOPPELT-doppelt\x00noch\x7feins"), (302, (items[-1][1] + " ") * 50)]
    check(spark, docs, items)


def test_long_items_only(spark):
    rng = random.Random(4)
    item = [f"a{rng.randrange(500)}" for _ in range(40)]
    near = item[:15] + ["changed"] + item[16:24] + ["changed"] + item[25:]
    check(spark, [(1, " ".join(item)), (2, " ".join(near)), (3, " ".join(item[:9])), (4, " ".join(item[5:15]))], [(1, " ".join(item))])


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert decontaminate.contamination(none, items).count() == 0
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert [r.n_hit for r in decontaminate.contamination(docs, items.limit(0)).collect()] == [0]


def test_given_tables(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    check(spark, docs, items)
