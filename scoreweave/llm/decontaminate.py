"""Benchmark decontamination by a prefix-filtered set join over word shingles.

An item is cut into windows of ``window`` consecutive words (a shorter item is one window). Exact
containment of a window needs all its shingles, so its necessary prefix is one shingle: the one that
the documents hold least often. Only these shingles are joined; the position of the match
then says where the window must lie, bounds rule out what does not fit, and the words are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tools import ALNUM, alnum_words, shingle_hashes, stored, word_hashes

SHINGLE = 3
# Bits of the filter that spares the shuffle shingles no item has. Its size is fixed: with more items it
# lets more pass and the join still decides.
FILTER_BITS = 1 << 23


def _kinds(n_words: np.ndarray, sizes: list[int]) -> Iterator[np.ndarray]:
    for size in sizes:
        yield shingle_hashes(n_words, size)


def item_windows(items: DataFrame, item: str, text: str, window: int) -> DataFrame:
    """``item``, ``words`` (joined with spaces), ``length``, ``hash`` and ``offset`` of each shingle."""

    @F.pandas_udf("array<struct<words: string, length: int, hashes: array<long>>>")
    def windows(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for t in texts:
                words = alnum_words((t or "").encode())
                own = word_hashes((t or "").encode(), ALNUM)
                length = min(window, len(words))
                out.append(
                    [
                        {
                            "words": b" ".join(words[i : i + length]).decode(),
                            "length": length,
                            "hashes": shingle_hashes(own[i : i + length], min(SHINGLE, length)).view(np.int64),
                        }
                        for i in range(len(words) - length + 1)
                    ]
                    if words
                    else []
                )
            yield pd.Series(out)

    cut = items.select(F.col(item).alias("item"), F.explode(windows.asNondeterministic()(F.col(text))).alias("w"))
    return cut.select("item", "w.words", "w.length", F.posexplode("w.hashes").alias("offset", "hash"))


def _bits(hashes: DataFrame) -> np.ndarray:
    """Fixed-size bitmap of the hashes, one bit each."""
    places = hashes.select(F.pmod("hash", F.lit(FILTER_BITS)).alias("place")).groupBy((F.col("place") / 65536).cast("int").alias("block"))
    rows = places.agg(F.collect_set((F.col("place") % 65536).cast("int")).alias("places")).toLocalIterator()
    bits = np.zeros(FILTER_BITS, bool)
    for row in rows:
        bits[np.asarray(row["places"], np.int64) + 65536 * row["block"]] = True
    return np.packbits(bits)


def _passed(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Places of the hashes that the bitmap lets pass."""
    place = (hashes.view(np.int64) & (FILTER_BITS - 1)).astype(np.int64)
    return np.flatnonzero(bits[place >> 3] & (128 >> (place & 7)).astype(np.uint8))


def shingle_frequencies(docs: DataFrame, text: str, bits: np.ndarray, sizes: list[int]) -> DataFrame:
    """How often the documents hold each shingle that passes the bitmap (``hash``, ``df``)."""
    shipped = docs.sparkSession.sparkContext.broadcast(bits)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for t in batch["text"]:
                own = word_hashes((t or "").encode(), ALNUM)
                for values in _kinds(own, sizes):
                    found.append(values[_passed(shipped.value, values)])
            values, n = np.unique(np.concatenate(found or [np.empty(0, np.uint64)]), return_counts=True)
            yield pd.DataFrame({"hash": values.view(np.int64), "n": n})

    counts = docs.select(F.col(text).alias("text")).mapInPandas(counted, "hash long, n long")
    return counts.groupBy("hash").agg(F.sum("n").alias("df"))


def candidates(docs: DataFrame, text: str, bits: np.ndarray, sizes: list[int], window: int) -> DataFrame:
    """Add ``n_words``, ``text_key`` and ``found``: the shingles that pass, with the words around them.

    ``found`` has the position, the hash, the words from ``window`` before to ``window`` after, and
    how many of them come before.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf("n_words long, found array<struct<place: int, hash: long, before: int, around: string>>")
    def marked(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for t in texts:
                own = word_hashes((t or "").encode(), ALNUM)
                kinds = [(values, _passed(shipped.value, values)) for values in _kinds(own, sizes)]
                words = alnum_words(t.encode()) if any(len(places) for _, places in kinds) else []
                found = []
                for values, places in kinds:
                    for i in places.tolist():
                        start = max(0, i - window)
                        around = b" ".join(words[start : i + window]).decode()
                        found.append({"place": i, "hash": int(values[i].view(np.int64)), "before": i - start, "around": around})
                rows.append((len(own), found))
            yield pd.DataFrame(rows, columns=["n_words", "found"])

    return docs.withColumn("m", marked.asNondeterministic()(F.col(text)))


def _same_words() -> Column:
    """The words of the window stand in the text where the shingle says."""
    start = F.col("before") - F.col("offset")
    there = F.array_join(F.slice(F.split("around", " "), start + 1, F.col("length")), " ")
    return (start >= 0) & (there == F.col("words"))


def contamination(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = 10,
) -> DataFrame:
    """One row per row of ``docs``: ``key``, ``n_words``, ``n_hit``, ``n_items``, ``items``, ``contaminated``.

    A document word inside any occurrence of an item's window is hit; ``items`` are the item ids with
    occurring windows as sorted strings. Words are runs of ASCII letters, digits and non-ASCII
    characters, with A-Z lower-cased.

    The documents are read twice: once to count the shingles that items have (partial counts
    before the shuffle), once to mark the rarest of each window. Both passes use a bitmap of fixed
    size; all that passes is joined with the items by shingle, whatever its number, and
    confirmed word by word. Common passages give one candidate per place, not pairs of documents.

    Null and empty texts have no words and no hits; such items have no windows. Whole texts are
    used at any length. Equal items each count. Repeated documents get a row each; rows with one key
    and other texts are judged apart. Null item ids are items without a name: they hit, but are not
    listed or counted. Empty tables give an empty result or no hits. Further columns are not read.
    General: the scoring tables of this library hold no prose.
    """
    windows = stored(item_windows(items, item, item_text, window), "item-windows")
    sizes = sorted(min(SHINGLE, r["length"]) for r in windows.select(F.least("length", F.lit(SHINGLE)).alias("length")).distinct().collect())
    base = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    frequencies = shingle_frequencies(base, "text", _bits(windows.select("hash")), sizes)
    distinct = windows.select("words", "length", "offset", "hash").distinct()
    ranked = distinct.join(frequencies, "hash")
    first = F.min(F.struct("df", "hash", "offset")).alias("first")
    # A window with a shingle that no document holds can't occur; it drops out of the count of its shingles.
    whole = F.count(F.lit(1)) == F.first("length") - F.least(F.first("length"), F.lit(SHINGLE)) + 1
    prefix = ranked.groupBy("words").agg(first, F.first("length").alias("length"), whole.alias("whole")).filter("whole")
    prefix = stored(prefix.select("words", "length", "first.hash", "first.offset"), "prefix")
    marked = candidates(base.withColumn("text_key", F.sha2("text", 256)), "text", _bits(prefix.select("hash")), sizes, window)
    rows = stored(marked.select("key", "text_key", "m.n_words", "m.found"), "candidates")
    found = rows.select("key", "text_key", F.inline("found")).join(prefix, "hash")
    start = (F.col("place") - F.col("offset")).alias("start")
    hits = stored(found.filter(_same_words()).select("key", "text_key", start, "length", "words").distinct(), "hits")
    hit = _covered(hits)
    of_item = windows.filter("offset = 0").select("words", F.col("item").cast("string").alias("item")).distinct()
    named = hits.select("key", "text_key", "words").distinct().join(of_item.filter("item is not null"), "words")
    listed = named.select("key", "text_key", "item").distinct().groupBy("key", "text_key").agg(F.sort_array(F.collect_list("item")).alias("items"))
    hit = hit.withColumnsRenamed({"key": "h_key", "text_key": "h_text"})
    listed = listed.withColumnsRenamed({"key": "l_key", "text_key": "l_text"})
    out = rows.drop("found").join(hit, F.col("key").eqNullSafe(F.col("h_key")) & (F.col("text_key") == F.col("h_text")), "left")
    out = out.join(listed, F.col("key").eqNullSafe(F.col("l_key")) & (F.col("text_key") == F.col("l_text")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    listed_items = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        F.col("key").alias(key),
        "n_words",
        n_hit.alias("n_hit"),
        F.size(listed_items).cast("long").alias("n_items"),
        listed_items.alias("items"),
        (n_hit > 0).alias("contaminated"),
    )


def _covered(hits: DataFrame) -> DataFrame:
    """Words inside the windows found, each counted once: the union of intervals per text."""
    spans = hits.groupBy("key", "text_key", "start").agg(F.max("length").alias("length"))
    view = spans.select("key", "text_key", "start", (F.col("start") + F.col("length")).alias("stop"))
    return view.sparkSession.sql(
        """
        SELECT key, text_key, CAST(sum(greatest(0, stop - greatest(start, coalesce(reached, 0)))) AS BIGINT) AS n_hit
        FROM (
          SELECT *, max(stop) OVER (
            PARTITION BY key, text_key ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING
          ) AS reached FROM {view}
        ) GROUP BY key, text_key
        """,
        view=view,
    )


def without_items(docs: DataFrame, items: DataFrame, text: str = "text", **settings) -> DataFrame:
    """The rows of ``docs`` that hold no window of an item; see :func:`contamination`."""
    keyed = docs.withColumn("_text_key", F.sha2(F.coalesce(text, F.lit("")), 256))
    found = contamination(keyed.select("_text_key", text), items, "_text_key", text, **settings)
    return keyed.join(found.filter("contaminated").select("_text_key").distinct(), "_text_key", "left_anti").drop("_text_key")
