"""Language identification by prediction by partial matching over bytes.

Each language has a variable-order context tree: how often a byte followed the 0 to 3 bytes before
it, within a word and the spaces around it. A byte that a context has not seen costs an escape and is
sought in the next shorter one, down to a uniform byte. Statistics are frozen after training; the
language with the shortest exact code length of the whole text wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tools import fresh

ORDER = 3
UNKNOWN = "und"
LANGUAGES = 1000
BLOCK = 1 << 20
HELD_WORDS = 300_000


class ContextTrees(NamedTuple):
    """Frozen code lengths in bits, by order: n-grams and contexts (sorted), a column a language."""

    languages: list[str]
    grams: list[np.ndarray]
    costs: list[np.ndarray]
    contexts: list[np.ndarray]
    escapes: list[np.ndarray]


def word_bytes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the words with a space before and after each, place in the word, number of the word."""
    data = np.frombuffer(b"".join([b" %b " % w for w in words]), np.uint8)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    number = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(data)) - (np.cumsum(sizes) - sizes)[number]
    return data, place, number


def packed_grams(data: np.ndarray, order: int) -> np.ndarray:
    """The last ``order`` + 1 bytes at each place as one number."""
    out = np.zeros(len(data), np.uint32)
    for back in range(order, -1, -1):
        out = (out << np.uint32(8)) | np.concatenate([np.zeros(min(back, len(data)), np.uint32), data[: max(0, len(data) - back)].astype(np.uint32)])
    return out


def gram_counts(rows: DataFrame, lang: str, text: str) -> DataFrame:
    """``lang``, ``size`` (bytes of context), ``gram``, ``n``: summed per batch, then over all."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, part in batch.groupby("lang"):
                words = [w for t in part["text"] for w in t.encode().split()]
                data, place, _ = word_bytes(words)
                for order in range(ORDER + 1):
                    grams, n = np.unique(packed_grams(data, order)[place > max(0, order - 1)], return_counts=True)
                    yield pd.DataFrame({"lang": name, "size": order, "gram": grams.astype(np.int64), "n": n})

    counts = rows.select(F.col(lang).alias("lang"), F.col(text).alias("text")).mapInPandas(counted, "lang string, size int, gram long, n long")
    return counts.groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))


def training_sample(
    docs: DataFrame, key: str, text: str, lang: str, train: Column, rows: int, characters: int, languages: int = LANGUAGES
) -> DataFrame:
    """About ``rows`` labelled rows a language, chosen by a hash of key and text; shorter than ``characters``.

    Repeated rows are one, and a key that repeats with other texts has a hash for each. More than
    ``languages`` languages are an error (ValueError), none is left out.
    """
    usable = docs.filter(train & F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.length(text) <= characters))
    sizes = usable.groupBy(F.col(lang).alias("_l")).agg(F.count(F.lit(1)).alias("_n"))
    counted = sizes.limit(languages + 1).collect()
    if len(counted) > languages:
        raise ValueError(f"more than {languages} languages: raise the bound `languages` or merge labels")
    sizes = F.broadcast(docs.sparkSession.createDataFrame([(r["_l"], r["_n"]) for r in counted], "_l string, _n long"))
    mark = F.xxhash64(F.col(key).cast("string"), F.col(text))
    share = F.pmod(mark, F.lit(1 << 30)) / float(1 << 30)
    chosen = usable.select(mark.alias("_mark"), share.alias("_share"), F.col(lang).alias("_l"), F.col(text).alias("_t")).join(sizes, "_l")
    return chosen.filter(F.col("_share") * F.col("_n") < rows).dropDuplicates(["_mark", "_l"]).select(F.col("_l").alias("lang"), F.col("_t").alias("text"))


def fit(sample: DataFrame) -> ContextTrees:
    """Context trees of a sample of ``lang``, ``text``; their size is bounded by that of the sample."""
    counts = gram_counts(sample, "lang", "text").toPandas()
    languages = sorted(counts["lang"].unique())
    column = counts["lang"].map({name: i for i, name in enumerate(languages)}).to_numpy(dtype=np.int64, na_value=0)
    trees = ContextTrees(languages, [], [], [], [])
    for order in range(ORDER + 1):
        own = (counts["size"] == order).to_numpy()
        grams, place = np.unique(counts["gram"].to_numpy()[own].astype(np.uint32), return_inverse=True)
        seen = np.zeros((len(grams), len(languages)))
        seen[place, column[own]] = counts["n"].to_numpy()[own]
        contexts, parent = np.unique(grams >> np.uint32(8), return_inverse=True)
        total = np.zeros((len(contexts), len(languages)))
        distinct = np.zeros_like(total)
        np.add.at(total, parent, seen)
        np.add.at(distinct, parent, seen > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            escape = np.where(total > 0, np.log2(total + distinct) - np.log2(distinct), 0.0)
            coded = np.log2(total + distinct)[parent] - np.log2(seen)
        if order:
            suffix = grams & np.uint32((1 << (8 * order)) - 1)
            shorter = trees.costs[-1][np.searchsorted(trees.grams[-1], suffix)]
        else:
            shorter = np.full((len(grams), len(languages)), 8.0)
        trees.grams.append(grams)
        trees.costs.append(np.where(seen > 0, coded, escape[parent] + shorter))
        trees.contexts.append(contexts)
        trees.escapes.append(escape)
    return trees


def code_lengths(trees: ContextTrees, words: list[bytes]) -> np.ndarray:
    """Bits of each word and the space after it, a column a language."""
    data, place, number = word_bytes(words)
    bits = np.zeros((len(data), len(trees.languages)))
    open_places = np.flatnonzero(place > 0)
    for order in range(ORDER, -1, -1):
        tried = open_places[place[open_places] >= order]
        if not len(tried) or not len(trees.grams[order]):
            continue
        grams = packed_grams(data, order)[tried]
        at = np.minimum(np.searchsorted(trees.grams[order], grams), len(trees.grams[order]) - 1)
        hit = trees.grams[order][at] == grams
        bits[tried[hit]] += trees.costs[order][at[hit]]
        missed, contexts = tried[~hit], grams[~hit] >> np.uint32(8)
        at = np.minimum(np.searchsorted(trees.contexts[order], contexts), len(trees.contexts[order]) - 1)
        known = trees.contexts[order][at] == contexts
        bits[missed[known]] += trees.escapes[order][at[known]]
        open_places = np.setdiff1d(open_places, tried[hit], assume_unique=True)
    bits[open_places] += 8.0
    out = np.zeros((len(words), len(trees.languages)))
    np.add.at(out, number, bits)
    return out


class WordCosts(dict):
    """Number of each word met; its code lengths are computed once for a block of texts."""

    def __init__(self, trees: ContextTrees):
        super().__init__()
        self.trees, self.new = trees, []
        self.bits = np.zeros((0, len(trees.languages)))

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        self.new.append(word)
        return number

    def numbers(self, text: bytes) -> np.ndarray:
        words = text.split()
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def table(self) -> np.ndarray:
        if self.new:
            self.bits = np.concatenate([self.bits, code_lengths(self.trees, self.new)])
            self.new = []
        return self.bits

    def shrink(self) -> None:
        if len(self) > HELD_WORDS:
            self.clear()
            self.bits = self.bits[:0]


def identify(docs: DataFrame, trees: ContextTrees, text: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``bits`` (names behind ``prefix``).

    ``score`` is the share of the winner if each language has the weight 2^-bits of its code;
    ``bits`` is the code length of the winner. Ties go to the first language in sorted order. One pass without a
    shuffle; the trees are broadcast.

    Null texts, texts without a letter, and all texts if no language was learned, are ``und`` with
    score 0. Whole texts are coded. Repeated rows are judged each, empty tables stay empty, further columns pass
    through (those with the names of results are replaced). General: the scoring tables of this
    library hold no prose.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(trees)
    names = ["lang_pred", "score", "bits"]

    @F.pandas_udf("lang_pred string, score double, bits double")
    def identified(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shipped.value
        costs = WordCosts(own)

        def judged(waiting: list[np.ndarray | None]) -> Iterator[tuple]:
            table = costs.table()
            for numbers in waiting:
                if numbers is None or not own.languages:
                    yield UNKNOWN, 0.0, 0.0
                    continue
                bits = table[numbers].sum(axis=0)
                best = int(bits.argmin())
                yield own.languages[best], float(1 / np.exp2(bits[best] - bits).sum()), float(bits[best])
            costs.shrink()

        for texts in batches:
            rows, waiting, size = [], [], 0
            for t in texts:
                waiting.append(costs.numbers(t.encode()) if t and any(map(str.isalpha, t)) else None)
                size += len(t or "")
                if size >= BLOCK:
                    rows += judged(waiting)
                    waiting, size = [], 0
            rows += judged(waiting)
            yield pd.DataFrame(rows, columns=names)

    packed = fresh("_language", docs)
    out = docs.withColumn(packed, identified.asNondeterministic()(F.col(text)))
    return out.withColumns({prefix + n: F.col(packed)[n] for n in names}).drop(packed)


def detect(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    train: Column | None = None,
    rows: int = 1000,
    characters: int = 20000,
    prefix: str = "",
) -> DataFrame:
    """Learn from the labelled rows of ``docs`` and identify every row; see :func:`identify`.

    ``train`` is a condition on the rows to learn from. About ``rows`` of each language with at
    most ``characters`` are used for the fit. Null languages are not learned; more than 1,000 languages
    are an error.
    """
    sample = training_sample(docs, key, text, lang, F.lit(True) if train is None else train, rows, characters)
    return identify(docs, fit(sample), text, prefix=prefix)
