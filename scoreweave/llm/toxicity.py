"""Toxicity by multiple-instance learning: sentences are scored, documents carry the labels.

A sentence has the probability ``sigmoid(bias + sum of word weights)``; a document is toxic unless
none of its sentences is (noisy-or). Bias and weights are trained from document labels alone, with
a sparsity penalty, and then point at the sentences that made a document toxic.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tools import fresh

# Word characters are letters, digits and all beyond ASCII; sentences end at . ! ? or a line end.
WORD_OR_STOP = re.compile("[0-9a-z\u0080-\U0010ffff]+|[.!?\n]")
SENTENCE = re.compile("[^.!?\n]*[0-9A-Za-z\u0080-\U0010ffff][^.!?\n]*")
STOPS = frozenset(".!?\n")
PREFIXES = (4, 5, 6, 7)
START = -7.0
HELD_WORDS = 300_000


class ToxicityModel(NamedTuple):
    """Weights of words and word beginnings (with a trailing ``*``), and the bias of a sentence."""

    weights: dict[str, float]
    bias: float
    rows: int


def tokens(text: str) -> list[str]:
    """Lower-cased words of a text and its sentence ends."""
    return WORD_OR_STOP.findall(text.lower())


def traits(word: str) -> list[str]:
    """What a word is known by: itself and its first 4 to 7 characters."""
    return [word, *[word[:n] + "*" for n in PREFIXES if len(word) > n]]


def sentence_numbers(found: list[str]) -> tuple[list[str], np.ndarray]:
    """The words without stops and, for each, the number of its sentence (sentences have words)."""
    stops = np.fromiter(map(STOPS.__contains__, found), bool, len(found))
    _, number = np.unique(np.cumsum(stops)[~stops], return_inverse=True)
    return [w for w in found if w not in STOPS], number


def training_sample(
    docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, train: Column, rows: int, characters: int
) -> DataFrame:
    """At most ``rows`` labelled documents of each class, in the order of a hash of the key.

    Only these keys are broadcast (twice ``rows`` at most). Of rows that repeat a key one text, the first in
    order, is taken, and a label that repeats counts once. Texts over ``characters`` are not trained on; they are
    scored like all others.
    """
    usable = labels.select(F.col(key).alias("_k"), F.col(label).cast("int").alias("_y")).distinct()
    order = [F.xxhash64(F.col("_k").cast("string")), F.col("_k"), F.col("_y")]
    parts = [usable.filter((F.col("_y") == y) & F.col("_k").isNotNull() & train).orderBy(*order).limit(rows) for y in (0, 1)]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))
    found = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t")).filter(F.length("_t") <= characters)
    return found.join(chosen, "_k").groupBy("_k", "_y").agg(F.min("_t").alias("_t")).select("_t", "_y")


def fit(sample: DataFrame, min_documents: int = 4, steps: int = 200, rate: float = 0.15, sparsity: float = 3e-4) -> ToxicityModel:
    """Train on a bounded sample (see :func:`training_sample`); without both classes no word counts."""
    rows = sample.toPandas().sort_values(["_y", "_t"], ignore_index=True)
    y = rows["_y"].to_numpy()
    if len(set(y)) < 2:
        return ToxicityModel({}, START, len(rows))
    parts = [sentence_numbers(tokens(t)) for t in rows["_t"]]
    seen = Counter(x for words, _ in parts for x in {x for w in set(words) for x in traits(w)})
    place = {x: i for i, x in enumerate(sorted(x for x, n in seen.items() if n >= min_documents))}
    vocabulary = {w: i for i, w in enumerate(sorted({w for words, _ in parts for w in words}))}
    pairs = [(i, place[x]) for w, i in vocabulary.items() for x in traits(w) if x in place]
    of_word, trait = np.array(pairs, np.int64).reshape(-1, 2).T
    words, sentences, owner, offset = [], [], [], 0
    for i, (own, number) in enumerate(parts):
        words.append(np.fromiter(map(vocabulary.__getitem__, own), np.int64, len(own)))
        sentences.append(number + offset)
        n = int(number.max()) + 1 if len(number) else 0
        owner.append(np.full(n, i))
        offset += n
    word, sentence, document = (np.concatenate(x) for x in (words, sentences, owner))
    design = (word, sentence, document, of_word, trait)
    weights, bias = _trained(*design, y, len(vocabulary), len(place), steps, rate, sparsity)
    return ToxicityModel({x: float(weights[i]) for x, i in place.items() if weights[i]}, bias, len(rows))


def _trained(word, sentence, document, of_word, trait, y, n_words, n_traits, steps, rate, sparsity) -> tuple[np.ndarray, float]:
    """Proximal Adam on the likelihood of the labels under noisy-or."""
    value = np.zeros(n_traits + 1)
    value[-1] = START
    mean, square = np.zeros_like(value), np.zeros_like(value)
    balance = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    for step in range(1, steps + 1):
        of_words = np.bincount(of_word, value[trait], n_words)
        z = np.bincount(sentence, of_words[word], len(document)) + value[-1]
        total = np.bincount(document, np.logaddexp(0, z), len(y))
        slope = np.where(y == 1, -1 / np.expm1(np.clip(total, 1e-9, 50)), 1.0) * balance
        by_sentence = slope[document] / (1 + np.exp(-np.clip(z, -50, 50)))
        by_word = np.bincount(word, by_sentence[sentence], n_words)
        gradient = np.append(np.bincount(trait, by_word[of_word], n_traits), by_sentence.sum())
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient**2
        scale = rate / (np.sqrt(square / (1 - 0.99**step)) + 1e-5)
        value -= scale * mean / (1 - 0.9**step)
        value[:-1] = np.sign(value[:-1]) * np.maximum(0, np.abs(value[:-1]) - scale[:-1] * sparsity)
        value[-1] = min(value[-1], -4.0)
    return value[:-1], float(value[-1])


class WordWeights(dict):
    """Sum of the weights of a word; not a number for a stop. Emptied when it is large."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        value = float("nan") if word in STOPS else sum(self.weights.get(x, 0.0) for x in traits(word))
        if len(word) <= 32:
            if len(self) >= HELD_WORDS:
                self.clear()
            self[word] = value
        return value


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", limit: float = 0.7, prefix: str = "") -> DataFrame:
    """``docs`` with ``score``, ``predicted``, ``n_sentences`` and ``offending`` (names behind ``prefix``).

    ``offending`` lists the sentences with a probability of a half or more: number, first and last
    character (exclusive) and probability. One pass without a shuffle; the model is broadcast, its
    size is bounded by the training sample.

    Null and empty texts have no sentence and score 0. Texts are read whole. Repeated rows are
    scored each, empty tables stay empty, further columns pass through (those with the names of results
    are replaced). General: the scoring tables of this library hold no prose.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    names = ["score", "n_sentences", "offending"]

    @F.pandas_udf("score double, n_sentences long, offending array<struct<sentence: int, start: int, stop: int, score: double>>")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shipped.value
        weight_of = WordWeights(own.weights)
        for texts in batches:
            rows = []
            for t in texts:
                found = tokens(t or "")
                weights = np.fromiter(map(weight_of.__getitem__, found), np.float64, len(found))
                stops = np.isnan(weights)
                number = np.cumsum(stops)[~stops]
                if not len(number):
                    rows.append((0.0, 0, []))
                    continue
                first = np.flatnonzero(np.diff(number, prepend=-1))
                z = np.add.reduceat(weights[~stops], first) + own.bias
                total = float(np.logaddexp(0, z).sum())
                bad = np.flatnonzero(z >= 0)
                spans = [m.span() for m in SENTENCE.finditer(t)] if len(bad) else []
                places = [(int(i), *spans[i], float(1 / (1 + np.exp(-z[i])))) for i in bad]
                places = [dict(zip(("sentence", "start", "stop", "score"), p, strict=True)) for p in places]
                rows.append((float(-np.expm1(-total)), len(z), places))
            yield pd.DataFrame(rows, columns=names)

    packed = fresh("_toxicity", docs)
    out = docs.withColumn(packed, scored.asNondeterministic()(F.col(text)))
    out = out.withColumns({prefix + n: F.col(packed)[n] for n in names}).drop(packed)
    return out.withColumn(f"{prefix}predicted", (F.col(f"{prefix}score") >= limit).cast("int"))


def detect(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    train: Column | None = None,
    rows: int = 1500,
    characters: int = 10000,
    prefix: str = "",
) -> DataFrame:
    """Train on labelled documents and score every row of ``docs``; see :func:`score`.

    ``train`` is a condition on ``_k``, the key of a labelled row. At most ``rows`` of each class
    with at most ``characters`` are used for the fit. Labels without a document, and null labels or
    keys, are left out.
    """
    sample = training_sample(docs, labels, key, text, label, F.lit(True) if train is None else train, rows, characters)
    return score(docs, fit(sample), text, prefix=prefix)
