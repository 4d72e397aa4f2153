"""Language model with hidden states: Baum-Welch over partitions, exact scaled forward scores.

Observations are the commonest words of the training texts, the end of a text, and one symbol for all
other words, which are then told apart by their smoothed share among those. Every word count behind
a score is exact: common words travel with the model, all others are looked up by a join.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tools import space_words, stored

END = " "
ADD = 0.1
STATES = 6
SYMBOLS = 20_000
# Words that travel with the model; a fixed bound on what is broadcast. All others are joined.
CARRIED = 200_000
STRETCH = 512
HELD = 400_000


class Vocabulary(NamedTuple):
    """Carried words by rank (the end first) with their counts, and the totals over all words.

    The first ``symbols`` words are observations of their own, all others share the next symbol.
    """

    words: list[str]
    counts: np.ndarray
    symbols: int
    tokens: int
    types: int

    def rare(self) -> tuple[int, int]:
        """Tokens and types that share the last symbol."""
        own = self.counts[: self.symbols]
        return self.tokens - int(own.sum()), self.types - int((own > 0).sum())


class HiddenMarkov(NamedTuple):
    """Start, transition and emission probabilities (a row a symbol)."""

    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray


def word_counts(docs: DataFrame, text: str) -> DataFrame:
    """``word``, ``c`` over all texts, ends included; counted per task before the shuffle."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Counter[bytes] = Counter()
        ends = 0
        for batch in batches:
            for t in batch["text"]:
                found.update(space_words((t or "").encode()))
                if len(found) >= HELD:
                    yield pd.DataFrame({"word": [w.decode() for w in found], "n": [*found.values()]})
                    found.clear()
            ends += len(batch)
        found[END.encode()] = ends
        yield pd.DataFrame({"word": [w.decode() for w in found], "n": [*found.values()]})

    counts = docs.select(F.col(text).alias("text")).mapInPandas(counted, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("c")).filter("c > 0")


def vocabulary(counts: DataFrame) -> Vocabulary:
    """The carried words (at most ``CARRIED``) and the totals of a table of counts.

    A histogram of the counts in steps of one per cent (some thousand rows) says from which count on
    the words fit the bound; only those are fetched.
    """
    bucket = F.floor(F.log(F.col("c")) / F.log(F.lit(1.01))).cast("int")
    sizes = counts.groupBy(bucket.alias("b")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()
    least, held = 1 << 30, 1
    for row in sorted(sizes, key=lambda r: -r["b"]):
        held += row["v"]
        if held > CARRIED:
            break
        least = row["b"]
    fetched = counts.filter((bucket >= least) | (F.col("word") == END)).collect()
    known = sorted((r["word"] != END, -r["c"], r["word"]) for r in fetched)
    if not known or known[0][0]:
        known.insert(0, (False, 0, END))
    words = [w for _, _, w in known]
    own = np.array([-c for _, c, _ in known], np.int64)
    return Vocabulary(words, own, min(SYMBOLS, len(words)), sum(r["n"] for r in sizes), sum(r["v"] for r in sizes))


class Reader:
    """Turns texts into ranks of carried words; other words get -1."""

    def __init__(self, vocab: Vocabulary):
        self.rank = {w.encode(): i for i, w in enumerate(vocab.words)}
        self.last = vocab.symbols

    def ranks(self, text: str | None) -> tuple[list[bytes], np.ndarray]:
        """Words, and their ranks with that of the end."""
        words = space_words((text or "").encode())
        ranks = np.fromiter(map(self.rank.get, words, repeat(-1)), np.int32, len(words))
        return words, np.append(ranks, np.int32(0))

    def symbols(self, ranks: np.ndarray) -> np.ndarray:
        return np.where((ranks < 0) | (ranks >= self.last), self.last, ranks)


def _sorted_flat(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sequences by falling length: order, joined values, starts, and how many reach each step."""
    sizes = np.array([len(s) for s in sequences])
    order = np.argsort(-sizes, kind="stable")
    flat = np.concatenate([sequences[i] for i in order])
    sizes = sizes[order]
    starts = np.cumsum(sizes) - sizes
    active = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")
    return order, flat, starts, active


def log_likelihoods(model: HiddenMarkov, sequences: list[np.ndarray]) -> np.ndarray:
    """Natural logarithm of the probability of each whole sequence, by the scaled forward recursion."""
    if not sequences:
        return np.zeros(0)
    order, flat, starts, active = _sorted_flat(sequences)
    found = np.zeros(len(sequences))
    alpha = np.tile(model.start, (len(sequences), 1))
    for t, n in enumerate(active):
        alpha = (alpha[:n] @ model.step if t else alpha) * model.emit[flat[starts[:n] + t]]
        scale = alpha.sum(axis=1)
        alpha /= scale[:, None]
        found[:n] += np.log(scale)
    out = np.empty(len(sequences))
    out[order] = found
    return out


class Expected:
    """Expected counts of starts, transitions and emissions, summed over sequences."""

    def __init__(self, model: HiddenMarkov):
        self.model = model
        n = len(model.start)
        self.start, self.step, self.emit = np.zeros(n), np.zeros((n, n)), np.zeros(model.emit.shape)
        occupied = np.full(n, 1 / n)
        for _ in range(50):
            occupied = occupied @ model.step
        self.middle = occupied

    def add(self, sequences: list[np.ndarray], opening: list[bool]) -> None:
        """Forward and backward recursion over stretches; only the opening ones count as starts."""
        if not sequences:
            return
        order, flat, starts, active = _sorted_flat(sequences)
        first = np.array(opening)[order]
        n_states = len(self.start)
        alpha = np.where(first[:, None], self.model.start, self.middle)
        alphas, emitted, scales = [], [], []
        for t, n in enumerate(active):
            emission = self.model.emit[flat[starts[:n] + t]]
            alpha = (alpha[:n] @ self.model.step if t else alpha) * emission
            scale = alpha.sum(axis=1, keepdims=True)
            alpha = alpha / scale
            alphas.append(alpha)
            emitted.append(emission)
            scales.append(scale)
        shares = np.empty((len(flat), n_states))
        beta = np.ones((active[-1], n_states))
        for t in range(len(active) - 1, -1, -1):
            n = active[t]
            if len(beta) < n:
                beta = np.concatenate([beta, np.ones((n - len(beta), n_states))])
            shares[starts[:n] + t] = alphas[t] * beta
            if t:
                ahead = emitted[t] * beta / scales[t]
                self.step += self.model.step * (alphas[t - 1][:n].T @ ahead)
                beta = ahead @ self.model.step.T
        for state in range(n_states):
            self.emit[:, state] += np.bincount(flat, shares[:, state], len(self.emit))
        self.start += shares[starts[first]].sum(axis=0)

    def rows(self) -> pd.DataFrame:
        """All counts as (place, value); places run over starts, transitions and emissions."""
        values = np.concatenate([self.start, self.step.ravel(), self.emit.ravel()])
        places = np.flatnonzero(values)
        return pd.DataFrame({"place": places, "value": values[places]})


def stretches(symbols: np.ndarray) -> tuple[list[np.ndarray], list[bool]]:
    """A sequence cut for training into parts of at most ``STRETCH`` symbols; the first one opens it."""
    parts = [symbols[i : i + STRETCH] for i in range(0, len(symbols), STRETCH)]
    return parts, [i == 0 for i in range(len(parts))]


def improved(values: np.ndarray, shares: np.ndarray, states: int) -> HiddenMarkov:
    """M-step with a little smoothing: every state can emit every symbol and reach every state."""
    start = values[:states] + ADD
    step = values[states : states + states * states].reshape(states, states) + ADD
    emit = values[states + states * states :].reshape(-1, states) + 20 * shares[:, None]
    return HiddenMarkov(start / start.sum(), step / step.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def symbol_shares(vocab: Vocabulary) -> np.ndarray:
    """Smoothed share of each symbol among the training tokens."""
    counts = np.append(vocab.counts[: vocab.symbols], vocab.rare()[0]) + ADD
    return counts / counts.sum()


def first_model(sample: list[str], vocab: Vocabulary, rounds: int = 12, states: int = STATES) -> HiddenMarkov:
    """A starting point from a bounded sample: random emissions, then a few rounds on the driver."""
    shares = symbol_shares(vocab)
    rng = np.random.default_rng(7)
    emit = shares[:, None] * rng.uniform(0.2, 1.8, (len(shares), states))
    step = np.full((states, states), 0.2 / states) + 0.8 * np.eye(states)
    model = HiddenMarkov(np.full(states, 1 / states), step, emit / emit.sum(axis=0))
    reader = Reader(vocab)
    parts: list[np.ndarray] = []
    opening: list[bool] = []
    for t in sample:
        own, first = stretches(reader.symbols(reader.ranks(t)[1]))
        parts += own
        opening += first
    for _ in range(rounds if parts else 0):
        expected = Expected(model)
        expected.add(parts, opening)
        model = improved(np.concatenate([expected.start, expected.step.ravel(), expected.emit.ravel()]), shares, states)
    return model


def baum_welch(docs: DataFrame, text: str, model: HiddenMarkov, vocab: Vocabulary) -> HiddenMarkov:
    """One round over all training texts: expected counts per task, summed by place, then the M-step.

    A task holds one array of states x symbols and about a million tokens at a time. What comes
    back to the driver is one number for each entry of the model.
    """
    shipped = docs.sparkSession.sparkContext.broadcast((model, vocab))

    def expected(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, words = shipped.value
        reader, counts = Reader(words), Expected(own)
        waiting: list[np.ndarray] = []
        opening: list[bool] = []
        size = 0
        for batch in batches:
            for t in batch["text"]:
                parts, first = stretches(reader.symbols(reader.ranks(t)[1]))
                while parts:
                    waiting.append(parts.pop())
                    opening.append(first.pop())
                    size += len(waiting[-1])
                    if size >= 250_000:
                        counts.add(waiting, opening)
                        waiting, opening, size = [], [], 0
        counts.add(waiting, opening)
        yield counts.rows()

    rows = docs.select(F.col(text).alias("text")).mapInPandas(expected, "place long, value double")
    summed = rows.groupBy("place").agg(F.sum("value").alias("value")).toPandas()
    states = len(model.start)
    values = np.zeros(states + states * states + model.emit.size)
    values[summed["place"].to_numpy(np.int64)] = summed["value"].to_numpy()
    return improved(values, symbol_shares(vocab), states)


def fit(docs: DataFrame, key: str, text: str, vocab: Vocabulary, rounds: int, sample: int, characters: int) -> HiddenMarkov:
    """Starting point from at most ``sample`` texts of at most ``characters``, then rounds over all."""
    order = [F.xxhash64(F.col(key).cast("string")), F.col(key)]
    chosen = docs.filter(F.length(text) <= characters).orderBy(*order).select(text).limit(sample).collect()
    model = first_model([r[0] for r in chosen], vocab)
    for _ in range(rounds):
        model = baum_welch(docs, text, model, vocab)
    return model


def score(docs: DataFrame, model: HiddenMarkov, vocab: Vocabulary, counts: DataFrame, text: str) -> DataFrame:
    """``docs`` without ``text``, with token counts, ``base_score`` and ``score`` (log10)."""
    shipped = docs.sparkSession.sparkContext.broadcast((model, vocab))
    base_sum = float(vocab.tokens + ADD * (vocab.types + 1))
    rare_tokens, rare_types = vocab.rare()
    rare_sum = float(rare_tokens + ADD * (rare_types + 1))

    @F.pandas_udf("n_tokens long, n_known long, base double, found double, rest string")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own, words = shipped.value
        reader = Reader(words)
        known = words.counts > 0
        base_logs = np.log10((words.counts + ADD) / base_sum)
        rare_logs = np.log10((words.counts + ADD) / rare_sum)
        rare_logs[: reader.last] = 0.0
        for texts in batches:
            rows, done = [], []
            waiting: list[np.ndarray] = []
            size = 0
            for t in texts:
                found, ranks = reader.ranks(t)
                carried = ranks[ranks >= 0]
                rest = b" ".join([found[i] for i in np.flatnonzero(ranks < 0).tolist()]).decode()
                rows.append((len(ranks), int(known[carried].sum()), base_logs[carried].sum(), rare_logs[carried].sum(), rest or None))
                waiting.append(reader.symbols(ranks))
                size += len(ranks)
                if size >= 2_000_000:
                    done.append(log_likelihoods(own, waiting))
                    waiting, size = [], 0
            done.append(log_likelihoods(own, waiting))
            out = pd.DataFrame(rows, columns=["n_tokens", "n_known", "base", "found", "rest"])
            out["found"] += np.concatenate(done) / np.log(10)
            yield out

    kept = [c for c in docs.columns if c != text]
    made = docs.select(F.struct(*kept).alias("_row"), F.monotonically_increasing_id().alias("_id"), F.col(text).alias("_text"))
    made = made.withColumn("_s", scored.asNondeterministic()("_text")).select("_row", "_id", "_s.*")
    rows = stored(made, "scored")
    rest = rows.filter("rest IS NOT NULL").select("_id", F.explode(F.split("rest", " ")).alias("word"))
    c = F.coalesce(F.col("c"), F.lit(0))
    looked_up = rest.join(counts, "word", "left").groupBy("_id").agg(
        F.sum((c > 0).cast("long")).alias("r_known"),
        F.sum(F.log10((c + ADD) / base_sum)).alias("r_base"),
        F.sum(F.log10((c + ADD) / rare_sum)).alias("r_score"),
    )
    out = rows.drop("rest").join(looked_up, "_id", "left")
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return out.select(
        *[F.col("_row")[x].alias(x) for x in kept],
        "n_tokens",
        plus("n_known", "r_known").alias("n_known"),
        F.lit(vocab.tokens).cast("long").alias("train_tokens"),
        plus("base", "r_base").alias("base_score"),
        plus("found", "r_score").alias("score"),
    )


def language_model(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    train: Column | None = None,
    rounds: int = 2,
    sample: int = 600,
    characters: int = 20000,
) -> DataFrame:
    """Train on the rows of ``docs`` that ``train`` selects and score every row.

    Returns the columns of ``docs`` except ``text``, with ``n_tokens`` (words and one end), ``n_known``
    (tokens seen in training), ``train_tokens``, ``base_score`` (add-0.1 unigram) and ``score`` (log10
    probability under the hidden Markov model); columns of ``docs`` with these names are replaced.

    Word counts and the expected counts of every round cover all training texts. The starting
    point is fitted on at most ``sample`` texts of at most ``characters``. The 200,000 commonest words
    travel with the model; the other words of a text are joined with the full count table, so no
    table that grows with the corpus is broadcast or collected. Common words never reach the
    join, so no word is a hot key.

    Null and empty texts are one end token. Whole texts are scored; for training they are cut into
    stretches of 512 tokens. Repeated rows are scored each. Without training rows
    the base score is 0 and the model knows two symbols, the end and any word, of one half each. An empty table gives an empty table. General: the scoring tables of this
    library hold no prose.
    """
    made = {"n_tokens", "n_known", "train_tokens", "base_score", "score"} - {text}
    base = docs.drop(*[c for c in docs.columns if c in made and c != key])
    chosen = (docs if train is None else docs.filter(train)).select(key, text)
    counts = stored(word_counts(chosen, text), "word-counts")
    vocab = vocabulary(counts)
    model = fit(chosen, key, text, vocab, rounds, sample, characters)
    return score(base, model, vocab, counts, text)
