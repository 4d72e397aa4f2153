"""Quality rules with limits learned per language and source from mergeable quantile sketches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tools import stored

GAP = r"[\x20\x09-\x0D]+"
WINDOW = 8
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

# Relative width of the sketch buckets (values are right to about 1 %), the bucket of zero, the distance
# of the fences from the outer deciles in ranges between them, and the values a limit needs.
GAMMA = 1.02
ZERO = -(1 << 20)
FENCE = 1.5
MIN_ROWS = 100

# Ratio of each metric.
METRICS = {
    "symbols": "n_symbols / word_chars",
    "dup_lines": "n_dup_lines / n_lines",
    "repeats": "n_repeat_words / n_words",
    "word_length": "word_chars / n_words",
}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with ``value`` evaluated once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _covered(hashes: Column) -> Column:
    """Positions inside windows whose hash occurs twice or more; ``hashes`` are those of all windows."""

    def joined(order: Column) -> Column:
        twin = lambda e, k: F.get(order, k - 1)["h"].eqNullSafe(e["h"]) | F.get(order, k + 1)["h"].eqNullSafe(e["h"])
        starts = F.array_sort(F.transform(F.filter(order, twin), lambda e: e["i"]))
        step = lambda x, k, all_: F.when(k == 0, WINDOW).otherwise(F.least(F.lit(WINDOW), x - F.get(all_, k - 1)))
        return let(
            starts,
            lambda s: F.aggregate(F.transform(s, lambda x, k: step(x, k, s)), F.lit(0), lambda a, x: a + x),
        )

    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(ordered, joined))


def _repeated(words: Column) -> Column:
    n = F.size(words)
    hashes = let(
        F.transform(words, lambda w: F.xxhash64(w)),
        lambda h: F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(h, i, WINDOW))),
    )
    return F.when(n <= WINDOW, F.lit(0)).otherwise(let(hashes, _covered))


def text_metrics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``n_words``, ``word_chars``, ``n_symbols``, ``n_lines``, ``n_dup_lines``, ``n_repeat_words``.

    One projection of built-in functions without a shuffle. Windows of eight words are compared by
    64-bit hashes inside their text.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    words = F.array_remove(F.split(whole, GAP), "")
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    symbols = F.length(whole) - F.length(F.regexp_replace(whole, r"[#*$%&|<>]", ""))
    of_words = let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _repeated(w).cast("long").alias("n_repeat_words"),
        ),
    )
    of_lines = let(
        lines,
        lambda x: F.struct(
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        ),
    )
    return docs.withColumns({"_words": of_words, "_lines": of_lines, "n_symbols": symbols.cast("long")}).select(
        *[F.col(c) for c in docs.columns if c not in (*BASE, "n_lines")],
        "_words.n_words",
        "_words.word_chars",
        "n_symbols",
        "_lines.n_lines",
        "_lines.n_dup_lines",
        "_words.n_repeat_words",
    )


def sketch(rows: DataFrame, groups: tuple[str, ...]) -> DataFrame:
    """Quantile sketch of each metric per group: counts of logarithmic buckets, zero in its own.

    Bucket ``b`` holds values in (GAMMA^(b-1), GAMMA^b]. Sketches merge by adding counts; a sketch
    has some thousand buckets at most, whatever the number of rows.
    """
    values = F.array(*[F.struct(F.lit(m).alias("metric"), F.expr(ratio).alias("x")) for m, ratio in METRICS.items()])
    bucket = F.when(F.col("x") > 0, F.ceil(F.log(F.col("x")) / F.log(F.lit(GAMMA)))).otherwise(F.lit(ZERO))
    return (
        rows.select(*groups, F.inline(values))
        .select(*groups, "metric", bucket.cast("long").alias("bucket"))
        .groupBy(*groups, "metric", "bucket")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def limits(sketches: DataFrame, lang: str, source: str) -> DataFrame:
    """Fences ``low_*`` and ``high_*`` of each (language, source); ``basis_*`` is how many values made the group's own.

    A fence stands 1.5 ranges between the outer deciles beyond them. Where most values of a metric are zero, the
    deciles are those of its other values and zero is always within the limits. A group with
    under 100 such values takes the limits of its language, or else of all rows; the eight fences over all
    rows are the only values that reach the driver. A metric without any value but zero has no limit.
    """
    view = stored(sketches, "quality-sketches").withColumnsRenamed({lang: "g_lang", source: "g_source"})
    merged = view.sparkSession.sql(
        f"""
        WITH merged AS (
          SELECT metric, bucket, g_lang, g_source, 2 * grouping(g_lang) + grouping(g_source) AS level, sum(n) AS n
          FROM {{view}}
          GROUP BY GROUPING SETS ((metric, bucket, g_lang, g_source), (metric, bucket, g_lang), (metric, bucket))
        ), counted AS (
          SELECT *, 2 * sum(CASE WHEN bucket = {ZERO} THEN n ELSE 0 END) OVER (PARTITION BY level, g_lang, g_source, metric)
            > sum(n) OVER (PARTITION BY level, g_lang, g_source, metric) AS sparse
          FROM merged
        ), summed AS (
          SELECT *,
            sum(n) OVER (PARTITION BY level, g_lang, g_source, metric ORDER BY bucket) AS upto,
            sum(n) OVER (PARTITION BY level, g_lang, g_source, metric) AS total
          FROM counted WHERE bucket > {ZERO} OR NOT sparse
        )
        SELECT level, g_lang, g_source, metric, sparse, max(total) AS total,
          min(CASE WHEN 10 * upto >= total THEN bucket END) AS b1,
          min(CASE WHEN 10 * upto >= 9 * total THEN bucket END) AS b9
        FROM summed GROUP BY level, g_lang, g_source, metric, sparse
        """,
        view=view,
    )
    value = lambda b: F.when(F.col(b) > ZERO, 2 * F.pow(F.lit(GAMMA), F.col(b)) / (1 + GAMMA)).otherwise(F.lit(0.0))
    spread = FENCE * (value("b9") - value("b1"))
    low = F.when(F.col("sparse"), F.lit(0.0)).otherwise(value("b1") - spread)
    fences = merged.select("level", "g_lang", "g_source", "metric", F.col("total").alias("basis"), low.alias("low"), (value("b9") + spread).alias("high"))
    names = [f"{side}_{m}" for m in METRICS for side in ("basis", "low", "high")]
    wide = fences.groupBy("level", "g_lang", "g_source").agg(
        *[F.max(F.when(F.col("metric") == m, F.col(side))).alias(f"{side}_{m}") for m in METRICS for side in ("basis", "low", "high")],
    )
    own = wide.filter("level = 0").drop("level")
    by_lang = wide.filter("level = 1").select(F.col("g_lang").alias("l_lang"), *[F.col(n).alias(f"l_{n}") for n in names])
    overall = wide.filter("level = 3").select(*names).first() or dict.fromkeys(names)
    joined = own.join(by_lang, F.col("g_lang").eqNullSafe(F.col("l_lang")))

    def choose(side: str, m: str) -> Column:
        n, basis = f"{side}_{m}", f"basis_{m}"
        found = F.when(F.col(basis) >= MIN_ROWS, F.col(n)).when(F.col(f"l_{basis}") >= MIN_ROWS, F.col(f"l_{n}"))
        return found.otherwise(F.lit(overall[n]).cast("double")).alias(n)

    return joined.select(
        "g_lang", "g_source", *[F.coalesce(f"basis_{m}", F.lit(0)).alias(f"basis_{m}") for m in METRICS],
        *[choose(side, m) for m in METRICS for side in ("low", "high")],
    )


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Judge every row of ``docs``: base rule first, then the learned limits of its group.

    Returns the columns of ``docs`` except ``text``, with the metrics of :func:`text_metrics`,
    ``base_failed`` (fewer than 20 words, or over 30 % of the words in repeated windows),
    ``failed_rules`` (names of the limits broken) and ``kept``. Columns of ``docs`` with these names are
    replaced.

    The texts are read once: the metrics are written as a narrow table, sketched per language and
    source, and joined with the limits. Sketch rows combine before their shuffle, so a source with
    a third of all rows costs no more than another. Every limit comes from a sketch (:func:`limits`):
    there is no fixed cutoff beside the base rule.

    Null and empty texts have no words: ``base_failed``, not kept. Texts are measured whole. Null
    languages and sources are groups of their own. Repeated rows count and are judged each. An empty
    table gives an empty table. General: the scoring tables of this library hold no prose.
    """
    made = {*BASE, "n_lines", "base_failed", "failed_rules", "kept", text}
    rest = [c for c in docs.columns if c not in made]
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    packed = docs.select(
        F.struct(*rest).alias("_row"), F.col(text).alias("_text"), F.col(lang).alias("_lang"), F.col(source).alias("_source")
    )
    rows = stored(text_metrics(packed, "_text").drop("_text").withColumn("base_failed", failed), "quality-metrics")
    fences = limits(sketch(rows.filter(~F.col("base_failed")), ("_lang", "_source")), "_lang", "_source")
    joined = rows.join(fences, F.col("_lang").eqNullSafe(F.col("g_lang")) & F.col("_source").eqNullSafe(F.col("g_source")), "left")
    joined = joined.withColumns({f"x_{m}": F.expr(f"try_divide({ratio.replace(' / ', ', ')})") for m, ratio in METRICS.items()})
    broken = F.array_compact(
        F.array(*[F.when(~F.col(f"x_{m}").between(F.col(f"low_{m}"), F.col(f"high_{m}")), F.lit(m)) for m in METRICS])
    )
    verdict = joined.withColumn("failed_rules", F.when(F.col("base_failed"), F.array().cast("array<string>")).otherwise(broken))
    kept = ~F.col("base_failed") & (F.size("failed_rules") == 0)
    return verdict.select(
        *[F.col("_row")[c].alias(c) for c in rest], *BASE, "n_lines", "base_failed", "failed_rules", kept.alias("kept")
    )
