"""Exact token counts for every context limit from one histogram of encoded lengths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .tools import stored

WIDTH = 1024


def length_histogram(docs: DataFrame, length: str) -> DataFrame:
    """One row per distinct length: ``n_tokens`` and ``n_docs``. Rows combine before the shuffle."""
    return docs.groupBy(F.col(length).cast("long").alias("n_tokens")).agg(F.count(F.lit(1)).alias("n_docs"))


def context_limits(histogram: DataFrame) -> DataFrame:
    """Totals below, at and above each length of a histogram.

    Columns: ``n_tokens`` (the limit), ``n_docs`` (documents of just that length), ``docs_over``
    and ``tokens_over`` (longer ones), ``truncated_docs`` (= ``docs_over``), ``truncated_tokens``
    (tokens left if every text is cut at the limit), ``lost_tokens``, ``docs_total``,
    ``tokens_total`` and ``quantile`` (share of documents that fit the limit).

    Lengths are cut into buckets of 1,024. Suffix sums run inside each bucket and over the few
    bucket totals, so no task holds the whole histogram. A limit between two listed lengths has
    the row sums of the next lower one: ``truncated_tokens`` then grows by ``docs_over`` a token.
    """
    rows = histogram.filter("n_tokens is not null").select(
        "n_tokens", "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("tokens"), F.floor(F.col("n_tokens") / WIDTH).alias("bucket")
    )
    totals = rows.groupBy("bucket").agg(F.sum("n_docs").alias("b_docs"), F.sum("tokens").alias("b_tokens"))
    above = Window.orderBy(F.col("bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.col("bucket").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = totals.select(
        "bucket",
        F.coalesce(F.sum("b_docs").over(above), F.lit(0)).alias("a_docs"),
        F.coalesce(F.sum("b_tokens").over(above), F.lit(0)).alias("a_tokens"),
        F.sum("b_docs").over(everything).alias("docs_total"),
        F.sum("b_tokens").over(everything).alias("tokens_total"),
    )
    inside = Window.partitionBy("bucket").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.withColumns(
        {
            "i_docs": F.coalesce(F.sum("n_docs").over(inside), F.lit(0)),
            "i_tokens": F.coalesce(F.sum("tokens").over(inside), F.lit(0)),
        }
    ).join(totals, "bucket")
    docs_over, tokens_over = F.col("a_docs") + F.col("i_docs"), F.col("a_tokens") + F.col("i_tokens")
    kept = F.col("tokens_total") - tokens_over + docs_over * F.col("n_tokens")
    return summed.select(
        "n_tokens",
        "n_docs",
        docs_over.alias("docs_over"),
        tokens_over.alias("tokens_over"),
        docs_over.alias("truncated_docs"),
        kept.alias("truncated_tokens"),
        (F.col("tokens_total") - kept).alias("lost_tokens"),
        "docs_total",
        "tokens_total",
        ((F.col("docs_total") - docs_over) / F.col("docs_total")).alias("quantile"),
    )


def length_at_quantile(limits: DataFrame, share: float) -> DataFrame:
    """Smallest length that at least ``share`` of the documents fit (one row, ``n_tokens``)."""
    return limits.filter(F.col("quantile") >= share).agg(F.min("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, text: str = "text", ranks: dict[bytes, int] | None = None) -> DataFrame:
    """Encode every text of ``docs`` and return :func:`context_limits` of the lengths.

    Null and empty texts have length 0 and count as documents. Texts of any length are encoded
    whole, and once: the histogram is a written table. Repeated rows count each. An empty table gives an empty result. Further columns are not
    read. General: the scoring tables of this library hold no prose.
    """
    name = "_length"
    lengths = bpe.text_lengths(docs.select(F.col(text).alias("text")), "text", name, ranks)
    return context_limits(stored(length_histogram(lengths, name), "length-histogram"))
