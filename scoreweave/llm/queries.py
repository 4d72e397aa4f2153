"""Named queries over the text tables, one per operator: thin mappings to the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import ID, TARGET
from . import boosted, bpe, decontaminate, histories, hmm, language, lengths, links, neardup, quality, toolcalls, toxicity, whitening
from .tools import fold, stored

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(run: Query) -> Query:
    REGISTRY[run.__name__] = run
    return run


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query
def op1_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return bpe.encode_decode(docs).drop("text")


@query
def op2_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    return quality.judge(docs).drop("lang", "source", "n_lines", "failed_rules")


@query
def op3_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.withColumn("items_sha256", F.sha2(F.array_join("items", ","), 256)).drop("items")


@query
def op4_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf, "documents"))


@query
def op5_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return lengths.token_counts(table(spark, sf, "documents"))


@query
def op6_url_filters(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select("page_id", "url", "html")
    return links.judge(pages).select("page_id", "host", "path", "rule", "verdict")


@query
def op7_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    held_out = fold("doc_id", 3) == 1
    found = language.detect(docs.withColumn("held_out", held_out), train=~F.col("held_out"))
    return found.select("doc_id", "held_out", "lang_pred", "score")


@query
def op8_language_model(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    held_out = fold("doc_id", 10) == 0
    return hmm.language_model(docs.withColumn("held_out", held_out), train=~F.col("held_out"))


@query
def op9_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = toxicity.detect(docs, table(spark, sf, "labels"), train=fold("_k", 3) != 1)
    held_out = fold("doc_id", 3) == 1
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted", F.size("offending").alias("n_offending"))


@query
def op10_tool_calls(spark: SparkSession, sf: str) -> DataFrame:
    calls, results = toolcalls.chat_calls(table(spark, sf, "conversations"))
    schemas = spark.createDataFrame([("reply", toolcalls.REPLY)], "name string, schema string")
    return toolcalls.link_calls(calls, results, schemas)


def rebuilt_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text_sha, n_bytes): every conversation with the beginning of its family's first one."""
    family = F.col("conv_id") - F.col("conv_id") % 5
    text = F.coalesce("text", F.lit(""))
    said = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.sha2(text.cast("binary"), 256).alias("text_sha"), F.octet_length(text).alias("n_bytes"))
    own = conversations.filter("conv_id IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_list(said)).alias("own"))
    shared = F.max(F.when(F.col("conv_id") == F.col("family"), F.slice("own", 1, 8))).over(Window.partitionBy("family"))
    both = own.withColumn("family", family).withColumn("shared", shared).withColumn("h", fold("conv_id", 9).cast("int"))
    rest = F.filter("own", lambda t, i: i >= F.col("h"))
    turns = F.concat(F.slice(F.coalesce("shared", F.slice("own", 1, 0)), F.lit(1), F.col("h")), rest)
    placed = both.select("conv_id", F.posexplode(turns).alias("turn", "t"))
    return placed.select("conv_id", "turn", "t.role", "t.text_sha", "t.n_bytes")


@query
def op11_conversation_trie(spark: SparkSession, sf: str) -> DataFrame:
    conversations = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    bureau = rebuilt_turns(conversations).withColumnsRenamed({"conv_id": ID, "turn": "days_credit", "role": "credit_active"})
    ids = conversations.select(F.col("conv_id").alias(ID))
    trie = histories.history_trie(ids, bureau, state=("credit_active", "text_sha"), size_col="n_bytes")
    nodes = trie.nodes.join(histories.ends_digest(trie.ends), [ID, "depth"], "left")
    no_end = F.sha2(F.lit(b""), 256)
    return nodes.select(
        F.col(ID).alias("conv_id"), F.col("depth").cast("long").alias("depth"), F.col(f"parent_{ID}").alias("parent_conv_id"), F.col("n_applications").alias("n_convs"),
        "n_children", "n_leaves", F.col("saved_bytes").alias("saved_tokens"), F.coalesce("ends_sha256", no_end).alias("ends_sha256"),
    )


@query
def op12_whitening(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias(ID), "embedding")
    found = whitening.whitened_applications(vectors, "embedding", components=4, scale=256)
    return found.select(
        F.col(ID).alias("vec_id"), F.col("component").cast("int").alias("component"), "n", F.expr("try_cast(deviation AS bigint)").alias("deviation"),
        "whitened", "explained", "identity_error",
    )


@query
def op13_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias(ID), "text")
    model_input = stored(boosted.text_statistics(docs, key=ID), "text-statistics")
    held_out = fold(ID, 3) == 1
    labels = table(spark, sf, "labels").groupBy(F.col("doc_id").alias(ID)).agg(F.max("quality").alias(TARGET))
    model = boosted.fit_boosted(model_input.filter(~held_out).join(labels, ID), boosted.STATISTICS)
    found = boosted.score_boosted(model_input, model)
    return found.select(
        F.col(ID).alias("doc_id"), held_out.alias("held_out"), F.col("predicted_bad_probability").alias("score"),
        (F.col("predicted_bad_probability") >= 0.5).cast("int").alias("predicted"),
    )
