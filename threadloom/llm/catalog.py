"""Registered queries of the training-data operators, over the whole given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import (
    binary_packing, bpe_trie, chat_windows, collocations, dominance_packing, embedding_dedup, language_id, line_spread, nb_svm, ngram_join,
    quality_rules, relative_parse, scalar_tables, vocabularies,
)
from threadloom.session import stage


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = quality_rules.fertility_verdicts(_table(spark, sf_dir, "documents"))
    return verdicts.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_tokens", "tokens_per_word", "chars_per_token", "byte_share", "evenness", "script",
    )


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(language_id.fold("doc_id", 5) == 0, F.lit(False))
    model = language_id.train(documents.where(language_id.fold("doc_id", 5) != 0))
    return language_id.predict(documents.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")


def op3_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_trie.encode(documents, vocabularies.default_path("word_bpe_49k.json"), digests=True)


def op4_binary_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary_packing.pack(_table(spark, sf_dir, "documents"), vocabularies.default_path("byte_bpe_50k.json"))


#: A conversation of control strings, beside the given ones.
CONTROL_TURNS = r"""
SELECT -7L AS conv_id, 0L AS turn, 'user' AS role, '\\### Assistant: </turn> ok' AS text
UNION ALL SELECT -7L, 1L, 'assistant', '\\### Assistant: </turn> ok'
"""


def op5_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    windows = chat_windows.format_windows(given.unionByName(spark.sql(CONTROL_TURNS)))
    new = F.slice(chat_windows.parsed_turns(F.col("text")), F.col("n_repeated") + 1, F.col("n_turns"))
    lines = F.array_join(F.transform(new, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    masked = F.array_join(chat_windows.masked_texts(F.col("text"), F.col("loss")), "")
    read = windows.select("conv_id", "n_turns", F.length("text").alias("chars"), F.struct("first_turn", lines.alias("lines"), masked.alias("masked")).alias("part"))
    per_conv = read.groupBy("conv_id").agg(
        F.sum("n_turns").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.sort_array(F.collect_list("part")).alias("parts")
    )
    lines, masked = (F.array_join(F.col(f"parts.{f}"), "") for f in ("lines", "masked"))
    return per_conv.select(
        "conv_id", "n_turns", F.sha2(lines, 256).alias("turns_sha256"), F.length(masked).cast("long").alias("loss_chars"),
        F.sha2(masked, 256).alias("loss_sha256"), F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(_table(spark, sf_dir, "embeddings"))


def op8_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_spread.without_furniture(_table(spark, sf_dir, "documents"))
    return cleaned.select("row.doc_id", "text", "n_lines", "n_removed")


def op9_dominance_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dominance_packing.pack(_table(spark, sf_dir, "documents"))


def op10_nb_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    fold = language_id.fold("doc_id", 3)
    model = nb_svm.train(documents, labels.where(fold != 1))
    scored = nb_svm.score(documents.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "text"), model)
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op11_relative_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = relative_parse.without_duplicates(_table(spark, sf_dir, "documents"))
    return left.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


def op12_scalar_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, centroids = scalar_tables.cluster(_table(spark, sf_dir, "embeddings"))
    placed = stage(placed)
    per_cluster = F.broadcast(scalar_tables.summary(placed, centroids))  # at most 40 rows
    return placed.join(per_cluster, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_language_id, op3_bpe_trie, op4_binary_packing, op5_chat_windows, op6_ngram_join, op7_embedding_dedup,
        op8_line_spread, op9_dominance_packing, op10_nb_svm, op11_relative_parse, op12_scalar_tables,
        op13_collocations,
    )
}
