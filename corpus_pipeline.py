"""Corpus cleaning as five stages, from raw documents to packed training sequences.

Each stage takes all documents its predecessor kept and returns documents with the same columns; the last returns the packed
pieces. ``run`` writes every stage as Parquet in the shared folder and reads it back, so a lost executor
costs a stage at most. Empty tables pass through all stages; a null or empty text is rejected by the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import dominance_packing, language_id, line_spread, ngram_join, quality_rules, vocabularies
from threadloom.session import stage

#: A text whose best language has a smaller posterior has no clear language.
MIN_POSTERIOR = 0.5
#: A text whose n-grams are less likely than this, in deviations from those of its best language, is in none of the learned languages.
MIN_FIT = -1.25


def _columns(rows: DataFrame, docs: DataFrame, changed: dict[str, Column]) -> DataFrame:
    """The columns of ``docs`` out of ``rows.row``, some of them changed."""
    return rows.select(*(changed.get(c, F.col(f"row.`{c}`")).cast(docs.schema[c].dataType).alias(c) for c in docs.columns))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts that are clearly in one of the learned languages; that language takes the place of a missing or contrary one."""
    model = language_id.train(docs)
    prefix = "found_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    found = language_id.predict(docs, model, prefix=prefix, fit=True)
    language, score, fit = (F.col(f"{prefix}{c}") for c in ("lang_pred", "score", "fit"))
    clear = found.where((language != language_id.UNKNOWN) & (score >= MIN_POSTERIOR) & (fit >= MIN_FIT))
    return clear.withColumn("lang", language.cast(docs.schema["lang"].dataType)).select(*docs.columns)


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts that the base rules and the fertility bands let pass."""
    print_of = {"print_1": F.xxhash64("text", "lang"), "print_2": F.xxhash64("lang", "text", F.lit(1))}
    shared = vocabularies.share_file(spark, vocabularies.default_path("piece_bpe_32k.model"))
    measured = stage(quality_rules.measure(docs.select("text", "lang", *(p.alias(n) for n, p in print_of.items())), shared))
    rejected = quality_rules.judged(measured).where("not kept").select(*print_of).distinct()
    rows = docs.select(F.struct("*").alias("row"), *(p.alias(n) for n, p in print_of.items()))
    return _columns(rows.join(rejected, list(print_of), "left_anti"), docs, {})


def remove_furniture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes lines that stand on many sites out of the texts."""
    cleaned = line_spread.without_furniture(docs)
    return _columns(cleaned, docs, {"text": F.col("text"), "n_chars": F.length("text").cast("long")})


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group of near duplicates, and all without links.

    Rows are told apart by id and text, so a null or repeated id takes no unlike row with it; of rows equal in
    both one stays. A null id goes before no other id.
    """
    print_of = {"print_1": F.xxhash64("text"), "print_2": F.xxhash64("text", F.lit(1))}
    found = ngram_join.classed_documents(docs, also=print_of)
    gone = found.where("n_links > 0 and member <> first").select("member").distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("doc"), *(p.alias(n) for n, p in print_of.items()))
    member = F.struct(F.col("doc").isNull().alias("unnamed"), "doc", *print_of)
    left = rows.withColumn("member", member).join(gone, "member", "left_anti")
    return _columns(left.dropDuplicates(["doc", *print_of]), docs, {})


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places all texts in as few training sequences as best fit finds."""
    return dominance_packing.pack(docs)


STAGES = [
    ("language_id", identify_language), ("quality_rules", apply_quality_rules), ("line_dedup", remove_furniture),
    ("near_duplicates", drop_near_duplicates), ("packing", pack_sequences),
]

#: Vocabularies and the learned model are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir))
    return docs
