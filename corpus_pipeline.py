"""Corpus pipeline: documents to packed training sequences, one operator per stage.

language ID -> near duplicates -> benchmark decontamination -> secret scan -> packing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skiff import files
from skiff.llm.common import fold_of
from skiff.llm.decontamination import find_contamination
from skiff.llm.jaccard_join import jaccard_classes
from skiff.llm.language_id import fit_language_model, has_letters_column, identify_language, labelled_sample
from skiff.llm.packing import pack_documents
from skiff.llm.secret_scan import redact_secrets
from skiff.session import materialize, run_dir, scratch


def _boxed(docs: DataFrame) -> Column:
    """All columns in one, so that no name of theirs clashes with a helper column."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised stay.

    The model learns from the labelled documents outside the held-out fold; where there are
    none, it can reject only texts without letters.
    """
    model = fit_language_model(labelled_sample(docs.where(fold_of("doc_id", 4) != 2)))
    if not model.langs:
        return docs.where(has_letters_column("text"))
    named = identify_language(docs.select(_boxed(docs), "text"), model)
    return named.where("lang_accepted").select("_doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicate documents the one with the smallest id (then text
    hash) stays, once.  Texts without words belong to no group and stay."""
    wordy = F.coalesce(F.col("text").rlike(r"[0-9A-Za-z]|[^\x00-\x7F]"), F.lit(False))
    keyed = docs.where(wordy).select(_boxed(docs), F.xxhash64("text").alias("_text_key"), F.col("doc_id").alias("_doc_id"))
    classes = jaccard_classes(docs.where(wordy))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key"))
    keep = classes.groupBy("class_key").agg(first.alias("k")).select(F.col("k.doc_id").alias("_id"), F.col("k.text_key").alias("_key"))
    keep = materialize(keep, "keep")
    kept = keyed.join(keep, (F.col("_text_key") == F.col("_key")) & F.col("_doc_id").eqNullSafe(F.col("_id")), "left_semi")
    once = kept.groupBy("_text_key", "_doc_id").agg(F.any_value("_doc").alias("_doc")).select("_doc.*")
    return once.unionByName(docs.where(~wordy))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    found = find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    bad = found.where(F.size("hit_words") > 0).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    bad = materialize(bad, "contaminated")
    keyed = docs.select(_boxed(docs), F.xxhash64("text").alias("_text_key"), F.col("doc_id").alias("_doc_id"))
    clean = keyed.join(bad, (F.col("_text_key") == F.col("_key")) & F.col("_doc_id").eqNullSafe(F.col("_id")), "left_anti")
    return clean.select("_doc.*")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; every document stays, with n_chars of its new text."""
    clean = redact_secrets(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences, with their token ids."""
    return pack_documents(docs)


#: (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame.
STAGES = [
    ("language_id", language),
    ("jaccard_join", near_duplicates),
    ("decontamination", decontaminate),
    ("secret_scan", secrets),
    ("packing", packing),
]

#: Packing needs a tokenizer and language ID a trained model: not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written as Parquet in the shared
    folder and reread as the next stage's input.  A stage's own intermediate tables, and its
    input, are deleted once its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        path = run_dir(spark, f"stage-{name}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            files.delete(spark, before)
        before = path
    return docs
