"""A corpus from documents: language ID, near-dedup, PII, mixing, packing. Every stage is one operator of sieveline.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm import common, langid, mixing, packing, pii, shingles, simhash


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language models do not reject; a document without a lang takes the one found."""
    return langid.accepted(docs, langid.train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each component, without the near copies left: 5-word similarity 0.8 or more.

    Fingerprints at 4 bits see few of the pairs below 0.95, so what they leave is compared by its runs of words.
    Rows with a repeated or null doc_id are documents of their own, in the order of (doc_id, text).
    """
    rows, _ = common.numbered(docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs["doc_id"], docs["text"]), "doc_id", "text")
    found = simhash.near_duplicates(rows.select(F.col("_row").alias("doc_id"), "text"), words=5)
    keep = found.where("doc_id = component_id").select(F.col("doc_id").alias("_keep"))
    kept = common.materialize(rows.join(keep, rows["_row"] == keep["_keep"], "left_semi").select("row", "_row"), "kept")
    lost = shingles.near_copies(kept.select(F.col("_row").alias("doc_id"), "row.text"), words=5, least=0.8).select(F.col("doc_id").alias("_lost"))
    return kept.join(lost, kept["_row"] == lost["_lost"], "left_anti").select("row.*")


def sanitised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without personal data, and their new lengths."""
    clean = pii.sanitize(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rate says."""
    return mixing.mixed(docs, common.table(spark, sf_dir, "labels"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences with their ids."""
    return packing.pack(docs)


STAGES = [("language_id", language), ("near_dedup", near_duplicates), ("pii", sanitised), ("mixing", mixed), ("packing", packed)]

#: No stage of learned models, iterated components or byte-pair ids can be said in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each stage's rows are written and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.materialize(stage(spark, docs, sf_dir), name)
    return docs
