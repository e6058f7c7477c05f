"""A text corpus from raw documents to packed sequences, one written stage after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import concat_pack, content_sort, hyperminhash, quality_gam, secrets
from barloom.llm.common import cut_lineage, table
from barloom.llm.queries import (
    END_TOKEN,
    QUALITY_THRESHOLD,
    VOCABULARY,
    repository,
    tokenizer_path,
)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the model, fitted on the labels beside the tables, scores below the threshold."""
    model = quality_gam.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality_gam.score_quality(docs, model, carry=docs.columns)
    return scored.filter(F.col("score") >= QUALITY_THRESHOLD).select("row.*")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each text: that with the largest id."""
    return content_sort.content_sort_dedup(docs, carry=docs.columns).filter("kept").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: that with the least id. An id on several documents
    stays while one of them does."""
    found = hyperminhash.near_duplicates(docs).groupBy("id").agg(F.max("kept").alias("kept"))
    dropped = found.filter(~F.col("kept")).select(F.col("id").alias("dropped_id"))
    return docs.join(dropped, docs["doc_id"].eqNullSafe(dropped["dropped_id"]), "left_anti")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document and replaces the secrets in it, live ones and copied examples by marks of their own."""
    length = "n_chars" if "n_chars" in docs.columns else None
    return secrets.redact_secrets(docs, repository(), F.col("source"), length_col=length)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document in the fixed-size sequences, with its token ids."""
    pieces = concat_pack.concat_and_cut(docs, tokenizer_path(VOCABULARY), END_TOKEN)
    return pieces.select(
        F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
        "sequence_id", "offset", "ids",
    )


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("secret scan", secret_scan),
    ("packing", packing),
]

#: The fitted model, the tokenizer and the connected components are beyond SQL; tests/llm holds the stages
#: against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each reads what the one before has written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
