"""The corpus pipeline: STAGES are applied to `documents` one after another, each written and read again.

Every stage calls one operator of `patchloom.llm` on all rows that the stage before kept. All stages but the last return the
columns they are given. An empty table passes through; repeated rows, null ids, sources and texts are treated as the
operators' docstrings say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchloom.llm import mixing, near_copies, ordinal, packing, secret_scan
from patchloom.llm.queries import MIX_WEIGHTS
from patchloom.llm.tables import materialize, table

#: SQL can state neither the fitted classifier nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that are more likely than not of the best grade; fitted on those that `labels` rates."""
    rated = ordinal.rated_documents(docs, table(spark, sf_dir, "labels"))
    model = ordinal.fit(rated, ordinal.GRADES)
    scored = ordinal.score(docs.withColumnsRenamed(_aside(docs)), model, [_aside(docs).get(c, c) for c in docs.columns], ordinal.GRADES - 1)
    kept = scored.filter(F.col("tail_probability") >= ordinal.KEPT_FROM)
    return kept.select(*(F.col(f"`{_aside(docs).get(c, c)}`").alias(c) for c in docs.columns))


def _aside(docs: DataFrame) -> dict[str, str]:
    """Other names for columns that clash with those of the classifier."""
    return {c: f"_given_{c}" for c in docs.columns if c in ordinal.ADDED}


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near copies: SimHash links and what lies beyond, verified at Jaccard 0.8 over five-word shingles."""
    return near_copies.unique_documents(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the kind of secret in the place of each secret; n_chars follows."""
    masked = secret_scan.masked(docs)
    if "n_chars" not in docs.columns:
        return masked
    kind = docs.schema["n_chars"].dataType
    changed = F.when(F.col("text").isNotNull(), F.char_length("text").cast(kind)).otherwise(F.col("n_chars"))
    return masked.withColumn("n_chars", changed)


def pfair_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Brings the documents into the order of the mix: files in their order, rows within them."""
    given = {c: f"_given_{c}" for c in docs.columns if c in ("block", "position", "start")}
    mixed = mixing.mix(docs.withColumnsRenamed(given), MIX_WEIGHTS)
    ordered = mixed.orderBy("position", "start", F.asc_nulls_first("doc_id"))
    return ordered.select(*(F.col(f"`{given.get(c, c)}`").alias(c) for c in docs.columns))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 1024 tokens, sequences in the order of the documents."""
    pieces = packing.tokenized_pieces(packing.in_file_order(docs), public_tokenizers.path("byte_bpe_50k.json"), order="_order", checksums=True)
    return packing.place_in_order(pieces, "_order").drop("_order")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", near_dedup),
    ("secret_scans", secret_scans),
    ("pfair_mix", pfair_mix),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the whole table of documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
