"""Submitted code, reviewed or scored on its own: no PR around it, and no triage before the review."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchloom.operators import context, findings, scoring
from patchloom.operators.features import chunk_features
from patchloom.plans.review import grouped_findings
from patchloom.sources import landed


def _chunks(snippets: DataFrame) -> DataFrame:
    chunks = landed.accepted(landed.snippet_chunks(snippets))
    return chunks.withColumnRenamed("snippet_id", "pr_id")


def snippet_prompts(snippets: DataFrame) -> DataFrame:
    """The review prompt of each accepted snippet: its code only."""
    chunks = _chunks(snippets)
    files = context.reviewed_files(chunks, context.file_routes(chunks))
    nothing = files.filter(F.lit(False))
    empty = F.lit("")
    about = nothing.select(
        "pr_id", *[empty.alias(c) for c in ("title", "body", "changed_files_summary", "shown_body")]
    )
    lists = nothing.select("pr_id", "file_path", empty.alias("signatures"))
    focus = nothing.select("pr_id", "file_path", F.array(empty).alias("focus_areas"))
    return context.prompts(files, about, lists, focus).withColumnRenamed("pr_id", "snippet_id")


def snippet_review(snippets: DataFrame, responses: DataFrame) -> DataFrame:
    """Findings of each snippet, five fields and their number."""
    chunks = _chunks(snippets)
    routes = context.file_routes(chunks)
    files = context.reviewed_files(chunks, routes)
    answers = responses.withColumnRenamed("snippet_id", "pr_id")
    found = findings.snippet_findings(grouped_findings(routes, files, answers))
    return found.drop("file_ord", "finding_ord").withColumnRenamed("pr_id", "snippet_id")


def snippet_scores(snippets: DataFrame, model: PipelineModel | None = None) -> DataFrame:
    """Risk report of each accepted snippet."""
    chunks = landed.accepted(landed.snippet_chunks(snippets))
    return scoring.snippet_risk(chunk_features(chunks), model)
