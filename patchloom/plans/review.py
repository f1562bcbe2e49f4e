"""The whole review of many PRs at once, as two jobs around the outside reviewer.

``triage`` goes from landed tables to the prompt table; ``conclude`` goes from the answers to
comments, summaries and reports. All joins from triage on share the key (pr_id, file_path).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchloom.operators import context, diffs, findings, scoring
from patchloom.operators.features import chunk_features
from patchloom.operators.history import with_file_context
from patchloom.session import joined_where_dealt, materialize
from patchloom.sources import landed


@dataclass
class Triage:
    prs: DataFrame
    scored: DataFrame
    triage_counts: DataFrame
    routes: DataFrame
    files: DataFrame
    prompts: DataFrame


def enriched_features(
    chunks: DataFrame, prs: DataFrame, pr_files: DataFrame, commits: DataFrame
) -> DataFrame:
    """Chunks with their own features and those of their file.

    The file columns come from the bare chunks, so the features are computed in one branch only.
    """
    return chunk_features(with_file_context(chunks, prs, pr_files, commits))


def scored_chunks(
    chunks: DataFrame,
    prs: DataFrame,
    pr_files: DataFrame,
    commits: DataFrame,
    model: PipelineModel | None,
) -> DataFrame:
    """Chunks with features, context features, score, band and focus areas."""
    enriched = enriched_features(chunks, prs, pr_files, commits)
    return scoring.with_focus_areas(
        scoring.with_adjusted_score(scoring.with_base_score(enriched, model))
    )


def triage(
    pull_requests: DataFrame,
    diff_table: DataFrame,
    pr_files: DataFrame,
    commits: DataFrame,
    file_contents: DataFrame,
    model: PipelineModel | None = None,
    store: bool = True,
) -> Triage:
    """From PRs to prompts. ``diff_table`` holds the diffs of the listed PRs and no others.

    Diffs become chunks with no join and no shuffle. Chunks are read by three branches and scored
    chunks by five, so both are stored once.
    """
    prs = landed.pr_status(pull_requests, diff_table)
    chunks = diffs.review_chunks(landed.with_diffs(diff_table), ["pr_id"]).drop("raw_patch")
    chunks = materialize(chunks) if store else chunks
    scored = scored_chunks(chunks, pull_requests, pr_files, commits, model)
    scored = materialize(scored) if store else scored
    high = scoring.high_risk(scored)
    routes = context.file_routes(high)
    files = context.reviewed_files(high, routes)
    contents = landed.file_content(
        file_contents.withColumnRenamed("path", "file_path"), ["pr_id", "file_path"]
    )
    prompt_table = context.prompts(
        files,
        context.pr_context(landed.pr_metadata(pull_requests), context.changed_files_summary(pr_files)),
        context.budgeted_signatures(high, contents),
        scoring.file_focus_areas(scored),
    )
    return Triage(
        prs=prs.select("pr_id", "repo", "head_sha", "status"),
        scored=scored,
        triage_counts=scoring.triage_counts(scored, model is not None),
        routes=routes,
        files=files,
        prompts=prompt_table,
    )


def grouped_findings(routes: DataFrame, files: DataFrame, responses: DataFrame, store: bool = False) -> DataFrame:
    parsed = findings.located(findings.parse_responses(responses), files, by_pr=store)
    oversize = findings.oversize_findings(routes)
    # both sides of the union are dealt out alike, so it needs no other shuffle
    grouped = findings.group_findings(findings.all_findings(oversize.repartition("pr_id") if store else oversize, parsed))
    return stored_by_pr(grouped) if store else grouped


def stored_by_pr(grouped: DataFrame) -> DataFrame:
    """Grouped findings of files that were located by PR, stored once."""
    with joined_where_dealt(grouped.sparkSession):
        return materialize(grouped, compression="zstd")


@dataclass
class Conclusion:
    comments: DataFrame
    summaries: DataFrame
    reports: DataFrame


def conclude(
    prs: DataFrame,
    triage_counts: DataFrame,
    routes: DataFrame,
    files: DataFrame,
    responses: DataFrame,
    store: bool = True,
) -> Conclusion:
    """From answers to comments, summaries and reports.

    Routes and grouped findings are each read by several branches, so they are stored once. Files, the wide rows, are
    read by one: which of them went to review, and in what order, the routes say as well.
    """
    if store:
        routes = materialize(routes, compression="zstd")
    grouped = grouped_findings(routes, files, responses, store)
    asked = routes.filter(F.col("route") == context.ROUTE_PROMPT)
    totals = findings.per_pr(
        triage_counts, routes, findings.finding_counts(grouped),
        findings.skipped_files(responses, asked),
    )
    return Conclusion(
        comments=findings.review_comments(grouped),
        summaries=findings.summaries(totals),
        reports=findings.run_reports(prs, totals),
    )
