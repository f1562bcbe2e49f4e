"""What the rest of the PR and the repository's history say about a chunk's file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchloom.functions.constants import HISTORY_COMMITS, HISTORY_FILES, HISTORY_FIX_PATTERN
from patchloom.functions.regex import folded_pattern
from patchloom.functions.text import folded, ratio4, stem
from patchloom.sources.landed import recent_commits

_MARK = 5  # length of "test_", "spec_" and "_test"


def _named_stems(segment: Column) -> Column:
    """Every stem for which ``segment`` holds ``test_<stem>``, ``spec_<stem>`` or ``<stem>_test``.

    A stem has no slash, so it lies within one path segment: it is a prefix of what follows an
    opening mark, or a suffix of what precedes a closing one.
    """
    at = F.filter(
        F.sequence(F.lit(1), F.length(segment)),
        lambda i: F.substr(segment, i, F.lit(_MARK)).isin("test_", "spec_", "_test"),
    )

    def stems(i: Column) -> Column:
        rest = F.substr(segment, i + _MARK)
        before = F.substr(segment, F.lit(1), i - 1)
        prefixes = F.transform(
            F.sequence(F.lit(0), F.length(rest)), lambda n: F.substr(rest, F.lit(1), n)
        )
        suffixes = F.transform(
            F.sequence(F.lit(1), F.length(before) + 1), lambda n: F.substr(before, n)
        )
        closing = F.substr(segment, i, F.lit(_MARK)) == "_test"
        return F.when(closing, suffixes).otherwise(prefixes)

    return F.array_distinct(F.flatten(F.transform(at, stems)))


def tested_stems(pr_files: DataFrame) -> DataFrame:
    """(pr_id, stem) pairs that some changed path of the PR names as tested; a pair may come twice.

    Turning "some path contains test_<stem>" into stems makes the check an equality join, so no file
    is paired with all the other paths of its PR.
    """
    segments = pr_files.select("pr_id", F.explode(F.split("filename", "/")).alias("segment"))
    marked = segments.filter(F.col("segment").rlike("test_|spec_|_test"))
    return marked.select("pr_id", F.explode(_named_stems(F.col("segment"))).alias("stem"))


def covered_files(files: DataFrame, pr_files: DataFrame) -> DataFrame:
    """The (pr_id, file_path) rows of ``files`` that a path changed in the same PR is a test of."""
    stems = files.select("pr_id", "file_path").distinct().withColumn("stem", stem(F.col("file_path")))
    return stems.join(tested_stems(pr_files), ["pr_id", "stem"], "left_semi").select(
        "pr_id", "file_path"
    )


def commit_history_risk(commits: DataFrame, limit: int = HISTORY_COMMITS) -> DataFrame:
    """Share of each file's recent commit messages that speak of a fix."""
    fixes = F.count_if(folded(F.col("message")).rlike(folded_pattern(HISTORY_FIX_PATTERN)))
    return (
        recent_commits(commits, limit)
        .groupBy("repo", "file_path")
        .agg(fixes.alias("fix_commits"), F.count("*").alias("commits"))
        .withColumn("commit_history_risk", ratio4(F.col("fix_commits"), F.col("commits")))
    )


def first_files(chunks: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` files of each PR, by their first chunk.

    Files are counted down to one row each first, and the limit is applied before the shuffle, too.
    """
    firsts = chunks.groupBy("pr_id", "file_path").agg(F.min("chunk_ord").alias("first_ord"))
    by_place = Window.partitionBy("pr_id").orderBy("first_ord", "file_path")
    return (
        firsts.withColumn("file_rank", F.row_number().over(by_place))
        .filter(F.col("file_rank") <= limit)
    )


def budgeted_history(
    chunks: DataFrame, prs: DataFrame, commits: DataFrame, budget: int = HISTORY_FILES
) -> DataFrame:
    """History risk of the first ``budget`` files of each PR, where they have any history."""
    files = first_files(chunks, budget).join(prs.select("pr_id", "repo"), "pr_id")
    wanted = commits.join(files.select("repo", "file_path").distinct(), ["repo", "file_path"], "left_semi")
    risks = commit_history_risk(wanted).select("repo", "file_path", "commit_history_risk")
    return files.join(risks, ["repo", "file_path"]).select("pr_id", "file_path", "commit_history_risk")


def with_file_context(
    chunks: DataFrame,
    prs: DataFrame,
    pr_files: DataFrame,
    commits: DataFrame,
    budget: int = HISTORY_FILES,
) -> DataFrame:
    """Adds ``has_test_coverage`` and ``commit_history_risk`` (0 outside the budget) to chunk rows.

    Both are worked out per file, so that the wide chunk rows are joined once.
    """
    covered = covered_files(chunks, pr_files).withColumn("covered", F.lit(True))
    risks = budgeted_history(chunks, prs, commits, budget)
    context = covered.join(risks, ["pr_id", "file_path"], "full")
    return (
        chunks.join(context, ["pr_id", "file_path"], "left")
        .withColumn("has_test_coverage", F.coalesce("covered", F.lit(False)))
        .withColumn("commit_history_risk", F.coalesce("commit_history_risk", F.lit(0.0)))
        .drop("covered")
    )
