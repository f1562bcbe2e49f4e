"""The training set: crawl, label, sample, cap, split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchloom.operators import training
from patchloom.operators.features import chunk_features
from patchloom.session import materialize
from patchloom.sources import landed


#: A crawl reads so many pages of so many commits of a repository.
PAGES, PAGE_COMMITS = 5, 50


def collected_samples(
    commits: DataFrame,
    commit_diffs: DataFrame,
    repos: DataFrame | None = None,
    cap: int = 50,
    pages: int = PAGES,
    page_commits: int = PAGE_COMMITS,
    parsed: list[int] | None = None,
) -> DataFrame:
    """Samples of the crawled commits of the chosen repositories, capped per repository.

    Commits are taken by pages, newest first. After each page the repositories that have reached the cap leave, so the diffs
    behind it are never parsed, and none is parsed twice. Diffs join the labelled commits once and are stored by page: a turn reads
    its own page only. ``parsed`` is given the number of diffs that each turn parsed.
    """
    if repos is not None:
        commits = commits.join(repos.select("repo"), "repo", "left_semi")
    crawled = landed.crawled_commits(commits, pages * page_commits)
    labelled = training.labelled_commits(crawled).withColumn("page", F.floor((F.col("place") - 1) / page_commits).cast("int"))
    wanted = landed.commits_with_diffs(labelled.select("repo", "sha", "committed_at", "place", "label", "page"), commit_diffs)
    stored = materialize(wanted.hint("rebalance", "page"), partition_by="page")
    open_repos = materialize(stored.select("repo").distinct())
    reached = open_repos.select("repo", F.lit(0).cast("bigint").alias("samples"))
    kept = []
    for page in range(pages):
        rows = stored.filter(F.col("page") == page).join(open_repos, "repo", "left_semi")
        if parsed is not None:
            parsed.append(rows.count())
        chunks = materialize(training.sample_chunks(rows).drop("raw_patch"))
        counts = chunks.groupBy("repo", "sha").agg(F.count("*").alias("n"))
        places = stored.filter(F.col("page") == page).select("repo", "sha", "place")
        within, after = training.page_within_cap(places.join(counts, ["repo", "sha"]), reached, cap)
        kept.append(chunks.join(within, ["repo", "sha"], "left_semi"))
        reached = materialize(after)
        open_repos = reached.filter(F.col("samples") < 2 * cap).select("repo")
        if open_repos.isEmpty():
            break
    together = kept[0]
    for more in kept[1:]:
        together = together.unionByName(more)
    return chunk_features(together)


def training_table(samples: DataFrame, seed: int = 42, whole_commits: bool = False) -> DataFrame:
    """Feature rows with label and split; keyed by commit, or by chunk of a commit."""
    key = F.col("sha") if whole_commits else F.concat_ws("-", "sha", F.col("chunk_ord").cast("string"))
    rows = training.training_rows(samples.withColumn("key", key), "key")
    return training.with_split(rows, F.col("key"), seed)
