"""The newest commits of each file, kept up to date by increments.

The newest few of what was kept and what is new are the newest few of all, so an increment reads and writes the buckets of its own
files only. Buckets are committed as batches: a run that ends early leaves the old state, and one that is run again changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchloom.functions.constants import HISTORY_COMMITS
from patchloom.session import materialize
from patchloom.sources import batches, landed

#: Buckets of files; an increment rewrites those that it touches.
BUCKETS = 256


def update(commits: DataFrame, path: str, batch: int, buckets: int = BUCKETS, limit: int = HISTORY_COMMITS) -> None:
    """Merge an increment of commits (repo, file_path, committed_at, sha, ...) into the state under `path`; `buckets` never changes."""
    spark = commits.sparkSession
    fresh = materialize(commits.withColumn("bucket", F.pmod(F.xxhash64("repo", "file_path"), F.lit(buckets)).cast("int")))
    touched = fresh.select("bucket").distinct()
    rows = fresh
    if not batches.is_new(spark, path):
        rows = batches.read_current(spark, path, "recent").join(touched, "bucket", "left_semi").unionByName(fresh)
    newest = landed.recent_commits(rows.dropDuplicates(["repo", "file_path", "sha"]), limit).drop("place")
    batches.commit(spark, path, batch, touched, recent=newest)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The kept commits of every file."""
    return batches.read_current(spark, path, "recent").drop("bucket")
