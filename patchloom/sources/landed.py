"""Scans: landed tables in, typed rows out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from patchloom.functions.constants import (
    CONTENT_MAX_BYTES,
    CRAWL_COMMITS,
    HISTORY_COMMITS,
    SEED_REPOS,
    SNIPPET_MAX_CHARS,
    VECTOR_COLUMNS,
)
from patchloom.functions.text import let, lines_of
from patchloom.operators.diffs import has_unreadable_header


def read_diff_files(spark: SparkSession, path: str) -> DataFrame:
    """Diff files named ``<pr_id>.diff``, one per PR."""
    files = spark.read.text(path, wholetext=True).select("value", F.input_file_name().alias("file"))
    return files.select(
        F.regexp_extract("file", r"([^/]*)\.diff$", 1).alias("pr_id"), F.col("value").alias("diff")
    )


def read_diff_blocks(spark: SparkSession, path: str, lines: int = 4096, terminated: bool = False) -> DataFrame:
    """Diff files as blocks (pr_id, block, text) of consecutive lines; a long file is read by many tasks.

    The PR is the name of the file, or of its folder ``pr_id=...``. Spark cuts files at byte ranges and starts each at a line; a line's
    place is its range's first byte plus its number in the range, which grows along the file. ``terminated``: the newline at a
    file's end only ends its last line; otherwise an empty line follows it, as in the text of the whole file.
    """
    meta = F.col("_metadata")
    read = spark.read.text(path, lineSep="\n").select(
        meta["file_path"].alias("file"), meta["file_size"].alias("size"), meta["file_block_start"].alias("first"),
        F.monotonically_increasing_id().alias("id"), F.col("value").alias("line"),
    )
    ranges = read.groupBy("file", "first").agg(
        F.min("id").alias("base"), F.count("*").alias("n"), F.sum(F.octet_length("line") + 1).alias("bytes"), F.max("size").alias("size")
    )
    placed = read.select("file", "first", "id", "line").join(ranges.select("file", "first", "base"), ["file", "first"]).select(
        "file", (F.col("first") + F.col("id") - F.col("base")).alias("at"), "line"
    )
    if not terminated:  # every line of such a file has its newline
        ended = ranges.groupBy("file").agg(F.sum("bytes").alias("bytes"), F.max("size").alias("size")).filter("bytes = size")
        placed = placed.unionByName(ended.select("file", F.col("size").alias("at"), F.lit("").alias("line")))
    listed = F.array_sort(F.collect_list(F.struct("at", "line")))
    named = F.coalesce(
        F.nullif(F.regexp_extract("file", r"/pr_id=([^/]*)/[^/]*$", 1), F.lit("")), F.regexp_extract("file", r"([^/]*?)(?:\.diff)?$", 1)
    )
    blocks = placed.groupBy("file", F.floor(F.col("at") / lines).alias("block")).agg(listed.alias("listed"))
    return blocks.select(
        F.url_decode(named).alias("pr_id"), "block", F.array_join(F.transform("listed", lambda l: l["line"]), "\n").alias("text")
    )


def with_diffs(diffs: DataFrame) -> DataFrame:
    return diffs.filter(F.length("diff") > 0)


def pr_status(pull_requests: DataFrame, diffs: DataFrame) -> DataFrame:
    """Every PR with a status: ``error`` where the diff is missing, empty or has a hunk header that can't be read.

    Only a flag goes through the join: the diffs themselves are parsed where they lie.
    """
    flags = with_diffs(diffs).select("pr_id", has_unreadable_header(F.col("diff")).alias("unreadable"))
    joined = pull_requests.join(flags, "pr_id", "left")
    status = F.when(F.coalesce(F.col("unreadable"), F.lit(True)), F.lit("error")).otherwise(F.lit("ok"))
    return joined.withColumn("status", status).drop("unreadable")


def diff_line_counts(diffs: DataFrame) -> DataFrame:
    """The number of lines of each diff that is not empty."""
    return with_diffs(diffs).select("pr_id", F.size(lines_of(F.col("diff"))).alias("diff_lines"))


def pr_metadata(pull_requests: DataFrame) -> DataFrame:
    """Title, body and base branch, empty where absent."""
    fields = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("title", "body", "base_branch")]
    return pull_requests.select("pr_id", *fields)


def changed_files(pull_requests: DataFrame, pr_files: DataFrame) -> DataFrame:
    """One row per PR and changed file; a PR without any keeps one row with no file name."""
    return pull_requests.select("pr_id").join(
        pr_files.select("pr_id", "file_ord", "filename", "patch"), "pr_id", "left"
    )


_NO_LETTER, _LETTERS = "[^A-Za-z0-9+/=]", r"\A[A-Za-z0-9+/=]*+\z"


def _decoded(letters: Column) -> Column:
    """The bytes of base64 text of its 64 letters and ``=`` only; null where it is not base64, as `try_to_binary` has it.

    `try_to_binary` makes an object of each character to check them, which takes twenty times as long as the decoding itself.
    """
    n, filler = F.octet_length(letters), F.instr(letters, "=")
    whole = F.when(filler == 0, n % 4 != 1).otherwise((n % 4 == 0) & (n - filler <= 1) & letters.endswith("="))
    return F.when(whole, F.unbase64(letters))


def file_content(
    file_contents: DataFrame, keys: list[str], max_bytes: int | None = CONTENT_MAX_BYTES
) -> DataFrame:
    """Decoded text, empty when the file is too large or not base64; bad bytes become U+FFFD.

    Characters outside the base64 alphabet are passed over, as a lenient decoder does. ``too_large`` tells
    which files the limit left out; ``max_bytes=None`` turns it off.
    """
    # line ends go by plain replacements, and a text of letters only by one look from its start; a search takes long at each character
    unbroken = F.replace(F.replace("content_b64", F.lit("\r"), F.lit("")), F.lit("\n"), F.lit(""))
    letters = let(unbroken, lambda u: F.when(u.rlike(_LETTERS), u).otherwise(F.regexp_replace(u, _NO_LETTER, "")))
    text = F.make_valid_utf8(let(letters, _decoded).cast("string"))
    size = F.coalesce(F.col("size"), F.lit(0))
    fits = F.lit(True) if max_bytes is None else size <= max_bytes
    return file_contents.select(
        *keys, F.when(fits, F.coalesce(text, F.lit(""))).otherwise("").alias("content"), (~fits).alias("too_large")
    )


def _newest(keys: list[str]) -> Window:
    return Window.partitionBy(*keys).orderBy(F.col("committed_at").desc(), F.col("sha"))


def recent_commits(commits: DataFrame, limit: int = HISTORY_COMMITS) -> DataFrame:
    """The newest commits of each file; the limit is applied before the shuffle, too."""
    place = F.row_number().over(_newest(["repo", "file_path"]))
    return commits.withColumn("place", place).filter(F.col("place") <= limit)


def crawled_commits(commits: DataFrame, limit: int = CRAWL_COMMITS) -> DataFrame:
    """The newest commits of each repository, as five pages of fifty."""
    place = F.row_number().over(_newest(["repo"]))
    return commits.withColumn("place", place).filter(F.col("place") <= limit)


def commits_with_diffs(commits: DataFrame, commit_diffs: DataFrame) -> DataFrame:
    """Commits joined to their diffs; a commit whose diff is missing or empty drops out."""
    present = commit_diffs.filter(F.length("diff") > 0).select("sha", "diff")
    return commits.join(present, "sha")


def read_training_csv(spark: SparkSession, path: str) -> DataFrame:
    """Training samples: a header, 27 feature columns and the label last."""
    schema = ", ".join(f"{name} FLOAT" for name in VECTOR_COLUMNS) + ", label FLOAT"
    return spark.read.csv(path, header=True, schema=schema, mode="FAILFAST", enforceSchema=False)


def sampled_repos(repos: DataFrame, count: int, seed: int = 42) -> DataFrame:
    """``count`` repositories, the same ones for the same seed: the lowest keyed hashes win."""
    distinct = repos.select("repo").distinct()
    ranked = distinct.withColumn("rank_key", F.md5(F.concat(F.lit(str(seed)), F.col("repo"))))
    return ranked.orderBy("rank_key", "repo").limit(count)


def seed_repos(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(name,) for name in SEED_REPOS], "repo string")


def snippet_chunks(snippets: DataFrame, max_chars: int | None = SNIPPET_MAX_CHARS) -> DataFrame:
    """Submitted code as one all-added chunk each; code over the length limit (None: no limit) is marked rejected."""
    lines = lines_of(F.col("code"))
    return snippets.select(
        "snippet_id",
        F.coalesce("filename", F.lit("snippet.py")).alias("file_path"),
        (F.lit(True) if max_chars is None else F.length("code") <= max_chars).alias("accepted"),
        F.lit(0).cast("bigint").alias("chunk_ord"),
        F.lit(1).cast("bigint").alias("start_line"),
        F.size(lines).cast("bigint").alias("end_line"),
        lines.alias("added_lines"),
        F.array().cast("array<string>").alias("context_lines"),
    )


def accepted(chunks: DataFrame) -> DataFrame:
    return chunks.filter("accepted").drop("accepted")


def md5_bucket(key: Column, seed: int, buckets: int) -> Column:
    """A stable bucket of a key: the first 32 bits of its seeded md5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}-"), key)), 1, 8), 16, 10).cast("bigint") % buckets
