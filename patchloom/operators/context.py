"""Everything a reviewer is shown besides the changed lines, and the prompt table itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchloom.functions import constants as C
from patchloom.functions.regex import pattern
from patchloom.functions.text import lines_of, strip
from patchloom.operators.history import first_files

ROUTE_OVERSIZE, ROUTE_DROP, ROUTE_PROMPT = "oversize", "drop", "prompt"


def _route(added: Column) -> Column:
    return (
        F.when(added > C.OVERSIZE_LINES, F.lit(ROUTE_OVERSIZE))
        .when(added < C.MIN_REVIEW_LINES, F.lit(ROUTE_DROP))
        .otherwise(F.lit(ROUTE_PROMPT))
    )


def file_routes(high_chunks: DataFrame) -> DataFrame:
    """High-risk chunks per file, its added lines, and where the file goes next."""
    return (
        high_chunks.groupBy("pr_id", "file_path")
        .agg(
            F.min("chunk_ord").alias("file_ord"),
            F.count("*").alias("chunks"),
            F.sum(F.size("added_lines")).alias("added"),
            F.min_by("start_line", "chunk_ord").alias("first_start_line"),
        )
        .withColumn("route", _route(F.col("added")))
    )


def files_in_order(high_chunks: DataFrame) -> DataFrame:
    """High-risk chunks under their file, with the order in which files and chunks come."""
    firsts = high_chunks.groupBy("pr_id", "file_path").agg(F.min("chunk_ord").alias("file_ord"))
    return high_chunks.join(firsts, ["pr_id", "file_path"])


def reviewed_files(high_chunks: DataFrame, routes: DataFrame | None = None, by_pr: bool = False) -> DataFrame:
    """One row per file that goes to review, with its chunks in order.

    The route is decided from counts first, so a list holds at most 500 added lines; of the lines around a chunk
    only those that a prompt shows are kept. Without ``routes`` the counts are taken beside the chunks, which are then read
    and shuffled once; with ``by_pr`` they are dealt out by PR, for `findings.located`.
    """
    shown = F.slice("context_lines", 1, C.PROMPT_CONTEXT_LINES).alias("context_lines")
    entry = F.struct("chunk_ord", "start_line", "end_line", "added_lines", shown)
    if routes is None:
        of_file = Window.partitionBy("pr_id", "file_path")
        needed = high_chunks.select("pr_id", "file_path", "chunk_ord", "start_line", "end_line", "added_lines", shown)
        counted = (needed.repartition("pr_id") if by_pr else needed).select(
            "*",
            F.sum(F.size("added_lines")).over(of_file).alias("added"), F.min("chunk_ord").over(of_file).alias("file_ord"),
        )
        named = F.col("pr_id").isNotNull() & F.col("file_path").isNotNull()  # as a join on them would have it
        chosen = counted.filter(named & (_route(F.col("added")) == ROUTE_PROMPT))
    else:
        prompt = routes.filter(F.col("route") == ROUTE_PROMPT).select("pr_id", "file_path", "file_ord")
        chosen = high_chunks.join(prompt, ["pr_id", "file_path"])
    return (
        chosen.groupBy("pr_id", "file_path")
        .agg(
            F.min("file_ord").alias("file_ord"),
            F.array_sort(F.collect_list(entry)).alias("chunks"),
        )
    )


def signatures(content: Column) -> Column:
    """Declarations found in a whole file, the first fifty, one per line."""
    found = F.regexp_extract_all(content, F.lit(pattern(C.SIGNATURE_PATTERN)), 0)
    return F.array_join(F.transform(F.slice(found, 1, C.SIGNATURES_PER_FILE), strip), "\n")


def file_signatures(contents: DataFrame, keys: list[str]) -> DataFrame:
    """Signature list per file; files without content are left out."""
    return contents.filter(F.col("content") != "").select(
        *keys, signatures(F.col("content")).alias("signatures")
    )


def budgeted_signatures(
    high_chunks: DataFrame, contents: DataFrame, limit: int = C.SIGNATURE_FILES
) -> DataFrame:
    """Signature lists for the first ``limit`` high-risk files of each PR."""
    files = first_files(high_chunks, limit).select("pr_id", "file_path", "file_rank")
    wanted = contents.join(files, ["pr_id", "file_path"])
    return file_signatures(wanted, ["pr_id", "file_path", "file_rank"])


def changed_files_summary(pr_files: DataFrame) -> DataFrame:
    """Per PR, the declarations added in its first ten files; files without any are passed over."""
    by_place = Window.partitionBy("pr_id").orderBy("file_ord")
    first = (
        pr_files.withColumn("place", F.row_number().over(by_place))
        .filter(F.col("place") <= C.SUMMARY_FILES)
    )
    added = F.filter(lines_of(F.col("patch")), lambda l: l.rlike(pattern(C.PATCH_SIGNATURE_PATTERN)))
    named = F.transform(
        F.slice(added, 1, C.SUMMARY_SIGNATURES), lambda l: strip(F.substring(l, 2, 2147483647))
    )
    lines = (
        first.filter((F.col("filename") != "") & F.col("patch").isNotNull())
        .withColumn("named", named)
        .filter(F.size("named") > 0)
        .select(
            "pr_id", "place",
            F.concat(F.lit("`"), F.col("filename"), F.lit("`: "), F.array_join("named", "; ")).alias("line"),
        )
    )
    ordered = F.array_sort(F.collect_list(F.struct("place", "line")))
    return lines.groupBy("pr_id").agg(
        F.array_join(F.transform(ordered, lambda e: e["line"]), "\n").alias("changed_files_summary")
    )


def pr_context(metadata: DataFrame, summaries: DataFrame) -> DataFrame:
    """Title, body and changed-files summary per PR, and the body as a prompt shows it."""
    joined = metadata.join(summaries, "pr_id", "left")
    body = F.substring("body", 1, C.BODY_CHARS)
    return joined.select(
        "pr_id", "title", body.alias("body"),
        F.coalesce("changed_files_summary", F.lit("")).alias("changed_files_summary"),
        F.when(F.col("title") != "", F.substring(body, 1, C.PROMPT_BODY_CHARS))
        .otherwise("").alias("shown_body"),
    )


def _section(chunk: Column) -> Column:
    context = F.slice(chunk["context_lines"], 1, C.PROMPT_CONTEXT_LINES)
    shown_context = F.when(
        F.size(context) > 0,
        F.concat_ws("\n", F.lit("Around it:"), F.concat_ws("\n", F.transform(context, lambda l: F.concat(F.lit("    "), l)))),
    )
    added = F.transform(chunk["added_lines"], lambda l: F.concat(F.lit("+ "), l))
    return F.concat_ws(
        "\n",
        F.concat(
            F.lit("Lines "), chunk["start_line"].cast("string"), F.lit(" to "),
            chunk["end_line"].cast("string"),
        ),
        shown_context,
        F.lit("New code:"),
        F.concat_ws("\n", added),
    )


def _block(heading: str, text: Column) -> Column:
    """A headed block, or nothing where the text is empty or missing."""
    return F.when(text != "", F.concat(F.lit(heading + "\n"), text))


def prompts(
    files: DataFrame, context: DataFrame, signature_lists: DataFrame, focus: DataFrame
) -> DataFrame:
    """One review prompt per file that goes to review."""
    joined = (
        files.join(context, "pr_id", "left")
        .join(signature_lists.select("pr_id", "file_path", "signatures"), ["pr_id", "file_path"], "left")
        .join(focus, ["pr_id", "file_path"], "left")
    )
    about = F.when(
        F.col("title") != "",
        F.concat_ws("\n", F.concat(F.lit("Title: "), F.col("title")), F.nullif("shown_body", F.lit(""))),
    )
    code = F.array_join(F.transform("chunks", _section), "\n---\n")
    text = F.concat_ws(
        "\n\n",
        _block("# Pull request", about),
        _block("# Declarations added in this pull request", F.col("changed_files_summary")),
        _block("# Declarations in this file", F.col("signatures")),
        _block("# Look closely at", F.concat_ws("\n", F.transform("focus_areas", lambda a: F.concat(F.lit("* "), a)))),
        F.concat(F.lit("# Changes in "), F.col("file_path"), F.lit("\n"), code),
    )
    return joined.select("pr_id", "file_path", "file_ord", F.size("chunks").alias("chunks"), text.alias("prompt"))
