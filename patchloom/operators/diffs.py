"""Unified diffs to chunks of added code.

A diff is one value of one row, so it is cut up inside its row: into file sections, hunks and lines,
by array expressions, with no shuffle and no sort. Only the final chunks become rows. Positions come
from filtering index sequences, which keeps each step linear in the length of the diff.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchloom.functions.constants import (
    CODE_EXTENSIONS,
    FILE_HEADER,
    HUNK_HEADER,
    MERGE_GAP,
    SAMPLE_MAX_LINES,
    SAMPLE_MIN_LINES,
    SKIPPED_LINES,
    SKIPPED_PATHS,
)
from patchloom.functions.regex import pattern
from patchloom.functions.text import extension, let, lines_of

CHUNK_COLUMNS = [
    "chunk_ord", "file_path", "start_line", "end_line", "added_lines", "context_lines", "raw_patch",
]

_NEW_SIDE_START = pattern("^" + HUNK_HEADER)


def is_reviewable(path: Column) -> Column:
    """A code file that is neither generated nor vendored."""
    skipped = pattern("|".join(SKIPPED_PATHS))
    return extension(path).isin(CODE_EXTENSIONS) & ~path.rlike(skipped)


def is_added(line: Column) -> Column:
    return line.startswith("+") & ~line.startswith("+++")


def is_removed(line: Column) -> Column:
    return line.startswith("-") & ~line.startswith("---")


def _is_skipped(line: Column) -> Column:
    first, *others = [line.startswith(s) for s in SKIPPED_LINES]
    for other in others:
        first = first | other
    return first


def _sections(diff: Column) -> Column:
    """File sections as (file_path, text); a header that names no path keeps the path before it."""
    pieces = F.split(diff, rf"\n(?={FILE_HEADER})")

    def named(piece: Column) -> Column:
        path = F.when(
            piece.startswith(FILE_HEADER), F.regexp_extract(piece, r"(?d)\A[^\n]*? b/(.+)", 1)
        )
        return F.struct(F.nullif(path, F.lit("")).alias("file_path"), piece.alias("text"))

    def carried(all_named: Column) -> Column:
        return F.transform(
            all_named,
            lambda s, i: F.struct(
                F.when(s["file_path"].isNotNull(), s["file_path"])
                # rare, so the look back over earlier sections is taken only here
                .otherwise(
                    F.get(
                        F.filter(
                            F.reverse(F.slice(all_named, 1, i + 1)),
                            lambda e: e["file_path"].isNotNull(),
                        ),
                        F.lit(0),
                    )["file_path"]
                ).alias("file_path"),
                s["text"].alias("text"),
            ),
        )

    return let(F.transform(pieces, named), carried)


def _hunks(section: Column) -> Column:
    """Hunks of a section as (file_path, start, body lines); lines before the first are ignored."""
    pieces = F.split(section["text"], pattern(rf"\n(?={HUNK_HEADER})"))
    after_header = F.when(
        section["text"].startswith(FILE_HEADER), F.slice(pieces, 2, F.size(pieces))
    ).otherwise(F.array().cast("array<string>"))

    def hunk(piece: Column) -> Column:
        return let(
            lines_of(piece),
            lambda lines: F.struct(
                section["file_path"].alias("file_path"),
                F.regexp_extract(F.get(lines, F.lit(0)), _NEW_SIDE_START, 1).try_cast("bigint").alias("start"),
                F.filter(F.slice(lines, 2, F.size(lines)), lambda l: ~_is_skipped(l)).alias("body"),
            ),
        )

    return F.transform(after_header, hunk)


def _chunk(hunk: Column) -> Column:
    """A hunk as a chunk; ``end_line`` is the new-side number of its last added line."""
    body = hunk["body"]
    from_end = F.array_position(F.transform(F.reverse(body), is_added), F.lit(True)).cast("int")
    before_last = F.slice(body, 1, F.greatest(F.size(body) - from_end, F.lit(0)))
    return F.struct(
        hunk["file_path"].alias("file_path"),
        hunk["start"].alias("start_line"),
        (hunk["start"] + F.size(F.filter(before_last, lambda l: ~is_removed(l)))).alias("end_line"),
        F.transform(F.filter(body, is_added), lambda l: F.substring(l, 2, 2147483647)).alias("added_lines"),
        F.transform(
            F.filter(body, lambda l: l.startswith(" ")), lambda l: F.substring(l, 2, 2147483647)
        ).alias("context_lines"),
        F.concat(F.array_join(body, "\n"), F.lit("\n")).alias("raw_patch"),
    )


def _chunks(diff: Column) -> Column:
    """All chunks of a diff in order: reviewable files only, and only hunks that add a line.

    A diff with a hunk header that can't be read has none: its line numbers can't be trusted.
    """
    reviewable = F.filter(_sections(diff), lambda s: F.coalesce(is_reviewable(s["file_path"]), F.lit(False)))
    adding = F.filter(
        F.flatten(F.transform(reviewable, _hunks)), lambda h: F.exists(h["body"], is_added)
    )
    chunks = F.transform(adding, _chunk)
    return F.when(has_unreadable_header(diff), F.slice(chunks, 1, 0)).otherwise(chunks)


def has_unreadable_header(diff: Column) -> Column:
    """Whether a hunk header names a line number that is too large or not in ASCII digits."""
    starts = F.regexp_extract_all(diff, F.lit(pattern("(?m)^" + HUNK_HEADER)), F.lit(1))
    return F.exists(starts, lambda n: n.try_cast("bigint").isNull())


def _merged(chunks: Column) -> Column:
    """Neighbours in the same file with a gap under ten lines become one chunk.

    A merged chunk ends where its last member ends, so each break depends on two neighbours only:
    the break positions cut the list into runs.
    """

    def runs(cs: Column) -> Column:
        def breaks(i: Column) -> Column:
            here, before = F.get(cs, i), F.get(cs, i - 1)
            return (
                (i == 0)
                | (here["file_path"] != before["file_path"])
                | (here["start_line"] - before["end_line"] >= MERGE_GAP)
            )

        every = F.when(F.size(cs) > 0, F.sequence(F.lit(0), F.size(cs) - 1)).otherwise(
            F.array().cast("array<int>")
        )
        return let(
            F.filter(every, breaks),
            lambda starts: F.transform(
                starts,
                lambda s, k: F.slice(
                    cs, s + 1, F.coalesce(F.get(starts, k + 1), F.size(cs)) - s
                ),
            ),
        )

    def fused(run: Column) -> Column:
        first, last = F.get(run, F.lit(0)), F.get(run, F.size(run) - 1)
        return F.struct(
            first["file_path"].alias("file_path"),
            first["start_line"].alias("start_line"),
            last["end_line"].alias("end_line"),
            F.flatten(F.transform(run, lambda c: c["added_lines"])).alias("added_lines"),
            F.flatten(F.transform(run, lambda c: c["context_lines"])).alias("context_lines"),
            F.array_join(F.transform(run, lambda c: c["raw_patch"]), "").alias("raw_patch"),
        )

    return F.transform(let(chunks, runs), fused)


def _as_rows(diffs: DataFrame, keys: list[str], items: Column, position: str) -> DataFrame:
    # the outer form keeps the optimizer from computing ``items`` a second time for a size filter
    rows = diffs.select(*keys, F.posexplode_outer(items).alias("at", "item"))
    return rows.filter(F.col("at").isNotNull()).select(
        *keys, F.col("at").cast("bigint").alias(position), "item.*"
    )


def diff_lines(diffs: DataFrame, keys: list[str]) -> DataFrame:
    """Lines of each diff, split on newline only."""
    return diffs.select(*keys, F.posexplode(lines_of(F.col("diff"))).alias("line_no", "line"))


def file_sections(diffs: DataFrame, keys: list[str]) -> DataFrame:
    """Parts of each diff that start with a file header, with the file they belong to."""
    sections = F.filter(_sections(F.col("diff")), lambda s: s["text"].startswith(FILE_HEADER))
    return _as_rows(diffs, keys, sections, "section_ord")


def hunks(diffs: DataFrame, keys: list[str]) -> DataFrame:
    """Every hunk of every file, reviewable or not: its file, new-side start and body lines."""
    return _as_rows(
        diffs, keys, F.flatten(F.transform(_sections(F.col("diff")), _hunks)), "hunk_ord"
    )


def new_side_lines(hunk_rows: DataFrame, keys: list[str]) -> DataFrame:
    """Lines of each hunk that exist on the new side, with their line numbers.

    The k-th line that is not a removal has number ``start + k``, so no running sum is needed.
    """
    kept = F.filter("body", lambda l: ~is_removed(l))
    return (
        hunk_rows.select(*keys, "hunk_ord", "file_path", "start", F.posexplode(kept).alias("at", "line"))
        .select(
            *keys, "hunk_ord", "file_path",
            (F.col("start") + F.col("at")).alias("line_no"),
            is_added(F.col("line")).alias("is_added"),
            "line",
        )
    )


def parse_diffs(diffs: DataFrame, keys: list[str]) -> DataFrame:
    """Chunk rows of each diff, before merging."""
    return _as_rows(diffs, keys, _chunks(F.col("diff")), "chunk_ord")


def review_chunks(diffs: DataFrame, keys: list[str]) -> DataFrame:
    """Chunk rows of each diff after merging neighbours: the unit of review."""
    return _as_rows(diffs, keys, _merged(_chunks(F.col("diff"))), "chunk_ord")


def chunk_export(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """The six exported fields of a chunk; the raw patch stays behind."""
    return chunks.select(
        *keys, "file_path", "start_line", "end_line", "added_lines", "context_lines",
        F.size("added_lines").alias("num_added"),
    )


def sample_sized(chunks: DataFrame) -> DataFrame:
    """Chunks of a size worth learning from."""
    return chunks.filter(F.size("added_lines").between(SAMPLE_MIN_LINES, SAMPLE_MAX_LINES))
