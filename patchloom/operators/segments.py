"""Diffs of any length as blocks of lines, to the same hunks and chunks as `diffs` gives for a diff in one row.

A block is some consecutive lines of one diff. It is cut up in its row, and summed up in a few values: its last path, whether its last
hunk is open, how many hunks it starts, and how far its last piece moves the line counter. These summaries combine from left to
right, so a scan over them tells each block what holds where it begins, and all blocks are finished in parallel. The scan is taken
in two steps, within runs of FAN blocks and over the runs, and sees no lines: no window is longer than a diff's lines / (block * FAN).

What must fit in one row is a block and, as a chunk is a row, the hunks of one chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchloom.functions.constants import FILE_HEADER, HUNK_HEADER, MERGE_GAP
from patchloom.functions.regex import pattern
from patchloom.functions.text import let, lines_of
from patchloom.operators import diffs as D
from patchloom.session import materialize

#: Lines of a block, and blocks (or chunks) of one run of a scan.
LINES, FAN = 4096, 1024

_HUNK_START = pattern("^" + HUNK_HEADER)


def cut(diffs: DataFrame, keys: list[str], lines: int = LINES) -> DataFrame:
    """Blocks (keys, block, text) of diffs that lie in one row each."""
    every = lines_of(F.col("diff"))
    blocks = let(every, lambda ls: F.transform(
        F.sequence(F.lit(0), F.floor((F.size(ls) - 1) / lines).cast("int")), lambda b: F.array_join(F.slice(ls, b * lines + 1, lines), "\n")
    ))
    return diffs.filter(F.length("diff") > 0).select(*keys, F.posexplode(blocks).alias("block", "text")).withColumn("block", F.col("block").cast("bigint"))


def scan(rows: DataFrame, keys: list[str], at: str, last: dict[str, Column] | None = None, total: dict[str, Column] | None = None) -> DataFrame:
    """Adds, for each row, what holds before it among the rows of its keys in the order of `at`, whole numbers from 0 on.

    `last` gives the last value that is not null, `total` the sum. Two windows: within runs of `at`, and over the runs.
    """
    last, total = last or {}, total or {}
    named = rows.select("*", F.floor(F.col(at) / FAN).alias("_run"), *(c.alias(f"_in_{n}") for n, c in {**last, **total}.items()))
    inner = Window.partitionBy(*keys, "_run").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*keys).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)

    def over(names: dict, kind, window: Window, prefix: str, source: str) -> list[Column]:
        return [kind(f"{source}{n}").over(window).alias(f"{prefix}{n}") for n in names]

    def newest(name: str) -> Column:
        return F.last(name, ignorenulls=True)

    within = named.select("*", *over(last, newest, inner, "_w_", "_in_"), *over(total, F.sum, inner, "_w_", "_in_"))
    runs = named.groupBy(*keys, "_run").agg(
        *(F.max_by(f"_in_{n}", F.when(F.col(f"_in_{n}").isNotNull(), F.col(at))).alias(f"_in_{n}") for n in last),
        *(F.sum(f"_in_{n}").alias(f"_in_{n}") for n in total),
    )
    runs = runs.select(*keys, "_run", *over(last, newest, outer, "_o_", "_in_"), *over(total, F.sum, outer, "_o_", "_in_"))
    on = [F.col(f"w.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys] + [F.col("w._run") == F.col("o._run")]
    joined = within.alias("w").join(runs.alias("o"), on)
    return joined.select(
        *(F.col(f"w.{c}") for c in rows.columns),
        *(F.coalesce(f"w._w_{n}", f"o._o_{n}").alias(n) for n in last),
        *((F.coalesce(f"w._w_{n}", F.lit(0)) + F.coalesce(f"o._o_{n}", F.lit(0))).alias(n) for n in total),
    )


def _items(text: Column) -> Column:
    """What a block holds of hunks, in order: the rest of one that is open before it, then those it starts."""

    def of_section(section: Column) -> Column:
        headed = section["text"].startswith(FILE_HEADER)
        parts = F.split(section["text"], pattern(rf"\n(?={HUNK_HEADER})"))

        def item(part: Column) -> Column:
            starts = part.rlike(_HUNK_START)
            return let(lines_of(part), lambda lines: F.struct(
                section["file_path"].alias("path"), headed.alias("headed"), starts.alias("starts"),
                F.when(starts, F.regexp_extract(F.get(lines, F.lit(0)), _HUNK_START, 1).try_cast("bigint")).alias("start"),
                F.filter(F.slice(lines, F.when(starts, 2).otherwise(1), F.size(lines)), lambda l: ~D._is_skipped(l)).alias("body"),
            ))

        return let(parts, lambda ps: F.transform(F.slice(ps, F.when(headed, 2).otherwise(1), F.size(ps)), item))

    return F.flatten(F.transform(D._sections(text), of_section))


def pieces(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows (keys, hunk_ord, block, file_path, start, before, body): what each block holds of each hunk.

    `before` is how far earlier blocks have moved the hunk's line counter. Hunks ahead of the first file header do not count.
    """
    sections = D._sections(F.col("text"))
    cut_up = materialize(blocks.select(
        *keys, "block", _items(F.col("text")).alias("items"),
        let(sections, lambda ss: F.struct(
            F.element_at(ss, -1)["file_path"].alias("path"),
            F.exists(ss, lambda s: s["text"].startswith(FILE_HEADER)).alias("headed"),
            F.element_at(ss, -1)["text"].startswith(FILE_HEADER).alias("ends_headed"),
            F.element_at(ss, -1)["text"].rlike(pattern(rf"(?:\A|\n){HUNK_HEADER}")).alias("ends_in_hunk"),
        )).alias("end"),
    ))
    final = F.try_element_at("items", F.lit(-1))
    has_start = F.exists("items", lambda i: i["starts"])
    moved = F.when(F.size("items") > 0, F.size(F.filter(final["body"], lambda l: ~D.is_removed(l)))).otherwise(0)
    # null where the block has no header of either kind: what held before still holds
    open_after = F.when(F.col("end.ends_in_hunk"), F.lit(True)).when(F.col("end.ends_headed"), F.lit(False))
    narrow = cut_up.select(
        *keys, "block", F.col("end.path").alias("path"), F.col("end.headed").alias("headed"), open_after.alias("open"),
        F.size(F.filter("items", lambda i: i["starts"])).cast("bigint").alias("starts"), moved.cast("bigint").alias("moved"),
        F.when(has_start, F.struct(final["start"].alias("start"))).alias("start"),
    )
    once = scan(
        narrow, keys, "block",
        last={"path_before": F.col("path"), "headed_before": F.when(F.col("headed"), True), "open_before": F.col("open"), "start_before": F.col("start")},
        total={"hunks_before": F.col("starts"), "moved_before": F.col("moved")},
    )
    # the counter of an open hunk: what has been moved since the block that started it, with that block's own last piece
    known = scan(once, keys, "block", last={"reset_at": F.when(F.col("open").isNotNull(), F.col("moved_before"))}).withColumn(
        "before", F.col("moved_before") - F.coalesce("reset_at", F.lit(0))
    )
    carried = ["path_before", "headed_before", "open_before", "start_before", "hunks_before", "before"]
    on = [F.col(f"b.{k}").eqNullSafe(F.col(f"k.{k}")) for k in (*keys, "block")]
    joined = cut_up.alias("b").join(known.alias("k"), on).select(
        *(F.col(f"b.{k}") for k in (*keys, "block", "items")), *(F.col(f"k.{c}") for c in carried)
    )
    rest = F.when(F.get("items", F.lit(0))["starts"], 0).otherwise(1)
    rows = joined.select(*keys, "block", *carried, rest.alias("rest"), F.posexplode("items").alias("at", "item"))
    goes_on = ~F.col("item.starts")
    rows = rows.filter(~goes_on | F.coalesce("open_before", F.lit(False)))
    rows = rows.filter(F.col("item.headed") | F.col("item.path").isNotNull() | F.coalesce("headed_before", F.lit(False)))
    return materialize(rows.select(
        *keys, (F.col("hunks_before") + F.col("at") - F.col("rest")).alias("hunk_ord"), "block",
        F.coalesce("item.path", "path_before").alias("file_path"),
        F.when(goes_on, F.col("start_before.start")).otherwise(F.col("item.start")).alias("start"),
        F.when(goes_on, F.col("before")).otherwise(0).alias("before"), F.col("item.body").alias("body"),
    ))


def _in_order(name: str) -> Column:
    """Lists of the pieces of one group, joined in the order of the diff."""
    listed = F.array_sort(F.collect_list(F.struct("hunk_ord", "block", F.col(name).alias("part"))))
    return F.flatten(F.transform(listed, lambda p: p["part"]))


def hunks(found: DataFrame, keys: list[str]) -> DataFrame:
    """Every hunk as one row, as `diffs.hunks` has it; hunk_ord leaves out hunks ahead of the first file header."""
    return found.groupBy(*keys, "hunk_ord").agg(
        F.min_by("file_path", "block").alias("file_path"), F.min_by("start", "block").alias("start"), _in_order("body").alias("body")
    )


def new_side_lines(found: DataFrame, keys: list[str]) -> DataFrame:
    """Lines of the new side with their numbers, piece by piece: no hunk is put together for it."""
    kept = F.filter("body", lambda l: ~D.is_removed(l))
    return found.select(*keys, "hunk_ord", "file_path", "start", "before", F.posexplode(kept).alias("at", "line")).select(
        *keys, "hunk_ord", "file_path", (F.col("start") + F.col("before") + F.col("at")).alias("line_no"), D.is_added(F.col("line")).alias("is_added"), "line"
    )


def _spans(found: DataFrame, keys: list[str]) -> DataFrame:
    """Narrow rows of the hunks that become chunks: file, first line and line of the last addition."""
    body = F.col("body")
    from_end = F.array_position(F.transform(F.reverse(body), D.is_added), F.lit(True)).cast("int")
    ahead = F.slice(body, 1, F.greatest(F.size(body) - from_end, F.lit(0)))
    last_added = F.when(from_end > 0, F.col("before") + F.size(F.filter(ahead, lambda l: ~D.is_removed(l))))
    rows = found.withColumn("last_added", last_added).groupBy(*keys, "hunk_ord").agg(
        F.min_by("file_path", "block").alias("file_path"), F.min_by("start", "block").alias("start_line"),
        F.max("last_added").alias("last_added"), F.max(F.col("start").isNull()).alias("unreadable"),
    )
    bad = rows.filter("unreadable").select(*keys).distinct()
    fine = rows.join(bad, keys, "left_anti").drop("unreadable").filter(F.col("last_added").isNotNull())
    return fine.filter(F.coalesce(D.is_reviewable(F.col("file_path")), F.lit(False))).withColumn("end_line", F.col("start_line") + F.col("last_added")).drop("last_added")


def _assembled(found: DataFrame, numbered: DataFrame, keys: list[str], group: str = "chunk_ord") -> DataFrame:
    """Chunk rows from the pieces of the hunks in `numbered` (keys, hunk_ord, chunk_ord, file_path, start_line, end_line).

    Pieces go through the shuffles with their lines once; what a chunk holds of them is told apart when they are together. `group`:
    the column that brings them together, `hunk_ord` where each hunk is a chunk, which leaves them where the join put them.
    """
    parts = found.select(*keys, "hunk_ord", "block", "body")
    grouped = parts.join(numbered, [*keys, "hunk_ord"]).groupBy(*keys, group).agg(
        *([] if group == "chunk_ord" else [F.first("chunk_ord").alias("chunk_ord")]),
        F.min_by("file_path", "hunk_ord").alias("file_path"), F.min_by("start_line", "hunk_ord").alias("start_line"),
        F.max_by("end_line", "hunk_ord").alias("end_line"), _in_order("body").alias("body"),
    )
    body = F.col("body")

    def text(lines: Column) -> Column:
        return F.transform(lines, lambda l: F.substring(l, 2, 2147483647))

    raw = F.when(F.size(body) > 0, F.concat(F.array_join(body, "\n"), F.lit("\n"))).otherwise("")
    return grouped.select(
        *keys, "chunk_ord", "file_path", "start_line", "end_line", text(F.filter(body, D.is_added)).alias("added_lines"),
        text(F.filter(body, lambda l: l.startswith(" "))).alias("context_lines"), raw.alias("raw_patch"),
    )


def parse_blocks(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Chunk rows of diffs in blocks, before merging: equal to `diffs.parse_diffs` on whole diffs. Keys are not null."""
    found = pieces(blocks, keys)
    spans = scan(_spans(found, keys), keys, "hunk_ord", total={"chunk_ord": F.lit(1).cast("bigint")})
    return _assembled(found, spans, keys, "hunk_ord")


def review_blocks(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Chunk rows after merging neighbours: equal to `diffs.review_chunks`."""
    found = pieces(blocks, keys)
    spans = materialize(_spans(found, keys))
    near = scan(spans, keys, "hunk_ord", last={"left": F.struct("file_path", "end_line")})
    apart = (
        F.col("left").isNull() | (F.col("left.file_path") != F.col("file_path"))
        | (F.col("start_line") - F.col("left.end_line") >= MERGE_GAP)
    )
    broken = near.withColumn("apart", apart.cast("bigint")).drop("left")
    numbered = scan(broken, keys, "hunk_ord", total={"chunk_ord": F.col("apart")})
    return _assembled(found, numbered.withColumn("chunk_ord", F.col("chunk_ord") + F.col("apart") - 1).drop("apart"), keys)
