"""Mixing sources to target weights by Pfair scheduling. Only DataFrame and SQL functions.

Each source is cut into blocks of about equal length. With whole-number weights n and their sum D, the k-th block of a
source (from 0) is released at slot floor(k D / n) and due at slot ceil((k + 1) D / n); in every slot the released
block that is due first goes next, ties to the lesser source name. So after any number of slots each source is less than
one block away from its share. The order repeats after D slots, so one frame of D slots is worked out per set of
sources and holds for all their blocks: nothing runs over the data one block after the other.

Nothing is dropped or repeated: a source whose blocks are used up leaves, and from the next frame on the others share the slots by
their weights (a phase). In its last frame a source may leave slots empty.

Documents are ordered within their source by id (nulls first, then by length). They are stored with a row number, and narrow rows of
source, id and length are dealt out by ranges of (source, id, length, row number): a source with most of the rows, or an id that very many rows
share, spreads over many tasks whatever the ids look like. One sum per source and range is carried on to later ranges. Texts move once, when
they join their places by row number.

The frame of a phase costs its slots times its sources, and a source opens one phase at most; phases are worked out over all tasks, but each
in one row. That suits up to some thousands of sources.

Edge cases: a null source is the source ''; a null text has length 0; repeated rows are all kept; a document longer
than a block takes the slot of the block in which it begins; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from patchloom.llm.tables import materialize

BLOCK_CHARS = 16_384

_FRAME = """
    aggregate(
        sequence(0L, slots - 1),
        named_struct('todo', transform(members, x -> named_struct('source', x.source, 'n', x.n, 'done', 0L)),
                     'taken', cast(array() as array<string>)),
        (state, t) -> transform(
            array(array_min(transform(
                filter(state.todo, x -> x.done < x.n and x.done * slots div x.n <= t),
                x -> named_struct('due', ((x.done + 1) * slots + x.n - 1) div x.n, 'source', x.source)
            )).source),
            next -> named_struct(
                'todo', transform(state.todo, x -> named_struct(
                    'source', x.source, 'n', x.n, 'done', if(x.source = next, x.done + 1, x.done))),
                'taken', concat(state.taken, array(next)))
        )[0],
        state -> state.taken)
"""


def _weight(source: Column, weights: dict[str, int], default: int) -> Column:
    if default < 1 or any(w < 1 for w in weights.values()):
        raise ValueError("weights are whole numbers from 1 on")
    return F.coalesce(*(F.when(source == s, F.lit(w)) for s, w in sorted(weights.items())), F.lit(default)).cast("long")


def _order() -> list[Column]:
    return [F.asc_nulls_first("_mix_id"), F.asc("_mix_chars"), F.asc("_mix_row")]


def _ranged(stored: DataFrame) -> DataFrame:
    """Narrow rows with the range they lie in, _mix_part; stored, so that a row keeps its range."""
    parts = int(stored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    narrow = stored.select("_mix_row", "_mix_source", F.col("doc_id").alias("_mix_id"), "_mix_chars")
    return materialize(narrow.repartitionByRange(parts, "_mix_source", *_order()).withColumn("_mix_part", F.spark_partition_id()))


def _started(stored: DataFrame) -> DataFrame:
    """_mix_row, _mix_source and _mix_start (characters of the source before the document) of all stored rows."""
    ranged = _ranged(stored)
    run = ["_mix_source", "_mix_part"]
    earlier = Window.partitionBy("_mix_source").orderBy("_mix_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy(*run).agg(F.sum("_mix_chars").alias("_mix_sum"))  # a row per source and range
    begins = sums.select(*run, F.coalesce(F.sum("_mix_sum").over(earlier), F.lit(0)).alias("_mix_begin"))
    within = Window.partitionBy(*run).orderBy(*_order()).rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("_mix_chars").over(within), F.lit(0))
    return ranged.withColumn("_mix_inside", inside).join(begins, run).select(
        "_mix_row", "_mix_source", (F.col("_mix_begin") + F.col("_mix_inside")).alias("_mix_start")
    )


def frames(sizes: DataFrame) -> DataFrame:
    """The frame of each phase from (source, n, blocks): source, k (its k-th slot of the frame), slot, since, until, slots, begin.

    A phase holds for the frames since .. until - 1, has `slots` slots a frame and begins at slot `begin` of all.
    """
    lasting = sizes.withColumn("until", F.expr("(blocks + n - 1) div n"))
    every = lasting.agg(F.collect_list(F.struct("source", "n", "until")).alias("all"))  # a row per source
    phases = every.select("all", F.expr("explode(array_sort(array_distinct(transform(all, x -> x.until))))").alias("until"))
    ordered = Window.orderBy("until")  # a phase per source at most
    phases = (
        phases.withColumn("since", F.coalesce(F.lag("until").over(ordered), F.lit(0)))
        .withColumn("members", F.expr("filter(all, x -> x.until >= until)"))
        .withColumn("slots", F.expr("aggregate(members, 0L, (a, x) -> a + x.n)"))
        .withColumn("begin", F.coalesce(
            F.sum(F.expr("(until - since) * slots")).over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ))
    )
    # spread: otherwise the one row of all sources keeps every phase in its task
    phases = phases.repartition(int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "until")
    taken = phases.select("since", "until", "slots", "begin", F.posexplode(F.expr(_FRAME)).alias("slot", "source"))
    turns = Window.partitionBy("until", "source").orderBy("slot")
    return taken.withColumn("k", F.row_number().over(turns) - 1)


def mix(
    docs: DataFrame, weights: dict[str, int], default: int = 1, block_chars: int = BLOCK_CHARS, length: str | None = None,
) -> DataFrame:
    """`docs` with block (of the source, from 0), position (slot of that block in the mix) and start (place in the source).

    Rows ordered by position, start and id are the mix. `length` names a column with the lengths of documents; without it
    they are the characters of `text`.
    """
    chars = F.col(f"`{length}`") if length else F.char_length("text")
    stored = materialize(docs.withColumns({
        "_mix_source": F.coalesce(F.col("source").cast("string"), F.lit("")),
        "_mix_chars": F.coalesce(chars, F.lit(0)).cast("long"),
        "_mix_row": F.monotonically_increasing_id(),
    }))
    own = _weight(F.col("_mix_source"), weights, default)
    started = materialize(_started(stored).withColumn("_mix_block", F.expr(f"_mix_start div {block_chars}")))
    sizes = (
        started.groupBy(F.col("_mix_source").alias("source")).agg((F.max("_mix_block") + 1).alias("blocks"))
        .withColumn("n", _weight(F.col("source"), weights, default))
    )
    frame = materialize(frames(sizes))
    plan = frame.select(*(F.col(c).alias(f"_mix_{c}") for c in ("source", "k", "slot", "since", "until", "slots", "begin")))
    turns = started.withColumn("_mix_frame", F.floor(F.col("_mix_block") / own)).withColumn("_mix_k", F.col("_mix_block") % own)
    placed = (
        turns.join(plan, ["_mix_source", "_mix_k"])
        .filter("_mix_frame >= _mix_since and _mix_frame < _mix_until")
        .select(
            "_mix_row", F.col("_mix_block").alias("block"),
            F.expr("_mix_begin + (_mix_frame - _mix_since) * _mix_slots + _mix_slot").alias("position"),
            F.col("_mix_start").alias("start"),
        )
    )
    given = stored.select("_mix_row", *(F.col(f"`{c}`") for c in docs.columns if c not in ("block", "position", "start")))
    return given.join(placed, "_mix_row").drop("_mix_row")


def oracle(weights: dict[str, int], default: int = 1, block_chars: int = BLOCK_CHARS) -> str:
    """DuckDB SQL for doc_id, source, block, position and start over `documents`."""
    cases = " ".join(f"WHEN '{s}' THEN {w}" for s, w in sorted(weights.items()))
    return f"""
    WITH RECURSIVE placed AS (
        SELECT doc_id, coalesce(source, '') AS source, coalesce(length(text), 0) AS chars,
               CASE coalesce(source, '') {cases} ELSE {default} END AS n FROM documents),
    started AS (
        SELECT doc_id, source, n, cast(coalesce(sum(chars) OVER (
            PARTITION BY source ORDER BY doc_id NULLS FIRST, chars ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
        FROM placed),
    sources AS (SELECT source, n, (max(start // {block_chars}) + 1 + n - 1) // n AS until FROM started GROUP BY source, n),
    ends AS (SELECT until, coalesce(lag(until) OVER (ORDER BY until), 0) AS since FROM (SELECT DISTINCT until FROM sources)),
    phases AS (
        SELECT e.until, e.since, sum(s.n)::BIGINT AS slots, list({{'source': s.source, 'n': s.n}}) AS members
        FROM ends e JOIN sources s ON s.until >= e.until GROUP BY e.until, e.since),
    begun AS (
        SELECT *, coalesce(sum((until - since) * slots) OVER (
            ORDER BY until ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin_at FROM phases),
    turns AS (
        SELECT until, slots, members, 0::BIGINT AS t, []::VARCHAR[] AS taken FROM begun
        UNION ALL
        SELECT until, slots, members, t + 1, list_append(taken, list_sort(list_transform(
            list_filter(
                list_transform(members, lambda x: {{'source': x.source, 'n': x.n, 'done': len(list_filter(taken, lambda y: y = x.source))}}),
                lambda x: x.done < x.n AND x.done * slots // x.n <= t),
            lambda x: {{'due': ((x.done + 1) * slots + x.n - 1) // x.n, 'source': x.source}}))[1].source)
        FROM turns WHERE t < slots),
    slots AS (
        SELECT until, unnest(taken) AS source, generate_subscripts(taken, 1) - 1 AS slot FROM turns WHERE t = slots),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY until, source ORDER BY slot) - 1 AS k FROM slots)
    SELECT d.doc_id, d.source, d.start // {block_chars} AS block,
           cast(b.begin_at + (d.start // {block_chars} // d.n - b.since) * b.slots + s.slot AS BIGINT) AS position, d.start
    FROM started d
    JOIN begun b ON d.start // {block_chars} // d.n >= b.since AND d.start // {block_chars} // d.n < b.until
    JOIN numbered s ON s.until = b.until AND s.source = d.source AND s.k = (d.start // {block_chars}) % d.n
    """
