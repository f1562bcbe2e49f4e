"""Best-fit packing of documents into token sequences of a fixed length.

Best-fit decreasing looks at lengths only, and a sequence of 1024 tokens knows 1024 lengths. So the plan is made
from the number of pieces per length: lengths in falling order, each going to the fullest sequence that still
has room, found in a segment tree over the remaining capacities. Equal pieces are placed in one step, which
gives the same packing as one at a time. The histogram and the plan have a size that the capacity bounds, whatever
the input; pieces find their places in parallel by their rank among those of their length.

`place` packs all items at once, so its sequences follow the lengths. `place_in_order` keeps an order that the items have,
such as that of a mix: it packs best-fit within consecutive windows of WINDOW sequences' worth of tokens. Sequences of a window
come after those of the windows before, and within it in the order of the items they begin with.

Edge cases: a null text counts as empty and still yields its end id; rows are packed as they are, so repeated
rows and repeated or null ids are packed once per row; an empty table gives an empty result. In `place`, a
length that is null, below 1 or above the capacity has no place (null sequence_id and offset).
"""

from __future__ import annotations

import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from patchloom.llm.tables import materialize, slices
from patchloom.llm.tokens import BLANK_LEADS, encoder

CAPACITY = 1024
END_ID = 2
#: Sequences' worth of tokens that `place_in_order` packs together.
WINDOW = 4096
#: Rows of a file, and of a task, that `in_file_order` can number.
FILE_ROWS = 1 << 40

PIECES = "doc_id long, piece int, start long, length long"


def tokenized_pieces(
    docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID,
    blank: str = BLANK_LEADS, order: str | None = None, checksums: bool = False,
) -> DataFrame:
    """Pieces of at most `capacity` ids per document; only the first piece of a document may be shorter.

    `order` names a column of longs that goes along. `tokens` holds the ids as little-endian unsigned 32-bit integers;
    with `checksums` their CRC-32, `ids_crc32`, stands in their place, and the ids do not leave the worker.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path, blank, end_id).encode
        for batch in slices(batches, text=1):
            flat, lengths = encode(batch.column(1))
            pieces = -(-lengths // capacity)
            doc = np.repeat(np.arange(len(lengths)), pieces)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            first = lengths - (pieces - 1) * capacity
            start = np.where(piece == 0, 0, first[doc] + (piece - 1) * capacity)
            length = np.where(piece == 0, first[doc], capacity)
            begin = (np.cumsum(lengths) - lengths)[doc] + start
            raw = memoryview(flat.astype("<u4").tobytes())
            tokens = (raw[4 * a : 4 * b] for a, b in zip(begin.tolist(), (begin + length).tolist()))
            ids = pa.array(map(zlib.crc32, tokens), pa.int64()) if checksums else pa.array(list(tokens), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start),
                 pa.array(length), ids, *(c.take(pa.array(doc)) for c in batch.columns[2:])],
                names=["doc_id", "piece", "start", "length", "ids_crc32" if checksums else "tokens", *along],
            )

    along = [order] if order else []
    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *along)
    return narrow.mapInArrow(cut, ", ".join([PIECES, "ids_crc32 long" if checksums else "tokens binary", *(f"`{c}` long" for c in along)]))


def in_file_order(docs: DataFrame) -> DataFrame:
    """doc_id, text and _order of `docs`: by the number of the part file that Spark wrote, then by the row in it.

    Spark reads large files first and splits them, so only files know the order in which rows were written. Files of the same
    number are in the order of their paths; files of other names follow in that order. Rows that don't
    come straight from files are in the order of their partitions.
    """
    named = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    path, row = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    try:
        docs.select(path, row).schema  # resolves _metadata
    except AnalysisException:
        # partition in the upper bits, row in the lower 33
        at = F.monotonically_increasing_id()
        return docs.select(*named, (F.shiftright(at, 33) * FILE_ROWS + at % (1 << 33)).alias("_order"))
    number = "try_cast(regexp_extract({}, '/part-([0-9]+)[^/]*$', 1) as long)"
    found = [re.search(r"/part-([0-9]+)[^/]*$", name) for name in docs.inputFiles()]
    if all(found) and len({int(m[1]) for m in found}) == len(found):  # the names alone tell the order
        return docs.select(*named, (F.expr(number.format("_metadata.file_path")) * FILE_ROWS + row).alias("_order"))
    by_name = Window.orderBy(F.expr(number.format("_path")).asc_nulls_last(), "_path")
    ranks = docs.select(path.alias("_path")).distinct().withColumn("_part", F.row_number().over(by_name))  # a row per file
    placed = docs.select(*named, path.alias("_path"), row.alias("_row")).join(ranks, "_path")
    return placed.select("doc_id", "text", (F.col("_part") * FILE_ROWS + F.col("_row")).alias("_order"))


class CapacityTree:
    """Segment tree over remaining capacities: how many open sequences have each, and the least one at or above a length."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, remaining: int, number: int) -> None:
        node = self.leaves + remaining
        while node:
            self.count[node] += number
            node >>= 1

    def tightest(self, length: int) -> int | None:
        node = self.leaves + length
        while not self.count[node]:
            while node & 1:  # a right child: nothing larger below its parent
                node >>= 1
            if not node:
                return None
            node += 1
            if not node & (node - 1):  # past the last leaf of this level
                return None
        while node < self.leaves:
            node *= 2
            if not self.count[node]:
                node += 1
        return node - self.leaves


def best_fit_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Best-fit decreasing over `histogram` (length: number of items).

    Rows (length, first rank, first sequence, items per sequence, offset): items of that length from that rank on fill the
    sequences from the first on, so many in each, beginning at the offset.
    """
    tree, open_by_room, plan, sequences = CapacityTree(capacity), {}, [], 0

    def put(room: int, first: int, number: int) -> None:
        if number and room:
            open_by_room.setdefault(room, deque()).append((first, number))
            tree.add(room, number)

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = tree.tightest(length)
            if room is None:  # none fits: open as many as the rest needs
                room, per = capacity, capacity // length
                first, number = sequences, -(-left // per)
                sequences += number
            else:
                first, number = open_by_room[room].popleft()
                tree.add(room, -number)
                per = room // length
            used = min(number, -(-left // per))
            items = min(left, used * per)
            whole = items // per
            plan.append((length, rank, first, per, capacity - room))
            put(room - per * length, first, whole)
            put(room - (items - whole * per) * length, first + whole, used - whole)
            put(room, first + used, number - used)
            rank, left = rank + items, left - items
    return np.array(plan, np.int64).reshape(-1, 5)


def place(items: DataFrame, length: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """`items` with sequence_id and offset, packed best-fit decreasing by the column `length`; all columns stay."""
    kept = items.columns
    taken = T.StructType([
        *items.schema, T.StructField("_bf_size", T.IntegerType()),
        T.StructField("_bf_task", T.IntegerType()), T.StructField("_bf_rank", T.LongType()),
    ])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rank of each item among those of its size in this task."""
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            size = batch.column(batch.num_columns - 1).fill_null(0).to_numpy(zero_copy_only=False)
            order = np.argsort(size, kind="stable")
            begin = np.searchsorted(size[order], size)
            rank = np.empty(len(size), np.int64)
            rank[order] = np.arange(len(size))
            rank += seen[size] - begin
            seen += np.bincount(size, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(size), task, np.int32)), pa.array(rank)],
                names=[*batch.schema.names, "_bf_task", "_bf_rank"],
            )

    valid = F.col(length).between(1, capacity)
    sized = items.withColumn("_bf_size", F.when(valid, F.col(length)).otherwise(0).cast("int"))
    # stored before they are numbered, so that no task runs the workers of two Python steps at once
    ranked = materialize(materialize(sized).mapInArrow(number, taken))
    counts = ranked.groupBy("_bf_task", "_bf_size").agg(F.count("*").alias("_bf_n"))
    before = Window.partitionBy("_bf_size").orderBy("_bf_task").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = counts.select(
        "_bf_task", "_bf_size", F.coalesce(F.sum("_bf_n").over(before), F.lit(0)).alias("_bf_before")
    )
    histogram = counts.groupBy("_bf_size").agg(F.sum("_bf_n").alias("n")).collect()  # capacity + 1 rows at most
    plan = best_fit_plan({r[0]: r[1] for r in histogram if r[0]}, capacity)
    sizes, ranks, firsts, pers, begins = plan.T if len(plan) else np.zeros((5, 1), np.int64)
    runs = sizes * (1 << 44) + ranks
    order = np.argsort(runs)
    runs, firsts, pers, begins, ranks = (x[order] for x in (runs, firsts, pers, begins, ranks))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = (batch.column(batch.num_columns - k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (2, 1))
            none = size == 0
            run = np.where(none, 0, np.searchsorted(runs, size * (1 << 44) + rank, side="right") - 1)
            at, per = rank - ranks[run], np.maximum(pers[run], 1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(kept)], pa.array(firsts[run] + at // per, mask=none),
                 pa.array(begins[run] + at % per * size, mask=none)],
                names=[*kept, "sequence_id", "offset"],
            )

    placed = ranked.join(offsets, ["_bf_task", "_bf_size"]).select(
        *(F.col(f"`{c}`") for c in kept), "_bf_size",
        (F.col("_bf_before") + F.col("_bf_rank")).alias("_bf_rank"),
    )
    out = T.StructType([
        *items.schema, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())
    ])
    return placed.mapInArrow(assign, out)


def place_in_order(items: DataFrame, order: str, length: str = "length", capacity: int = CAPACITY, window: int = WINDOW) -> DataFrame:
    """`items` with sequence_id and offset, packed best-fit decreasing within consecutive windows of the column `order`.

    `order` holds longs as `in_file_order` makes them: a part, and the row within it. Items of equal order follow by doc_id
    and piece. Lengths are from 1 to the capacity.
    """
    kept = items.columns
    stored = materialize(items.withColumn("_bf_part", F.floor(F.col(order) / FILE_ROWS).cast("long")))
    sums = stored.groupBy("_bf_part").agg(F.sum(length).alias("n"))  # a row per part file
    earlier = Window.orderBy("_bf_part").rowsBetween(Window.unboundedPreceding, -1)
    begins = sums.select("_bf_part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_bf_begin"))
    within = Window.partitionBy("_bf_part").orderBy(order, "doc_id", "piece").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum(length).over(within), F.lit(0))
    placed_at = stored.withColumn("_bf_at", inside).join(begins, "_bf_part").withColumn("_bf_at", F.col("_bf_at") + F.col("_bf_begin"))
    windowed = placed_at.select(
        *(F.col(f"`{c}`") for c in kept), "_bf_at", F.floor(F.col("_bf_at") / (window * capacity)).cast("long").alias("_bf_window")
    )

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("_bf_at")
        size = table.column(length).to_numpy().astype(np.int64)
        plan = best_fit_plan({int(s): int(n) for s, n in zip(*np.unique(size, return_counts=True))}, capacity)
        by_size = np.argsort(size, kind="stable")
        rank = np.empty(len(size), np.int64)
        rank[by_size] = np.arange(len(size)) - np.searchsorted(size[by_size], size[by_size])
        runs = plan[:, 0] * (1 << 44) + plan[:, 1]
        plan, runs = plan[np.argsort(runs)], np.sort(runs)
        _, ranks, firsts, pers, begins = plan[np.searchsorted(runs, size * (1 << 44) + rank, side="right") - 1].T
        made = firsts + (rank - ranks) // pers
        offset = begins + (rank - ranks) % pers * size
        number = np.empty(int(made.max()) + 1, np.int64)  # in the order of the items that begin a sequence
        leads = made[offset == 0]
        number[leads] = np.arange(len(leads))
        out = table.select([*kept, "_bf_window"])
        return out.append_column("_bf_own", pa.array(number[made])).append_column("offset", pa.array(offset))

    out = T.StructType([
        *items.schema, T.StructField("_bf_window", T.LongType()), T.StructField("_bf_own", T.LongType()), T.StructField("offset", T.LongType())
    ])
    packed = materialize(windowed.groupBy("_bf_window").applyInArrow(pack, out))
    numbers = packed.groupBy("_bf_window").agg((F.max("_bf_own") + 1).alias("n"))  # a row per window
    past = Window.orderBy("_bf_window").rowsBetween(Window.unboundedPreceding, -1)
    bases = numbers.select("_bf_window", F.coalesce(F.sum("n").over(past), F.lit(0)).alias("_bf_base"))
    return packed.join(bases, "_bf_window").select(
        *(F.col(f"`{c}`") for c in kept), (F.col("_bf_base") + F.col("_bf_own")).alias("sequence_id"), "offset"
    )


def sequences(placed: DataFrame) -> DataFrame:
    """The packed sequences themselves from pieces that still have their tokens: sequence_id, length, tokens."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "tokens")))  # a sequence holds `capacity` pieces at most
    return placed.groupBy("sequence_id").agg(
        F.sum("length").alias("length"), parts.alias("parts")
    ).select("sequence_id", "length", F.expr("concat_ws('', transform(parts, p -> hex(p.tokens)))").alias("hex")).select(
        "sequence_id", "length", F.unhex("hex").alias("tokens")
    )
