"""Token ids as files of a static range asymmetric numeral system.

A file holds some millions of ids of consecutive documents. One frequency table, shared by all blocks of the file, gives each
symbol its share of 2**20. A block of LANES x STEPS ids is coded by LANES interleaved states that share one stream of
32-bit words, and stands alone. Every CHECKPOINT steps the states and the place in the stream are kept, so that
the pieces between checkpoints, of one block or of many, are decoded side by side; that is also how numpy is kept busy.
Table, document list and blocks carry CRC-32 checksums.

Layout: magic; table; documents; blocks; footer (JSON: parameters, and offset, length, checksum of each part); length of the footer as
4 bytes; magic. Integers are little-endian.

Files are written with the folder's own file system, under a name of each attempt's own; only files that the stored manifest
names count, so lost or repeated tasks leave no trace in the result.

Edge cases: a null text counts as empty and still has its end id; documents without an id come first; equal ids are ordered by
text; an empty table gives no file and an empty result. A document is never cut, so a file is as long as its last document needs.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from patchloom.llm.tables import materialize, slices
from patchloom.llm.tokens import BLANK_DROPS, encoder

MAGIC = b"LOOMRANS"
PROBABILITY_BITS = 20
LANES, STEPS, CHECKPOINT = 32, 1024, 256
#: Ids after which a file ends, and blocks coded at once.
FILE_IDS, GROUP = 1 << 21, 16
END_ID = 2

_LOW = np.uint64(1 << 31)
_WORD = np.uint64(32)


class CorruptFile(ValueError):
    """A checksum or a length of a file is not what its footer says."""


# ---------------------------------------------------------------- frequencies


def normalise(counts: np.ndarray, bits: int = PROBABILITY_BITS) -> np.ndarray:
    """Shares of 2**bits in proportion to `counts`, at least 1 for whatever occurs."""
    total = 1 << bits
    if len(counts) > total:
        raise ValueError("more symbols than shares")
    shares = np.maximum(1, np.floor(counts * (total / counts.sum())).astype(np.int64))
    over = int(shares.sum()) - total
    order = np.argsort(-shares, kind="stable")
    if over < 0:
        shares[order[0]] -= over
    while over > 0:  # take back from the largest, never below 1
        cut = np.minimum(shares[order] - 1, -(-over // len(order)))
        cut = np.minimum(cut, np.maximum(0, over - (np.cumsum(cut) - cut)))
        shares[order] -= cut
        over -= int(cut.sum())
    return shares


# ---------------------------------------------------------------- coding


def _encode_grid(symbols: np.ndarray, share: np.ndarray, below: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Codes blocks symbols[step, block, lane]; per block its words, checkpoint states and checkpoint places."""
    steps, blocks, lanes = symbols.shape
    bits = np.uint64(PROBABILITY_BITS)
    x = np.full((blocks, lanes), _LOW, np.uint64)
    words, told = np.empty(symbols.shape, np.uint32), np.empty(symbols.shape, bool)
    states = np.empty((-(-steps // CHECKPOINT), blocks, lanes), np.uint64)
    for t in range(steps - 1, -1, -1):
        f = share[symbols[t]]
        full = x >= f << (np.uint64(63) - bits)
        words[t], told[t] = x.astype(np.uint32), full
        x = np.where(full, x >> _WORD, x)
        q = x // f
        x = (q << bits) + (x - q * f) + below[symbols[t]]
        if t % CHECKPOINT == 0:
            states[t // CHECKPOINT] = x
    per_step = told.sum(axis=2)
    upto = np.concatenate([np.zeros((1, blocks), np.int64), np.cumsum(per_step, axis=0)])
    return [
        (words[:, b][told[:, b]], states[:, b], upto[:steps:CHECKPOINT, b].astype(np.uint32)) for b in range(blocks)
    ]


def _decode_units(
    stream: np.ndarray, states: np.ndarray, places: np.ndarray, steps: int, share: np.ndarray, below: np.ndarray, symbol_at: np.ndarray
) -> np.ndarray:
    """Symbols [step, unit, lane] of units that begin at `places` of the stream with the given states."""
    bits, mask = np.uint64(PROBABILITY_BITS), np.uint64((1 << PROBABILITY_BITS) - 1)
    x, at, last = states.copy(), places.astype(np.int64), max(len(stream) - 1, 0)
    out = np.empty((steps, *x.shape), symbol_at.dtype)
    if not len(stream):
        stream = np.zeros(1, np.uint32)
    for t in range(steps):
        slot = x & mask
        symbol = symbol_at[slot]
        out[t] = symbol
        x = share[symbol] * (x >> bits) + slot - below[symbol]
        low = x < _LOW
        read = np.cumsum(low, axis=1)
        x = np.where(low, x << _WORD | stream[np.minimum(at[:, None] + read - low, last)], x)
        at += read[:, -1]
    return out


# ---------------------------------------------------------------- files


def encode_file(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """A whole file: `lengths` ids for each document, one document after the other."""
    every = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)  # as long as the vocabulary
    symbols = np.flatnonzero(every)
    counts, numbers = every[symbols], (np.cumsum(every > 0, dtype=np.int32) - 1)[ids]
    shares = normalise(counts) if len(counts) else np.zeros(0, np.int64)
    share, below = shares.astype(np.uint64), (np.cumsum(shares) - shares).astype(np.uint64)
    parts, footer = [MAGIC], {"bits": PROBABILITY_BITS, "lanes": LANES, "ids": len(ids), "docs": len(doc_ids), "blocks": []}
    at = len(MAGIC)

    def add(body: bytes) -> list[int]:
        nonlocal at
        parts.append(body)
        at += len(body)
        return [at - len(body), len(body), zlib.crc32(body)]

    known = np.array([d is not None for d in doc_ids], np.uint8)
    named = np.array([d or 0 for d in doc_ids], "<i8")
    footer["table"] = add(zlib.compress(np.diff(symbols, prepend=0).astype("<u4").tobytes() + shares.astype("<u4").tobytes()))
    footer["list"] = add(zlib.compress(known.tobytes() + named.tobytes() + lengths.astype("<u4").tobytes()))
    top = int(np.argmax(counts)) if len(counts) else 0  # pads the last block

    def code(first: int, blocks: int, steps: int) -> None:
        part = numbers[first : first + blocks * steps * LANES]
        grid = np.full(blocks * steps * LANES, top, np.int32)
        grid[: len(part)] = part
        grid = grid.reshape(blocks, steps, LANES).transpose(1, 0, 2)
        for words, states, places in _encode_grid(grid, share, below):
            body = states.astype("<u8").tobytes() + places.astype("<u4").tobytes() + words.astype("<u4").tobytes()
            footer["blocks"].append([steps, *add(body)])

    whole = len(ids) // (LANES * STEPS)
    for b in range(0, whole, GROUP):
        code(b * LANES * STEPS, min(GROUP, whole - b), STEPS)
    if rest := len(ids) - whole * LANES * STEPS:
        code(whole * LANES * STEPS, 1, -(-rest // LANES))
    tail = json.dumps(footer, separators=(",", ":")).encode()
    return b"".join([*parts, tail, struct.pack("<I", len(tail)), MAGIC])


class RansFile:
    """Reads a file by parts: `read(offset, length)` gives its bytes."""

    def __init__(self, size: int, read) -> None:
        end = read(size - 12, 12) if size >= 20 else b""
        if end[4:] != MAGIC:
            raise CorruptFile("no end mark")
        (length,) = struct.unpack("<I", end[:4])
        try:
            self.footer = json.loads(read(size - 12 - length, length))
        except ValueError as problem:
            raise CorruptFile("footer can't be read") from problem
        self.read = read
        raw = np.frombuffer(zlib.decompress(self._part(self.footer["table"])), "<u4")
        self.symbols = np.cumsum(raw[: len(raw) // 2]).astype(np.uint32)
        shares = raw[len(raw) // 2 :].astype(np.uint64)
        self.share, self.below = shares, np.cumsum(shares) - shares
        self.symbol_at = np.repeat(np.arange(len(shares), dtype=np.int32), shares.astype(np.int64))

    def _part(self, place: list[int]) -> bytes:
        offset, length, checksum = place
        body = self.read(offset, length)
        if len(body) != length or zlib.crc32(body) != checksum:
            raise CorruptFile(f"checksum of the part at {offset}")
        return body

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        body, n = zlib.decompress(self._part(self.footer["list"])), self.footer["docs"]
        known = np.frombuffer(body, np.uint8, n)
        named, lengths = np.frombuffer(body, "<i8", n, n), np.frombuffer(body, "<u4", n, 9 * n)
        return [d if k else None for d, k in zip(named.tolist(), known.tolist())], lengths.astype(np.int64)

    def ids(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """The ids of blocks first .. last - 1, all pieces between checkpoints decoded side by side."""
        blocks, lanes = self.footer["blocks"][first:last], self.footer["lanes"]
        found: list[np.ndarray] = []
        for at in range(0, len(blocks), GROUP):
            found += self._group(blocks[at : at + GROUP], lanes)
        if not found:
            return np.zeros(0, np.uint32)
        every = self.symbols[np.concatenate(found)]
        through = last is None or last >= len(self.footer["blocks"])
        return every[: self.footer["ids"] - first * LANES * STEPS] if through else every

    def _group(self, blocks: list[list[int]], lanes: int) -> list[np.ndarray]:
        pieces, streams, base = [], [], 0  # (block, steps, states, place)
        for b, (steps, *place) in enumerate(blocks):
            body, n = self._part(place), -(-steps // CHECKPOINT)
            states = np.frombuffer(body, "<u8", n * lanes).reshape(n, lanes)
            places = np.frombuffer(body, "<u4", n, 8 * n * lanes)
            words = np.frombuffer(body, "<u4", -1, 8 * n * lanes + 4 * n)
            pieces += [(b, min(CHECKPOINT, steps - k * CHECKPOINT), states[k], base + int(places[k])) for k in range(n)]
            streams.append(words)
            base += len(words)
        stream, out = np.concatenate(streams), [[] for _ in blocks]
        done: dict[int, np.ndarray] = {}
        for steps in {p[1] for p in pieces}:
            some = [k for k, p in enumerate(pieces) if p[1] == steps]
            symbols = _decode_units(
                stream, np.array([pieces[k][2] for k in some], np.uint64), np.array([pieces[k][3] for k in some]),
                steps, self.share, self.below, self.symbol_at,
            )
            done.update((k, symbols[:, u].ravel()) for u, k in enumerate(some))
        for k, piece in enumerate(pieces):
            out[piece[0]].append(done[k])
        return [np.concatenate(parts) for parts in out]


def decode_file(body: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(document ids, lengths, ids) of a whole file."""
    file = RansFile(len(body), lambda offset, length: body[offset : offset + length])
    return *file.documents(), file.ids()


# ---------------------------------------------------------------- jobs

MANIFEST = "path string, task int, file int, n_docs long, n_ids long, bytes long"


def write_files(
    docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = END_ID, blank: str = BLANK_DROPS,
    file_ids: int = FILE_IDS,
) -> DataFrame:
    """Encodes the texts in ascending order of doc_id into files of `folder`, which all machines must reach; the stored manifest."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        encode, task = encoder(tokenizer_path, blank, end_id).encode, TaskContext.get().partitionId()
        held: list[tuple[list, np.ndarray, np.ndarray]] = []
        number = size = 0

        def flush() -> pa.RecordBatch:
            names = [d for part in held for d in part[0]]
            lengths = np.concatenate([part[1] for part in held])
            body = encode_file(names, lengths, np.concatenate([part[2] for part in held]))
            path = f"{root}/ids-{task:06d}-{number:05d}-{uuid.uuid4().hex}.rans"
            with store.open_output_stream(path) as out:
                out.write(body)
            return pa.RecordBatch.from_pylist(
                [{"path": path, "task": task, "file": number, "n_docs": len(names), "n_ids": int(lengths.sum()), "bytes": len(body)}],
                schema=manifest,
            )

        manifest = pa.schema([("path", pa.string()), ("task", pa.int32()), ("file", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("bytes", pa.int64())])
        store.create_dir(root, recursive=True)
        for batch in slices(batches, text=1):
            flat, lengths = encode(batch.column(1))
            names, ends, at, done = batch.column(0).to_pylist(), np.cumsum(lengths), 0, 0
            while at < len(names):  # a file ends with the document that fills it
                to = min(int(np.searchsorted(ends, done + file_ids - size)) + 1, len(names))
                upto = int(ends[to - 1])
                held.append((names[at:to], lengths[at:to], flat[done:upto]))
                size += upto - done
                at, done = to, upto
                if size >= file_ids:
                    yield flush()
                    held, number, size = [], number + 1, 0
        if held:
            yield flush()

    ordered = (
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        .repartitionByRange(_partitions(docs), "doc_id")
        .sortWithinPartitions(F.asc_nulls_first("doc_id"), "text")
    )
    return materialize(ordered.mapInArrow(write, MANIFEST))


def _partitions(frame: DataFrame) -> int:
    return int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def read_files(manifest: DataFrame, folder: str, checksums: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and tokens (little-endian 32-bit) of every document, from the files that the manifest names.

    With `checksums` the CRC-32 of the tokens, `ids_crc32`, stands in their place, and they do not leave the worker.
    """
    tasks = manifest.groupBy("task").agg(F.sum("n_ids").alias("n"))
    earlier = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # a row per writing task
    before = tasks.select("task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("task_start"))
    within = Window.partitionBy("task").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = (
        manifest.withColumn("file_start", F.coalesce(F.sum("n_ids").over(within), F.lit(0)))
        .join(before, "task")
        .select("path", (F.col("task_start") + F.col("file_start")).alias("start"))
        .repartition(_partitions(manifest), "path")
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store = fs.FileSystem.from_uri(folder)[0] if "://" in folder else fs.LocalFileSystem()
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with store.open_input_file(path) as source:
                    file = RansFile(source.size(), lambda offset, length: source.read_at(length, offset))
                    names, lengths = file.documents()
                    raw = memoryview(file.ids().astype("<u4").tobytes())
                ends = np.cumsum(lengths)
                begins = (ends - lengths).tolist()
                tokens = (raw[4 * a : 4 * b] for a, b in zip(begins, ends.tolist()))
                ids = pa.array(map(zlib.crc32, tokens), pa.int64()) if checksums else pa.array(list(tokens), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.int64()), pa.array(start + ends - lengths), pa.array(lengths), ids],
                    names=["doc_id", "start", "n_tokens", last],
                )

    last = "ids_crc32" if checksums else "tokens"
    return files.mapInArrow(read, f"doc_id long, start long, n_tokens long, {last} {'long' if checksums else 'binary'}")
