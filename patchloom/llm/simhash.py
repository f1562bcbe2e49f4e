"""Near-duplicates by SimHash fingerprints and the generalised pigeonhole principle.

The 64 bits are cut into partitions of correlated bits. If partition i is given a threshold t_i and the sum of (t_i + 1) is
k + 1, then two fingerprints that differ in at most k bits differ in at most t_i bits of some partition i. The
thresholds need not be equal: dynamic programming spends the k + 1 units where they cost least, by the number of rows
and candidates that each threshold is estimated to make, and the number of partitions is chosen by the same estimate. So
the cost per document stays about level while the corpus grows, and the links found are always all links.

Fingerprints that are equal are one row from the start. Each is stored under its bits of every partition and probes the keys
within the partition's threshold; of two fingerprints only the one that holds the highest differing bit probes. Rows
of a key meet in one run, are verified on all 64 bits, and leave as a spanning forest, never as pairs. A key with
very many fingerprints is cut into blocks, and every two of its blocks meet in a run of their own.

Edge cases: a null text counts as empty; without words the fingerprint is 0, and such texts are linked like any
other; with fewer words than a shingle has, all of them are the one shingle; rows are kept as they are, so repeated rows
share a component; the component id is the least non-null document id (null if a component has none); an empty table gives an empty
result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from patchloom.llm.components import components
from patchloom.llm.tables import materialize, slices

BITS = 64
SEED = 42
WIDTH = 4
MAX_BITS = 4

#: What a stored or probing row costs, in comparisons of two fingerprints.
ROW_COST = 100
#: Fingerprints that share a key and are brought together in one block.
BLOCK = 20_000
#: Pairs compared at once in short runs; runs that make more are searched from one fingerprint to the next.
PAIRS_AT_ONCE = 1 << 20


# ---------------------------------------------------------------- fingerprints


def fingerprint(text: bytes, width: int = WIDTH) -> int:
    """SimHash of the shingles of one text, as an unsigned integer."""
    import xxhash

    words = text.lower().split()  # on bytes: A-Z only, and exactly the ASCII white space
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) <= width:
        return digest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = ends[width - 1 :].tolist()
    hashes = np.fromiter(
        [digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), last)], np.uint64, len(last)
    )
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, name: str, width: int = WIDTH) -> DataFrame:
    """`docs` with the 64 bits of the fingerprint of `text` as a signed long."""
    kept = [c for c in docs.columns if c != name]
    rows = docs.select(*(F.col(f"`{c}`") for c in kept))
    at = kept.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text=at):
            texts = batch.column(at).cast(pa.binary()).to_pylist()
            found = np.fromiter((fingerprint(t or b"", width) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found.view(np.int64))], names=[*kept, name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(work, f"{fields}, `{name}` long")


# ---------------------------------------------------------------- partitions and thresholds


def bit_statistics(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints, and in how many of them bits i and j are both set. 4097 sums, whatever the input."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        together, rows = np.zeros((BITS, BITS), np.int64), 0
        for batch in slices(batches, 1 << 14):
            bits = _bits(batch.column(0).to_numpy()).astype(np.float32)
            together += (bits.T @ bits).astype(np.int64)
            rows += len(bits)
        at = np.arange(BITS * BITS + 1, dtype=np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at), pa.array(np.append(together.ravel(), rows))], names=["at", "n"]
        )

    sums = distinct.select("fingerprint").mapInArrow(count, "at int, n long").groupBy("at").agg(F.sum("n").alias("n"))
    found = np.zeros(BITS * BITS + 1, np.int64)
    for at, n in sums.collect():
        found[at] = n
    return int(found[-1]), found[:-1].reshape(BITS, BITS)


def _bits(values: np.ndarray) -> np.ndarray:
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8)
    return np.unpackbits(raw, axis=1, bitorder="little")


def group_bits(rows: int, together: np.ndarray, parts: int) -> list[list[int]]:
    """Partitions of about equal width; each takes the bits most correlated with those it has."""
    share = together / max(rows, 1)
    own = np.diag(share)
    spread = np.sqrt(np.maximum(own * (1 - own), 1e-12))
    tied = np.abs((share - np.outer(own, own)) / np.outer(spread, spread))
    free, groups = list(range(BITS)), []
    for part in range(parts):
        width = (BITS + part) // parts
        group = [max(free, key=lambda b: tied[b, free].sum())]
        free.remove(group[0])
        while len(group) < width:
            best = max(free, key=lambda b: tied[b, group].sum())
            free.remove(best)
            group.append(best)
        groups.append(sorted(group))
    return groups


def _cost(rows: int, own: np.ndarray, group: list[int], threshold: int) -> float:
    """Estimated cost of a threshold: stored and probing rows, and the candidates that share a key."""
    if threshold < 0:
        return 0.0
    apart = np.zeros(threshold + 1)  # chance that two fingerprints differ in so many bits of the group
    apart[0] = 1
    for q in own[group]:
        p = 2 * q * (1 - q)
        apart[1:] = apart[1:] * (1 - p) + apart[:-1] * p
        apart[0] *= 1 - p
    probes, ways = 0.0, 1.0
    for k in range(1, threshold + 1):
        ways *= (len(group) - k + 1) / k
        probes += ways / 2
    return rows * (1 + probes) * ROW_COST + 0.5 * rows * rows * float(apart.sum())


def choose_thresholds(
    rows: int, together: np.ndarray, max_bits: int = MAX_BITS
) -> list[tuple[list[int], int]]:
    """Partitions of bits with their thresholds; partitions with threshold -1 are left out."""
    own, best = np.diag(together) / max(rows, 1), None
    for parts in range(1, max_bits + 2):
        groups = group_bits(rows, together, parts)
        least: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for group in groups:
            step: dict[int, tuple[float, list[int]]] = {}
            for spent, (cost, chosen) in least.items():
                for units in range(max_bits + 2 - spent):
                    total = cost + _cost(rows, own, group, units - 1)
                    if spent + units not in step or total < step[spent + units][0]:
                        step[spent + units] = (total, [*chosen, units - 1])
            least = step
        cost, chosen = least[max_bits + 1]
        if best is None or cost < best[0]:
            best = (cost, [(g, t) for g, t in zip(groups, chosen) if t >= 0])
    return best[1]


# ---------------------------------------------------------------- candidates and links


def _keys(distinct: DataFrame, plan: list[tuple[list[int], int]]) -> DataFrame:
    """(part, key, fp, stored): each fingerprint under its own key and under those that it probes."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            values = batch.column(0).to_numpy().view(np.uint64)
            for part, (group, threshold) in enumerate(plan):
                ones = [np.uint64(1 << b) for b in group]
                own = values & np.bitwise_or.reduce(ones)
                yield _rows(part, own, values, True)
                for k in range(1, threshold + 1):
                    for flipped in itertools.combinations(reversed(ones), k):
                        probing = (values & flipped[0]) != 0  # flipped[0] is the highest
                        yield _rows(
                            part, own[probing] ^ np.bitwise_or.reduce(flipped), values[probing], False
                        )

    return distinct.select("fingerprint").mapInArrow(emit, "part int, key long, fp long, stored boolean")


def _rows(part: int, key: np.ndarray, values: np.ndarray, stored: bool) -> pa.RecordBatch:
    n = len(values)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, part, np.int32)), pa.array(key.view(np.int64)),
         pa.array(np.ascontiguousarray(values).view(np.int64)), pa.array(np.full(n, stored))],
        names=["part", "key", "fp", "stored"],
    )


class _Forest:
    """Disjoint sets of the fingerprints that a task has found linked."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = y
        return x

    def link(self, x: int, y: int) -> None:
        a, b = self.root(x), self.root(y)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def drain(self) -> pa.RecordBatch:
        found = [(x, self.root(x)) for x in list(self.up)]
        self.up = {}
        links = np.array([p for p in found if p[0] != p[1]], np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], names=["a", "b"])


def _search(values: np.ndarray, max_bits: int, forest: _Forest) -> None:
    """All components of one long run, each grown from one fingerprint to the next."""
    todo = np.unique(values)
    while len(todo):
        near, todo = [todo[0]], todo[1:]
        root = int(near[0].view(np.int64))
        while near and len(todo):
            linked = np.bitwise_count(todo ^ near.pop()) <= max_bits
            if linked.any():
                found, todo = todo[linked], todo[~linked]
                for x in found.view(np.int64).tolist():
                    forest.link(root, x)
                near.extend(found)


def _verify(fp: np.ndarray, stored: np.ndarray, starts: np.ndarray, ends: np.ndarray, max_bits: int, forest: _Forest) -> None:
    """Links of whole runs [starts, ends): each stored row against all rows of its run."""
    sizes = ends - starts
    held = np.add.reduceat(stored.astype(np.int64), starts)
    long = held * sizes > PAIRS_AT_ONCE
    for a, b in zip(starts[long].tolist(), ends[long].tolist()):
        _search(fp[a:b], max_bits, forest)
    run = np.repeat(np.arange(len(starts)), sizes)
    left = np.flatnonzero(stored & ((sizes > 1) & ~long)[run])
    upto = np.cumsum(sizes[run[left]])
    for at in range(0, int(upto[-1]) if len(upto) else 0, PAIRS_AT_ONCE):
        some = left[np.searchsorted(upto, at, "right") : np.searchsorted(upto, at + PAIRS_AT_ONCE, "right")]
        if not len(some):
            continue
        n = sizes[run[some]]
        i = np.repeat(some, n)
        j = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[run[some]], n)
        linked = (np.bitwise_count(fp[i] ^ fp[j]) <= max_bits) & (fp[i] != fp[j])
        for x, y in zip(fp[i[linked]].view(np.int64).tolist(), fp[j[linked]].view(np.int64).tolist()):
            forest.link(x, y)


def links(distinct: DataFrame, plan: list[tuple[list[int], int]], max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b): links between fingerprints that join what lies within `max_bits` of each other, as forests."""
    keys = _keys(distinct, plan)
    owners = _keys(distinct, [(g, 0) for g, _ in plan]).groupBy("part", "key").agg(F.count("*").alias("n"))
    crowded = materialize(
        owners.filter(F.col("n") > BLOCK).select("part", "key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    )
    block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    other = F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.expr("sequence(0, blocks - 1)"))
    dealt = (
        keys.join(crowded, ["part", "key"], "left")
        .select("part", "key", "fp", "stored", F.coalesce(block, F.lit(0)).alias("own"), F.explode(other).alias("other"))
        .select("part", "key", "fp", "stored", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
    )
    names = ["part", "key", "x", "y"]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, rest = _Forest(), None
        for batch in itertools.chain(batches, [None]):
            if batch is None:
                if rest is None:
                    break
                now, whole = rest, True
            else:
                now = pa.concat_batches([rest, batch]) if rest is not None else batch
                whole = False
            if not now.num_rows:
                continue
            columns = [now.column(k).to_numpy() for k in names]
            changed = np.zeros(now.num_rows - 1, bool)
            for c in columns:
                changed |= c[1:] != c[:-1]
            starts = np.concatenate([[0], np.flatnonzero(changed) + 1])
            ends = np.append(starts[1:], now.num_rows)
            if not whole:  # the last run may go on
                rest = now.slice(starts[-1])
                starts, ends = starts[:-1], ends[:-1]
            if len(starts):
                fp = now.column("fp").to_numpy().view(np.uint64)[: ends[-1]]
                stored = now.column("stored").to_numpy(zero_copy_only=False)[: ends[-1]]
                _verify(fp, stored, starts, ends, max_bits, forest)
            if len(forest.up) > 500_000:
                yield forest.drain()
        yield forest.drain()

    return dealt.repartition(*names).sortWithinPartitions(*names).mapInArrow(verify, "a long, b long")


def classes(found: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(fingerprint, first_id, root) of each fingerprint in `found` (doc_id, fingerprint): its least id, and the root of its class."""
    distinct = materialize(found.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id")))
    rows, together = bit_statistics(distinct)
    roots = components(links(distinct, choose_thresholds(rows, together, max_bits), max_bits))
    return distinct.join(roots, distinct["fingerprint"] == roots["node"], "left").select(
        "fingerprint", "first_id", F.coalesce("root", "fingerprint").alias("root")
    )


def near_duplicates(docs: DataFrame, width: int = WIDTH, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every document."""
    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = materialize(with_fingerprints(narrow, "fingerprint", width).drop("text"))
    rooted = classes(found, max_bits)
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(least, "root").select("fingerprint", "component_id")
    return found.join(named, "fingerprint").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


def unique_documents(docs: DataFrame, width: int = WIDTH, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of `docs` for each near-duplicate class: that with the least id (null last, then by a hash of the text)."""
    found = materialize(with_fingerprints(docs, "_simhash", width))
    rooted = classes(found.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("_simhash").alias("fingerprint")), max_bits)
    best = F.min(F.struct(F.col("first_id").isNull(), "first_id", "fingerprint"))["fingerprint"]
    winners = rooted.groupBy("root").agg(best.alias("_simhash")).select("_simhash")
    # copies go before the rows are dealt out: each task keeps one row of a fingerprint at most
    among = Window.partitionBy("_simhash").orderBy(F.asc_nulls_last("doc_id"), F.xxhash64("text"))
    firsts = found.withColumn("_simhash_rank", F.row_number().over(among)).filter("_simhash_rank = 1")
    return firsts.join(winners, "_simhash", "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))
