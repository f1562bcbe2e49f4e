"""One document of each class of near copies: the SimHash search of `simhash`, verified, and what lies beyond its radius.

Copies are texts whose word shingles have a Jaccard similarity of 0.8 or more. First the fingerprints within 4 bits are searched by
`simhash`; each component is verified against one of its members on the whole sets of shingles. At similarity 0.8 two
fingerprints differ in about 10 of 64 bits, and a search of so wide a radius compares nearly all pairs. So further candidates are texts
that agree in one of BANDS bands of ROWS minimal hashes: a pair at the least similarity meets in none of them with a chance of
(1 - 0.8^5)^24 = 0.00007, more similar ones less.

Texts with equal sets are one node. A first turn verifies each node against one hub of its component and of each of its bands, drawn by
a hash, so a large group of near copies becomes one class without its pairs. A second turn looks at the runs of a band key
that still hold several classes. A run is cut into blocks, every two of which meet in a task; there nodes of different classes are
compared by their sizes and sketches (the low bytes of their minima; a pair at 0.8 agrees in fewer than LEAST of them with a chance below
0.000001), what is left is verified on the whole sets in the first band that the two share, and a spanning forest comes out. So no
row is ever made for a pair, and no pair that shares a band is left out. The largest class of a run meets the others only.

Edge cases: a null text counts as empty; texts without words are one class; with fewer words than a shingle has, all
of them are the one shingle; rows are kept as they are, so repeated rows are one class; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from patchloom.llm import simhash
from patchloom.llm.components import components
from patchloom.llm.tables import materialize, slices

SEED = 42
WIDTH = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 5
#: Shingles hashed at once.
CHUNK = 512
#: Equal bytes of two sketches from which on a pair is verified.
LEAST = 75
#: Nodes of a run that come together in one block.
BLOCK = 2048

_rng = np.random.default_rng(SEED)
_FLIPS = _rng.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64)
_FACTORS = _rng.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64) | np.uint64(1)


def _sequence(text: bytes, width: int = WIDTH) -> np.ndarray:
    """The 64-bit hashes of the shingles of one text, repeats included."""
    import xxhash

    words = text.lower().split()  # on bytes: A-Z only, and exactly the ASCII white space
    digest, joined = xxhash.xxh64_intdigest, b" ".join(words)
    if len(words) <= width:
        return np.array([digest(joined, SEED)] if words else [], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = ends[width - 1 :].tolist()
    return np.fromiter([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), last)], np.uint64, len(last))


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """The sorted hashes of the distinct shingles of one text."""
    return np.unique(_sequence(text, width))


def _fingerprint(hashes: np.ndarray) -> int:
    """SimHash of the shingles, as `simhash.fingerprint` has it, as a signed integer."""
    ones = np.zeros(simhash.BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += simhash._bits(hashes[at : at + (1 << 16)]).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def minima(hashes: np.ndarray) -> np.ndarray | None:
    """The minimal hashes; none without shingles."""
    if not len(hashes):
        return None
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), CHUNK):
        np.minimum(least, ((hashes[at : at + CHUNK] ^ _FLIPS) * _FACTORS).min(axis=1), out=least)
    return least


def _with_sets(docs: DataFrame) -> DataFrame:
    """`docs` with _copy_set, a hash of the set of shingles, _copy_bits, the fingerprint, _copy_bands and _copy_sketch."""
    at = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in slices(batches, text=at):
            sets, bits, bands, sketches = [], [], [], []
            for text in batch.column(at).cast(pa.binary()).to_pylist():
                every = _sequence(text or b"")
                hashes = np.unique(every)
                least = minima(hashes)
                sets.append(xxhash.xxh64_intdigest(hashes.tobytes(), SEED))
                bits.append(_fingerprint(every))
                keys = [] if least is None else [xxhash.xxh64_intdigest(b.tobytes(), SEED) for b in least.reshape(BANDS, ROWS)]
                bands.append(np.array(keys, np.uint64).view(np.int64))
                sketches.append(b"" if least is None else least.astype(np.uint8).tobytes())
            added = [
                pa.array(np.array(sets, np.uint64).view(np.int64)), pa.array(bits, pa.int64()), pa.array(bands, pa.list_(pa.int64())),
                pa.array(sketches, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, *_ADDED])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(work, f"{fields}, _copy_set long, _copy_bits long, _copy_bands array<long>, _copy_sketch binary")


_ADDED = ["_copy_set", "_copy_bits", "_copy_bands", "_copy_sketch"]


def _hashed(texts: DataFrame) -> DataFrame:
    """(node, hashes) of (node, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text=1):
            found = [shingles(t or b"").view(np.int64) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["node", "hashes"])

    return texts.mapInArrow(work, "node long, hashes array<long>")


def _similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    short, long = sorted((len(a), len(b)))
    if short < similarity * long:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (short + long - both)


def _sets_of(column: pa.Array) -> list[np.ndarray]:
    cuts = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)
    return [values[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


def _verified(stars: DataFrame, hashed: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs `stars` (node, hub) that are similar, as (a, b). A hub with many nodes is dealt out in parts."""
    sizes = stars.groupBy("hub").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    members = stars.join(sizes, "hub").select("hub", part.alias("part"), F.lit(1).alias("kind"), "node")
    leads = sizes.select("hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), F.col("hub").alias("node"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = None
        for batch in slices(batches):
            found: list[tuple[int, int]] = []
            rows = zip(*(batch.column(k).to_pylist() for k in range(3)), _sets_of(batch.column(3)))
            for hub, kind, node, hashes in rows:
                if kind == 0:
                    lead = hashes
                elif _similar(lead, hashes, similarity):
                    found.append((node, hub))
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    both = members.unionAll(leads).join(hashed, "node").repartition("hub", "part").sortWithinPartitions("hub", "part", "kind")
    return both.select("hub", "kind", "node", "hashes").mapInArrow(work, "a long, b long")


def _roots(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """`nodes` (node, ...) with the root of the class of each."""
    return nodes.join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))


_RUN = ["band", "key", "x", "y"]


def _dealt(classed: DataFrame) -> DataFrame:
    """(band, key, x, y, own, node, root): the runs with several classes, in blocks that meet; the largest class has blocks of its own."""
    run = ["band", "key"]
    sizes = classed.groupBy(*run, "root").agg(F.count("*").alias("n"))
    runs = sizes.groupBy(*run).agg(
        F.max(F.struct("n", "root")).alias("main"), F.sum("n").alias("n"), F.count("*").alias("classes")
    ).filter("classes > 1").select(
        *run, F.col("main.root").alias("main"), F.ceil((F.col("n") - F.col("main.n")) / BLOCK).cast("int").alias("others"),
        F.ceil(F.col("main.n") / BLOCK).cast("int").alias("mains"),
    )
    in_main = F.col("root") == F.col("main")
    spread = F.xxhash64("node", "band")
    own = F.when(in_main, F.col("others") + F.pmod(spread, F.col("mains"))).otherwise(F.pmod(spread, F.col("others"))).cast("int")
    upto = F.when(in_main, F.col("others")).otherwise(F.col("others") + F.col("mains"))
    rows = classed.join(runs, run).select(*run, "node", "root", own.alias("own"), F.explode(F.sequence(F.lit(0), upto - 1)).alias("other"))
    return rows.select(*run, F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "node", "root")


def _compare(band: int, apart: bool, rows: list[tuple], similarity: float, forest: simhash._Forest) -> None:
    """Links between nodes of different classes of one run; `apart`: only those of different blocks. Rows are (own, node, root, sketch, hashes)."""
    own = np.array([r[0] for r in rows])
    _, label = np.unique(np.array([r[2] for r in rows], np.int64), return_inverse=True)
    sketches = np.frombuffer(b"".join(r[3] for r in rows), np.uint8).reshape(len(rows), BANDS, ROWS)
    sizes = np.array([len(r[4]) for r in rows])
    for i in range(len(rows) - 1):
        others = label[i + 1 :] != label[i]
        if apart:
            others &= own[i + 1 :] != own[i]
        others &= np.minimum(sizes[i + 1 :], sizes[i]) >= similarity * np.maximum(sizes[i + 1 :], sizes[i])
        at = np.flatnonzero(others) + i + 1
        same = sketches[at] == sketches[i]
        good = same.sum(axis=(1, 2)) >= LEAST
        good &= ~same[:, :band].all(axis=2).any(axis=1)  # an earlier band has both
        for j in at[good].tolist():
            if label[j] != label[i] and _similar(rows[i][4], rows[j][4], similarity):
                forest.link(rows[i][1], rows[j][1])
                label[label == label[j]] = label[i]


def _across(dealt: DataFrame, sketched: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links that join the classes of each run."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, key, held = simhash._Forest(), None, []

        def done() -> None:
            if len(held) > 1:
                _compare(key[0], key[2] != key[3], held, similarity, forest)

        for batch in slices(batches):
            columns = [batch.column(k).to_pylist() for k in range(8)]
            for row in zip(*columns, _sets_of(batch.column(8))):
                if row[:4] != key:
                    done()
                    key, held = row[:4], []
                held.append(row[4:])
            if len(forest.up) > 500_000:
                yield forest.drain()
        done()
        yield forest.drain()

    rows = dealt.join(sketched, "node").repartition(*_RUN).sortWithinPartitions(*_RUN)
    return rows.select(*_RUN, "own", "node", "root", "sketch", "hashes").mapInArrow(work, "a long, b long")


def links(sets: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b): links that join the similar nodes, from `sets` (node, bits, bands, sketch) and `texts` (node, text)."""
    classes = simhash.classes(sets.select(F.col("node").alias("doc_id"), F.col("bits").alias("fingerprint")))
    hubs = classes.groupBy("root").agg(F.min("first_id").alias("hub"))
    within = sets.select("node", F.col("bits").alias("fingerprint")).join(classes.join(hubs, "root").select("fingerprint", "hub"), "fingerprint")
    every = sets.select("node", F.posexplode("bands").alias("band", "key"))
    drawn = F.min(F.struct(F.xxhash64("node", "band"), "node"))["node"]
    crowded = every.groupBy("band", "key").agg(drawn.alias("hub"), F.count("*").alias("n")).filter("n > 1").drop("n")
    shared = materialize(every.join(crowded, ["band", "key"]))
    stars = materialize(shared.select("node", "hub").unionAll(within.select("node", "hub")).filter("node != hub").distinct())
    asked = stars.select("node").unionAll(stars.select("hub")).distinct()
    wanted = texts.join(asked, "node", "left_semi").select("node", "text")
    hashed = materialize(_hashed(wanted))
    found = materialize(_verified(stars, hashed, similarity))
    classed = materialize(_roots(shared.drop("hub"), found))
    sketched = hashed.join(sets.select("node", "sketch"), "node")
    return found.unionAll(_across(_dealt(classed), sketched, similarity))


def unique_documents(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row of `docs` for each class of near copies: that with the least id (null last, then by a hash of the text)."""
    found = materialize(_with_sets(docs))
    sets = materialize(found.groupBy(F.col("_copy_set").alias("node")).agg(
        F.min(F.col("doc_id").cast("long")).alias("first_id"), F.min("_copy_bits").alias("bits"), F.first("_copy_bands").alias("bands"),
        F.first("_copy_sketch").alias("sketch"),
    ))
    # copies go before the rows are dealt out: each task keeps one row of a set at most
    among = Window.partitionBy("_copy_set").orderBy(F.asc_nulls_last("doc_id"), F.xxhash64("text"))
    firsts = found.withColumn("_copy_rank", F.row_number().over(among)).filter("_copy_rank = 1")
    joined = links(sets.drop("first_id"), firsts.select(F.col("_copy_set").alias("node"), F.col("text").cast("string").alias("text")), similarity)
    best = F.min(F.struct(F.col("first_id").isNull(), "first_id", "node"))["node"]
    winners = _roots(sets.select("node", "first_id"), joined).groupBy("root").agg(best.alias("_copy_set")).select("_copy_set")
    return firsts.join(winners, "_copy_set", "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))
