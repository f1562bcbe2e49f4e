"""The best documents for each item by a lexical score, found in a tree of frequent terms over the documents.

Terms of the items, in blocks of at most BLOCK_TERMS different ones, restrict each document to a short vector of term counts. Vectors are
ordered by the terms' document frequency in the whole corpus, most frequent first, and put into a trie, where documents with a common
beginning share a path; a chain without a branch is one node, and what is left of at most LEAF documents is one leaf. A node keeps for
each term the largest count within its subtree, and the least length factor m. The score grows with a count and falls with m, so these
bound what any document below can reach. Per item the trie is walked depth first, best child first, and a subtree is left out when
its bound is below the lowest of the best scores so far; that value goes on from one trie of a task to the next.

Each task keeps the best of its own documents per item, and a ranking over these few rows is the result. The numbers N, L and the document
frequencies come from one pass over the stored vectors and cover all documents.

Edge cases: a null text, or one without terms, counts nowhere; an item without terms has no rows; equal scores come by document id, null
last; repeated documents and items are each their own; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from patchloom.llm.tables import materialize, slices
from patchloom.llm.terms import terms, terms_of

BEST = 20
#: Different terms of the items that are ranked in one pass, unless one item alone has more.
BLOCK_TERMS = 4096
#: Documents of a leaf; cells of a trie's table of largest counts, which bounds the documents of one trie.
LEAF, CELLS = 64, 1 << 25
_NO_ID = np.iinfo(np.int64).max


# ---------------------------------------------------------------- items and vectors


def _blocks(items: DataFrame) -> Iterator[tuple[list, list[bytes], list[dict[int, int]]]]:
    """Item ids, different terms, and the count of each term in each item, block by block."""
    ids, names, counts = [], {}, []
    for item, text in items.select("item_id", F.col("text").cast("string")).toLocalIterator():
        words = terms_of(text)
        if ids and len(names.keys() | set(words)) > BLOCK_TERMS:
            yield ids, list(names), counts
            ids, names, counts = [], {}, []
        if words:
            held: dict[int, int] = {}
            for w in words:
                t = names.setdefault(w, len(names))
                held[t] = held.get(t, 0) + 1
            ids.append(item)
            counts.append(held)
    if ids:
        yield ids, list(names), counts


def vectors(docs: DataFrame, names: list[bytes]) -> DataFrame:
    """(doc_id, n, terms, tfs) of documents with terms: the number of all their terms, and the counts of those in `names`."""
    asked = pa.array(names, pa.large_binary())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text=1):
            found = terms(batch.column(1))
            known = pc.index_in(found.names, value_set=asked).fill_null(-1).to_numpy(zero_copy_only=False)
            code = known[found.codes] if len(known) else np.zeros(0, np.int64)
            doc = np.repeat(np.arange(batch.num_rows), found.counts)[code >= 0]
            pair, tf = np.unique(doc * len(names) + code[code >= 0], return_counts=True)
            cuts = np.searchsorted(pair, np.arange(1, batch.num_rows) * len(names))
            some = np.flatnonzero(found.counts)
            term_parts, tf_parts = np.split((pair % len(names)).astype("<i4"), cuts), np.split(tf.astype("<i4"), cuts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(some)), pa.array(found.counts[some].astype(np.int64)),
                 pa.array([term_parts[k].tobytes() for k in some], pa.binary()), pa.array([tf_parts[k].tobytes() for k in some], pa.binary())],
                names=["doc_id", "n", "terms", "tfs"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(work, "doc_id long, n long, terms binary, tfs binary")


def statistics(stored: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """N, L and the document frequency of each of `size` terms."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 2, np.int64)
        for batch in slices(batches, rows=1 << 14):
            total[size] += batch.num_rows
            total[size + 1] += pc.sum(batch.column(0)).as_py() or 0
            total[:size] += np.bincount(np.frombuffer(b"".join(batch.column(1).to_pylist()), "<i4"), minlength=size)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + 2, dtype=np.int32)), pa.array(total)], names=["at", "n"])

    found = np.zeros(size + 2, np.int64)
    sums = stored.select("n", "terms").mapInArrow(count, "at int, n long").groupBy("at").agg(F.sum("n").alias("n"))
    for at, n in sums.collect():  # as many as terms, and two
        found[at] = n
    return int(found[size]), int(found[size + 1]), found[:size]


# ---------------------------------------------------------------- the tree


def _parts(weight: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term adds to the score."""
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))


class _Tree:
    """Documents as vectors of ascending term ranks, in the order of the trie, and its nodes."""

    def __init__(self, starts: np.ndarray, ranks: np.ndarray, tfs: np.ndarray, m: np.ndarray, ids: np.ndarray, size: int) -> None:
        self.spans: list[tuple[int, int]] = []
        self.children: list[list[int]] = []
        self.order: list[np.ndarray] = []
        self._placed = 0
        lengths = np.diff(starts)
        self._grow(starts[:-1], lengths, ranks, np.arange(len(m)))
        order = np.concatenate(self.order)
        lengths = lengths[order]
        self.starts = np.concatenate([[0], np.cumsum(lengths)])
        gather = np.arange(self.starts[-1]) + np.repeat(starts[:-1][order] - self.starts[:-1], lengths)
        self.ranks, self.tfs, self.m, self.ids = ranks[gather], tfs[gather].astype(np.int64), m[order], ids[order]
        self._bound(size)

    def _grow(self, starts: np.ndarray, lengths: np.ndarray, ranks: np.ndarray, every: np.ndarray) -> None:
        """Nodes in the order of a walk from the root; leaves own ranges of documents."""
        todo: list[tuple[np.ndarray, int, int]] = [(every, 0, -1)]
        while todo:
            docs, depth, parent = todo.pop()
            node = len(self.children)
            self.children.append([])
            self.spans.append((0, 0))
            if parent >= 0:
                self.children[parent].append(node)
            groups = None
            while len(docs) > LEAF:
                ended = lengths[docs] <= depth
                key = np.where(ended, -1, ranks[np.where(ended, 0, starts[docs] + depth)])
                if (key == key[0]).all():
                    if key[0] < 0:
                        break  # copies of one vector
                    depth += 1
                    continue
                docs = docs[np.argsort(key, kind="stable")]
                cuts = np.flatnonzero(np.diff(np.sort(key))) + 1
                groups = self._few(np.split(docs, cuts))
                break
            if groups is None:
                self.spans[node] = (self._placed, self._placed + len(docs))
                self._placed += len(docs)
                self.order.append(docs)
            else:
                todo += [(g, depth, node) for g in reversed(groups)]

    @staticmethod
    def _few(groups: list[np.ndarray]) -> list[np.ndarray]:
        """Small neighbours together, as long as they make one leaf."""
        out: list[list[np.ndarray]] = []
        room = 0
        for g in groups:
            if len(g) <= room:
                out[-1].append(g)
            else:
                out.append([g])
                room = LEAF
            room -= len(g)
        return [np.concatenate(g) for g in out] if len(out) > 1 else groups

    def _bound(self, size: int) -> None:
        """Largest counts and least m of each subtree; children come after their parents."""
        nodes = len(self.children)
        self.most = np.zeros((nodes, size), np.int64 if len(self.tfs) and self.tfs.max() > 2**31 - 1 else np.int32)
        self.least = np.full(nodes, np.iinfo(np.int64).max)
        for node, (a, b) in enumerate(self.spans):
            if b > a:
                at = slice(self.starts[a], self.starts[b])
                np.maximum.at(self.most[node], self.ranks[at], self.tfs[at])
                self.least[node] = self.m[a:b].min()
        for node in reversed(range(nodes)):
            if self.children[node]:
                self.most[node] = self.most[self.children[node]].max(axis=0)
                self.least[node] = self.least[self.children[node]].min()

    def search(self, item: tuple[np.ndarray, np.ndarray], slot: np.ndarray, best: "_Best") -> None:
        """Offers to `best` every document that can be among the best of an item (term ranks, weights)."""
        held, weights = item
        slot[held] = np.arange(len(held))
        todo = [(_NO_ID, 0)]
        while todo:
            bound, node = todo.pop()
            if bound < best.floor:
                continue
            children = self.children[node]
            if not children:
                self._score(node, weights, slot, best)
                continue
            most = self.most[np.ix_(children, held)].astype(np.int64)
            bounds = _parts(weights, most, self.least[children][:, None]).sum(axis=1)
            todo += sorted(((b, c) for b, c in zip(bounds.tolist(), children) if b >= best.floor), key=lambda p: p[0])
        slot[held] = -1

    def _score(self, node: int, weights: np.ndarray, slot: np.ndarray, best: "_Best") -> None:
        a, b = self.spans[node]
        at = slice(self.starts[a], self.starts[b])
        where = slot[self.ranks[at]]
        m = np.repeat(self.m[a:b], np.diff(self.starts[a : b + 1]))
        part = np.where(where >= 0, _parts(weights[where], self.tfs[at], m), 0)
        best.offer(np.add.reduceat(part, self.starts[a:b] - self.starts[a]), self.ids[a:b])


class _Best:
    """The best scores of an item so far, equal ones by id."""

    def __init__(self, size: int) -> None:
        self.size, self.floor = size, 1
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        good = scores >= self.floor
        if good.any():
            scores, ids = np.concatenate([self.scores, scores[good]]), np.concatenate([self.ids, ids[good]])
            order = np.lexsort((ids, -scores))[: self.size]
            self.scores, self.ids = scores[order], ids[order]
            if len(order) == self.size:
                self.floor = int(self.scores[-1])


# ---------------------------------------------------------------- ranking


def rank(docs: DataFrame, items: DataFrame, best: int = BEST) -> DataFrame:
    """item_id, rank, doc_id and score of the `best` documents of `docs` (doc_id, text) for each row of `items` (item_id, text)."""
    kind = items.schema["item_id"].dataType.simpleString()
    found = None
    for ids, names, counts in _blocks(items):
        part = materialize(_rank_block(docs, ids, names, counts, best, items.schema["item_id"].dataType))
        found = part if found is None else found.unionAll(part)
    return found if found is not None else docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")


def _rank_block(docs: DataFrame, ids: list, names: list[bytes], counts: list[dict[int, int]], best: int, id_type) -> DataFrame:
    spark = docs.sparkSession
    stored = materialize(vectors(docs, names))
    n_docs, n_terms, frequency = statistics(stored, len(names))
    rank_of = np.empty(len(names), np.int64)
    rank_of[np.argsort(-frequency, kind="stable")] = np.arange(len(names))
    weight = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for df in frequency.tolist()]
    wanted = [
        (rank_of[list(held)], np.array([weight[t] * n for t, n in held.items()], np.int64)) for held in counts
    ]
    in_tree = max(CELLS // len(names), LEAF)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops = [_Best(best) for _ in wanted]
        slot = np.full(len(names), -1)
        for batch in slices(batches, rows=in_tree):
            batch = batch.filter(pc.greater(pc.binary_length(batch.column(2)), 0))
            if not batch.num_rows:
                continue
            starts = np.concatenate([[0], np.cumsum(pc.binary_length(batch.column(2)).to_numpy().astype(np.int64) // 4)])
            codes = rank_of[np.frombuffer(b"".join(batch.column(2).to_pylist()), "<i4")]
            tfs = np.frombuffer(b"".join(batch.column(3).to_pylist()), "<i4")
            order = np.lexsort((codes, np.repeat(np.arange(batch.num_rows), np.diff(starts))))
            m = np.array([75 + 25 * n * n_docs // n_terms for n in batch.column(1).to_pylist()], np.int64)
            doc_ids = batch.column(0).fill_null(_NO_ID).to_numpy(zero_copy_only=False)
            tree = _Tree(starts, codes[order], tfs[order], m, doc_ids, len(names))
            for item, top in zip(wanted, tops):
                tree.search(item, slot, top)
        for k, top in enumerate(tops):
            if len(top.ids):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(top.ids), k, np.int32)), pa.array(top.ids, mask=top.ids == _NO_ID), pa.array(top.scores)],
                    names=["item", "doc_id", "score"],
                )

    tops = stored.mapInArrow(work, "item int, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = tops.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best)
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", id_type)])
    named = spark.createDataFrame(list(enumerate(ids)), schema)  # the block's items
    return ranked.join(named, "item").select("item_id", "rank", "doc_id", "score")
