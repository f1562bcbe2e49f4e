"""Exact phrases and near words of benchmark items in training text, by a distributed positional inverted index.

The index is a stored table of segments. A segment covers about a megabyte of text, or one longer document: its different
terms, and for each of them the ascending list of the places where it stands, counted through all documents of the segment. Segments are
made where the documents lie and searched where they lie, so a term that holds a third of all words is a long list in each segment and
never one group.

A search takes the items in blocks of at most BLOCK_WORDS words. One pass over the terms alone counts how often each test term stands in
the corpus. In each segment, windows that lack a term fall out at once; for the others the list of the rarest term, less its offset
in the window, gives the possible starts, and the lists of the other terms, rarest first, each less its own offset, are intersected with it.
What is left are exact occurrences. `near` looks for the same terms in any order within so many words.

Edge cases: a null text, or one without terms, has no words and is hit by nothing; the same of an item; repeated documents are
documents of their own; items of one id are one item; a null item id counts but is not listed; no phrase crosses from one document
to the next; an empty table gives an empty index, and no items hit nothing; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchloom.llm.tables import materialize, slices
from patchloom.llm.terms import terms, terms_of

WINDOW = 10
#: Words of items that are searched for in one pass; their windows go to every task.
BLOCK_WORDS = 100_000

_LISTS = "term_bytes binary, term_ends binary, list_ends binary, places binary"


# ---------------------------------------------------------------- the index


def build(docs: DataFrame) -> DataFrame:
    """The stored index of `docs` (doc_id, text): segment, doc_ids, n_words, and the terms with their lists of places."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_ids", "n_words", "term_bytes", "term_ends", "list_ends", "places"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text=1):
            found = terms(batch.column(1))
            used = found.names.cast(pa.large_binary())
            ends = np.frombuffer(used.buffers()[1], np.int64)[used.offset + 1 : used.offset + len(used) + 1]
            sizes = np.bincount(found.codes, minlength=len(used))
            row = [
                pa.array([batch.column(0).to_pylist()], pa.list_(batch.column(0).type)), pa.array([found.counts.astype(np.int32)], pa.list_(pa.int32())),
                *(pa.array([v], pa.binary()) for v in (
                    used.buffers()[2].to_pybytes()[: int(ends[-1])] if len(used) else b"", ends.astype("<u4").tobytes(),
                    np.cumsum(sizes).astype("<u4").tobytes(), np.argsort(found.codes, kind="stable").astype("<u4").tobytes(),
                )),
            ]
            yield pa.RecordBatch.from_arrays(row, names=names)

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    made = rows.mapInArrow(work, f"doc_ids array<{kind}>, n_words array<int>, {_LISTS}")
    return materialize(made.withColumn("segment", F.monotonically_increasing_id()))


def indexed_documents(index: DataFrame) -> DataFrame:
    """(segment, doc_no, doc_id, n_words) of every document of the index."""
    zipped = F.posexplode(F.arrays_zip("doc_ids", "n_words")).alias("doc_no", "doc")
    return index.select("segment", zipped).select("segment", "doc_no", F.col("doc.doc_ids").alias("doc_id"), F.col("doc.n_words").cast("long").alias("n_words"))


def _term_array(term_bytes: bytes, term_ends: bytes) -> pa.Array:
    ends = np.frombuffer(term_ends, "<u4").astype(np.int64)
    cuts = np.concatenate([[0], ends])
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(cuts), pa.py_buffer(term_bytes)])


def _found(asked: pa.Array, row: dict) -> np.ndarray:
    """The number of each asked term within the segment, -1 where it is not there."""
    at = pc.index_in(asked, value_set=_term_array(row["term_bytes"], row["term_ends"]))
    return at.fill_null(-1).to_numpy(zero_copy_only=False)


def term_counts(index: DataFrame, asked: list[bytes]) -> np.ndarray:
    """How often each of `asked` stands in the corpus."""
    names = pa.array(asked, pa.large_binary())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(names), np.int64)
        for batch in slices(batches, rows=8):
            for row in batch.to_pylist():
                at = _found(names, row)
                sizes = np.diff(np.frombuffer(row["list_ends"], "<u4").astype(np.int64), prepend=0)
                total[at >= 0] += sizes[at[at >= 0]]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["term", "n"])

    counts = np.zeros(len(asked), np.int64)
    sums = index.select("term_bytes", "term_ends", "list_ends").mapInArrow(work, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
    for term, n in sums.collect():  # at most as many as were asked for
        counts[term] = n
    return counts


# ---------------------------------------------------------------- windows of the items


class _Block:
    """Windows of some items: rows of term numbers, -1 behind the end of short ones, and the items of each window."""

    def __init__(self, window: int) -> None:
        self.window, self.terms, self.windows, self.items, self.words = window, {}, {}, {}, 0

    def add(self, item, words: list[bytes]) -> None:
        codes = [self.terms.setdefault(w, len(self.terms)) for w in words]
        at = self.items.setdefault(item, len(self.items))
        for k in range(max(len(codes) - self.window, 0) + 1):
            self.windows.setdefault(tuple(codes[k : k + self.window]), {})[at] = None
        self.words += len(codes)


def _blocks(items: DataFrame, window: int) -> Iterator[_Block]:
    """Blocks of at most BLOCK_WORDS words; a longer item is cut, so that cuts overlap by all but one word of a window."""
    block = _Block(window)
    for item, text in items.select("item_id", F.col("text").cast("string")).toLocalIterator():
        words = terms_of(text)
        for start in range(0, len(words), BLOCK_WORDS):
            part = words[max(start - window + 1, 0) : start + BLOCK_WORDS]
            if block.words and block.words + len(part) > BLOCK_WORDS:
                yield block
                block = _Block(window)
            block.add(item, part)
    if block.words:
        yield block


# ---------------------------------------------------------------- search


class _Segment:
    """One row of the index, open for a search."""

    def __init__(self, row: dict, asked: pa.Array) -> None:
        self.counts = np.array(row["n_words"], np.int64)
        self.ends = np.cumsum(self.counts)
        self.lists = np.frombuffer(row["list_ends"], "<u4")
        self.places = np.frombuffer(row["places"], "<u4")
        self.at = _found(asked, row)

    def places_of(self, term: int) -> np.ndarray:
        """Where a term that is there stands."""
        k = self.at[term]
        return self.places[(self.lists[k - 1] if k else 0) : self.lists[k]].astype(np.int64)

    def document(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, places, side="right")


def _holds(sorted_places: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(sorted_places, wanted), len(sorted_places) - 1)
    return sorted_places[at] == wanted


def _phrase(segment: _Segment, codes: np.ndarray, rarest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of every occurrence of a window."""
    first = rarest[0]
    starts = segment.places_of(codes[first]) - first
    starts = starts[starts >= 0]
    for offset in rarest[1:]:
        if not len(starts):
            break
        starts = starts[_holds(segment.places_of(codes[offset]), starts + offset)]
    return starts, starts + len(codes) - 1


def _near(segment: _Segment, codes: np.ndarray, rarest: np.ndarray, within: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of every least stretch of at most `within` words that holds all terms of a window."""
    lists = [segment.places_of(t) for t in dict.fromkeys(codes[rarest].tolist())]
    rare = lists[0]
    starts = np.unique(np.concatenate(lists))
    last = starts.copy()
    for places in lists:
        at = np.searchsorted(places, starts)
        there = at < len(places)
        starts, last, at = starts[there], last[there], at[there]
        last = np.maximum(last, places[at])
        close = last - starts < within
        starts, last = starts[close], last[close]
    least = np.ones(len(starts), bool)
    least[:-1] = last[1:] != last[:-1]  # of stretches with one end the shortest
    return (starts[least], last[least]) if len(rare) else (starts[:0], last[:0])


def search(index: DataFrame, items: DataFrame, window: int = WINDOW, within: int | None = None) -> DataFrame:
    """(segment, doc_no, item_id, spans) of each item that a document holds a window of.

    A window is `window` consecutive words of the item, or all of a shorter one. Spans are word places within the document, end exclusive,
    ascending; those of one item that touch or overlap are one. With `within`, a window's terms may stand in any order, in a
    stretch of at most so many words.
    """
    kind = items.schema["item_id"].dataType.simpleString()
    ddl = f"segment long, doc_no int, item_id {kind}, spans array<struct<start: int, end: int>>"
    found = None
    for block in _blocks(items, window):
        part = _search_block(index, block, within, ddl, kind)
        found = materialize(part) if found is None else materialize(found.unionAll(part))
    return found if found is not None else index.sparkSession.createDataFrame([], ddl)


def _search_block(index: DataFrame, block: _Block, within: int | None, ddl: str, kind: str) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    counts = term_counts(index, list(block.terms))
    asked = pa.array(list(block.terms), pa.large_binary())
    kept = [w for w in block.windows if all(counts[c] for c in w)]
    width = max(map(len, kept), default=1)
    codes = np.full((len(kept), width), -1, np.int32)
    for k, w in enumerate(kept):
        codes[k, : len(w)] = w
    lengths = (codes >= 0).sum(axis=1)
    rarest = np.argsort(np.where(codes >= 0, counts[codes], np.iinfo(np.int64).max), axis=1, kind="stable").astype(np.int32)
    items, item_ids = [list(block.windows[w]) for w in kept], list(block.items)
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, rows=4):
            for row in batch.to_pylist():
                segment = _Segment(row, asked)
                there = np.append(segment.at >= 0, True)  # the last is for places behind short windows
                hits: list[np.ndarray] = []
                for k in np.flatnonzero(there[codes].all(axis=1)).tolist():
                    args = segment, codes[k, : lengths[k]], rarest[k, : lengths[k]]
                    starts, last = _phrase(*args) if within is None else _near(*args, within)
                    docs = segment.document(starts)
                    same = docs == segment.document(last)
                    for item in items[k] if same.any() else ():
                        n = int(same.sum())
                        hits.append(np.stack([docs[same], np.full(n, item), starts[same], last[same] + 1], axis=1))
                if hits:
                    yield pa.RecordBatch.from_pylist(_spans(np.concatenate(hits), segment, row["segment"], item_ids), schema=schema)

    return index.select("segment", "n_words", "term_bytes", "term_ends", "list_ends", "places").mapInArrow(work, ddl)


def _spans(hits: np.ndarray, segment: _Segment, number: int, item_ids: list) -> list[dict]:
    """Hits (document, item, start, end) as one row per document and item, with the spans that are left when touching ones are joined."""
    out: list[dict] = []
    key = None
    for doc, item, start, end in hits[np.lexsort(hits.T[::-1])].tolist():
        before = int(segment.ends[doc] - segment.counts[doc])
        if (doc, item) != key:
            key, spans = (doc, item), []
            out.append({"segment": number, "doc_no": doc, "item_id": item_ids[item], "spans": spans})
        if spans and start - before <= spans[-1]["end"]:
            spans[-1]["end"] = max(spans[-1]["end"], end - before)
        else:
            spans.append({"start": start - before, "end": end - before})
    return out


def _covered(spans: Column) -> Column:
    """How many places spans cover together."""
    start = F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n"))

    def step(state: Column, span: Column) -> Column:
        return F.struct(
            F.greatest(state["upto"], span["end"]).alias("upto"),
            (state["n"] + F.greatest(span["end"] - F.greatest(span["start"], state["upto"]), F.lit(0))).alias("n"),
        )

    return F.aggregate(F.array_sort(spans), start, step, lambda s: s["n"])


def contamination(index: DataFrame, matches: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, item_ids (as text, sorted) and contaminated of every document of the index."""
    per_doc = matches.groupBy("segment", "doc_no").agg(
        _covered(F.flatten(F.collect_list("spans"))).alias("n_hit"),
        F.collect_set("item_id").alias("ids"), F.max(F.col("item_id").isNull()).cast("int").alias("nameless"),
    )
    joined = indexed_documents(index).join(per_doc, ["segment", "doc_no"], "left")
    hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    ids = F.array_sort(F.transform(F.coalesce("ids", F.array()), lambda i: i.cast("string")))
    return joined.select(
        "doc_id", "n_words", hit.alias("n_hit"),
        F.coalesce(F.size("ids") + F.col("nameless"), F.lit(0)).cast("long").alias("n_items"), ids.alias("item_ids"), (hit > 0).alias("contaminated"),
    )
