import bisect
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from patchloom.llm import packing, tokens
from llm_cases import ODD

FILES = [("byte_bpe_50k.json", tokens.BLANK_LEADS), ("word_bpe_49k.json", tokens.BLANK_DROPS)]


def plain(name):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    tokenizer.encode_special_tokens = True
    return tokenizer


@pytest.mark.parametrize("name,blank", FILES)
@pytest.mark.parametrize("cached", [5, 700_000])
def test_cached_ids_are_those_of_the_whole_text(name, blank, cached, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", cached)
    encode, whole = tokens.CachedEncoder(public_tokenizers.path(name), blank, 2).encode, plain(name)

    @settings(max_examples=60, deadline=None)
    @given(st.lists(st.text(alphabet=" \n\taA1',.éßΩ\xa0\x01\x1c|", max_size=25), min_size=1, max_size=8))
    def check(texts):
        flat, lengths = encode(pa.array(texts, pa.string()))
        got = [x.tolist() for x in np.split(flat, np.cumsum(lengths)[:-1])]
        assert got == [e.ids + [2] for e in whole.encode_batch(texts, add_special_tokens=False)]

    check()


@pytest.mark.parametrize("name,blank", FILES)
def test_texts_that_name_added_tokens(name, blank):
    """As the library has them, without any setting of ours."""
    encode, whole = tokens.CachedEncoder(public_tokenizers.path(name), blank, 2).encode, Tokenizer.from_file(public_tokenizers.path(name))
    texts = [
        "hello <|endoftext|> world", "plain text", None, "<|ENDOFTEXT|> in capitals", "a<|startoftext|>b<|endoftext|>", "<|endoftext", "", "  <|endoftext|>\n",
    ]
    flat, lengths = encode(pa.array(texts, pa.string()))
    got = [x.tolist() for x in np.split(flat, np.cumsum(lengths)[:-1])]
    assert got == [whole.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]


def naive_bins(lengths, capacity):
    rooms = []
    count = 0
    for length in sorted(lengths, reverse=True):
        at = bisect.bisect_left(rooms, length)
        room = rooms.pop(at) if at < len(rooms) else capacity
        count += room == capacity
        bisect.insort(rooms, room - length) if room > length else None
    return count


def test_plan_is_best_fit_decreasing():
    rng = random.Random(4)
    for capacity in (7, 50, 1024):
        for _ in range(15):
            lengths = [rng.randint(1, capacity) for _ in range(rng.randint(1, 900))]
            sizes = Counter(lengths)
            plan = packing.best_fit_plan(sizes, capacity).tolist()
            fill, taken = Counter(), {}
            for size, n in sizes.items():
                runs = sorted(r for r in plan if r[0] == size)
                for run, end in zip(runs, [r[1] for r in runs[1:]] + [n]):
                    for rank in range(run[1], end):
                        step = rank - run[1]
                        sequence, offset = run[2] + step // run[3], run[4] + step % run[3] * size
                        fill[sequence] += size
                        taken.setdefault(sequence, []).append((offset, size))
            assert max(fill.values()) <= capacity and len(fill) == naive_bins(lengths, capacity)
            for parts in taken.values():
                at = 0
                for offset, size in sorted(parts):
                    assert offset == at
                    at += size


def test_pieces_and_places(spark, documents):
    rng = random.Random(9)
    rows = [(k, " ".join(rng.choice(["alpha", "beta", "gamma7", "d,"]) for _ in range(rng.choice([3, 40, 300, 2500])))) for k in range(60)]
    rows += ODD
    docs = documents(rows).repartition(5)
    path = public_tokenizers.path("byte_bpe_50k.json")
    stored = packing.place(packing.tokenized_pieces(docs, path))
    got = stored.collect()
    whole = plain("byte_bpe_50k.json")
    want = Counter()
    for doc_id, text in rows:
        ids = whole.encode(text or "", add_special_tokens=False).ids + [2]
        pieces = -(-len(ids) // 1024)
        first = len(ids) - 1024 * (pieces - 1)
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[doc_id, k, a, np.array(ids[a:b], "<u4").tobytes()] += 1
    assert Counter((r.doc_id, r.piece, r.start, bytes(r.tokens)) for r in got) == want
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(places) == naive_bins([r.length for r in got], 1024)
    lines = {r.sequence_id: r for r in packing.sequences(stored).collect()}
    for key, r in lines.items():
        parts = sorted((g.offset, bytes(g.tokens)) for g in got if g.sequence_id == key)
        assert zlib.crc32(bytes(r.tokens)) == zlib.crc32(b"".join(t for _, t in parts))


def test_items_without_a_valid_length_and_empty_tables(spark, documents):
    items = spark.createDataFrame([(1, 5, "x"), (2, None, "y"), (3, 0, "z"), (4, 1025, "w")], "id int, length int, offset2 string")
    got = {r.id: (r.sequence_id, r.offset) for r in packing.place(items).collect()}
    assert got == {1: (0, 0), 2: (None, None), 3: (None, None), 4: (None, None)}
    assert packing.place(packing.tokenized_pieces(documents([]), public_tokenizers.path("byte_bpe_50k.json"))).count() == 0
