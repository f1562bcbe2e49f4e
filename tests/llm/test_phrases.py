import random
import re
from collections import Counter

import pytest
from llm_cases import ODD

from patchloom.llm import phrases

_TERM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain_terms(text):
    return _TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_hits(doc, windows):
    """Words of a document within a window of an item, and the items."""
    hit, items = set(), set()
    for item, window in windows:
        for k in range(len(doc) - len(window) + 1):
            if doc[k : k + len(window)] == window:
                hit.update(range(k, k + len(window)))
                items.add(item)
    return len(hit), sorted(map(str, items))


def windows_of(items, size):
    out = []
    for item, text in items:
        words = plain_terms(text)
        if words:
            out += [(item, words[k : k + size]) for k in range(max(len(words) - size, 0) + 1)]
    return out


@pytest.fixture
def benchmark(spark):
    return lambda rows: spark.createDataFrame(rows, "item_id long, text string")


def check(documents, benchmark, rows, items, window):
    index = phrases.build(documents(rows).repartition(3))
    found = phrases.contamination(index, phrases.search(index, benchmark(items), window)).collect()
    windows = windows_of(items, window)
    want = Counter()
    for doc_id, text in rows:
        words = plain_terms(text)
        n_hit, names = plain_hits(words, windows)
        want[(doc_id, len(words), n_hit, len(names), tuple(names), n_hit > 0)] += 1
    assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, tuple(r.item_ids), r.contaminated) for r in found) == want
    return want


def some_texts(rng, n, words):
    marks = [" ", " ", ", ", ".\n", "-", " 'É ", "\x00"]
    return [(k, "".join(rng.choice(["a", "B", "c", "Dé", "e9", "é"]) + rng.choice(marks) for _ in range(rng.randrange(words)))) for k in range(n)]


def test_against_brute_force(documents, benchmark):
    rng = random.Random(1)
    rows, items = some_texts(rng, 120, 60), [(500 + k, t) for k, t in some_texts(rng, 20, 12)]
    rows += [(300 + k, items[k % 20][1] + " between " + items[(k + 3) % 20][1]) for k in range(30)]
    want = check(documents, benchmark, rows, items + items[:2], 4)
    assert sum(r[5] for r in want) > 40


def test_long_windows_and_odd_rows(documents, benchmark):
    long_item = " ".join(f"w{k}" for k in range(40))
    rows = ODD + [(70, "x " * 9 + long_item + " y"), (71, long_item.replace("w20", "W20!")), (72, " ".join(long_item.split()[:9])), (73, "one, TWO three")]
    items = [(1, long_item), (2, None), (3, " ."), (4, "Two three"), (5, "word " * 12), (6, "xxxxx")]
    check(documents, benchmark, rows, items, 10)


def test_no_phrase_crosses_documents(documents, benchmark):
    index = phrases.build(documents([(1, "a b"), (2, "c d")]).coalesce(1))
    assert phrases.search(index, benchmark([(1, "b c")])).isEmpty()
    assert phrases.search(index, benchmark([(1, "b c")]), within=5).isEmpty()


def test_blocks_of_items(documents, benchmark, monkeypatch):
    monkeypatch.setattr(phrases, "BLOCK_WORDS", 7)
    rng = random.Random(2)
    rows = some_texts(rng, 60, 50)
    check(documents, benchmark, rows, [(500 + k, t) for k, t in some_texts(rng, 10, 25)], 3)


def test_empty_tables(documents, benchmark):
    check(documents, benchmark, [], [(1, "a b")], 10)
    check(documents, benchmark, [(1, "a b"), (None, None)], [], 10)


@pytest.mark.parametrize("within", [3, 5, 9])
def test_near_words(documents, benchmark, within):
    rng = random.Random(within)
    rows, items = some_texts(rng, 60, 30), [(500 + k, t) for k, t in some_texts(rng, 12, 5)]
    index = phrases.build(documents(rows).repartition(3))
    ids = {(r.segment, r.doc_no): r.doc_id for r in phrases.indexed_documents(index).collect()}
    found = {(ids[r.segment, r.doc_no], r.item_id): {k for s in r.spans for k in range(s.start, s.end)} for r in phrases.search(index, benchmark(items), 3, within).collect()}
    want = {}
    for doc_id, text in rows:
        words = plain_terms(text)
        for item, window in windows_of(items, 3):
            for a in range(len(words)):
                for b in range(a + 1, min(a + within, len(words)) + 1):
                    inside = set(words[a:b])
                    if set(window) <= inside and not set(window) <= set(words[a + 1 : b]) and not set(window) <= set(words[a : b - 1]):
                        want.setdefault((doc_id, item), set()).update(range(a, b))
    assert found == want and want
