import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from llm_cases import ODD

from patchloom.llm import ranked

_TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def plain_terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in _TERM.findall(text or "")]


def plain_ranking(rows, items, best):
    docs = [(d, Counter(plain_terms(t))) for d, t in rows]
    docs = [(d, c, c.total()) for d, c in docs if c]
    n_docs, n_terms = len(docs), sum(n for _, _, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in items:
        wanted, scored = Counter(plain_terms(text)), []
        for d, c, n in docs:
            m = 100 - 25 + 25 * n * n_docs // n_terms
            s = sum(k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t, k in wanted.items() if t in c)
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(item, k + 1, d, -s) for k, (s, _, _, d) in enumerate(sorted(scored)[:best])]
    return Counter(out)


@pytest.fixture
def benchmark(spark):
    return lambda rows: spark.createDataFrame(rows, "item_id long, text string")


def check(documents, benchmark, rows, items, best=20):
    got = Counter(tuple(r) for r in ranked.rank(documents(rows).repartition(3), benchmark(items), best).collect())
    want = plain_ranking(rows, items, best)
    assert got == want
    return want


def some_rows(rng, n, words):
    vocabulary = [f"w{k}" for k in range(60)]
    shares = [1 / (k + 1) for k in range(60)]
    return [(k, " ".join(rng.choices(vocabulary, shares, k=rng.randrange(words)))) for k in range(n)]


@pytest.mark.parametrize("leaf", [1, 8, 64])
def test_against_brute_force(documents, benchmark, monkeypatch, leaf):
    monkeypatch.setattr(ranked, "LEAF", leaf)
    rng = random.Random(leaf)
    rows = some_rows(rng, 500, 40)
    rows += [(1000 + k, rows[7][1]) for k in range(200)]  # copies: ties by id
    items = [(k, t) for k, t in some_rows(rng, 15, 12)]
    check(documents, benchmark, rows, [*items, items[3], (99, None), (100, "never seen words W1")])


def test_blocks_and_small_trees(documents, benchmark, monkeypatch):
    monkeypatch.setattr(ranked, "BLOCK_TERMS", 10)
    monkeypatch.setattr(ranked, "CELLS", 1)
    rng = random.Random(4)
    check(documents, benchmark, some_rows(rng, 300, 30), some_rows(rng, 12, 9), best=5)


def test_odd_rows(documents, benchmark):
    rows = ODD + [(8, "É x! É"), (9, "One-two THREE word")]
    check(documents, benchmark, rows, [(1, "word three É é x"), (None, "one two"), (3, " .")])


def test_empty_tables(documents, benchmark):
    check(documents, benchmark, [], [(1, "a b")])
    check(documents, benchmark, [(1, "a b")], [])


def test_most_documents_are_never_scored():
    """Bounds of subtrees leave most leaves out once good documents are known."""
    rng = np.random.default_rng(0)
    size, docs = 400, 4096
    rows = [np.unique(np.minimum(rng.zipf(1.3, 25) - 1, size - 1)) for _ in range(docs)]
    rows[17] = np.arange(300, 330)
    starts = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    tree = ranked._Tree(starts, np.concatenate(rows), np.ones(starts[-1], np.int64), np.full(docs, 100), np.arange(docs), size)
    seen = []
    tree._score = lambda node, *rest: (seen.append(node), ranked._Tree._score(tree, node, *rest))
    best = ranked._Best(1)
    tree.search((np.arange(300, 330), np.full(30, 5000)), np.full(size, -1), best)
    assert best.ids.tolist() == [17]
    assert len(seen) < sum(not c for c in tree.children) / 10
