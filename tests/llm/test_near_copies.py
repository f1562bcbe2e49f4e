import random
from collections import Counter

from llm_cases import ODD
from test_pipeline import stages  # noqa: F401

import corpus_pipeline
from patchloom.llm import near_copies


def plain_sets(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_kept(rows):
    """The least id of each class, all pairs compared."""
    up, sets = list(range(len(rows))), [plain_sets(t) for _, t in rows]

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                up[root(i)] = root(j)
    classes = {}
    for i, (d, _) in enumerate(rows):
        classes.setdefault(root(i), []).append(d)
    return Counter(min((d for d in c if d is not None), default=None) for c in classes.values())


def test_stage_finds_copies_with_edited_words(spark, documents):
    rng = random.Random(4)
    rows = []
    for k in range(120):
        words = [rng.choice("abcdefghij") + str(rng.randrange(900)) for _ in range(200)]
        rows.append((1000 + k, " ".join(words)))
        for copy in range(3):
            edited = list(words)
            for at in rng.sample(range(200), rng.choice([1, 2, 3, 4, 6, 9])):
                edited[at] = f"edit{rng.random()}"
            rows.append((2000 + 10 * k + copy, " ".join(edited)))
    rows += [r for r in ODD if r[0] != 4]
    got = corpus_pipeline.near_dedup(spark, documents(rows).repartition(4), "")
    assert Counter(r.doc_id for r in got.collect()) == plain_kept(rows)


def test_large_group_and_empty_table(documents):
    text = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join([*text[:30], f"own{k}", *text[30:]])) for k in range(300)]  # 5 of 57 shingles are their own
    assert [r.doc_id for r in near_copies.unique_documents(documents(rows)).collect()] == [0]
    assert near_copies.unique_documents(documents([])).count() == 0


def test_stage_within_the_pipeline(stages):  # noqa: F811
    (_, before, after, *_), _, _ = stages
    assert Counter(r.doc_id for r in after.collect()) == plain_kept([(r.doc_id, r.text) for r in before.collect()])


def passage_texts(rng, n):
    """Texts with one passage of 60 words in common and 22 of their own: none is a copy, many share a band key."""
    passage = [f"p{k}" for k in range(60)]
    return [(k, " ".join([*passage[:30], *(f"own{k}_{rng.random()}" for _ in range(22)), *passage[30:]])) for k in range(n)]


def test_unlike_texts_with_a_passage(documents, monkeypatch):
    """All stay, and the rows that are dealt to tasks grow with the texts, not with their pairs."""
    rng, dealt = random.Random(8), []

    def counted(classed, given=near_copies._dealt):
        rows = given(classed)
        dealt.append(rows.count())
        return rows

    monkeypatch.setattr(near_copies, "_dealt", counted)
    for n in (500, 2000):
        got = near_copies.unique_documents(documents(passage_texts(rng, n)).repartition(4))
        assert got.count() == n
    assert 0 < dealt[1] < 5 * dealt[0] and dealt[1] < 24 * 2000


def test_blocks_of_a_run(documents, monkeypatch):
    """Small blocks: classes of a run meet across all of them."""
    monkeypatch.setattr(near_copies, "BLOCK", 7)
    rng = random.Random(2)
    base = [f"w{k}" for k in range(120)]
    rows = passage_texts(rng, 60)
    for group in range(6):  # near copies of near copies, all around 0.8
        words = list(base)
        for at in rng.sample(range(120), 6 + group):
            words[at] = f"g{group}_{at}"
        for k in range(15):
            edited = list(words)
            for at in rng.sample(range(120), rng.choice([0, 1, 2, 3])):
                edited[at] = f"e{rng.random()}"
            rows.append((1000 + 100 * group + k, " ".join(edited)))
    got = near_copies.unique_documents(documents(rows).repartition(4))
    assert Counter(r.doc_id for r in got.collect()) == plain_kept(rows)


def test_recall_just_above_the_least_similarity(documents):
    """Pairs at 0.80 to 0.84: nearly all meet (one in 14,000 may not)."""
    rng, rows = random.Random(6), []
    for k in range(300):
        words = [f"t{k}_{j}" for j in range(200)]
        edited = list(words)
        for at in (20, 70, 120, 170):  # 4 * 5 of 196 shingles change: 176 / 216 = 0.815
            edited[at] = "x"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(edited))]
    assert near_copies.unique_documents(documents(rows).repartition(4)).count() == 300
