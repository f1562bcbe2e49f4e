import random
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from patchloom.llm import simhash
from patchloom.llm.components import components
from llm_cases import ODD


def plain_fingerprint(text, width=4):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate(
        {c: " " for c in range(9, 14)}).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def plain_components(rows):
    prints = [(d, plain_fingerprint(t)) for d, t in rows]
    up = list(range(len(prints)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i][1] ^ prints[j][1]).count("1") <= 4:
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(prints):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [(d, f"{p:016x}", least.get(root(i))) for i, (d, p) in enumerate(prints)]


def corpus():
    rng = random.Random(3)
    words = [f"w{k}" for k in range(500)]
    rows = []
    for k in range(40):
        base = [rng.choice(words) for _ in range(rng.choice([2, 4, 30, 200]))]
        rows.append((100 + len(rows) * 7 % 1009, " ".join(base)))
        for _ in range(rng.choice([0, 0, 2, 6])):
            near = list(base)
            near[rng.randrange(len(near))] = rng.choice(words)
            rows.append((100 + len(rows) * 7 % 1009, ("  " if k % 2 else "\n").join(near).upper()))
    return rows + ODD


def test_classes_are_those_of_all_pairs(documents):
    rows = corpus()
    got = simhash.near_duplicates(documents(rows).repartition(4)).collect()
    assert Counter(map(tuple, got)) == Counter(plain_components(rows))


def test_one_document_of_each_class_stays(documents):
    rows = corpus()
    got = simhash.unique_documents(documents(rows).withColumn("fingerprint", F.lit("given")))
    want = {c for _, _, c in plain_components(rows)}  # no class shares an id with another
    kept = [r.doc_id for r in got.collect()]
    assert Counter(kept) == Counter(want) and got.columns[-1] == "fingerprint"


def test_empty_table(documents):
    assert simhash.near_duplicates(documents([])).count() == 0


def test_thresholds_reach_every_pair():
    rng = np.random.default_rng(5)
    bits = rng.random((4000, 64)) < rng.random(64)
    for rows in (10, 10**5, 10**8):
        plan = simhash.choose_thresholds(rows, (bits.T.astype(float) @ bits * (rows / 4000)).astype(np.int64))
        assert sum(t + 1 for _, t in plan) == simhash.MAX_BITS + 1
        used = [b for g, _ in plan for b in g]
        assert len(used) == len(set(used))


def test_links_of_blocks_and_of_random_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 20)  # crowded keys are cut into blocks
    monkeypatch.setattr(simhash, "PAIRS_AT_ONCE", 50)
    rng = random.Random(8)
    centre, values = rng.getrandbits(64), set()
    for _ in range(300):
        x = centre
        for _ in range(rng.randint(0, 6)):
            x ^= 1 << rng.randrange(64)
        values.add(x)
    values |= {rng.getrandbits(64) for _ in range(200)}
    frame = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in values], "fingerprint long")
    rows, together = simhash.bit_statistics(frame)
    plan = simhash.choose_thresholds(rows, together)
    roots = dict(map(tuple, components(simhash.links(frame, plan)).collect()))
    signed = [int(np.uint64(v).view(np.int64)) for v in values]
    got = Counter(roots.get(v, v) for v in signed)
    up = {v: v for v in values}

    def root(v):
        while up[v] != v:
            v = up[v]
        return v

    listed = sorted(values)
    for i, a in enumerate(listed):
        for b in listed[:i]:
            if bin(a ^ b).count("1") <= 4:
                up[root(a)] = root(b)
    assert sorted(got.values()) == sorted(Counter(root(v) for v in listed).values())


def test_components_of_a_long_chain(spark):
    links = [(k, k + 1) for k in range(300)] + [(1000, 1001), (5, 5), (None, 3), (1001, 1000)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {**{k: 0 for k in range(301)}, 1000: 1000, 1001: 1000}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
