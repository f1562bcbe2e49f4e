import hashlib
import heapq
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from patchloom.llm import conversations as C

COLUMNS = "conv_id long, turn long, role string, text string"


def plain_repair(rows):
    """Cost, audit and turns by a search over (cost, audit): rows are (role, text, must go, truncated)."""
    legal = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, last, out = heapq.heappop(heap)
        if at == len(rows) and last in ("", "a"):
            return cost, audit, list(out)
        if (at, last) in seen:
            continue
        seen.add((at, last))
        steps = []
        for name in ("user", "assistant"):
            if (last, name[0]) in legal:
                steps.append((3, "I", 0, name[0], ((name, ""),)))
        if at < len(rows):
            role, text, gone, cut = rows[at]
            steps.append((4, "D", 1, last, ()))
            if not gone:
                if (last, role[:1]) in legal:
                    steps.append((3 * cut, "K", 1, role[:1], ((role, text),)))
                for name in ("user", "assistant"):
                    if (last, name[0]) in legal:
                        steps.append((3 + 3 * cut, "R", 1, name[0], ((name, text),)))
        for more, letter, on, state, added in steps:
            heapq.heappush(heap, (cost + more, audit + letter, at + on, state, out + added))


def plain(rows):
    """What the query returns for (conv_id, turn, role, text) rows after damage, without Spark."""
    found = {}
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t, r, x))
    for c, turns in by.items():
        damaged = []
        for t, r, x in sorted(turns, key=lambda v: (v[0] is not None, v[0] or 0, v[1] or " ", v[2] or " ")):
            r, x = " " if r is None else r, " " if x is None else x
            fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
            if fault == 0:
                continue
            x = "" if fault == 1 else "".join(ch for ch in x if ch not in ".!?") if fault == 2 else x
            damaged += [(t, "user" if fault == 4 else r, x)] * (2 if fault == 3 else 1)
        damaged.sort(key=lambda v: (v[0] is not None, v[0] or 0, v[1], v[2]))
        seen, marked, counts = set(), [], Counter()
        for _, r, x in damaged:
            stripped = x.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not stripped else "duplicate" if (r, x) in seen else "truncated" if stripped[-1] not in ".!?" else ""
            counts[fault] += 1
            seen.add((r, x))
            marked.append((r, x, fault in ("blank", "duplicate"), fault == "truncated"))
        cost, audit, out = plain_repair(marked)
        numbers = [t for t, _, _ in damaged if t is not None]
        initials = [r[:1] for _, r, _ in damaged]
        found[c] = (
            max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, counts["blank"], counts["duplicate"],
            counts["truncated"], sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
            hashlib.sha256("\n".join(f"{r}:{x}" for r, x in out).encode()).hexdigest(),
        )
    return found


def got(spark, rows):
    table = spark.createDataFrame(rows, COLUMNS)
    parts = C.repair(C.damaged(table.repartition(3)), present="present")
    out = C.digests(parts).collect()
    found = {r.conv_id: tuple(r)[1:] for r in out}
    assert len(found) == len(out)
    return found


def random_rows(rng, conversations, longest):
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", "User", None, "sam"]
    texts = ["Yes.", "Why?", "no end", "", " \t", None, "é!", "a.b", "x ", "Same."]
    return [
        (c, None if rng.random() < 0.02 else t * rng.choice([1, 1, 2]), rng.choice(roles), rng.choice(texts))
        for c in conversations for t in range(rng.randrange(1, longest))
    ]


def test_against_a_plain_search(spark):
    rows = random_rows(random.Random(7), [*range(150), None], 9)
    assert got(spark, rows) == plain(rows)


def test_conversations_of_many_parts(spark, monkeypatch):
    monkeypatch.setattr(C, "PART", 20)
    rng = random.Random(5)
    rows = random_rows(rng, range(12), 90)
    rows += [(50, t, "user", "The same again.") for t in range(150)]  # all but the first are duplicates
    rows += [(51, 7, "assistant", "Equal row.")] * 70  # one turn, one text
    rows += [(52, t, ("user", "assistant")[t % 2], f"turn {t}.") for t in range(100)]
    rows += [(53, t, ("system", "assistant", "tool")[t % 3], f"turn {t}") for t in range(90)]
    assert got(spark, rows) == plain(rows)


@pytest.mark.parametrize("seed", range(4))
def test_parts_meet_at_any_place(seed, monkeypatch):
    """The costs of parts, from state to state, put together give the costs of the whole."""
    rng = random.Random(seed)
    for _ in range(60):
        codes = "".join(rng.choice("suaoSUAO.") for _ in range(rng.randrange(2, 40)))
        at = rng.randrange(1, len(codes))
        monkeypatch.setattr(C, "PIECE", rng.choice([1, 3, 16]))
        end = C.FINAL
        for part in (codes[at:], codes[:at]):
            costs = [[c for c, _, _ in C._solve(part, tuple(0 if r == q else C.FAR for r in range(4)), (0, 1, 2, 3))] for q in range(4)]
            end = tuple(min(costs[r][q] + end[r] for r in range(4)) for q in range(4))
        rows = [({"s": "system", "u": "user", "a": "assistant"}.get(c.lower(), "x"), "t", c == ".", c.isupper()) for c in codes]
        cost, audit, out = plain_repair(rows)
        assert end[C.START] == cost and C.cheapest(codes) == (cost, audit)
        assert C.apply(audit, C.START, [(r, t) for r, t, _, _ in rows]) == out


def test_odd_rows(spark):
    rows = [(1, None, None, None), (None, 1, "user", "x."), (2, 1, "user", "word. " * 40_000), (3, 1, "user", "q?"), (3, 1, "user", "q?")]
    assert got(spark, rows) == plain(rows)
    assert got(spark, []) == {}
    clashing = spark.createDataFrame([(1, 0, "user", "Hi.", "x", 2)], COLUMNS + ", _key string, part long")
    assert [r.audit for r in C.repair(clashing).collect()] == ["KI"]


def test_a_conversation_that_is_dropped_whole(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert got(spark, [(gone, 0, "user", "Hi.")]) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_repaired_turns_are_legal(spark):
    rows = random_rows(random.Random(3), range(40), 12)
    out = C.repair(spark.createDataFrame(rows, COLUMNS)).select("conv_id", F.array_join(F.transform("messages", lambda m: F.substring(m["role"], 1, 1)), "").alias("roles"))
    assert out.filter(~F.col("roles").rlike("^(s?(ua)+)?$")).isEmpty()
