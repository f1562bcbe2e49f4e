from collections import Counter, defaultdict

import duckdb
import pytest
from llm_cases import ODD

from patchloom.llm import mixing
from patchloom.llm.tables import materialize


def corpus():
    rows = [(k, "x" * (k % 7 * 10), f"s{k % 11 % 4}") for k in range(900)]
    rows += [(2000 + k, "long " * 30, "s0") for k in range(500)] + [(5, "x" * 40, "s1"), (5, "x" * 40, "s1")]
    return rows + [(*r, None if r[0] == 2 else "") for r in ODD if r[0] != 4] + [(4, "y" * 30_000, "s3")]


WEIGHTS = {"s0": 5, "s1": 2}


def test_mix_is_that_of_sql(documents):
    docs = documents(corpus())
    got = mixing.mix(docs.repartition(4), WEIGHTS, block_chars=64)
    rows = Counter((r.doc_id, r.source or "", r.block, r.position, r.start) for r in got.collect())
    frame = docs.toPandas()
    frame["doc_id"] = frame["doc_id"].astype("Int64")
    con = duckdb.connect()
    con.register("documents", frame)
    assert rows == Counter(con.execute(mixing.oracle(WEIGHTS, block_chars=64)).fetchall())


def test_hashed_null_and_equal_ids_spread(documents):
    """Orders that no bucket of ids could deal out; the same rows as SQL on any partitioning."""
    rows = [((k * 0x9E3779B97F4A7C15) % (1 << 63) - (1 << 62), "x" * (k % 5 * 9), "s0") for k in range(1500)]
    rows += [(None, "y" * (k % 3), "s1") for k in range(900)] + [(7, "same text", "s2")] * 900
    docs = documents(rows)
    con = duckdb.connect()
    con.register("documents", docs.toArrow())  # pandas would round large ids beside nulls
    want = Counter(con.execute(mixing.oracle(WEIGHTS, block_chars=64)).fetchall())
    for parts in (1, 7):
        got = mixing.mix(docs.repartition(parts), WEIGHTS, block_chars=64).collect()
        assert Counter((r.doc_id, r.source, r.block, r.position, r.start) for r in got) == want
    assert Counter((r.doc_id, r.text, r.source) for r in got) == Counter(rows)
    stored = materialize(docs.selectExpr("doc_id", "source as _mix_source", "cast(length(text) as long) as _mix_chars", "monotonically_increasing_id() as _mix_row"))
    ranged = mixing._ranged(stored)
    largest = max(r["count"] for r in ranged.groupBy("_mix_part").count().collect())
    assert largest < len(rows) / 3  # each of the sources holds more


def test_many_sources(documents):
    rows = [(k, "x" * 64, f"s{k % 60:02d}") for k in range(600 + 30)]
    got = mixing.mix(documents(rows), {}, block_chars=64).collect()
    assert sorted(r.position for r in got) == list(range(len(rows)))
    assert all(r.source == f"s{r.position % 60:02d}" for r in got)


def test_deviation_is_below_one_block(documents):
    rows = [(k, "x" * 64, f"s{k % 4}") for k in range(1600)]
    got = mixing.mix(documents(rows), WEIGHTS, block_chars=64).collect()
    order = [r.source for r in sorted(got, key=lambda r: r.position)]
    assert len({r.position for r in got}) == len(order) == 1600
    weight = {"s0": 5, "s1": 2, "s2": 1, "s3": 1}
    done, until = defaultdict(int), 80 * 9  # s0 has 400 blocks, 80 frames
    for slot, source in enumerate(order[:until], 1):
        done[source] += 1
        assert all(abs(done[s] - slot * w / 9) < 1 for s, w in weight.items())
    rest, done = order[until:], defaultdict(int)  # then the others share the slots
    for slot, source in enumerate(rest[: 120 * 4], 1):
        done[source] += 1
        assert all(abs(done[s] - slot * weight[s] / 4) < 1 for s in ("s1", "s2", "s3"))


def test_native_plan_clashes_and_empty_table(documents):
    docs = documents(corpus()).withColumnRenamed("lang", "block")
    mixed = mixing.mix(docs, WEIGHTS)
    plan = mixed._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "Cartesian"))
    assert Counter(mixed.columns) == Counter([*docs.columns, "position", "start"])
    assert mixing.mix(documents([]), WEIGHTS).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(docs, {"s0": 0})
