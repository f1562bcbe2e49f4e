import random
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
from test_tokens_packing import naive_bins

import corpus_pipeline
from patchloom.llm import packing
from patchloom.llm.queries import MIX_WEIGHTS
from patchloom.llm.tables import materialize


def test_prefixes_of_the_sequences_keep_the_shares(spark, documents):
    rng = random.Random(6)
    sizes = {"src0": 400, "src1": 900, "src2": 120}  # words of a text: without the mix, lengths would sort the sources
    rows = []
    for source, n in sizes.items():
        for k in range(1_500_000 * MIX_WEIGHTS[source] // (n * 10)):
            rows.append((len(rows), " ".join(rng.choice(("one", "two", "six", "ten")) for _ in range(n)), source))
    docs = materialize(documents(rows).repartition(5))
    mixed = materialize(corpus_pipeline.pfair_mix(spark, docs, ""))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")  # so that files are read split and out of order
    try:
        got = corpus_pipeline.best_fit_packing(spark, mixed, "").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    source, weights = {d: s for d, _, s in rows}, sum(MIX_WEIGHTS.values())
    last = max(r.sequence_id for r in got)
    tokens = sum(r.length for r in got)
    for share in (0.25, 0.5, 0.75):
        seen = Counter()
        for r in got:
            if r.sequence_id <= share * last:
                seen[source[r.doc_id]] += r.length
        for s, n in MIX_WEIGHTS.items():
            assert abs(seen[s] / sum(seen.values()) - n / weights) < 0.1, (share, seen, tokens)


def test_order_of_files_of_any_name(spark, tmp_path):
    """Files of one number or of other names are not thrown together."""
    names = ["part-00001-x.c000.parquet", "part-00001-x.c001.parquet", "part-00000-x.c000.parquet", "b.parquet", "a.parquet"]
    for k, name in enumerate(names):
        pq.write_table(pa.table({"doc_id": pa.array(range(10 * k, 10 * k + 10), pa.int64()), "text": ["t"] * 10}), tmp_path / name)
    got = packing.in_file_order(spark.read.parquet(str(tmp_path))).collect()
    assert len({r._order for r in got}) == 50
    assert [r.doc_id // 10 for r in sorted(got, key=lambda r: r._order)][::10] == [2, 0, 1, 4, 3]
    assert [r.doc_id % 10 for r in sorted(got, key=lambda r: r._order)] == list(range(10)) * 5
    pq.write_table(pa.table({"doc_id": pa.array([3, 1, 2], pa.int64()), "text": ["t"] * 3}), tmp_path / "one.parquet")
    alone = packing.in_file_order(spark.read.parquet(str(tmp_path / "one.parquet"))).orderBy("_order")
    assert [r.doc_id for r in alone.collect()] == [3, 1, 2]


def test_windows_hold_every_item_once_and_follow_the_order(spark):
    rng = random.Random(7)
    rows = [(k, 0, rng.randrange(1, 101), (k // 700 << 40) + k % 700) for k in range(3000)]
    items = spark.createDataFrame(rows, "doc_id long, piece int, length long, at long").repartition(6)
    got = packing.place_in_order(items, "at", capacity=100, window=40).collect()
    assert Counter((r.doc_id, r.piece, r.length, r.at) for r in got) == Counter(rows)
    inside, start, windows = {}, 0, {}
    for k, _, n, _ in rows:
        windows.setdefault(start // 4000, []).append(n)
        inside[k] = start // 4000
        start += n
    held = {}
    for r in got:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length, r.doc_id))
    assert sorted(held) == list(range(len(held))) and len(held) == sum(naive_bins(w, 100) for w in windows.values())
    firsts = [min(held[s])[2] for s in range(len(held))]
    assert firsts == sorted(firsts)
    for parts in held.values():
        parts.sort()
        assert len({inside[d] for _, _, d in parts}) == 1 and parts[0][0] == 0
        assert all(a + n == b for (a, n, _), (b, _, _) in zip(parts, parts[1:])) and parts[-1][0] + parts[-1][1] <= 100
