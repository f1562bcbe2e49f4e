import random
from collections import Counter

import duckdb
import pytest
from llm_cases import ODD
from pyspark.sql import functions as F
from test_ordinal import rated
from test_tokens_packing import naive_bins, plain

import corpus_pipeline
from patchloom.llm import mixing, secret_scan
from patchloom.llm.queries import MIX_WEIGHTS


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The tables of each stage over a small corpus with good, bad and toxic texts, copies, secrets and odd rows."""
    folder = tmp_path_factory.mktemp("tables")
    rng = random.Random(5)
    rows = [(d, t + f" unique{d} " * 3, g) for d, t, g in rated(500, 4)]
    rows += [(70_000 + k, rows[k][1] + (" password=hunter22" if k % 2 else ""), rows[k][2]) for k in range(0, 120, 3)]
    rows += [(80_000 + k, rows[3][1], rows[3][2]) for k in range(200)]
    documents = [(d, t, "en", f"src{rng.choice([0, 0, 1, 2, 3])}", len(t)) for d, t, _ in rows]
    documents += [(d, t, None, None, None) for d, t in ODD]
    spark.createDataFrame(documents, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    labels = [(d, int(g == 2), int(g == 0)) for d, _, g in rows if d % 2]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs, tables = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        tables.append(docs)
        stage(spark, docs, str(folder)).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return [*tables, docs], {d: g for d, _, g in rows}, str(folder)


def columns(frame):
    return Counter(tuple(r) for r in frame.collect())


def test_all_but_the_last_return_the_columns_of_documents(stages):
    tables, _, _ = stages
    assert len({tuple(t.dtypes) for t in tables[:-1]}) == 1


def test_classifier_keeps_good_texts(stages):
    (before, after, *_), grades, _ = stages
    kept, given = Counter(r.doc_id for r in after.collect()), Counter(r.doc_id for r in before.collect())
    assert not kept - given and not columns(after) - columns(before)
    good = [kept[d] > 0 for d, g in grades.items() if g == 2]
    rest = [kept[d] > 0 for d, g in grades.items() if g < 2]
    assert sum(good) / len(good) > 0.95 and sum(rest) / len(rest) < 0.05


def test_near_dedup_keeps_rows_as_they_are(stages):
    (_, before, after, *_), _, _ = stages  # which rows: test_near_copies.test_stage_within_the_pipeline
    assert not columns(after) - columns(before)


def test_secrets_are_masked(stages):
    (_, _, before, after, *_), _, _ = stages
    want = Counter()
    for r in before.collect():
        text = secret_scan.mask(r.text) if r.text else r.text
        want[(r.doc_id, text, r.lang, r.source, r.n_chars if text is None else len(text))] += 1
    assert columns(after) == want and not after.filter(F.col("text").contains("hunter22")).count()


def test_mix_has_the_order_of_sql(spark, stages):
    (_, _, _, before, after, _), _, folder = stages
    assert columns(before) == columns(after)
    con = duckdb.connect()
    con.register("documents", before.toPandas())
    want = con.execute(f"SELECT doc_id FROM ({mixing.oracle(MIX_WEIGHTS)}) ORDER BY position, start, doc_id NULLS FIRST").fetchall()
    files = sorted(f for f in after.inputFiles())
    got = [r.doc_id for f in files for r in spark.read.parquet(f).coalesce(1).collect()]
    assert got == [d for d, in want]


def test_packing_of_what_is_left(stages):
    *_, before, after = stages[0]
    tokenizer = plain("byte_bpe_50k.json")
    lengths = {r.doc_id: len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in before.collect()}
    got = after.collect()
    sums = Counter()
    for r in got:
        sums[r.doc_id] += r.length
    assert sums == lengths and len({r.sequence_id for r in got}) == naive_bins([r.length for r in got], 1024)


def test_run_gives_the_last_table_and_empty_tables_pass(spark, stages, tmp_path):
    tables, _, folder = stages
    assert columns(corpus_pipeline.run(spark, folder).drop("sequence_id", "offset")) == columns(tables[-1].drop("sequence_id", "offset"))
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_columns_with_clashing_names(spark, stages):
    tables, _, folder = stages
    docs = tables[0].filter("doc_id is not null").limit(40).withColumns({c: F.lit("given") for c in (
        "fingerprint", "tail_probability", "expected_grade", "block", "position", "start", "spans", "tokens", "length", "piece", "n")})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.dtypes == docs.dtypes and all(r.position == "given" and r.tail_probability == "given" for r in out.collect())
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() >= 40
