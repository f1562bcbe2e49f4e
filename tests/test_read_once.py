"""What is read, scored and shuffled once."""

from pyspark.sql import functions as F

from patchloom.checks import registry
from patchloom.functions.text import strip, strip_long
from patchloom.operators import context, segments


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _documents(spark, path):
    rows = [(d, f"word {d}\nif x: return open(name)", "en", f"src{d % 3}", 30) for d in range(12)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(d, d % 2, 0) for d in range(5)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    events = [(e, 1, "error", 0.0) for e in range(5)]
    spark.createDataFrame(events, "event_id long, user_id long, event_type string, value double").withColumn(
        "ts", F.timestamp_seconds("event_id")
    ).write.parquet(f"{path}/events.parquet")
    return str(path)


def test_only_labelled_chunks_get_features(spark, tmp_path):
    labelled = registry._labelled(spark, _documents(spark, tmp_path))
    plan = _plan(labelled)
    assert plan.index("regexp_extract_all") < plan.index("Join")  # the join comes first
    assert labelled.count() == 5


def test_triage_split_reads_stored_scores(spark, tmp_path):
    split = registry.f5_triage_split(spark, _documents(spark, tmp_path))
    assert "doc_id" not in _plan(split) and split.count() == 12


def test_pieces_of_hunks_stay_where_the_join_put_them(spark):
    body = ["+a", " b", "-c"]
    found = spark.createDataFrame([("p", 0, 0, body), ("p", 0, 1, ["+d"]), ("p", 1, 0, [])], "pr_id string, hunk_ord long, block long, body array<string>")
    numbered = spark.createDataFrame([("p", 0, 0, "f", 1, 3), ("p", 1, 1, "f", 9, 9)], "pr_id string, hunk_ord long, chunk_ord long, file_path string, start_line long, end_line long")
    chunks = segments._assembled(found, numbered, ["pr_id"], "hunk_ord")
    rows = [tuple(r)[1:] for r in chunks.orderBy("chunk_ord").collect()]
    assert rows == [(0, "f", 1, 3, ["a", "d"], ["b"], "+a\n b\n-c\n+d\n"), (1, "f", 9, 9, [], [], "")]
    same = segments._assembled(found, numbered, ["pr_id"])
    assert [tuple(r)[1:] for r in same.orderBy("chunk_ord").collect()] == rows


def test_reviewed_files_without_routes(spark):
    lines = lambda n: [f"l{i}" for i in range(n)]
    rows = [("p", "a", 2, 5, 6, lines(2), ["x"] * 9), ("p", "a", 1, 1, 2, lines(2), []), ("p", "big", 3, 1, 501, lines(501), []),
            ("p", "small", 4, 1, 2, lines(2), []), (None, "a", 5, 1, 3, lines(3), []), ("p", None, 6, 1, 3, lines(3), []), ("q", "a", 7, 1, 500, lines(500), [])]
    chunks = spark.createDataFrame(rows, "pr_id string, file_path string, chunk_ord long, start_line long, end_line long, added_lines array<string>, context_lines array<string>")
    found = context.reviewed_files(chunks)
    assert "Join" not in _plan(found)
    assert sorted(found.collect()) == sorted(context.reviewed_files(chunks, context.file_routes(chunks)).collect())
    assert sorted((r.pr_id, r.file_path, r.file_ord) for r in found.collect()) == [("p", "a", 1), ("q", "a", 7)]


def test_long_texts_are_stripped_alike(spark):
    texts = ["", " ", "a", " a", "a ", "　a　", "a\u0085", "é", " é", "a\x1f", "a\x7f", "}", "\n {a b} \t", " ", None, "a b"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = rows.select("t", strip(F.col("t")).alias("a"), strip_long(F.col("t")).alias("b")).collect()
    assert [r.b for r in got] == [r.a for r in got] == [None if r.t is None else r.t.strip() for r in got]
