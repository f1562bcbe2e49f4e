"""Findings are dealt out by PR once, from their files to their groups."""

from pyspark.sql import functions as F

from patchloom.operators import context, findings
from patchloom.plans import review
from patchloom.session import joined_where_dealt
from patchloom.sources import fixtures

CHUNKS = "pr_id string, file_path string, chunk_ord long, start_line long, end_line long, added_lines array<string>, context_lines array<string>"


def _tables(spark):
    """Two PRs: a file that is reviewed, one too large, one too small, one whose answer came too late; rows that repeat, keys that are null."""
    chunks = [
        ("p", "a", 1, 1, 3, ["x = 1", "y = 2", "z"], []), ("p", "a", 2, 9, 11, ["u", "v", "w"], ["c"]), ("p", "big", 3, 5, 600, ["l"] * 501, []),
        ("p", "small", 4, 1, 2, ["s"], []), ("q", "b", 5, 1, 3, ["x = 1"] * 3, []), ("q", "late", 6, 1, 4, ["r"] * 4, []),
        (None, "a", 7, 1, 3, ["n"] * 3, []), ("q", None, 8, 1, 3, ["n"] * 3, []),
    ]
    found = '{"findings": [{"message": "m", "line_content": "y = 2"}, {"message": "m", "line_content": "w"}, {"type": "style", "message": "k"}]}'
    answers = [("p", "a", "ok", found), ("q", "b", "ok", found), ("q", "b", "ok", found), ("q", "late", "timeout", None),
               ("p", "big", "timeout", None), (None, "a", "ok", found), ("q", None, "timeout", None)]
    return spark.createDataFrame(chunks, CHUNKS), spark.createDataFrame(answers, "pr_id string, file_path string, status string, response_text string")


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_findings_are_shuffled_once_on_the_way_to_their_groups(spark):
    chunks, answers = _tables(spark)
    parsed, plain = findings.parse_responses(answers), context.file_routes(chunks)
    want = findings.group_findings(findings.located(parsed, context.reviewed_files(chunks, plain)))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with joined_where_dealt(spark):
            got = findings.group_findings(findings.located(parsed, context.reviewed_files(chunks, by_pr=True), by_pr=True))
            assert _exchanges(got) == 2  # one of the chunks, one of the findings
            rows = sorted(map(str, got.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert rows == sorted(map(str, want.collect())) and len(rows) == 4
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"


def test_a_conclusion_reads_its_files_once(spark, monkeypatch):
    chunks, answers = _tables(spark)
    routes, files = context.file_routes(chunks), context.reviewed_files(chunks)
    prs = spark.createDataFrame([("p", "ok"), ("q", "ok"), ("r", "error")], "pr_id string, status string")
    counts = chunks.groupBy("pr_id").agg(*(F.count("*").alias(c) for c in ("total_chunks", "high_risk")), F.lit(0).alias("low_risk_skipped"), F.lit(True).alias("classifier_loaded"))
    stored, write = [], review.materialize
    monkeypatch.setattr(review, "materialize", lambda df, *a, **b: stored.append(df.columns) or write(df, *a, **b))
    got = review.conclude(prs, counts, routes, files, answers)
    assert [c for c in stored if "chunks" in c and "route" not in c] == []
    reports = {r.pr_id: r for r in got.reports.collect()}
    assert reports["q"].files_skipped == ["late"] and reports["p"].files_skipped == [] and reports["r"].detail == "no diff"
    assert (reports["p"].files_checked, reports["p"].findings, reports["q"].findings) == (3, 3, 2)  # with the remark on the large file
    lazy = review.conclude(prs, counts, routes, files, answers, store=False)
    for name in ("comments", "summaries", "reports"):
        assert sorted(map(str, getattr(got, name).collect())) == sorted(map(str, getattr(lazy, name).collect()))


def test_snippet_findings_are_counted_beside_the_rows(spark):
    rows = [("s", 1, 0, "bug", "high", "m", 3, "c"), ("s", 1, 1, "bug", "high", "m", 3, "c"), ("t", 1, 0, None, None, None, None, None), (None, 1, 0, "bug", "low", "m", 1, "")]
    grouped = spark.createDataFrame(rows, "pr_id string, file_ord long, finding_ord int, type string, severity string, message string, line long, line_content string")
    found = findings.snippet_findings(grouped)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.pr_id, r.finding_ord, r.total_findings) for r in found.collect()) == [("s", 0, 2), ("s", 1, 2), ("t", 0, 1)]


def test_a_scan_of_many_tasks_is_not_shuffled(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    spark.range(400).repartition(3 * cores).write.parquet(f"{tmp_path}/many/t.parquet")
    spark.range(400).coalesce(1).write.parquet(f"{tmp_path}/one/t.parquet")
    spark.range(300).coalesce(1).union(spark.range(300, 400).repartition(3 * cores)).write.parquet(f"{tmp_path}/uneven/t.parquet")
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", str(128 << 20))  # a task for each file
    try:
        for kind, moved in (("many", 0), ("one", 1), ("uneven", 1)):
            rows = fixtures.read_spread(spark, f"{tmp_path}/{kind}", "t", "id")
            assert _exchanges(rows) == moved, kind
            assert rows.count() == 400
        empty = spark.range(0)
        empty.write.parquet(f"{tmp_path}/none/t.parquet")
        assert fixtures.read_spread(spark, f"{tmp_path}/none", "t", "id").count() == 0
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)
