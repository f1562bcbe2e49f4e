"""The whole job on a few small PRs, and a sample of the registered queries beside their SQL."""

import json
from datetime import datetime
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from patchloom.plans import review, snippets
from patchloom.sources import sinks
from patchloom.streaming import reviews

SMALL = "/root/testdata/sf0.001"


def section(path, hunks):
    lines = [f"diff --git a/{path} b/{path}"]
    for start, added in hunks:
        lines += [f"@@ -1,0 +{start},{len(added)} @@"] + ["+" + a for a in added]
    return "\n".join(lines)


def inputs(spark):
    prs = [("p1", "r", 1, "s1", "Title", None, "main"), ("p2", "r", 2, "s2", None, "body", None),
           ("p3", "r", 3, "s3", "t", "b", "main"), ("p4", "r", 4, "s4", "t", "b", "main")]
    risky = ["def run(x):", "    return eval(x)", "    done()"]
    diffs = [
        ("p1", section("app/run.py", [(1, risky), (90, ["a = 1", "b = 2"])]) + "\n" + section("big.go", [(5, ["x := 1"] * 501)])),
        ("p2", section("README.md", [(1, ["text"])])),
        ("p3", ""),
    ]
    return {
        "pull_requests": spark.createDataFrame(prs, "pr_id string, repo string, pr_number bigint, head_sha string, title string, body string, base_branch string"),
        "diff_table": spark.createDataFrame(diffs, "pr_id string, diff string"),
        "pr_files": spark.createDataFrame([("p1", 0, "app/run.py", "@@\n+def run(x):"), ("p1", 1, "tests/test_run.py", None)], "pr_id string, file_ord bigint, filename string, patch string"),
        "commits": spark.createDataFrame([("r", "app/run.py", datetime(2024, 1, 1), "c", "fix bug")], "repo string, file_path string, committed_at timestamp, sha string, message string"),
        "file_contents": spark.createDataFrame([("p1", "app/run.py", 9, "ZGVmIHJ1bih4KToK")], "pr_id string, path string, size bigint, content_b64 string"),
    }


def test_job(spark, tmp_path):
    first = review.triage(**inputs(spark))
    scored = {(r.file_path, r.start_line): r for r in first.scored.collect()}
    assert scored["app/run.py", 1].score == 0.8 and scored["app/run.py", 1].has_test_coverage
    prompt = first.prompts.collect()
    assert [p.file_path for p in prompt] == ["app/run.py"]
    assert "Title: Title" in prompt[0].prompt and "`app/run.py`: def run(x):" in prompt[0].prompt
    text = json.dumps({"findings": [{"type": "security", "severity": "high", "line_content": "eval(x)", "message": "m"}]})
    responses = spark.createDataFrame([("p1", "app/run.py", "ok", text)], "pr_id string, file_path string, status string, response_text string")
    last = review.conclude(first.prs, first.triage_counts, first.routes, first.files, responses)
    assert [(c.path, c.line) for c in last.comments.orderBy("path").collect()] == [("app/run.py", 2), ("big.go", 5)]
    reports = {r.pr_id: r for r in last.reports.collect()}
    assert reports["p1"].triage.high_risk == 3 and reports["p1"].breakdown.security == 1 and reports["p1"].findings == 2
    assert (reports["p2"].status, reports["p2"].detail, reports["p2"].chunks_analyzed) == ("ok", "no reviewable changes", 0)
    assert reports["p3"].status == reports["p4"].status == "error"
    assert last.summaries.first().summary.startswith("Reviewed 3 chunks in 2 files.\nHigh severity: 1.")
    sinks.write_comments(last.comments, first.prs, str(tmp_path / "c"))
    assert sinks.read_comments(spark, str(tmp_path / "c")).select("repo", "head_sha").first() == ("r", "s1")


def test_stream_runs_the_job_per_batch(spark, tmp_path):
    payload = json.dumps({"action": "opened", "pull_request": {"number": 1, "head": {"sha": "s1"}}, "repository": {"name": "r", "owner": {"login": "o"}}})
    rows = [(1, "pull_request", payload), (2, "push", payload), (3, "pull_request", payload)]
    spark.createDataFrame(rows, "delivery_id bigint, event_type string, payload string").coalesce(1).write.json(str(tmp_path / "in"))
    tables = inputs(spark)

    def run(accepted):
        keys = accepted.select("pr_number", "head_sha", "delivery_id")
        prs = tables["pull_requests"].drop("head_sha")
        wanted = keys.join(prs, "pr_number")
        listed = wanted.drop("delivery_id").distinct()
        read = tables["diff_table"].join(listed, "pr_id", "left_semi")
        job = review.triage(**{**tables, "pull_requests": listed, "diff_table": read}, store=False)
        return wanted.select("delivery_id", "pr_id").join(job.triage_counts, "pr_id")

    reviews.review_stream(
        reviews.read_events(spark, str(tmp_path / "in")), run, str(tmp_path / "out"), str(tmp_path / "progress")
    ).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out/reports")).collect()
    assert sorted((r.delivery_id, r.total_chunks) for r in got) == [(1, 3), (3, 3)]
    assert spark.read.parquet(str(tmp_path / "out/rejected")).first().delivery_id == 2


def test_snippets(spark):
    code = "def go(x):\n    return eval(x)\n    done()"
    rows = [("s1", "a.py", code), ("s2", None, "x\ny"), ("s3", "b.py", "y" * 10001), ("s4", "c.py", "z\n" * 600)]
    table = spark.createDataFrame(rows, "snippet_id string, filename string, code string")
    prompts = snippets.snippet_prompts(table).collect()
    assert [(p.snippet_id, p.file_path) for p in prompts] == [("s1", "a.py")]
    assert "eval(x)" in prompts[0].prompt and "# Pull request" not in prompts[0].prompt
    text = json.dumps({"findings": [{"type": "security", "severity": "high", "line_content": "eval(x)", "message": "m"}]})
    answers = spark.createDataFrame([("s1", "a.py", "ok", text)], "snippet_id string, file_path string, status string, response_text string")
    found = {r.snippet_id: r for r in snippets.snippet_review(table, answers).collect()}
    assert (found["s1"].line, found["s1"].type, found["s1"].total_findings) == (2, "security", 1)
    assert found["s4"].message.startswith("601 lines") and set(found) == {"s1", "s4"}
    risk = {r.snippet_id: r for r in snippets.snippet_scores(table).collect()}
    assert set(risk) == {"s1", "s2", "s4"} and risk["s2"].file_path == "snippet.py"
    assert risk["s1"].risk_score == 0.7 and risk["s1"].would_trigger_review and len(risk["s1"].risk_factors) == 2


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["d6_merged_chunks", "e1_diff_features", "c6_prompts", "i5_grouped_findings", "m2_commit_samples", "t2_admissions"])
def test_query_beside_sql(spark, name):
    if not Path(SMALL).exists():
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for file in Path(SMALL).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    df = entry.queries()[name](spark, SMALL)
    columns = sorted(df.columns)
    got = sorted(tuple(r) for r in df.select(columns).collect())
    want = sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall())
    assert got == want
