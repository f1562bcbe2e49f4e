"""Events and answers as two streams, against `conclude` on the same rows."""

import json
from datetime import datetime, timedelta

import pytest

from patchloom.plans import review
from patchloom.sources import batches
from patchloom.streaming import answers, reviews
from pyspark.sql import functions as F

START = datetime(2024, 1, 1)
REPLY = answers.ANSWERS


def chunk(pr, path, at, score, lines):
    return (pr, path, at, 10 * at + 1, 10 * at + lines, [f"x = {k}" for k in range(lines)], [], score)


#: Two files to answer, one that is too large, one low-risk; one file; none; an error.
CHUNKS = [
    chunk("p-1", "a.py", 0, 0.9, 4), chunk("p-1", "b.py", 1, 0.8, 5), chunk("p-1", "c.py", 2, 0.8, 501), chunk("p-1", "d.py", 3, 0.1, 5),
    chunk("p-2", "a.py", 0, 0.9, 4), chunk("p-3", "a.py", 0, 0.1, 4), chunk("p-5", "a.py", 0, 0.9, 3), chunk("p-5", "b.py", 1, 0.9, 3),
]
STATUS = [("p-1", "ok"), ("p-2", "ok"), ("p-3", "ok"), ("p-4", "error"), ("p-5", "ok")]


def found(*messages):
    return json.dumps({"findings": [{"type": "bug", "severity": "high", "message": m, "line_content": "x = 1"} for m in messages]})


@pytest.fixture
def job(spark):
    chunks = spark.createDataFrame(
        CHUNKS, "pr_id string, file_path string, chunk_ord bigint, start_line bigint, end_line bigint, added_lines array<string>, context_lines array<string>, score double"
    )
    prs = spark.createDataFrame(STATUS, "pr_id string, status string")

    def triage(wanted):
        from patchloom.operators import context, scoring

        mine = chunks.join(wanted, "pr_id", "left_semi")
        high = scoring.high_risk(mine)
        routes = context.file_routes(high)
        files = context.reviewed_files(high, routes)
        return review.Triage(
            prs=prs.join(wanted, "pr_id", "left_semi"), scored=high, routes=routes, files=files, prompts=files.select("pr_id", "file_path"),
            triage_counts=scoring.triage_counts(mine, True),
        )

    return triage


class Streams:
    def __init__(self, spark, triage, folder):
        self.spark, self.triage, self.folder = spark, triage, str(folder)

    def deliver(self, *events):
        rows = [
            (k, "pull_request", json.dumps({
                "action": "opened", "pull_request": {"number": number, "head": {"sha": sha}}, "repository": {"name": "p", "owner": {"login": "o"}},
            }), START + timedelta(seconds=at)) for k, (number, sha, at) in enumerate(events)
        ]
        self.spark.createDataFrame(rows, f"{reviews.EVENT_SCHEMA}, at timestamp").coalesce(1).write.mode("append").json(f"{self.folder}/events")
        stream = reviews.read_events(self.spark, f"{self.folder}/events", 1, f"{reviews.EVENT_SCHEMA}, at timestamp")
        name = lambda: F.concat_ws("-", "repo_name", F.col("pr_number").cast("string"))
        answers.asking_stream(stream, self.triage, name, f"{self.folder}/store", f"{self.folder}/p1").awaitTermination()

    def reply(self, *rows):
        full = [(pr, sha, START + timedelta(seconds=at), path, status, text) for pr, sha, at, path, status, text in rows]
        self.spark.createDataFrame(full, REPLY).coalesce(1).write.mode("append").parquet(f"{self.folder}/replies")

    def follow(self):
        """Starts the second stream, which takes what has landed and stops."""
        closed = answers.closed_reviews(
            answers.read_asked(self.spark, f"{self.folder}/store", 1),
            self.spark.readStream.schema(REPLY).option("maxFilesPerTrigger", 1).parquet(f"{self.folder}/replies"), 600,
        )
        with answers.list_store(self.spark):
            answers.report_stream(closed, f"{self.folder}/store", f"{self.folder}/out", f"{self.folder}/p2").awaitTermination()

    def read(self, table):
        rows = batches.read_current(self.spark, f"{self.folder}/out", table)
        return sorted(rows.drop("head_sha").select(*sorted(set(rows.columns) - {"head_sha"})).collect(), key=repr)


TICK = ("", "", 100_000, "", "ok", "")


def batch_form(spark, triage, replies, table):
    wanted = spark.createDataFrame([(p,) for p, _ in STATUS], "pr_id string")
    first = triage(wanted)
    responses = spark.createDataFrame(replies, "pr_id string, file_path string, status string, response_text string")
    rows = getattr(review.conclude(first.prs, first.triage_counts, first.routes, first.files, responses), table)
    return sorted(rows.select(*sorted(rows.columns)).collect(), key=repr)


def test_reports_equal_the_batch_form(spark, job, tmp_path):
    s = Streams(spark, job, tmp_path)
    s.deliver((1, "s", 0), (2, "s", 1), (3, "s", 2))
    s.reply(("p-1", "s", 30, "b.py", "ok", found("one", "two")), ("p-9", "s", 31, "a.py", "ok", found("nobody asked")))
    s.follow()
    assert {r.pr_id for r in batches.read_current(spark, f"{tmp_path}/out", "reports").collect()} == {"p-3"}  # nothing was asked
    # the stream has stopped in mid-review and goes on; more events, a repeated one, an early answer, two answers for one file
    s.reply(("p-5", "s", 39, "b.py", "ok", found("early")), ("p-1", "s", 41, "z.py", "ok", found("not asked")))
    s.deliver((4, "s", 40), (5, "s", 41), (1, "s", 42))
    s.reply(("p-1", "s", 60, "a.py", "ok", found("three")), ("p-5", "s", 61, "b.py", "ok", found("too late")))
    s.follow()
    assert {r.pr_id for r in batches.read_current(spark, f"{tmp_path}/out", "reports").collect()} == {"p-1", "p-3", "p-4"}
    s.reply(TICK)  # time is up for p-2 and p-5
    s.follow()
    same = [
        ("p-1", "a.py", "ok", found("three")), ("p-1", "b.py", "ok", found("one", "two")), ("p-5", "b.py", "ok", found("early")),
        ("p-2", "a.py", "timeout", None), ("p-5", "a.py", "timeout", None),
    ]
    for table in ("comments", "summaries", "reports"):
        assert s.read(table) == batch_form(spark, job, same, table)
    skipped = {r.pr_id: r.files_skipped for r in batches.read_current(spark, f"{tmp_path}/out", "reports").collect()}
    assert skipped["p-2"] == ["a.py"] and skipped["p-5"] == ["a.py"] and skipped["p-1"] == []


def test_a_new_head_and_a_review_after_the_end(spark, job, tmp_path):
    s = Streams(spark, job, tmp_path)
    s.deliver((2, "s", 0), (2, "t", 1))
    s.reply(("p-2", "s", 2, "a.py", "ok", found("of s")), ("p-2", "t", 3, "a.py", "ok", found("of t")))
    s.follow()
    by_head = {r.head_sha: r.body for r in batches.read_current(spark, f"{tmp_path}/out", "comments").collect()}
    assert "of s" in by_head["s"] and "of t" in by_head["t"]
    s.deliver((2, "s", 4))
    s.reply(("p-2", "s", 5, "a.py", "ok", found("again")))
    s.follow()
    by_head = {r.head_sha: r.body for r in batches.read_current(spark, f"{tmp_path}/out", "comments").collect()}
    assert "again" in by_head["s"] and "of t" in by_head["t"]  # the later review replaces its own, no other
    assert batches.read_batches(spark, f"{tmp_path}/out", "comments").count() == 3


def test_batches(spark, tmp_path):
    path = str(tmp_path / "t")

    def put(batch, keys, rows, **more):
        table = spark.createDataFrame(rows, "pr_id string, n int, repo string")
        batches.commit(spark, path, batch, spark.createDataFrame([(k,) for k in keys], "pr_id string"), comments=table, **more)

    put(1, ["a", "b"], [("a", 1, "r"), ("b", 2, "r")])
    put(2, ["c"], [("c", 3, "r")])
    assert {(r.pr_id, r.n) for r in batches.read_current(spark, path, "comments").collect()} == {("a", 1), ("b", 2), ("c", 3)}
    put(2, ["c"], [("c", 4, "r")])  # run again
    put(3, ["b"], [])  # b has no comment any more
    assert {(r.pr_id, r.n) for r in batches.read_current(spark, path, "comments").collect()} == {("a", 1), ("c", 4)}
    with pytest.raises(Exception):  # ends between two tables, before the commit
        put(4, ["a"], [("a", 9, "r")], reports=spark.range(1).select(F.raise_error(F.lit("killed")).alias("x")))
    assert {(r.pr_id, r.n) for r in batches.read_current(spark, path, "comments").collect()} == {("a", 1), ("c", 4)}
    assert batches.read_batches(spark, path, "comments").count() == 3
