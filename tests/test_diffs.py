"""Diffs are made from known chunks, so the expected result needs no second parser."""

import random
import time

import pytest
from pyspark.sql import functions as F

from patchloom.operators import diffs as D
from patchloom.sources import landed

CHUNK = ["file_path", "start_line", "end_line", "added_lines", "context_lines", "raw_patch"]


def parsed(spark, diff, merge=False):
    df = spark.createDataFrame([("p", diff)], "pr_id string, diff string")
    rows = (D.review_chunks if merge else D.parse_diffs)(df, ["pr_id"])
    return [tuple(r[c] for c in CHUNK) for r in rows.orderBy("chunk_ord").collect()]


@pytest.mark.parametrize("path, kept", [
    ("svc/run.py", True), ("ui/View.jsx", True), ("core/util.ts", True), ("q.sql", True),
    ("package-lock.json", False), ("out/app.min.js", False), ("settings.json", False),
    ("NOTES.md", False), ("types.d.ts", False), ("a/dist/x.js", False), ("mydist/x.py", False),
    ("x.generated.go", False), ("Makefile", False), ("a.b/file", False), ("X.PY", False),
    ("node_modules/m.js", False), ("rebuild/x.c", False), ("building/x.c", True),
])
def test_reviewable(spark, path, kept):
    df = spark.createDataFrame([(path,)], "path string")
    assert df.select(D.is_reviewable(F.col("path"))).first()[0] is kept


TWO_HUNKS = "\n".join([
    "diff --git a/svc/lib/run.py b/svc/lib/run.py", "index 1..2", "--- a/svc/lib/run.py",
    "+++ b/svc/lib/run.py",
    "@@ -4,3 +4,5 @@ def first():", " keep", "+new one", "-gone", "+new two", " tail",
    "@@ -40 +42,2 @@", " ctx", "+++double", "+last", "\\ No newline at end of file",
])


def test_two_hunks(spark):
    assert parsed(spark, TWO_HUNKS) == [
        ("svc/lib/run.py", 4, 6, ["new one", "new two"], ["keep", "tail"],
         " keep\n+new one\n-gone\n+new two\n tail\n"),
        # a line that opens with three plus signs only moves the counter
        ("svc/lib/run.py", 42, 44, ["last"], ["ctx"],
         " ctx\n+++double\n+last\n\\ No newline at end of file\n"),
    ]


def test_lines_that_do_not_count(spark):
    diff = "\n".join([
        "@@ -1 +1 @@", "+before any header",
        "diff --git a/a.py b/a.py", "old mode 100644", "+ignored before a hunk",
        "@@ -1 +7 @@", "new mode 100755", "--- x", "+a\r", "Binary files differ", "",
        "diff --git mode only", "@@ -1 +30 @@", "+b", "@@ -1 +60 @@", "-c", " d", "",
    ])
    assert parsed(spark, diff) == [
        ("a.py", 7, 8, ["a\r"], [], "--- x\n+a\r\n\n"),
        ("a.py", 30, 30, ["b"], [], "+b\n"),
    ]


@pytest.mark.parametrize("diff", ["", "x", "diff --git a/r.md b/r.md\n@@ -1 +1 @@\n+t\n"])
def test_no_chunks(spark, diff):
    assert parsed(spark, diff) == parsed(spark, diff, merge=True) == []


def random_diff(rng):
    """A diff text, its chunks, and its chunks after merging."""
    lines, chunks = [], []
    for _ in range(rng.randint(1, 4)):
        path = rng.choice(["a.py", "b.go", "c.md", "d.rs"])
        lines += [f"diff --git a/{path} b/{path}", f"+++ b/{path}"]
        number = rng.randint(1, 5)
        for _ in range(rng.randint(0, 4)):
            start = number
            lines.append(f"@@ -1,2 +{start},9 @@" if rng.random() < 0.7 else f"@@ -1 +{start} @@ f()")
            added, context, raw, end = [], [], "", start
            for _ in range(rng.randint(1, 7)):
                body = rng.choice(["x = 1", "", "++i", "--i", "été", " y"])
                mark = rng.choice("+++ -")
                lines.append(mark + body)
                raw += mark + body + "\n"
                if mark == "+" and not body.startswith("++"):
                    added.append(body)
                    end = number
                if mark == " ":
                    context.append(body)
                if not (mark == "-" and not body.startswith("--")):
                    number += 1
            if added and path != "c.md":
                chunks.append((path, start, end, added, context, raw))
            number += rng.choice([0, 3, 9, 12])
    merged = []
    for chunk in chunks:
        near = merged and merged[-1][0] == chunk[0] and chunk[1] - merged[-1][2] < 10
        if near:
            p = merged[-1]
            merged[-1] = (p[0], p[1], chunk[2], p[3] + chunk[3], p[4] + chunk[4], p[5] + chunk[5])
        else:
            merged.append(chunk)
    return "\n".join(lines), chunks, merged


def test_random_diffs(spark):
    rng = random.Random(7)
    cases = {f"p{i}": random_diff(rng) for i in range(200)}
    df = spark.createDataFrame([(k, v[0]) for k, v in cases.items()], "pr_id string, diff string")
    for place, rows in ((1, D.parse_diffs(df, ["pr_id"])), (2, D.review_chunks(df, ["pr_id"]))):
        got = {k: [] for k in cases}
        for row in rows.orderBy("pr_id", "chunk_ord").collect():
            got[row.pr_id].append(tuple(row[c] for c in CHUNK))
        assert got == {k: v[place] for k, v in cases.items()}
    assert sum(len(v[1]) - len(v[2]) for v in cases.values()) > 20


def test_parsing_needs_no_shuffle(spark, tmp_path):
    spark.createDataFrame([("p", TWO_HUNKS, "other")], "pr_id string, diff string, note string").write.parquet(str(tmp_path / "d"))
    df = D.review_chunks(spark.read.parquet(str(tmp_path / "d")), ["pr_id"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan and "Window" not in plan
    assert "ReadSchema: struct<pr_id:string,diff:string>" in plan


def test_new_side_numbers(spark):
    df = spark.createDataFrame([("p", TWO_HUNKS)], "pr_id string, diff string")
    rows = D.new_side_lines(D.hunks(df, ["pr_id"]), ["pr_id"]).orderBy("hunk_ord", "line_no").collect()
    assert [(r.line_no, r.line[:4], r.is_added) for r in rows] == [
        (4, " kee", False), (5, "+new", True), (6, "+new", True), (7, " tai", False),
        (42, " ctx", False), (43, "+++d", False), (44, "+las", True), (45, "\\ No", False),
    ]


def test_one_diff_with_most_of_the_lines(spark):
    """Many sections, many hunks, and one very long hunk in one row: every line is there, in time."""
    parts, want = [], []
    for i in range(400):
        parts.append(f"diff --git a/f{i}.py b/f{i}.py")
        for h in range(10):
            start = 1 + h * 30
            parts += [f"@@ -1 +{start},2 @@", f"+l{h}", " c", f"+m{h}"]
            want.append((f"f{i}.py", start, start + 2, 2))
    parts += ["diff --git a/long.go b/long.go", "@@ -0,0 +1,150000 @@", *["+x"] * 150_000]
    want.append(("long.go", 1, 150_000, 150_000))
    rows = [("big", "\n".join(parts))] + [(f"s{i}", TWO_HUNKS) for i in range(20)]
    df = spark.createDataFrame(rows, "pr_id string, diff string")
    begin = time.time()
    got = D.review_chunks(df, ["pr_id"]).filter("pr_id = 'big'").select(
        "chunk_ord", "file_path", "start_line", "end_line", F.size("added_lines").alias("n")
    ).orderBy("chunk_ord").collect()
    assert [(r.file_path, r.start_line, r.end_line, r.n) for r in got] == want
    assert time.time() - begin < 60


@pytest.mark.parametrize("start", ["99999999999999999999", "\u0663"])
def test_a_header_that_cannot_be_read_costs_its_diff_only(spark, start):
    bad = f"diff --git a/x.py b/x.py\n@@ -1,1 +{start},1 @@\n+a = 1\n@@ -9,1 +9,1 @@\n+b = 2\n"
    good = "diff --git a/x.py b/x.py\n@@ -1,1 +5,1 @@\n+a = 1\n"
    df = spark.createDataFrame([("bad", bad), ("good", good)], "pr_id string, diff string")
    assert [(r.pr_id, r.start_line) for r in D.parse_diffs(df, ["pr_id"]).collect()] == [("good", 5)]
    prs = spark.createDataFrame([("bad",), ("good",), ("none",)], "pr_id string")
    got = {r.pr_id: r.status for r in landed.pr_status(prs, df).collect()}
    assert got == {"bad": "error", "good": "ok", "none": "error"}
