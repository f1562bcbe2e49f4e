"""Diffs in blocks against the same diffs in one row each."""

import random

import pytest
from pyspark.sql import functions as F

from patchloom.operators import diffs as D
from patchloom.operators import segments
from patchloom.sources import landed

KEYS = ["pr_id"]


def random_diff(rng, lines):
    """Lines of every kind in any order, so that headers, hunks and rests fall on all sides of a cut."""
    kinds = [
        lambda: f"diff --git a/x/{rng.choice('ab')}.py b/x/{rng.choice('ab')}.py", lambda: "diff --git a/r.md b/r.md", lambda: "diff --git mode only",
        lambda: f"@@ -1,2 +{rng.randrange(1, 60)},3 @@ def f():", lambda: "+added", lambda: "+", lambda: "-gone", lambda: " same", lambda: "+++ b/x", lambda: "--- a/x",
        lambda: "old mode 100644", lambda: "Binary files differ", lambda: "", lambda: "\\ No newline", lambda: "index 1..2",
    ]
    weights = [3, 1, 1, 8, 14, 2, 6, 8, 1, 1, 1, 1, 2, 1, 1]
    return "\n".join(rng.choices(kinds, weights)[0]() for _ in range(lines))


def rows_of(df, columns=None):
    columns = columns or sorted(df.columns)
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.fixture(scope="module")
def diffs(spark):
    rng = random.Random(3)
    rows = [(f"p{k}", random_diff(rng, rng.randrange(1, 90))) for k in range(120)]
    rows += [("unreadable", "diff --git a/a.py b/a.py\n@@ -1 +99999999999999999999 @@\n+x\n@@ -1 +2 @@\n+y"), ("empty", ""), ("none", None)]
    return spark.createDataFrame(rows, "pr_id string, diff string").cache()


@pytest.mark.parametrize("lines", [1, 3, 7, 1000])
def test_equal_to_the_row_form(spark, diffs, monkeypatch, lines):
    monkeypatch.setattr(segments, "FAN", 5)
    whole = diffs.filter(F.length("diff") > 0)
    blocks = segments.cut(diffs, KEYS, lines)
    assert rows_of(segments.parse_blocks(blocks, KEYS)) == rows_of(D.parse_diffs(whole, KEYS))
    assert rows_of(segments.review_blocks(blocks, KEYS)) == rows_of(D.review_chunks(whole, KEYS))
    found = segments.pieces(blocks, KEYS)
    in_rows = D.hunks(whole, KEYS)
    # hunk numbers of the row form leave out nothing but hunks ahead of the first header, as here
    columns = ["pr_id", "file_path", "start", "body"]
    assert rows_of(segments.hunks(found, KEYS), columns) == rows_of(in_rows, columns)
    numbered = ["pr_id", "file_path", "line_no", "is_added", "line"]
    assert rows_of(segments.new_side_lines(found, KEYS), numbered) == rows_of(D.new_side_lines(in_rows, KEYS), numbered)


def test_one_diff_in_a_thousand_blocks(spark):
    """Many tasks work on one diff, and no window sees its lines."""
    rng = random.Random(9)
    text = "\n".join(
        [line for f in range(40) for line in (f"diff --git a/f{f}.py b/f{f}.py", "--- a", "+++ b")
         for line in ([line] if not line.startswith("+++") else [line, *(row for h in range(5) for row in (f"@@ -1 +{h * 30 + 1} @@", *(rng.choice(["+new", " old", "-gone"]) for _ in range(18))))])]
    )
    table = spark.createDataFrame([("big", text)], "pr_id string, diff string")
    n = len(text.split("\n"))
    blocks = segments.cut(table, KEYS, max(n // 1000, 1)).repartition(8, "block")
    assert blocks.count() >= 1000
    assert rows_of(segments.review_blocks(blocks, KEYS)) == rows_of(D.review_chunks(table, KEYS))
    found = segments.scan(blocks.select("pr_id", "block"), KEYS, "block", total={"n": F.lit(1).cast("bigint")})
    assert found.filter("n != block").isEmpty()


def test_windows_carry_no_lines(spark, diffs):
    """What is sorted for a window has summaries only."""
    rows = segments.cut(diffs, KEYS, 7).select(*KEYS, "block", F.length("text").alias("n"))
    plan = segments.scan(rows, KEYS, "block", total={"before": F.col("n")})._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") == 2 and "body" not in plan


@pytest.mark.parametrize("ending", ["", "\n"])
def test_diff_files_by_byte_ranges(spark, tmp_path, ending):
    rng = random.Random(4)
    texts = {f"p{k}": random_diff(rng, 30 if k else 4000) + ending for k in range(4)}
    for name, text in texts.items():
        (tmp_path / f"{name}.diff").write_text(text, newline="")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        blocks = landed.read_diff_blocks(spark, str(tmp_path), 16)
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 8  # one file over many tasks
        joined = {}
        for r in blocks.orderBy("pr_id", "block").collect():
            joined.setdefault(r.pr_id, []).append(r.text)
        assert {k: "\n".join(v) for k, v in joined.items()} == texts
        table = spark.createDataFrame(list(texts.items()), "pr_id string, diff string")
        assert rows_of(segments.review_blocks(blocks, KEYS)) == rows_of(D.review_chunks(table, KEYS))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_empty_table(spark, diffs):
    blocks = segments.cut(diffs.limit(0), KEYS)
    assert segments.review_blocks(blocks, KEYS).isEmpty() and segments.parse_blocks(blocks, KEYS).isEmpty()
