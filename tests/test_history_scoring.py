import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from patchloom.functions import constants as C
from patchloom.operators import context, history, scoring
from patchloom.sources import landed


def test_coverage_equals_looking_at_every_pair(spark):
    rng = random.Random(5)
    names = ["a", "ab", "test_a", "a_test", "spec_", "", "test", "b.c", "_test", "é"]

    def path():
        parts = ["".join(rng.choices(names + ["test_", "spec_", "_test", "/", "."], k=rng.randint(1, 4))) for _ in range(2)]
        return "/".join(parts)

    files = {(f"p{i % 5}", path()) for i in range(150)}
    changed = {(f"p{i % 5}", path()) for i in range(120)}
    got = history.covered_files(
        spark.createDataFrame(sorted(files), "pr_id string, file_path string"),
        spark.createDataFrame(sorted(changed), "pr_id string, filename string"),
    ).collect()

    def covered(pr, file):
        name = file.split("/")[-1]
        stem = name[: name.rindex(".")] if "." in name else name
        marks = (f"test_{stem}", f"{stem}_test", f"spec_{stem}")
        return any(m in p for q, p in changed if q == pr for m in marks)

    want = {f for f in files if covered(*f)}
    assert {tuple(r) for r in got} == want and 0 < len(want) < len(files)


def commits(spark, messages, path="a.py"):
    start = datetime(2024, 1, 1)
    rows = [("r", path, start + timedelta(hours=i), f"s{i}", m) for i, m in enumerate(messages)]
    return spark.createDataFrame(rows, "repo string, file_path string, committed_at timestamp, sha string, message string")


def test_history_risk(spark):
    risk = history.commit_history_risk(commits(spark, ["fix null", "Fix login bug", "fix regression", "add it", "prefix"]))
    assert risk.first().commit_history_risk == 0.6
    old = ["a bug"] * 10 + ["docs"] * 20
    assert history.commit_history_risk(commits(spark, old)).first().commit_history_risk == 0.0


def test_history_budget(spark):
    chunks = spark.createDataFrame([("p", f"f{i}.py", i) for i in range(7)], "pr_id string, file_path string, chunk_ord bigint")
    prs = spark.createDataFrame([("p", "r")], "pr_id string, repo string")
    log = commits(spark, ["fix"], "f1.py").union(commits(spark, ["fix"], "f6.py"))
    got = history.budgeted_history(chunks, prs, log).collect()
    assert [(r.file_path, r.commit_history_risk) for r in got] == [("f1.py", 1.0)]


def test_top_n_is_cut_before_the_shuffle(spark):
    plan = landed.recent_commits(commits(spark, ["x"]))._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def enriched(spark, **values):
    defaults = {
        "base_score": 0.5, "commit_history_risk": 0.0, "has_test_coverage": True, "cross_function_calls": 0,
        "import_complexity": 0, "error_handling_ratio": 1.0, "has_eval_exec": False, "has_sql_string": False,
        "has_hardcoded_secret": False, "has_shell_command": False, "cyclomatic_estimate": 1, "num_added_lines": 5,
    }
    return spark.createDataFrame([{**defaults, **values}])


def test_adjustments(spark):
    def score(**values):
        row = scoring.with_adjusted_score(enriched(spark, **values)).first()
        return row.score, row.risk_label, row.is_high

    assert score() == (0.5, "low", False)
    assert score(commit_history_risk=0.51) == (0.6, "medium", True)
    assert score(commit_history_risk=0.5) == (0.5, "low", False)
    assert score(has_test_coverage=False, cross_function_calls=6, error_handling_ratio=0.0) == (0.6, "medium", True)
    assert score(import_complexity=6, base_score=0.98) == (1.0, "high", True)
    assert score(base_score=0.7) == (0.7, "high", True)


def test_fallback(spark):
    row = scoring.with_base_score(spark.range(1), None).first()
    assert (row.base_score, row.base_label) == (0.7, "medium")


def test_focus_areas(spark):
    def areas(**values):
        return scoring.with_focus_areas(enriched(spark, **values)).first().focus_areas

    assert areas() == []
    assert areas(has_eval_exec=True, has_shell_command=True, has_test_coverage=False) == [
        C.FOCUS_EVAL, C.FOCUS_SHELL, C.FOCUS_NO_TEST,
    ]
    assert areas(cyclomatic_estimate=9, commit_history_risk=0.625, cross_function_calls=9) == [
        "many paths through the code (about 9)", "62% of its recent commits were fixes", "leans on 9 functions from elsewhere",
    ]


def test_routes_and_prompt(spark):
    rows = [("p", 0, "small.py", 1, 2, ["a", "b"], []), ("p", 1, "fit.py", 5, 6, ["c = 1", "d"], ["k"] * 7),
            ("p", 2, "fit.py", 40, 40, ["e"], []), ("p", 3, "big.py", 9, 510, ["x"] * 501, [])]
    chunks = spark.createDataFrame(rows, "pr_id string, chunk_ord bigint, file_path string, start_line bigint, end_line bigint, added_lines array<string>, context_lines array<string>")
    routes = context.file_routes(chunks)
    assert {r.file_path: (r.route, r.added) for r in routes.collect()} == {
        "small.py": ("drop", 2), "fit.py": ("prompt", 3), "big.py": ("oversize", 501),
    }
    files = context.reviewed_files(chunks, routes)
    about = spark.createDataFrame([("p", "Title", "b" * 450, "", "b" * 400)], "pr_id string, title string, body string, changed_files_summary string, shown_body string")
    lists = spark.createDataFrame([("p", "fit.py", "def a():")], "pr_id string, file_path string, signatures string")
    focus = spark.createDataFrame([], "pr_id string, file_path string, focus_areas array<string>")
    row = context.prompts(files, about, lists, focus).first()
    assert row.file_path == "fit.py" and row.chunks == 2
    assert row.prompt.count("    k\n") == 5 and "Lines 5 to 6" in row.prompt and "\n---\nLines 40 to 40" in row.prompt
    assert "Look closely" not in row.prompt and row.prompt.count("b" * 400) == 1


def test_signatures(spark):
    text = "import os\n\ndef foo(x):\n    pass\nclass Bar:\n  def m(self): pass\nexport async function go(a) {\nconst f = async (x) => x\npublic List<int> size (\nfunc main() {\n"
    df = spark.createDataFrame([(text,), ("",)], "content string")
    rows = [r[0] for r in df.select(context.signatures(F.col("content"))).collect()]
    assert rows == ["def foo(x):\nclass Bar:\ndef m(self):\nexport async function go\nconst f = async (x) =>\npublic List<int> size (\nfunc main() {", ""]


def test_file_content(spark):
    import base64
    rows = [("a", 10, base64.b64encode("né\n".encode()).decode()), ("b", 100001, "YQ=="), ("c", 1, "***"),
            ("d", 3, "YW\nJj"), ("e", 3, base64.b64encode(b"a\xff\xe2\x82b").decode())]
    df = spark.createDataFrame(rows, "path string, size bigint, content_b64 string")
    got = {r.path: r.content for r in landed.file_content(df, ["path"]).collect()}
    assert got == {"a": "né\n", "b": "", "c": "", "d": "abc", "e": b"a\xff\xe2\x82b".decode("utf-8", "replace")}
