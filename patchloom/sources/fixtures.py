"""Input tables in the engine's schemas, derived row by row from the generic test tables.

Each PR is a bounded slice of its table (at most 20 documents, or the rows of 8 orders), and the
number of PRs grows with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patchloom.functions.text import let, lines_of, stem

#: code lines, each firing a signal or just missing it
CODE_LINES = [
    "import os",
    "import sys, json",
    "from pathlib import Path",
    "  import numpy as np",
    "from a.b import c",
    "import re",
    "from  typing  import Any",
    "importlib.reload(mod)",
    "def load_user(uid):",
    "  sql = f\"DELETE FROM carts WHERE owner = {who}\"",
    "\tcursor.execute('update t set a = 1')",
    "    DROP  the INDEX only",
    "shown = eval (template)",
    "medieval(x); evaluate(y)",
    "os.system('ls ' + path); subprocess.Popen(cmd)",
    "api_key = \"q7-zz-90817263\"",
    "token = 'abc'",
    "# TODO: remove this HACK",
    "debugger; TODOS = []",
    "// value is 100 or 101, 2.50 and 404 but not x12 or 33.7.99",
    "/* block */ total += count * 4096 ",
    "x = compute(a, b) */",
    "* bullet in a block comment",
    "if (user === null) { throw new Error('missing') }",
    "} else if (n != null) { return n } else if (m ?? k) { return m }",
    "elif value is None or other == None: return 0",
    "try: data = json.loads(open(name).read())",
    "except ValueError: raise",
    "items.forEach(i => console.log(i)).map(f).filter(g) . map(h)",
    "for (let i = 0; i < 99; i += 1) { while (ok) { do_it(); } }",
    "const handler = async (req, res) => fetch(url)",
    "const total = (a, b) => a + b",
    "public int size() { return fs.readFileSync(p); }",
    "class Foo(Bar): pass",
    "func main() { fmt.Println(\"x\") }",
    "switch (kind) { case 1: break; case 22: when (x) { return 7 } }",
    "                deep(nested(call(one, two(three(four(five(six(7))))))))",
    "++counter;",
    "-- drop legacy rows",
    "handler = function (e) { return parseInt(e.value) + Number (x) }",
    "long = '" + "z" * 130 + "'",
    "response = requests.get(url); curl_easy(httpx)",
    "y -= 3 ; z = 5 = 6 = 7",
]

#: directory by doc_id % 6, extension by doc_id % 9 (the last one is no code)
DIRECTORIES = ["src/core", "src/api", "lib", "tests", "mydist", "latest"]
EXTENSIONS = ["py", "js", "tsx", "java", "go", "rs", "c", "sql", "md"]

COMMIT_MESSAGES = {
    "error": ["Fix crash in parser", "Resolve overflow in counter", "Hotfix: wrong total\n\nadd test"],
    "signup": ["Add login form", "feat: new export", "Implement cache\n\nfix for later"],
    "purchase": ["Refactor billing", "Improve query speed", "clean up imports"],
    "click": ["Fix and improve menu", "add patch level", "Refactor broken layout"],
    "view": ["Update docs", "bump version", "prefix and suffix notes"],
}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def read_spread(spark: SparkSession, sf_dir: str, table: str, key: str) -> DataFrame:
    """For work that is heavy per byte: rows are dealt out by their key where a scan would leave them to a few tasks."""
    rows = read(spark, sf_dir, table)
    if _is_spread(rows):
        return rows
    return rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), key)


def _is_spread(rows: DataFrame) -> bool:
    """Whether a scan gives every core a task of its own with rows, none with over twice its share. No column is read for that."""
    held = [r.n for r in rows.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]  # one row per task
    return len(held) >= rows.sparkSession.sparkContext.defaultParallelism and max(held) * len(held) <= 2 * sum(held)


def _pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int") + 1)


def pr_of_doc(source: Column, doc: Column) -> Column:
    return F.concat(source, F.lit("-"), F.floor(doc / 400).cast("string"))


def path_of_doc(source: Column, doc: Column) -> Column:
    return F.concat_ws(
        "",
        _pick(DIRECTORIES, doc % 6), F.lit("/"), source, F.lit("/doc_"), doc.cast("string"),
        F.lit("."), _pick(EXTENSIONS, doc % 9),
    )


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("doc_id")
    count = F.lit(3) + doc % 12
    bank = F.transform(
        F.sequence(F.lit(0).cast("bigint"), count - 1),
        lambda k: _pick(CODE_LINES, (doc + k * (F.lit(1) + doc % 5)) % len(CODE_LINES)),
    )
    return read_spread(spark, sf_dir, "documents", "doc_id").select(
        "doc_id",
        pr_of_doc(F.col("source"), doc).alias("pr_id"),
        F.concat(F.lit("org/"), F.col("source")).alias("repo"),
        path_of_doc(F.col("source"), doc).alias("file_path"),
        F.col("text"),
        bank.alias("bank"),
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1: every document as one all-added chunk, with code lines from the bank at its end."""
    return _documents(spark, sf_dir).select(
        "pr_id", "repo",
        F.col("doc_id").alias("chunk_ord"),
        "file_path",
        F.lit(1).cast("bigint").alias("start_line"),
        (F.size(lines_of(F.col("text"))) + F.size("bank")).cast("bigint").alias("end_line"),
        F.concat(lines_of(F.col("text")), F.col("bank")).alias("added_lines"),
        F.array().cast("array<string>").alias("context_lines"),
        ((F.col("doc_id") % 100) / 100.0).alias("base_score"),
    )


def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1 as submitted code."""
    return _documents(spark, sf_dir).select(
        F.col("doc_id").cast("string").alias("snippet_id"),
        F.when(F.col("doc_id") % 10 != 0, F.col("file_path")).alias("filename"),
        F.concat_ws("\n", F.col("text"), F.concat_ws("\n", "bank")).alias("code"),
    )


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file section per document: hunks of 7 lines, or of 400 one-word lines for every eighth."""
    doc = F.col("doc_id")
    wordy = doc % 8 == 5
    hunk = F.when(wordy, 400).otherwise(7).cast("bigint")
    source = F.when(wordy, F.split("text", "[\n ]")).otherwise(lines_of(F.col("text")))
    lines = _documents(spark, sf_dir).select(
        "doc_id", "pr_id", "repo", "file_path",
        F.concat(source, F.col("bank")).alias("lines"),
        hunk.alias("per_hunk"),
    )
    marks = ["+", "+", "+", " ", "-"]
    marked = F.transform("lines", lambda text, k: F.concat(_pick(marks, k % 5), text))
    numbers = F.sequence(
        F.lit(0).cast("bigint"), F.floor((F.size("lines") - 1) / F.col("per_hunk")).cast("bigint")
    )

    def hunk_text(marked: Column, h: Column) -> Column:
        start = 1 + h * F.col("per_hunk") + F.floor((h + 1) / 2) * 2 + F.floor(h / 2) * 15
        header = F.concat(
            F.lit("@@ -"), start.cast("string"), F.lit(",7 +"), start.cast("string"),
            F.when(h % 3 != 0, F.lit(",7")).otherwise(F.lit("")), F.lit(" @@ part"),
        )
        body = F.slice(
            marked,
            (h * F.col("per_hunk") + 1).cast("int"), F.col("per_hunk").cast("int"),
        )
        detached = (doc % 10 == 7) & (h == F.floor((F.size("lines") - 1) / F.col("per_hunk")))
        return F.concat_ws(
            "\n",
            F.when(detached, F.lit("diff --git mode-only")),
            header,
            F.concat_ws("\n", body),
        )

    # bound by let, or the marks would be put on again for each hunk
    patch = F.concat(
        F.concat_ws("\n", let(marked, lambda m: F.transform(numbers, lambda h: hunk_text(m, h)))),
        F.when(doc % 3 == 0, F.lit("\n\\ No newline at end of file")).otherwise(F.lit("")),
    )
    return (
        lines.select(
            "doc_id", "pr_id", "repo", "file_path",
            patch.alias("patch"),
            F.concat_ws(
                "\n",
                F.concat(F.lit("diff --git a/"), F.col("file_path"), F.lit(" b/"), F.col("file_path")),
                F.when(doc % 4 == 1, F.lit("old mode 100644\nnew mode 100755")),
                F.lit("index 1111111..2222222 100644"),
                F.concat(F.lit("--- a/"), F.col("file_path")),
                F.concat(F.lit("+++ b/"), F.col("file_path")),
            ).alias("header"),
        )
    )


def diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2: one unified diff per PR; a PR has at most 20 documents."""
    part = F.struct("doc_id", F.concat_ws("\n", "header", "patch").alias("text"))
    whole = sections(spark, sf_dir).groupBy("pr_id", "repo").agg(
        F.concat(
            F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(part)), lambda s: s["text"])),
            F.lit("\n"),
        ).alias("diff")
    )
    empty = _drafts(spark, sf_dir).filter(F.col("draft") % 2 == 0)
    return whole.unionByName(empty.select("pr_id", "repo", F.lit("").alias("diff")))


def _drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRs without a diff, or with an empty one: one for each forty labelled documents."""
    draft = F.floor(F.col("doc_id") / 40)
    return read(spark, sf_dir, "labels").select(draft.alias("draft")).distinct().select(
        "draft",
        F.concat(F.lit("draft-"), F.col("draft").cast("string")).alias("pr_id"),
        F.lit("org/draft").alias("repo"),
    )


def pull_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4: PR list and metadata; some have no title, some no body, and drafts have neither."""
    number = F.col("pr_number")
    drafts = _drafts(spark, sf_dir).select(
        "pr_id", "repo", (-F.col("draft") - 1).alias("pr_number"),
        F.concat(F.lit("draft"), F.col("draft").cast("string")).alias("head_sha"),
        *[F.lit(None).cast("string").alias(c) for c in ("title", "body", "base_branch")],
    )
    return (
        read(spark, sf_dir, "documents")
        .groupBy(
            pr_of_doc(F.col("source"), F.col("doc_id")).alias("pr_id"),
            F.concat(F.lit("org/"), F.col("source")).alias("repo"),
        )
        .agg(F.min("doc_id").alias("pr_number"), F.min_by("text", "doc_id").alias("text"))
        .select(
            "pr_id", "repo", "pr_number",
            F.concat(F.lit("sha"), number.cast("string")).alias("head_sha"),
            F.when(number % 5 != 4, F.concat(F.lit("Change "), F.col("pr_id"))).alias("title"),
            F.when(number % 7 != 3, F.col("text")).alias("body"),
            F.when(number % 2 == 0, F.lit("main")).alias("base_branch"),
        )
        .unionByName(drafts)
    )


def pr_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4: changed files, with a test file beside every third one."""
    doc = F.col("doc_id")
    own = F.struct(
        (doc * 2).alias("file_ord"), F.col("file_path").alias("filename"),
        F.when(doc % 11 != 10, F.col("patch")).alias("patch"),
    )
    name = stem(F.col("file_path"))
    test_name = (
        F.when(doc % 9 == 0, F.concat(F.lit("tests/unit/test_"), name, F.lit(".py")))
        .when(doc % 9 == 3, F.concat(F.lit("tests/my_"), name, F.lit("_test.go")))
        .when(doc % 9 == 6, F.concat(F.lit("spec_"), name, F.lit("_more.js")))
    )
    test = F.struct(
        (doc * 2 + 1).alias("file_ord"), test_name.alias("filename"),
        F.lit(None).cast("string").alias("patch"),
    )
    return (
        sections(spark, sf_dir)
        .select("pr_id", F.explode(F.array(own, test)).alias("f"))
        .select("pr_id", "f.file_ord", "f.filename", "f.patch")
        .filter(F.col("filename").isNotNull())
    )


def file_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4: file bodies at the head commit, base64; every tenth claims to be too large."""
    doc = F.col("doc_id")
    body = F.concat_ws("\n", "text", F.concat_ws("\n", "bank")).cast("binary")
    return _documents(spark, sf_dir).select(
        "pr_id", "repo",
        F.col("file_path").alias("path"),
        F.when(doc % 10 == 9, F.lit(100001)).otherwise(F.lit(100000)).cast("bigint").alias("size"),
        F.when(doc % 13 == 12, F.lit("*not base64*")).otherwise(F.base64(body)).alias("content_b64"),
    )


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3: every event as one commit touching one document's file."""
    event = F.col("event_id")
    tens = F.floor(event / 10)
    doc = F.when(event % 2 == 0, tens).otherwise(tens - tens % 10)
    source = F.concat(F.lit("src"), (doc % 20).cast("string"))
    message = F.lit(None).cast("string")
    for kind, texts in COMMIT_MESSAGES.items():
        message = F.when(F.col("event_type") == kind, _pick(texts, event % 3)).otherwise(message)
    return read_spread(spark, sf_dir, "events", "event_id").select(
        F.concat(F.lit("org/"), source).alias("repo"),
        path_of_doc(source, doc).alias("file_path"),
        F.col("ts").alias("committed_at"),
        event.cast("string").alias("sha"),
        message.alias("message"),
    )


def commit_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3: the diff of each commit, from the code-line bank; some are missing or empty."""
    event = F.col("event_id")
    count = F.lit(1) + event % 29
    tens = F.floor(event / 10)
    doc = F.when(event % 2 == 0, tens).otherwise(tens - tens % 10)
    path = path_of_doc(F.concat(F.lit("src"), (doc % 20).cast("string")), doc)
    line = F.transform(
        F.sequence(F.lit(0).cast("bigint"), count - 1),
        lambda k: F.concat(F.lit("+"), _pick(CODE_LINES, (event * 7 + k * 3) % len(CODE_LINES))),
    )
    diff = F.concat_ws(
        "\n",
        F.concat(F.lit("diff --git a/"), path, F.lit(" b/"), path),
        F.concat(F.lit("@@ -0,0 +1,"), count.cast("string"), F.lit(" @@")),
        F.concat_ws("\n", line),
    )
    present = F.when(event % 23 == 0, F.lit(None)).when(event % 23 == 1, F.lit("")).otherwise(diff)
    # the outer form keeps a filter of the diffs from building them a second time, and before the rows are dealt out
    return read_spread(spark, sf_dir, "events", "event_id").select(
        event.cast("string").alias("sha"), F.explode_outer(F.array(present)).alias("diff")
    )


_REVIEW_TYPES = ["bug", "security", "performance", "style", "naming"]


def _order_file() -> Column:
    return F.concat_ws(
        "", F.lit("svc/o"), F.col("l_orderkey").cast("string"), F.lit("/m"),
        F.col("l_linenumber").cast("string"), F.lit("_"), F.col("l_partkey").cast("string"),
        F.lit("_"), F.col("l_suppkey").cast("string"), F.lit("_"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string"), F.lit(".py"),
    )


def _reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_spread(spark, sf_dir, "lineitem", "l_orderkey").select(
        F.concat(F.lit("pr-"), F.floor(F.col("l_orderkey") / 8).cast("string")).alias("pr_id"),
        _order_file().alias("file_path"),
        F.col("l_linenumber").cast("bigint").alias("n"),
        F.col("l_partkey").alias("p"),
        F.col("l_suppkey").alias("s"),
        F.col("l_quantity").cast("bigint").alias("q"),
        F.col("l_discount").alias("l_discount"),
        F.col("l_orderkey").alias("o"),
        F.col("l_returnflag").alias("flag"),
        F.col("l_linestatus").alias("status"),
    )


def reviewed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V5: the chunks of one file per line item: one of three to four lines, some with a second."""
    n, p, s, q = (F.col(c) for c in "npsq")
    size = len(CODE_LINES)
    first = F.array(
        _pick(CODE_LINES, p % size),
        F.concat(F.lit("  qty = "), q.cast("string"), F.lit("; part_"), p.cast("string"), F.lit("()")),
        _pick(CODE_LINES, s % size),
    )
    second = F.array(
        F.lit("tail_start()"),
        F.concat(F.lit("tail_"), s.cast("string"), F.lit("(qty = "), q.cast("string"), F.lit(")")),
    )
    base = _reviewed(spark, sf_dir)
    rows = F.array_compact(F.array(
        F.struct(
            (n * 10).alias("chunk_ord"), (n * 10).alias("start_line"), first.alias("added_lines"),
            F.when((p + s) % 4 == 0, 0.3).otherwise(0.8).alias("score"),
        ),
        F.when(n % 2 == 0, F.struct(
            (n * 10 + 1).alias("chunk_ord"), F.lit(200).cast("bigint").alias("start_line"),
            second.alias("added_lines"), F.when((p + s) % 8 == 0, 0.3).otherwise(0.8).alias("score"),
        )),
    ))
    return base.select("pr_id", "file_path", F.explode(rows).alias("c")).select(
        "pr_id", "file_path", "c.chunk_ord", "c.start_line",
        (F.col("c.start_line") + F.size("c.added_lines") - 1).alias("end_line"),
        "c.added_lines",
        F.array().cast("array<string>").alias("context_lines"),
        "c.score",
    )


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V5: the reviewer's answer for each of those files, in every shape an answer can take."""
    n, p, s, q, d = (F.col(c) for c in ["n", "p", "s", "q", "l_discount"])
    kind = _pick(_REVIEW_TYPES, (p + n) % 5)
    severity = _pick(["high", "medium", "low"], s % 3)
    content = (
        F.when(s % 5 == 0, F.concat(F.lit("   qty = "), q.cast("string"), F.lit("; part_"), p.cast("string"), F.lit("()  ")))
        .when(s % 5 == 1, F.lit("qty = "))
        .when(s % 5 == 2, F.concat(F.lit("tail_"), s.cast("string")))
        .when(s % 5 == 3, F.lit("zzz missing line"))
        .otherwise(F.lit(""))
    )
    message = F.concat(
        F.lit("Check the handling of "), F.col("flag"), F.col("status"),
        F.lit(" because the value may be out of its range here"),
        F.when(p % 3 == 0, F.concat(F.lit(" for part "), p.cast("string"))).otherwise(F.lit("")),
    )
    fields = _reviewed(spark, sf_dir).select(
        "pr_id", "file_path",
        ((p + s + n) % 11).alias("form"),
        kind.alias("type"), severity.alias("severity"), content.alias("line_content"),
        message.alias("message"),
        F.when(p % 2 == 0, F.lit("guard(\"value\")")).alias("suggestion"),
        F.round(d * 10, 1).alias("confidence"),
        _pick(CODE_LINES, p % len(CODE_LINES)).alias("second_content"),
    )
    form = F.col("form")
    full = ["type", "severity", "line_content", "message", "suggestion"]
    entries = fields.select(
        "pr_id", "file_path", "form",
        F.to_json(F.struct(*full, "confidence")).alias("head"),
        F.to_json(F.struct(*full, F.col("confidence").cast("string").alias("confidence"))).alias("quoted"),
        F.to_json(F.struct(
            F.lit("Second look").alias("message"), F.col("second_content").alias("line_content"),
        )).alias("bare"),
    )
    # each step is a column of its own, so that none is written out many times in the plan
    items = (
        F.when(form == 3, F.col("quoted"))
        .when(form == 4, F.regexp_replace("head", r'"confidence":[0-9.]+', '"confidence":null'))
        .when(form == 5, F.concat(F.col("head"), F.lit(',"not an object"')))
        .otherwise(F.concat(F.col("head"), F.lit(", "), F.col("bare")))
    )
    plain = F.col("plain")
    text = (
        F.when(form == 1, F.concat(F.lit("```json\n"), plain, F.lit("\n```")))
        .when(form == 2, F.concat(F.lit("Here is what I found: "), plain, F.lit(" Regards.")))
        .when(form == 6, F.concat(plain, F.lit(" }{")))
        .when(form == 7, F.lit('{"findings": []}'))
        .when(form == 8, F.lit('["findings"]'))
        .when(form == 10, F.concat(F.lit("  \n"), plain, F.lit("\n\n")))
        .otherwise(plain)
    )
    return entries.withColumn(
        "plain", F.concat(F.lit('{"findings": ['), items, F.lit("]}"))
    ).select(
        "pr_id", "file_path",
        F.when(form == 9, F.lit("timeout")).otherwise(F.lit("ok")).alias("status"),
        F.when(form != 9, text).alias("response_text"),
    )


def reviewed_prs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V5: the PR list of those answers, and one PR without chunks or without a diff per customer."""
    empty = read(spark, sf_dir, "customer").select(
        F.concat(F.lit("cust-"), F.col("c_custkey").cast("string")).alias("pr_id"),
        F.when(F.col("c_custkey") % 2 == 0, F.lit("error")).otherwise(F.lit("ok")).alias("status"),
    )
    reviewed = read(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("pr-"), F.floor(F.col("l_orderkey") / 8).cast("string")).alias("pr_id"),
        F.lit("ok").alias("status"),
    )
    return reviewed.distinct().unionByName(empty)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V7: events as calls of a client."""
    return read(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("client"), "ts", F.col("event_id").alias("request_id")
    )


def pr_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V7: events as webhook deliveries: an event type beside a JSON payload."""
    e = F.col("event_id")
    payload = F.to_json(F.struct(
        _pick(["opened", "synchronize", "reopened", "closed", "labeled"], e % 5).alias("action"),
        F.struct(
            F.when(e % 7 == 3, 0).otherwise(e % 400).alias("number"),
            F.struct(F.when(e % 11 == 5, F.lit("")).otherwise(F.concat(F.lit("sha"), e.cast("string"))).alias("sha")).alias("head"),
        ).alias("pull_request"),
        F.struct(
            F.struct(F.when(e % 13 != 6, F.lit("org")).alias("login")).alias("owner"),
            F.concat(F.lit("src"), (e % 20).cast("string")).alias("name"),
        ).alias("repository"),
    ))
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("delivery_id"),
        F.when(F.col("event_type") == "view", F.lit("push")).otherwise(F.lit("pull_request")).alias("event_type"),
        payload.alias("payload"),
    )
