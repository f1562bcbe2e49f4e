import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from patchloom.functions.constants import SEED_REPOS, VECTOR_COLUMNS
from patchloom.operators import training
from patchloom.plans import collect
from patchloom.sources import fixtures, landed, recent, sinks

COMMIT = "repo string, file_path string, committed_at timestamp, sha string, message string"


def test_labels(spark):
    cases = {
        "Fix crash": "bugfix", "feat: add x": "clean", "fix and add": "skip", "docs": "skip",
        "NPE in run": "bugfix", "off-by-one": "bugfix", "prefix addon": "skip", "docs\n\nfix": "skip",
        "Race Condition": "bugfix", "refactor\nbug": "clean",
    }
    df = spark.createDataFrame([(m,) for m in cases], "message string")
    got = df.select("message", training.commit_label().alias("kind")).collect()
    assert {r.message: r.kind for r in got} == cases


def tables(spark, commits_per_repo=30):
    start, log, diffs = datetime(2024, 1, 1), [], []
    for repo in ("r1", "r2"):
        for i in range(commits_per_repo):
            sha = f"{repo}-{i:03d}"
            log.append((repo, "a.py", start + timedelta(hours=i), sha, "fix it" if i % 2 else "add it"))
            body = "\n".join(f"+line {k}" for k in range(2 + i % 4))
            far = f"@@ -1 +{100 + i} @@\n+a = 1\n+b\n+c" if i % 3 == 0 else ""
            diffs.append((sha, f"diff --git a/a.py b/a.py\n@@ -1 +1 @@\n{body}\n{far}" if i % 10 else ""))
    return spark.createDataFrame(log, COMMIT), spark.createDataFrame(diffs, "sha string, diff string")


def test_cap_keeps_the_commit_that_reaches_it(spark):
    commits, diffs = tables(spark)
    every = training.commit_samples(landed.crawled_commits(commits), diffs)
    kept = collect.collected_samples(commits, diffs, cap=4)
    counts = {(r.repo, r.sha): r.n for r in every.groupBy("repo", "sha").agg(F.count("*").alias("n")).collect()}
    want = set()
    for repo in ("r1", "r2"):
        total = 0
        for key in sorted((k for k in counts if k[0] == repo), reverse=True):
            if total >= 8:
                break
            total += counts[key]
            want.add(key)
    assert {(r.repo, r.sha) for r in kept.collect()} == want
    assert max(counts.values()) == 2


def test_diffs_behind_the_cap_are_not_parsed(spark):
    """r1 has enough after its first page and r2 after its second; a third repository never has, and is read to its end."""
    start, log, diffs = datetime(2024, 1, 1), [], []
    for repo, chunks in (("r1", 2), ("r2", 1), ("r3", 0)):
        for i in range(23):
            sha = f"{repo}-{i:03d}"
            log.append((repo, "a.py", start - timedelta(hours=i), sha, "fix it"))
            hunks = [f"@@ -1 +{k * 100 + 1} @@\n+a = 1\n+b\n+c" for k in range(chunks)] or ["@@ -1 +1 @@\n+short"]
            diffs.append((sha, "diff --git a/a.py b/a.py\n" + "\n".join(hunks)))
    commits, table = spark.createDataFrame(log, COMMIT), spark.createDataFrame(diffs, "sha string, diff string")
    parsed: list[int] = []
    kept = collect.collected_samples(commits, table, cap=4, pages=4, page_commits=5, parsed=parsed)
    assert parsed == [15, 10, 5, 5]
    counts = {r.repo: r["count"] for r in kept.groupBy("repo").count().collect()}
    assert counts == {"r1": 8, "r2": 8}  # the fourth commit of r1 reaches it
    done: list[int] = []
    collect.collected_samples(commits.filter("repo = 'r1'"), table, cap=4, pages=4, page_commits=5, parsed=done)
    assert done == [5]


def test_no_commits(spark):
    commits, diffs = tables(spark)
    assert collect.collected_samples(commits.limit(0), diffs).isEmpty()


def test_crawl_and_sample(spark):
    commits, _ = tables(spark)
    assert landed.crawled_commits(commits, 10).count() == 20
    picked = [r.repo for r in landed.sampled_repos(landed.seed_repos(spark), 7, 1).collect()]
    assert len(picked) == 7 and set(picked) <= set(SEED_REPOS)
    assert picked == [r.repo for r in landed.sampled_repos(landed.seed_repos(spark), 7, 1).collect()]
    assert landed.sampled_repos(landed.seed_repos(spark), 99).count() == 20
    many = spark.range(60).selectExpr("concat('r', id) AS repo")
    assert landed.sampled_repos(many, 40).count() == 40


def labelled(spark, count=400):
    rng = random.Random(2)
    rows = []
    for i in range(count):
        label = rng.random() < 0.5
        vector = [float(rng.random()) for _ in VECTOR_COLUMNS]
        vector[3] += 2.0 if label else 0.0
        rows.append((str(i), *vector, int(label)))
    schema = "key string, " + ", ".join(f"{c} double" for c in VECTOR_COLUMNS) + ", label int"
    return spark.createDataFrame(rows, schema)


def test_split_is_stable_and_whole(spark):
    rows = labelled(spark)
    first = training.with_split(rows, F.col("key"))
    again = training.with_split(rows.repartition(3), F.col("key"))
    sizes = {r.split: r.n for r in first.groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert sum(sizes.values()) == 400 and 280 < sizes["train"] < 360 and set(sizes) == {"train", "val", "test"}
    assert {(r.key, r.split) for r in first.collect()} == {(r.key, r.split) for r in again.collect()}


def test_evaluation(spark):
    rows = [(0.9, 1), (0.8, 0), (0.5, 1), (0.1, 0), (0.7, 1)]
    scores = training.evaluate(spark.createDataFrame(rows, "probability_1 double, label int")).first()
    assert (scores.tp, scores.fp, scores.tn, scores.fn) == (2, 1, 1, 1)
    assert scores.accuracy == 0.6 and abs(scores.f1 - 2 / 3) < 1e-12
    none = training.evaluate(spark.createDataFrame([(0.1, 0)], "probability_1 double, label int")).first()
    assert (none.precision, none.recall, none.f1) == (0.0, 0.0, 0.0)


def test_train_save_load(spark, tmp_path):
    rows = training.with_split(labelled(spark), F.col("key"))
    model, scores = training.train(rows, rounds=3, patience=2, steps=10, layers=[27, 8, 2])
    assert scores["val_f1"] > 0.9
    sinks.save_model(spark, model, scores, str(tmp_path / "m"))
    loaded = sinks.load_model(str(tmp_path / "m"))
    a = training.evaluate_split(model, rows).first()
    assert a == training.evaluate_split(loaded, rows).first() and a.f1 > 0.85
    assert sinks.load_model(str(tmp_path / "none")) is None


def test_csv_round_trip(spark, tmp_path):
    rows = labelled(spark, 20)
    sinks.write_training_csv(rows, str(tmp_path / "c"))
    back = landed.read_training_csv(spark, str(tmp_path / "c"))
    assert back.columns == [*VECTOR_COLUMNS, "label"] and back.count() == 20
    assert back.agg(F.sum("label")).first()[0] == rows.agg(F.sum("label")).first()[0]


def test_exact_split_sizes(spark, monkeypatch):
    for n, digits in ((0, 4), (1, 4), (9, 1), (10, 4), (257, 1), (1000, 2)):
        monkeypatch.setattr(training, "CUT_DIGITS", digits)
        rows = spark.range(n).select(F.col("id").cast("string").alias("key"))
        by = {r.key: r.split for r in training.with_exact_split(rows.repartition(3), F.col("key")).collect()}
        counts = [list(by.values()).count(s) for s in ("train", "val", "test")]
        assert counts == [int(0.8 * n), int(0.1 * n), n - int(0.8 * n) - int(0.1 * n)]
        assert by == {r.key: r.split for r in training.with_exact_split(rows.coalesce(1), F.col("key")).collect()}


def test_exact_split_keeps_keys_together(spark):
    rows = spark.range(400).select((F.col("id") % 10).cast("string").alias("key"))
    split = training.with_exact_split(rows, F.col("key"))
    assert split.groupBy("key").agg(F.count_distinct("split").alias("n")).filter("n > 1").isEmpty()


def test_positions(spark, tmp_path):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("v"), (F.col("id") % 3).alias("w"))
    placed = training.with_positions(rows.repartition(5), F.col("w").desc(), F.col("v"))
    placed.write.parquet(str(tmp_path / "p"))
    got = sorted((r.position, -r.w, r.v) for r in spark.read.parquet(str(tmp_path / "p")).collect())
    assert [p for p, _, _ in got] == list(range(1000)) and [g[1:] for g in got] == sorted(g[1:] for g in got)
    plan = placed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window ") == 1 and "_range" in plan.split("Window ")[1]
    assert training.with_positions(rows.limit(0), F.col("v")).isEmpty()


def test_recent_commits_by_increments(spark, tmp_path):
    """After every increment as a full run has them; an increment writes the buckets of its files and no others."""
    rng, start, path = random.Random(1), datetime(2024, 1, 1), str(tmp_path / "recent")
    log = [(f"r{rng.randrange(3)}", f"f{rng.randrange(8)}.py", start + timedelta(hours=rng.randrange(300)), f"c{k}", "m") for k in range(400)]
    done = []
    for batch, part in enumerate((log[:150], log[150:152], log[152:], log[152:])):
        recent.update(spark.createDataFrame(part, COMMIT), path, batch, buckets=16, limit=5)
        done += [r for r in part if r not in done]
        full = landed.recent_commits(spark.createDataFrame(done, COMMIT), 5).drop("place")
        columns = ["repo", "file_path", "sha", "committed_at"]
        assert sorted(recent.read(spark, path).select(columns).collect()) == sorted(full.select(columns).collect())
    touched = spark.read.parquet(f"{path}/recent").filter("commit_batch = 1").select("bucket").distinct().count()
    assert touched == len({(r, f) for r, f, *_ in log[150:152]})


def test_labels_and_diffs_are_worked_out_once_and_where_the_rows_were_dealt_out(spark, tmp_path):
    rows = [(e, kind, f"2024-01-01 00:00:{e % 60:02d}") for e, kind in enumerate(["error", "signup", "click", "view"] * 10)]
    events = spark.createDataFrame(rows, "event_id bigint, event_type string, ts string")
    events.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    sf = str(tmp_path)
    labelled = training.labelled_commits(fixtures.commits(spark, sf)).select("sha", "label")
    joined = landed.commits_with_diffs(labelled, fixtures.commit_diffs(spark, sf))
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE(") == 3  # fixes, and features in either branch; the filter repeats none
    assert plan.count("diff --git") == 1
    below = plan[plan.index("RepartitionByExpression"):]
    assert "RLIKE(" not in below.split("Generate")[0]
    assert joined.count() == len([e for e in range(40) if e % 4 < 2 and e % 23 > 1])
