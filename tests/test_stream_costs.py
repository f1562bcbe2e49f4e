from types import SimpleNamespace

import pandas as pd
from pyspark.sql import functions as F

from patchloom.checks import registry
from patchloom.streaming import answers


class State:
    def __init__(self, calls, name):
        self.calls, self.name, self.value = calls, name, None

    def exists(self):
        self.calls.append(("exists", self.name))
        return self.value is not None

    def get(self):
        return iter(self.value) if isinstance(self.value, list) else self.value

    def update(self, value):
        self.calls.append(("update", self.name))
        self.value = value

    def appendList(self, rows):
        self.calls.append(("append", self.name))
        self.value = [*(self.value or []), *rows]

    def clear(self):
        self.calls.append(("clear", self.name))
        self.value = None


class Handle:
    def __init__(self):
        self.calls = []

    def getListState(self, name, _):
        return State(self.calls, name)

    getValueState = getListState

    def registerTimer(self, at):
        self.calls.append(("timer", at))

    def deleteTimer(self, at):
        self.calls.append(("no timer", at))


def frame(*rows):
    columns = ["at", "asked_in", "n_files", "file_path", "status", "response_text"]
    return pd.DataFrame([(pd.Timestamp(2024, 1, 1), *r) for r in rows], columns=columns)


def handled(reviewer, *rows):
    timers = SimpleNamespace(getCurrentWatermarkInMs=lambda: 0)
    return [tuple(r) for out in reviewer.handleInputRows(("p", "s"), iter([frame(*rows)]), timers) for r in out.values.tolist()]


ASKS = [(3, 2, "a", None, None), (3, 2, "b", None, None)]
TEXTS = [(None, None, "b", "ok", "late"), (None, None, "a", "ok", None)]
CLOSED = [("p", "s", 3, "a", "ok", None), ("p", "s", 3, "b", "ok", "late")]


def test_a_review_that_ends_at_once_keeps_no_rows():
    reviewer = answers._Review(1000)
    reviewer.init(handle := Handle())
    assert handled(reviewer, *ASKS, *TEXTS) == CLOSED
    assert not [c for c in handle.calls if c[0] in ("append", "clear")] and reviewer.last.value == (3,)


def test_a_review_that_waits_ends_with_its_last_answer():
    reviewer = answers._Review(1000)
    reviewer.init(handle := Handle())
    assert handled(reviewer, TEXTS[0]) == [] and handled(reviewer, *ASKS) == []
    assert handled(reviewer, TEXTS[1]) == CLOSED
    assert reviewer.now.value is None and reviewer.asked.value is None and reviewer.answers.value is None
    assert handled(reviewer, *ASKS) == []  # a micro-batch of questions that was run again


def test_event_reviews_derive_their_tables_once(spark, monkeypatch):
    """However many micro-batches the events come in."""
    made = []

    def table(name, schema):
        def make(*_):
            made.append(name)
            return spark.createDataFrame([("n-1", "x")], schema)

        return make

    for name in ("pull_requests", "diffs", "pr_files", "commits", "file_contents"):
        monkeypatch.setattr(registry.X, name, table(name, "pr_id string, head_sha string"))
    payload = (
        '{"action": "opened", "pull_request": {"number": 1, "head": {"sha": "x"}},'
        ' "repository": {"name": "n", "owner": {"login": "o"}}}'
    )
    deliveries = spark.range(6).repartition(3).select(
        F.col("id").alias("delivery_id"), F.lit("pull_request").alias("event_type"), F.lit(payload).alias("payload")
    )
    monkeypatch.setattr(registry.X, "pr_events", lambda *_: deliveries)
    read = registry.reviews.read_events
    monkeypatch.setattr(registry.reviews, "read_events", lambda s, path, n: read(s, path, 1))
    monkeypatch.setattr(registry.review, "triage", lambda prs, diffs, *_: SimpleNamespace(triage_counts=diffs.select("pr_id", F.lit(1).alias("chunks"))))
    got = registry.t1_event_reviews(spark, "").collect()
    assert len(got) == 6 and {r.chunks for r in got} == {1}
    assert made.count("diffs") == made.count("pull_requests") == made.count("pr_files") == made.count("commits") == 1
