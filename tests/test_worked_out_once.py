"""What prompts store, what a trained model's scores work out, and what the states of streams are asked."""

from types import SimpleNamespace

from test_read_once import _documents, _plan
from test_stream_costs import ASKS, TEXTS, Handle, handled

from pyspark.sql import Row
from pyspark.sql import functions as F

from patchloom.checks import registry
from patchloom.streaming import admission, answers


def test_prompts_store_chunks_and_scores_without_their_patches(spark, tmp_path, monkeypatch):
    sf, stored, write = _documents(spark, tmp_path), [], registry.materialize
    longer = [(d, "\n".join(f"x{k} = call({k})" for k in range(120)), "en", "src0", 30) for d in range(5)]  # chunks far down have a high score
    spark.createDataFrame(longer, "doc_id long, text string, lang string, source string, n_chars long").write.mode("overwrite").parquet(f"{sf}/documents.parquet")
    monkeypatch.setattr(registry, "materialize", lambda df, *a: stored.append(df.columns) or write(df, *a))
    prompts = registry.c6_review_prompts(spark, sf)
    assert len(stored) == 2 and not [c for columns in stored for c in columns if c in ("raw_patch", "route", "chunks")]
    got = sorted(map(str, prompts.collect()))
    assert got and got == sorted(map(str, registry._job(spark, sf).prompts.collect()))


def test_scores_and_training_share_their_features(spark, tmp_path, monkeypatch):
    seen = []
    monkeypatch.setattr(registry.training, "train", lambda rows: seen.append(rows) or (None, {}))
    scored = registry.r1_model_scores(spark, _documents(spark, tmp_path))
    assert "regexp" not in _plan(seen[0]) and "regexp" not in _plan(scored)
    want = registry._training_rows(spark, str(tmp_path))
    assert seen[0].columns == want.columns and sorted(map(str, seen[0].collect())) == sorted(map(str, want.collect()))
    assert scored.select(F.col("scored")).first()[0] == 12


def test_a_review_keeps_an_entry_per_batch():
    reviewer = answers._Review(1000)
    reviewer.init(Handle())
    handled(reviewer, *ASKS)
    assert handled(reviewer, TEXTS[0], TEXTS[0]) == []
    assert reviewer.asked.value == [(["a", "b"],)] and len(reviewer.answers.value) == 1


def test_a_review_from_rows_closes_alike():
    reviewer = answers._RowReview(1000)
    reviewer.init(Handle())
    timers = SimpleNamespace(getCurrentWatermarkInMs=lambda: 0)
    rows = [Row(pr_id="p", head_sha="s", at=None, micros=5, asked_in=a, n_files=n, file_path=f, status=s, response_text=t) for a, n, f, s, t in [*ASKS, *TEXTS]]
    closed = list(reviewer.handleInputRows(("p", "s"), iter(rows), timers))
    assert [tuple(r) for r in closed] == [("p", "s", 3, "a", "ok", None), ("p", "s", 3, "b", "ok", "late")]
    assert closed[0].file_path == "a" and list(reviewer.handleInputRows(("p", "s"), iter(()), timers)) == []


class Held(dict):
    """A map state, a value state."""

    def __init__(self):
        self.calls, self.value = 0, None

    def exists(self):
        return bool(len(self)) or self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def updateValue(self, key, value):
        self.calls += 1
        self[key] = value

    def getValue(self, key):
        return self[key]

    removeKey = dict.pop

    def clear(self):
        dict.clear(self)
        self.value = None


def test_admission_has_a_timer_per_client_and_packs_sparse_requests():
    timers: list[int] = []
    handle = SimpleNamespace(getMapState=lambda *_: Held(), getValueState=lambda *_: Held(), registerTimer=timers.append)
    client = admission._Admission(160, 2)  # stretches of ten seconds
    client.init(handle)
    at = lambda ms: SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)
    rows = [("c", None, k * 10_000_000 + 1, k) for k in range(20)] + [("c", None, 30_000_002 + k, 100 + k) for k in range(admission.PACK)]
    assert list(client.handleInputRows(("c",), iter(rows), at(0))) == []
    assert timers == [10_000] and client.waiting.calls == 2  # the full stretch alone
    first = list(client.handleExpiredTimer(("c",), at(45_000), None))
    assert [r.request_id for r in first] == [0, 1, 2, 3, *range(100, 100 + admission.PACK)]
    assert [r.request_id for r in first if r.admitted] == [0, 1] and 50_000 in timers
    rest = list(client.handleExpiredTimer(("c",), at(10_000_000), None))
    assert [r.request_id for r in rest] == list(range(4, 20)) and not client.waiting
    assert [r.request_id for r in rest if r.admitted] == [16, 17]
