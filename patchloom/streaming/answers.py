"""The second half of the event stream: from the answers of the outside reviewer to comments and reports.

`asking_stream` triages the pull requests of each micro-batch of events, stores what their conclusion will need, and lists the files
that were sent out. `closed_reviews` follows these lists and the answers together: per pull request and head commit it keeps what was
asked and what has come back, and lets the review go when every file is answered or, by a timer on event time, when its time
is up; silent files then count as timed out. `report_stream` concludes the reviews that a micro-batch let go and commits their
comments, summaries and reports.

An event that comes again while its review is open is answered by that review; after that it opens another. Of several answers for a file the
earliest counts; answers for files that were not asked for, or that come after the end, are dropped.
"""

from __future__ import annotations

import contextlib
import itertools
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from patchloom.operators.events import accepted_events, classified_events
from patchloom.plans import review
from patchloom.session import materialize
from patchloom.sources import batches

ASKED = (
    "pr_id string, head_sha string, at timestamp, asked_in bigint, n_files bigint, file_path string"
)
ANSWERS = "pr_id string, head_sha string, at timestamp, file_path string, status string, response_text string"
CLOSED = "pr_id string, head_sha string, asked_in bigint, file_path string, status string, response_text string"
#: The setting of the state store, and the store that timers and lists need.
STORE_SETTING = "spark.sql.streaming.stateStore.providerClass"
LIST_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
KEY = ["pr_id", "head_sha"]
_CLOSED_COLUMNS = [*KEY, "asked_in", "file_path", "status", "response_text"]
_CLOSED_ROW = Row(*_CLOSED_COLUMNS)
_NO_TIME = -(1 << 63)
_STORED = ("prs", "triage_counts", "routes", "files", "prompts")


@contextlib.contextmanager
def list_store(spark: SparkSession) -> Iterator[None]:
    """Streams that are started inside keep lists and timers in their state."""
    before = spark.conf.get(STORE_SETTING, None)
    spark.conf.set(STORE_SETTING, LIST_STORE)
    try:
        yield
    finally:
        spark.conf.unset(STORE_SETTING) if before is None else spark.conf.set(STORE_SETTING, before)


# ---------------------------------------------------------------- events to questions


def asking_stream(
    events: DataFrame, triage: Callable[[DataFrame], review.Triage], pr_id: Callable[[], Column] | None, store: str, checkpoint: str, **trigger
) -> StreamingQuery:
    """Triage the accepted events of each micro-batch. `events` has `at` beside the delivery; `triage` gets the pr_ids.

    Each micro-batch owns a folder of every table, so one that is run again replaces its own. The list of what was
    asked is written last: whoever sees it finds the rest.
    """
    name = pr_id or (lambda: F.concat_ws("-", "owner", "repo_name", F.col("pr_number").cast("string")))

    def run(batch: DataFrame, batch_id: int) -> None:
        accepted = accepted_events(classified_events(batch)).withColumn("pr_id", name())
        wanted = materialize(accepted.groupBy(*KEY).agg(F.min("at").alias("at")))
        job = triage(wanted.select("pr_id").distinct())

        def put(table: str, rows: DataFrame) -> DataFrame:
            folder = f"{store}/{table}/asked_in={batch_id}"
            rows.write.mode("overwrite").parquet(folder)
            return rows.sparkSession.read.schema(rows.schema).parquet(folder)

        for table in _STORED:
            rows = getattr(job, table)
            rows = put(table, rows.drop("head_sha", "repo") if table == "prs" else rows)
            if table == "files":
                files = rows
        numbers = files.groupBy("pr_id").agg(F.count("*").alias("n_files"))
        asked = wanted.join(numbers, "pr_id", "left").join(files.select("pr_id", "file_path"), "pr_id", "left")
        put("asked", asked.select(
            *KEY, "at", F.lit(batch_id).cast("bigint").alias("asked_in"), F.coalesce("n_files", F.lit(0)).alias("n_files"), "file_path"
        ))

    return events.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_asked(spark: SparkSession, store: str, files_per_batch: int = 100) -> DataFrame:
    """What `asking_stream` has listed, as a stream."""
    return spark.readStream.schema(ASKED).option("maxFilesPerTrigger", files_per_batch).parquet(f"{store}/asked/*")


# ---------------------------------------------------------------- the state of a review


class _Row(NamedTuple):
    at: int  # microseconds
    asked_in: int | None
    n_files: int | None
    file_path: str | None
    status: str | None
    response_text: str | None


def _plain(frame: pd.DataFrame) -> Iterator[_Row]:
    """Rows without pandas; a missing number comes as NaN or None."""
    at = frame["at"].to_numpy().astype("datetime64[us]").astype("int64").tolist()
    whole = ([None if n is None or n != n else int(n) for n in frame[c].tolist()] for c in ("asked_in", "n_files"))
    return map(_Row, at, *whole, *(frame[c].tolist() for c in ("file_path", "status", "response_text")))


class _Review(StatefulProcessor):
    """One review: what was asked, what has come back, and when its time is up."""

    def __init__(self, wait_ms: int) -> None:
        self.wait = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # lists are appended to, so a batch writes its own rows and not those that wait: one entry, as each costs more than its rows
        self.asked = handle.getListState("asked", "file_path array<string>")
        self.answers = handle.getListState("answers", "file_path array<string>, status array<string>, response_text array<string>, at array<bigint>")
        self.now = handle.getValueState("now", "asked_in bigint, n_files bigint, asked bigint, answered bigint, due bigint")
        self.last = handle.getValueState("last", "asked_in bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ended = self._take(key, [row for frame in rows for row in _plain(frame)], timerValues)
        if ended:
            yield pd.DataFrame(ended, columns=_CLOSED_COLUMNS)

    def _take(self, key, came: list[_Row], timerValues) -> list[tuple]:
        """Rows of CLOSED where the review ends with these. Plain lists: each call on a frame or on the state costs more than a row."""
        now = self.now.get()
        open_now = now is not None
        asked_in, n_files, n_asked, n_answered, due = now if open_now else (None, 0, 0, 0, None)
        asks = [r for r in came if r.asked_in is not None]
        if asks and (last := self.last.get()) is not None:  # a micro-batch of questions that was run again
            asks = [r for r in asks if r.asked_in > last[0]]
        if asks:
            asked_in = min(r.asked_in for r in asks) if asked_in is None else asked_in
            asks = [r for r in asks if r.asked_in == asked_in]
        answers = [r for r in came if r.asked_in is None]
        if not asks and not answers:
            return []
        if asks:
            n_files = asks[0].n_files
        paths = [r.file_path for r in asks if r.file_path is not None]
        texts = [(r.file_path, r.status, r.response_text, r.at) for r in answers]
        n_asked += len(paths)
        n_answered += len(texts)
        if asked_in is not None and n_asked >= n_files and n_answered >= n_files:
            files, found = self._state(open_now, paths, texts)
            if len(files) == n_files and files.keys() <= found.keys():
                return self._close(key, asked_in, files, found, due, timerValues, open_now)
        if paths:
            self.asked.appendList([(paths,)])
        if texts:
            self.answers.appendList([tuple(map(list, zip(*texts)))])
        first = due is None or (len(asks) > 0 and n_asked == len(paths))
        if first:
            moment = min(r.at for r in asks or answers) // 1000 + self.wait
            moment = max(moment, timerValues.getCurrentWatermarkInMs() + 1)
            if due is not None and due != moment:
                self.handle.deleteTimer(due)
            if due != moment:
                self.handle.registerTimer(moment)
            due = moment
        self.now.update((asked_in, n_files, n_asked, n_answered, due))
        return []

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ended = self._expire(key, timerValues, expiredTimerInfo)
        if ended:
            yield pd.DataFrame(ended, columns=_CLOSED_COLUMNS)

    def _expire(self, key, timerValues, expiredTimerInfo) -> list[tuple]:
        if (now := self.now.get()) is None:
            self.last.clear()
            return []
        asked_in, n_files, _, _, due = now
        if due != expiredTimerInfo.getExpiryTimeInMs():
            return []
        files, found = self._state()
        if asked_in is None:  # answers to nothing
            self._forget()
            return []
        return self._close(key, asked_in, files, found, None, timerValues)

    def _state(self, stored: bool = True, paths: Sequence[str] = (), texts: Sequence[tuple] = ()) -> tuple[dict, dict]:
        """Files in the order in which they were asked for, and the earliest answer of each: those stored, then these."""
        found: dict = {}
        kept = (self.answers.get() or ()) if stored else ()
        for path, status, text, at in itertools.chain((r for entry in kept for r in zip(*entry)), texts):
            if path not in found or (at, status, text or "") < found[path]:
                found[path] = (at, status, text or "", text)
        asked = [path for entry in (self.asked.get() or ()) for path in entry[0]] if stored else []
        return dict.fromkeys([*asked, *paths]), found

    def _close(self, key, asked_in: int, files: dict, found: dict, due: int | None, timers, stored: bool = True) -> list[tuple]:
        if due is not None:
            self.handle.deleteTimer(due)
        if stored:
            self._forget()
        self.last.update((asked_in,))  # kept for as long as a review lasts
        self.handle.registerTimer(timers.getCurrentWatermarkInMs() + self.wait + 1)
        answered = [(path, *((found[path][1], found[path][3]) if path in found else ("timeout", None))) for path in files]
        return [(*key, asked_in, *row) for row in answered or [(None, None, None)]]

    def _forget(self) -> None:
        for state in (self.asked, self.answers, self.now):
            state.clear()


class _RowReview(_Review):
    """The same review from rows: a frame for each key, in and out, takes longer than all that is done with it."""

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        yield from (_CLOSED_ROW(*r) for r in self._take(key, [_Row(*r[len(KEY) + 1 :]) for r in rows], timerValues))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from (_CLOSED_ROW(*r) for r in self._expire(key, timerValues, expiredTimerInfo))


def closed_reviews(asked: DataFrame, answers: DataFrame, wait_seconds: int, late_seconds: int = 3600) -> DataFrame:
    """Streaming rows of CLOSED for each review that ends: a row per file, or one without a file.

    `asked` and `answers` are streams of ASKED and ANSWERS. A review ends with its last answer, or once the watermark,
    `late_seconds` behind the newest row, is `wait_seconds` past its question. Rows older than the watermark are dropped. Start it
    within `list_store`.
    """
    micros = F.coalesce(F.unix_micros("at"), F.lit(_NO_TIME)).alias("micros")
    columns = [*KEY, "at", micros, "asked_in", "n_files", "file_path", "status", "response_text"]
    questions = asked.withColumn("status", F.lit(None).cast("string")).withColumn("response_text", F.lit(None).cast("string"))
    replies = answers.withColumn("asked_in", F.lit(None).cast("bigint")).withColumn("n_files", F.lit(None).cast("bigint"))
    both = questions.select(*columns).unionByName(replies.select(*columns)).withWatermark("at", f"{late_seconds} seconds")
    return both.groupBy(*KEY).transformWithState(_RowReview(wait_seconds * 1000), CLOSED, "append", "eventTime")


# ---------------------------------------------------------------- answers to reports


def _review_id() -> Column:
    return F.concat_ws("@", *KEY)


def conclude_closed(spark: SparkSession, store: str, closed: DataFrame) -> tuple[DataFrame, review.Conclusion]:
    """The reviews of a table of CLOSED rows, by a review_id, and their conclusion, keyed by that in place of pr_id.

    Only folders of micro-batches that these reviews were asked in are read.
    """
    reviews = materialize(closed.select(*KEY, "asked_in", _review_id().alias("review_id")).distinct())
    folders = [r.asked_in for r in reviews.select("asked_in").distinct().collect()]  # micro-batches with an open review

    def stored(table: str) -> DataFrame:
        rows = spark.read.parquet(f"{store}/{table}").filter(F.col("asked_in").isin(folders))
        return rows.join(reviews, ["pr_id", "asked_in"]).drop("pr_id", "asked_in", "head_sha").withColumnRenamed("review_id", "pr_id")

    responses = closed.filter("file_path is not null").select(_review_id().alias("pr_id"), "file_path", "status", "response_text")
    last = review.conclude(stored("prs"), stored("triage_counts"), stored("routes"), stored("files"), responses)
    return reviews, last


def report_stream(closed: DataFrame, store: str, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Concludes the reviews that each micro-batch lets go and commits comments, summaries and reports under `out`.

    A micro-batch that is run again commits again, and replaces what it had committed for its reviews.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        ended = materialize(batch)
        if ended.isEmpty():
            return
        reviews, last = conclude_closed(spark, store, ended)
        named = reviews.select("review_id", *KEY)

        def keyed(rows: DataFrame) -> DataFrame:
            return rows.withColumnRenamed("pr_id", "review_id").join(named, "review_id").drop("review_id")

        batches.commit(
            spark, out, batch_id, named.select(*KEY),
            comments=keyed(last.comments), summaries=keyed(last.summaries), reports=keyed(last.reports),
        )

    return closed.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
