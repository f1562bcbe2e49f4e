"""Quality by weak supervision: rules vote good, bad or abstain, and expectation-maximisation weighs them.

Nobody has labelled the texts. How often a rule that votes is right is unknown, apart for good and for bad texts; so is the
share of good texts. Rules are written so that they seldom call a good text bad, and the estimates are held to that; how
often they notice a bad one is left to the data. All are estimated from how the votes agree, over all documents. Only the number of documents per
combination of votes is needed, at most 3 to the power of the number of rules, so the driver sees no more than that
however many documents there are. The posterior probability of good, not a set of tests that must all pass, decides.

Edge cases: a null text has no words, so it fails the base test; rows are kept as they are; a document on which every
rule abstains has the prior as its posterior; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patchloom.llm.tables import materialize, slices

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

#: Steps of expectation-maximisation, and the change of all estimates at which it ends.
STEPS, TOLERANCE = 300, 1e-7
#: Bounds of a rule's accuracy when it votes: on good texts, where one wrong vote in 200 is the most a rule is
#: granted, and on bad ones, most of which a rule may miss.
GOOD_BOUNDS, BAD_BOUNDS = (0.995, 0.999), (0.05, 0.95)
FIRST_GOOD, FIRST_BAD, FIRST_PRIOR = 0.995, 0.3, 0.8

MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_loud",
    "n_top_word", "n_distinct",
)

_SYMBOLS = re.compile(r"[#*$%&|<>]")
_SPACE = re.compile(r"[\x20\x09-\x0D]+")


def measure(text: str) -> tuple[int, ...]:
    """What the rules look at, in the order of MEASURES."""
    raw = text.encode()
    words = raw.split()  # on bytes: exactly the ASCII white space
    n = len(words)
    if not n:
        return (0,) * len(MEASURES)
    lines, seen, dup, full = raw.split(b"\n"), set(), 0, 0
    for line in lines:
        if line.strip():
            full += 1
            dup += line in seen
            seen.add(line)
    numbers: dict[bytes, int] = {}
    ids = np.fromiter([numbers.setdefault(w, len(numbers)) for w in words], np.int64, n)
    repeat = 0
    if n >= 3:
        k = len(numbers)
        if k < 1 << 21:
            windows = (ids[:-2] * k + ids[1:-1]) * k + ids[2:]
        else:  # three numbers no longer fit one integer: number the pairs first
            _, pairs = np.unique(ids[:-2] * k + ids[1:-1], return_inverse=True)
            windows = pairs * k + ids[2:]
        _, place, times = np.unique(windows, return_inverse=True, return_counts=True)
        twice = times[place] >= 2
        held = np.zeros(n, bool)
        for shift in range(3):
            held[shift : n - 2 + shift] |= twice
        repeat = int(held.sum())
    white = sum(map(len, _SPACE.findall(text)))
    upper = sum(map(str.isupper, text))
    letters = sum(map(str.isalpha, text))
    loud = text.count("!") + text.count("?")
    return (
        n, len(text) - white, len(_SYMBOLS.findall(text)), dup, repeat, full, upper, letters, loud,
        int(np.bincount(ids).max()), len(numbers),
    )


def measures(docs: DataFrame) -> DataFrame:
    """doc_id and MEASURES of every document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text=1):
            found = np.array([measure(t or "") for t in batch.column(1).to_pylist()], np.int64).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(found[:, k]) for k in range(len(MEASURES)))], names=["doc_id", *MEASURES]
            )

    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return narrow.mapInArrow(work, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """Votes on the measures: -1 bad, 1 good, 0 abstains."""
    words, chars = F.col("n_words"), F.col("word_chars")
    some = words > 0

    def share(part: str, whole: str) -> Column:
        return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(0.0)

    return {
        "length": _vote(words < MIN_WORDS, words >= 200),
        "word_length": _vote(some & ((chars > 12 * words) | (chars < 3 * words)), some & (chars < 9 * words)),
        "symbols": _vote(share("n_symbols", "n_words") > 0.1, some & (share("n_symbols", "n_words") < 0.01)),
        "dup_lines": _vote(share("n_dup_lines", "n_lines") > 0.3, (F.col("n_lines") > 2) & (F.col("n_dup_lines") == 0)),
        "repeats": _vote(share("n_repeat_words", "n_words") > 0.3, some & (share("n_repeat_words", "n_words") < 0.1)),
        "capitals": _vote(share("n_upper", "n_letters") > 0.3, some & (share("n_upper", "n_letters") < 0.1)),
        "loudness": _vote(share("n_loud", "n_words") > 0.1, some & (share("n_loud", "n_words") < 0.02)),
        "top_word": _vote((words >= 20) & (share("n_top_word", "n_words") > 0.2), some & (share("n_top_word", "n_words") < 0.1)),
    }


@dataclass
class VoteModel:
    """Share of good documents, and how often each rule that votes is right on good and on bad ones."""

    prior: float
    good: np.ndarray
    bad: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of good for each combination of votes (-1, 0, 1); abstentions tell nothing."""
        odds = np.log(self.prior / (1 - self.prior))
        odds = odds + (votes > 0) @ np.log(self.good / (1 - self.bad)) + (votes < 0) @ np.log((1 - self.good) / self.bad)
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def fit(votes: np.ndarray, counts: np.ndarray) -> VoteModel:
    """Expectation-maximisation over combinations of votes and their counts."""
    rules = votes.shape[1]
    model = VoteModel(FIRST_PRIOR, np.full(rules, FIRST_GOOD), np.full(rules, FIRST_BAD))
    for_good, for_bad = (votes > 0).astype(float), (votes < 0).astype(float)
    for _ in range(STEPS):
        chance = model.posterior(votes)
        good, bad = chance * counts, (1 - chance) * counts
        # two imagined votes per rule keep silent rules at their first value
        right_good = (good @ for_good + 2 * FIRST_GOOD) / (good @ (for_good + for_bad) + 2)
        right_bad = (bad @ for_bad + 2 * FIRST_BAD) / (bad @ (for_good + for_bad) + 2)
        fresh = VoteModel(
            float(np.clip(good.sum() / max(counts.sum(), 1), 0.01, 0.99)), np.clip(right_good, *GOOD_BOUNDS), np.clip(right_bad, *BAD_BOUNDS)
        )
        moved = max(abs(fresh.prior - model.prior), np.abs(fresh.good - model.good).max(), np.abs(fresh.bad - model.bad).max())
        model = fresh
        if moved < TOLERANCE:
            break
    return model


def label(docs: DataFrame) -> DataFrame:
    """doc_id, all measures, votes, base_failed, quality (posterior probability of good) and kept."""
    voting = rules()
    taken = F.concat_ws(",", *(v.cast("string") for v in voting.values()))
    measured = materialize(measures(docs).withColumn("votes", taken))
    combinations = measured.groupBy("votes").agg(F.count("*").alias("n")).collect()  # 3 ** rules rows at most
    votes = np.array([r[0].split(",") for r in combinations], np.int64).reshape(-1, len(voting))
    model = fit(votes, np.array([r[1] for r in combinations], np.float64))
    quality = np.round(model.posterior(votes), 9).tolist()
    known = T.StructType([T.StructField("votes", T.StringType()), T.StructField("quality", T.DoubleType())])
    weighed = docs.sparkSession.createDataFrame([(r[0], q) for r, q in zip(combinations, quality)], known)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return (
        measured.join(F.broadcast(weighed), "votes")
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5))
    )
