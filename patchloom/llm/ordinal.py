"""Quality by ordinal regression: graded ratings, one set of weights over hashed words, ordered thresholds.

A text has a score, the weighted sum of its hashed features; grade g or better has the probability
sigmoid(score - threshold of g). All grades share the weights, only the thresholds differ, and they are kept in order by fitting
the first one and the logarithms of the gaps. From these probabilities come the expected grade and the tail probability of reaching the
grade that selection asks for.

Features are hashed words and stems without case and edge punctuation (present or not), and hashed properties of the text such as how many of its
words repeat, are in capitals or stand beside symbols, each in steps. The fit takes at most `max_rated` rated documents, drawn by a
hash of their ids; everything else covers all documents. Its gradients are summed over the partitions of a stored table of
features, so no machine holds more than one vector of weights; the driver gets one sum per partition and step.

Edge cases: a null text has no words; ratings that are null are left out, and several of one document all count; without ratings the
weights are zero and all grades are equally likely; documents are scored as they are, repeated rows and null ids
included; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchloom.llm.tables import materialize, slices

BITS = 18
MAX_RATED = 20_000
STEPS, MEMORY, PENALTY = 40, 8, 5e-5
PARTS = 12
#: Letters of a word's stem, and hashed copies of a property, which weigh it against the many words of a text.
STEM, COPIES = 4, 8

_WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
_CAPITALS = re.compile(r"[^A-ZÀ-ÖØ-Þ]+")
_SYMBOLS = re.compile(r"[#*$%&|<>=+~^\\/{}\[\]@]")

#: Words whose hashes a worker keeps.
CACHE_WORDS = 500_000


# ---------------------------------------------------------------- features


class Hasher:
    """Hashed features of texts; keeps the hashes of words that it has seen."""

    def __init__(self, bits: int) -> None:
        import xxhash

        self.size, self.known, self.digest = 1 << bits, {}, xxhash.xxh32_intdigest

    def _number(self, feature: str) -> int:
        found = self.known.get(feature)
        if found is None:
            if len(self.known) >= CACHE_WORDS:
                self.known.clear()
            found = self.known[feature] = self.digest(feature.encode()) % self.size
        return found

    def features(self, text: str) -> np.ndarray:
        """Sorted numbers of the features that the text has."""
        plain = text.split()
        words = _WORD.findall(text.lower())
        present = set(words)
        found = {self._number(w) for w in present}
        found.update(map(self._number, {"\1" + w[:STEM] for w in present if len(w) > STEM}))
        for name, value in self.properties(text, plain, words, present).items():
            found.update(
                self._number(f"\0{name}>{step}.{copy}") for step in range(1, value + 1) for copy in range(COPIES)
            )
        found.add(self._number("\0any"))
        return np.fromiter(found, np.int32, len(found))

    @staticmethod
    def properties(text: str, plain: list[str], words: list[str], present: set[str]) -> dict[str, int]:
        """Properties in steps; each step reached is a feature."""
        n, m = max(len(plain), 1), max(len(words), 1)

        def eighths(share: float) -> int:
            return min(8, int(8 * share + 1e-9))

        letters = max(sum(map(len, words)), 1)
        return {
            "capitals": eighths(min(1.0, len(_CAPITALS.sub("", text)) / letters)),
            "symbols": eighths(min(1.0, 2 * len(_SYMBOLS.findall(text)) / n)),
            "loud": eighths(min(1.0, (text.count("!") + text.count("?")) / n)),
            "same": eighths(sum(a == b for a, b in zip(words, words[1:])) / m),
            "few words": eighths(1 - len(present) / m) if m > 20 else 0,
            "long words": min(8, int(letters / m)),
            "size": min(16, m.bit_length()),
            "lines": eighths(min(1.0, text.count("\n") / n)),
            "digits": eighths(min(1.0, 4 * sum(w.isdigit() for w in words) / m)),
        }


def hashed(docs: DataFrame, keep: list[str], bits: int = BITS) -> DataFrame:
    """The columns `keep` and `features`, the numbers of the hashed features of `text`."""
    wanted = docs.select(*(F.col(f"`{c}`") for c in keep), F.col("text").cast("string").alias("_text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(bits)
        for batch in slices(batches, text=len(keep)):
            found = [hasher.features(t or "") for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(found, pa.list_(pa.int32()))], names=[*keep, "features"]
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.schema.fields[:-1])
    return wanted.mapInArrow(work, f"{fields}, features array<int>")


# ---------------------------------------------------------------- model


@dataclass
class OrdinalModel:
    """Weights of the hashed features and the ordered thresholds of grades 1 and up."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """Probability of each grade from 1 on, or better, per score."""
        return 1 / (1 + np.exp(-np.clip(scores[:, None] - self.thresholds[None, :], -500, 500)))


def _scores(batch_features: pa.ListArray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Score of each row, the numbers of all features, and the row of each."""
    numbers = batch_features.flatten().to_numpy(zero_copy_only=False)
    offsets = np.diff(batch_features.offsets.to_numpy())
    row = np.repeat(np.arange(len(offsets)), offsets)
    return np.bincount(row, weights[numbers], len(offsets)), numbers, row


def _unfold(theta: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds from what is fitted: the first threshold and the logarithms of the gaps."""
    cuts = theta[size:]
    return theta[:size], cuts[0] + np.concatenate([[0.0], np.cumsum(np.exp(cuts[1:]))])


def partial_loss(features: pa.ListArray, grades: np.ndarray, theta: np.ndarray, size: int) -> tuple[float, np.ndarray]:
    """Sum of the negative log-likelihood over these rows, and its gradient by theta."""
    weights, thresholds = _unfold(theta, size)
    scores, numbers, row = _scores(features, weights)
    k = len(thresholds)
    tail = OrdinalModel(weights, thresholds).tails(scores)
    padded = np.hstack([np.ones((len(scores), 1)), tail, np.zeros((len(scores), 1))])
    at = np.arange(len(scores))
    p = np.maximum(padded[at, grades] - padded[at, grades + 1], 1e-12)
    slope = padded * (1 - padded)  # of each tail by the score; 0 at both ends
    by_score = -(slope[at, grades] - slope[at, grades + 1]) / p
    gradient = np.zeros_like(theta)
    gradient[:size] = np.bincount(numbers, by_score[row], size)
    by_cut = np.zeros(k + 2)
    np.add.at(by_cut, grades, slope[at, grades] / p)
    np.add.at(by_cut, grades + 1, -slope[at, grades + 1] / p)
    by_cut = by_cut[1 : k + 1]
    gradient[size] = by_cut.sum()
    for g in range(1, k):
        gradient[size + g] = by_cut[g:].sum() * np.exp(theta[size + g])
    return float(-np.log(p).sum()), gradient


def packed(gradient: np.ndarray) -> bytes:
    """A gradient in single precision: a bit for each place, then what is not zero. Most features are in no text of a partition."""
    held = gradient.astype(np.float32)
    return np.packbits(held != 0).tobytes() + held[held != 0].tobytes()


def add_packed(sums: np.ndarray, gradient: bytes) -> None:
    """Adds a gradient that `packed` made to `sums`."""
    bits = (len(sums) + 7) // 8
    places = np.unpackbits(np.frombuffer(gradient, np.uint8, bits), count=len(sums)).astype(bool)
    sums[places] += np.frombuffer(gradient[bits:], np.float32)


def _minimise(loss, theta: np.ndarray, steps: int) -> np.ndarray:
    """L-BFGS with a halving line search; `loss` gives value and gradient."""
    value, gradient = loss(theta)
    moves: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        way, used = gradient.copy(), []
        for s, y, r in reversed(moves):
            a = r * (s @ way)
            used.append(a)
            way -= a * y
        if moves:
            s, y, r = moves[-1]
            way *= 1 / (r * (y @ y))
        for (s, y, r), a in zip(moves, reversed(used)):
            way += s * (a - r * (y @ way))
        slope, size = -(way @ gradient), 1.0 if moves else 1 / max(1.0, float(np.abs(gradient).max()))
        if slope >= 0:
            break
        for _ in range(12):
            new = theta - size * way
            new_value, new_gradient = loss(new)
            if new_value <= value + 1e-4 * size * slope:
                break
            size /= 2
        else:
            break
        s, y = new - theta, new_gradient - gradient
        if (curve := float(s @ y)) > 1e-12:
            moves = [*moves, (s, y, 1 / curve)][-MEMORY:]
        gain, theta, value, gradient = value - new_value, new, new_value, new_gradient
        if gain < 1e-5 * max(abs(value), 1e-3):
            break
    return theta


def fit(rated: DataFrame, grades: int, bits: int = BITS, max_rated: int = MAX_RATED, steps: int = STEPS, penalty: float = PENALTY) -> OrdinalModel:
    """A model from rows (doc_id, text, grade) with grades 0 .. grades - 1; at most about `max_rated` rows are used."""
    size, cuts = 1 << bits, grades - 1
    sound = rated.filter(F.col("grade").between(0, grades - 1))
    rows = sound.count()
    share = min(1.0, max_rated / max(rows, 1))
    drawn = sound.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < round(share * (1 << 20)))
    spread = drawn.select("doc_id", "text", F.col("grade").cast("int").alias("grade")).repartition(PARTS)
    stored = materialize(hashed(spread, ["grade"], bits))
    counts = {r[0]: r[1] for r in stored.groupBy("grade").agg(F.count("*")).collect()}  # a row per grade
    total = sum(counts.values())
    if not total:
        return OrdinalModel(np.zeros(size), -np.log(np.arange(grades - 1, 0, -1) / np.arange(1, grades)))
    upward = np.cumsum([counts.get(g, 0) for g in range(grades)][::-1])[::-1][1:] / total
    first = -np.log(np.clip(upward, 1e-3, 1 - 1e-3) / (1 - np.clip(upward, 1e-3, 1 - 1e-3)))
    gaps = np.maximum(np.diff(first), 0.1)
    theta = np.concatenate([np.zeros(size), first[:1], np.log(gaps)])
    context = rated.sparkSession.sparkContext

    def loss(theta: np.ndarray) -> tuple[float, np.ndarray]:
        held = context.broadcast(theta)

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            value, gradient = 0.0, np.zeros(size + cuts)
            for batch in batches:
                v, g = partial_loss(batch.column(1), batch.column(0).to_numpy(), held.value, size)
                value, gradient = value + v, gradient + g
            yield pa.RecordBatch.from_arrays(
                [pa.array([value]), pa.array([packed(gradient)])], names=["value", "gradient"]
            )

        value, gradient = 0.0, np.zeros(size + cuts)
        sums = stored.select("grade", "features").coalesce(PARTS).mapInArrow(part, "value double, gradient binary")
        for v, g in sums.collect():  # a row per partition, of which there are PARTS at most
            value += v
            add_packed(gradient, g)
        held.destroy()  # on the driver as well, or it would keep the weights of every step
        weights = theta[:size]
        value = value / total + 0.5 * penalty * float(weights @ weights)
        gradient /= total
        gradient[:size] += penalty * weights
        return value, gradient

    return OrdinalModel(*_unfold(_minimise(loss, theta, steps), size))


ADDED = ("expected_grade", "tail_probability")


def score(docs: DataFrame, model: OrdinalModel, keep: list[str], tail_grade: int, bits: int = BITS) -> DataFrame:
    """The columns `keep`, expected_grade, and tail_probability: the chance of `tail_grade` or better."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    own = [F.col(f"`{c}`") for c in keep if c not in ADDED]
    names, at = [c for c in keep if c not in ADDED], len(own)
    if "text" in names:
        at = names.index("text")
    else:
        own.append(F.col("text").alias("_text"))
    wanted = docs.select(*own)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, model = Hasher(bits), held.value
        for batch in slices(batches, text=at):
            features = [hasher.features(t or "") for t in batch.column(at).to_pylist()]
            scores, _, _ = _scores(pa.array(features, pa.list_(pa.int32())), model.weights)
            tails = model.tails(scores)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(names)], pa.array(np.round(tails.sum(axis=1), 9)), pa.array(np.round(tails[:, tail_grade - 1], 9))],
                names=[*names, *ADDED],
            )

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in wanted.schema.fields[: len(names)])
    return wanted.mapInArrow(work, f"{fields}expected_grade double, tail_probability double")


#: Grades of `grade`, and the probability of the best one from which a document is kept.
GRADES, KEPT_FROM = 3, 0.5


def grade(quality: Column, toxic: Column) -> Column:
    """Grades from two ratings: 0 toxic, 1 neither toxic nor good, 2 good; null where a rating is missing."""
    return F.when(toxic == 1, 0).when((toxic == 0) & (quality == 0), 1).when((toxic == 0) & (quality == 1), 2)


def rated_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, grade) of the documents that `labels` rates."""
    ratings = labels.select(F.col("doc_id").alias("doc_id"), grade(F.col("quality"), F.col("toxic")).alias("grade"))
    return docs.select("doc_id", "text").join(ratings.filter("grade is not null"), "doc_id")
