import random

import numpy as np
import pyarrow as pa
from llm_cases import ODD
from pyspark.sql import functions as F

from patchloom.llm import ordinal


def rated(n, seed):
    rng = random.Random(seed)
    clean, junk, bad = [f"plain{k}" for k in range(60)], ["###", "$$$", "!!!"], ["vile", "nasty"]
    rows = []
    for k in range(n):
        grade = rng.choice([0, 1, 2, 2, 2])
        words = [rng.choice(clean) for _ in range(rng.randint(20, 60))]
        if grade == 1:
            words = [w + rng.choice(junk) for w in words]
        if grade == 0:
            words[rng.randrange(len(words))] = rng.choice(bad)
        rows.append((seed * 10_000 + k, " ".join(words), grade))
    return rows


def test_gradient():
    rng = np.random.default_rng(1)
    features = pa.array([rng.choice(40, 6, replace=False).astype(np.int32) for _ in range(30)], pa.list_(pa.int32()))
    grades, theta = rng.integers(0, 4, 30), rng.normal(0, 0.3, 43)
    _, gradient = ordinal.partial_loss(features, grades, theta, 40)
    for k in (0, 7, 39, 40, 41, 42):
        step = np.zeros(43)
        step[k] = 1e-6
        up, down = (ordinal.partial_loss(features, grades, theta + s, 40)[0] for s in (step, -step))
        assert abs((up - down) / 2e-6 - gradient[k]) < 1e-4


def test_packed_gradients():
    rng = np.random.default_rng(2)
    for size in (1, 8, 43, 1 << 14):
        for share in (0.0, 0.1, 1.0):
            parts = [np.where(rng.random(size) < share, rng.normal(0, 1, size), 0.0) for _ in range(3)]
            sums, plain = np.zeros(size), np.zeros(size)
            for part in parts:
                ordinal.add_packed(sums, ordinal.packed(part))
                plain += part.astype(np.float32)
            assert (sums == plain).all()
    assert len(ordinal.packed(np.eye(1, 1 << 14)[0])) < 4 * (1 << 14) / 30  # no bytes for the zeros


def test_fit_keeps_no_weights_on_the_driver(spark, monkeypatch):
    """The driver drops the weights of a step when the step is done."""
    sent, gone = [], []
    kind = type(spark.sparkContext.broadcast(0))
    made, destroy = kind.__init__, kind.destroy

    def counted(self, *args, **named):
        made(self, *args, **named)
        sent.append(id(self))

    def dropped(self, *args, **named):
        destroy(self, *args, **named)
        gone.append(id(self))

    monkeypatch.setattr(kind, "__init__", counted)
    monkeypatch.setattr(kind, "destroy", dropped)
    ordinal.fit(spark.createDataFrame(rated(60, 4), "doc_id long, text string, grade int"), 3, bits=10, steps=3)
    assert len(sent) >= 3 and len(gone) == len(sent)


def test_held_out_accuracy(spark, documents):
    frame = spark.createDataFrame(rated(500, 1), "doc_id long, text string, grade int")
    model = ordinal.fit(frame, 3, bits=14)
    assert (np.diff(model.thresholds) > 0).all()
    test = spark.createDataFrame(rated(200, 2), "doc_id long, text string, grade int")
    got = ordinal.score(test, model, ["doc_id", "grade", "text"], 2, bits=14).toPandas()
    assert got.columns.tolist() == ["doc_id", "grade", "text", "expected_grade", "tail_probability"]
    assert ((got.tail_probability >= 0.5) == (got.grade == 2)).mean() > 0.95
    means = got.groupby("grade").expected_grade.mean()
    assert means[0] < means[1] < means[2]
    odd = ordinal.score(documents(ODD).withColumn("tail_probability", F.lit("given")), model, ["doc_id"], 2, bits=14).collect()
    assert len(odd) == len(ODD) and all(0 <= r.tail_probability <= 1 and 0 <= r.expected_grade <= 2 for r in odd)
    assert ordinal.score(documents([]), model, ["doc_id"], 2, bits=14).count() == 0


def test_no_ratings_and_null_ratings(spark, documents):
    labels = spark.createDataFrame([(5, None, 0), (6, 1, None)], "doc_id long, quality int, toxic int")
    frame = ordinal.rated_documents(documents(ODD), labels)
    model = ordinal.fit(frame, 3, bits=10)
    tails = model.tails(np.zeros(1))[0]
    assert np.allclose(tails, [2 / 3, 1 / 3]) and not model.weights.any()


def test_grades(spark):
    labels = spark.createDataFrame([(1, 1), (0, 1), (0, 0), (1, 0), (None, 1), (None, 0), (1, None)], "quality int, toxic int")
    got = [r[0] for r in labels.select(ordinal.grade(F.col("quality"), F.col("toxic"))).collect()]
    assert got == [0, 0, 1, 2, 0, None, None]


def test_the_sample_of_ratings_is_bounded(spark):
    frame = spark.createDataFrame(rated(400, 3), "doc_id long, text string, grade int")
    model = ordinal.fit(frame, 3, bits=12, max_rated=60, steps=3)
    assert np.isfinite(model.weights).all()
