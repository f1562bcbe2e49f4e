"""Training samples from labelled commits, and the classifier learnt from them."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchloom.functions import constants as C
from patchloom.functions.regex import folded_pattern, opening
from patchloom.functions.text import folded
from patchloom.operators import diffs as D
from patchloom.operators.features import chunk_features
from patchloom.session import materialize
from patchloom.sources.landed import commits_with_diffs, md5_bucket

#: inputs, three hidden layers, and one output per class
LAYERS = [len(C.VECTOR_COLUMNS), 128, 128, 64, 2]


def commit_label() -> Column:
    """``bugfix``, ``clean`` or ``skip``, from the first line of the message."""
    first_line = folded(F.substring_index("message", "\n", 1))
    fix = first_line.rlike(_words_pattern(C.LABEL_FIX_PATTERN))
    clean = first_line.rlike(_words_pattern(C.LABEL_CLEAN_PATTERN))
    # nested, so that each search runs once at most
    return F.when(fix, F.when(clean, F.lit("skip")).otherwise(F.lit("bugfix"))).when(clean, F.lit("clean")).otherwise(F.lit("skip"))


def _words_pattern(text: str) -> str:
    """A pattern ``\\b(word|word ...)\\b`` for folded text, with a look at the words' first letters."""
    words = text.lower().removeprefix(r"\b(").removesuffix(r")\b").split("|")
    return folded_pattern(opening(words) + text)


def labelled_commits(commits: DataFrame) -> DataFrame:
    """Commits that speak of a fix only (label 1) or of a feature only (label 0)."""
    # the filter stays behind the outer form; moved down to the scan, it would search each message again, on as few tasks as there are files
    kinds = commits.select("*", F.explode_outer(F.array(commit_label())).alias("kind")).filter(F.col("kind") != "skip")
    return kinds.withColumn("label", (F.col("kind") == "bugfix").cast("int"))


def commit_samples(commits: DataFrame, commit_diffs: DataFrame) -> DataFrame:
    """One sample per chunk of a labelled commit, if the chunk is of a size worth learning from."""
    return chunk_features(sample_chunks(commits_with_diffs(labelled_commits(commits), commit_diffs)))


def sample_chunks(labelled: DataFrame) -> DataFrame:
    """Chunks of a size worth learning from, of labelled commits with their diffs."""
    return D.sample_sized(D.review_chunks(labelled, ["repo", "sha", "committed_at", "label"]))


def page_within_cap(page: DataFrame, reached: DataFrame, cap: int) -> tuple[DataFrame, DataFrame]:
    """What of a page of commits still counts, and the samples each repository has then.

    ``page`` has (repo, sha, place, n): commits in the order of ``place`` with their samples; ``reached`` has (repo, samples) of the
    pages before. A repository takes commits up to the one that brings it to twice the cap. The sum runs over one page of
    each repository.
    """
    in_order = Window.partitionBy("repo").orderBy("place", "sha")
    so_far = page.join(reached, "repo", "left").withColumn("had", F.coalesce("samples", F.lit(0)))
    kept = so_far.withColumn(
        "before", F.col("had") + F.sum("n").over(in_order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    ).filter(F.col("before") < 2 * cap)
    taken = page.groupBy("repo").agg(F.sum("n").alias("n"))
    after = reached.join(taken, "repo", "full").select("repo", (F.coalesce("samples", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("samples"))
    return kept.select("repo", "sha"), after


def collection_stats(samples: DataFrame) -> DataFrame:
    """Samples, buggy and clean ones per repository, and in total where ``repo`` is null."""
    return samples.rollup("repo").agg(
        F.count("*").alias("samples"),
        F.count_if(F.col("label") == 1).alias("buggy"),
        F.count_if(F.col("label") == 0).alias("clean"),
    )


def training_rows(samples: DataFrame, *keys: str) -> DataFrame:
    """The 27 features as doubles and the label."""
    vector = [F.col(name).cast("double").alias(name) for name in C.VECTOR_COLUMNS]
    return samples.select(*keys, *vector, F.col("label").cast("int").alias("label"))


def shuffled(samples: DataFrame, key: Column, seed: int = 42) -> DataFrame:
    """Rows in an order that depends on the seed and a key only."""
    return samples.orderBy(F.md5(F.concat(F.lit(f"{seed}-"), key)), key)


def with_split(samples: DataFrame, key: Column, seed: int = 42) -> DataFrame:
    """Adds ``split``: eight, one and one tenths for training, validation and test.

    Keyed by sample, or by commit to keep a commit's samples together.
    """
    bucket = md5_bucket(key, seed, 10)
    return samples.withColumn(
        "split", F.when(bucket < 8, F.lit("train")).when(bucket == 8, F.lit("val")).otherwise(F.lit("test"))
    )


def with_positions(rows: DataFrame, *order: Column) -> DataFrame:
    """Stored rows with ``position``: 0, 1, 2 ... in the given order, which a write and a read leave as it is.

    Ranges of the order are dealt out and sorted in parallel; a window over one count per range carries them on. Rows that are equal
    in ``order`` come in any order.
    """
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    number = F.monotonically_increasing_id()  # the range in the upper bits, the row in the lower 33
    stored = materialize(sorted_rows.select("*", F.shiftright(number, 33).alias("_range"), (number % (1 << 33)).alias("_row")))
    counts = stored.groupBy("_range").agg(F.count("*").alias("n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    starts = counts.select("_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    return stored.join(starts, "_range").select(*rows.columns, (F.col("_start") + F.col("_row")).alias("position"))


#: Hexadecimal digits of a hash by which one pass narrows a cut, so a pass counts at most 16^4 prefixes.
CUT_DIGITS = 4


def _cuts(hashes: DataFrame, ranks: list[int]) -> list[str | None]:
    """For each rank the prefix such that as many rows as the rank says have a hash up to it; None for rank 0.

    Counts by prefix narrow each cut to one prefix, whose rows are then counted by longer prefixes, until a prefix ends at the rank or is
    a whole hash. Rows of one hash stay together, so a rank within them is rounded up.
    """
    found: dict[int, str | None] = {k: None for k, rank in enumerate(ranks) if rank == 0}
    prefixes, left = {k: "" for k in range(len(ranks)) if k not in found}, dict(enumerate(ranks))
    for width in range(CUT_DIGITS, 32 + CUT_DIGITS, CUT_DIGITS):
        if not prefixes:
            break
        within = F.substring("hash", 1, width - CUT_DIGITS).isin(*set(prefixes.values())) if width > CUT_DIGITS else F.lit(True)
        counted = hashes.filter(within).groupBy(F.substring("hash", 1, width).alias("prefix")).agg(F.count("*").alias("n"))
        counts = sorted((r.prefix, r.n) for r in counted.collect())  # 16^4 for each cut at most
        for k, prefix in list(prefixes.items()):
            for longer, n in counts:
                if not longer.startswith(prefix):
                    continue
                if left[k] > n:
                    left[k] -= n
                    continue
                if left[k] == n or width >= 32:
                    found[k] = longer
                    del prefixes[k]
                else:
                    prefixes[k] = longer
                break
    return [found[k] for k in range(len(ranks))]


def with_exact_split(samples: DataFrame, key: Column, seed: int = 42) -> DataFrame:
    """Adds ``split`` with floor sizes to the row: 80 % train, 10 % validation, the rest test, in the order of the seeded md5 of the key.

    Two cuts through the hashes say it all: no sort, and the same split however the rows are dealt out. Samples that
    share a key stay together; then a size can be off by the samples of one key.
    """
    hashed = samples.withColumn("_hash", F.md5(F.concat(F.lit(f"{seed}-"), key)))
    hashes = materialize(hashed.select(F.col("_hash").alias("hash")))
    n = hashes.count()
    train, val = _cuts(hashes, [int(0.8 * n), int(0.8 * n) + int(0.1 * n)])

    def upto(prefix: str | None) -> Column:
        return F.lit(False) if prefix is None else F.substring("_hash", 1, len(prefix)) <= prefix

    split = F.when(upto(train), F.lit("train")).when(upto(val), F.lit("val")).otherwise(F.lit("test"))
    return hashed.withColumn("split", split).drop("_hash")


def class_balance(samples: DataFrame, *by: str) -> DataFrame:
    """Sample count, positives, their share, and the ratio of negatives to positives."""
    positive = F.count_if(F.col("label") == 1)
    negative = F.count_if(F.col("label") == 0)
    return samples.groupBy(*by).agg(
        F.count("*").alias("samples"),
        positive.alias("buggy"),
        negative.alias("clean"),
        (positive / F.count("*")).alias("buggy_share"),
        (negative / F.greatest(positive, F.lit(1))).alias("clean_per_buggy"),
    )


def evaluate(predictions: DataFrame, *by: str) -> DataFrame:
    """Confusion counts and their scores from ``probability_1`` and ``label``, in one pass."""
    p, y = F.col("probability_1"), F.col("label") == 1
    said = p > 0.5
    safe = F.least(F.greatest(p, F.lit(1e-15)), F.lit(1 - 1e-15))
    counts = predictions.groupBy(*by).agg(
        F.count_if(said & y).alias("tp"),
        F.count_if(said & ~y).alias("fp"),
        F.count_if(~said & ~y).alias("tn"),
        F.count_if(~said & y).alias("fn"),
        F.avg(-F.when(y, F.log(safe)).otherwise(F.log(1 - safe))).alias("loss"),
    )
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    rates = counts.select(
        "*",
        ((tp + tn) / F.greatest(tp + fp + tn + fn, F.lit(1))).alias("accuracy"),
        (tp / F.greatest(tp + fp, F.lit(1))).alias("precision"),
        (tp / F.greatest(tp + fn, F.lit(1))).alias("recall"),
    )
    precision, recall = F.col("precision"), F.col("recall")
    return rates.withColumn("f1", precision * recall * 2 / F.greatest(precision + recall, F.lit(1e-8)))


def _predictions(model: PipelineModel, samples: DataFrame) -> DataFrame:
    probability = F.get(vector_to_array("probability"), F.lit(1))
    return model.transform(samples).select(probability.alias("probability_1"), "label")


def train(
    samples: DataFrame,
    rounds: int = 50,
    patience: int = 10,
    steps: int = 10,
    layers: list[int] = LAYERS,
    seed: int = 42,
    history: list[float] | None = None,
) -> tuple[PipelineModel, dict]:
    """Fit on the training split, keep the model that is best on validation, stop without gain.

    Each round goes on from the weights of the one before for ``steps`` iterations. ``samples`` are
    the 27 features, ``label`` and ``split``. Returns the best model and its validation scores; the F1 of each
    round is added to ``history``.
    """
    scaling = Pipeline(stages=[
        VectorAssembler(inputCols=C.VECTOR_COLUMNS, outputCol="raw_features"),
        StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True),
    ])
    samples = materialize(samples)
    training = samples.filter(F.col("split") == "train")
    validation = samples.filter(F.col("split") == "val")
    scaler = scaling.fit(training)
    # every pass of every round reads the scaled vectors
    scaled = materialize(scaler.transform(training).select("features", "label"))

    best, best_scores, weights, idle = None, {"val_f1": 0.0}, None, 0
    for number in range(1, rounds + 1):
        learner = MultilayerPerceptronClassifier(
            layers=layers, maxIter=steps, seed=seed, featuresCol="features", labelCol="label"
        )
        if weights is not None:
            learner.setInitialWeights(weights)
        fitted = learner.fit(scaled)
        weights = fitted.weights
        model = PipelineModel(stages=[*scaler.stages, fitted])
        scores = evaluate(_predictions(model, validation)).first()
        if history is not None:
            history.append(0.0 if scores is None else scores["f1"])
        if scores is not None and scores["f1"] > best_scores["val_f1"]:
            best, idle = model, 0
            best_scores = {
                "val_f1": scores["f1"], "val_precision": scores["precision"],
                "val_recall": scores["recall"], "round": number,
            }
        else:
            if best is None:  # the answer if no round ever gains
                best, first = model, scores
                best_scores |= {"val_precision": 0.0, "val_recall": 0.0, "round": number}
                if first is not None:
                    best_scores |= {"val_precision": first["precision"], "val_recall": first["recall"]}
            idle += 1
            if idle >= patience:
                break
    return best, best_scores


def evaluate_split(model: PipelineModel, samples: DataFrame, split: str = "test") -> DataFrame:
    return evaluate(_predictions(model, samples.filter(F.col("split") == split)))
