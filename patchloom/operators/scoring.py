"""Risk scores, bands, triage and focus areas."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchloom.functions import constants as C
from patchloom.functions.text import percent


def band(score: Column) -> Column:
    return (
        F.when(score >= C.HIGH_BAND, F.lit("high"))
        .when(score >= C.TRIAGE_THRESHOLD, F.lit("medium"))
        .otherwise(F.lit("low"))
    )


def with_base_score(features: DataFrame, model: PipelineModel | None) -> DataFrame:
    """Adds ``base_score`` to four places and ``base_label``, the band of the unrounded score.

    Without a model every chunk gets the fallback score, labelled medium.
    """
    if model is None:
        return features.select(
            "*", F.lit(C.FALLBACK_SCORE).alias("base_score"), F.lit("medium").alias("base_label")
        )
    scored = model.transform(features)
    probability = F.get(vector_to_array("probability"), F.lit(1))
    return scored.select(
        *features.columns,
        F.bround(probability, 4).alias("base_score"),
        band(probability).alias("base_label"),
    )


def adjusted_score(base: Column) -> Column:
    """The base score with its semantic additions in order, each capped at 1."""
    error_prone = (F.col("error_handling_ratio") < 0.05) & (F.col("cross_function_calls") > 3)
    untested = ~F.col("has_test_coverage") & (F.col("cross_function_calls") > 5)
    score = base
    for applies, amount in (
        (F.col("commit_history_risk") > 0.5, 0.10),
        (untested, 0.05),
        (F.col("import_complexity") > 5, 0.05),
        (error_prone, 0.05),
    ):
        score = F.when(applies, F.least(score + amount, F.lit(1.0))).otherwise(score)
    return F.bround(score, 4)


def with_adjusted_score(enriched: DataFrame) -> DataFrame:
    """Adds ``score``, ``risk_label`` and ``is_high``, whether the chunk goes on to review."""
    scored = enriched.withColumn("score", adjusted_score(F.col("base_score")))
    return scored.select(
        "*",
        band(F.col("score")).alias("risk_label"),
        (F.col("score") >= C.TRIAGE_THRESHOLD).alias("is_high"),
    )


def high_risk(scored: DataFrame) -> DataFrame:
    return scored.filter(F.col("score") >= C.TRIAGE_THRESHOLD)


def low_risk(scored: DataFrame) -> DataFrame:
    return scored.filter(F.col("score") < C.TRIAGE_THRESHOLD)


def focus_areas() -> Column:
    """What to look at in a chunk, in a fixed order."""
    calls, ratio = F.col("cross_function_calls"), F.col("error_handling_ratio")
    history = percent(F.col("commit_history_risk"))
    areas = [
        F.when(F.col("has_eval_exec"), F.lit(C.FOCUS_EVAL)),
        F.when(F.col("has_sql_string"), F.lit(C.FOCUS_SQL)),
        F.when(F.col("has_hardcoded_secret"), F.lit(C.FOCUS_SECRET)),
        F.when(F.col("has_shell_command"), F.lit(C.FOCUS_SHELL)),
        F.when(
            F.col("cyclomatic_estimate") > 8,
            F.format_string(C.FOCUS_COMPLEXITY, F.col("cyclomatic_estimate")),
        ),
        F.when(F.col("commit_history_risk") > 0.4, F.format_string(C.FOCUS_HISTORY, history)),
        F.when(~F.col("has_test_coverage"), F.lit(C.FOCUS_NO_TEST)),
        F.when(calls > 8, F.format_string(C.FOCUS_CALLS, calls)),
        F.when((ratio < 0.05) & (F.col("num_added_lines") > 20), F.lit(C.FOCUS_ERRORS)),
    ]
    return F.array_compact(F.array(*areas))


def with_focus_areas(enriched: DataFrame) -> DataFrame:
    return enriched.withColumn("focus_areas", focus_areas())


def file_focus_areas(scored: DataFrame) -> DataFrame:
    """Focus areas per file over its high-risk chunks, first seen first; files with none are absent.

    Equal areas meet before they are collected, so a list is no longer than its distinct entries.
    """
    areas = high_risk(scored).select(
        "pr_id", "file_path", "chunk_ord", F.posexplode("focus_areas").alias("at", "area")
    )
    firsts = areas.groupBy("pr_id", "file_path", "area").agg(
        F.min(F.struct("chunk_ord", "at")).alias("seen")
    )
    ordered = F.array_sort(F.collect_list(F.struct("seen", "area")))
    return firsts.groupBy("pr_id", "file_path").agg(
        F.transform(ordered, lambda e: e["area"]).alias("focus_areas")
    )


def triage_counts(scored: DataFrame, model_loaded: bool) -> DataFrame:
    """Chunks, high-risk chunks and low-risk chunks per PR."""
    return scored.groupBy("pr_id").agg(
        F.count("*").alias("total_chunks"),
        F.count_if(F.col("score") >= C.TRIAGE_THRESHOLD).alias("high_risk"),
        F.count_if(F.col("score") < C.TRIAGE_THRESHOLD).alias("low_risk_skipped"),
        F.lit(model_loaded).alias("classifier_loaded"),
    )


def snippet_risk(features: DataFrame, model: PipelineModel | None) -> DataFrame:
    """Score, band, factors and trigger per snippet; it has no PR, so no tests and no history."""
    alone = features.select(
        "*", F.lit(False).alias("has_test_coverage"), F.lit(0.0).alias("commit_history_risk")
    )
    scored = with_base_score(alone, model)
    return with_focus_areas(scored).select(
        "snippet_id", "file_path",
        F.col("base_score").alias("risk_score"),
        band(F.col("base_score")).alias("risk_label"),
        F.col("focus_areas").alias("risk_factors"),
        (F.col("base_score") >= C.TRIAGE_THRESHOLD).alias("would_trigger_review"),
        F.lit(C.TRIAGE_THRESHOLD).alias("threshold"),
        *C.VECTOR_COLUMNS, "cross_function_calls", "import_complexity", "error_handling_ratio",
    )
