"""Joins between runs, scores and their dimensions.

No side is broadcast by hint: Spark broadcasts a dimension while its measured
size is under ``spark.sql.autoBroadcastJoinThreshold`` and shuffles it beyond.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.functions import fixed_values as fv
from scoreloom.functions.keys import canonical_json


def scored(runs: DataFrame, scores: DataFrame) -> DataFrame:
    """Completed runs with their score row."""
    return runs.filter(F.col("status") == "completed").join(scores, "run_id")


def with_scores(runs: DataFrame, scores: DataFrame) -> DataFrame:
    """Completed runs, unscored ones included."""
    return runs.filter(F.col("status") == "completed").join(scores, "run_id", "left")


def with_subtopic(runs: DataFrame, questions: DataFrame, subtopics: DataFrame) -> DataFrame:
    return runs.join(questions, "question_id").join(subtopics, "subtopic_id")


def star(runs, scores, models, questions, subtopics, topics) -> DataFrame:
    """Scored runs with model, question, subtopic and topic."""
    return (
        with_subtopic(scored(runs, scores), questions, subtopics)
        .join(topics, "topic_id")
        .join(models, "model_id")
    )


def config_hash():
    """Short hash of the stored configuration text."""
    return F.substring(F.sha2("hyperparams", 256), 1, 16)


def baseline(scored_runs: DataFrame, default_hyperparams: str) -> DataFrame:
    """One baseline score per question and model.

    Where several baseline configurations were run, the default one counts,
    then the one with the smallest hash.
    """
    preference = F.struct(
        (F.col("hyperparams") != default_hyperparams).alias("other"), config_hash().alias("hash"), "run_id",
        "master_composite_score",
    )
    return (
        scored_runs.filter(F.col("prompt_strategy") == fv.BASELINE_STRATEGY)
        .groupBy("question_id", "model_id")
        .agg(F.min_by("master_composite_score", preference).alias("baseline_mcs"))
    )


def with_baseline(scored_runs: DataFrame, default_hyperparams: str) -> DataFrame:
    """Runs of other strategies with the baseline score of their question and model."""
    others = scored_runs.filter(F.col("prompt_strategy") != fv.BASELINE_STRATEGY)
    return others.join(baseline(scored_runs, default_hyperparams), ["question_id", "model_id"])


EXPORT_COLUMNS = [
    "run_id", "model_id", "question_id", "question_type", "prompt_strategy",
    "mcs", "db_correctness", "llm_quality", "hallucination_rate",
    "judge_score_0_10", "total_latency_ms", "cost_usd",
]


def export_rows(runs, scores, models, questions) -> DataFrame:
    """The twelve export columns of every completed run; unscored runs keep nulls."""
    rows = with_scores(runs, scores).join(models, "model_id").join(
        questions.select("question_id", "question_type"), "question_id"
    )
    return rows.withColumn("cost_usd", run_cost()).select(
        *EXPORT_COLUMNS[:5],
        F.col("master_composite_score").alias("mcs"),
        F.col("db_correctness_score").alias("db_correctness"),
        F.col("llm_quality_score").alias("llm_quality"),
        *EXPORT_COLUMNS[8:],
    )


def run_cost():
    """Token cost from the model's prices per thousand tokens."""
    return (
        F.col("input_tokens") / 1000 * F.col("cost_per_1k_input")
        + F.col("output_tokens") / 1000 * F.col("cost_per_1k_output")
    )


def tokens_per_second():
    latency = F.col("total_latency_ms")
    return F.when(latency > 0, F.col("output_tokens") / (latency / 1000)).otherwise(F.lit(0.0))


def time_to_first_token():
    """Share of the latency by provider, with a cap where the provider has one."""
    latency, expr = F.col("total_latency_ms"), None
    for provider, (share, cap) in fv.TTFT_SHARE.items():
        value = latency * share if cap is None else F.least(latency * share, F.lit(cap))
        hit = F.col("provider") == provider
        expr = F.when(hit, value) if expr is None else expr.when(hit, value)
    return expr


def telemetry(runs: DataFrame, models: DataFrame) -> DataFrame:
    """Cost, speed and time to first token of every run."""
    return (
        runs.join(models, "model_id")
        .withColumn("cost_usd", run_cost())
        .withColumn("tokens_per_second", tokens_per_second())
        .withColumn("ttft_ms", time_to_first_token())
    )
