"""Report aggregates over scored runs and contests."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.functions import fixed_values as fv
from scoreloom.functions.numbers import report_round
from scoreloom.operators.ordering import with_row_number

MCS = "master_composite_score"


def steady(value: Column) -> Column:
    """Average freed of summation noise, so that equal averages tie."""
    return F.round(value, 9)


def contains_text(column: str, part: str) -> Column:
    return F.contains(F.lower(column), F.lit(part.lower()))


def results_summary(
    star: DataFrame, model_id=None, topic=None, subtopic=None, prompt_type=None, difficulty=None
) -> DataFrame:
    """Counts and averages by model, subtopic and strategy, after optional filters."""
    kept = star
    if model_id is not None:
        kept = kept.filter(F.col("model_id") == model_id)
    if topic:
        kept = kept.filter(contains_text("topic", topic))
    if subtopic:
        kept = kept.filter(contains_text("subtopic", subtopic))
    if prompt_type:
        kept = kept.filter(F.col("prompt_strategy") == prompt_type)
    if difficulty:
        kept = kept.filter(F.col("difficulty") == difficulty)

    def mean(column, digits):
        return F.coalesce(report_round(F.avg(column), digits), F.lit(0.0))

    return kept.groupBy("model_id", "display_name", "subtopic", "prompt_strategy").agg(
        F.count("run_id").alias("question_count"),
        mean(MCS, 2).alias("avg_mcs"),
        mean("db_correctness_score", 2).alias("avg_db_correctness"),
        mean("llm_quality_score", 2).alias("avg_llm_quality"),
        mean("hallucination_rate", 4).alias("avg_hallucination_rate"),
        mean("total_latency_ms", 1).alias("avg_latency_ms"),
    )


def page(df: DataFrame, order: list[str], limit: int, offset: int = 0) -> DataFrame:
    """One page of a report in a fixed order."""
    if limit < 1 or offset < 0:
        raise ValueError("limit must be at least 1 and offset at least 0")
    return df.orderBy(*order).offset(offset).limit(limit)


def list_questions(
    bank: DataFrame, topic=None, subtopic=None, question_type=None, difficulty=None, limit: int = 50, offset: int = 0
) -> DataFrame:
    """One page of the question bank by id, with the total number of matches.

    The total is a scalar subquery, so no window runs over all matches and nothing is joined.
    """
    kept = bank
    if topic:
        kept = kept.filter(contains_text("topic", topic))
    if subtopic:
        kept = kept.filter(contains_text("subtopic", subtopic))
    if question_type:
        kept = kept.filter(F.col("question_type") == question_type)
    if difficulty:
        kept = kept.filter(F.col("difficulty") == difficulty)
    return page(kept, ["question_id"], limit, offset).withColumn("total", kept.agg(F.count("*")).scalar())


def model_in_contests(entries: DataFrame, model_id) -> DataFrame:
    """Per contest whether a model took part and whether it is listed first."""
    mine = F.col("model_id") == model_id
    first = F.min_by("model_id", F.struct("placement", "model_id"))
    return entries.groupBy("contest_id").agg(
        F.max(mine).alias("has_model"), (first == model_id).alias("first_is_model")
    )


def param_text(param: str) -> Column:
    return F.get_json_object("hyperparams", f"$.{param}")


def hyperparam_compare(scored: DataFrame, param: str) -> DataFrame:
    """Average and spread per value of one parameter, with the best value and a tier, per model."""
    groups = (
        scored.withColumn("param_value", param_text(param))
        .filter(F.col("param_value").isNotNull())
        .groupBy("model_id", "param_value")
        .agg(
            F.coalesce(F.avg(MCS), F.lit(0.0)).alias("mean"),
            F.stddev_samp(MCS).alias("spread"),
            F.count("run_id").alias("run_count"),
        )
        .withColumn("avg_mcs", report_round(F.col("mean"), 2))
        .withColumn("score_variance", F.coalesce(report_round(F.col("spread"), 4), F.lit(0.0)))
    )
    per_model = Window.partitionBy("model_id")
    width = steady(F.max("avg_mcs").over(per_model) - F.min("avg_mcs").over(per_model))
    best = F.min_by("param_value", F.struct((-steady(F.col("mean"))).alias("m"), "param_value")).over(per_model)
    return groups.select(
        "model_id",
        F.lit(param).alias("param_name"),
        "param_value", "avg_mcs", "score_variance", "run_count",
        best.alias("recommended_value"),
        F.when(width > fv.SENSITIVITY_HIGH, "HIGH").when(width > fv.SENSITIVITY_MEDIUM, "MEDIUM")
        .otherwise("LOW").alias("sensitivity"),
    )


def sweep_curve(scored: DataFrame, param: str) -> DataFrame:
    """Per parameter value the averages, spread and drop from the best value, over all models."""
    groups = (
        scored.withColumn("param_value", param_text(param))
        .filter(F.col("param_value").isNotNull())
        .groupBy("param_value")
        .agg(
            F.avg(MCS).alias("mean"),
            report_round(F.avg("db_correctness_score"), 2).alias("avg_db_correctness"),
            report_round(F.avg("llm_quality_score"), 2).alias("avg_llm_quality"),
            F.coalesce(report_round(F.stddev_samp(MCS), 4), F.lit(0.0)).alias("score_variance"),
            F.count("run_id").alias("run_count"),
        )
    )
    best = groups.agg(F.max("mean")).scalar()
    return groups.withColumn("param_name", F.lit(param)).select(
        "param_name", "param_value",
        report_round(F.col("mean"), 2).alias("avg_mcs"),
        "avg_db_correctness", "avg_llm_quality", "score_variance", "run_count",
        report_round(best - F.col("mean"), 4).alias("drop_from_best"),
    )


def prompts_compare(scored: DataFrame) -> DataFrame:
    """Strategies of each model against its baseline strategy."""
    groups = scored.groupBy("model_id", "prompt_strategy").agg(
        F.coalesce(F.avg(MCS), F.lit(0.0)).alias("mean"),
        F.stddev_samp(MCS).alias("spread"),
        F.avg(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"),
        F.avg("format_compliance_score").alias("format"),
        F.count("run_id").alias("run_count"),
    )
    per_model = Window.partitionBy("model_id")
    base = F.max(F.when(F.col("prompt_strategy") == fv.BASELINE_STRATEGY, F.col("mean"))).over(per_model)
    lift = F.when(
        F.coalesce(F.col("base"), F.lit(0.0)) != 0,
        (F.col("mean") - F.col("base")) / F.greatest(F.col("base"), F.lit(1e-6)),
    ).otherwise(F.lit(0.0))
    tokens = F.when(F.coalesce(F.col("tokens"), F.lit(0.0)) == 0, F.lit(1.0)).otherwise(F.col("tokens"))
    gain = F.when(
        F.col("lift") > 0, F.col("lift") / F.greatest(F.col("mean_tokens") / 1000, F.lit(0.001))
    ).otherwise(F.lit(0.0))
    best = F.min_by("prompt_strategy", F.struct((-steady(F.col("mean"))).alias("m"), "prompt_strategy"))
    return (
        groups.withColumn("base", base)
        .withColumn("lift", lift)
        .withColumn("mean_tokens", tokens)
        .select(
            "model_id",
            F.col("prompt_strategy").alias("strategy"),
            report_round(F.col("mean"), 2).alias("avg_mcs"),
            report_round(F.col("lift"), 4).alias("accuracy_lift_vs_zeroshot"),
            F.coalesce(report_round(F.col("spread"), 4), F.lit(0.0)).alias("consistency_sigma"),
            report_round(F.col("mean_tokens"), 0).alias("avg_tokens"),
            report_round(gain, 4).alias("token_efficiency"),
            F.coalesce(report_round(F.col("format"), 4), F.lit(0.0)).alias("format_compliance_rate"),
            "run_count",
            best.over(per_model).alias("recommended_strategy"),
            F.coalesce(report_round(F.col("base"), 2), F.lit(0.0)).alias("zero_shot_baseline_mcs"),
        )
    )


def _best(name: str, mean: str, sign: int = 1) -> Column:
    """Name with the highest (sign 1) or lowest (sign -1) average, ties by name."""
    key = steady(F.col(mean)) if sign < 0 else -steady(F.col(mean))
    return F.min_by(name, F.struct(key.alias("m"), F.col(name)))


def best_worst_topic(scored_topics: DataFrame) -> DataFrame:
    """Best and worst subtopic of each model by average score."""
    means = scored_topics.groupBy("model_id", "subtopic").agg(
        F.coalesce(F.avg(MCS), F.lit(0.0)).alias("mean")
    )
    return means.groupBy("model_id").agg(
        _best("subtopic", "mean").alias("best_topic"), _best("subtopic", "mean", -1).alias("worst_topic")
    )


def win_rate(entries: DataFrame) -> DataFrame:
    """Contests, wins and win rate per model; only the first listed entry of a contest wins."""
    # a contest adds one row without a total for its winner, so both counts come from one grouping
    winners = entries.groupBy("contest_id").agg(F.min_by("model_id", F.struct("placement", "model_id")).alias("model_id"))
    counts = entries.select("model_id", F.lit(0).alias("won")).unionByName(winners.select("model_id", F.lit(1).alias("won")))
    wins, total = F.col("contest_wins"), F.col("contest_total")
    return counts.groupBy("model_id").agg(
        F.count_if(F.col("won") == 0).alias("contest_total"), F.count_if(F.col("won") == 1).alias("contest_wins")
    ).withColumn("win_rate", report_round(wins / total, 6))


METRICS = {
    "mcs": MCS, "db": "db_correctness_score", "llm": "llm_quality_score",
    "pe": "prompting_effectiveness_score", "eff": "efficiency_score",
    "hr": "hallucination_rate", "lat": "total_latency_ms",
}


def leaderboard_refresh(scored_topics: DataFrame, entries: DataFrame, keep: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """One leaderboard row per model with at least one score.

    The facts are read and shuffled once, into sums per model, subtopic and
    strategy. Grouping sets roll those cells up to models, subtopics and
    strategies in one more pass, from which every column is picked.
    ``keep`` may store the cells, the board without contests and the win rates, so that the shuffles of one step can go before the next.
    """
    keep = keep or (lambda rows, name: rows)
    cells = scored_topics.groupBy("model_id", "subtopic", "prompt_strategy").agg(
        *[F.sum(c).alias(f"sum_{m}") for m, c in METRICS.items()],
        *[F.count(c).alias(f"n_{m}") for m, c in METRICS.items()],
    )
    levels = keep(cells, "cells").groupingSets(
        [["model_id"], ["model_id", "subtopic"], ["model_id", "prompt_strategy"]],
        "model_id", "subtopic", "prompt_strategy",
    ).agg(
        F.grouping_id().alias("level"),
        *[(F.sum(f"sum_{m}") / F.sum(f"n_{m}")).alias(m) for m in METRICS],
    ).withColumn("mean", F.coalesce("mcs", F.lit(0.0)))
    model, subtopic, strategy = (F.col("level") == n for n in (0b011, 0b001, 0b010))

    def overall(m):
        return F.max(F.when(model, F.col(m)))

    def best(level, name, sign):
        key = F.struct((sign * steady(F.col("mean"))).alias("m"), F.col(name))
        return F.min_by(name, F.when(level, key))

    def or_zero(m, digits):
        return F.coalesce(report_round(overall(m), digits), F.lit(0.0))

    def or_neutral(m):
        return report_round(F.coalesce(F.nullif(overall(m), F.lit(0.0)), F.lit(50.0)), 2)

    board = levels.groupBy("model_id").agg(
        report_round(overall("mcs"), 2).alias("mcs_score"),
        or_zero("db", 2).alias("db_correctness"),
        or_zero("llm", 2).alias("llm_quality"),
        or_neutral("pe").alias("prompting_effectiveness"),
        or_neutral("eff").alias("efficiency_score"),
        or_zero("hr", 4).alias("hallucination_rate"),
        or_zero("lat", 1).alias("avg_latency_ms"),
        best(subtopic, "subtopic", -1).alias("best_topic"),
        best(subtopic, "subtopic", 1).alias("worst_topic"),
        best(strategy, "prompt_strategy", -1).alias("best_prompt_strategy"),
    ).filter(F.col("mcs_score").isNotNull())
    return keep(board, "board").join(keep(win_rate(entries), "win-rates"), "model_id", "left").fillna(0, ["contest_total", "contest_wins"])


SORT_AXES = ["mcs_score", "elo_rating", "win_rate", "db_correctness", "llm_quality"]


def leaderboard(board: DataFrame, models: DataFrame, ratings: DataFrame | None = None, sort_by: str = "mcs_score") -> DataFrame:
    """Leaderboard rows ranked by one axis, nulls last, ties by model.

    ``ratings`` has model_id and rating; a model without contests has a null elo_rating.
    """
    rows = board.join(models.select("model_id", "display_name", "provider"), "model_id")
    if ratings is not None:
        rows = rows.join(ratings.select("model_id", F.col("rating").alias("elo_rating")), "model_id", "left")
    if sort_by not in SORT_AXES or sort_by not in rows.columns:
        raise ValueError(f"cannot sort by {sort_by}: the axes are {', '.join(a for a in SORT_AXES if a in rows.columns)}")
    return with_row_number(rows, [F.col(sort_by).desc_nulls_last(), F.col("model_id")], "rank")


def leaderboard_totals(board: DataFrame, entries: DataFrame, runs: DataFrame) -> DataFrame:
    """Number of models on the board, of contests and of runs."""
    parts = {
        "total_models": board.agg(F.count("*").alias("n")),
        "total_contests": entries.agg(F.count_distinct("contest_id").alias("n")),
        "total_runs": runs.agg(F.count("*").alias("n")),
    }
    counts = None
    for name, part in parts.items():
        part = part.withColumn("name", F.lit(name))
        counts = part if counts is None else counts.unionByName(part)
    return counts.agg(*[F.sum(F.when(F.col("name") == name, F.col("n"))).alias(name) for name in parts])


LEAST_TOPICS = 5


def topic_breakdown(star: DataFrame, least_topics: int = LEAST_TOPICS) -> DataFrame:
    """Runs and average per topic, how many topics have a score at all, and whether those are at least ``least_topics``."""
    topics = star.groupBy("topic").agg(F.count("run_id").alias("run_count"), report_round(F.avg(MCS), 2).alias("avg_mcs"))
    scored = F.count("avg_mcs").over(Window.partitionBy())  # a row per topic
    return topics.withColumn("scored_topics", scored).withColumn("enough_topics", F.col("scored_topics") >= least_topics)


def subtopic_counts(questions: DataFrame, subtopics: DataFrame) -> DataFrame:
    return (
        questions.groupBy("subtopic_id").agg(F.count("*").alias("questions"))
        .join(subtopics, "subtopic_id").select("subtopic", "questions")
    )


def distinct_scored_models(runs: DataFrame, scores: DataFrame) -> DataFrame:
    done = runs.filter(F.col("status") == "completed")
    return done.join(scores, "run_id", "left_semi").select("model_id").distinct()


def hallucination_rate(scored: DataFrame) -> DataFrame:
    """Share of responses with a finding, next to the average severity stored per run."""
    return scored.groupBy("model_id").agg(
        F.count("*").alias("responses"),
        report_round(F.avg(F.col("has_finding").cast("double")) * 100, 4).alias("response_rate_pct"),
        report_round(F.avg("hallucination_rate"), 4).alias("avg_severity"),
    )


def check_summary(checks: DataFrame) -> DataFrame:
    """Passed and failed checks per section, with a grand-total row (null section)."""
    return checks.rollup("section").agg(
        F.count("*").alias("total"),
        F.count_if("passed").alias("passed"),
        F.count_if(~F.col("passed")).alias("failed"),
        report_round(F.avg(F.col("passed").cast("double")) * 100, 1).alias("pass_rate"),
        F.count_if(~F.col("passed") & F.col("critical")).alias("critical_failures"),
    )


def ops_telemetry(run_telemetry: DataFrame, scores: DataFrame) -> DataFrame:
    """Latency, speed, retries and cost per correct answer of each model."""
    rows = run_telemetry.join(scores.select("run_id", "judge_score_0_10"), "run_id", "left")
    correct = F.count_if(F.col("judge_score_0_10") >= fv.CORRECT_JUDGE_SCORE)
    ttft, retries = F.avg("ttft_ms"), F.avg((F.col("retry_count") > 0).cast("double"))
    return rows.groupBy("model_id").agg(
        F.count("*").alias("runs"),
        report_round(F.avg("total_latency_ms"), 1).alias("avg_latency_ms"),
        report_round(ttft, 1).alias("avg_ttft_ms"),
        (ttft <= fv.TTFT_TARGET_MS).alias("ttft_on_target"),
        report_round(F.avg("tokens_per_second"), 2).alias("avg_tokens_per_second"),
        report_round(F.sum("cost_usd"), 4).alias("total_cost_usd"),
        report_round(retries, 4).alias("retry_rate"),
        (retries < fv.RETRY_RATE_TARGET).alias("retry_on_target"),
        correct.alias("correct_answers"),
        report_round(F.sum("cost_usd") / F.nullif(correct, F.lit(0)), 6).alias("cost_per_correct"),
    )


def strategy_per_subtopic(all_runs_topics: DataFrame, scores: DataFrame) -> DataFrame:
    """Best strategy per model and subtopic, the fixed default where nothing is scored."""
    rows = all_runs_topics.join(scores.select("run_id", MCS), "run_id", "left")
    means = rows.groupBy("model_id", "subtopic", "prompt_strategy").agg(F.avg(MCS).alias("mean"))
    default = F.lit(fv.FALLBACK_STRATEGY)
    for subtopic, strategy in fv.SUBTOPIC_DEFAULT_STRATEGY.items():
        default = F.when(F.upper("subtopic") == subtopic, strategy).otherwise(default)
    best = F.min_by("prompt_strategy", F.when(
        F.col("mean").isNotNull(), F.struct((-steady(F.col("mean"))).alias("m"), "prompt_strategy")
    ))
    return means.groupBy("model_id", "subtopic").agg(best.alias("measured")).select(
        "model_id", "subtopic", F.coalesce("measured", default).alias("best_strategy"),
        F.col("measured").isNull().alias("is_default"),
    )


def audit_counts(runs: DataFrame, scores: DataFrame, default_hyperparams: str) -> DataFrame:
    """Done and attempted generations, scores and contests of each phase."""
    base = F.col("prompt_strategy") == fv.BASELINE_STRATEGY
    phase = (
        F.when(~base, "phase2").when(F.col("hyperparams") == default_hyperparams, "phase1").otherwise("phase3")
    )
    done = F.col("status") == "completed"
    rows = runs.withColumn("phase", phase).join(
        scores.select("run_id", F.lit(True).alias("is_scored")), "run_id", "left"
    )
    steps = rows.groupBy("phase").agg(
        F.count_if(done).alias("generated"), F.count("*").alias("attempted"),
        F.count_if(done & F.col("is_scored")).alias("scored"),
    ).select("phase", F.explode(F.array(
        F.struct(F.lit("generate").alias("step"), F.col("generated").alias("ok"), F.col("attempted").alias("total")),
        F.struct(F.lit("score").alias("step"), F.col("scored").alias("ok"), F.col("generated").alias("total")),
    )).alias("s")).select("phase", "s.*")
    # a contest needs two models; min and max tell one from several without a distinct list
    model = F.when(done, F.col("model_id"))
    contests = runs.filter(base).groupBy("question_id").agg(
        (F.min(model) < F.max(model)).alias("ready")
    ).agg(
        F.lit("phase1").alias("phase"), F.lit("contest").alias("step"),
        F.count_if(F.col("ready")).alias("ok"), F.count("*").alias("total"),
    )
    return steps.unionByName(contests)
