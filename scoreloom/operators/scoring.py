"""From answers, judge replies and run telemetry to the composite score."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.functions import answer_text as at
from scoreloom.functions import fixed_values as fv
from scoreloom.functions import pillars, tags
from scoreloom.operators import answer_scan
from scoreloom.operators.joins import baseline
from scoreloom.session import new_folder


def sub_scores(scored_questions: DataFrame) -> DataFrame:
    """Every sub-score and pillar of stored judge fields; needs the question's type and tags."""
    c = F.col
    norm = pillars.judge_norm(c("judge_score_0_10"))
    conceptual = pillars.conceptual_score(
        c("factual_correctness"), c("completeness"), c("absence_of_contradiction"), c("topic_specificity")
    )
    sql = pillars.sql_score(
        c("syntactic_parse_success"), c("result_set_f1"), norm, norm * 0.9, c("idiomatic_postgresql")
    )
    route = tags.correctness_route(c("question_type"), c("tags"))
    reasoning = pillars.reasoning_score(norm, c("completeness"), c("has_finding"), norm)
    return scored_questions.withColumns({
        "route": route,
        "sql_score": sql,
        "conceptual_score": conceptual,
        "schema_score": pillars.schema_score(norm),
        "query_opt_score": pillars.query_opt_score(norm),
        "transaction_score": pillars.transaction_score(norm, norm),
        "reasoning_score": reasoning,
    }).withColumns({
        "db_correctness": pillars.db_correctness(c("route"), c("sql_score"), c("transaction_score"), c("conceptual_score")),
        "llm_quality": pillars.llm_quality(
            c("hallucination_rate"), c("reasoning_score"), norm, norm * 0.95, c("completeness"),
            c("verbosity_ratio"), c("format_compliance_score"), norm * 0.9,
        ),
    })


def severity(found: Column) -> Column:
    weights = F.aggregate(
        found, F.lit(0.0), lambda total, f: total + pillars.severity_weight(f["severity"])
    )
    return pillars.severity_of(weights, F.size(found))


def _judge_findings(found: Column) -> Column:
    return F.transform(found, lambda f: F.struct(
        f["type"].alias("hallucination_type"), f["text"].alias("description"),
        f["severity"].alias("severity"), F.lit("llm_judge").alias("detected_by"),
    ))


def judged(answers: DataFrame, replies: DataFrame, references: DataFrame, harness: DataFrame) -> DataFrame:
    """Answers with findings, format score, judge fields and all pillars but the prompting one.

    ``harness`` holds the outcome of running the answer's SQL (parse success and
    result-set F1, null F1 where the answer holds no SQL).
    """
    c = F.col
    answers, text = at.searchable(answers, "answer")
    # everything that needs the text is computed before the first join, which
    # then moves a few numbers per answer instead of the text
    scanned = answers.withColumns({
        "auto_findings": at.automated_findings(text),
        "format_compliance_score": answer_scan.format_compliance(c("question_type"), c("tags"), text),
        "idiomatic_postgresql": at.idiom_score(text),
        "answer_words": at.word_count(text.raw),
    }).drop("answer", "answer__folded")
    rows = (
        scanned.join(answer_scan.reference_sizes(references), "question_id", "left")
        .join(answer_scan.parse_judge_replies(replies), "answer_id", "left")
        .join(harness, "answer_id", "left")
        .withColumns({
            "expected_words": F.coalesce("expected_words", F.lit(fv.DEFAULT_EXPECTED_WORDS)),
            "judge_failed": c("judge_score_0_10").isNull(),
        })
    )
    score = F.coalesce(c("judge_score_0_10"), pillars.fallback_judge_score(severity(c("auto_findings"))))
    rows = rows.withColumn("judge_score_0_10", score)
    fallback = answer_scan.fallback_fields(c("judge_score_0_10"))
    all_findings = F.concat(
        c("auto_findings"), F.coalesce(_judge_findings(c("judge_findings")), at.no_findings())
    )
    harness_ran = tags.needs_sql_harness(c("question_type"), c("tags")) & c("result_set_f1").isNotNull()
    rows = rows.withColumns({
        **{name: F.coalesce(c(name), value) for name, value in fallback.items()},
        "findings": all_findings,
        "sql_scored": harness_ran,
    })
    norm = pillars.judge_norm(c("judge_score_0_10"))
    return rows.withColumns({
        "hallucination_rate": severity(c("findings")),
        "has_finding": F.size("findings") > 0,
        "verbosity_ratio": c("answer_words") / c("expected_words"),
        "result_set_f1": F.coalesce(c("result_set_f1"), F.lit(0.0)),
    }).transform(sub_scores).withColumns({
        "db_correctness_score": pillars.db_correctness(
            c("route"), F.when(c("sql_scored"), c("sql_score")), c("transaction_score"), c("conceptual_score")
        ),
        "llm_quality_score": c("llm_quality"),
        "efficiency_score": pillars.efficiency(
            c("ttft_ms"), c("total_latency_ms"), c("tokens_per_second"), c("cost_usd")
        ),
        "norm_score": norm,
    }).drop("db_correctness", "llm_quality", "auto_findings", "judge_findings")


SCORE_COLUMNS = [
    "run_id", "question_id", "model_id", "prompt_strategy", "hyperparams", "route", "judge_failed",
    "parse_error", "judge_score_0_10", "factual_correctness", "completeness",
    "absence_of_contradiction", "topic_specificity", "format_compliance_score",
    "idiomatic_postgresql", "result_set_f1", "verbosity_ratio", "hallucination_rate", "has_finding",
    "conceptual_score", "reasoning_score",
    "db_correctness_score", "llm_quality_score", "efficiency_score",
]


def with_prompting(rows: DataFrame, default_hyperparams: str, unbiased: bool = False) -> DataFrame:
    """Add the prompting pillar and the composite to rows that have the other three pillars.

    The rows hold numbers only by now, yet come from a scan of the answer texts;
    they are written once, so that the baseline side reads a few of their columns and does not scan the texts again.
    """
    folder = new_folder(rows.sparkSession, "scores")
    rows.write.parquet(folder)
    rows = rows.sparkSession.read.schema(rows.schema).parquet(folder)
    c = F.col
    pillar_columns = (c("db_correctness_score"), c("llm_quality_score"), c("efficiency_score"))
    neutral = pillars.composite(pillar_columns[0], pillar_columns[1], F.lit(50.0), pillar_columns[2])
    base = baseline(rows.withColumn("master_composite_score", neutral), default_hyperparams)
    effect = pillars.prompting_effectiveness(
        c("prompt_strategy"), *pillar_columns, c("baseline_mcs"), unbiased
    )
    return (
        rows.join(base, ["question_id", "model_id"], "left")
        .withColumn("prompting_effectiveness_score", effect)
        .withColumn("master_composite_score", pillars.composite(
            pillar_columns[0], pillar_columns[1], c("prompting_effectiveness_score"), pillar_columns[2]
        ))
        .drop("baseline_mcs")
    )


def score_runs(answers, replies, references, harness, default_hyperparams: str) -> DataFrame:
    """Score table of a run table: one row per answer with every sub-score and the composite."""
    rows = judged(answers, replies, references, harness).withColumn("run_id", F.col("answer_id"))
    return with_prompting(rows.select(*SCORE_COLUMNS), default_hyperparams)


def validate_scores(scores: DataFrame) -> DataFrame:
    """Checked rows and violations of every rule on a score table."""
    c = F.col
    pillar_names = [
        "db_correctness_score", "llm_quality_score", "prompting_effectiveness_score",
        "efficiency_score", "master_composite_score",
    ]
    expected = (
        0.5 * c("db_correctness_score") + 0.3 * c("llm_quality_score")
        + 0.15 * c("prompting_effectiveness_score") + 0.05 * c("efficiency_score")
    )
    checks = {"judge_score_range": F.coalesce(c("judge_score_0_10").between(0, 10), F.lit(False))}
    checks |= {f"{n}_range": F.coalesce(c(n).between(0, 100), F.lit(False)) for n in pillar_names}
    checks["mcs_formula"] = F.coalesce(F.abs(expected - c("master_composite_score")) < 1.0, F.lit(True))
    for name, weights in WEIGHT_SETS.items():
        checks[f"{name}_weights"] = F.lit(abs(sum(weights.values()) - 1.0) < 0.001)
    counts = scores.agg(
        F.count("*").alias("checked"), *[F.count_if(~ok).alias(name) for name, ok in checks.items()]
    )
    return counts.select("checked", F.explode(F.create_map(*[
        x for name in checks for x in (F.lit(name), c(name))
    ])).alias("check", "violations"))


WEIGHT_SETS = {
    "sql": fv.SQL_WEIGHTS, "conceptual": fv.CONCEPTUAL_WEIGHTS, "llm_quality": fv.LLM_QUALITY_WEIGHTS,
    "mcs": fv.MCS_WEIGHTS, "prompting": fv.PROMPTING_WEIGHTS, "efficiency": fv.EFFICIENCY_WEIGHTS,
}
