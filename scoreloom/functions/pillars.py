"""Sub-score, pillar and composite formulas as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from scoreloom.functions import fixed_values as fv
from scoreloom.functions.numbers import clamp, harmonic, weighted


def judge_norm(score_0_10: Column) -> Column:
    return clamp(score_0_10 / 10.0)


def sql_score(parse, f1, clause, constraint, idiom) -> Column:
    return weighted(fv.SQL_WEIGHTS, {
        "syntactic_parse_success": F.coalesce(parse, F.lit(0.5)),
        "result_set_f1": f1,
        "clause_appropriateness": clause,
        "constraint_correctness": constraint,
        "idiomatic_postgresql": idiom,
    })


def conceptual_score(factual, complete, consistent, specific) -> Column:
    return weighted(fv.CONCEPTUAL_WEIGHTS, {
        "factual_correctness": factual,
        "completeness": complete,
        "absence_of_contradiction": consistent,
        "topic_specificity": specific,
    })


def schema_score(norm: Column) -> Column:
    return weighted(fv.SCHEMA_WEIGHTS, {
        "entity_coverage": norm,
        "fk_correctness": norm * 0.9,
        "normalization_compliance": norm * 0.85,
        "index_appropriateness": norm * 0.8,
    })


def query_opt_score(norm: Column) -> Column:
    return weighted(fv.QUERY_OPT_WEIGHTS, {
        "join_algorithm_selection": norm,
        "index_selectivity_reasoning": norm * 0.9,
        "cost_estimation_accuracy": norm * 0.85,
        "plan_tree_correctness": norm * 0.8,
        "optimization_hint_usage": norm * 0.75,
    })


def transaction_score(auto: Column, judge: Column) -> Column:
    return weighted(fv.TRANSACTION_WEIGHTS, {"auto_score": auto, "judge_score": judge})


def db_correctness(route: Column, sql: Column, transaction: Column, conceptual: Column) -> Column:
    """Pillar of the routed scorer; the conceptual one where that scorer is absent."""
    routed = F.when(route == "sql", sql).when(route == "transaction", transaction)
    return F.coalesce(routed, conceptual, F.lit(0.0)) * 100.0


def reasoning_score(coherence, steps, has_finding, self_consistency) -> Column:
    return weighted(fv.REASONING_WEIGHTS, {
        "logical_coherence": coherence,
        "step_completeness": steps,
        "error_propagation": F.when(has_finding, F.lit(0.7)).otherwise(F.lit(1.0)),
        "self_consistency": self_consistency,
    })


def verbosity_factor(ratio: Column) -> Column:
    return (
        F.when(ratio > fv.VERBOSITY_HIGH, F.lit(fv.VERBOSITY_HIGH_FACTOR))
        .when(ratio < fv.VERBOSITY_LOW, F.lit(fv.VERBOSITY_LOW_FACTOR))
        .otherwise(F.lit(1.0))
    )


def llm_quality(hallucination, reasoning, f1, precision, recall, verbosity, fmt, consistency) -> Column:
    """Quality pillar; a zero or missing F1 is rebuilt from precision and recall."""
    text_f1 = F.when(F.coalesce(f1, F.lit(0.0)) != 0, f1).otherwise(harmonic(precision, recall))
    return weighted(fv.LLM_QUALITY_WEIGHTS, {
        "hallucination_inverted": clamp(1.0 - hallucination),
        "reasoning": F.coalesce(reasoning, F.lit(0.5)),
        "text_f1": text_f1 * verbosity_factor(verbosity),
        "format_compliance": fmt,
        "consistency": consistency,
    }) * 100.0


def prompting_bundle(lift, sigma, token_efficiency, depth, fmt) -> Column:
    return weighted(fv.PROMPTING_WEIGHTS, {
        "accuracy_lift": clamp(lift),
        "low_variance": clamp(1.0 - F.least(sigma, F.lit(1.0))),
        "token_efficiency": clamp(token_efficiency),
        "reasoning_depth": clamp(depth),
        "format_compliance": clamp(fmt),
    }) * 100.0


def prompting_effectiveness(strategy, db, quality, eff, baseline_mcs, unbiased: bool = False) -> Column:
    """50 for the baseline strategy or without a baseline, else 50 plus the scaled lift.

    The current side leaves out the prompting term while the baseline is a full
    composite, so equal quality lands below 50; ``unbiased`` adds the neutral
    term back to the current side.
    """
    current = db * 0.5 + quality * 0.3 + eff * 0.05
    if unbiased:
        current = current + F.lit(50.0 * fv.MCS_WEIGHTS["prompting_effectiveness"])
    lifted = clamp(50.0 + (current - baseline_mcs) * (50.0 / 30.0), 0.0, 100.0)
    neutral = (strategy == fv.BASELINE_STRATEGY) | baseline_mcs.isNull()
    return F.when(neutral, F.lit(50.0)).otherwise(lifted)


def efficiency(ttft_ms, latency_ms, tps, cost) -> Column:
    """Efficiency pillar, neutral where no latency was recorded."""
    ttft = F.coalesce(ttft_ms, F.lit(0.0))
    paid = F.coalesce(cost, F.lit(0.0))
    score = weighted(fv.EFFICIENCY_WEIGHTS, {
        "ttft": clamp(1.0 - ttft / (fv.TTFT_TARGET_MS * 3.0)),
        "tokens_per_second": clamp(F.coalesce(tps, F.lit(0.0)) / 200.0),
        "cost": F.when(paid > 0, clamp(1.0 - paid / 0.02)).otherwise(F.lit(0.5)),
    }) * 100.0
    return F.when(F.coalesce(latency_ms, F.lit(0.0)) == 0, F.lit(50.0)).otherwise(score)


def composite(db, quality, prompting, eff) -> Column:
    w = fv.MCS_WEIGHTS
    return clamp(
        F.lit(w["db_correctness"]) * db
        + F.lit(w["llm_quality"]) * quality
        + F.lit(w["prompting_effectiveness"]) * prompting
        + F.lit(w["efficiency"]) * eff,
        0.0,
        100.0,
    )


def severity_weight(severity: Column) -> Column:
    expr = None
    for name, weight in fv.SEVERITY_WEIGHTS.items():
        hit = severity == name
        expr = F.when(hit, F.lit(weight)) if expr is None else expr.when(hit, F.lit(weight))
    return expr.otherwise(F.lit(fv.UNKNOWN_SEVERITY_WEIGHT))


def severity_of(weight_sum: Column, findings: Column) -> Column:
    """Summed weight over the largest possible weight, 0 without findings."""
    worst = fv.SEVERITY_WEIGHTS["critical"]
    return F.when(findings == 0, F.lit(0.0)).otherwise(
        F.least(weight_sum / (findings * worst), F.lit(1.0))
    )


def fallback_judge_score(severity: Column) -> Column:
    """Score used where no judge reply arrived."""
    return F.greatest(F.lit(3.0), 5.0 - F.least(severity * 2, F.lit(2.0)))
