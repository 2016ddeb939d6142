"""Schemas of the evaluation tables."""

from pyspark.sql.types import StructType

_DDL = {
    "question_bank": (
        "id string, topic string, subtopic string, exercise_number string, question_text string, "
        "expected_answer string, question_type string, difficulty string, tags array<string>"
    ),
    "question_sheet": "row_no long, topic string, subtopic string, questions string, answers string",
    "topics": "id string, name string",
    "subtopics": "id string, topic_id string, name string",
    "models": (
        "id string, model_id string, display_name string, provider string, api_model string, is_judge boolean, "
        "cost_per_1k_input double, cost_per_1k_output double, max_context_tokens int, supports_seed boolean"
    ),
    "runs": (
        "run_id string, question_id string, model_id string, prompt_strategy string, hyperparam_hash string, "
        "hyperparams string, answer string, input_tokens int, output_tokens int, cost_usd double, ttft_ms double, "
        "total_latency_ms double, tokens_per_second double, retry_count int, run_timestamp timestamp, status string"
    ),
    "contests": (
        "contest_id string, league string, contest_ts timestamp, model_id string, label string, placement int"
    ),
    "findings": (
        "run_id string, hallucination_type string, description string, severity string, detected_by string"
    ),
    "result_rows": "case_id string, candidate_idx int, row map<string,string>",
    "exported_runs": (
        "run_id string, model_id long, question_id long, question_type string, prompt_strategy string, mcs double, "
        "db_correctness double, llm_quality double, hallucination_rate double, judge_score_0_10 double, "
        "total_latency_ms double, cost_usd double"
    ),
}


def schema(name: str) -> StructType:
    return StructType.fromDDL(_DDL[name])
