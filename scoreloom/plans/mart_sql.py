"""The marts as SQL, written apart from the DataFrame versions for the checks."""

from scoreloom.functions import fixed_values as fv
from scoreloom.plans.marts import BROKEN_REPLIES, DECORATION, QUESTION_FRAMES, SCHEMA_FIXTURE


def text(value: str) -> str:
    """SQL expression for a literal, with line breaks spelled as chr(10)."""
    parts = ["'" + p.replace("'", "''") + "'" for p in value.split("\n")]
    return "(" + "||chr(10)||".join(parts) + ")"


def rounded(expr: str, digits: int) -> str:
    """Half-up rounding on the decimal value, as a double."""
    return f"CAST(round(CAST(({expr}) AS DECIMAL(38,9)), {digits}) AS DOUBLE)"


def clamp(expr: str, low: float = 0.0, high: float = 1.0) -> str:
    return f"greatest({low}, least({high}, {expr}))"


MARTS = {
    "topics": "SELECT r_regionkey AS topic_id, r_name AS topic FROM region",
    "subtopics": "SELECT n_nationkey AS subtopic_id, n_name AS subtopic, n_regionkey AS topic_id FROM nation",
    "models": """
SELECT s_suppkey AS model_id, s_name AS display_name,
  CASE s_nationkey % 4 WHEN 0 THEN 'openai' WHEN 1 THEN 'anthropic' WHEN 2 THEN 'google' ELSE 'groq' END AS provider,
  (s_suppkey % 5 + 1) * 0.001::DOUBLE AS cost_per_1k_input,
  (s_suppkey % 7 + 1) * 0.002::DOUBLE AS cost_per_1k_output
FROM supplier""",
    "questions": """
SELECT o_orderkey AS question_id, c_nationkey AS subtopic_id,
  CASE o_orderpriority[1] WHEN '1' THEN 'hard' WHEN '2' THEN 'hard' WHEN '3' THEN 'medium' ELSE 'easy' END AS difficulty,
  CASE WHEN o_orderstatus = 'F' THEN 'practical' ELSE 'conceptual' END AS question_type,
  CASE o_orderpriority[1] WHEN '1' THEN ['sql'] WHEN '2' THEN ['sql', 'transactions'] WHEN '3' THEN ['transactions']
    WHEN '4' THEN ['normalization'] ELSE ['database_concepts'] END AS tags,
  o_orderdate AS created_at
FROM orders JOIN customer ON o_custkey = c_custkey""",
    "runs": """
SELECT concat_ws('-', l_orderkey, l_linenumber, l_suppkey, l_partkey, strftime(l_shipdate, '%Y%m%d')) AS run_id,
  l_orderkey AS question_id, l_suppkey AS model_id,
  CASE l_returnflag || l_linestatus WHEN 'NO' THEN 'zero-shot' WHEN 'NF' THEN 'few-shot' WHEN 'AF' THEN 'cot'
    WHEN 'AO' THEN 'few-shot-cot' WHEN 'RF' THEN 'role-prompting' WHEN 'RO' THEN 'react' END AS prompt_strategy,
  '{"temperature": ' || l_tax || ', "top_p": ' || l_discount || '}' AS hyperparams,
  (l_partkey % 900 + 100)::INT AS input_tokens, (l_quantity * 20)::INT AS output_tokens,
  l_extendedprice / 20 AS total_latency_ms, CASE WHEN l_partkey % 3 = 0 THEN 1 ELSE 0 END AS retry_count,
  l_shipdate AS run_timestamp, CASE WHEN l_quantity <= 2 THEN 'failed' ELSE 'completed' END AS status,
  l_linenumber AS attempt, l_tax::VARCHAR AS temperature, l_discount::VARCHAR AS top_p
FROM lineitem""",
    "judge_scores": """
SELECT *, greatest(0.0, least(100.0, 0.5::DOUBLE * db_correctness_score + 0.3::DOUBLE * llm_quality_score
    + 0.15::DOUBLE * prompting_effectiveness_score + 0.05::DOUBLE * efficiency_score)) AS master_composite_score
FROM (SELECT concat_ws('-', l_orderkey, l_linenumber, l_suppkey, l_partkey, strftime(l_shipdate, '%Y%m%d')) AS run_id,
  l_quantity / 5 AS judge_score_0_10, l_quantity * 2 AS db_correctness_score, l_discount * 1000 AS llm_quality_score,
  l_tax * 1250 AS prompting_effectiveness_score, least(100.0, l_extendedprice / 1050) AS efficiency_score,
  (l_partkey % 5) / 4.0::DOUBLE AS format_compliance_score, (l_partkey % 4) / 4.0::DOUBLE AS hallucination_rate,
  l_discount * 10 AS factual_correctness, l_tax / 0.08::DOUBLE AS completeness,
  1 - l_discount * 5 AS absence_of_contradiction, l_linenumber / 7.0::DOUBLE AS topic_specificity,
  l_partkey % 11 / 10.0::DOUBLE AS result_set_f1,
  CASE WHEN l_partkey % 3 <> 0 THEN (l_partkey % 2) * 1.0::DOUBLE END AS syntactic_parse_success,
  l_partkey % 7 / 7.0::DOUBLE AS idiomatic_postgresql, l_partkey % 6 = 0 AS has_finding,
  l_partkey % 400 / 100.0::DOUBLE AS verbosity_ratio
FROM lineitem WHERE l_quantity > 5)""",
    "contest_entries": """
SELECT contest_id, model_id, rank() OVER (PARTITION BY contest_id ORDER BY floor(price / 1000) DESC) AS placement,
  count(*) OVER (PARTITION BY contest_id) AS entrants, min(seen) OVER (PARTITION BY contest_id) AS contest_ts
FROM (SELECT l_orderkey AS contest_id, l_suppkey AS model_id, max(l_extendedprice) AS price, min(l_shipdate) AS seen
      FROM lineitem GROUP BY ALL)
QUALIFY entrants >= 2""",
    "contest_log": """
SELECT e.*, c_nationkey AS league FROM contest_entries e
JOIN orders ON o_orderkey = contest_id JOIN customer ON c_custkey = o_custkey""",
    "answers": f"""
SELECT doc_id AS answer_id, doc_id // 9 AS question_id, lang AS model_id,
  ['zero-shot','one-shot','few-shot','cot','few-shot-cot','self-consistency','role-prompting','least-to-most','react'][doc_id % 9 + 1] AS prompt_strategy,
  CASE WHEN (doc_id // 9) % 2 = 0 THEN 'practical' ELSE 'conceptual' END AS question_type,
  CASE (doc_id // 9) % 5 WHEN 0 THEN ['sql'] WHEN 1 THEN ['sql', 'transactions'] WHEN 2 THEN ['transactions']
    WHEN 3 THEN ['normalization'] ELSE ['database_concepts'] END AS tags,
  CASE doc_id % 3 WHEN 0 THEN 'Answer in one paragraph.' WHEN 1 THEN 'List 3 key points about it.' END AS length_instruction,
  CASE doc_id % 12 WHEN 0 THEN text || {text(DECORATION[0])} WHEN 1 THEN {text(DECORATION[1])} || text
    WHEN 2 THEN {text(DECORATION[2])} || text WHEN 3 THEN text || {text(DECORATION[3])}
    WHEN 4 THEN text || {text(DECORATION[4])} WHEN 5 THEN text || {text(DECORATION[5])}
    WHEN 6 THEN {text(DECORATION[6])} || text WHEN 7 THEN {text(DECORATION[7])} || doc_id || '}}' || chr(10) || '```'
    WHEN 8 THEN text || {text(DECORATION[8])} WHEN 9 THEN text || {text(DECORATION[9])}
    WHEN 10 THEN text || {text(DECORATION[10])} ELSE text END AS answer,
  source, n_chars
FROM documents""",
    "harness": """
SELECT doc_id AS answer_id, CASE WHEN n_chars % 3 <> 0 THEN (n_chars % 2)::DOUBLE END AS syntactic_parse_success,
  CASE WHEN doc_id % 12 IN (0, 8, 9, 10) THEN n_chars % 11 / 10.0::DOUBLE END AS result_set_f1 FROM documents""",
    "refs": "SELECT item_id AS question_id, text AS expected_answer FROM benchmark",
    "judge_replies": f"""
SELECT doc_id AS answer_id, CASE WHEN doc_id % 24 = 4 THEN {text(BROKEN_REPLIES[0])} WHEN doc_id % 24 = 10 THEN {text(BROKEN_REPLIES[1])} ELSE CASE doc_id % 6 WHEN 1 THEN '```json' || chr(10) || body || chr(10) || '```'
  WHEN 2 THEN 'My verdict: ' || body || ' as asked' WHEN 3 THEN 'score is high {{' || quality ELSE body END END AS reply
FROM (SELECT doc_id, quality, '{{"score": ' || (quality * 5 + doc_id % 5) || ', "factual_correctness": ' || (doc_id % 10 / 10.0::DOUBLE)
  || ', "completeness": ' || (doc_id % 7 / 8.0::DOUBLE)
  || CASE WHEN toxic = 1 THEN ', "hallucinations": [{{"type": "contradiction", "text": "claim", "severity": "medium"}}]' ELSE '' END
  || '}}' AS body FROM labels)""",
    "perturbable": f"""
SELECT doc_id AS question_id, CASE doc_id % 8 {" ".join(f"WHEN {i} THEN {text(h)} || text || {text(t)}" for i, (h, t) in QUESTION_FRAMES.items())} END AS question_text
FROM documents""",
    "bank": f"""
SELECT doc_id AS question_id, [{", ".join(text(t) for t in [*fv.SUBTOPIC_TYPES, "OTHER"])}][doc_id % {len(fv.SUBTOPIC_TYPES) + 1} + 1] AS subtopic,
  CASE doc_id % 4 WHEN 0 THEN 'Exercise 3.' || (doc_id % 10) || ': ' || text
    WHEN 1 THEN '## exercise 4.' || (doc_id % 7) || chr(10) || chr(10) || text ELSE text END AS question_text FROM documents""",
    "example_questions": f"""
SELECT doc_id AS question_id, source AS subtopic_id, ['easy', 'medium', 'hard'][n_chars % 3 + 1] AS difficulty, text AS question_text,
  CASE WHEN n_chars % 4 <> 0 THEN 'Answer of ' || lang || ' ' || doc_id END AS expected_answer,
  CASE WHEN doc_id % 10 = 0 THEN {text(SCHEMA_FIXTURE)} END AS schema_fixture FROM documents""",
    "candidate_rows": """
SELECT case_id, candidate_idx, CASE WHEN (case_id + candidate_idx) % 3 = 0 THEN 'qty' ELSE 'amount' END AS value_name, part, quantity
FROM (SELECT l_orderkey AS case_id, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS candidate_idx,
  l_partkey::DOUBLE AS part, l_quantity AS quantity FROM lineitem)""",
    "expected_rows": """
SELECT l_orderkey AS case_id, 'qty' AS value_name, l_partkey::DOUBLE AS part,
  l_quantity + CASE WHEN l_linenumber % 4 = 0 THEN 1 ELSE 0 END AS quantity FROM lineitem WHERE l_linestatus = 'F'""",
    "sheet": r"""
SELECT page_id AS row_no, CASE WHEN page_id % 5 = 0 THEN ' topic ' || (page_id // 5) END AS topic,
  CASE WHEN page_id % 7 = 3 THEN '  ' ELSE 'sub ' || (page_id % 11) || ' ' END AS subtopic,
  CASE WHEN page_id % 3 = 0 THEN 'questions = ["Exercise ' || (page_id % 9) || '.1: What is it?", "'
    || regexp_replace(title, '["\\]', '', 'g') || '", " "]' ELSE title END AS questions,
  CASE WHEN page_id % 3 = 0 THEN '["first answer"]' ELSE 'plain answer' END AS answers
FROM (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages)""",
}
NEEDS = {"contest_log": ["contest_entries"]}


def with_marts(names: str, body: str, recursive: bool = False) -> str:
    """Prefix a query with the marts it reads, given as a space-separated list."""
    ordered = []
    for name in names.split():
        ordered += [n for n in NEEDS.get(name, []) + [name] if n not in ordered]
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(f"{n} AS ({MARTS[n]})" for n in ordered) + "\n" + body
