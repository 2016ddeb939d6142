"""Registered answer-scan queries with their SQL."""

from pyspark.sql import functions as F

from scoreloom.functions import answer_text as at
from scoreloom.functions import fixed_values as fv
from scoreloom.functions import pillars, tags
from scoreloom.functions.numbers import report_round
from scoreloom.functions.strict_json import json_valid_score
from scoreloom.operators import answer_scan, scoring
from scoreloom.plans.mart_sql import rounded, text, with_marts
from scoreloom.plans.marts import Marts

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = lambda spark, folder: fn(Marts(spark, folder))
        if sql:
            SQL[name] = sql
        return fn
    return add


def per_answer(name, sql_score, score):
    """Register a score per answer."""
    def run(spark, folder):
        answers, text = at.searchable(Marts(spark, folder).answers(), "answer")
        return answers.select("answer_id", score(text).cast("double").alias("score"))

    SQL[name] = with_marts("answers", f"SELECT answer_id, CAST({sql_score} AS DOUBLE) AS score FROM answers")
    QUERIES[name] = run


def words_sql(column):
    return rf"len(regexp_extract_all({column}, '\S+'))"


# --- format -------------------------------------------------------------------

SQL_BLOCK = r"""(SELECT CASE WHEN block <> '' THEN greatest(0.5::DOUBLE, 1.0::DOUBLE - least(0.5::DOUBLE, 0.15::DOUBLE * len(list_filter(
    lines[2:len(lines) - 1], lambda l: NOT regexp_matches(l, '(?i)^\s*(?:%s)') AND regexp_matches(l, '(?s)\S.{19,}\S')))))
  WHEN regexp_matches(answer, '(?i)\b(SELECT|INSERT|UPDATE|DELETE|CREATE TABLE|CREATE INDEX)\b') THEN 0.3::DOUBLE ELSE 0 END
  FROM (SELECT block, string_split(block, chr(10)) AS lines FROM (SELECT regexp_extract(answer, '(?s)```(?:sql|SQL)\s*\n.*?```') AS block)))""" % fv.SQL_LINE_START
STEPS = r"len(list_filter(string_split(answer, chr(10)), lambda l: regexp_matches(l, '(?i)^\s*(\d+\.|step\s+\d+:|\d+\)|\(\d+\))')))"
NUMBERED = f"CASE WHEN {STEPS} >= 3 THEN 1.0 WHEN {STEPS} >= 1 THEN 0.5 ELSE 0 END"
SCHEMA = r"""CASE WHEN regexp_matches(answer, '(?i)\bCREATE\s+TABLE\b') THEN least(1.0::DOUBLE, 0.7::DOUBLE
  + CASE WHEN regexp_matches(answer, '(?i)\bFOREIGN\s+KEY\b') THEN 0.2::DOUBLE ELSE 0 END
  + CASE WHEN regexp_matches(answer, '(?i)\b(ALTER\s+TABLE|CREATE\s+INDEX)\b') THEN 0.1::DOUBLE ELSE 0 END)
  WHEN regexp_matches(answer, '(?i)\b(primary key|foreign key|table|column|attribute|entity|relation)\b') THEN 0.3::DOUBLE ELSE 0 END"""
BULLETS = r"len(list_filter(string_split(answer, chr(10)), lambda l: regexp_matches(l, '^\s*[-•*\d]')))"
LENGTH = rf"""CASE WHEN answer = '' OR length_instruction IS NULL THEN 1.0
  WHEN length_instruction ILIKE '%one paragraph%' THEN CASE WHEN
    len(list_filter(string_split(answer, chr(10) || chr(10)), lambda p: regexp_matches(p, '\S'))) = 1
    AND {words_sql('answer')} BETWEEN 30 AND 250 THEN 1.0 ELSE 0.4 END
  WHEN regexp_matches(lower(length_instruction), 'list\s+\d+\s+key\s+points?') THEN CASE WHEN
    abs({BULLETS} - regexp_extract(lower(length_instruction), 'list\s+(\d+)', 1)::INT) <= 1 THEN 1.0 ELSE 0.5 END
  ELSE 1.0 END"""
STRIPPED = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '^\s+|\s+$', '', 'g'),
  '(?m)^```(?:json)?\s*', '', 'g'), '(?m)\s*```$', '', 'g'), '^\s+|\s+$', '', 'g')"""

per_answer("format_sql_block", SQL_BLOCK, at.sql_block_score)
per_answer("format_numbered_steps", NUMBERED, lambda t: at.numbered_score(t.raw))
per_answer("format_schema", SCHEMA, at.schema_score)
per_answer("format_json_valid", f"json_valid({STRIPPED.format('answer')})::INT", lambda t: json_valid_score(t.raw))
per_answer("format_length", LENGTH, lambda t: at.length_score(t.raw, F.col("length_instruction")))

IS_SQL = "(question_type = 'practical' AND list_contains(tags, 'sql'))"
IS_STEPS = "(question_type = 'practical' AND list_contains(tags, 'transactions'))"


def compliance_sql(length):
    return rounded(f"""0.25::DOUBLE * 1.0 + 0.2::DOUBLE * CASE WHEN {IS_SQL} THEN {SQL_BLOCK} ELSE 1.0 END
  + 0.2::DOUBLE * CASE WHEN {IS_STEPS} THEN {NUMBERED} ELSE 1.0 END
  + 0.2::DOUBLE * CASE WHEN {IS_SQL} THEN {SCHEMA} ELSE 1.0 END + 0.15::DOUBLE * {length}""", 4)


@query("format_compliance", with_marts("answers", f"""
SELECT model_id, prompt_strategy, count(*) AS answers, {rounded('avg(score)', 4)} AS avg_format_compliance
FROM (SELECT *, {compliance_sql(LENGTH)} AS score FROM answers) GROUP BY ALL"""))
def _(m):
    return answer_scan.compliance_by_strategy(m.answers())


@query("route_by_tags", with_marts("questions", f"""
SELECT question_id, {IS_SQL} AS sql_harness, list_contains(tags, 'sql') AS sql_rubric, {IS_STEPS} AS numbered_steps,
  CASE WHEN {IS_SQL} THEN 'sql' WHEN list_contains(tags, 'transactions') THEN 'transaction'
    WHEN list_contains(tags, 'normalization') THEN 'normalization' ELSE 'conceptual' END AS route FROM questions"""))
def _(m):
    kind, names = F.col("question_type"), F.col("tags")
    return m.questions().select(
        "question_id",
        tags.needs_sql_harness(kind, names).alias("sql_harness"),
        tags.needs_sql_rubric(names).alias("sql_rubric"),
        tags.needs_numbered_steps(kind, names).alias("numbered_steps"),
        tags.correctness_route(kind, names).alias("route"))


# --- findings -------------------------------------------------------------------

IGNORED = ", ".join(f"'{n}'" for n in fv.SQL_KEYWORDS_BEFORE_PAREN + fv.KNOWN_SQL_FUNCTIONS)
UNKNOWN = rf"""SELECT answer_id, model_id, 'fabricated_sql_function' AS hallucination_type,
  'Unknown PostgreSQL function: ' || name || '(…)' AS description, 'critical' AS severity, 'regex+pg_catalog' AS detected_by
FROM (SELECT answer_id, model_id, unnest(list_distinct(regexp_extract_all(answer, '\b([A-Za-z_][A-Za-z0-9_]*)\s*\(', 1))) AS name FROM answers)
WHERE lower(name) NOT IN ({IGNORED}) AND regexp_matches(name, '(?i)^(pg_\w+|[A-Z]{{2,}}_\w+)')"""
INVENTED = " UNION ALL ".join(
    rf"SELECT answer_id, model_id, 'invented_constraint_type', {text('Non-existent PostgreSQL construct matching: ' + p)}, 'high', 'regex' "
    rf"FROM answers WHERE regexp_matches(answer, '(?i){p}')" for p in fv.INVENTED_CONSTRAINTS)
INVENTED = INVENTED.replace("'invented_constraint_type',", "'invented_constraint_type' AS hallucination_type,", 1)
FACTS = " UNION ALL ".join(
    f"SELECT answer_id, model_id, 'wrong_fact' AS hallucination_type, {text(d)} AS description, '{s}' AS severity, "
    f"'ground_truth_comparison' AS detected_by FROM answers WHERE regexp_matches(lower(answer), '{p}')"
    for p, d, s in fv.WRONG_FACTS)
INVENTED_NAMED = f"SELECT answer_id, model_id, hallucination_type, #4 AS description, #5 AS severity, #6 AS detected_by FROM ({INVENTED})"
INVENTED_NAMED = INVENTED.replace("'high', 'regex' FROM", "'high' AS severity, 'regex' AS detected_by FROM", 1).replace(
    ", 'high' AS severity", " AS description, 'high' AS severity", 1)
ALL_FINDINGS = f"found AS ({UNKNOWN} UNION ALL {INVENTED} UNION ALL {FACTS})"


@query("scan_unknown_functions", with_marts("answers", UNKNOWN))
def _(m):
    return answer_scan.findings(m.answers(), lambda t: at.unknown_function_findings(t.raw))


@query("scan_invented_constraints", with_marts("answers", INVENTED_NAMED))
def _(m):
    return answer_scan.findings(m.answers(), at.invented_constraint_findings)


@query("scan_wrong_facts", with_marts("answers", FACTS))
def _(m):
    return answer_scan.findings(m.answers(), at.wrong_fact_findings)


@query("finding_counts", with_marts("answers", f""", {ALL_FINDINGS}
SELECT model_id, hallucination_type, severity, count(*) AS findings FROM found GROUP BY ALL"""))
def _(m):
    return answer_scan.finding_counts(answer_scan.findings(m.answers()))


SEVERITY = "CASE severity WHEN 'critical' THEN 3.0 WHEN 'high' THEN 2.0 WHEN 'medium' THEN 1.0 ELSE 0.5 END"


@query("severity_score", with_marts("answers", f""", {ALL_FINDINGS}
SELECT answer_id, count(*) AS findings, count(*) FILTER (severity = 'critical') AS critical_count,
  count(*) FILTER (severity = 'high') AS high_count,
  {rounded(f"least(1, sum({SEVERITY})::DOUBLE / (count(*) * 3))", 6)} AS severity_score FROM found GROUP BY answer_id"""))
def _(m):
    return answer_scan.severity_by_answer(answer_scan.findings(m.answers()))


JUDGED = """judged AS (SELECT answer_id, model_id, 'contradiction' AS hallucination_type, 'claim' AS description,
  'medium' AS severity, 'llm_judge' AS detected_by FROM judge_replies JOIN answers USING (answer_id)
  WHERE reply LIKE '%"hallucinations"%')"""


def judge_rows(m):
    parsed = answer_scan.parse_judge_replies(m.judge_replies())
    found = parsed.select("answer_id", F.explode("judge_findings").alias("f"))
    return found.join(m.answers().select("answer_id", "model_id"), "answer_id").select(
        "answer_id", "model_id", F.col("f.type").alias("hallucination_type"),
        F.col("f.text").alias("description"), F.col("f.severity").alias("severity"),
        F.lit("llm_judge").alias("detected_by"))


@query("merge_findings", with_marts("answers judge_replies", f""", {ALL_FINDINGS}, {JUDGED}
SELECT * FROM found UNION ALL SELECT * FROM judged"""))
def _(m):
    return answer_scan.merge_findings(answer_scan.findings(m.answers()), judge_rows(m))


# --- idioms, candidates, renames --------------------------------------------------

FEATURES = " + ".join(f"regexp_matches(answer, '(?i){p}')::INT" for p in fv.IDIOM_PATTERNS)
BASE = rf"""greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.15::DOUBLE * ({FEATURES})) - 0.1::DOUBLE * (
  (regexp_matches(answer, '(?i)\bCAST\s*\(') AND NOT contains(answer, '::'))::INT
  + (regexp_matches(answer, '(?i)FROM\s*\(\s*SELECT') AND NOT regexp_matches(answer, '(?i)\bLATERAL\b'))::INT))"""
IDIOM = rf"""CASE WHEN ({FEATURES}) = 0 AND regexp_matches(upper(answer), '\b(SELECT|INSERT|UPDATE|DELETE)\b')
  THEN greatest({BASE}, 0.5::DOUBLE) ELSE {BASE} END"""
per_answer("idiom_score", rounded(IDIOM, 4), at.idiom_score)

TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
KEYWORDS = "|".join(fv.STATEMENT_STARTS)


def first_statement_sql(block):
    bare = TRIM.format(r"regexp_replace(s, '--[^\n]*', '', 'g')")
    return (rf"coalesce(list_filter(list_transform(string_split({block}, ';'), lambda s: {bare}), "
            rf"lambda t: regexp_matches(t, '(?i)^(?:{KEYWORDS})\b'))[1], {TRIM.format(block)})")


LOOSE = rf"(?is)((?:{KEYWORDS})\b.*?)(?:\n\n|\z)"


@query("extract_sql_candidates", with_marts("answers", rf"""
, b AS (SELECT answer_id, answer, regexp_extract_all(answer, '(?s)```(?:sql|SQL)?\s*\n(.*?)```', 1) AS blocks FROM answers),
f AS (SELECT *, list_filter(list_transform(blocks, lambda b: {first_statement_sql('b')}),
  lambda q: regexp_matches(q, '(?i)^\s*(SELECT|WITH|EXPLAIN)\b')) AS fenced,
  CASE WHEN len(blocks) > 0 THEN blocks[1] WHEN regexp_matches(answer, '{LOOSE}') THEN regexp_extract(answer, '{LOOSE}', 1)
    WHEN regexp_matches(answer, '(?i)({KEYWORDS})') THEN answer END AS single FROM b),
s AS (SELECT answer_id, CASE WHEN len(fenced) > 0 THEN fenced
  WHEN regexp_matches({first_statement_sql('single')}, '(?i)^\s*(SELECT|WITH|EXPLAIN)\b') THEN [{first_statement_sql('single')}]
  ELSE [] END AS found FROM f)
SELECT answer_id, (unnest(range(len(found))))::INT AS candidate_idx, unnest(found) AS sql FROM s"""))
def _(m):
    return answer_scan.sql_candidates(m.answers())


RENAMES = {"en": {"the": "t_article", "with": "t_prep"}, "fr": {"le": "t_le", "que": "t_que"}}


def rename_sql(names):
    expr = "answer"
    for old, new in names.items():
        for _ in range(2):  # neighbours share a separator, so every other hit is left to a second pass
            expr = rf"regexp_replace({expr}, '(^|[^\p{{L}}\p{{N}}_]){old}($|[^\p{{L}}\p{{N}}_])', '\1{new}\2', 'g')"
    return expr


@query("rename_identifiers", with_marts("answers", f"""
SELECT answer_id, md5(CASE model_id WHEN 'en' THEN {rename_sql(RENAMES['en'])} WHEN 'fr' THEN {rename_sql(RENAMES['fr'])}
  ELSE answer END) AS renamed_md5 FROM answers"""))
def _(m):
    maps = m.spark.createDataFrame(list(RENAMES.items()), "model_id string, names map<string,string>")
    return answer_scan.rename_identifiers(m.answers(), maps, "model_id").select(
        "answer_id", F.md5("answer").alias("renamed_md5"))


# --- lengths and judge replies -------------------------------------------------------

REF_WORDS = f"CASE WHEN coalesce(expected_answer, '') = '' THEN 100 ELSE greatest({words_sql('expected_answer')}, 1) END"
VERBOSITY = f"{words_sql('answer')} / ({REF_WORDS})"


@query("verbosity_ratio", with_marts("answers refs", f"""
SELECT answer_id, {rounded('r', 6)} AS verbosity_ratio, CAST(CASE WHEN r > 3 THEN 0.9 WHEN r < 0.5 THEN 0.85 ELSE 1 END AS DOUBLE) AS verbosity_factor
FROM (SELECT answer_id, {VERBOSITY} AS r FROM answers LEFT JOIN refs USING (question_id))"""))
def _(m):
    return answer_scan.verbosity(m.answers(), m.references())


@query("truncate_for_judge", with_marts("answers refs", """
SELECT answer_id, CASE WHEN length(expected_answer) > 2000 THEN substr(expected_answer, 1, 2000) || chr(10) || chr(10)
    || '[TRUNCATED — original length ' || length(expected_answer) || ' chars; key points above are sufficient for scoring]'
  ELSE expected_answer END AS judge_reference,
  CASE WHEN length(answer) > 3000 THEN substr(answer, 1, 3000) || chr(10) || chr(10)
    || '[TRUNCATED — original length ' || length(answer) || ' chars]' ELSE answer END AS judge_answer
FROM answers LEFT JOIN refs USING (question_id)"""))
def _(m):
    return answer_scan.truncate_for_judge(m.answers(), m.references())


PARSED = f"""cleaned AS (SELECT answer_id, {STRIPPED.format('reply')} AS c FROM judge_replies),
bodies AS (SELECT answer_id, CASE WHEN json_valid(c) THEN c WHEN json_valid(inner_c) THEN inner_c END AS body
  FROM (SELECT *, regexp_extract(c, '(?s)\\{{.*\\}}') AS inner_c FROM cleaned)),
parsed AS (SELECT answer_id, parse_error, body,
  CASE WHEN parse_error THEN 5 ELSE coalesce(TRY_CAST(body->>'score' AS DOUBLE), 5) END AS judge_score_0_10
  FROM (SELECT *, body IS NULL OR {" OR ".join(f"(body->>'{n}' IS NOT NULL AND TRY_CAST(body->>'{n}' AS DOUBLE) IS NULL)" for n in ("score", *fv.CONCEPTUAL_WEIGHTS))} AS parse_error
        FROM bodies))"""


def judge_field(name):
    return f"CASE WHEN parse_error THEN 0.5::DOUBLE ELSE coalesce(TRY_CAST(body->>'{name}' AS DOUBLE), judge_score_0_10 / 10) END AS {name}"


JUDGE_FIELDS = ", ".join(judge_field(n) for n in fv.CONCEPTUAL_WEIGHTS)


@query("parse_judge_json", with_marts("judge_replies", f""", {PARSED}
SELECT answer_id, parse_error, judge_score_0_10, {JUDGE_FIELDS},
  (coalesce(json_array_length(body->'hallucinations'), 0))::INT AS judge_findings FROM parsed"""))
def _(m):
    parsed = answer_scan.parse_judge_replies(m.judge_replies())
    return parsed.withColumn("judge_findings", F.size("judge_findings"))


@query("judge_fallback", with_marts("answers judge_replies", f""", {ALL_FINDINGS},
sev AS (SELECT answer_id, least(1, sum({SEVERITY})::DOUBLE / (count(*) * 3)) AS severity FROM found GROUP BY answer_id),
s AS (SELECT answer_id, greatest(3.0, 5.0 - least(2.0, 2 * coalesce(severity, 0)))::DOUBLE AS score
  FROM answers ANTI JOIN judge_replies USING (answer_id) LEFT JOIN sev USING (answer_id))
SELECT answer_id, {rounded('score', 6)} AS judge_score_0_10, {rounded('score / 10', 6)} AS factual_correctness,
  {rounded('greatest(0, (score - 0.5) / 10)', 6)} AS absence_of_contradiction FROM s"""))
def _(m):
    unjudged = m.answers().join(m.judge_replies(), "answer_id", "left_anti")
    unjudged, text = at.searchable(unjudged, "answer")
    score = pillars.fallback_judge_score(scoring.severity(at.automated_findings(text)))
    rows = unjudged.select("answer_id", score.alias("score"))
    fields = answer_scan.fallback_fields(F.col("score"))
    return rows.select(
        "answer_id", report_round(F.col("score"), 6).alias("judge_score_0_10"),
        report_round(fields["factual_correctness"], 6).alias("factual_correctness"),
        report_round(fields["absence_of_contradiction"], 6).alias("absence_of_contradiction"))
