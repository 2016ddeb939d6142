"""Registered scoring queries with their SQL."""

from pyspark.sql import functions as F

from scoreloom.functions import fixed_values as fv
from scoreloom.functions import pillars
from scoreloom.functions.numbers import report_round
from scoreloom.operators import joins, scoring
from scoreloom.plans import scan_queries as scan
from scoreloom.plans.mart_sql import clamp, rounded, with_marts
from scoreloom.plans.marts import Marts
from scoreloom.plans.report_queries import DEFAULT_HP, DONE, TELEMETRY

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = lambda spark, folder: fn(Marts(spark, folder))
        if sql:
            SQL[name] = sql
        return fn
    return add


def scored_questions(m: Marts):
    return joins.scored(m.runs(), m.judge_scores()).join(m.questions(), "question_id")


def rounded_columns(df, keys, columns, digits=6):
    return df.select(*keys, *[report_round(F.col(c), digits).alias(c) for c in columns])


# The weights once more as SQL, written out for the check.
NORM = clamp("judge_score_0_10 / 10")
SUB_SQL = {
    "sql_score": clamp(f"""0.15::DOUBLE * coalesce(syntactic_parse_success, 0.5) + 0.30::DOUBLE * result_set_f1
      + 0.20::DOUBLE * norm + 0.15::DOUBLE * (0.9::DOUBLE * norm) + 0.20::DOUBLE * idiomatic_postgresql"""),
    "conceptual_score": clamp("""0.35::DOUBLE * factual_correctness + 0.25::DOUBLE * completeness
      + 0.20::DOUBLE * absence_of_contradiction + 0.20::DOUBLE * topic_specificity"""),
    "schema_score": clamp("norm * (0.30::DOUBLE + 0.25::DOUBLE * 0.9 + 0.25::DOUBLE * 0.85 + 0.20::DOUBLE * 0.8)"),
    "query_opt_score": clamp("norm * (0.25::DOUBLE + 0.25::DOUBLE * 0.9 + 0.20::DOUBLE * 0.85 + 0.15::DOUBLE * 0.8 + 0.15::DOUBLE * 0.75)"),
    "transaction_score": clamp("0.6::DOUBLE * norm + 0.4::DOUBLE * norm"),
    "reasoning_score": clamp("""0.30::DOUBLE * norm + 0.25::DOUBLE * completeness
      + 0.20::DOUBLE * CASE WHEN has_finding THEN 0.7 ELSE 1.0 END + 0.25::DOUBLE * norm"""),
}
ROUTE = f"""CASE WHEN {scan.IS_SQL} THEN 'sql' WHEN list_contains(tags, 'transactions') THEN 'transaction'
  WHEN list_contains(tags, 'normalization') THEN 'normalization' ELSE 'conceptual' END"""
SUBS = ", ".join(f"{expr} AS {name}" for name, expr in SUB_SQL.items())
SQ = f"""sq AS (SELECT *, {NORM} AS norm, {ROUTE} AS route FROM runs JOIN judge_scores USING (run_id)
  JOIN questions USING (question_id) WHERE {DONE}),
subs AS (SELECT *, {SUBS} FROM sq)"""
MARTS = "runs judge_scores questions"


def sub_query(name, column):
    SQL[name] = with_marts(MARTS, f", {SQ} SELECT run_id, {rounded(column, 6)} AS {column} FROM subs")
    QUERIES[name] = lambda spark, folder: rounded_columns(
        scoring.sub_scores(scored_questions(Marts(spark, folder))), ["run_id"], [column])


for _name, _column in {
    "score_sql": "sql_score", "score_conceptual": "conceptual_score", "score_schema": "schema_score",
    "score_query_opt": "query_opt_score", "score_transaction": "transaction_score",
    "score_reasoning": "reasoning_score",
}.items():
    sub_query(_name, _column)


ROUTED = """CASE route WHEN 'sql' THEN sql_score WHEN 'transaction' THEN transaction_score ELSE conceptual_score END * 100"""


@query("db_correctness", with_marts(MARTS, f", {SQ} SELECT run_id, route, {rounded(ROUTED, 6)} AS db_correctness FROM subs"))
def _(m):
    return rounded_columns(scoring.sub_scores(scored_questions(m)), ["run_id", "route"], ["db_correctness"])


def quality_sql(hallucination="hallucination_rate", fmt="format_compliance_score", verbosity="verbosity_ratio"):
    # a zero F1 is rebuilt from precision .95 x norm and recall completeness
    p, r = "(0.95::DOUBLE * norm)", "completeness"
    f1 = f"CASE WHEN norm <> 0 THEN norm WHEN {p} + {r} = 0 THEN 0 ELSE 2 * {p} * {r} / ({p} + {r}) END"
    return "100 * " + clamp(f"""0.25::DOUBLE * {clamp(f'1 - {hallucination}')} + 0.25::DOUBLE * reasoning_score
      + 0.20::DOUBLE * ({f1}) * CASE WHEN {verbosity} > 3 THEN 0.9 WHEN {verbosity} < 0.5 THEN 0.85 ELSE 1.0 END
      + 0.15::DOUBLE * {fmt} + 0.15::DOUBLE * (0.9::DOUBLE * norm)""")


@query("llm_quality", with_marts(MARTS, f", {SQ} SELECT run_id, {rounded(quality_sql(), 6)} AS llm_quality FROM subs"))
def _(m):
    return rounded_columns(scoring.sub_scores(scored_questions(m)), ["run_id"], ["llm_quality"])


@query("prompting_bundle", with_marts("runs judge_scores", f"""
SELECT run_id, {rounded("100 * " + clamp(f'''0.35::DOUBLE * {clamp('master_composite_score / 100 - 0.5')}
  + 0.20::DOUBLE * {clamp('1 - least(hallucination_rate * 1.5, 1)')} + 0.15::DOUBLE * {clamp('output_tokens / 1000')}
  + 0.15::DOUBLE * {clamp('completeness')} + 0.15::DOUBLE * {clamp('format_compliance_score')}'''), 6)} AS prompting_score
FROM runs JOIN judge_scores USING (run_id) WHERE {DONE}"""))
def _(m):
    c = F.col
    score = pillars.prompting_bundle(
        c("master_composite_score") / 100 - 0.5, c("hallucination_rate") * 1.5,
        c("output_tokens") / 1000, c("completeness"), c("format_compliance_score"))
    rows = joins.scored(m.runs(), m.judge_scores()).withColumn("prompting_score", score)
    return rounded_columns(rows, ["run_id"], ["prompting_score"])


EFFICIENCY = f"""CASE WHEN coalesce(total_latency_ms, 0) = 0 THEN 50 ELSE 100 * {clamp(f'''0.40::DOUBLE * {clamp('1 - ttft_ms / 4500')}
  + 0.35::DOUBLE * {clamp('tokens_per_second / 200')}
  + 0.25::DOUBLE * CASE WHEN cost_usd > 0 THEN {clamp('1 - cost_usd / 0.02::DOUBLE')} ELSE 0.5 END''')} END"""


@query("efficiency", with_marts("runs models", f", {TELEMETRY} SELECT run_id, {rounded(EFFICIENCY, 6)} AS efficiency_score FROM telemetry"))
def _(m):
    c = F.col
    rows = joins.telemetry(m.runs(), m.models()).withColumn("efficiency_score", pillars.efficiency(
        c("ttft_ms"), c("total_latency_ms"), c("tokens_per_second"), c("cost_usd")))
    return rounded_columns(rows, ["run_id"], ["efficiency_score"])


@query("mcs", with_marts("runs judge_scores", f"""
SELECT run_id, {rounded(clamp('''0.50::DOUBLE * db_correctness_score + 0.30::DOUBLE * llm_quality_score
  + 0.15::DOUBLE * prompting_effectiveness_score + 0.05::DOUBLE * efficiency_score''', 0, 100), 6)} AS mcs
FROM runs JOIN judge_scores USING (run_id) WHERE {DONE}"""))
def _(m):
    c = F.col
    rows = joins.scored(m.runs(), m.judge_scores().drop("master_composite_score")).withColumn(
        "mcs", pillars.composite(c("db_correctness_score"), c("llm_quality_score"),
                                 c("prompting_effectiveness_score"), c("efficiency_score")))
    return rounded_columns(rows, ["run_id"], ["mcs"])


# --- prompting effectiveness against the stored baseline ---------------------------

def effect_sql(unbiased):
    current = "0.5::DOUBLE * db_correctness_score + 0.3::DOUBLE * llm_quality_score + 0.05::DOUBLE * efficiency_score"
    current += " + 7.5" if unbiased else ""
    return with_marts("runs judge_scores", f"""
, scored AS (SELECT * FROM runs JOIN judge_scores USING (run_id) WHERE {DONE}),
base AS (SELECT question_id, model_id, master_composite_score AS baseline_mcs FROM scored WHERE prompt_strategy = 'zero-shot'
  QUALIFY row_number() OVER (PARTITION BY question_id, model_id
    ORDER BY hyperparams <> '{DEFAULT_HP}', substr(sha256(hyperparams), 1, 16), run_id) = 1)
SELECT run_id, {rounded(f'''CASE WHEN prompt_strategy = 'zero-shot' OR baseline_mcs IS NULL THEN 50
  ELSE greatest(0.0, least(100.0, 50 + ({current} - baseline_mcs) * (50.0::DOUBLE / 30))) END''', 6)} AS prompting_effectiveness
FROM scored LEFT JOIN base USING (question_id, model_id)""")


def effect(m, unbiased):
    c, scored = F.col, joins.scored(m.runs(), m.judge_scores())
    rows = scored.join(joins.baseline(scored, DEFAULT_HP), ["question_id", "model_id"], "left").withColumn(
        "prompting_effectiveness", pillars.prompting_effectiveness(
            c("prompt_strategy"), c("db_correctness_score"), c("llm_quality_score"),
            c("efficiency_score"), c("baseline_mcs"), unbiased))
    return rounded_columns(rows, ["run_id"], ["prompting_effectiveness"])


@query("prompting_effectiveness", effect_sql(False))
def _(m):
    return effect(m, False)


@query("prompting_effectiveness_unbiased", effect_sql(True))
def _(m):
    return effect(m, True)


# --- the whole scoring job ------------------------------------------------------------

# The telemetry columns of the answers, as the mart derives them.
TEL = """CASE WHEN n_chars % 10 = 0 THEN 0 ELSE n_chars * 2.0::DOUBLE END AS total_latency_ms, n_chars * 0.3::DOUBLE AS ttft_ms,
  n_chars % 300 AS tokens_per_second, n_chars % 7 * 0.004::DOUBLE AS cost_usd"""
JUDGE_FALLBACK = {
    "factual_correctness": "score / 10", "completeness": "score / 10",
    "absence_of_contradiction": "greatest(0, (score - 0.5) / 10)", "topic_specificity": "score / 10",
}
FIELDS = ", ".join(f"coalesce(p.{n}, {e}) AS {n}" for n, e in JUDGE_FALLBACK.items())
PILLARS_SQL = f"""
jf AS (SELECT answer_id, parse_error, judge_score_0_10, {scan.JUDGE_FIELDS},
  coalesce(json_array_length(body->'hallucinations'), 0) AS llm_findings FROM parsed),
auto AS (SELECT answer_id, count(*) AS n, sum({scan.SEVERITY})::DOUBLE AS w FROM found GROUP BY answer_id),
a AS (SELECT answers.*, {TEL}, expected_answer, syntactic_parse_success, result_set_f1, coalesce(n, 0) AS n, coalesce(w, 0) AS w,
    {rounded(scan.IDIOM, 4)} AS idiomatic_postgresql, {scan.compliance_sql('1.0')} AS format_compliance_score
  FROM answers LEFT JOIN refs USING (question_id) LEFT JOIN harness USING (answer_id) LEFT JOIN auto USING (answer_id)),
s AS (SELECT a.*, p.parse_error, p.answer_id IS NULL AS judge_failed, coalesce(p.llm_findings, 0) AS llm_findings,
    coalesce(p.judge_score_0_10, greatest(3.0, 5.0 - least(2.0, 2 * CASE WHEN n = 0 THEN 0 ELSE w / (n * 3) END)))::DOUBLE AS score,
    {FIELDS}
  FROM a LEFT JOIN jf p USING (answer_id)),
t AS (SELECT *, score AS judge_score_0_10, {clamp('score / 10')} AS norm, {ROUTE} AS route, n + llm_findings > 0 AS has_finding,
    CASE WHEN n + llm_findings = 0 THEN 0 ELSE least(1, (w + llm_findings) / ((n + llm_findings) * 3)) END AS hallucination_rate,
    {scan.VERBOSITY} AS verbosity_ratio, {scan.IS_SQL} AND result_set_f1 IS NOT NULL AS sql_scored
  FROM s),
u AS (SELECT * REPLACE (coalesce(result_set_f1, 0) AS result_set_f1) FROM t),
v AS (SELECT *, {SUB_SQL['sql_score']} AS sql_score, {SUB_SQL['conceptual_score']} AS conceptual_score,
    {SUB_SQL['transaction_score']} AS transaction_score, {SUB_SQL['reasoning_score']} AS reasoning_score FROM u),
w AS (SELECT *, 100 * CASE WHEN route = 'sql' AND sql_scored THEN sql_score WHEN route = 'transaction' THEN transaction_score
    ELSE conceptual_score END AS db_correctness_score, {quality_sql()} AS llm_quality_score, {EFFICIENCY} AS efficiency_score FROM v),
base AS (SELECT question_id, model_id, arg_min(0.5::DOUBLE * db_correctness_score + 0.3::DOUBLE * llm_quality_score + 7.5
    + 0.05::DOUBLE * efficiency_score, answer_id) AS baseline_mcs
  FROM w WHERE prompt_strategy = 'zero-shot' GROUP BY ALL),
x AS (SELECT *, CASE WHEN prompt_strategy = 'zero-shot' OR baseline_mcs IS NULL THEN 50.0::DOUBLE ELSE {clamp('''50 + (0.5::DOUBLE * db_correctness_score
    + 0.3::DOUBLE * llm_quality_score + 0.05::DOUBLE * efficiency_score - baseline_mcs) * (50.0::DOUBLE / 30)''', 0.0, 100.0)} END AS prompting_effectiveness_score
  FROM w LEFT JOIN base USING (question_id, model_id)),
y AS (SELECT *, {clamp('''0.5::DOUBLE * db_correctness_score + 0.3::DOUBLE * llm_quality_score + 0.15::DOUBLE * prompting_effectiveness_score
    + 0.05::DOUBLE * efficiency_score''', 0.0, 100.0)} AS master_composite_score FROM x)"""
ALL_SCORES = [
    "judge_score_0_10", "factual_correctness", "completeness", "absence_of_contradiction", "topic_specificity",
    "format_compliance_score", "idiomatic_postgresql", "result_set_f1", "verbosity_ratio", "hallucination_rate",
    "conceptual_score", "reasoning_score", "db_correctness_score", "llm_quality_score", "efficiency_score",
    "prompting_effectiveness_score", "master_composite_score",
]
ALL_ROUNDED = ", ".join(f"{rounded(c, 4)} AS {c}" for c in ALL_SCORES)
SCORE_MARTS = "answers refs harness judge_replies"
SCORE_CTES = f", {scan.ALL_FINDINGS}, {scan.PARSED}, {PILLARS_SQL.replace('(SELECT answers.*, CASE', '(SELECT answers.*, CASE')}"


def score_table(m):
    return scoring.score_runs(m.answer_runs(), m.judge_replies(), m.references(), m.harness(), "{}")


@query("score_runs", with_marts(SCORE_MARTS, f"""{SCORE_CTES}
SELECT answer_id AS run_id, question_id, model_id, prompt_strategy, route, judge_failed, parse_error, has_finding, {ALL_ROUNDED} FROM y"""))
def _(m):
    keys = ["run_id", "question_id", "model_id", "prompt_strategy", "route", "judge_failed", "parse_error", "has_finding"]
    return rounded_columns(score_table(m), keys, ALL_SCORES, 4)


RANGES = ["db_correctness_score", "llm_quality_score", "prompting_effectiveness_score", "efficiency_score", "master_composite_score"]
# The stored scores with two faults put in, so that the checks have something to find.
FAULTY = """faulty AS (SELECT * REPLACE (CASE WHEN judge_score_0_10 = 10 THEN 10.5 ELSE judge_score_0_10 END AS judge_score_0_10,
  CASE WHEN hallucination_rate = 0.75 THEN least(100, master_composite_score + 2) ELSE master_composite_score END AS master_composite_score)
  FROM judge_scores)"""


@query("validate_scores", with_marts("judge_scores", f""", {FAULTY}, n AS (SELECT count(*) AS checked,
  count(*) FILTER (NOT judge_score_0_10 BETWEEN 0 AND 10) AS judge_score_range,
  {", ".join(f"count(*) FILTER (NOT {c} BETWEEN 0 AND 100) AS {c}_range" for c in RANGES)},
  count(*) FILTER (abs(0.5::DOUBLE * db_correctness_score + 0.3::DOUBLE * llm_quality_score + 0.15::DOUBLE * prompting_effectiveness_score
    + 0.05::DOUBLE * efficiency_score - master_composite_score) >= 1) AS mcs_formula,
  {", ".join(f"0::BIGINT AS {w}_weights" for w in scoring.WEIGHT_SETS)} FROM faulty)
SELECT checked, "check", violations FROM (UNPIVOT n ON COLUMNS(* EXCLUDE checked) INTO NAME "check" VALUE violations)"""))
def _(m):
    score, total = F.col("judge_score_0_10"), F.col("master_composite_score")
    faulty = m.judge_scores().withColumns({
        "judge_score_0_10": F.when(score == 10, F.lit(10.5)).otherwise(score),
        "master_composite_score": F.when(
            F.col("hallucination_rate") == 0.75, F.least(F.lit(100.0), total + 2)).otherwise(total),
    })
    return scoring.validate_scores(faulty)
