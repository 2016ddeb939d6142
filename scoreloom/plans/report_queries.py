"""Registered report queries with their SQL."""

from functools import reduce

from pyspark.sql import functions as F

from scoreloom.functions.numbers import report_round
from scoreloom.operators import joins, ratings, reports
from scoreloom.plans.mart_sql import rounded, with_marts
from scoreloom.plans.marts import Marts
from scoreloom.plans.rating_queries import REPLAY_CTES, REPLAY_RATINGS
from scoreloom.session import new_folder
from scoreloom.sources import files

DEFAULT_HP = '{"temperature": 0.03, "top_p": 0.05}'
STAR_MARTS = "runs judge_scores models questions subtopics topics"
STAR = """runs JOIN judge_scores USING (run_id) JOIN models USING (model_id) JOIN questions USING (question_id)
JOIN subtopics USING (subtopic_id) JOIN topics USING (topic_id)"""
DONE = "status = 'completed'"
MCS = "master_composite_score"


def star(m: Marts):
    return joins.star(m.runs(), m.judge_scores(), m.models(), m.questions(), m.subtopics(), m.topics())


def scored(m: Marts):
    return joins.scored(m.runs(), m.judge_scores())


def scored_topics(m: Marts):
    return joins.with_subtopic(scored(m), m.questions(), m.subtopics())


def board(m: Marts):
    return reports.leaderboard_refresh(scored_topics(m), m.contest_entries())


def kept(m: Marts, rows, name):
    """Rows written before the next step reads them, without the shuffles they came from."""
    return m.spark.read.schema(rows.schema).parquet(files.staged(rows, new_folder(m.spark, name)))


SLICES = 4


def slices(m: Marts) -> list[tuple]:
    """Runs and score rows dealt by run id: those of a run are in one slice, so slices can be joined one after the other."""
    number = F.pmod(F.xxhash64("run_id"), F.lit(SLICES))
    return [(m.runs().filter(number == n), m.judge_scores().filter(number == n)) for n in range(SLICES)]


QUERIES, SQL = {}, {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = lambda spark, folder: fn(Marts(spark, folder))
        if sql:
            SQL[name] = sql
        return fn
    return add


SUMMARY_SQL = with_marts(STAR_MARTS, f"""
SELECT model_id, display_name, subtopic, prompt_strategy, count(*) AS question_count,
  {rounded(f'avg({MCS})', 2)} AS avg_mcs, {rounded('avg(db_correctness_score)', 2)} AS avg_db_correctness,
  {rounded('avg(llm_quality_score)', 2)} AS avg_llm_quality, {rounded('avg(hallucination_rate)', 4)} AS avg_hallucination_rate,
  {rounded('avg(total_latency_ms)', 1)} AS avg_latency_ms
FROM {STAR} WHERE {DONE} GROUP BY ALL""")


@query("results_summary", SUMMARY_SQL)
def _(m):
    return reports.results_summary(star(m))


@query("results_summary_filtered", SUMMARY_SQL.replace(
    f"WHERE {DONE}", f"WHERE {DONE} AND topic ILIKE '%asia%' AND difficulty = 'hard' AND prompt_strategy = 'cot'"))
def _(m):
    return reports.results_summary(star(m), topic="asia", prompt_type="cot", difficulty="hard")


@query("page_results", SUMMARY_SQL + " ORDER BY model_id, subtopic, prompt_strategy LIMIT 500 OFFSET 100")
def _(m):
    rows = reports.results_summary(star(m))
    return reports.page(rows, ["model_id", "subtopic", "prompt_strategy"], 500, 100)


@query("star_join_runs", with_marts(STAR_MARTS, f"""
SELECT run_id, model_id, display_name, provider, question_id, difficulty, question_type, subtopic, topic,
  prompt_strategy, {MCS}, judge_score_0_10 FROM {STAR} WHERE {DONE}"""))
def _(m):
    return star(m).select(
        "run_id", "model_id", "display_name", "provider", "question_id", "difficulty", "question_type",
        "subtopic", "topic", "prompt_strategy", MCS, "judge_score_0_10")


@query("left_join_scores", with_marts("runs judge_scores", f"""
SELECT run_id, model_id, question_id, prompt_strategy, judge_score_0_10, {MCS}, judge_score_0_10 IS NULL AS unscored
FROM runs LEFT JOIN judge_scores USING (run_id) WHERE {DONE}"""))
def _(m):
    rows = joins.with_scores(m.runs(), m.judge_scores())
    return rows.selectExpr(
        "run_id", "model_id", "question_id", "prompt_strategy", "judge_score_0_10", MCS,
        "judge_score_0_10 IS NULL AS unscored")


@query("zero_shot_baseline", with_marts("runs judge_scores", f"""
, scored AS (SELECT * FROM runs JOIN judge_scores USING (run_id) WHERE {DONE}),
base AS (SELECT question_id, model_id, {MCS} AS baseline_mcs FROM scored WHERE prompt_strategy = 'zero-shot'
  QUALIFY row_number() OVER (PARTITION BY question_id, model_id
    ORDER BY hyperparams <> '{DEFAULT_HP}', substr(sha256(hyperparams), 1, 16), run_id) = 1)
SELECT run_id, question_id, model_id, prompt_strategy, {rounded(MCS, 6)} AS mcs,
  {rounded('baseline_mcs', 6)} AS baseline_mcs, {rounded(f'{MCS} - baseline_mcs', 6)} AS lift
FROM scored JOIN base USING (question_id, model_id) WHERE prompt_strategy <> 'zero-shot'"""))
def _(m):
    rows = joins.with_baseline(scored(m), DEFAULT_HP)
    return rows.select(
        "run_id", "question_id", "model_id", "prompt_strategy",
        report_round(F.col(MCS), 6).alias("mcs"),
        report_round(F.col("baseline_mcs"), 6).alias("baseline_mcs"),
        report_round(F.col(MCS) - F.col("baseline_mcs"), 6).alias("lift"))


EXPORT_SQL = with_marts("runs judge_scores models questions", f"""
SELECT run_id, model_id, question_id, question_type, prompt_strategy, {MCS} AS mcs, db_correctness_score AS db_correctness,
  llm_quality_score AS llm_quality, hallucination_rate, judge_score_0_10, total_latency_ms,
  input_tokens / 1000 * cost_per_1k_input + output_tokens / 1000 * cost_per_1k_output AS cost_usd
FROM runs LEFT JOIN judge_scores USING (run_id) JOIN models USING (model_id) JOIN questions USING (question_id)
WHERE {DONE}""")


def exported(m, fmt):
    """Write the export and read it back."""
    rows = joins.export_rows(m.runs(), m.judge_scores(), m.models(), m.questions())
    path = new_folder(m.spark, f"export-{fmt}")
    (files.write_runs_json if fmt == "json" else files.write_runs_csv)(rows, path)
    return files.read_exported_runs(m.spark, path, fmt)


@query("export_runs_json", EXPORT_SQL)
def _(m):
    return exported(m, "json")


@query("export_runs_csv", EXPORT_SQL)
def _(m):
    return exported(m, "csv")


def hyperparam_sql(param):
    return with_marts("runs judge_scores", f"""
, g AS (SELECT model_id, {param} AS param_value, avg({MCS}) AS mean, stddev_samp({MCS}) AS spread, count(*) AS run_count
  FROM runs JOIN judge_scores USING (run_id) WHERE {DONE} GROUP BY ALL),
r AS (SELECT *, {rounded('mean', 2)} AS avg_mcs, coalesce({rounded('spread', 4)}, 0.0) AS score_variance FROM g),
w AS (SELECT model_id, arg_min(param_value, (round(-mean, 9), param_value)) AS recommended_value,
  round(max(avg_mcs) - min(avg_mcs), 9) AS width FROM r GROUP BY model_id)
SELECT model_id, '{param}' AS param_name, param_value, avg_mcs, score_variance::DOUBLE AS score_variance, run_count,
  recommended_value, CASE WHEN width > 15 THEN 'HIGH' WHEN width > 7 THEN 'MEDIUM' ELSE 'LOW' END AS sensitivity
FROM r JOIN w USING (model_id)""")


@query("hyperparam_compare", hyperparam_sql("temperature"))
def _(m):
    return reports.hyperparam_compare(scored(m), "temperature")


@query("hyperparam_compare_top_p", hyperparam_sql("top_p"))
def _(m):
    return reports.hyperparam_compare(scored(m), "top_p")


@query("sweep_curve", with_marts("runs judge_scores", f"""
, g AS (SELECT temperature AS param_value, avg({MCS}) AS mean, avg(db_correctness_score) AS db,
  avg(llm_quality_score) AS llm, stddev_samp({MCS}) AS spread, count(*) AS run_count
  FROM runs JOIN judge_scores USING (run_id) WHERE {DONE} GROUP BY ALL)
SELECT 'temperature' AS param_name, param_value, {rounded('mean', 2)} AS avg_mcs, {rounded('db', 2)} AS avg_db_correctness,
  {rounded('llm', 2)} AS avg_llm_quality, coalesce({rounded('spread', 4)}, 0.0::DOUBLE) AS score_variance, run_count,
  {rounded('max(mean) OVER () - mean', 4)} AS drop_from_best FROM g"""))
def _(m):
    return reports.sweep_curve(scored(m), "temperature")


@query("prompts_compare", with_marts("runs judge_scores", f"""
, g AS (SELECT model_id, prompt_strategy AS strategy, avg({MCS}) AS mean, stddev_samp({MCS}) AS spread,
  avg(input_tokens + output_tokens) AS tokens, avg(format_compliance_score) AS format, count(*) AS run_count
  FROM runs JOIN judge_scores USING (run_id) WHERE {DONE} GROUP BY ALL),
b AS (SELECT model_id, max(CASE WHEN strategy = 'zero-shot' THEN mean END) AS base,
  arg_min(strategy, (round(-mean, 9), strategy)) AS recommended_strategy FROM g GROUP BY model_id),
l AS (SELECT *, CASE WHEN coalesce(base, 0) <> 0 THEN (mean - base) / greatest(base, 1e-6) ELSE 0 END AS lift
  FROM g JOIN b USING (model_id))
SELECT model_id, strategy, {rounded('mean', 2)} AS avg_mcs, {rounded('lift', 4)} AS accuracy_lift_vs_zeroshot,
  coalesce({rounded('spread', 4)}, 0.0::DOUBLE) AS consistency_sigma, {rounded('tokens', 0)} AS avg_tokens,
  {rounded('CASE WHEN lift > 0 THEN lift / greatest(tokens / 1000, 0.001) ELSE 0 END', 4)} AS token_efficiency,
  coalesce({rounded('format', 4)}, 0.0::DOUBLE) AS format_compliance_rate, run_count, recommended_strategy,
  coalesce({rounded('base', 2)}, 0.0::DOUBLE) AS zero_shot_baseline_mcs FROM l"""))
def _(m):
    return reports.prompts_compare(scored(m))


BEST_WORST = f"""topic_means AS (SELECT model_id, subtopic, round(avg({MCS}), 9) AS mean FROM st GROUP BY ALL),
best_worst AS (SELECT model_id, arg_min(subtopic, (-mean, subtopic)) AS best_topic,
  arg_min(subtopic, (mean, subtopic)) AS worst_topic FROM topic_means GROUP BY model_id)"""
ST = f"""st AS (SELECT * FROM runs JOIN judge_scores USING (run_id) JOIN questions USING (question_id)
JOIN subtopics USING (subtopic_id) WHERE {DONE})"""


@query("best_worst_topic", with_marts("runs judge_scores questions subtopics", f""", {ST}, {BEST_WORST}
SELECT * FROM best_worst"""))
def _(m):
    return reports.best_worst_topic(scored_topics(m))


WINS = f"""wins AS (SELECT model_id, count(*) AS contest_total, count(*) FILTER (first_listed = model_id) AS contest_wins
FROM (SELECT *, first(model_id) OVER (PARTITION BY contest_id ORDER BY placement, model_id) AS first_listed
      FROM contest_entries) GROUP BY model_id)"""
WIN_RATE = rounded("contest_wins / contest_total", 6)


@query("win_rate", with_marts("contest_entries", f", {WINS} SELECT *, {WIN_RATE} AS win_rate FROM wins"))
def _(m):
    return reports.win_rate(m.contest_entries())


BOARD_MARTS = "runs judge_scores questions subtopics contest_entries models"
BOARD = f""", {ST}, {BEST_WORST}, {WINS},
strategy_means AS (SELECT model_id, prompt_strategy, round(avg({MCS}), 9) AS mean FROM st GROUP BY ALL),
strategies AS (SELECT model_id, arg_min(prompt_strategy, (-mean, prompt_strategy)) AS best_prompt_strategy
  FROM strategy_means GROUP BY model_id),
board AS (SELECT model_id, {rounded(f'avg({MCS})', 2)} AS mcs_score, {rounded('avg(db_correctness_score)', 2)} AS db_correctness,
  {rounded('avg(llm_quality_score)', 2)} AS llm_quality,
  {rounded('coalesce(nullif(avg(prompting_effectiveness_score), 0), 50)', 2)} AS prompting_effectiveness,
  {rounded('coalesce(nullif(avg(efficiency_score), 0), 50)', 2)} AS efficiency_score,
  {rounded('avg(hallucination_rate)', 4)} AS hallucination_rate, {rounded('avg(total_latency_ms)', 1)} AS avg_latency_ms,
  any_value(best_topic) AS best_topic, any_value(worst_topic) AS worst_topic,
  any_value(best_prompt_strategy) AS best_prompt_strategy, coalesce(any_value(contest_total), 0) AS contest_total,
  coalesce(any_value(contest_wins), 0) AS contest_wins, any_value({WIN_RATE}) AS win_rate
FROM st JOIN best_worst USING (model_id) JOIN strategies USING (model_id) LEFT JOIN wins USING (model_id) GROUP BY model_id)"""


@query("leaderboard_refresh", with_marts(BOARD_MARTS, BOARD + " SELECT * FROM board"))
def _(m):
    return board(m)


@query("leaderboard", with_marts(BOARD_MARTS, BOARD + """
SELECT b.*, display_name, provider, row_number() OVER (ORDER BY win_rate DESC NULLS LAST, model_id) AS rank
FROM board b JOIN models USING (model_id)"""))
def _(m):
    return reports.leaderboard(board(m), m.models(), sort_by="win_rate")


# the best rating that a model reached in any league
ELO = f"elo AS (SELECT model_id, max(rating) AS elo_rating FROM ({REPLAY_RATINGS}) GROUP BY model_id)"


def best_ratings(m):
    return ratings.final_ratings(ratings.elo_history(m.contest_log())).groupBy("model_id").agg(F.max("rating").alias("rating"))


@query("leaderboard_by_elo", with_marts(BOARD_MARTS + " contest_log", f"""{REPLAY_CTES}{BOARD}, {ELO}
SELECT b.*, elo_rating, display_name, provider, row_number() OVER (ORDER BY elo_rating DESC NULLS LAST, model_id) AS rank
FROM board b JOIN models USING (model_id) LEFT JOIN elo USING (model_id)""", recursive=True))
def _(m):
    """The facts, the board, the win rates and the ratings are written one after the other, so their shuffles are never on disk together."""
    def keep(rows, name):
        return kept(m, rows, name)

    facts = files.staged_parts([
        joins.with_subtopic(joins.scored(*part), m.questions(), m.subtopics()).select("model_id", "subtopic", "prompt_strategy", *reports.METRICS.values())
        for part in slices(m)], new_folder(m.spark, "facts"))
    refreshed = reports.leaderboard_refresh(facts, m.contest_entries(), keep)
    return reports.leaderboard(refreshed, m.models(), keep(best_ratings(m), "ratings"), "elo_rating")


@query("leaderboard_totals", with_marts(BOARD_MARTS, BOARD + """
SELECT (SELECT count(*) FROM board) AS total_models, (SELECT count(DISTINCT contest_id) FROM contest_entries) AS total_contests,
  (SELECT count(*) FROM runs) AS total_runs"""))
def _(m):
    return reports.leaderboard_totals(board(m), m.contest_entries(), m.runs())


@query("topic_breakdown", with_marts(STAR_MARTS, f"""
SELECT topic, count(*) AS run_count, {rounded(f'avg({MCS})', 2)} AS avg_mcs, count(avg({MCS})) OVER () AS scored_topics, count(avg({MCS})) OVER () >= 5 AS enough_topics
FROM {STAR} WHERE {DONE} GROUP BY topic"""))
def _(m):
    return reports.topic_breakdown(star(m))


@query("subtopic_counts", with_marts("questions subtopics", """
SELECT subtopic, count(*) AS questions FROM questions JOIN subtopics USING (subtopic_id) GROUP BY subtopic"""))
def _(m):
    return reports.subtopic_counts(m.questions(), m.subtopics())


@query("distinct_scored_models", with_marts("runs judge_scores", f"""
SELECT DISTINCT model_id FROM runs SEMI JOIN judge_scores USING (run_id) WHERE {DONE}"""))
def _(m):
    return reports.distinct_scored_models(m.runs(), m.judge_scores())


@query("hallucination_rate", with_marts("runs judge_scores", f"""
SELECT model_id, count(*) AS responses, {rounded('avg(has_finding::INT) * 100', 4)} AS response_rate_pct,
  {rounded('avg(hallucination_rate)', 4)} AS avg_severity
FROM runs JOIN judge_scores USING (run_id) WHERE {DONE} GROUP BY model_id"""))
def _(m):
    return reports.hallucination_rate(scored(m))


@query("check_summary", with_marts("runs", """
SELECT prompt_strategy AS section, count(*) AS total, count(*) FILTER (status = 'completed') AS passed,
  count(*) FILTER (status <> 'completed') AS failed,
  """ + rounded("avg((status = 'completed')::INT) * 100", 1) + """ AS pass_rate,
  count(*) FILTER (status <> 'completed' AND retry_count > 0) AS critical_failures
FROM runs GROUP BY ROLLUP (prompt_strategy)"""))
def _(m):
    return reports.check_summary(m.runs().selectExpr(
        "prompt_strategy AS section", "status = 'completed' AS passed", "retry_count > 0 AS critical"))


TELEMETRY = """telemetry AS (SELECT *, input_tokens / 1000 * cost_per_1k_input + output_tokens / 1000 * cost_per_1k_output AS cost_usd,
  CASE WHEN total_latency_ms > 0 THEN output_tokens / (total_latency_ms / 1000) ELSE 0 END AS tokens_per_second,
  CASE provider WHEN 'openai' THEN total_latency_ms * 0.15::DOUBLE WHEN 'anthropic' THEN total_latency_ms * 0.12::DOUBLE
    WHEN 'google' THEN total_latency_ms * 0.10::DOUBLE WHEN 'groq' THEN least(total_latency_ms * 0.08::DOUBLE, 200) END AS ttft_ms
  FROM runs JOIN models USING (model_id))"""


@query("telemetry_columns", with_marts("runs models", f""", {TELEMETRY}
SELECT run_id, provider, {rounded('cost_usd', 6)} AS cost_usd, {rounded('tokens_per_second', 4)} AS tokens_per_second,
  {rounded('ttft_ms', 4)} AS ttft_ms FROM telemetry"""))
def _(m):
    return joins.telemetry(m.runs(), m.models()).select(
        "run_id", "provider", report_round(F.col("cost_usd"), 6).alias("cost_usd"),
        report_round(F.col("tokens_per_second"), 4).alias("tokens_per_second"),
        report_round(F.col("ttft_ms"), 4).alias("ttft_ms"))


@query("ops_telemetry", with_marts("runs models judge_scores", f""", {TELEMETRY}
SELECT model_id, count(*) AS runs, {rounded('avg(total_latency_ms)', 1)} AS avg_latency_ms, {rounded('avg(ttft_ms)', 1)} AS avg_ttft_ms,
  avg(ttft_ms) <= 1500 AS ttft_on_target, {rounded('avg(tokens_per_second)', 2)} AS avg_tokens_per_second,
  {rounded('sum(cost_usd)', 4)} AS total_cost_usd, {rounded('avg((retry_count > 0)::INT)', 4)} AS retry_rate,
  avg((retry_count > 0)::INT) < 0.02 AS retry_on_target, count(*) FILTER (judge_score_0_10 >= 7) AS correct_answers,
  {rounded('sum(cost_usd) / nullif(count(*) FILTER (judge_score_0_10 >= 7), 0)', 6)} AS cost_per_correct
FROM telemetry LEFT JOIN judge_scores USING (run_id) GROUP BY model_id"""))
def _(m):
    return reports.ops_telemetry(joins.telemetry(m.runs(), m.models()), m.judge_scores())


@query("strategy_per_subtopic", with_marts("runs judge_scores questions subtopics", f"""
, means AS (SELECT model_id, subtopic, prompt_strategy, round(avg({MCS}), 9) AS mean
  FROM runs JOIN questions USING (question_id) JOIN subtopics USING (subtopic_id) LEFT JOIN judge_scores USING (run_id)
  GROUP BY ALL),
best AS (SELECT model_id, subtopic, arg_min(prompt_strategy, CASE WHEN mean IS NOT NULL THEN (-mean, prompt_strategy) END) AS s
  FROM means GROUP BY ALL)
SELECT model_id, subtopic, coalesce(s, 'few-shot-cot') AS best_strategy, s IS NULL AS is_default FROM best"""))
def _(m):
    rows = joins.with_subtopic(m.runs(), m.questions(), m.subtopics())
    return reports.strategy_per_subtopic(rows, m.judge_scores())


@query("audit_counts", with_marts("runs judge_scores", f"""
, p AS (SELECT r.*, s.run_id IS NOT NULL AS is_scored, CASE WHEN prompt_strategy <> 'zero-shot' THEN 'phase2'
  WHEN hyperparams = '{DEFAULT_HP}' THEN 'phase1' ELSE 'phase3' END AS phase
  FROM runs r LEFT JOIN judge_scores s USING (run_id))
SELECT phase, 'generate' AS step, count(*) FILTER ({DONE}) AS ok, count(*) AS total FROM p GROUP BY phase
UNION ALL SELECT phase, 'score', count(*) FILTER ({DONE} AND is_scored), count(*) FILTER ({DONE}) FROM p GROUP BY phase
UNION ALL SELECT 'phase1', 'contest', count(*) FILTER (n >= 2), count(*) FROM (SELECT question_id,
  count(DISTINCT model_id) FILTER ({DONE}) AS n FROM runs WHERE prompt_strategy = 'zero-shot' GROUP BY question_id)"""))
def _(m):
    return reports.audit_counts(m.runs(), m.judge_scores(), DEFAULT_HP)


PARAMS = ["temperature", "top_p"]
BUNDLE_SQL = with_marts(BOARD_MARTS + " topics contest_log", f"""{REPLAY_CTES}{BOARD}, {ELO},
summary AS (SELECT {rounded(f'avg({MCS})', 2)} AS v FROM {STAR} WHERE {DONE} GROUP BY model_id, display_name, subtopic, prompt_strategy),
per_model AS (SELECT {rounded(f'avg({MCS})', 2)} AS v FROM runs JOIN judge_scores USING (run_id) WHERE {DONE} GROUP BY model_id, prompt_strategy),
params AS (SELECT 'hyperparams_temperature' AS report, {rounded(f'avg({MCS})', 2)} AS v FROM runs JOIN judge_scores USING (run_id) WHERE {DONE} GROUP BY model_id, temperature
  UNION ALL SELECT 'hyperparams_top_p', {rounded(f'avg({MCS})', 2)} FROM runs JOIN judge_scores USING (run_id) WHERE {DONE} GROUP BY model_id, top_p),
parts AS (
  SELECT 'leaderboard' AS report, mcs_score + coalesce(elo_rating, 0) AS v FROM board JOIN models USING (model_id) LEFT JOIN elo USING (model_id)
  UNION ALL SELECT 'totals', (SELECT count(*) FROM board) + (SELECT count(DISTINCT contest_id) FROM contest_entries) + (SELECT count(*) FROM runs)
  UNION ALL SELECT 'results_summary', v FROM summary UNION ALL SELECT 'prompts_compare', v FROM per_model UNION ALL SELECT report, v FROM params
  UNION ALL SELECT 'full_export', total_latency_ms FROM runs LEFT JOIN judge_scores USING (run_id) WHERE {DONE}
  UNION ALL SELECT 'audit', total FROM (
    SELECT count(*) AS total FROM (SELECT *, CASE WHEN prompt_strategy <> 'zero-shot' THEN 2 WHEN hyperparams = '{DEFAULT_HP}' THEN 1 ELSE 3 END AS phase FROM runs) GROUP BY phase
    UNION ALL SELECT count(*) FILTER ({DONE}) FROM (SELECT *, CASE WHEN prompt_strategy <> 'zero-shot' THEN 2 WHEN hyperparams = '{DEFAULT_HP}' THEN 1 ELSE 3 END AS phase FROM runs) GROUP BY phase
    UNION ALL SELECT count(DISTINCT question_id) FROM runs WHERE prompt_strategy = 'zero-shot'))
SELECT report, count(*) AS rows, {rounded('sum(v)', 1)} AS total FROM parts GROUP BY report""", recursive=True)
# The figure of each report that is added up to compare its content.
BUNDLE_FIGURES = {
    "leaderboard": "mcs_score + coalesce(elo_rating, 0)", "totals": "total_models + total_contests + total_runs",
    "results_summary": "avg_mcs", "prompts_compare": "avg_mcs", "hyperparams_temperature": "avg_mcs", "hyperparams_top_p": "avg_mcs",
    "full_export": "total_latency_ms", "audit": "total",
}


@query("report_bundle", BUNDLE_SQL)
def _(m):
    """The report files of a finished benchmark, written and read again."""
    def keep(rows, name):
        return kept(m, rows, name)

    models, runs, scores, questions = m.models(), m.runs(), m.judge_scores(), m.questions()
    # the reports read the joined rows, which are therefore written once; of the run id, which no joined row lacks, they only count the rows
    shared = files.staged_parts([
        joins.star(*part, models, questions, m.subtopics(), m.topics()).select(
            F.lit(True).alias("run_id"), "model_id", "display_name", "subtopic", "prompt_strategy", "hyperparams", "input_tokens", "output_tokens",
            "format_compliance_score", *reports.METRICS.values())
        for part in slices(m)], new_folder(m.spark, "star"))
    refreshed = keep(reports.leaderboard_refresh(shared, m.contest_entries(), keep), "refreshed")
    bundle = {
        "leaderboard": reports.leaderboard(refreshed, models, keep(best_ratings(m), "ratings")),
        "totals": reports.leaderboard_totals(refreshed, m.contest_entries(), runs),
        "results_summary": reports.results_summary(shared),
        "prompts_compare": reports.prompts_compare(shared),
        **{f"hyperparams_{p}": reports.hyperparam_compare(shared, p) for p in PARAMS},
        "full_export": [joins.export_rows(*part, models, questions) for part in slices(m)],
        "audit": reports.audit_counts(runs, scores, DEFAULT_HP),
    }
    per_model = ["prompts_compare", *(f"hyperparams_{p}" for p in PARAMS)]
    paths = files.write_report_bundle(bundle, new_folder(m.spark, "reports"), per_model)
    schemas = {name: (report[0] if isinstance(report, list) else report).schema for name, report in bundle.items()}
    figures = [
        m.spark.read.schema(schemas[name]).json(path).select(F.lit(name).alias("report"), F.expr(BUNDLE_FIGURES[name]).cast("double").alias("v"))
        for name, path in paths.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), figures).groupBy("report").agg(
        F.count("*").alias("rows"), report_round(F.sum("v"), 1).alias("total"))
