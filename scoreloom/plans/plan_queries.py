"""Registered planning, sampling and prompt queries with their SQL."""

from pyspark.sql import functions as F

from scoreloom.functions import fixed_values as fv
from scoreloom.functions import prompt_texts as pt
from scoreloom.functions.keys import hyperparam_hash
from scoreloom.operators import joins, planning, ratings, sampling
from scoreloom.plans.mart_sql import text, with_marts
from scoreloom.plans.marts import Marts
from scoreloom.plans.report_queries import DONE

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = lambda spark, folder: fn(Marts(spark, folder))
        if sql:
            SQL[name] = sql
        return fn
    return add


# --- samples --------------------------------------------------------------------------

STRATIFIED = """SELECT * FROM questions QUALIFY row_number() OVER (PARTITION BY subtopic_id
  ORDER BY CASE difficulty WHEN 'medium' THEN 0 WHEN 'easy' THEN 1 ELSE 2 END, question_id) = 1"""
SAMPLE_COLUMNS = ["question_id", "subtopic_id", "difficulty", "question_type"]


@query("stratified_sample", with_marts("questions", f"SELECT {', '.join(SAMPLE_COLUMNS)} FROM ({STRATIFIED})"))
def _(m):
    return sampling.stratified_sample(m.questions()).select(*SAMPLE_COLUMNS)


@query("cell_sample", with_marts("questions", f"""
, s AS (SELECT * FROM questions QUALIFY row_number() OVER (PARTITION BY subtopic_id, difficulty ORDER BY question_id) = 1)
SELECT {', '.join(SAMPLE_COLUMNS)} FROM s UNION ALL SELECT {', '.join(SAMPLE_COLUMNS)} FROM
  (SELECT * FROM questions WHERE question_type = 'practical' ORDER BY question_id LIMIT 1) WHERE 'practical' NOT IN (SELECT question_type FROM s)"""))
def _(m):
    return sampling.cell_sample(m.questions()).select(*SAMPLE_COLUMNS)


@query("fast_sweep_sample", with_marts("questions", f"""
SELECT {', '.join(SAMPLE_COLUMNS)} FROM questions QUALIFY row_number() OVER (PARTITION BY difficulty ORDER BY md5(question_id::VARCHAR), question_id)
  <= greatest(ceil(count(*) OVER (PARTITION BY difficulty) / 5), least(count(*) OVER (PARTITION BY difficulty), 2))"""))
def _(m):
    return sampling.fast_sweep_sample(m.questions()).select(*SAMPLE_COLUMNS)


# --- grids ------------------------------------------------------------------------------

# the registry of contestants
MODELS = "(SELECT r_regionkey::BIGINT AS model_id FROM region)"


def contestants(m):
    return m.raw("region").select(F.col("r_regionkey").cast("long").alias("model_id"))



def config_sql(overrides):
    values = {**fv.DEFAULT_HYPERPARAMS, **overrides}
    return "'{" + ", ".join(f'"{k}": {values[k]}' for k in sorted(values)) + "}'"


def grid_sql(source, strategies, overrides, phase):
    configs = " UNION ALL ".join(f"SELECT {config_sql(o)} AS hyperparams" for o in overrides)
    return f"""SELECT '{phase}' AS phase, question_id, model_id, prompt_strategy, hyperparams, substr(sha256(hyperparams), 1, 16) AS hyperparam_hash
FROM {source}, {MODELS}, (SELECT unnest({strategies}) AS prompt_strategy), ({configs})"""


OTHERS = [s for s in fv.STRATEGIES if s != "zero-shot"]
GRID = " UNION ALL ".join([
    grid_sql("questions", ["zero-shot"], [{}], "phase1"),
    grid_sql(f"({STRATIFIED})", OTHERS, [{}], "phase2"),
    grid_sql("questions", ["zero-shot"], [{"temperature": v} for v in ("0.0", "0.7", "1.0")], "phase3"),
])


@query("experiment_grid", with_marts("questions", GRID))
def _(m):
    sample = sampling.stratified_sample(m.questions())
    return planning.experiment_grid(m.questions(), sample, contestants(m), ["temperature"])


@query("sweep_metadata", with_marts("models", " UNION ALL ".join(
    f"SELECT model_id, '{p}' AS sweep_param, '[{', '.join(v)}]' AS param_grid, 'dispatched' AS status FROM models"
    for p, v in fv.HYPERPARAM_GRID.items())))
def _(m):
    return planning.sweep_metadata(m.models(), list(fv.HYPERPARAM_GRID))


@query("comparison_metadata", with_marts("models", f"""
SELECT model_id, '{','.join(fv.STRATEGIES)}' AS strategies, 'dispatched' AS status FROM models"""))
def _(m):
    return planning.comparison_metadata(m.models()).withColumn("strategies", F.array_join("strategies", ","))


@query("pending_runs", with_marts("questions runs", f"""
, planned AS (SELECT question_id, m AS model_id, s AS prompt_strategy FROM questions, (SELECT model_id AS m FROM {MODELS}), (SELECT unnest({fv.STRATEGIES}) AS s))
SELECT question_id, model_id::BIGINT AS model_id, prompt_strategy FROM planned ANTI JOIN runs USING (question_id, model_id, prompt_strategy)"""))
def _(m):
    planned = planning.grid(m.questions(), contestants(m), fv.STRATEGIES, [{}], "any")
    runs = m.runs().withColumn("hyperparam_hash", hyperparam_hash({}))
    return planning.pending_runs(planned, runs).select("question_id", "model_id", "prompt_strategy")


@query("contest_ready", with_marts("runs judge_scores", f"""
SELECT question_id FROM runs JOIN judge_scores USING (run_id) WHERE {DONE} AND prompt_strategy = 'zero-shot'
GROUP BY question_id HAVING count(DISTINCT model_id % 3) FILTER (model_id % 3 IN (0, 1)) = 2"""))
def _(m):
    # three groups of suppliers act as the models, two of them required
    scored = joins.scored(m.runs(), m.judge_scores()).withColumn("model_id", F.col("model_id") % 3)
    return planning.contest_ready(scored, [0, 1])


@query("contestable_questions", with_marts("runs judge_scores", f"""
SELECT question_id FROM runs JOIN judge_scores USING (run_id) WHERE {DONE} AND prompt_strategy = 'zero-shot'
GROUP BY question_id HAVING count(DISTINCT model_id) >= 2"""))
def _(m):
    return planning.contestable(joins.scored(m.runs(), m.judge_scores()))


# --- few-shot examples and prompts ----------------------------------------------------------

def filled(template, *values):
    pieces = template.split("%s")
    out = [text(pieces[0])]
    for value, piece in zip(values, pieces[1:]):
        out += [f"({value})", text(piece)]
    return "(" + " || ".join(out) + ")"


STORE = f"""store AS (SELECT question_id, subtopic_id, difficulty, 'few-shot' AS prompt_strategy, question_text AS q, expected_answer AS a
  FROM example_questions WHERE expected_answer IS NOT NULL AND question_id NOT IN (SELECT doc_id FROM labels)
  UNION ALL SELECT question_id, subtopic_id, difficulty, 'few-shot-cot', question_text, {filled(pt.COT_EXAMPLE_ANSWER, 'expected_answer')}
  FROM example_questions WHERE expected_answer IS NOT NULL)"""


def store(m):
    stored = m.raw("labels").select(F.col("doc_id").alias("question_id"), F.lit("few-shot").alias("prompt_strategy"))
    return planning.seed_few_shot(m.example_questions(), stored)


@query("seed_few_shot", with_marts("example_questions", f""", {STORE}
SELECT question_id, subtopic_id, difficulty, prompt_strategy, md5(q) AS question_md5, a AS example_answer FROM store"""))
def _(m):
    return store(m).select("question_id", "subtopic_id", "difficulty", "prompt_strategy",
                           F.md5("example_question").alias("question_md5"), "example_answer")


# some stored examples with steps have a reasoning
WHY = "CASE WHEN s.prompt_strategy = 'few-shot-cot' AND s.question_id % 2 = 0 THEN 'Because of ' || s.question_id END"


def reasoned_store(m):
    why = F.when((F.col("prompt_strategy") == "few-shot-cot") & (F.col("question_id") % 2 == 0),
                 F.concat(F.lit("Because of "), F.col("question_id").cast("string")))
    return store(m).withColumn("example_reasoning", why)


def lookup_sql(wanted):
    return f"""strict AS (SELECT e.question_id, list({{id: s.question_id, strategy: s.prompt_strategy, q: s.q, a: s.a, why: {WHY}}} ORDER BY s.question_id, s.prompt_strategy)[1:3] AS ex
  FROM example_questions e JOIN store s ON s.subtopic_id = e.subtopic_id AND s.difficulty = e.difficulty AND s.question_id <> e.question_id
    AND s.prompt_strategy IN ({wanted}) GROUP BY e.question_id),
relaxed AS (SELECT e.question_id, list({{id: s.question_id, strategy: s.prompt_strategy, q: s.q, a: s.a, why: {WHY}}} ORDER BY s.question_id, s.prompt_strategy)[1:3] AS ex
  FROM example_questions e JOIN store s ON s.subtopic_id = e.subtopic_id AND s.question_id <> e.question_id GROUP BY e.question_id),
looked AS (SELECT e.*, coalesce(len(s.ex), 0) < 3 AS is_relaxed, CASE WHEN coalesce(len(s.ex), 0) < 3 THEN coalesce(r.ex, []) ELSE s.ex END AS ex
  FROM example_questions e LEFT JOIN strict s USING (question_id) LEFT JOIN relaxed r USING (question_id))"""


def lookup_rows(rows):
    ids = F.transform("examples", lambda e: F.concat(e["question_id"].cast("string"), F.lit(":"), e["prompt_strategy"]))
    return rows.select("question_id", "is_relaxed", F.array_join(ids, ",").alias("examples"))


LOOKUP_OUT = "SELECT question_id, is_relaxed, array_to_string(list_transform(ex, lambda e: e.id || ':' || e.strategy), ',') AS examples FROM looked"


@query("few_shot_lookup", with_marts("example_questions", f", {STORE}, {lookup_sql(repr('few-shot') + ', ' + repr('few-shot-cot'))} {LOOKUP_OUT}"))
def _(m):
    return lookup_rows(planning.few_shot_lookup(m.example_questions(), store(m)))


@query("few_shot_lookup_cot", with_marts("example_questions", f", {STORE}, {lookup_sql(repr('few-shot-cot'))} {LOOKUP_OUT}"))
def _(m):
    return lookup_rows(planning.few_shot_lookup(m.example_questions(), store(m), "few-shot-cot"))


EXAMPLE = "'Question: ' || e.q || chr(10) || 'Answer: ' || e.a"
REASONED = "'Question: ' || e.q || coalesce(chr(10) || 'Reasoning:' || chr(10) || e.why, '') || chr(10) || 'Answer: ' || e.a"


def numbered_sql(example):
    return f"array_to_string(list_transform(ex, lambda e, i: 'Example ' || i || ':' || chr(10) || {example}), chr(10) || chr(10))"


DDL = ", ".join(text(w) for w in pt.DDL_LINE_WORDS)
SUMMARY = f"""trim(array_to_string(list_filter(string_split(schema_fixture, chr(10)),
  lambda l: len(list_filter([{DDL}], lambda w: contains(upper(l), w))) > 0), chr(10)))"""
PROMPT = f"""CASE WHEN s = 'one-shot' AND n > 0 THEN {filled(pt.ONE_SHOT, EXAMPLE.replace('e.', 'ex[1].'), 'q')}
  WHEN s = 'few-shot' AND n > 0 THEN {filled(pt.FEW_SHOT, 'n', numbered_sql(EXAMPLE), 'q')}
  WHEN s = 'few-shot-cot' AND n > 0 THEN {filled(pt.FEW_SHOT_COT, 'n', numbered_sql(REASONED), 'q')}
  WHEN s = 'cot' AND question_id % 3 = 0 THEN q || {text(pt.COT_IMPLICIT_SUFFIX)}
  WHEN s IN ('cot', 'few-shot-cot', 'self-consistency') THEN q || {text(pt.COT_SUFFIX)}
  WHEN s = 'least-to-most' THEN {filled(pt.LEAST_TO_MOST, 'q')} WHEN s = 'react' THEN {filled(pt.REACT, 'q')} ELSE q END"""


@query("render_prompts", with_marts("example_questions", f""", {STORE}, {lookup_sql(repr('few-shot') + ', ' + repr('few-shot-cot'))},
p AS (SELECT question_id, ex, len(ex) AS n, unnest({fv.STRATEGIES}) AS s,
  CASE WHEN coalesce({SUMMARY}, '') <> '' THEN {filled(pt.SCHEMA_PREFIX, SUMMARY, 'question_text')} ELSE question_text END AS q FROM looked)
SELECT question_id, s AS prompt_strategy, CASE WHEN s IN ('one-shot', 'few-shot') AND n = 0 THEN 'zero-shot' WHEN s = 'few-shot-cot' AND n = 0 THEN 'cot'
    WHEN s = 'self-consistency' THEN 'cot' ELSE s END AS label,
  md5(CASE WHEN s = 'role-prompting' THEN {text(pt.ROLE_SYSTEM_PROMPT)} ELSE {text(pt.SYSTEM_PROMPTS['expert-persona'])} END) AS system_md5,
  md5({PROMPT}) AS user_md5 FROM p"""))
def _(m):
    looked = planning.few_shot_lookup(m.example_questions(), reasoned_store(m))
    strategies = F.explode(F.array(*[F.lit(s) for s in fv.STRATEGIES])).alias("prompt_strategy")
    variant = F.when(F.col("question_id") % 3 == 0, "implicit").otherwise("explicit").alias("cot_variant")
    planned = looked.select("question_id", "question_text", "schema_fixture", "examples", variant, strategies)
    return planning.render_prompts(planned).select(
        "question_id", "prompt_strategy", "label", F.md5("system_prompt").alias("system_md5"), F.md5("user_prompt").alias("user_md5"))


JUDGE_REF = f"""CASE WHEN coalesce(expected_answer, '') = '' THEN {text(pt.NO_REFERENCE)} WHEN length(expected_answer) > 2000
  THEN substr(expected_answer, 1, 2000) || {filled(pt.REFERENCE_NOTE, 'length(expected_answer)')} ELSE expected_answer END"""
JUDGE_ANS = f"""CASE WHEN answer = '' THEN {text(pt.NO_ANSWER)} WHEN length(answer) > 3000
  THEN substr(answer, 1, 3000) || {filled(pt.ANSWER_NOTE, 'length(answer)')} ELSE answer END"""
RUBRIC = f"""CASE WHEN answer_id % 7 = 0 THEN {text(pt.HINT_BLOCK)} || 'schema of ' || source || chr(10) || chr(10) || 'Scoring Rubric:' || chr(10) ELSE '' END
  || CASE WHEN list_contains(tags, 'sql') THEN {text(pt.SQL_RUBRIC)} ELSE {text(pt.DEFAULT_RUBRIC)} END"""


def in_places(template, values):
    """SQL for a template with values in its places."""
    pieces = template.split("%s")
    return " || ".join([text(pieces[0])] + [f"({v}) || {text(p)}" for v, p in zip(values, pieces[1:])])


SYSTEM_MD5 = f"md5({text(pt.JUDGE_SYSTEM_PROMPT)}) AS system_md5"


@query("judge_prompts", with_marts("answers refs", f"""
SELECT answer_id, md5({in_places(pt.JUDGE_PROMPT, ["'Question ' || question_id", JUDGE_REF, JUDGE_ANS, RUBRIC])}) AS prompt_md5, {SYSTEM_MD5}
FROM answers LEFT JOIN refs USING (question_id)"""))
def _(m):
    answers = m.answers().withColumn("answer", planning.answer_for_judge(F.col("answer")))
    references = m.references().select("question_id", planning.reference_for_judge(F.col("expected_answer")).alias("reference"))
    rows = answers.join(references, "question_id", "left").withColumns({
        "question_text": F.concat(F.lit("Question "), F.col("question_id").cast("string")),
        "judge_hint": F.when(F.col("answer_id") % 7 == 0, F.concat(F.lit("schema of "), "source")),
        "execution_context": F.lit(None).cast("string"),
    })
    return planning.judge_prompts(rows).select(
        "answer_id", F.md5("judge_prompt").alias("prompt_md5"), F.md5("system_prompt").alias("system_md5"))


CONTEST_HEAD, CONTEST_TAIL = pt.CONTEST_PROMPT.rsplit("%s", 3)[0], "%s".join(pt.CONTEST_PROMPT.rsplit("%s", 3)[1:])


@query("contest_prompts", with_marts("contest_entries", f"""
, l AS (SELECT contest_id, model_id, row_number() OVER (PARTITION BY contest_id ORDER BY md5(contest_id || '|' || model_id || '|0'), model_id) AS k,
  count(*) OVER (PARTITION BY contest_id) AS n FROM contest_entries),
p AS (SELECT contest_id, 0 AS part, {in_places(CONTEST_HEAD, ["n", "'Question ' || contest_id", text(pt.NO_CONTEST_REFERENCE)])} AS t FROM l WHERE k = 1
  UNION ALL
  SELECT contest_id, k, CASE WHEN k > 1 THEN chr(10) || chr(10) ELSE '' END || 'Answer ' || chr((65 + (k - 1) % 26)::INT)
    || CASE WHEN k > 26 THEN ((k - 1) // 26)::VARCHAR ELSE '' END || ':' || chr(10) || 'Text of ' || model_id FROM l
  UNION ALL SELECT contest_id, n + 1, {in_places(CONTEST_TAIL, ["n", "n"])} FROM l WHERE k = 1)
SELECT contest_id, part, md5(t) AS text_md5, {SYSTEM_MD5} FROM p"""))
def _(m):
    labelled = ratings.anonymise_contest(m.contest_entries()).withColumn(
        "answer", F.concat(F.lit("Text of "), F.col("model_id").cast("string")))
    parts = planning.contest_prompts(
        labelled, F.concat(F.lit("Question "), F.col("contest_id").cast("string")), F.lit(None).cast("string"))
    return parts.select("contest_id", "part", F.md5("text").alias("text_md5"), F.md5("system_prompt").alias("system_md5"))
