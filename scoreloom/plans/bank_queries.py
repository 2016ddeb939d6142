"""Registered question-bank, upsert and run-intake queries with their SQL."""

from pyspark.sql import functions as F

from scoreloom.functions import fixed_values as fv
from scoreloom.functions import keys
from scoreloom.functions.numbers import report_round
from scoreloom.operators import ingest, joins, reports
from scoreloom.plans.mart_sql import rounded, text, with_marts
from scoreloom.plans.marts import Marts
from scoreloom.plans.report_queries import DONE, TELEMETRY
from scoreloom.session import new_folder
from scoreloom.sources import files

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = lambda spark, folder: fn(Marts(spark, folder))
        if sql:
            SQL[name] = sql
        return fn
    return add


# --- classification ------------------------------------------------------------------

def any_word(column, words):
    return f"len(list_filter([{', '.join(text(w) for w in words)}], lambda w: contains({column}, w))) > 0"


TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
PRACTICAL = ", ".join(text(s) for s, kind in fv.SUBTOPIC_TYPES.items() if kind == "practical")


def classified_sql(source):
    """Exercise number, cleaned text, type, difficulty and tags of a table with question_text and subtopic."""
    tags = ", ".join(f"CASE WHEN {any_word('t', w)} THEN '{tag}' END" for tag, w in sorted(fv.TAG_WORDS.items()))
    return rf"""
x1 AS (SELECT * REPLACE ({TRIM.format('question_text')} AS question_text) FROM {source}),
x2 AS (SELECT *, regexp_extract(question_text, '(?i)^(Exercise\s+[\d.]+):?\s*', 1) AS plain,
  regexp_extract(question_text, '(?i)^#+\s*(Exercise\s+[\d.]+)\s*\n+', 1) AS heading FROM x1),
x3 AS (SELECT * EXCLUDE (plain, heading) REPLACE ({TRIM.format(r"CASE WHEN plain <> '' THEN regexp_replace(question_text, '(?i)^Exercise\s+[\d.]+:?\s*', '') WHEN heading <> '' THEN regexp_replace(question_text, '(?i)^#+\s*Exercise\s+[\d.]+\s*\n+', '') ELSE question_text END")} AS question_text),
  nullif(CASE WHEN plain <> '' THEN plain ELSE heading END, '') AS exercise_number FROM x2),
classified AS (SELECT * EXCLUDE t, CASE WHEN subtopic IN ({PRACTICAL}) THEN 'practical' ELSE 'conceptual' END AS question_type,
  CASE WHEN {any_word('t', fv.HARD_WORDS)} THEN 'hard' WHEN {any_word('t', fv.MEDIUM_WORDS)} THEN 'medium'
    WHEN regexp_extract_all(exercise_number, '\d+')[-1]::BIGINT % 2 = 1 THEN 'easy' ELSE 'medium' END AS difficulty,
  list_filter([{tags}], lambda g: g IS NOT NULL) AS tags FROM (SELECT *, lower(question_text) AS t FROM x3))"""


@query("classify_questions", with_marts("bank", f""", {classified_sql('bank')}
SELECT question_id, subtopic, exercise_number, md5(question_text) AS text_md5, question_type, difficulty, array_to_string(tags, ',') AS tags FROM classified"""))
def _(m):
    rows = ingest.classify_questions(m.bank())
    return rows.select("question_id", "subtopic", "exercise_number", F.md5("question_text").alias("text_md5"),
                       "question_type", "difficulty", F.array_join("tags", ",").alias("tags"))


def items_sql(column):
    """Items of a cell: the list in it, or the whole cell."""
    body = rf"CASE WHEN regexp_matches({column}, '(?s)(?:questions|answers)\s*=\s*\[.*\]') THEN regexp_extract({column}, '(?s)(?:questions|answers)\s*=\s*(\[.*\])', 1) WHEN {column}[1] = '[' THEN {column} END"
    return f"""CASE WHEN trim({column}) = '' THEN [] WHEN json_valid({body}) THEN
    list_filter(list_transform(CAST(({body}) AS JSON)::VARCHAR[], lambda i: trim(i)), lambda i: i <> '') ELSE [{TRIM.format(column)}] END"""


@query("explode_question_sheet", with_marts("sheet", f"""
, filled AS (SELECT row_no, upper(trim(coalesce(last(topic IGNORE NULLS) OVER (ORDER BY row_no), ''))) AS topic, upper(trim(subtopic)) AS subtopic,
  {items_sql('questions')} AS q, {items_sql('answers')} AS a FROM sheet),
items AS (SELECT row_no, topic, subtopic, a, unnest(range(len(q))) AS item, unnest(q) AS question_text FROM filled WHERE subtopic <> ''),
numbered AS (SELECT *, nullif(trim(coalesce(a[item + 1], '')), '') AS expected_answer, row_number() OVER (ORDER BY row_no, item) - 1 AS global_index FROM items),
{classified_sql('numbered')}
SELECT substr(md5(topic || '|' || subtopic || '|' || coalesce(exercise_number, '') || '|' || global_index), 1, 12) AS question_id, topic, subtopic,
  exercise_number, question_text, expected_answer, question_type, difficulty, array_to_string(tags, ',') AS tags, global_index FROM classified"""))
def _(m):
    rows = ingest.explode_question_sheet(m.sheet())
    return rows.withColumn("tags", F.array_join("tags", ","))


NORMAL_TEXT = r"lower(trim(regexp_replace(text, '\s+', ' ', 'g')))"


@query("dedupe_questions", f"""SELECT min(doc_id) AS question_id, count(*) AS copies FROM documents
WHERE NOT regexp_matches(source, 'src1$') GROUP BY {NORMAL_TEXT}""")
def _(m):
    source = F.when(F.col("source") == "src1", "er_diagram").otherwise("sql")
    return ingest.dedupe_questions(m.texts().select(
        F.col("doc_id").alias("question_id"), F.col("text").alias("question_text"), F.array(source).alias("tags")))


# --- keys ----------------------------------------------------------------------------

@query("stable_question_id", with_marts("questions subtopics topics", """
, s AS (SELECT question_id, substr(md5(topic || '|' || subtopic || '|' || difficulty || '|' || question_id), 1, 12) AS short_id
  FROM questions JOIN subtopics USING (subtopic_id) JOIN topics USING (topic_id))
SELECT question_id, short_id, short_id[1:8] || '-' || short_id[9:12] || '-0000-0000-000000000000' AS uuid, short_id AS round_trip FROM s"""))
def _(m):
    rows = m.questions().join(m.subtopics(), "subtopic_id").join(m.topics(), "topic_id")
    short = keys.stable_question_id(F.col("topic"), F.col("subtopic"), F.col("difficulty"), F.col("question_id"))
    return rows.select("question_id", short.alias("short_id")).withColumn(
        "uuid", keys.id_to_uuid(F.col("short_id"))).withColumn("round_trip", keys.uuid_to_id(F.col("uuid")))


HASH_SQL = """substr(sha256('{"frequency_penalty": 0.0, "max_tokens": 1024, "presence_penalty": 0.0, "seed": null, '
  || '"system_prompt_style": "expert-persona", "temperature": ' || temperature || ', "top_k": -1, "top_p": ' || top_p || '}'), 1, 16)"""


@query("hyperparam_hash", with_marts("runs", f"SELECT run_id, {HASH_SQL} AS hyperparam_hash FROM runs"))
def _(m):
    return keys.with_hyperparam_hash(m.runs()).select("run_id", "hyperparam_hash")


@query("json_param_extract", with_marts("runs", """
SELECT run_id, hyperparams->>'temperature' AS temperature, hyperparams->>'top_p' AS top_p, hyperparams->>'seed' AS seed FROM runs"""))
def _(m):
    return m.runs().select("run_id", *[reports.param_text(p).alias(p) for p in ("temperature", "top_p", "seed")])


# --- upserts ----------------------------------------------------------------------------

@query("upsert_dimensions", """
SELECT coalesce(n.q, o.q) AS question_id, CASE WHEN n.q IS NOT NULL THEN n.t ELSE o.t END AS question_text,
  CASE WHEN n.q IS NOT NULL THEN n.a ELSE o.a END AS expected_answer, CASE WHEN n.q IS NOT NULL THEN n.k ELSE o.k END AS question_type,
  CASE WHEN n.q IS NOT NULL THEN n.d ELSE o.d END AS difficulty, CASE WHEN o.q IS NULL THEN n.e ELSE o.e END AS exercise_number,
  coalesce(n.f, o.f) AS schema_fixture
FROM (SELECT c_custkey AS q, c_name AS t, 'stored' AS a, 'practical' AS k, 'easy' AS d, 'Exercise 1' AS e, c_mktsegment AS f FROM customer) o
FULL JOIN (SELECT p_partkey + 500 AS q, p_name AS t, CASE WHEN p_size % 3 <> 0 THEN p_brand END AS a, 'conceptual' AS k, 'hard' AS d,
  'Exercise 2' AS e, CASE WHEN p_size % 2 = 0 THEN p_type END AS f FROM part) n ON o.q = n.q""")
def _(m):
    stored = m.raw("customer").select(
        F.col("c_custkey").alias("question_id"), F.col("c_name").alias("question_text"),
        F.lit("stored").alias("expected_answer"), F.lit("practical").alias("question_type"),
        F.lit("easy").alias("difficulty"), F.lit("Exercise 1").alias("exercise_number"),
        F.col("c_mktsegment").alias("schema_fixture"))
    incoming = m.raw("part").select(
        (F.col("p_partkey") + 500).alias("question_id"), F.col("p_name").alias("question_text"),
        F.when(F.col("p_size") % 3 != 0, F.col("p_brand")).alias("expected_answer"),
        F.lit("conceptual").alias("question_type"), F.lit("hard").alias("difficulty"),
        F.lit("Exercise 2").alias("exercise_number"),
        F.when(F.col("p_size") % 2 == 0, F.col("p_type")).alias("schema_fixture"))
    return ingest.upsert_questions(stored, incoming)


@query("upsert_names", """
SELECT substr(md5('stored' || c_mktsegment), 1, 12) AS id, c_mktsegment AS name FROM customer GROUP BY c_mktsegment
UNION ALL SELECT substr(md5(n), 1, 12), n FROM (SELECT DISTINCT p_type AS n FROM part UNION SELECT DISTINCT c_mktsegment FROM customer)
WHERE n NOT IN (SELECT c_mktsegment FROM customer)""")
def _(m):
    segments = m.raw("customer").select(F.col("c_mktsegment").alias("name"))
    stored = segments.distinct().withColumn("id", F.substring(F.md5(F.concat(F.lit("stored"), "name")), 1, 12))
    incoming = m.raw("part").select(F.col("p_type").alias("name")).unionByName(segments)
    return ingest.upsert_names(stored, incoming, ["name"])


@query("upsert_models", """
, """.lstrip(", \n") + """WITH c AS (SELECT s_suppkey AS model_id, s_name AS display_name, 'p' || (s_nationkey % 4) AS provider, s_acctbal AS cost FROM supplier),
j AS (SELECT n_nationkey::BIGINT * 3 AS model_id, n_name || ' (Judge)' AS display_name, 'judge' AS provider, 1.0::DOUBLE AS cost FROM nation),
merged AS (SELECT *, true AS is_judge FROM j UNION ALL SELECT *, false FROM c WHERE model_id NOT IN (SELECT model_id FROM j)),
stored AS (SELECT r_regionkey::BIGINT * 30 AS model_id, r_name AS display_name, 'kept' AS provider, 0.0::DOUBLE AS cost, false AS is_judge FROM region)
SELECT coalesce(n.model_id, o.model_id) AS model_id, coalesce(n.display_name, o.display_name) AS display_name,
  coalesce(o.provider, n.provider) AS provider, coalesce(n.cost, o.cost) AS cost, coalesce(n.is_judge, o.is_judge) AS is_judge
FROM merged n FULL JOIN stored o ON n.model_id = o.model_id""")
def _(m):
    challengers = m.raw("supplier").select(
        F.col("s_suppkey").alias("model_id"), F.col("s_name").alias("display_name"),
        F.concat(F.lit("p"), (F.col("s_nationkey") % 4).cast("string")).alias("provider"), F.col("s_acctbal").alias("cost"))
    judges = m.raw("nation").select(
        (F.col("n_nationkey").cast("long") * 3).alias("model_id"),
        F.concat("n_name", F.lit(" (Judge)")).alias("display_name"),
        F.lit("judge").alias("provider"), F.lit(1.0).alias("cost"))
    stored = m.raw("region").select(
        (F.col("r_regionkey").cast("long") * 30).alias("model_id"), F.col("r_name").alias("display_name"),
        F.lit("kept").alias("provider"), F.lit(0.0).alias("cost"), F.lit(False).alias("is_judge"))
    return ingest.upsert_models(stored, challengers, judges)


# --- runs -----------------------------------------------------------------------------

def dedupe_sql(order):
    return with_marts("runs", f"""
SELECT run_id, question_id, model_id, prompt_strategy, run_timestamp FROM runs
QUALIFY row_number() OVER (PARTITION BY question_id, model_id, prompt_strategy ORDER BY {order}) = 1""")


def keyed_runs(m):
    # one configuration only, so that some keys repeat
    return m.runs().withColumn("hyperparam_hash", keys.hyperparam_hash({}))


@query("dedupe_runs", dedupe_sql("run_timestamp, run_id"))
def _(m):
    return ingest.dedupe_runs(keyed_runs(m)).select("run_id", "question_id", "model_id", "prompt_strategy", "run_timestamp")


@query("dedupe_runs_forced", dedupe_sql("run_timestamp DESC, run_id DESC"))
def _(m):
    rows = ingest.dedupe_runs(keyed_runs(m), force_rerun=True)
    return rows.select("run_id", "question_id", "model_id", "prompt_strategy", "run_timestamp")


@query("append_latency_records", with_marts("runs models", f""", {TELEMETRY}
SELECT run_id, {rounded('ttft_ms', 6)} AS ttft_ms, total_latency_ms, {rounded('tokens_per_second', 6)} AS tokens_per_second,
  {rounded('cost_usd', 6)} AS cost_usd, input_tokens, output_tokens, retry_count AS api_retry_count, run_timestamp AS recorded_at
FROM telemetry WHERE {DONE} AND run_id NOT IN (SELECT run_id FROM runs WHERE output_tokens > 100)"""))
def _(m):
    # the scored runs stand in for those recorded before
    rows = ingest.new_latency_records(joins.telemetry(m.runs(), m.models()), m.judge_scores().select("run_id"))
    return rows.withColumns({c: report_round(F.col(c), 6) for c in ("ttft_ms", "tokens_per_second", "cost_usd")})


# --- listings ----------------------------------------------------------------------------

@query("list_questions", with_marts("questions subtopics topics", """
SELECT question_id, subtopic, topic, question_type, difficulty, array_to_string(tags, ',') AS tags, count(*) OVER () AS total
FROM questions JOIN subtopics USING (subtopic_id) JOIN topics USING (topic_id)
WHERE topic ILIKE '%america%' AND difficulty = 'hard' AND question_type = 'conceptual' ORDER BY question_id LIMIT 200 OFFSET 50"""))
def _(m):
    bank = m.questions().join(m.subtopics(), "subtopic_id").join(m.topics(), "topic_id")
    rows = reports.list_questions(bank, topic="america", question_type="conceptual", difficulty="hard", limit=200, offset=50)
    return rows.select("question_id", "subtopic", "topic", "question_type", "difficulty",
                       F.array_join("tags", ",").alias("tags"), "total")


@query("list_models", with_marts("models", "SELECT * FROM models"))
def _(m):
    return m.models()


@query("array_contains_model", with_marts("contest_entries", """
SELECT contest_id, list_contains(ranked, 7) AS has_model, ranked[1] = 7 AS first_is_model
FROM (SELECT contest_id, list(model_id ORDER BY placement, model_id) AS ranked FROM contest_entries GROUP BY contest_id)"""))
def _(m):
    return reports.model_in_contests(m.contest_entries(), 7)


RECORDS_PER_ARRAY = 100_000


@query("read_question_bank", with_marts("questions subtopics topics", """
SELECT substr(md5(question_id::VARCHAR), 1, 12) AS id, topic, subtopic, CASE WHEN question_id % 2 = 0 THEN 'Exercise ' || question_id END AS exercise_number,
  'Question ' || question_id || ' "é" ' || chr(10) || 'line' AS question_text, NULL::VARCHAR AS expected_answer, question_type, difficulty, array_to_string(tags, ',') AS tags
FROM questions JOIN subtopics USING (subtopic_id) JOIN topics USING (topic_id)"""))
def _(m):
    rows = m.questions().join(m.subtopics(), "subtopic_id").join(m.topics(), "topic_id")
    number = F.col("question_id").cast("string")
    bank = rows.select(
        F.substring(F.md5(number), 1, 12).alias("id"), "topic", "subtopic",
        F.when(F.col("question_id") % 2 == 0, F.concat(F.lit("Exercise "), number)).alias("exercise_number"),
        F.concat(F.lit("Question "), number, F.lit(' "é" \nline')).alias("question_text"),
        F.lit(None).cast("string").alias("expected_answer"), "question_type", "difficulty", "tags")
    # array files, each of arrays over several lines; their number follows the bank, so that a task sorts and writes a bounded part
    arrays = max(4, -(-bank.count() // RECORDS_PER_ARRAY))
    record = F.concat(F.when(F.col("first"), "[\n").otherwise(",\n"), F.to_json(F.struct(*bank.columns), {"ignoreNullFields": "false"}))
    part = F.spark_partition_id()
    placed = bank.repartition(arrays, "id").withColumn("part", part).sortWithinPartitions("id")
    first = placed.groupBy("part").agg(F.min("id").alias("head"))
    rows = placed.join(F.broadcast(first), "part").withColumn("first", F.col("id") == F.col("head"))
    path = new_folder(m.spark, "bank")
    ends = first.select(F.col("part"), F.lit("~").alias("id"), F.lit("\n]").alias("value"))
    rows.select("part", "id", record.alias("value")).unionByName(ends).repartition(arrays, "part").sortWithinPartitions("part", "id").select("value").write.text(path)
    read = files.read_question_bank(m.spark, path)
    return read.withColumn("tags", F.array_join("tags", ","))
