"""Registered accuracy, similarity and consensus queries with their SQL."""

from pyspark.sql import functions as F

from scoreloom.functions import fixed_values as fv
from scoreloom.functions.numbers import report_round
from scoreloom.operators import accuracy, consensus
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


# --- result sets -------------------------------------------------------------------

def f1_sql(returned, by_values):
    def block(kind, key):
        return f"""
{kind} AS (SELECT coalesce(r.case_id, e.case_id) AS case_id, count(r.case_id) AS ret, count(e.case_id) AS exp,
  count(*) FILTER (r.case_id IS NOT NULL AND e.case_id IS NOT NULL) AS common
  FROM (SELECT DISTINCT case_id, {key} AS k FROM {returned}) r
  FULL JOIN (SELECT DISTINCT case_id, {key} AS k FROM expected_rows) e ON r.case_id = e.case_id AND r.k = e.k GROUP BY 1),
{kind}_pr AS (SELECT *, CASE WHEN ret = 0 THEN 0 ELSE common / ret END AS p, CASE WHEN exp = 0 THEN 0 ELSE common / exp END AS r FROM {kind}),
{kind}_f AS (SELECT *, CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END AS f FROM {kind}_pr)"""

    up = "v.f > 0 AND n.f = 0" if by_values else "false"
    return f"""{block('names', '(value_name, part, quantity)')}, {block('vals', 'list_sort(list_distinct([part, round(quantity, 4)]))')},
f1 AS (SELECT n.case_id, {rounded(f'CASE WHEN {up} THEN v.p ELSE n.p END', 4)} AS precision,
  {rounded(f'CASE WHEN {up} THEN v.r ELSE n.r END', 4)} AS recall, {rounded(f'CASE WHEN {up} THEN v.f ELSE n.f END', 4)} AS f1,
  n.ret AS returned_count, n.exp AS expected_count FROM names_f n JOIN vals_f v USING (case_id))"""


ROWS = "candidate_rows expected_rows"


@query("result_set_f1", with_marts(ROWS, f", {f1_sql('candidate_rows', False)} SELECT * FROM f1"))
def _(m):
    return accuracy.result_set_f1(m.candidate_rows(), m.expected_rows())


@query("result_set_f1_values", with_marts(ROWS, f", {f1_sql('candidate_rows', True)} SELECT * FROM f1"))
def _(m):
    return accuracy.result_set_f1(m.candidate_rows(), m.expected_rows(), by_values=True)


@query("pick_candidate", with_marts(ROWS, f"""
, c AS (SELECT case_id, candidate_idx, min(quantity) > 3 AS ok, any_value(value_name) = 'qty' AS matches FROM candidate_rows GROUP BY ALL),
p AS (SELECT case_id, arg_min(candidate_idx, (NOT matches, candidate_idx)) FILTER (ok) AS chosen_idx FROM c
  WHERE case_id IN (SELECT case_id FROM expected_rows) GROUP BY case_id),
picks AS (SELECT o_orderkey AS case_id, chosen_idx, CASE WHEN o_orderkey NOT IN (SELECT case_id FROM expected_rows) THEN 'Missing SQL or expected rows'
  WHEN o_orderkey NOT IN (SELECT case_id FROM candidate_rows) THEN 'No SQL found in answer'
  WHEN chosen_idx IS NULL THEN 'All SQL candidates failed to execute' END AS error
  FROM orders LEFT JOIN p ON p.case_id = o_orderkey),
chosen AS (SELECT r.* FROM candidate_rows r JOIN picks ON r.case_id = picks.case_id AND candidate_idx = chosen_idx),
{f1_sql('chosen', True)}
SELECT case_id, chosen_idx::INT AS chosen_idx, error, CASE WHEN error = 'No SQL found in answer' THEN NULL
  WHEN error IS NULL THEN coalesce(f1, 0) ELSE 0 END::DOUBLE AS f1 FROM picks LEFT JOIN f1 USING (case_id)"""))
def _(m):
    cases = m.raw("orders").select(F.col("o_orderkey").alias("case_id"))
    return accuracy.candidate_accuracy(cases, m.candidates(), m.candidate_rows(), m.expected_rows())


# --- perturbations ---------------------------------------------------------------------

def chained(column, rules, flags, prefix):
    expr = column
    for pattern, replacement in rules:
        expr = f"regexp_replace({expr}, '{prefix}{pattern}', '{replacement}'{flags})"
    return expr


Q = "question_text"
REPHRASED = chained(Q, fv.REPHRASE_RULES, "", "(?i)")
RENAMED = chained(Q, fv.SYNONYMS, ", 'g'", "(?i)")
PARTS = rf"string_split_regex({Q}, '\n\s*\d+\.\s+')"
INNER = rf"regexp_extract({Q}, '\(([^)]+,\s*[^)]+)\)', 1)"
INVERTED = rf"""CASE WHEN len({PARTS}) > 2 THEN {PARTS}[1] || array_to_string(list_transform(list_reverse({PARTS}[2:]),
    lambda p, i: chr(10) || i || '. ' || p), '')
  WHEN {INNER} <> '' THEN replace({Q}, {INNER}, array_to_string(list_reverse(list_transform(string_split({INNER}, ','), lambda s: trim(s))), ', '))
  ELSE {Q} END"""
TYPO = "CASE " + " ".join(
    f"WHEN contains(lower({Q}), '{a}') THEN regexp_replace({Q}, '(?i){a}', '{b}')" for a, b in fv.TYPOS) + f" ELSE {Q} END"
# verbs that are negated already are marked first, as this SQL has no lookahead
EDGE = r"[^\p{L}\p{N}_]"
MARKED = rf"regexp_replace({Q}, '(?i)(^|{EDGE})(is|are|does|do)(\s+not)', '\1ZQX\2\3', 'g')"
VERB = rf"replace(regexp_replace({MARKED}, '(?i)(^|{EDGE})(is|are|does|do)($|{EDGE})', '\1\2 NOT\3'), 'ZQX', '')"
TRIMMED = rf"regexp_replace({Q}, '^\s+|\s+$', '', 'g')"
NEGATED = rf"""CASE WHEN {VERB} <> {Q} THEN {VERB} WHEN ends_with({TRIMMED}, '?')
  THEN {TRIMMED}[1:length({TRIMMED}) - 1] || {text(fv.NEGATED_QUESTION_SUFFIX)} ELSE {Q} || {text(fv.NEGATED_STATEMENT_SUFFIX)} END"""
KINDS_SQL = {
    "syntactic_rephrasing": f"CASE WHEN {REPHRASED} <> {Q} THEN {REPHRASED} ELSE {Q} || {text(fv.REPHRASE_SUFFIX)} END",
    "variable_name_change": RENAMED, "order_inversion": INVERTED, "typo_injection": TYPO, "negation_injection": NEGATED,
}


@query("perturb_questions", with_marts("perturbable", " UNION ALL ".join(
    f"SELECT question_id, '{kind}' AS perturbation_type, md5({expr}) AS perturbed_md5 FROM perturbable"
    for kind, expr in KINDS_SQL.items())))
def _(m):
    rows = consensus.perturb_questions(m.perturbable())
    return rows.select("question_id", "perturbation_type", F.md5("perturbed_question").alias("perturbed_md5"))


# --- similarity -------------------------------------------------------------------------

def words_sql(column):
    return rf"list_distinct(regexp_extract_all(lower({column}), '[\p{{L}}\p{{N}}_]+'))"


def jaccard_sql(a, b):
    return (f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0 ELSE len(list_intersect({a}, {b})) "
            f"/ (len({a}) + len({b}) - len(list_intersect({a}, {b}))) END")


KINDS = list(KINDS_SQL)


def originals(m):
    """Every sixth document is an original, the five after it answer its perturbed versions."""
    doc = F.col("doc_id")
    rows = m.texts().select(
        F.floor(doc / 6).cast("long").alias("original_id"), (doc % 6).alias("kind_no"),
        doc.alias("run_id"), F.when(doc % 13 == 5, "").otherwise(F.col("text")).alias("answer"))
    kind = F.get(F.array(*[F.lit(k) for k in KINDS]), (F.col("kind_no") - 1).cast("int"))
    return (rows.filter("kind_no = 0").select("original_id", "answer"),
            rows.filter("kind_no > 0").withColumn("perturbation_type", kind).drop("kind_no"))


PAIRS = f"""d AS (SELECT doc_id // 6 AS original_id, doc_id % 6 AS kind_no, doc_id AS run_id,
  CASE WHEN doc_id % 13 = 5 THEN '' ELSE text END AS answer FROM documents),
w AS (SELECT *, {words_sql('answer')} AS words FROM d),
pairs AS (SELECT p.original_id, {KINDS}[p.kind_no] AS perturbation_type, p.run_id, p.answer = '' AS is_empty,
  {rounded(jaccard_sql('o.words', 'p.words'), 4)} AS similarity
  FROM w p JOIN w o ON o.original_id = p.original_id AND o.kind_no = 0 WHERE p.kind_no > 0)"""


@query("jaccard_pairs", f"WITH {PAIRS} SELECT * FROM pairs")
def _(m):
    return consensus.jaccard_pairs(*originals(m))


@query("consistency_score", f"""WITH {PAIRS}, agg AS (SELECT original_id, count(*) AS tried, count(*) FILTER (NOT is_empty) AS kept,
  sum(similarity) FILTER (NOT is_empty) AS total, array_to_string(list(perturbation_type || '=' || printf('%.4f', similarity) ORDER BY perturbation_type)
  FILTER (NOT is_empty), ',') AS detail FROM pairs GROUP BY original_id)
SELECT d.original_id, CASE WHEN tried IS NULL THEN 1.0 WHEN kept = 0 THEN 0.0 ELSE {rounded('total / kept', 4)} END::DOUBLE AS consistency_score,
  coalesce(detail, '') AS per_perturbation FROM d LEFT JOIN agg USING (original_id) WHERE kind_no = 0""")
def _(m):
    rows = consensus.consistency_score(*originals(m))
    entries = F.array_sort(F.transform(
        F.map_entries("per_perturbation"), lambda e: F.concat(e["key"], F.lit("="), F.format_string("%.4f", e["value"]))))
    return rows.withColumn("per_perturbation", F.array_join(entries, ","))


def samples(m):
    doc = F.col("doc_id")
    return m.texts().select(
        F.lit("m").alias("model_id"), F.floor(doc / 5).cast("long").alias("question_id"),
        (doc % 5).cast("int").alias("sample_idx"), doc.alias("run_id"), F.col("text").alias("answer"))


SAMPLES = f"""s AS (SELECT doc_id // 5 AS question_id, (doc_id % 5)::INT AS sample_idx, text AS answer, {words_sql('text')} AS words
  FROM documents WHERE text <> ''),
m AS (SELECT a.question_id, a.sample_idx, any_value(a.answer) AS answer,
  round(coalesce(avg({jaccard_sql('a.words', 'b.words')}) FILTER (b.sample_idx IS NOT NULL), 1), 9)::DOUBLE AS mean
  FROM s a LEFT JOIN s b ON a.question_id = b.question_id AND a.sample_idx <> b.sample_idx GROUP BY ALL)"""


@query("pairwise_similarity", f"""WITH {SAMPLES}
SELECT 'm' AS model_id, question_id, sample_idx, {rounded('mean', 6)} AS mean_similarity FROM m""")
def _(m):
    rows = consensus.pairwise_similarity(samples(m))
    return rows.withColumn("mean_similarity", report_round(F.col("mean_similarity"), 6))


@query("plurality_vote", f"""WITH {SAMPLES}
SELECT 'm' AS model_id, question_id, count(*)::INT AS samples, arg_min(sample_idx, (-mean, sample_idx)) AS best_idx,
  {rounded('max(mean)', 6)} AS mean_similarity, md5(arg_min(answer, (-mean, sample_idx))) AS best_md5 FROM m GROUP BY question_id""")
def _(m):
    rows = consensus.plurality_vote(samples(m))
    return rows.select("model_id", "question_id", "samples", "best_idx",
                       report_round(F.col("mean_similarity"), 6).alias("mean_similarity"),
                       F.md5("best_answer").alias("best_md5"))


@query("token_set_ops", with_marts("answers refs", f"""
SELECT answer_id AS pair_id, len(list_intersect(a, b))::INT AS common_words, len(list_distinct(list_concat(a, b)))::INT AS all_words
FROM (SELECT answer_id, coalesce({words_sql('expected_answer')}, []) AS a, {words_sql('answer')} AS b
  FROM answers LEFT JOIN refs USING (question_id))"""))
def _(m):
    answers = m.answers().select(F.col("answer_id").alias("pair_id"), "question_id", consensus.word_hashes(F.col("answer")).alias("right_words"))
    references = m.references().select("question_id", consensus.word_hashes(F.col("expected_answer")).alias("left_words"))
    return consensus.token_set_ops(answers.join(references, "question_id", "left"))


@query("self_consistency_plan", with_marts("questions", """
SELECT question_id, i::INT AS sample_idx, 'self-consistency' AS prompt_strategy, 0.7::DOUBLE AS temperature, (42 + i)::INT AS seed
FROM questions, range(5) r(i)"""))
def _(m):
    return consensus.self_consistency_plan(m.questions())
