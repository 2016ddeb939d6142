"""Text checks, classification and perturbations on hand-made texts."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from scoreloom.functions import answer_text as at
from scoreloom.functions import fixed_values as fv
from scoreloom.functions import keys, perturb
from scoreloom.functions.strict_json import json_valid_score
from scoreloom.operators import answer_scan, consensus, ingest


def check(spark, build, text):
    df, searchable = at.searchable(spark.createDataFrame([(text,)], "answer string"), "answer")
    return df.select(build(searchable).alias("x")).first().x


@pytest.mark.parametrize("text, score", [
    ("", 0.0), ("plain words", 0.0), ("please SELECT it", 0.3),
    ("```sql\nSELECT 1\n```", 1.0), ("```SQL  \nselect 1;\n```", 1.0), ("```sql\r\nselect 1;\r\n```", 1.0),
    ("```sql\nSELECT 1\nthis is plain prose, long\nthis is plain prose, long\n```", 0.7),
    ("```sql\n" + "this is plain prose, long\n" * 9 + "```", 0.5),
])
def test_sql_block(spark, text, score):
    assert check(spark, at.sql_block_score, text) == pytest.approx(score)


@pytest.mark.parametrize("text, score", [
    ("1. a\n2) b\n(3) c", 1.0), ("  step 1: a\nno", 0.5), ("a 1. b", 0.0), ("\n\n 1. a", 0.5), (None, 0.0),
])
def test_numbered(spark, text, score):
    assert check(spark, lambda t: at.numbered_score(t.raw), text) == score


@pytest.mark.parametrize("text, score", [
    ("create\n table t", 0.7), ("CREATE TABLE t; FOREIGN KEY", 0.9), ("create table t create index i foreign key", 1.0),
    ("a Primary Key", 0.3), ("none", 0.0),
])
def test_schema(spark, text, score):
    assert check(spark, at.schema_score, text) == pytest.approx(score)


@pytest.mark.parametrize("text, valid", [
    ('{"a": 1}', 1.0), ('```json\n[1, 2]\n```', 1.0), ('{"a": 1} x', 0.0), ("NaN", 1.0), ("", 0.0), ("{'a': 1}", 0.0),
])
def test_json(spark, text, valid):
    assert check(spark, lambda t: json_valid_score(t.raw), text) == valid


@pytest.mark.parametrize("text, instruction, score", [
    ("w " * 40, "in One Paragraph", 1.0), ("w " * 20, "in one paragraph", 0.4), ("a\n\nb " * 20, "one paragraph", 0.4),
    ("- a\n- b\n* c", "list 4 key points", 1.0), ("- a", "List 4 key point", 0.5), ("x", None, 1.0),
])
def test_length(spark, text, instruction, score):
    assert check(spark, lambda t: at.length_score(t.raw, F.lit(instruction).cast("string")), text) == score


@pytest.mark.parametrize("text, names", [
    ("pg_fake(1) PG_FAKE (2) foo(3) my_fn(4)", ["pg_fake", "PG_FAKE", "my_fn"]),
    ("pg_table_size(t) array_agg(x) row_number() count(*)", []),
    ("épg_fake(1)", []), ("pg_ (1) a_b(1)", []),
])
def test_unknown_functions(spark, text, names):
    assert check(spark, lambda t: at.unknown_functions(t.raw), text) == names


def test_findings_of_a_text(spark):
    text = "A temporal  key. 2PL guarantees freedom from deadlock, b+-tree"
    kinds = [(f.hallucination_type, f.severity) for f in check(spark, at.automated_findings, text)]
    assert kinds == [("invented_constraint_type", "high"), ("wrong_fact", "high")]
    assert check(spark, at.automated_findings, "  \n") == []


@pytest.mark.parametrize("text, score", [
    ("", 0.0), ("select 1", 0.5), ("with x as (select 1) select x::int", 0.3),
    ("cast(a as int) from (select 1)", 0.5), ("returning cast(a as int) from ( select 1)", 0.0), ("a -> b", 0.15),
])
def test_idioms(spark, text, score):
    assert check(spark, at.idiom_score, text) == pytest.approx(score)


@pytest.mark.parametrize("text, statements", [
    ("```sql\n-- c\nSELECT 1;\nSELECT 2;\n```\n```\nWITH a AS (SELECT 1) SELECT 1\n```", ["SELECT 1", "WITH a AS (SELECT 1) SELECT 1"]),
    ("Use select a from t; then", ["select a from t"]),
    ("```sql\nCREATE TABLE t (a int);\n```", []),
    ("No query here", []), (None, []),
])
def test_candidates(spark, text, statements):
    assert check(spark, at.sql_candidates, text) == statements


def test_required_words_occur_in_what_their_pattern_matches():
    samples = {
        fv.WRONG_FACTS[0][0]: "2pl guarantee no deadlock", fv.WRONG_FACTS[1][0]: "b tree insertion is o(1)",
        fv.WRONG_FACTS[2][0]: "hash index handle range query", fv.WRONG_FACTS[3][0]: "aries all dbms use",
        fv.WRONG_FACTS[4][0]: "repeatable read prevent phantom read", fv.WRONG_FACTS[5][0]: "3nf was defined in 1985",
    }
    import re
    for pattern, text in samples.items():
        assert re.search(pattern, text)
        assert any(w in text for w in at.required_words(pattern))
    for pattern in fv.IDIOM_PATTERNS + fv.INVENTED_CONSTRAINTS + [fv.CAST_CALL, fv.NESTED_SELECT]:
        plain = re.sub(r"\\[bs][*+]?|\\d\+", " ", pattern).replace("\\", "").lower()
        assert at.required_words(pattern)[0] in plain


def test_format_weights(spark):
    df = spark.createDataFrame([("practical", ["sql"], "plain")], "question_type string, tags array<string>, answer string")
    df, text = at.searchable(df, "answer")
    score = df.select(answer_scan.format_compliance(F.col("question_type"), F.col("tags"), text).alias("x")).first().x
    assert score == 0.6


def test_judge_replies(spark):
    rows = spark.createDataFrame([
        (1, '```json\n{"score": 8, "completeness": 0.5, "hallucinations": [{"type": "a", "text": "b", "severity": "low"}]}\n```'),
        (2, 'Sure: {"score": 4}'), (3, "nothing"), (4, '{"factual_correctness": 0.9}'),
    ], "answer_id int, reply string")
    got = {r.answer_id: r for r in answer_scan.parse_judge_replies(rows).collect()}
    assert (got[1].judge_score_0_10, got[1].completeness, got[1].factual_correctness) == (8.0, 0.5, 0.8)
    assert got[1].judge_findings[0].severity == "low"
    assert (got[2].judge_score_0_10, got[2].topic_specificity, got[2].parse_error) == (4.0, 0.4, False)
    assert (got[3].judge_score_0_10, got[3].completeness, got[3].parse_error) == (5.0, 0.5, True)
    assert (got[4].judge_score_0_10, got[4].factual_correctness) == (5.0, 0.9)


@pytest.mark.parametrize("kind, question, expected", [
    ("syntactic_rephrasing", "What is a key?", "What is meant by a key."),
    ("syntactic_rephrasing", "List keys", "List keys Please explain in detail."),
    ("variable_name_change", "Employees of a Department, did sidx", "staff of a division, dept_id sidx"),
    ("order_inversion", "Do:\n1. one\n2. two", "Do:\n1. two\n2. one"),
    ("order_inversion", "Keys (a, b,c) and (d, e)", "Keys (c, b, a) and (d, e)"),
    ("typo_injection", "A Transaction, a transaction and a constraint", "A transactoin, a transaction and a constraint"),
    ("typo_injection", "relational Normalization", "relational normalisation"),
    ("negation_injection", "It is not so but IS so", "It is not so but IS NOT so"),
    ("negation_injection", "Explain this? ", "Explain this, given that the usual assumption does NOT hold?"),
    ("negation_injection", "Explain", "Explain (Note: the standard assumption does NOT apply here.)"),
])
def test_perturbations(spark, kind, question, expected):
    assert check(spark, perturb.PERTURBATIONS[kind], question) == expected


def test_jaccard_counts_letters_outside_ascii(spark):
    df = spark.createDataFrame([("Écoute là, écoute", "là été")], "a string, b string")
    assert df.select(at.jaccard(at.words(F.col("a")), at.words(F.col("b"))).alias("x")).first().x == pytest.approx(1 / 3)


def test_plurality_vote(spark):
    rows = [("m", 1, i, 10 + i, t) for i, t in enumerate(["a b c", "a b", "x", "", "a b"])]
    rows += [("m", 2, 3, 9, "only")]
    samples = spark.createDataFrame(rows, "model_id string, question_id int, sample_idx int, run_id int, answer string")
    got = {r.question_id: (r.best_idx, r.best_answer, r.samples) for r in consensus.plurality_vote(samples).collect()}
    assert got == {1: (1, "a b", 4), 2: (3, "only", 1)}


def test_sample_outside_the_plan_is_an_error(spark):
    samples = spark.createDataFrame([("m", 1, 7, 1, "a")], "model_id string, question_id int, sample_idx int, run_id int, answer string")
    with pytest.raises(Exception, match="outside the plan"):
        consensus.plurality_vote(samples).collect()


@pytest.mark.parametrize("overrides", [{}, {"temperature": 0.0, "top_p": 0.95}, {"seed": 137, "system_prompt_style": "minimal"}])
def test_hyperparam_hash_is_that_of_sorted_json(spark, overrides):
    defaults = {"temperature": 0.3, "top_p": 0.9, "max_tokens": 1024, "top_k": -1, "presence_penalty": 0.0,
                "frequency_penalty": 0.0, "system_prompt_style": "expert-persona", "seed": None}
    wanted = hashlib.sha256(json.dumps({**defaults, **overrides}, sort_keys=True).encode()).hexdigest()[:16]
    df = spark.createDataFrame([(json.dumps(overrides),)], "hyperparams string")
    assert keys.with_hyperparam_hash(df).first().hyperparam_hash == wanted
    assert keys.config_digest({k: json.dumps(v) for k, v in overrides.items()}) == wanted


def test_sheet(spark):
    rows = [
        (1, "design", " Crash Recovery ", 'questions = ["Exercise 5.1: Trace it", \'# Exercise 5.2\\nName\\n\', " "]', "['one']"),
        (2, None, "other", "just text", None), (3, None, None, "dropped", None), (4, "next", "s", '[1, "x"]', "[oops"),
    ]
    sheet = spark.createDataFrame(rows, "row_no int, topic string, subtopic string, questions string, answers string")
    got = ingest.explode_question_sheet(sheet).orderBy("global_index").collect()
    assert [(r.topic, r.subtopic, r.exercise_number, r.question_text, r.expected_answer) for r in got] == [
        ("DESIGN", "CRASH RECOVERY", "Exercise 5.1", "Trace it", "one"),
        ("DESIGN", "CRASH RECOVERY", "Exercise 5.2", "Name", None),
        ("DESIGN", "OTHER", None, "just text", None),
        ("NEXT", "S", None, "1", "[oops"), ("NEXT", "S", None, "x", None),
    ]
    assert [r.difficulty for r in got] == ["hard", "medium", "medium", "medium", "medium"]
    first = hashlib.md5(b"DESIGN|CRASH RECOVERY|Exercise 5.1|0").hexdigest()[:12]
    assert got[0].question_id == first
    assert keys.id_to_uuid(F.lit("c6c4ce7444f2")) is not None


def test_rename_whole_words_only(spark):
    answers = spark.createDataFrame([("0def7bdc534e", "femployees ffrom ffroms Ffrom"), ("x", "ffrom")], "question_id string, answer string")
    maps = spark.createDataFrame(list(fv.RENAME_MAPS.items()), "question_id string, names map<string,string>")
    got = {r.question_id: r.answer for r in answer_scan.rename_identifiers(answers, maps, "question_id").collect()}
    assert got == {"0def7bdc534e": "Employees from ffroms Ffrom", "x": "ffrom"}
