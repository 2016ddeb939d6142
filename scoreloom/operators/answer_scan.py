"""Scans over answer texts: format, idioms, findings and SQL candidates.

Every scan is a projection of the answers; nothing is shuffled before the
per-row figures (a few bytes per answer) are grouped.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.functions import answer_text as at
from scoreloom.functions import fixed_values as fv
from scoreloom.functions import pillars, tags
from scoreloom.functions.numbers import report_round
from scoreloom.functions.prompt_texts import (
    ANSWER_CHAR_LIMIT, ANSWER_NOTE, REFERENCE_CHAR_LIMIT, REFERENCE_NOTE,
)
from scoreloom.functions.strict_json import json_valid_score, reply_object


def format_compliance(
    question_type: Column, tag_list: Column, answer: at.Searchable,
    instruction: Column | None = None, formats: list[str] = (),
) -> Column:
    """Weighted format score; a check that does not apply counts as passed."""
    sql = F.lit("sql_block" in formats) | tags.needs_sql_harness(question_type, tag_list)
    steps = F.lit("numbered" in formats) | tags.needs_numbered_steps(question_type, tag_list)
    ddl = F.lit("ddl" in formats) | tags.needs_sql_harness(question_type, tag_list)
    one = F.lit(1.0)
    w = fv.FORMAT_WEIGHTS
    total = (
        w["json"] * (json_valid_score(answer.raw) if "json" in formats else one)
        + w["sql_block"] * F.when(sql, at.sql_block_score(answer)).otherwise(one)
        + w["numbered"] * F.when(steps, at.numbered_score(answer.raw)).otherwise(one)
        + w["schema"] * F.when(ddl, at.schema_score(answer)).otherwise(one)
        + w["length"] * (one if instruction is None else at.length_score(answer.raw, instruction))
    )
    return report_round(total, 4)


def compliance_by_strategy(answers: DataFrame) -> DataFrame:
    answers, text = at.searchable(answers, "answer")
    score = format_compliance(F.col("question_type"), F.col("tags"), text, F.col("length_instruction"))
    return answers.groupBy("model_id", "prompt_strategy").agg(
        F.count("*").alias("answers"), report_round(F.avg(score), 4).alias("avg_format_compliance")
    )


def findings(answers: DataFrame, scan: Callable[[at.Searchable], Column] = at.automated_findings) -> DataFrame:
    """One row per automated finding."""
    answers, text = at.searchable(answers, "answer")
    return answers.filter(~at.is_blank(text.raw)).select("answer_id", "model_id", F.inline(scan(text)))


def merge_findings(automated: DataFrame, judged: DataFrame) -> DataFrame:
    """Automated and judge findings together, duplicates kept."""
    return automated.unionByName(judged)


def finding_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("model_id", "hallucination_type", "severity").agg(
        F.count("*").alias("findings")
    )


def severity_by_answer(found: DataFrame) -> DataFrame:
    """Severity score with critical and high counts of every answer that has findings."""
    return found.groupBy("answer_id").agg(
        F.count("*").alias("findings"),
        F.sum(pillars.severity_weight(F.col("severity"))).alias("weight"),
        F.count_if(F.col("severity") == "critical").alias("critical_count"),
        F.count_if(F.col("severity") == "high").alias("high_count"),
    ).withColumn(
        "severity_score", report_round(pillars.severity_of(F.col("weight"), F.col("findings")), 6)
    ).drop("weight")


def sql_candidates(answers: DataFrame) -> DataFrame:
    """One row per candidate query of an answer, in text order."""
    answers, text = at.searchable(answers, "answer")
    return answers.select("answer_id", F.posexplode(at.sql_candidates(text)).alias("candidate_idx", "sql"))


def rename_identifiers(answers: DataFrame, maps: DataFrame, key: str) -> DataFrame:
    """Whole-word renames from a map per key; answers without a map stay as they are.

    ``maps`` has one row per key with the names as map<string,string>; the
    names apply in the order of the map.
    """
    renamed = F.aggregate(
        F.map_entries("names"), F.col("answer"),
        lambda text, e: F.regexp_replace(
            text, F.concat(F.lit(r"(?U)\b\Q"), e["key"], F.lit(r"\E\b")), e["value"]
        ),
    )
    return answers.join(maps, key, "left").withColumn(
        "answer", F.when(F.col("names").isNull(), F.col("answer")).otherwise(renamed)
    ).drop("names")


def expected_words(reference: Column) -> Column:
    missing = F.coalesce(reference, F.lit("")) == ""
    return F.when(missing, F.lit(fv.DEFAULT_EXPECTED_WORDS)).otherwise(
        F.greatest(at.word_count(reference), F.lit(1))
    )


def reference_sizes(references: DataFrame) -> DataFrame:
    """Word count of every expected answer, so that joins carry a number, not the text."""
    return references.select("question_id", expected_words(F.col("expected_answer")).alias("expected_words"))


def verbosity(answers: DataFrame, references: DataFrame) -> DataFrame:
    """Answer length against the expected answer's, with the factor it puts on the F1 term."""
    sizes = answers.select("answer_id", "question_id", at.word_count(F.col("answer")).alias("answer_words"))
    ratio = F.col("answer_words") / F.coalesce("expected_words", F.lit(fv.DEFAULT_EXPECTED_WORDS))
    return sizes.join(reference_sizes(references), "question_id", "left").select(
        "answer_id",
        report_round(ratio, 6).alias("verbosity_ratio"),
        pillars.verbosity_factor(ratio).alias("verbosity_factor"),
    )


JUDGE_FINDINGS = "array<struct<type:string,text:string,severity:string>>"


def parse_judge_replies(replies: DataFrame) -> DataFrame:
    """Clean score fields of every reply; unreadable ones get the neutral fallback.

    A field the judge left out takes the normalised score. A reply with a score or field that is
    no number counts as unreadable.
    """
    body = F.col("body")

    def number(name):
        return F.get_json_object(body, f"$.{name}").try_cast("double")

    def broken(name):
        return F.get_json_object(body, f"$.{name}").isNotNull() & number(name).isNull()

    unreadable = body.isNull()
    for name in ("score", *fv.CONCEPTUAL_WEIGHTS):
        unreadable = unreadable | broken(name)
    parsed = replies.withColumn("body", reply_object(F.col("reply"))).withColumn("parse_error", unreadable)
    score = F.when(F.col("parse_error"), F.lit(5.0)).otherwise(F.coalesce(number("score"), F.lit(5.0)))
    parsed = parsed.withColumn("judge_score_0_10", score)
    norm = pillars.judge_norm(F.col("judge_score_0_10"))
    fields = {
        name: F.when(F.col("parse_error"), F.lit(0.5)).otherwise(
            F.coalesce(number(name), norm)
        )
        for name in fv.CONCEPTUAL_WEIGHTS
    }
    found = F.coalesce(
        F.from_json(F.get_json_object(body, "$.hallucinations"), JUDGE_FINDINGS),
        F.array().cast(JUDGE_FINDINGS),
    )
    return parsed.withColumns({**fields, "judge_findings": found}).drop("reply", "body")


def fallback_fields(score: Column) -> dict:
    """Sub-scores of a run whose judge call failed."""
    tenth = score / 10
    return {
        "factual_correctness": tenth,
        "completeness": tenth,
        "absence_of_contradiction": F.greatest(F.lit(0.0), (score - 0.5) / 10),
        "topic_specificity": tenth,
    }


def cut(text: Column, limit: int, note: str) -> Column:
    """Text for a judge prompt: cut at a limit with a note on the original length."""
    noted = F.concat(F.substring(text, 1, limit), F.format_string(note, F.length(text).cast("string")))
    return F.when(F.length(text) > limit, noted).otherwise(text)


def truncate_for_judge(answers: DataFrame, references: DataFrame) -> DataFrame:
    """What the judge gets to read; texts are cut before the join, which then moves less."""
    short_answers = answers.select(
        "answer_id", "question_id", cut(F.col("answer"), ANSWER_CHAR_LIMIT, ANSWER_NOTE).alias("judge_answer")
    )
    short_references = references.select("question_id", cut(
        F.col("expected_answer"), REFERENCE_CHAR_LIMIT, REFERENCE_NOTE
    ).alias("judge_reference"))
    return short_answers.join(short_references, "question_id", "left").select(
        "answer_id", "judge_reference", "judge_answer"
    )
