"""Question-bank ingestion, upserts and run deduplication."""

import ast
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from scoreloom.functions import fixed_values as fv
from scoreloom.functions.answer_text import contains_any, strip
from scoreloom.functions.keys import stable_question_id
from scoreloom.operators.ordering import with_carried, with_sum_before
from scoreloom.session import new_folder


# --- classification -------------------------------------------------------------

EXERCISE = r"(?iU)^(Exercise\s+[\d.]+):?\s*"
EXERCISE_HEADING = r"(?iU)^#+\s*(Exercise\s+[\d.]+)\s*\n+"


def exercise_number(text: Column) -> Column:
    """'Exercise 5.1' from a plain or heading prefix, null without one."""
    found = F.coalesce(
        F.nullif(F.regexp_extract(strip(text), EXERCISE, 1), F.lit("")),
        F.regexp_extract(strip(text), EXERCISE_HEADING, 1),
    )
    return F.nullif(strip(found), F.lit(""))


def without_exercise(text: Column) -> Column:
    bare = strip(text)
    plain = F.regexp_replace(bare, EXERCISE, "")
    return strip(F.when(plain != bare, plain).otherwise(F.regexp_replace(bare, EXERCISE_HEADING, "")))


def difficulty(exercise: Column, lowered: Column) -> Column:
    """Hard word, else medium word, else easy for an odd last exercise number, else medium."""
    last = F.regexp_extract(exercise, r"(\d+)\D*$", 1).try_cast("long")
    return (
        F.when(contains_any(lowered, fv.HARD_WORDS), "hard")
        .when(contains_any(lowered, fv.MEDIUM_WORDS), "medium")
        .when(last % 2 == 1, "easy")
        .otherwise("medium")
    )


def tag_list(lowered: Column) -> Column:
    """Sorted tags whose words occur anywhere in the lower-cased text."""
    hits = [F.when(contains_any(lowered, words), F.lit(tag)) for tag, words in sorted(fv.TAG_WORDS.items())]
    return F.array_compact(F.array(*hits))


def type_of_subtopic(subtopic: Column) -> Column:
    practical = [s for s, kind in fv.SUBTOPIC_TYPES.items() if kind == "practical"]
    return F.when(subtopic.isin(practical), "practical").otherwise("conceptual")


def classify_questions(questions: DataFrame) -> DataFrame:
    """Add exercise number, cleaned text, type, difficulty and tags to raw question texts."""
    return (
        questions.withColumn("exercise_number", exercise_number(F.col("question_text")))
        .withColumn("question_text", without_exercise(F.col("question_text")))
        .withColumn("__lowered", F.lower("question_text"))
        .withColumns({
            "question_type": type_of_subtopic(F.col("subtopic")),
            "difficulty": difficulty(F.col("exercise_number"), F.col("__lowered")),
            "tags": tag_list(F.col("__lowered")),
        })
        .drop("__lowered")
    )


# --- question sheet ----------------------------------------------------------------


# fixed value: an assignment of a list literal inside a cell
LIST_CELL = re.compile(r"(?:questions|answers)\s*=\s*(\[.*\])", re.DOTALL)


def _items(cell):
    """Items of a list literal, the whole cell where it holds none."""
    text = (cell or "").strip()
    named = LIST_CELL.search(text)
    literals = [named.group(1)] if named else []
    literals += [text] if text.startswith("[") else []
    for literal in literals:
        try:
            items = ast.literal_eval(literal)
        except (ValueError, SyntaxError):
            continue
        if isinstance(items, list):
            trimmed = (str(item).strip() for item in items)
            return [item for item in trimmed if item]
    return [text] if text else []


@F.pandas_udf(ArrayType(StringType()))
def list_items(cells: pd.Series) -> pd.Series:
    return cells.map(_items)


def explode_question_sheet(sheet: DataFrame) -> DataFrame:
    """One classified question per item of the sheet's list cells.

    ``sheet`` has row_no, topic (only on the first row of a block), subtopic,
    questions and answers.
    """
    def upper(name):
        return F.upper(strip(F.coalesce(name, F.lit("")))).alias(name)

    folder = new_folder(sheet.sparkSession, "sheet")
    parsed = sheet.select(
        "row_no", "topic", upper("subtopic"), list_items("questions").alias("questions"), list_items("answers").alias("answers"),
    ).withColumn("row", F.monotonically_increasing_id())
    # cells are parsed and written once; only row numbers, topics and counts are put in order
    parsed.write.parquet(folder)
    cells = sheet.sparkSession.read.schema(parsed.schema).parquet(folder)
    count = F.when(F.col("subtopic") != "", F.greatest(F.size("questions"), F.lit(0))).otherwise(F.lit(0))
    order = ["row_no", "row"]
    rows = with_sum_before(with_carried(
        cells.select("row_no", "row", "topic", count.alias("items")), order, "topic", "topic_filled"), order, "items", "before")
    filled = cells.filter(F.col("subtopic") != "").drop("topic", "row_no").join(
        rows.select("row", upper("topic_filled").alias("topic"), "before"), "row")
    items = filled.select("topic", "subtopic", "answers", "before", F.posexplode("questions").alias("item", "question_text"))
    answer = F.nullif(strip(F.coalesce(F.get("answers", F.col("item")), F.lit(""))), F.lit(""))
    placed = items.withColumn("expected_answer", answer).withColumn("global_index", F.col("before") + F.col("item"))
    indexed = classify_questions(placed.drop("answers", "before", "item"))
    return indexed.withColumn(
        "question_id", stable_question_id(F.col("topic"), F.col("subtopic"), F.col("exercise_number"), F.col("global_index"))
    )


def dedupe_questions(questions: DataFrame, excluded_tag: str | None = "er_diagram") -> DataFrame:
    """The smallest id of every distinct normalised question text.

    Only a digest and the id are shuffled, not the text.
    """
    rows = questions
    if excluded_tag:
        rows = rows.filter(~F.array_contains("tags", excluded_tag))
    text = F.lower(strip(F.regexp_replace("question_text", r"(?U)\s+", " ")))
    return rows.groupBy(F.md5(text).alias("text_key")).agg(
        F.min("question_id").alias("question_id"), F.count("*").alias("copies")
    ).drop("text_key")


# --- upserts -------------------------------------------------------------------------


def upsert_names(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows plus the incoming natural keys that are new, with a stable id."""
    fresh = incoming.select(*keys).distinct().join(stored, keys, "left_anti")
    digest = F.substring(F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys])), 1, 12)
    return stored.select("id", *keys).unionByName(fresh.select(digest.alias("id"), *keys))


def upsert_questions(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Insert or update questions by id.

    An update overwrites the texts and labels, keeps the exercise number, and
    replaces the fixture only by a value.
    """
    new, old = incoming.alias("new"), stored.alias("old")
    present = F.col("new.question_id").isNotNull()

    def overwritten(name):
        return F.when(present, F.col(f"new.{name}")).otherwise(F.col(f"old.{name}")).alias(name)

    inserted = F.col("old.question_id").isNull()
    return old.join(new, F.col("old.question_id") == F.col("new.question_id"), "full").select(
        F.coalesce("new.question_id", "old.question_id").alias("question_id"),
        *[overwritten(n) for n in ("question_text", "expected_answer", "question_type", "difficulty")],
        F.when(inserted, F.col("new.exercise_number")).otherwise(F.col("old.exercise_number")).alias("exercise_number"),
        F.coalesce("new.schema_fixture", "old.schema_fixture").alias("schema_fixture"),
    )


def upsert_models(stored: DataFrame, challengers: DataFrame, judges: DataFrame) -> DataFrame:
    """Register models; a judge entry wins over a challenger of the same id.

    The provider of a stored model is kept.
    """
    incoming = challengers.withColumn("is_judge", F.lit(False)).unionByName(
        judges.withColumn("is_judge", F.lit(True))
    )
    fields = [c for c in incoming.columns if c != "model_id"]
    merged = incoming.groupBy("model_id").agg(
        F.max_by(F.struct(*fields), "is_judge").alias("entry")
    ).select("model_id", "entry.*")
    new, old = merged.alias("new"), stored.alias("old")
    present = F.col("new.model_id").isNotNull()
    columns = [
        F.coalesce("old.provider", "new.provider").alias("provider") if name == "provider"
        else F.when(present, F.col(f"new.{name}")).otherwise(F.col(f"old.{name}")).alias(name)
        for name in fields
    ]
    return old.join(new, F.col("old.model_id") == F.col("new.model_id"), "full").select(
        F.coalesce("new.model_id", "old.model_id").alias("model_id"), *columns
    )


# --- runs ----------------------------------------------------------------------------

RUN_KEY = ["question_id", "model_id", "prompt_strategy", "hyperparam_hash"]


def dedupe_runs(runs: DataFrame, force_rerun: bool = False, key: list[str] = RUN_KEY) -> DataFrame:
    """One run per configuration: the first, or the last where reruns replace.

    Spark keeps one row per key in each map task before the shuffle (window
    group limit), so a hot configuration does not reach one task whole.
    """
    time, tie = F.col("run_timestamp"), F.col("run_id")
    order = [time.desc(), tie.desc()] if force_rerun else [time, tie]
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return runs.withColumn("__rank", rank).filter(F.col("__rank") == 1).drop("__rank")


def new_latency_records(telemetry: DataFrame, stored: DataFrame) -> DataFrame:
    """Telemetry rows of completed runs that have no record yet."""
    done = telemetry.filter(F.col("status") == "completed")
    return done.join(stored, "run_id", "left_anti").select(
        "run_id", "ttft_ms", "total_latency_ms", "tokens_per_second", "cost_usd",
        "input_tokens", "output_tokens", F.col("retry_count").alias("api_retry_count"),
        F.col("run_timestamp").alias("recorded_at"),
    )
