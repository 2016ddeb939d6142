"""Routing of a question by its type and tags."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def has_tag(tags: Column, tag: str) -> Column:
    return F.coalesce(F.array_contains(tags, tag), F.lit(False))


def needs_sql_harness(question_type: Column, tags: Column) -> Column:
    return (question_type == "practical") & has_tag(tags, "sql")


def needs_numbered_steps(question_type: Column, tags: Column) -> Column:
    return (question_type == "practical") & has_tag(tags, "transactions")


def needs_sql_rubric(tags: Column) -> Column:
    return has_tag(tags, "sql")


def correctness_route(question_type: Column, tags: Column) -> Column:
    """Which scorer decides the correctness pillar."""
    return (
        F.when(needs_sql_harness(question_type, tags), "sql")
        .when(has_tag(tags, "transactions"), "transaction")
        .when(has_tag(tags, "normalization"), "normalization")
        .otherwise("conceptual")
    )
