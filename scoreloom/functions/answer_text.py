"""Checks on answer text as built-in column expressions.

Regular expressions carry ``(?U)`` so that letters outside ASCII count as word
characters, and ``(?d)`` where a line ends at a newline only.
"""

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.functions import fixed_values as fv

SQL_BLOCK = r"(?s)```(?:sql|SQL)\s*\n.*?```"
ANY_BLOCK = r"(?s)```(?:sql|SQL)?\s*\n(.*?)```"


class Searchable(NamedTuple):
    """A text column and its case-folded copy.

    A plain substring test on the folded copy rules most texts out before a
    regular expression runs on the text itself.
    """

    raw: Column
    folded: Column


def searchable(df: DataFrame, column: str) -> tuple[DataFrame, Searchable]:
    """Add the folded copy of a text column, computed once for all checks on it.

    Upper before lower also folds letters such as the long s that match their
    plain form in a case-insensitive search.
    """
    name = f"{column}__folded"
    return df.withColumn(name, F.lower(F.upper(column))), Searchable(F.col(column), F.col(name))


def required_words(pattern: str) -> list[str]:
    """Per alternative of a pattern, its longest stretch that must occur literally."""
    words = []
    for branch in _top_level(pattern):
        literal = re.sub(r"\\[bsdSWw][*+]?|\(\?:[^()]*\)\??|\([^()]*\)\??|\[[^\]]*\][?*+]?|.[?*]", "\0", branch)
        literal = literal.replace("\\", "").replace("^", "\0").replace("$", "\0").replace("+", "\0")
        words.append(max(literal.split("\0"), key=len).lower())
    return words


def _top_level(pattern: str) -> list[str]:
    """Alternatives of a pattern that is an alternation as a whole."""
    whole = re.fullmatch(r"\\b\(([^()]*)\)\\b", pattern)
    if whole:
        return whole.group(1).split("|")
    return [pattern] if "(" in pattern.replace("\\(", "") else pattern.split("|")


def found(text: Searchable, pattern: str) -> Column:
    """Case-insensitive search anywhere in the text."""
    words = [w for w in required_words(pattern)]
    match = F.coalesce(text.raw.rlike("(?iU)" + pattern), F.lit(False))
    if not all(words):
        return match
    return contains_any(text.folded, words) & match


def contains_any(text: Column, words: list[str]) -> Column:
    expr = F.lit(False)
    for word in words:
        expr = expr | F.coalesce(F.contains(text, F.lit(word)), F.lit(False))
    return expr


def is_blank(text: Column) -> Column:
    return text.isNull() | ~text.rlike(r"(?U)\S")


def strip(text: Column) -> Column:
    """Trim every kind of white space from both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def word_count(text: Column) -> Column:
    """Number of white-space separated words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"(?U)\S+")), F.lit(0))


def words(text: Column) -> Column:
    """Distinct lower-case words of a text, an empty array for null."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.coalesce(F.array_distinct(tokens), F.array().cast("array<string>"))


def jaccard(left: Column, right: Column) -> Column:
    """|common| / |all| of two distinct-word arrays, 0 if either is empty."""
    common = F.size(F.array_intersect(left, right)).cast("double")
    total = F.size(left) + F.size(right) - common
    return F.when((F.size(left) == 0) | (F.size(right) == 0), F.lit(0.0)).otherwise(common / total)


# --- format checks -----------------------------------------------------------


def sql_block_score(text: Searchable) -> Column:
    """1 for a fenced SQL block less .15 per prose line in it (at least .5), .3 for bare SQL."""
    answer = text.raw
    block = F.regexp_extract(answer, SQL_BLOCK, 0)
    lines = F.split(block, "\n")
    inner = F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 2, F.lit(0)))
    starts = rf"(?iU)^\s*(?:{fv.SQL_LINE_START})"
    prose = F.filter(inner, lambda l: ~l.rlike(starts) & l.rlike(r"(?sU)\S.{19,}\S"))
    fenced = F.greatest(F.lit(0.5), 1.0 - F.least(F.size(prose) * 0.15, F.lit(0.5)))
    return (
        F.when(F.coalesce(answer, F.lit("")) == "", F.lit(0.0))
        .when(F.contains(answer, F.lit("```")) & (block != ""), fenced)
        .when(found(text, fv.UNFENCED_SQL), F.lit(0.3))
        .otherwise(F.lit(0.0))
    )


def numbered_lines(answer: Column) -> Column:
    """Lines that start with '1.', 'Step 1:', '1)' or '(1)'."""
    gap = r"[^\S\n]"
    marks = [r"\d+\.", rf"step{gap}+\d+:", r"\d+\)", r"\(\d+\)"]
    pattern = rf"(?imdU)^{gap}*(?:" + "|".join(marks) + ")"
    return F.coalesce(F.regexp_count(answer, F.lit(pattern)), F.lit(0))


def numbered_score(answer: Column) -> Column:
    steps = numbered_lines(answer)
    return F.when(steps >= 3, F.lit(1.0)).when(steps >= 1, F.lit(0.5)).otherwise(F.lit(0.0))


def schema_score(answer: Searchable) -> Column:
    """.7 for a table definition, .2 more for a foreign key, .1 more for an alteration or index."""
    extra = found(answer, r"\bALTER\s+TABLE\b") | found(answer, r"\bCREATE\s+INDEX\b")
    ddl = (
        F.lit(0.7)
        + F.when(found(answer, r"\bFOREIGN\s+KEY\b"), F.lit(0.2)).otherwise(F.lit(0.0))
        + F.when(extra, F.lit(0.1)).otherwise(F.lit(0.0))
    )
    return (
        F.when(found(answer, r"\bCREATE\s+TABLE\b"), F.least(ddl, F.lit(1.0)))
        .when(found(answer, fv.SCHEMA_PROSE), F.lit(0.3))
        .otherwise(F.lit(0.0))
    )


def length_score(answer: Column, instruction: Column) -> Column:
    """Whether an explicit length instruction was followed; 1 where none is given."""
    asked = F.lower(instruction)
    paragraphs = F.size(F.filter(F.split(answer, "\n\n"), lambda p: p.rlike(r"(?U)\S")))
    count = word_count(answer)
    paragraph_ok = (paragraphs == 1) & count.between(30, 250)
    wanted = F.regexp_extract(asked, r"(?U)list\s+(\d+)\s+key\s+points?", 1)
    bullets = F.regexp_count(answer, F.lit(r"(?mdU)^[^\S\n]*[-•*\d]"))
    points_ok = F.coalesce(F.abs(bullets - wanted.try_cast("int")) <= 1, F.lit(False))  # no text has that many
    one_paragraph = F.contains(asked, F.lit("one paragraph")) | F.contains(asked, F.lit("single paragraph"))
    absent = (F.coalesce(answer, F.lit("")) == "") | (F.coalesce(instruction, F.lit("")) == "")
    return (
        F.when(absent, F.lit(1.0))
        .when(one_paragraph, F.when(paragraph_ok, F.lit(1.0)).otherwise(F.lit(0.4)))
        .when(wanted != "", F.when(points_ok, F.lit(1.0)).otherwise(F.lit(0.5)))
        .otherwise(F.lit(1.0))
    )


def strip_fences(text: Column) -> Column:
    """Drop markdown fences around a JSON reply."""
    opened = F.regexp_replace(strip(text), r"(?mdU)^```(?:json)?\s*", "")
    return strip(F.regexp_replace(opened, r"(?mdU)\s*```$", ""))


# --- idioms and factual findings ----------------------------------------------


def idiom_score(text: Searchable) -> Column:
    """.15 per idiom up to 1, .1 off per anti-pattern, at least .5 for plain SQL."""
    hits = F.array(*[found(text, p).cast("int") for p in fv.IDIOM_PATTERNS])
    features = F.aggregate(hits, F.lit(0), lambda total, hit: total + hit)
    cast_call = found(text, fv.CAST_CALL) & ~found(text, fv.CAST_IDIOM)
    nested = found(text, fv.NESTED_SELECT) & ~found(text, fv.LATERAL_IDIOM)
    parts = F.struct(
        features.alias("features"),
        ((cast_call.cast("int") + nested.cast("int")) * 0.10).alias("penalty"),
    )

    def score(p):
        base = F.greatest(F.lit(0.0), F.least(p["features"] * 0.15, F.lit(1.0)) - p["penalty"])
        plain = (p["features"] == 0) & found(text, fv.SQL_LIKE)
        return F.round(F.when(plain, F.greatest(base, F.lit(0.5))).otherwise(base), 4)

    # a one-element array binds the parts, so that each pattern is tried once
    return F.get(F.transform(F.array(parts), score), F.lit(0))


def unknown_functions(answer: Column) -> Column:
    """Distinct called names that claim to be built in and are not known."""
    called = F.array_distinct(
        F.regexp_extract_all(answer, F.lit(r"(?iU)\b([A-Za-z_][A-Za-z0-9_]*)\s*\("), F.lit(1))
    )
    none = F.array().cast("array<string>")
    ignored = fv.SQL_KEYWORDS_BEFORE_PAREN + fv.KNOWN_SQL_FUNCTIONS
    suspicious = "(?iU)" + "|".join(fv.SUSPICIOUS_FUNCTION_NAMES)
    flagged = F.filter(called, lambda n: n.rlike(suspicious) & ~F.lower(n).isin(ignored))
    # a flagged name holds an underscore and is followed by a parenthesis
    possible = F.contains(answer, F.lit("(")) & F.contains(answer, F.lit("_"))
    return F.when(possible, flagged).otherwise(none)


def finding(kind, text, severity, source) -> Column:
    return F.struct(
        F.lit(kind).alias("hallucination_type"),
        text.alias("description"),
        F.lit(severity).alias("severity"),
        F.lit(source).alias("detected_by"),
    )


def no_findings() -> Column:
    return F.array().cast(
        "array<struct<hallucination_type:string,description:string,severity:string,detected_by:string>>"
    )


def unknown_function_findings(answer: Column) -> Column:
    return F.transform(
        unknown_functions(answer),
        lambda n: finding(
            "fabricated_sql_function",
            F.concat(F.lit("Unknown PostgreSQL function: "), n, F.lit("(…)")),
            "critical",
            "regex+pg_catalog",
        ),
    )


def invented_constraint_findings(answer: Searchable) -> Column:
    hits = [
        F.when(found(answer, p), finding(
            "invented_constraint_type",
            F.lit("Non-existent PostgreSQL construct matching: " + p),
            "high",
            "regex",
        ))
        for p in fv.INVENTED_CONSTRAINTS
    ]
    return F.array_compact(F.array(*hits))


def wrong_fact_findings(answer: Searchable) -> Column:
    lowered = F.lower(answer.raw)
    hits = [
        F.when(
            contains_any(answer.folded, required_words(p)) & F.coalesce(lowered.rlike("(?U)" + p), F.lit(False)),
            finding("wrong_fact", F.lit(text), severity, "ground_truth_comparison"),
        )
        for p, text, severity in fv.WRONG_FACTS
    ]
    return F.array_compact(F.array(*hits))


def automated_findings(answer: Searchable) -> Column:
    """All findings of the three scans; none for a blank answer."""
    scans = F.concat(
        unknown_function_findings(answer.raw),
        invented_constraint_findings(answer),
        wrong_fact_findings(answer),
    )
    return F.when(is_blank(answer.raw), no_findings()).otherwise(scans)


# --- SQL candidates ------------------------------------------------------------


def first_statement(block: Column) -> Column:
    """First statement of a block that starts with an SQL keyword, else the whole block."""
    bare = F.transform(
        F.split(block, ";"), lambda s: strip(F.regexp_replace(s, r"--[^\n]*", ""))
    )
    keyword = r"(?iU)^(?:" + "|".join(fv.STATEMENT_STARTS) + r")\b"
    return F.coalesce(F.get(F.filter(bare, lambda s: s.rlike(keyword)), F.lit(0)), strip(block))


def is_query(statement: Column) -> Column:
    return statement.rlike(r"(?iU)^\s*(?:" + "|".join(fv.QUERY_STARTS) + r")\b")


def sql_candidates(text: Searchable) -> Column:
    """First query of every fenced block, else the first query found in the text."""
    answer, none = text.raw, F.array().cast("array<string>")
    fences = F.contains(answer, F.lit("```"))
    blocks = F.when(fences, F.regexp_extract_all(answer, F.lit(ANY_BLOCK), F.lit(1))).otherwise(none)
    keywords = "(?:" + "|".join(fv.STATEMENT_STARTS) + ")"
    loose = F.regexp_extract(answer, rf"(?isU)({keywords}\b.*?)(?:\n\n|\z)", 1)

    def choose(blocks):
        fenced = F.filter(F.transform(blocks, first_statement), is_query)
        single = first_statement(
            F.when(F.size(blocks) > 0, F.get(blocks, F.lit(0)))
            .when(loose != "", loose)
            .when(answer.rlike(r"(?iU)" + keywords), answer)
        )
        fallback = F.filter(F.array(single), is_query)
        return F.when(F.size(fenced) > 0, fenced).otherwise(fallback)

    found_any = F.get(F.transform(F.array(blocks), choose), F.lit(0))
    return F.when(contains_any(text.folded, [k.lower() for k in fv.STATEMENT_STARTS]), found_any).otherwise(none)
