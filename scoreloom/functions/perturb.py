"""Perturbed versions of a question as regular-expression chains."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from scoreloom.functions import fixed_values as fv
from scoreloom.functions.answer_text import Searchable, contains_any, required_words, strip


def replace_first(text: Column, pattern: str, replacement: str) -> Column:
    """Replace only the first match; group numbers in the replacement start at $2."""
    return F.regexp_replace(text, r"(?isdU)\A(.*?)" + pattern, "$1" + replacement)


def rephrase(text: Searchable) -> Column:
    question = text.raw
    changed = reduce(
        lambda q, rule: F.regexp_replace(q, "(?idU)" + rule[0], rule[1]), fv.REPHRASE_RULES, question
    )
    return F.when(changed != question, changed).otherwise(F.concat(question, F.lit(fv.REPHRASE_SUFFIX)))


def rename_variables(text: Searchable) -> Column:
    words = [w for pattern, _ in fv.SYNONYMS for w in required_words(pattern)]
    renamed = reduce(lambda q, rule: F.regexp_replace(q, "(?iU)" + rule[0], rule[1]), fv.SYNONYMS, text.raw)
    return F.when(contains_any(text.folded, words), renamed).otherwise(text.raw)


def invert_order(text: Searchable) -> Column:
    """Reverse a numbered list, else the items of the first parenthesised list."""
    question = text.raw
    items = F.split(question, r"(?U)\n\s*\d+\.\s+", -1)
    parts = F.reverse(F.slice(items, F.lit(2), F.size(items)))
    numbered = F.transform(
        parts, lambda p, i: F.concat(F.lit("\n"), (i + 1).cast("string"), F.lit(". "), p)
    )
    relisted = F.concat(F.get(items, F.lit(0)), F.array_join(numbered, ""))
    inner = F.regexp_extract(question, r"(?U)\(([^)]+,\s*[^)]+)\)", 1)
    reversed_inner = F.array_join(F.reverse(F.transform(F.split(inner, ","), strip)), ", ")
    return (
        F.when(F.size(items) > 2, relisted)
        .when(inner != "", F.replace(question, inner, reversed_inner))
        .otherwise(question)
    )


def inject_typo(text: Searchable) -> Column:
    """Misspell the first listed term that occurs, once."""
    question, expr = text.raw, None
    for right, wrong in fv.TYPOS:
        hit = F.contains(text.folded, F.lit(right))
        changed = replace_first(question, right, wrong)
        expr = F.when(hit, changed) if expr is None else expr.when(hit, changed)
    return expr.otherwise(question)


def negate(text: Searchable) -> Column:
    """Negate the first verb that is not negated yet, else add a closing note."""
    question = text.raw
    changed = replace_first(question, r"\b(is|are|does|do)\b(?!\s+not)", "$2 NOT")
    stripped = strip(question)
    noted = F.when(
        F.endswith(stripped, F.lit("?")),
        F.concat(F.regexp_replace(stripped, r"\?\z", ""), F.lit(fv.NEGATED_QUESTION_SUFFIX)),
    ).otherwise(F.concat(question, F.lit(fv.NEGATED_STATEMENT_SUFFIX)))
    return F.when(changed != question, changed).otherwise(noted)


PERTURBATIONS = {
    "syntactic_rephrasing": rephrase,
    "variable_name_change": rename_variables,
    "order_inversion": invert_order,
    "typo_injection": inject_typo,
    "negation_injection": negate,
}
