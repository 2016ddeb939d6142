"""Strict JSON parsing of short replies.

Spark's own JSON functions accept text after the first value, which must count
as invalid here. Validity is decided by them with a tag after the value, and by one Arrow-batched UDF where they
leave it open; replies are re-written by that UDF and every field is then read with the built-in functions.
"""

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from scoreloom.functions.answer_text import strip_fences


def _normalised(text):
    if text is None:
        return None
    try:
        return json.dumps(json.loads(text))
    except ValueError:
        return None


@F.pandas_udf(StringType())
def valid_json(texts: pd.Series) -> pd.Series:
    """The text re-written as JSON, null where it is not valid."""
    return texts.map(_normalised)


@F.pandas_udf(StringType())
def first_valid_json(whole: pd.Series, part: pd.Series) -> pd.Series:
    """The first of two texts that is valid JSON."""
    return pd.Series([_normalised(a) or _normalised(b) for a, b in zip(whole, part)], dtype=object)


def is_json(text: Column) -> Column:
    """Whether a text is one JSON value with nothing after it, as Python's parser judges it.

    The text is parsed in the JVM as the first element of an array whose second is the text's own digest: if something
    follows the value, the second element is another one. The variant parser is strict, so what it takes is valid; Spark's lenient
    parser takes all that is valid but NaN and infinities. Only texts on which the two differ (repeated
    keys, single quotes, control characters) or that hold those words go to Python; the others are sent as nulls.
    """
    begins = F.coalesce(F.rlike(text, F.lit(r"^[ \t\r\n]*[\[{\"\-0-9tfnNI]")), F.lit(False))
    tag = F.md5(text)
    wrapped = F.when(begins, F.concat(F.lit("["), text, F.lit(',"'), tag, F.lit('"]')))
    strict = F.coalesce(F.try_variant_get(F.try_parse_json(wrapped), "$[1]", "string") == tag, F.lit(False))
    lenient = F.coalesce((F.json_array_length(wrapped) == 2) & (F.get_json_object(wrapped, "$[1]") == tag), F.lit(False))
    odd = F.contains(text, F.lit("NaN")) | F.contains(text, F.lit("Infinity"))
    undecided = begins & ~strict & (lenient | odd)
    return strict | valid_json(F.when(undecided, text)).isNotNull()


def json_valid_score(answer: Column) -> Column:
    return F.when(is_json(strip_fences(answer)), F.lit(1.0)).otherwise(F.lit(0.0))


def reply_object(reply: Column) -> Column:
    """The reply's JSON, else that of its outermost braces, else null."""
    cleaned = strip_fences(reply)
    braces = F.nullif(F.regexp_extract(cleaned, r"(?s)\{.*\}", 0), F.lit(""))
    return first_valid_json(cleaned, braces)
