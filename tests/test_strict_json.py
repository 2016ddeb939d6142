"""JSON validity in the JVM against Python's parser."""

import json
import random

from pyspark.sql import functions as F

from scoreloom.functions.strict_json import is_json

PIECES = ["{", "}", "[", "]", ",", ":", '"', '"a"', "'a'", "1", "-", "0", "01", "1.5", "1e9", "1E400", "true", "null", "NaN", "-Infinity", "\\", "\\u00e9",
          " ", "\n", "\t", '"a":1', '"a":1,"a":2', "[]", "{}", '"\x01"', "é", "tru", "],[", "//", "9" * 60]


def is_valid(text):
    try:
        json.loads(text)
    except (ValueError, TypeError):
        return False
    return True


def test_validity_is_that_of_the_parser(spark):
    draw = random.Random(4)
    texts = ["".join(draw.choice(PIECES) for _ in range(draw.randrange(1, 6))) for _ in range(3000)]
    texts += [json.dumps({"k": [1, {"x": "y" * 50}], "z": None}), '{"a": 1} tail', '[1,2],[3', '1,"x"', "", " ", '{"a":{"b":1,"b":2}}', "{'a': 1}", "NaN", '"x" "y"']
    df = spark.createDataFrame(list(enumerate([*texts, None])), "k int, text string")
    found = {r.k: r.ok for r in df.select("k", is_json(F.col("text")).alias("ok")).collect()}
    assert {k: v for k, v in found.items() if v != (k < len(texts) and is_valid(texts[k]))} == {}
    assert sum(found.values()) > 200


def test_only_texts_left_open_reach_python(spark):
    texts = ['{"a": 1}', "prose {", '{"a": 1,}', '{"a":1} x', "[1, 2]", "tail [1]"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    plan = df.select(is_json(F.col("text")).alias("ok"))._jdf.queryExecution().optimizedPlan().toString()
    sent = [line for line in plan.split("\n") if "ArrowEvalPython" in line]
    assert len(sent) == 1 and "valid_json(CASE WHEN" in sent[0]  # nulls, but for texts left open
    assert [r.ok for r in df.select(is_json(F.col("text")).alias("ok")).collect()] == [True, False, False, False, True, False]
