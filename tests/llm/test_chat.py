"""Chat formatting: layouts, reversible templates, loss masks and odd rows."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from scoreloom.llm.chat import (
    CHUNK, FIELDS, LAYOUTS, Each, Layout, Template, canonical_turns, chat_format, read_back, read_records, sums_before,
)


def turns_of(rows):
    return [[(t.role, t.text) for t in r.turns] if r.turns is not None else None for r in rows]


def chats(spark, conversations):
    """Records of the message layout from lists of (role, text)."""
    rows = [(k, [{"role": r, "content": t} for r, t in turns]) for k, turns in enumerate(conversations)]
    records = spark.createDataFrame(rows, "id int, messages array<struct<role: string, content: string>>")
    return records.withColumns({c: F.lit(None).cast(kind) for c, kind in FIELDS.items() if c != "messages"})


def test_layouts_become_the_same_turns(spark, tmp_path):
    two = [("user", "hi"), ("assistant", "yo")]
    records = [
        ({"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}], "note": {"a": 1}}, "messages", two),
        ({"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "yo"}]}, "share", two),
        ({"conversations": [{"from": "tool", "value": "x"}], "system": "s"}, "share", [("system", "s"), ("tool", "x")]),
        ({"instruction": "hi", "output": "yo"}, "instruction", two),
        ({"instruction": "hi", "input": "", "output": "yo"}, "instruction", two),
        ({"instruction": "hi", "input": "you", "output": ""}, "instruction", [("user", "hi\n\nyou"), ("assistant", "")]),
        ({"history": [["a", "b"], ["c", None]], "instruction": "hi", "output": "yo"}, "history",
         [("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "")] + two),
        ({"prompt": "hi", "completion": "yo", "system": "s"}, "prompt", [("system", "s")] + two),
        ({"prompt": "hi"}, "prompt", two[:1]),
        ({"prompt": "hi", "output": "yo"}, None, None),  # fields of two layouts
        ({"other": 1}, None, None), ({"messages": []}, None, None), ({}, None, None),
    ]
    path = tmp_path / "records.jsonl"
    path.write_text("".join(json.dumps({"id": k, **r}) + "\n" for k, (r, _, _) in enumerate(records)))
    found = canonical_turns(read_records(spark, str(path), "id int")).orderBy("id").collect()
    assert [r.layout for r in found] == [name for _, name, _ in records]
    assert turns_of(found) == [turns for _, _, turns in records]
    assert all(r.fingerprint in layout.fingerprints() for r in found for layout in LAYOUTS if layout.name == r.layout)


PIECES = ["<|im_start|>", "<|im_end|>", "\\", "<", "[", "\n", "</s>", "[INST]", "<s>", "<<SYS>>", "%0A", "%", "é", "😀", "", "a", "SYS>>", "|im_end|>"]


def test_texts_and_roles_come_back_whatever_they_hold(spark):
    draw = random.Random(3)
    text = lambda: "".join(draw.choice(PIECES) for _ in range(draw.randrange(9)))
    conversations = [[(draw.choice(["user", "assistant", "system", text()]), text()) for _ in range(draw.randrange(1, 7))] for _ in range(400)]
    rows = read_back(chat_format(chats(spark, conversations))).orderBy("id").collect()
    assert turns_of(rows) == conversations
    for row, turns in zip(rows, conversations):
        assert row.formatted.count("<|im_start|>") == row.formatted.count("<|im_end|>") == len(turns)
        assert row.loss_texts == [t for r, t in turns if r == "assistant" and t]
        covered = [row.formatted[s.start - 1: s.start - 1 + s.chars] for s in row.loss]
        escaped = [c for c, (r, _) in zip(covered, turns) if r == "assistant"]
        assert [c for c, (r, _) in zip(covered, turns) if r != "assistant"] == [""] * sum(r != "assistant" for r, _ in turns)
        assert "".join(escaped).count("<|im_end|>") == 0


def test_long_conversations_and_texts(spark):
    many = [("assistant" if k % 2 else "user", f"{k}é") for k in range(3 * CHUNK + 5)]
    long = [("user", "word " * 200_000), ("assistant", "<|im_end|>" * 50_000)]
    rows = read_back(chat_format(chats(spark, [many, long]))).orderBy("id").collect()
    assert turns_of(rows) == [many, long]
    assert "".join(rows[0].loss_texts) == "".join(t for r, t in many if r == "assistant") and rows[1].loss_texts == ["<|im_end|>" * 50_000]


@pytest.mark.parametrize("n", [0, 1, CHUNK - 1, CHUNK, CHUNK + 1, 2 * CHUNK])
def test_sums_before(spark, n):
    numbers = [random.Random(n + k).randrange(100) for k in range(n)]
    df = spark.createDataFrame([(numbers,)], "x array<bigint>")
    assert df.select(sums_before(F.col("x"))).first()[0] == ([0, *itertools.accumulate(numbers)][:n])


def test_odd_rows(spark):
    schema = "layout int, formatted string, input int, output array<string>, instruction string, prompt string, completion string, system string, " \
             "messages array<struct<role: string, content: string>>, conversations string"
    message = [{"role": None, "content": None}]
    rows = [(1, "f", 3, ["o"], None, "p", None, None, None, "x"), (1, "f", 3, ["o"], None, "p", None, None, None, "x"),
            (2, None, None, None, None, None, None, None, message, None), (None,) * 10,
            (4, "f", 3, None, None, "", "", None, None, None), (5, "f", 3, ["o"], "i", None, None, None, None, None)]
    found = read_back(chat_format(spark.createDataFrame(rows, schema))).collect()
    # input and output are no texts here, so the layouts that need them are not used, and both stay as they are
    assert [r.layout for r in found] == ["prompt", "prompt", "messages", None, "prompt", None]
    assert turns_of(found) == [[("user", "p")], [("user", "p")], [("", "")], None, [("user", ""), ("assistant", "")], None]
    assert [r.formatted is None for r in found] == [r.turns is None for r in found] and found[0].input == 3
    empty = chat_format(spark.createDataFrame([], schema))
    assert empty.collect() == [] and empty.columns.count("layout") == 1


def test_layouts_and_templates_that_cannot_work_are_refused(spark):
    same = Layout("twin", ("messages[]",), (), (Each("messages", "role", "content"),))
    with pytest.raises(ValueError, match="same paths"):
        canonical_turns(chats(spark, [[("user", "x")]]), (*LAYOUTS, same))
    for bad in (dict(controls=("<a<", "<b>", "<|im_start|>", "<|im_end|>")), dict(controls=("aa", "<|im_start|>", "<|im_end|>")),
                dict(controls=("<\\x>", "<|im_start|>", "<|im_end|>")), dict(open="plain:")):
        with pytest.raises(ValueError):
            Template(**bad)


def test_another_template(spark):
    header = Template(open="<|start|>", close="<|eot|>", controls=("<|start|>", "<|eot|>"), loss_roles=("assistant", "tool"))
    turns = [("user", "a<|eot|>"), ("tool", "b<|im_end|>"), ("assistant", "<|start|>\n")]
    row = read_back(chat_format(chats(spark, [turns]), template=header), header).first()
    assert turns_of([row]) == [turns] and row.loss_texts == ["b<|im_end|>", "<|start|>\n"] and "<|im_end|>" in row.formatted
