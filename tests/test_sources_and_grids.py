"""Split JSON arrays, grids of any size, ranks in hot groups and answers that are read late."""

import json
import random

import pytest
from pyspark.sql import functions as F

from scoreloom.operators import consensus, joins, ordering, planning
from scoreloom.plans.marts import Marts
from scoreloom.session import new_folder
from scoreloom.sources import files
from scoreloom.sources.json_arrays import read_json_objects

PIECES = ["}", "{", '"', "\\", "]", "[", ",", "a", "é", "\n", "\\}", '"}', "[{", " "]


def objects(seed, count):
    draw = random.Random(seed)
    text = lambda: "".join(draw.choice(PIECES) for _ in range(draw.randrange(8)))
    return [{"id": k, "text": text(), "inner": {"a": text(), "more": [{"b": text()} for _ in range(draw.randrange(3))]} if k % 3 else None} for k in range(count)]


SCHEMA = "id int, text string, inner struct<a: string, more: array<struct<b: string>>>"


@pytest.mark.parametrize("most, indent, shape", [(97, None, "array"), (1000, 2, "array"), (None, None, "array"), (64, None, "lines"), (50, 1, "single")])
def test_json_objects_are_split_at_their_borders(spark, tmp_path, most, indent, shape):
    schema = spark.createDataFrame([], SCHEMA).schema
    want = {}
    for f in range(3):
        rows = [{**o, "id": 1000 * f + o["id"]} for o in objects(f, 1 if shape == "single" else 40)]
        want |= {o["id"]: o for o in rows}
        whole = json.dumps(rows, indent=indent, ensure_ascii=f == 0)
        if shape != "array":
            whole = "\n".join(json.dumps(o, indent=indent) for o in rows)
        (tmp_path / f"{f}.json").write_text(whole + ("\n" if f == 1 else ""))
    (tmp_path / "empty.json").write_text("[]")
    found = read_json_objects(spark, str(tmp_path), schema, most).collect()
    assert {r.id: r.asDict(recursive=True) for r in found} == want and len(found) == len(want)


def test_one_array_is_read_by_many_tasks(spark, tmp_path):
    rows = objects(9, 4000)
    (tmp_path / "bank.json").write_text(json.dumps(rows))
    schema = spark.createDataFrame([], SCHEMA).schema
    pieces = spark.read.option("lineSep", "}").text(str(tmp_path))
    assert read_json_objects(spark, str(tmp_path), schema, 50_000).agg(F.countDistinct("id")).first()[0] == 4000
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        assert pieces.rdd.getNumPartitions() > 5
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_a_cut_object_is_a_row_of_nulls(spark, tmp_path):
    (tmp_path / "cut.json").write_text('[{"id": 1, "text": "x"}, {"id": 2, "te')
    rows = read_json_objects(spark, str(tmp_path), spark.createDataFrame([], SCHEMA).schema).collect()
    assert [r.id for r in rows if r.id is not None] == [1] and len(rows) == 2


@pytest.mark.parametrize("few", [planning.FEW_MODELS, 10])  # broadcast and joined
def test_a_million_cells_a_question(spark, few, monkeypatch):
    monkeypatch.setattr(planning, "FEW_MODELS", few)
    models = spark.range(50_000).select(F.col("id").alias("model_id"))
    configs = [{"temperature": f"0.{k}"} for k in range(4)]
    cells = planning.grid(spark.range(2).select(F.col("id").alias("question_id")), models, [f"s{k}" for k in range(5)], configs, "p")
    found = cells.groupBy("question_id").agg(
        F.count("*").alias("n"), F.countDistinct(F.xxhash64("model_id", "prompt_strategy", "hyperparam_hash")).alias("cells")).collect()
    assert [(r.n, r.cells) for r in found] == [(1_000_000, 1_000_000)] * 2
    blocks = planning.model_blocks(models)
    assert blocks.agg(F.max(F.size("model_ids"))).first()[0] == planning.MODEL_BLOCK


def test_a_grid_of_no_models_is_empty(spark):
    none = spark.range(0).select(F.col("id").alias("model_id"))
    assert planning.grid(spark.range(2).select(F.col("id").alias("question_id")), none, ["s"], [{}], "p").collect() == []


@pytest.mark.parametrize("hot", [5, 5000])
def test_ranks_from_lanes_equal_a_sort(spark, hot):
    draw = random.Random(hot)
    rows = [(k % 3 if k > hot else 0, draw.choice("abcdef") * draw.randrange(1, 4), k) for k in range(hot + 40)]
    df = spark.createDataFrame(rows, "g int, word string, k int")
    ranked = ordering.with_rank_in(df, ["g"], F.substring("word", 1, 1), ["word", "k"])
    want = {}
    for g in range(3):
        want |= {r: i + 1 for i, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2])))}
    assert {(r.g, r.word, r.k): r["rank"] for r in ranked.collect()} == want
    assert "rangepartitioning" not in ranked._jdf.queryExecution().executedPlan().toString()


def test_texts_are_left_behind_until_the_vote_is_done(spark):
    samples = spark.createDataFrame(
        [(1, 1, 0, "a b c"), (1, 1, 1, "a b d"), (1, 1, 2, "x"), (1, 2, 0, ""), (1, 2, 1, None), (1, 3, 4, "??")],
        "model_id int, question_id int, sample_idx int, answer string")
    votes = {r.question_id: (r.best_idx, r.best_answer, r.samples) for r in consensus.plurality_vote(samples).collect()}
    assert votes == {1: (0, "a b c", 3), 3: (4, "??", 1)}
    for line in consensus.plurality_vote(samples)._jdf.queryExecution().optimizedPlan().toString().split("\n"):
        assert "Aggregate" not in line or "answer" not in line


def test_new_examples_are_found_by_key(spark):
    questions = spark.createDataFrame([(k, 1, "easy", f"q{k}", f"a{k}" if k != 2 else None) for k in range(4)],
                                      "question_id int, subtopic_id int, difficulty string, question_text string, expected_answer string")
    stored = spark.createDataFrame([(0, "few-shot"), (0, "few-shot-cot"), (1, "few-shot")], "question_id int, prompt_strategy string")
    rows = planning.seed_few_shot(questions, stored).collect()
    assert {(r.question_id, r.prompt_strategy) for r in rows} == {(1, "few-shot-cot"), (3, "few-shot"), (3, "few-shot-cot")}
    assert {r.example_answer for r in rows if r.prompt_strategy == "few-shot"} == {"a3"}


def test_bucketed_tables_join_without_a_shuffle(spark, tables):
    marts = Marts(spark, tables)
    names = [f"runs_{new_folder(spark, '')[-8:]}", f"scores_{new_folder(spark, '')[-8:]}"]
    runs = files.write_bucketed(marts.runs(), names[0], new_folder(spark, "runs"), 4)
    scores = files.write_bucketed(marts.judge_scores(), names[1], new_folder(spark, "scores"), 4)
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for join in (joins.scored, joins.with_scores):
            joined = join(runs, scores)
            plan = joined._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "Exchange" not in plan
            assert "Exchange" in join(marts.runs(), marts.judge_scores())._jdf.queryExecution().executedPlan().toString()
        # the joins of the star come above the one on run_id, which still has none
        star = joins.star(runs, scores, marts.models(), marts.questions(), marts.subtopics(), marts.topics())
        assert star.count() == joins.star(marts.runs(), marts.judge_scores(), marts.models(), marts.questions(), marts.subtopics(), marts.topics()).count()
        assert joins.scored(runs, scores).count() == joins.scored(marts.runs(), marts.judge_scores()).count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)
        for name in names:
            spark.sql(f"DROP TABLE {name}")
