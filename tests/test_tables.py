"""Accuracy goldens, skewed groups, sources, sinks and streams."""

import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from scoreloom.operators import (
    accuracy, answer_scan, ingest, joins, ordering, planning, ratings, reports, sampling, scoring, verdicts,
)
from scoreloom.plans import bank_queries, report_queries, stream_queries
from scoreloom.plans.marts import Marts
from scoreloom.session import new_folder
from scoreloom.sources import files
from scoreloom.streaming import contests as contests_mod
from scoreloom.streaming import live
from tests.test_ratings import records_read, log_of, made_up, moves_of, sequential

ROWS = "case_id string, row map<string,string>"


def f1(spark, returned, expected, by_values=False):
    def frame(rows):
        return spark.createDataFrame([("c", r) for r in rows], ROWS)

    got = accuracy.result_set_f1(frame(returned), frame(expected), by_values).collect()
    return (got[0].precision, got[0].recall, got[0].f1) if got else None


SAILORS = [{"sname": n} for n in ("Alice", "Carol", "Eve", "Grace")]


@pytest.mark.parametrize("returned, expected, by_values, result", [
    (SAILORS, SAILORS, False, (1, 1, 1)),
    (SAILORS[::-1] + SAILORS, SAILORS, False, (1, 1, 1)),
    (SAILORS[:2] + [{"sname": "Bob"}], SAILORS, False, (0.6667, 0.5, 0.5714)),
    ([{"average": "5.33333333"}], [{"avg": "5.333333"}], False, (0, 0, 0)),
    ([{"average": "5.33333333"}], [{"avg": "5.333333"}], True, (1, 1, 1)),
    ([{"b": "1", "a": "x"}], [{"a": "x", "b": "1.0"}], False, (1, 1, 1)),
    ([{"a": None}], [{"a": None}], False, (1, 1, 1)),
    ([{"n": "Alice"}] + SAILORS[1:2], SAILORS, True, (0.5, 0.25, 0.3333)),
    ([], SAILORS, True, (0, 0, 0)),
])
def test_result_sets(spark, returned, expected, by_values, result):
    assert f1(spark, returned, expected, by_values) == result


def test_candidates(spark):
    cases = spark.createDataFrame([(c,) for c in "abcde"], "case_id string")
    expected = spark.createDataFrame([(c, {"x": "1"}) for c in "abcd"], ROWS)
    tried = spark.createDataFrame([
        ("a", 0, True, ["y"]), ("a", 1, True, ["x"]), ("b", 0, False, ["x"]), ("b", 1, True, ["y"]),
        ("c", 0, False, ["x"]), ("e", 0, True, ["x"]),
    ], "case_id string, candidate_idx int, ok boolean, columns array<string>")
    got = {r.case_id: (r.chosen_idx, r.error) for r in accuracy.pick_candidate(cases, tried, expected).collect()}
    assert got == {
        "a": (1, None), "b": (1, None), "c": (None, accuracy.ALL_FAILED), "d": (None, accuracy.NO_SQL),
        "e": (None, accuracy.NO_ROWS),
    }


# --- hot groups --------------------------------------------------------------------------


def skewed(spark, n=4000):
    rng = random.Random(1)
    rows = [(0 if rng.random() < 0.4 else rng.randrange(1, 300), rng.randrange(10**6), i) for i in range(n)]
    return rows, spark.createDataFrame(rows, "k int, v int, id int")


def test_row_numbers_of_hot_groups(spark):
    rows, df = skewed(spark)
    got = {r.id: r.nth for r in ordering.with_row_number_in(df, ["k"], ["v", "id"], "nth").collect()}
    wanted = {}
    for key in {r[0] for r in rows}:
        for nth, row in enumerate(sorted((r for r in rows if r[0] == key), key=lambda r: r[1:]), 1):
            wanted[row[2]] = nth
    assert got == wanted
    ranks = [r["rank"] for r in ordering.with_row_number(df, ["v", "id"]).orderBy("v", "id").collect()]
    assert ranks == list(range(1, len(rows) + 1))


def test_carried_values(spark):
    rng = random.Random(2)
    rows = [(i, f"v{i}" if rng.random() < 0.02 else None) for i in range(3000)]
    got = ordering.with_carried(spark.createDataFrame(rows, "i int, v string"), ["i"], "v", "filled").orderBy("i").collect()
    last = None
    for r in got:
        last = r.v or last
        assert r.filled == last


def test_sweep_sample_takes_the_smallest_digests(spark):
    import hashlib
    rows = [(i, "easy" if i % 3 else "hard") for i in range(997)]
    got = sampling.fast_sweep_sample(spark.createDataFrame(rows, "question_id int, difficulty string")).collect()
    for tier in ("easy", "hard"):
        ids = sorted((hashlib.md5(str(i).encode()).hexdigest(), i) for i, d in rows if d == tier)
        quota = -(-len(ids) // 5)
        assert {r.question_id for r in got if r.difficulty == tier} == {i for _, i in ids[:quota]}
    few = spark.createDataFrame([(1, "easy"), (2, "medium")], "question_id int, difficulty string")
    assert sampling.fast_sweep_sample(few).count() == 2


def test_cell_sample_adds_a_practical_question(spark):
    rows = [(1, 1, "easy", "conceptual"), (2, 1, "easy", "practical"), (3, 2, "hard", "conceptual")]
    df = spark.createDataFrame(rows, "question_id int, subtopic_id int, difficulty string, question_type string")
    assert sorted(r.question_id for r in sampling.cell_sample(df).collect()) == [1, 2, 3]
    assert sorted(r.question_id for r in sampling.cell_sample(df.filter("question_id != 1")).collect()) == [2, 3]


def test_first_of_a_key_is_kept_before_the_shuffle(spark, tables):
    runs = Marts(spark, tables).runs().withColumn("hyperparam_hash", F.lit("h"))
    plan = ingest.dedupe_runs(runs)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_filters_and_columns_reach_the_scan(spark, tables):
    m = Marts(spark, tables)
    scored = joins.scored(m.runs(), m.judge_scores()).groupBy("model_id").agg(F.avg("judge_score_0_10"))
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,5.0)" in plan and "l_returnflag" not in plan.split("ReadSchema")[1]


def test_few_shot_against_brute_force(spark):
    rng = random.Random(3)
    questions = [(i, rng.choice("ab"), rng.choice(["easy", "hard"]), f"q{i}", f"a{i}" if rng.random() < 0.6 else None) for i in range(40)]
    questions += [(40, "c", "easy", "alone", "answer")]
    df = spark.createDataFrame(questions, "question_id long, subtopic_id string, difficulty string, question_text string, expected_answer string")
    none = spark.createDataFrame([], "question_id long, prompt_strategy string")
    store = planning.seed_few_shot(df, none)
    stored = [(q, s, d, p) for q, s, d, _, a in questions if a for p in ("few-shot", "few-shot-cot")]
    for strategy, wanted in {"few-shot": {"few-shot", "few-shot-cot"}, "few-shot-cot": {"few-shot-cot"}}.items():
        got = planning.few_shot_lookup(df, store, strategy).collect()
        for r in got:
            strict = sorted((q, p) for q, s, d, p in stored if s == r.subtopic_id and d == r.difficulty and p in wanted and q != r.question_id)[:3]
            relaxed = sorted((q, p) for q, s, d, p in stored if s == r.subtopic_id and q != r.question_id)[:3]
            assert [(e.question_id, e.prompt_strategy) for e in r.examples] == (strict if len(strict) == 3 else relaxed)


def test_prompt_fallbacks_and_schema(spark):
    rows = [(s, "Q", "CREATE TABLE t (\nINSERT INTO t\n);" if s == "cot" else None) for s in ("one-shot", "few-shot-cot", "cot", "self-consistency")]
    df = spark.createDataFrame(rows, "prompt_strategy string, question_text string, schema_fixture string")
    empty = F.array().cast("array<struct<question_id:bigint,prompt_strategy:string,question:string,answer:string>>")
    got = {r.prompt_strategy: r for r in planning.render_prompts(df.withColumn("examples", empty)).collect()}
    assert got["one-shot"].label == "zero-shot" and got["one-shot"].user_prompt == "Q"
    assert got["few-shot-cot"].label == got["self-consistency"].label == "cot"
    assert "```sql\nCREATE TABLE t (\n);\n```\n\nQ\n\nApproach" in got["cot"].user_prompt


def test_reasoning_and_implicit_steps(spark):
    rows = [(s, v, "Q?", None, [("q", "a", "because"), ("p", "b", "")]) for s in ("cot", "self-consistency", "few-shot", "few-shot-cot") for v in ("implicit", None)]
    df = spark.createDataFrame(rows, "prompt_strategy string, cot_variant string, question_text string, schema_fixture string, "
                               "examples array<struct<question: string, answer: string, reasoning: string>>")
    got = {(r.prompt_strategy, v): r.user_prompt for r, (_, v, *_) in zip(planning.render_prompts(df).collect(), rows)}
    assert got["cot", "implicit"] == "Q?\n\nLet us think step by step."
    assert got["cot", None] == got["self-consistency", "implicit"] == got["self-consistency", None] != got["cot", "implicit"]
    assert "Question: q\nReasoning:\nbecause\nAnswer: a" in got["few-shot-cot", None] and "Question: p\nAnswer: b" in got["few-shot-cot", None]
    assert "because" not in got["few-shot", None]


def test_upsert_twice_changes_nothing(spark):
    stored = spark.createDataFrame([(1, "a")], "id int, name string").withColumn("id", F.col("id").cast("string"))
    incoming = spark.createDataFrame([("a",), ("b",), ("b",)], "name string")
    once = ingest.upsert_names(stored, incoming, ["name"])
    assert sorted(once.collect()) == sorted(ingest.upsert_names(once, incoming, ["name"]).collect())
    assert once.count() == 2


# --- scoring ------------------------------------------------------------------------------


def test_scores_stay_in_range_and_missing_harness_falls_back(spark, tables):
    m = Marts(spark, tables)
    scores = scoring.score_runs(m.answer_runs(), m.judge_replies(), m.references(), m.harness(), "{}")
    assert scores.count() == m.answers().count()
    checks = {r.check: r.violations for r in scoring.validate_scores(scores).collect()}
    assert sum(checks.values()) == 0


# --- files ----------------------------------------------------------------------------------


def test_bank_array_file(spark, tmp_path):
    (tmp_path / "bank.json").write_text('[{"id": "x", "topic": "T", "tags": ["sql"]}, {"id": "y", "expected_answer": null}]')
    rows = {r.id: r for r in files.read_question_bank(spark, str(tmp_path / "bank.json")).collect()}
    assert rows["x"].tags == ["sql"] and rows["y"].expected_answer is None


def test_sheet_file(spark, tmp_path):
    (tmp_path / "sheet.csv").write_text('row_no,topic,subtopic,questions,answers\n1,T,S,"[""a"",\n""b""]",\n')
    sheet = files.read_question_sheet(spark, str(tmp_path / "sheet.csv"))
    assert [r.question_text for r in ingest.explode_question_sheet(sheet).orderBy("global_index").collect()] == ["a", "b"]


def test_csv_export_keeps_zeros_and_blanks_nulls(spark):
    rows = spark.createDataFrame([("r", 0.0, None)], "run_id string, mcs double, cost_usd double")
    path = new_folder(spark, "csv")
    files.write_runs_csv(rows.coalesce(1), path)
    assert [r.value for r in spark.read.text(path).collect()] == ["run_id,mcs,cost_usd", "r,0.0,"]


def test_exports_are_compressed_and_read_back(spark):
    rows = spark.range(2000).selectExpr(
        "'r' || id AS run_id", "id AS model_id", "id AS question_id", "'practical' AS question_type", "'cot' AS prompt_strategy",
        "CASE WHEN id > 0 THEN id / 7 END AS mcs", "0.0D AS db_correctness", "1.5D AS llm_quality", "0.5D AS hallucination_rate",
        "id / 3 AS judge_score_0_10", "id * 2.0D AS total_latency_ms", "CAST(NULL AS DOUBLE) AS cost_usd")
    for fmt, write in {"json": files.write_runs_json, "csv": files.write_runs_csv}.items():
        path = new_folder(spark, fmt)
        write(rows, path)
        back = files.read_exported_runs(spark, path, fmt)
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.select(*back.columns).collect())) if fmt == "json" else back.count() == 2000
        stored = back.inputFiles()
        plain = new_folder(spark, "plain")
        getattr(rows.write, fmt)(plain)
        size = {p: sum(r.length for r in spark.read.format("binaryFile").load(p).select("length").collect()) for p in (path, plain)}
        assert all(f.endswith(".gz") for f in stored) and size[path] < size[plain] / 3


def test_bundle_writes_every_model_in_one_of_many_tasks(spark):
    report = spark.range(3000).selectExpr("id % 40 AS model_id", "id AS avg_mcs", "count(*) OVER (PARTITION BY id % 40) AS n")
    paths = files.write_report_bundle({"per": report, "whole": report}, new_folder(spark, "bundle"), ["per"])
    written = spark.read.schema("avg_mcs long, model_id long").json(paths["per"])
    names = [f.rsplit("/", 1)[1] for f in written.inputFiles()]
    assert written.count() == 3000 and len(names) == 40
    assert len({n.split("-")[1] for n in names}) > 1  # the task is in the file's name
    assert spark.read.schema("avg_mcs long, model_id long").json(paths["whole"]).count() == 3000


def test_few_shot_lookup_gathers_no_questions_by_key(spark):
    questions = spark.range(200).selectExpr(
        "id AS question_id", "'one' AS subtopic_id", "'easy' AS difficulty", "'q' || id AS question_text", "'a' || id AS expected_answer")
    store = planning.seed_few_shot(questions, spark.createDataFrame([], "question_id long, prompt_strategy string"))
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        looked = planning.few_shot_lookup(questions.withColumn("question_text", F.repeat("question_text", 50)), store)
        plan = looked._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert "SortMergeJoin" not in plan and "Window" not in plan
    assert looked.where("size(examples) = 3").count() == 200


def test_arrays_of_the_question_bank_follow_its_records(spark, tables, monkeypatch):
    seen = []
    whole = files.read_question_bank
    monkeypatch.setattr(files, "read_question_bank", lambda s, path: seen.append(s.read.text(path).inputFiles()) or whole(s, path))
    monkeypatch.setattr(bank_queries, "RECORDS_PER_ARRAY", 100)
    rows = bank_queries.QUERIES["read_question_bank"](spark, tables)
    assert rows.count() == Marts(spark, tables).questions().count() and len(seen[0]) > 6


# --- streams ----------------------------------------------------------------------------------


def test_every_delivery_of_a_stream_is_a_fixed_number_of_files(spark, monkeypatch):
    monkeypatch.setattr(stream_queries, "ROWS_PER_FILE", 25)
    delivery = F.when(F.col("id") < 90, 0).when(F.col("id") < 92, 1).otherwise(3)
    folders = []
    monkeypatch.setattr(stream_queries, "new_folder", lambda s, name: folders.append(new_folder(s, name)) or folders[-1])
    stream = stream_queries.arriving(Marts(spark, "none"), spark.range(100).toDF("id"), "numbers", 4, delivery)
    seen = {}
    live.run_batches(stream, lambda batch, n: seen.update({n: batch.count()}), new_folder(spark, "numbers-state"))
    assert seen == {0: 90, 1: 2, 2: 0, 3: 8} and live.file_count(spark, folders[0]) == 16


def test_rows_of_a_stream_are_stored_once(spark, monkeypatch):
    folders = []
    monkeypatch.setattr(stream_queries, "new_folder", lambda s, name: folders.append(new_folder(s, name)) or folders[-1])
    stream_queries.arriving(Marts(spark, "none"), spark.range(100).toDF("id"), "numbers", 4, F.col("id") % 5)
    assert sum(spark.read.schema("id long").option("recursiveFileLookup", True).parquet(f).count() for f in folders) == 80  # no delivery 4


def test_runs_and_scores_wait_on_disk(spark, monkeypatch):
    seen = []
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    whole = live.run_batches
    monkeypatch.setattr(live, "run_batches", lambda *a, **k: seen.append(spark.conf.get(setting)) or whole(*a, **k))
    runs, scores, folder = new_folder(spark, "r"), new_folder(spark, "s"), new_folder(spark, "waiting")
    spark.sql("SELECT 'a' AS run_id, 1L AS model_id, 2.0D AS total_latency_ms, timestamp_ntz '2024-01-01' AS run_timestamp").write.parquet(runs)
    spark.sql("SELECT 'a' AS run_id, 1.0D AS master_composite_score, 1.0D AS db_correctness_score, 1.0D AS llm_quality_score, timestamp_ntz '2024-01-02' AS scored_at").write.parquet(scores)
    streams = [live.file_stream(spark, spark.read.parquet(p).schema, p) for p in (runs, scores)]
    assert [r.run_count for r in live.stream_leaderboard(*streams, folder).collect()] == [1]
    assert "RocksDB" in seen[0] and spark.conf.get(setting) == before


def test_elo_in_batches_equals_the_replay(spark):
    contests = made_up(11, 60)
    log = log_of(spark, contests)
    arrived, state = new_folder(spark, "log"), new_folder(spark, "state")
    for part, (low, high) in enumerate([(0, 20), (20, 45), (45, 60)]):
        log.filter(F.col("contest_ts").between(low, high - 1)).coalesce(1).write.mode("append").parquet(arrived)
        # each part is a run of its own that goes on where the last one stopped
        stream = live.file_stream(spark, log.schema, arrived, per_batch=1)
        history = live.stream_elo(stream, state, segment_size=1000)
    assert moves_of(history) == sequential(contests)


@pytest.mark.parametrize("seed", [1, 2])
def test_entries_of_contests_may_arrive_apart_in_any_order(spark, seed):
    contests = made_up(seed, 60)
    log = log_of(spark, contests)
    arrived, state = new_folder(spark, "log"), new_folder(spark, "state")
    for part in range(6):  # every entry in a file of its own choice, and some twice
        own = F.pmod(F.xxhash64("contest_id", "model_id", F.lit(seed)), F.lit(6))
        log.filter((own == part) | (F.lit(part == 3) & (own == 1))).coalesce(1).write.mode("append").parquet(arrived)
    stream = live.file_stream(spark, log.schema, arrived, per_batch=1)
    history = live.stream_elo(stream, state, delay=F.lit(100))
    assert moves_of(history) == sequential(contests) and history.count() == log.count()
    assert contests_mod.late_contests(spark, state, log.schema).isEmpty() and contests_mod.open_contests(spark, state, log.schema).isEmpty()


def test_late_and_open_contests_are_listed(spark, monkeypatch):
    monkeypatch.setattr(contests_mod, "SNAPSHOT_EVERY", 2)
    contests = [(k % 2, k, 10 * k, [(1, k % 5), (2, 5 + k % 4)]) for k in range(24)]
    log = log_of(spark, contests)
    arrived, state = new_folder(spark, "log"), new_folder(spark, "state")
    late, never = F.col("contest_id").isin(2, 5), (F.col("contest_id") == 7) & (F.col("placement") == 2)
    for k in range(8):
        log.filter(~late & ~never & F.col("contest_id").between(3 * k, 3 * k + 2) | late & F.lit(k == 6)).coalesce(1).write.mode("append").parquet(arrived)
    stream = live.file_stream(spark, log.schema, arrived, per_batch=1)
    live.stream_elo(stream, state, delay=F.lit(20), close=False)
    history = live.stream_elo(stream, state, delay=F.lit(20))  # nothing new: the run only closes
    rated = [c for c in contests if c[1] not in (2, 5, 7)]
    assert moves_of(history) == sequential(rated)
    assert {(r.contest_id, r.model_id) for r in contests_mod.late_contests(spark, state, log.schema).collect()} == {(2, 2), (2, 7), (5, 0), (5, 6)}
    assert [(r.contest_id, r.model_id) for r in contests_mod.open_contests(spark, state, log.schema).collect()] == [(7, 2)]
    assert len(contests_mod.ContestTables(spark, state, log.schema).steps("snapshot")) >= 3


def stored_in_files(spark, df, name, files, file):
    arrived = new_folder(spark, name)
    for k in range(files):
        df.filter(file == k).coalesce(1).write.mode("append").parquet(arrived)
    return live.file_stream(spark, df.schema, arrived, per_batch=1)


def test_runs_and_scores_may_arrive_in_any_order(spark):
    start = datetime(2024, 1, 1)
    runs = spark.createDataFrame([(f"r{k}", k % 3, float(k), start + timedelta(hours=k)) for k in range(40)],
                                 "run_id string, model_id int, total_latency_ms double, run_timestamp timestamp_ntz")
    rows = [(f"r{k}", start + timedelta(hours=k + k % 7 - 3), float(k), 2.0, None if k % 2 else 3.0) for k in range(40) if k % 5]
    scores = spark.createDataFrame(rows, "run_id string, scored_at timestamp_ntz, master_composite_score double, db_correctness_score double, llm_quality_score double")
    board = live.stream_leaderboard(
        stored_in_files(spark, runs, "runs", 4, F.crc32("run_id") % 4), stored_in_files(spark, scores, "scores", 4, F.crc32("run_id") % 7 % 4),
        new_folder(spark, "board"), "3 HOURS", "3 HOURS", "2 days")
    want = {m: [k for k in range(40) if k % 5 and k % 3 == m] for m in range(3)}
    got = {r.model_id: (r.run_count, r.mcs_score, r.avg_latency_ms, r.llm_quality) for r in board.collect()}
    assert got == {m: (len(ks), round(sum(ks) / len(ks), 2), round(sum(ks) / len(ks), 1), 3.0) for m, ks in want.items()}


def test_runs_and_scores_meet_as_in_a_join_of_streams(spark):
    """Rows that repeat, lack an id or a time, are out of range or come too late are paired as Spark's own join does."""
    draw, start = random.Random(5), datetime(2024, 1, 1)

    def rows(count, columns):
        made = []
        for k in range(count):
            at = None if draw.random() < 0.05 else start + timedelta(hours=draw.randrange(400))
            early = 0 if at is None else (at - start).days // 4
            made.append((draw.choice([None, *[f"r{n}" for n in range(60)]]), at, k % 4, float(k), min(3, early + draw.choice([0, 0, 1, 3]))))
        return spark.createDataFrame(made, f"run_id string, {columns}, file int")

    runs = rows(400, "run_timestamp timestamp_ntz, model_id int, total_latency_ms double")
    scores = rows(500, "scored_at timestamp_ntz, x int, master_composite_score double").selectExpr(
        "run_id", "scored_at", "master_composite_score", "1.0D AS db_correctness_score", "CAST(NULL AS DOUBLE) AS llm_quality_score", "file")

    def streams():
        return [stored_in_files(spark, df, "odd", 4, F.col("file")) for df in (runs, scores)]

    left, right = streams()
    joined, found = left.withColumn("run_timestamp", F.col("run_timestamp").cast("timestamp")).withWatermark("run_timestamp", "2 days").drop("file").join(
        right.withColumn("scored_at", F.col("scored_at").cast("timestamp")).withWatermark("scored_at", "2 days").withColumnRenamed("run_id", "scored_run"), F.expr(
            "run_id = scored_run AND scored_at >= run_timestamp - INTERVAL 9 HOURS AND scored_at <= run_timestamp + INTERVAL 30 HOURS")), []
    live.run_batches(joined, lambda batch, n: found.extend(batch.select("model_id", "master_composite_score", "total_latency_ms").collect()), new_folder(spark, "own"))
    board = live.stream_leaderboard(*streams(), new_folder(spark, "odd-board"), "9 HOURS", "30 HOURS", "2 days")
    every = runs.join(scores, "run_id").where("scored_at BETWEEN run_timestamp - INTERVAL 9 HOURS AND run_timestamp + INTERVAL 30 HOURS").count()
    assert 100 < len(found) < every  # some pairs are late
    want = {m: [r for r in found if r.model_id == m] for m in range(4)}
    got = {r.model_id: (r.run_count, r.mcs_score, r.avg_latency_ms) for r in board.collect()}
    assert {m: n for m, (n, *_) in got.items()} == {m: len(rs) for m, rs in want.items()}
    for m, rs in want.items():
        assert got[m][1] == pytest.approx(sum(r.master_composite_score for r in rs) / len(rs), abs=0.006)
        assert got[m][2] == pytest.approx(sum(r.total_latency_ms for r in rs) / len(rs), abs=0.06)


def test_a_batch_of_the_board_goes_through_no_row_out_of_reach(spark):
    start = datetime(2024, 1, 1)
    runs = spark.createDataFrame([(f"r{k}", k % 3, 1.0, start + timedelta(hours=k)) for k in range(1200)],
                                 "run_id string, model_id int, total_latency_ms double, run_timestamp timestamp_ntz")
    scores = runs.selectExpr("run_id", "run_timestamp + INTERVAL 1 HOUR AS scored_at", "1.0D AS master_composite_score", "1.0D AS db_correctness_score", "1.0D AS llm_quality_score")
    number, folder, read = F.substring("run_id", 2, 9).cast("int"), new_folder(spark, "reach"), []
    streams = [stored_in_files(spark, df, "reach", 12, F.floor(number / 100)) for df in (runs, scores)]
    pairs = live.WaitingTables._side
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(live.WaitingTables, "_side", lambda *a: read.append((rows := pairs(*a)).count()) or rows)
        board = live.stream_leaderboard(*streams, folder, "3 HOURS", "3 HOURS", "400 days")
    assert sum(r.run_count for r in board.collect()) == 1200
    assert len(read) == 24 and max(read) <= 110 and not live.exists(spark, f"{folder}/checkpoint/state")


def shuffle_files(spark, most=1 << 30):
    """Files of shuffles and spills on disk, as soon as they are no more than ``most``, or after ten seconds."""
    for _ in range(100):
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
        if found <= most:
            break
        time.sleep(0.1)
    return found


def test_the_run_stream_leaves_no_shuffles_behind(spark):
    rows = [(f"r{k}", k % 50, 1, "cot", "{}", datetime(2024, 1, 1) + timedelta(days=(k * 37) % 400)) for k in range(1200)]
    runs = spark.createDataFrame(rows, "run_id string, question_id int, model_id int, prompt_strategy string, hyperparams string, run_timestamp timestamp")
    stream, before = stored_in_files(spark, runs, "runs", 4, F.crc32("run_id") % 4), shuffle_files(spark)
    first = live.stream_run_dedupe(stream, new_folder(spark, "first"))
    assert shuffle_files(spark, before) <= before and first.count() == 50


@pytest.mark.parametrize("name, steps", [("leaderboard_by_elo", 8), ("report_bundle", 9)])
def test_steps_of_the_reports_do_not_pile_up_shuffles(spark, tables, monkeypatch, name, steps):
    # small steps that count or number rows may leave a few files; the joins of a step, of tens of files, are gone
    most, left, whole = shuffle_files(spark) + 24, [], files.staged

    def staged(df, path):
        left.append(shuffle_files(spark, most))
        return whole(df, path)

    monkeypatch.setattr(files, "staged", staged)
    rows = report_queries.QUERIES[name](spark, tables).collect()
    assert len(left) >= steps and len(rows) in (8, 10)
    assert max(left) <= most


def test_parts_of_a_report_are_the_report(spark):
    report = spark.range(100).selectExpr("id AS model_id", "id * 2 AS v")
    paths = files.write_report_bundle({"parts": [report.where("v < 50"), report.where("v >= 50")]}, new_folder(spark, "bundle"))
    assert sorted(map(tuple, spark.read.schema(report.schema).json(paths["parts"]).collect())) == sorted(map(tuple, report.collect()))


def test_telemetry_in_any_order_loses_no_row(spark):
    start = datetime(2024, 1, 1)
    rows = [(start + timedelta(minutes=(k * 53) % 3000), k % 4, "cot", float(k % 10), 0.5) for k in range(400)]
    events = spark.createDataFrame(rows, "ts timestamp_ntz, model_id int, prompt_strategy string, total_latency_ms double, cost_usd double")
    for order in ((3, 1, 0, 2), (0, 1, 2, 3)):
        part = F.element_at(F.array(*[F.lit(k) for k in order]), (F.crc32(F.col("ts").cast("string")) % 4 + 1).cast("int"))
        folder = new_folder(spark, "windows")
        windows = live.stream_windows(stored_in_files(spark, events, "events", 4, part), folder, "6 hours").collect()
        assert sum(r.runs for r in windows) == 400 and len(windows) == 9
        assert live.late_windows(spark, folder).agg(F.sum("runs")).first()[0] > 100
        sessions = live.stream_sessions(stored_in_files(spark, events, "events", 4, part), new_folder(spark, "sessions"), "40 minutes").collect()
        want = []
        for m in range(4):
            times = sorted(r[0] for r in rows if r[1] == m)
            cuts = [0, *[i for i in range(1, len(times)) if times[i] - times[i - 1] >= timedelta(minutes=40)], len(times)]
            want += [(m, times[a], times[b - 1] + timedelta(minutes=40), b - a) for a, b in zip(cuts, cuts[1:])]
        assert sorted((r.model_id, r.window_start, r.window_end, r.runs) for r in sessions) == sorted(want)


def test_default_configuration_wins_as_baseline(spark):
    rows = [("b", "x", 1.0), ("c", report_queries.DEFAULT_HP, 2.0), ("d", "y", 3.0)]
    df = spark.createDataFrame(rows, "run_id string, hyperparams string, master_composite_score double").withColumns({
        "question_id": F.lit(1), "model_id": F.lit(1), "prompt_strategy": F.lit("zero-shot")})
    assert joins.baseline(df, report_queries.DEFAULT_HP).first().baseline_mcs == 2.0


def test_values_compare_by_their_form(spark):
    same = [("5", "5.0"), ("-0", "0"), ("1.50", "1.5"), ("1.0E7", "10000000"), (None, None), ("a", "a")]
    differ = [("0123", "123"), ("1d", "1"), ("9007199254740993", "9007199254740992"), ("", None), ("1", "1f"), ("01", "1")]
    for pairs, f1 in ((same, 1.0), (differ, 0.0)):
        returned = spark.createDataFrame([(k, {"v": a}) for k, (a, _) in enumerate(pairs)], "case_id int, row map<string,string>")
        expected = spark.createDataFrame([(k, {"v": b}) for k, (_, b) in enumerate(pairs)], "case_id int, row map<string,string>")
        for by_values in (False, True):
            assert {r.f1 for r in accuracy.result_set_f1(returned, expected, by_values).collect()} == {f1}


@pytest.mark.parametrize("entrants", [1, 70, 500])
def test_contest_prompt_of_any_size(spark, entrants):
    entries = spark.createDataFrame([(1, m, entrants, f"answer {m}") for m in range(entrants)], "contest_id int, model_id int, entrants int, answer string")
    parts = planning.contest_prompts(ratings.anonymise_contest(entries), F.lit("What?"), F.lit(None).cast("string")).orderBy("part").collect()
    prompt = "".join(r.text for r in parts)
    assert [r.part for r in parts] == list(range(entrants + 2)) and "%s" not in prompt
    assert all(f"answer {m}\n" in prompt + "\n" for m in range(entrants)) and f"Rank all {entrants} answers" in prompt


def test_bad_fields_are_unreadable_replies(spark):
    replies = ['{"score": "8/10"}', '{"score": 7, "completeness": "high"}', '{"score": 7}', "x", None]
    rows = answer_scan.parse_judge_replies(spark.createDataFrame([(k, r) for k, r in enumerate(replies)], "answer_id int, reply string"))
    assert [(r.parse_error, r.judge_score_0_10) for r in rows.orderBy("answer_id").collect()] == [
        (True, 5.0), (True, 5.0), (False, 7.0), (True, 5.0), (True, 5.0)]


def test_verdicts_are_decoded(spark):
    reply = ('```json\n{"reasoning": "r", "rankings": [{"label": "B", "placement": 2}, {"label": "A", "placement": "1", "justification": "j"},'
             ' {"label": "C"}, {"label": "Z", "placement": 1}], "ties": [["A", "B"], "no list"]}\n```')
    labels = spark.createDataFrame([(1, "A", 10), (1, "B", 20), (1, "C", 30), (2, "A", 10)], "contest_id int, label string, model_id int")
    parsed = verdicts.parse_contest_replies(spark.createDataFrame([(1, reply.replace(', "no list"', "")), (2, "sorry")], "contest_id int, reply string"))
    found = {r.contest_id: r for r in verdicts.contest_results(parsed, labels).collect()}
    assert found[1].ranked_model_ids == ["10", "Z", "20", "30"] and found[1].tie_model_ids == ["10", "20"]
    assert found[1].anonymized_map == {"A": "10", "B": "20", "C": "30"} and found[1].tie_exists and found[1].judge_reasoning == "r"
    assert found[2].parse_error and found[2].ranked_model_ids == [] and found[2].tie_model_ids is None
    entries = verdicts.contest_entries(verdicts.contest_placements(parsed, labels), spark.createDataFrame([(1, 5), (2, 6)], "contest_id int, contest_ts int"))
    assert {(r.model_id, r.placement, r.entrants) for r in entries.collect()} == {(10, 1, 3), (20, 2, 3), (30, 99, 3)}


def test_run_stream_keeps_the_first_of_each_key_in_any_order(spark):
    rows = [(f"r{k}", k % 5, 1, "cot", "{}", datetime(2024, 1, 1) + timedelta(days=(k * 37) % 100)) for k in range(60)]
    runs = spark.createDataFrame(rows, "run_id string, question_id int, model_id int, prompt_strategy string, hyperparams string, run_timestamp timestamp")
    want = {r.run_id for r in ingest.dedupe_runs(runs, key=live.RUN_KEY).collect()}
    for seed in (1, 2):
        arrived = new_folder(spark, "runs")
        for part in range(5):
            runs.filter(F.pmod(F.xxhash64("run_id", F.lit(seed)), F.lit(5)) == part).coalesce(1).write.mode("append").parquet(arrived)
        stream = live.file_stream(spark, runs.schema, arrived, per_batch=1)
        assert {r.run_id for r in live.stream_run_dedupe(stream, new_folder(spark, "first")).collect()} == want


def test_a_batch_of_runs_reads_no_earlier_batch(spark):
    rows = [(f"r{k}", k % 50, 1, "cot", "{}", datetime(2024, 1, 1) + timedelta(days=(k * 37) % 400)) for k in range(1200)]
    runs = spark.createDataFrame(rows, "run_id string, question_id int, model_id int, prompt_strategy string, hyperparams string, run_timestamp timestamp")
    folder, stream = new_folder(spark, "first"), stored_in_files(spark, runs, "runs", 12, F.crc32("run_id") % 12)
    read, write = [], live._table_writer(f"{folder}/rows")
    live_writer = lambda batch, n: (write(batch, n), read.append(records_read(spark)))
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(live, "_table_writer", lambda where: live_writer)
        found = {r.run_id for r in live.stream_run_dedupe(stream, folder).collect()}
    assert found == {r.run_id for r in ingest.dedupe_runs(runs, key=live.RUN_KEY).collect()} and len(read) == 12
    steps = [b - a for a, b in zip(read, read[1:])]
    assert max(steps) <= 200  # the rows of its own file, about a hundred


def test_unknown_axis_is_an_error(spark):
    board = spark.createDataFrame([(1, 2.0)], "model_id int, mcs_score double")
    models = spark.createDataFrame([(1, "m", "p")], "model_id int, display_name string, provider string")
    with pytest.raises(ValueError):
        reports.leaderboard(board, models, sort_by="elo_rating")
    given = spark.createDataFrame([(1, 1300)], "model_id int, rating int")
    assert reports.leaderboard(board, models, given, "elo_rating").first().elo_rating == 1300


def test_names_alone_need_no_value_digests(spark, monkeypatch):
    monkeypatch.setitem(accuracy.KEYS, "values", None)
    assert f1(spark, [{"a": "5.0"}], [{"a": "5"}]) == (1, 1, 1)


@pytest.mark.parametrize("value, plain, rounded", [
    ("5.0", "5", "5"), ("-0.00", "0", "0"), ("100", "100", "100"), ("100.50", "100.5", "100.5"), ("1e3", "1000", "1000"),
    ("0.00004", "0.00004", "0"), ("2.00005", "2.00005", "2.0001"), ("0123.0", "0123.0", "0123.0"), ("9" * 40 + ".0", "9" * 40, "9" * 40 + ".0"),
])
def test_forms_of_numbers(spark, value, plain, rounded):
    row = spark.createDataFrame([(value,)], "v string").select(accuracy._plain(F.col("v")), accuracy._rounded(F.col("v"))).first()
    assert tuple(row) == (plain, rounded)


def python_plan_nodes(df, name):
    return df._jdf.queryExecution().optimizedPlan().toString().count(name)


def test_a_contest_reply_is_parsed_once(spark):
    """Three uses of the parsed replies, ties in ranked and unranked labels, and an unknown contest."""
    reply = '{"rankings": [{"label": "A", "placement": 1}, {"label": "B", "placement": 1}], "ties": [["B", "A", "X"], []]}'
    parsed = verdicts.parse_contest_replies(spark.createDataFrame([(1, reply), (None, reply), (3, '{"ties": []}')], "contest_id int, reply string"))
    labels = spark.createDataFrame([(1, "A", 10), (1, "B", 20)], "contest_id int, label string, model_id int")
    results = verdicts.contest_results(parsed, labels)
    assert python_plan_nodes(results, "ArrowEvalPython") == 0  # read from the written replies
    found = {r.contest_id: (r.ranked_model_ids, r.tie_model_ids, r.anonymized_map, r.tie_exists) for r in results.collect()}
    assert found == {1: (["10", "20"], ["20", "10", "X"], {"A": "10", "B": "20"}, True), None: ([], None, {}, True), 3: ([], None, {}, False)}


def test_contest_entries_meet_once_by_contest(spark, tables):
    entries = Marts(spark, tables).contest_entries()
    plan = entries._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Aggregate") == 1
    lost = entries.filter("contest_id IS NULL OR entrants < 2").count()
    assert lost == 0
