"""Elo against a plain sequential replay."""

import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from scoreloom.operators import ratings


def sequential(contests, start=1200):
    """contests: [(league, contest, ts, [(placement, model)])] -> {(league, contest, model): (old, new)}"""
    known, moves = {}, {}
    for league, contest, ts, entries in sorted(contests, key=lambda c: (c[0], c[2], c[1])):
        entries = sorted(entries)
        old = {m: known.get((league, m), start) for _, m in entries}
        for place, model in entries:
            new = old[model]
            for other_place, other in entries:
                if other == model:
                    continue
                actual = 1.0 if place < other_place else 0.0 if place > other_place else 0.5
                new = round(new + 32 * (actual - 1 / (1 + 10 ** ((old[other] - old[model]) / 400))) / (len(entries) - 1))
            moves[league, contest, model] = (old[model], new)
        for _, model in entries:
            known[league, model] = moves[league, contest, model][1]
    return moves


def log_of(spark, contests):
    rows = [
        (league, contest, ts, model, place, len(entries))
        for league, contest, ts, entries in contests for place, model in entries
    ]
    return spark.createDataFrame(
        rows, "league int, contest_id long, contest_ts long, model_id long, placement int, entrants long"
    )


def moves_of(history):
    return {(r.league, r.contest_id, r.model_id): (r.old_rating, r.new_rating) for r in history.collect()}


def made_up(seed, contests=120, models=9, hot=None):
    rng = random.Random(seed)
    log = []
    for i in range(contests):
        league = 0 if rng.random() < 0.7 else rng.randrange(1, 4)
        size = hot if hot and i % 40 == 7 else rng.randrange(1, 6)
        members = rng.sample(range(max(models, size)), size)
        log.append((league, i, rng.randrange(60), [(rng.randrange(1, size + 1), m) for m in members]))
    return log


def test_two_even_models(spark):
    moves = moves_of(ratings.elo_history(log_of(spark, [(0, 1, 1, [(1, 10), (2, 20)])])))
    assert moves == {(0, 1, 10): (1200, 1216), (0, 1, 20): (1200, 1184)}


@pytest.mark.parametrize("size", [30, 1000])
def test_segments_do_not_change_the_outcome(spark, size):
    contests = made_up(size)
    assert moves_of(ratings.elo_history(log_of(spark, contests), segment_size=size)) == sequential(contests)


def test_very_large_contests_keep_their_rows(spark):
    contests = made_up(5, contests=60, hot=80)
    moves = moves_of(ratings.elo_history(log_of(spark, contests), segment_size=40))
    assert moves == sequential(contests)


def test_contests_that_cannot_move_a_rating_have_vanishing_steps(spark):
    rows = spark.range(2, 100).select("id", ratings.can_move(F.col("id")).alias("moves")).collect()
    assert all(r.moves == (32 / (r.id - 1) >= 0.5) for r in rows)


@pytest.mark.parametrize("models", [10, 400])
def test_every_stretch_is_replayed_once_from_its_own_files(spark, models, monkeypatch):
    contests = [(0, i, i, [(1, i % models), (2, (i * 7 + 1) % models)]) for i in range(240) if i % models != (i * 7 + 1) % models]
    read = []
    replay = ratings._replayed
    monkeypatch.setattr(ratings, "_replayed", lambda log, *more: read.append(set(log.inputFiles())) or replay(log, *more))
    moves = moves_of(ratings.elo_history(log_of(spark, contests), segment_size=40))
    assert len(read) == -(-len(contests) // 40) and sum(map(len, read)) == len(set().union(*read))
    assert moves == sequential(contests)


def test_lanes_share_no_model(spark):
    contests = [(0, i, i, [(1, i % 30 * 3 + i // 30 % 2), (2, i % 30 * 3 + i // 30 % 2 + 1)]) for i in range(80)]
    log = log_of(spark, contests).withColumn("segment", F.lit(0))
    rows = ratings._dealt(None, log.toPandas())
    assert rows.groupby("model_id").lane.nunique().max() == rows.groupby("contest_id").lane.nunique().max() == 1
    assert rows.lane.nunique() > 8
    assert moves_of(ratings.elo_history(log_of(spark, contests), segment_size=30)) == sequential(contests)


def big_league(folder, count, models):
    """A league of two-entrant contests as Parquet, with the pairs and placements that it holds."""
    draw = np.random.default_rng(7)
    first = draw.integers(0, models, count)
    pairs = np.stack([first, (first + draw.integers(1, models, count)) % models], axis=1)
    places = draw.integers(1, 3, (count, 2))
    pq.write_table(pa.table({
        "league": pa.array(np.zeros(2 * count, np.int32)), "contest_id": np.repeat(np.arange(count), 2), "contest_ts": np.repeat(np.arange(count) // 3, 2),
        "model_id": pairs.ravel(), "placement": pa.array(places.ravel().astype(np.int32)), "entrants": np.full(2 * count, 2),
    }), folder / "log.parquet", row_group_size=1 << 18)
    return pairs, places


def test_a_league_of_a_million_contests(spark, tmp_path):
    pairs, places = big_league(tmp_path, 1_000_000, 20_000)
    known, expected = [1200] * 20_000, np.empty(pairs.shape, np.int64)
    for k, ((a, b), (x, y)) in enumerate(zip(pairs.tolist(), places.tolist())):
        win = 1.0 if x < y else 0.0 if x > y else 0.5
        ra, rb = known[a], known[b]
        known[a] = round(ra + 32 * (win - 1 / (1 + 10 ** ((rb - ra) / 400))))
        known[b] = round(rb + 32 * (1 - win - 1 / (1 + 10 ** ((ra - rb) / 400))))
        expected[k] = known[a], known[b]
    history = ratings.elo_replay(spark.read.parquet(str(tmp_path))).select("contest_id", "model_id", "new_rating").toPandas()
    history = history.sort_values(["contest_id", "model_id"])
    assert (history.new_rating.to_numpy().reshape(-1, 2) == np.take_along_axis(expected, np.argsort(pairs, axis=1), 1)).all()


def records_read(spark):
    """Rows of files read by all stages of the session so far."""
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
    stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
    return sum(stages.apply(k).inputRecords() for k in range(stages.size()))


def test_more_stretches_do_not_read_the_log_more_often(spark, tmp_path):
    big_league(tmp_path, 40_000, 500)
    read = []
    for size in (20_000, 4_000):
        before = records_read(spark)
        ratings.elo_replay(spark.read.parquet(str(tmp_path)), segment_size=size).agg(F.sum("delta")).collect()
        read.append(records_read(spark) - before)
    assert read[1] < 1.3 * read[0] and read[0] < 10 * 80_000, read


def test_one_round_equals_the_replay(spark):
    contests = [(0, i, i, entries) for i, (_, _, _, entries) in enumerate(made_up(3, 20)) if len(entries) > 1]
    log = log_of(spark, contests).withColumn("rating", F.lit(1200))
    got = {(r.contest_id, r.model_id): r.new_rating for r in ratings.elo_round(log).collect()}
    alone = {}
    for contest in contests:
        alone |= {(c, m): new for (_, c, m), (_, new) in sequential([contest]).items()}
    assert got == alone


def test_pair_counts_add_up(spark):
    log = log_of(spark, made_up(4, hot=70))
    rows = ratings.contest_pairs(log).groupBy("contest_id").agg(
        F.sum("won").alias("won"), F.sum("lost").alias("lost"), F.sum("tied").alias("tied"), F.count("*").alias("n"))
    for r in rows.collect():
        assert r.won == r.lost and r.won + r.lost + r.tied == r.n * (r.n - 1)


def test_labels(spark):
    entries = spark.createDataFrame([(1, m) for m in range(60)] + [(2, 5)], "contest_id int, model_id int")
    rows = ratings.anonymise_contest(entries, seed=1).collect()
    big = sorted(r.label for r in rows if r.contest_id == 1)
    assert len(set(big)) == 60 and "A" in big and "H2" in big
    assert [r.label for r in rows if r.contest_id == 2] == ["A"]
    assert rows != ratings.anonymise_contest(entries, seed=2).collect()


def test_missing_placement_goes_last(spark):
    judged = spark.createDataFrame(
        [(1, "B", None), (1, "A", 2), (1, "C", 1)], "contest_id int, label string, placement int")
    rows = ratings.rank_placements(judged).orderBy("position").collect()
    assert [(r.label, r.placement) for r in rows] == [("C", 1), ("A", 2), ("B", 99)]
