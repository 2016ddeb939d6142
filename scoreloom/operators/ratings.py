"""Contest placements and Elo ratings."""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreloom.functions import fixed_values as fv
from scoreloom.functions.numbers import report_round
from scoreloom.operators.ordering import with_carried, with_rank_in, with_row_number_in
from scoreloom.session import new_folder, shuffles_removed


def can_move(entrants: Column) -> Column:
    """Whether a contest can change a rating.

    A pairwise step is at most K / (n - 1) points. Below half a point it rounds back to the
    whole rating it started from, so only contests of at most 2 K + 1 entrants need the pairwise fold.
    """
    return entrants - 1 <= 2 * fv.ELO_K


def expected_score(rating: Column, other: Column) -> Column:
    return 1.0 / (1.0 + F.pow(F.lit(10.0), (other - rating) / 400.0))


def updated_rating(rating: Column, actual: Column, expected: Column, k: int = fv.ELO_K) -> Column:
    """Rating after one match, rounded half to even."""
    return F.bround(rating + k * (actual - expected)).cast("int")


def placement_score(placement: Column, total: Column) -> Column:
    """1 for the first place down to 0 for the last, 1 in a contest of one."""
    return F.when(total <= 1, F.lit(1.0)).otherwise((total - placement) / (total - 1))


def mean_placement_score(entries: DataFrame) -> DataFrame:
    score = placement_score(F.col("placement"), F.col("entrants"))
    return entries.groupBy("model_id").agg(
        F.count("*").alias("contests"), report_round(F.avg(score), 6).alias("mean_placement_score")
    )


def contest_pairs(entries: DataFrame) -> DataFrame:
    """Outcome of all pairings of every entrant: opponents beaten, lost to and tied with.

    Counted from the number of entrants per placement, so no pair is built.
    """
    per_place = entries.groupBy("contest_id", "placement").agg(F.count("*").alias("n"))
    contest = Window.partitionBy("contest_id")
    earlier = contest.orderBy("placement").rowsBetween(Window.unboundedPreceding, -1)
    tallies = per_place.select(
        "contest_id", "placement",
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("lost"),
        (F.col("n") - 1).alias("tied"),
        F.sum("n").over(contest).alias("total"),
    ).withColumn("won", F.col("total") - F.col("lost") - F.col("tied") - 1)
    return entries.select("contest_id", "model_id", "placement").join(
        tallies, ["contest_id", "placement"]
    ).select("contest_id", "model_id", "won", "lost", "tied")


# --- placements ----------------------------------------------------------------------

UNPLACED = 99


def rank_placements(judged: DataFrame) -> DataFrame:
    """Position of every entry in its contest's ranked list; a missing placement goes last."""
    rows = judged.withColumn("placement", F.coalesce("placement", F.lit(UNPLACED)))
    lane = F.struct("placement", F.substring("label", 1, 2))
    return with_rank_in(rows, ["contest_id"], lane, ["placement", "label"], "position")


def label_of(rank: Column) -> Column:
    """A to Z, then A1 to Z1 and so on."""
    letter = F.char(F.lit(65) + (rank - 1) % 26)
    round_no = F.floor((rank - 1) / 26)
    return F.concat(letter, F.when(round_no > 0, round_no.cast("string")).otherwise(F.lit("")))


def anonymise_contest(entries: DataFrame, seed: int = 0) -> DataFrame:
    """A label per answer, and its number, in an order that depends on the contest and the seed only.

    Kept with the prompts, contest_id, label and model_id are the map that decodes a verdict. The answers of
    a contest, one per model, are numbered together. Rows without a contest have no label and go.
    """
    shuffled = F.md5(F.concat_ws("|", "contest_id", "model_id", F.lit(seed)))
    nth = F.row_number().over(Window.partitionBy("contest_id").orderBy("shuffle_key", "model_id")).cast("long")
    ranked = entries.filter(F.col("contest_id").isNotNull()).withColumn("shuffle_key", shuffled).withColumn("rank", nth)
    return ranked.select(*entries.columns, label_of(F.col("rank")).alias("label"), F.col("rank").alias("label_no"))


# --- one contest -----------------------------------------------------------------------


def _folded(me: Column, index: Column, entries: Column) -> Column:
    """New rating of one entrant: a rounded step per opponent, in listed order."""
    others = F.filter(entries, lambda o, j: j != index)
    step = F.lit(float(fv.ELO_K))

    def play(rating, o):
        actual = (
            F.when(me["placement"] < o["placement"], 1.0).when(me["placement"] > o["placement"], 0.0).otherwise(0.5)
        )
        delta = step * (actual - expected_score(me["rating"], o["rating"])) / F.size(others)
        return F.bround(rating + delta)

    return F.aggregate(others, me["rating"].cast("double"), play).cast("int")


def elo_round(entries: DataFrame) -> DataFrame:
    """One round per contest from the ratings given on its entries.

    ``entries`` has contest_id, model_id, placement, rating and entrants (the
    size of the contest).
    """
    entry = F.struct("placement", "model_id", "rating")
    small = (
        entries.filter(can_move(F.col("entrants")))
        .groupBy("contest_id").agg(F.sort_array(F.collect_list(entry)).alias("entries"))
    )
    played = F.transform("entries", lambda me, i: F.struct(
        me["model_id"].alias("model_id"), me["placement"].alias("placement"),
        me["rating"].alias("old_rating"), _folded(me, i, F.col("entries")).alias("new_rating"),
    ))
    large = entries.filter(~can_move(F.col("entrants"))).select(
        "contest_id", "model_id", "placement", F.col("rating").alias("old_rating"), F.col("rating").alias("new_rating")
    )
    return small.select("contest_id", F.inline(played)).unionByName(large).withColumn(
        "delta", F.col("new_rating") - F.col("old_rating")
    )


# --- the whole log ---------------------------------------------------------------------


def _play(entries: list, ratings: dict) -> list:
    """New ratings of one contest; ``entries`` are (placement, model) in listed order."""
    steps = len(entries) - 1
    results = []
    for i, (place, model) in enumerate(entries):
        old = new = ratings[model]
        for j, (other_place, other) in enumerate(entries):
            if i == j:
                continue
            actual = 1.0 if place < other_place else 0.0 if place > other_place else 0.5
            expected = 1.0 / (1.0 + 10 ** ((ratings[other] - old) / 400.0))
            new = round(new + fv.ELO_K * (actual - expected) / steps)
        results.append(new)
    return results


def _levels(bounds: list, models: list, count: int) -> np.ndarray:
    """Dependency level of every contest: one more than the highest level of its entrants' earlier contests."""
    last, levels = [0] * count, np.empty(len(bounds) - 1, np.int64)
    for k in range(len(levels)):
        entrants = models[bounds[k]: bounds[k + 1]]
        level = 1 + max(last[m] for m in entrants)
        for m in entrants:
            last[m] = level
        levels[k] = level
    return levels


GAPS = 4000  # rating differences whose expected scores are kept in a table
_expected = np.array([1.0 / (1.0 + 10 ** (g / 400.0)) for g in range(-GAPS, GAPS + 1)])


def _expected_of(gaps: np.ndarray) -> np.ndarray:
    known = _expected[np.clip(gaps, -GAPS, GAPS) + GAPS]
    for at in zip(*np.nonzero(np.abs(gaps) > GAPS)):
        known[at] = 1.0 / (1.0 + 10 ** (int(gaps[at]) / 400.0))
    return known


def _play_level(places: np.ndarray, before: np.ndarray) -> np.ndarray:
    """``_play`` for many contests of one size at once; a row per contest, its entries in listed order."""
    size = places.shape[1]
    me, after = np.arange(size), before.astype(float)
    for step in range(size - 1):
        other = step + (step >= me)  # everyone's next opponent
        actual = 0.5 + 0.5 * np.sign(places[:, other] - places)
        after = np.rint(after + fv.ELO_K * (actual - _expected_of(before[:, other] - before)) / (size - 1))
    return after.astype(np.int64)


NARROW = 8  # contests per level below which one contest after the other is the quicker way


def _replay_segment(key, log: pd.DataFrame, starts: pd.DataFrame) -> pd.DataFrame:
    """Replay one stretch of a league's log from the given ratings, level by level.

    Contests of one level share no entrant, so those of one size are played together.
    """
    if log.empty:  # a league that was rated before
        return log.assign(old_rating=0, new_rating=0)
    log = log.sort_values(["contest_ts", "contest_id", "placement", "model_id"], ignore_index=True)
    codes, names = pd.factorize(log["model_id"], use_na_sentinel=False)
    given = dict(zip(starts["model_id"], starts["rating"].astype(int)))
    ratings = np.array([given.get(m, fv.ELO_START) for m in names], np.int64)
    contest = log["contest_id"].to_numpy()
    bounds = np.r_[0, np.flatnonzero(contest[1:] != contest[:-1]) + 1, len(log)]
    places = log["placement"].to_numpy()
    olds, news = np.empty(len(log), np.int64), np.empty(len(log), np.int64)
    sizes, levels = np.diff(bounds), _levels(bounds.tolist(), codes.tolist(), len(names))
    if len(levels) < NARROW * levels.max():
        for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            entries = list(zip(places[start:end].tolist(), codes[start:end].tolist()))
            olds[start:end] = before = [int(ratings[m]) for _, m in entries]
            after = _play(entries, {m: r for (_, m), r in zip(entries, before)}) if len(entries) > 1 else before
            news[start:end] = ratings[codes[start:end]] = after
    else:
        order = np.lexsort((sizes, levels))
        cuts = np.flatnonzero((np.diff(levels[order]) != 0) | (np.diff(sizes[order]) != 0)) + 1
        for group in np.split(order, cuts):
            at = bounds[group][:, None] + np.arange(sizes[group[0]])
            before = ratings[codes[at]]
            after = _play_level(places[at], before) if at.shape[1] > 1 else before
            olds[at], news[at], ratings[codes[at]] = before, after, after
    return log.assign(old_rating=olds, new_rating=news)


LANES = 16


def _dealt(key, log: pd.DataFrame) -> pd.DataFrame:
    """A lane for every entry of a stretch: contests that are linked by entrants, directly or not, share one."""
    models, names = pd.factorize(log["model_id"], use_na_sentinel=False)
    contests, _ = pd.factorize(log["contest_id"])
    above = list(range(len(names)))

    def top(x):
        while above[x] != x:
            above[x] = x = above[above[x]]
        return x

    first = {}
    for contest, model in zip(contests.tolist(), models.tolist()):
        one, other = top(first.setdefault(contest, model)), top(model)
        if one != other:
            above[max(one, other)] = min(one, other)
    group = np.unique([top(x) for x in range(len(names))], return_inverse=True)[1]
    return log.assign(lane=group[models] % LANES)


def _longest(log: DataFrame) -> int:
    """Contests of the league that has most of them."""
    contests = log.select("league", "contest_ts", "contest_id").distinct()
    return contests.groupBy("league").count().agg(F.max("count")).first()[0] or 0


def _segments(log: DataFrame, size: int) -> DataFrame:
    """Number the stretches of each league's log, ``size`` contests to a stretch."""
    contests = log.select("league", "contest_ts", "contest_id").distinct()
    ranked = with_row_number_in(contests, ["league"], ["contest_ts", "contest_id"], "nth")
    segments = ranked.select("league", "contest_id", F.floor((F.col("nth") - 1) / size).alias("segment"))
    return log.join(segments, ["league", "contest_id"])


SEGMENT = ["league", "segment"]
LOG_COLUMNS = ["league", "contest_id", "contest_ts", "model_id", "placement"]


def _replayed(log: DataFrame, starts: DataFrame | None, keys: list[str]) -> DataFrame:
    """Replay the log of each group of keys from the ratings of its models in ``starts``; others start afresh."""
    kinds = dict(log.dtypes)
    output = ", ".join(f"{c} {kinds[c]}" for c in log.columns) + ", old_rating int, new_rating int"
    if starts is None:
        afresh = pd.DataFrame({"model_id": [], "rating": []})
        return log.groupBy(*keys).applyInPandas(lambda key, rows: _replay_segment(key, rows, afresh), output)
    # fresh column ids: the ratings may stem from the log itself
    given = starts.select(*[F.col(c).alias(c) for c in (*keys, "model_id", "rating")]).groupBy(*keys)
    return log.groupBy(*keys).cogroup(given).applyInPandas(_replay_segment, output)


def _ends(history: DataFrame) -> DataFrame:
    """The rating each model left a segment with."""
    return history.groupBy("league", "model_id").agg(
        F.max_by("new_rating", F.struct("contest_ts", "contest_id")).alias("rating")
    )


def _stored_by_segment(log: DataFrame, folder: str) -> str:
    """Deal each stretch of the log over lanes that share no model, and write it to a folder of its own."""
    kinds = dict(log.dtypes)
    dealt = log.groupBy(*SEGMENT).applyInPandas(_dealt, ", ".join(f"{c} {kinds[c]}" for c in log.columns) + ", lane long")
    dealt.write.partitionBy("segment").parquet(f"{folder}/log")
    return f"{folder}/log"


def _walk(log: DataFrame, segments: int, initial: DataFrame | None) -> DataFrame:
    """Replay segment after segment, each once; leagues and lanes run side by side in every step.

    A step reads its own folder of the log and the ratings of the models seen so far, which are all that is handed on.
    """
    spark, folder, known = log.sparkSession, new_folder(log.sparkSession, "elo"), initial
    stored, keys = _stored_by_segment(log, folder), ["league", "lane"]
    schema = T.StructType([*[f for f in log.schema.fields if f.name != "segment"], T.StructField("lane", T.LongType())])
    for number in range(segments):
        part = spark.read.schema(schema).parquet(f"{stored}/segment={number}")
        history = f"{folder}/history/part={number}"
        _replayed(part, known if known is None else _openings(part, known, keys), keys).drop("lane").write.parquet(history)
        latest = _ends(spark.read.parquet(history))
        if known is not None:
            latest = known.join(latest, ["league", "model_id"], "left_anti").unionByName(latest)
        if number + 1 < segments:
            ratings = f"{folder}/ratings/{number}"
            latest.write.parquet(ratings)
            known = spark.read.parquet(ratings)
    return spark.read.parquet(f"{folder}/history").drop("part")


def _openings(part: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Rating with which a model that was rated before enters a stretch."""
    return part.select(*keys, "model_id").distinct().join(known.select("league", "model_id", "rating"), ["league", "model_id"])


def elo_replay(log: DataFrame, initial: DataFrame | None = None, segment_size: int = 200_000, longest: int | None = None) -> DataFrame:
    """Elo history of a contest log, each league replayed in time order.

    ``log`` has league, contest_id, contest_ts, model_id, placement and entrants;
    ``initial`` optionally holds league, model_id and rating to start from.
    Contests depend on each other within a league, yet no task takes a whole
    league: its log is cut into stretches of ``segment_size`` contests that are replayed in turn (see ``_walk``), each read once
    from a folder of its own. Contests of a stretch that no entrant links run in different tasks, and
    within a task those of one dependency level are played together. Contests that cannot move a rating (see ``can_move``) stay out.
    ``longest`` spares the count of contests of the longest league where it is known, or known to be less.
    """
    small = log.filter(can_move(F.col("entrants"))).select(*LOG_COLUMNS)
    longest = _longest(small) if longest is None else longest
    if initial is not None:
        initial = initial.select("league", "model_id", "rating")
    if longest <= segment_size:
        history = _replayed(small, initial, ["league"])
    else:
        history = _walk(_segments(small, segment_size), -(-longest // segment_size), initial)
    return history.withColumn("delta", F.col("new_rating") - F.col("old_rating"))


def unmoved(log: DataFrame, history: DataFrame, initial: DataFrame | None = None) -> DataFrame:
    """History rows of the contests that are too large to move a rating."""
    columns = LOG_COLUMNS
    big = log.filter(~can_move(F.col("entrants"))).select(*columns)
    known = history.select(*columns, F.struct("league", "model_id", F.col("new_rating").alias("rating")).alias("state"))
    rows = known.unionByName(big.withColumn("state", F.lit(None).cast(known.schema["state"].dataType)))
    order = ["league", "model_id", "contest_ts", "contest_id"]
    carried = with_carried(rows, order, "state", "last_state").filter(F.col("state").isNull())
    same = (F.col("last_state.league") == F.col("league")) & (F.col("last_state.model_id") == F.col("model_id"))
    seen = F.when(same, F.col("last_state.rating"))
    if initial is not None:
        given = initial.select("league", "model_id", F.col("rating").alias("given"))
        carried = carried.join(given, ["league", "model_id"], "left")
        seen = F.coalesce(seen, F.col("given"))
    rating = F.coalesce(seen, F.lit(fv.ELO_START))
    return carried.select(
        *columns, rating.alias("old_rating"), rating.alias("new_rating"), F.lit(0).alias("delta")
    )


def elo_history(log: DataFrame, initial: DataFrame | None = None, segment_size: int = 200_000, stored: bool = False) -> DataFrame:
    """Old and new rating of every entry of a contest log.

    The log is read several times, so its few columns are written first, unless it is ``stored`` already.
    """
    log = log.select(*LOG_COLUMNS, "entrants")
    if not stored:
        folder = new_folder(log.sparkSession, "contests")
        with shuffles_removed(log.sparkSession):
            log.write.parquet(folder)
        log = log.sparkSession.read.schema(log.schema).parquet(folder)
    rows, largest = log.groupBy("league").agg(F.count(F.lit(1)).alias("n"), F.max("entrants").alias("largest")).agg(
        F.max("n"), F.max("largest")).first()
    # a league has no more contests than rows
    history = elo_replay(log, initial, segment_size, longest=rows or 0 if (rows or 0) <= segment_size else None)
    if (largest or 0) - 1 <= 2 * fv.ELO_K:  # can_move holds for all
        return history
    return history.unionByName(unmoved(log, history, initial))


def final_ratings(history: DataFrame) -> DataFrame:
    """Last rating of every model per league, with its contests and first places."""
    return history.groupBy("league", "model_id").agg(
        F.max_by("new_rating", F.struct("contest_ts", "contest_id")).alias("rating"),
        F.count("*").alias("contests"),
        F.count_if(F.col("placement") == 1).alias("first_places"),
    )
