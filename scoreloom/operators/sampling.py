"""Deterministic samples of the question bank.

Picks of one row per group are grouped minima, merged before the shuffle;
nothing sorts a whole group.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.functions import fixed_values as fv


def first_per(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The whole row with the smallest order value of each group."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("__row")).select(*keys, "__row.*")


def stratified_sample(questions: DataFrame) -> DataFrame:
    """One question per subtopic: medium, else easy, else hard, the first by id."""
    preference = F.when(F.col("difficulty") == "medium", 0).when(F.col("difficulty") == "easy", 1).otherwise(2)
    return first_per(questions, ["subtopic_id"], F.struct(preference.alias("p"), "question_id"))


def cell_sample(questions: DataFrame) -> DataFrame:
    """One question per subtopic and difficulty, plus a practical one if none is among them."""
    sample = first_per(questions, ["subtopic_id", "difficulty"], F.col("question_id"))
    practical = first_per(
        questions.filter(F.col("question_type") == "practical"), ["question_type"], F.col("question_id")
    )
    missing = practical.join(sample, "question_type", "left_anti")
    return sample.unionByName(missing.select(*sample.columns))


PREFIX_DIGITS = 4


def fast_sweep_sample(questions: DataFrame) -> DataFrame:
    """A fifth of every difficulty tier, and at least five questions over all tiers.

    Members are the smallest md5 digests of the ids. A histogram over digest
    prefixes (at most 65,536 per tier) finds the prefix in which a tier's quota
    ends; only the rows of that one prefix are ranked.
    """
    tiers = len(fv.DIFFICULTIES)
    floor = -(-fv.FAST_SWEEP_MINIMUM // tiers)
    rows = questions.withColumn("digest", F.md5(F.col("question_id").cast("string"))).withColumn(
        "prefix", F.substring("digest", 1, PREFIX_DIGITS)
    )
    by_prefix = Window.partitionBy("difficulty").orderBy("prefix")
    histogram = rows.groupBy("difficulty", "prefix").agg(F.count("*").alias("n"))
    tier_size = F.sum("n").over(Window.partitionBy("difficulty"))
    share = round(1 / fv.FAST_SWEEP_FRACTION)
    quota = F.greatest(F.ceil(tier_size / share), F.least(tier_size, F.lit(floor)))
    before = F.coalesce(F.sum("n").over(by_prefix.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    room = (
        histogram.withColumn("room", quota - before).filter(F.col("room") > 0)
        .select("difficulty", "prefix", "room", (F.col("n") > F.col("room")).alias("is_last"))
    )
    kept = rows.join(room, ["difficulty", "prefix"])
    rank = F.row_number().over(Window.partitionBy("difficulty", "prefix").orderBy("digest", "question_id"))
    last = kept.filter("is_last").withColumn("rank", rank).filter(F.col("rank") <= F.col("room")).drop("rank")
    return kept.filter(~F.col("is_last")).unionByName(last).select(*questions.columns)
