"""Ratings kept up to date while the entries of contests arrive apart, in any order.

Every step (a micro-batch, or the closing of a run) reads the tables that the step before it left and writes its own, so a step
that is run again after a failure finds the same and overwrites what it wrote. Steps are numbered 2 n for batch n and 2 n + 1 for a
closing after it.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from scoreloom.operators import ratings

SNAPSHOT_EVERY = 16
CONTEST = ["league", "contest_id"]
LOG = [*ratings.LOG_COLUMNS, "entrants"]


class ContestTables:
    """The tables of one stream below a folder: work (entries by state), times, ratings and history, a folder per step."""

    def __init__(self, spark: SparkSession, folder: str, schema: StructType):
        self.spark, self.folder = spark, folder
        kinds = {f.name: f.dataType for f in schema.fields}
        self.log = StructType([StructField(c, kinds[c]) for c in LOG])
        self.work = StructType([*self.log.fields, StructField("state", StringType())])
        ts = kinds["contest_ts"]
        self.times = StructType([StructField("league", kinds["league"]), StructField("seen", ts), StructField("played", ts)])
        self.rating = StructType([StructField("league", kinds["league"]), StructField("model_id", kinds["model_id"]), StructField("rating", IntegerType())])
        moves = [StructField(c, IntegerType()) for c in ("old_rating", "new_rating", "delta")]
        self.moves = StructType([*[f for f in self.log.fields if f.name != "entrants"], *moves])

    def path(self, table: str, step: int) -> str:
        return f"{self.folder}/{table}/step={step}"

    def read(self, table: str, step: int | None, schema: StructType) -> DataFrame:
        if step is None:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path(table, step))

    def write(self, df: DataFrame, table: str, step: int, by: str | None = None) -> DataFrame:
        writer = df.write.mode("overwrite")
        (writer.partitionBy(by) if by else writer).parquet(self.path(table, step))
        return self.spark.read.schema(df.schema).parquet(self.path(table, step))

    def steps(self, table: str) -> list[int]:
        """The steps that wrote a table to the end."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{table}/step=*/_SUCCESS")
        found = root.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(root)
        return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found or [])

    def before(self, step: int) -> int | None:
        """The last step before this one; times is what a step writes last."""
        return max((s for s in self.steps("times") if s < step), default=None)

    def ratings_before(self, step: int) -> DataFrame | None:
        """The latest rating of every model: a full table of some step and what the steps since then have changed."""
        full = max((s for s in self.steps("snapshot") if s < step), default=None)
        changed = [s for s in self.steps("ratings") if s < step and (full is None or s > full)]
        if full is None and not changed:
            return None
        parts = [self.read("snapshot", full, self.rating).withColumn("step", F.lit(full))] if full is not None else []
        parts += [self.read("ratings", s, self.rating).withColumn("step", F.lit(s)) for s in changed]
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        return rows.groupBy("league", "model_id").agg(F.max_by("rating", "step").alias("rating"))

    def all_of(self, table: str, schema: StructType) -> DataFrame:
        if not self.steps(table):
            return self.spark.createDataFrame([], schema)
        wide = StructType([*schema.fields, StructField("step", LongType())])
        return self.spark.read.schema(wide).parquet(f"{self.folder}/{table}").drop("step")


def _by_state(rows: DataFrame, times: DataFrame) -> DataFrame:
    """Entries with state: due (complete, and no earlier one is awaited), late (complete after later ones were played) or open."""
    whole = rows.groupBy(*CONTEST).agg((F.count(F.lit(1)) >= F.max("entrants")).alias("complete"))
    held = rows.join(whole, CONTEST).join(times, "league")
    state = (
        F.when(~F.col("complete"), "open").when(F.col("contest_ts") <= F.col("played"), "late")
        .when(F.col("contest_ts") <= F.col("limit"), "due").otherwise("open")
    )
    return held.select(*LOG, state.alias("state"))


def play_step(tables: ContestTables, arrived: DataFrame | None, step: int, delay: Column | None, segment_size: int) -> None:
    """One step: entries that arrived join those that wait; contests that are due are rated in time order.

    An entry that is delivered twice counts once. Without arrived entries the step closes the log: what is complete is rated.
    """
    last, ts = tables.before(step), tables.times["played"].dataType
    waiting = tables.read("work", last, tables.work).where("state = 'open'").select(*LOG)
    rows = waiting if arrived is None else waiting.unionByName(arrived.select(*LOG))
    new = rows.select("league", F.col("contest_ts").alias("seen"), F.lit(None).cast(ts).alias("played"))
    times = tables.read("times", last, tables.times).unionByName(new).groupBy("league").agg(
        F.max("seen").alias("seen"), F.max("played").alias("played"))
    limit = F.col("seen") if delay is None or arrived is None else F.col("seen") - delay
    times = tables.write(times.withColumn("limit", limit.cast(ts)), "limits", step)
    # one shuffle: entries of a contest meet to drop repeats, to be counted and to get the state of their contest
    rows = rows.repartition(*CONTEST).dropDuplicates([*CONTEST, "model_id"])
    due = tables.write(_by_state(rows, times), "work", step, by="state").where("state = 'due'").select(*LOG)
    if not due.isEmpty():
        history = ratings.elo_history(due, tables.ratings_before(step), segment_size, stored=True)
        moves = tables.write(history.select(*[f.name for f in tables.moves.fields]), "history", step)
        tables.write(ratings.final_ratings(moves).select("league", "model_id", "rating"), "ratings", step)
    if step % (2 * SNAPSHOT_EVERY) >= 2 * SNAPSHOT_EVERY - 2 and (known := tables.ratings_before(step + 1)) is not None:
        tables.write(known, "snapshot", step)
    tables.write(times.select("league", "seen", F.greatest("played", "limit").alias("played")).coalesce(1), "times", step)


def _listed(tables: ContestTables, state: str) -> DataFrame:
    if state == "open":
        return tables.read("work", tables.before(1 << 62), tables.work).where("state = 'open'").drop("state")
    return tables.all_of("work", tables.work).where(F.col("state") == state).drop("state")


def open_contests(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """Entries that still wait for others of their contest, or for their time."""
    return _listed(ContestTables(spark, folder, schema), "open")


def late_contests(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """Entries of contests that were complete only after later ones of their league had been rated; they move no rating."""
    return _listed(ContestTables(spark, folder, schema), "late")
