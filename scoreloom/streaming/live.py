"""Incremental versions of the leaderboard, ratings, intake and telemetry.

Each query writes its results per micro-batch into a table of its own, in a
folder named after the batch, so a batch that is run again after a failure
overwrites what it wrote before.
"""

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from scoreloom.functions.numbers import report_round
from scoreloom.operators import ingest
from scoreloom.session import settings, shuffles_removed
from scoreloom.streaming import contests


def file_stream(spark: SparkSession, schema: StructType, folder: str, files: str = "*", per_batch: int | None = None) -> DataFrame:
    """Parquet files of a folder as they arrive."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", files)
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    return reader.parquet(folder)


def event_time(df: DataFrame, column: str) -> DataFrame:
    """Zone-less times as UTC timestamps, which watermarks need."""
    return df.withColumn(column, F.col(column).cast("timestamp"))


def run_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Process everything that has arrived, then stop."""
    query = (
        stream.writeStream.foreachBatch(handle).outputMode(mode)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


STATE_ON_DISK = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",  # a batch stores what it changed
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",  # else every put is a lookup as well
    "spark.sql.streaming.stateStore.rocksdb.compression": "zstd",
    "spark.sql.streaming.stateStore.compression.codec": "zstd",
}


def state_on_disk(spark: SparkSession):
    """Queries started inside keep their state in RocksDB, not in the memory of the executors."""
    return settings(spark, STATE_ON_DISK)


def _table_writer(folder: str) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/batch={batch_id}")

    return write


def _written(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """The rows that all batches wrote."""
    return spark.read.schema(schema).parquet(folder)


# --- averages per model ---------------------------------------------------------------------------

AVERAGED = {  # column: what is averaged, decimals
    "mcs_score": ("master_composite_score", 2), "db_correctness": ("db_correctness_score", 2),
    "llm_quality": ("llm_quality_score", 2), "avg_latency_ms": ("total_latency_ms", 1),
}


RUN, SCORE = 0, 1  # kinds of rows
TIMES = {RUN: "run_timestamp", SCORE: "scored_at"}


class WaitingTables:
    """Runs and scores that have arrived, in a table below a folder by batch and kind, and the times that each batch brought.

    A batch writes its own parts and reads those of the batches before, so one that is run again after a failure finds the same.
    """

    def __init__(self, spark: SparkSession, folder: str, runs: DataFrame, scores: DataFrame, before: str, after: str, delay: str):
        self.spark, self.folder = spark, folder
        self.before, self.after, self.delay = (F.expr(f"INTERVAL {i}") for i in (before, after, delay))
        sides = {RUN: event_time(runs, TIMES[RUN]), SCORE: event_time(scores, TIMES[SCORE]).withColumnRenamed("run_id", "scored_run")}
        self.columns = {kind: side.columns for kind, side in sides.items()}
        tagged = [side.withColumn("kind", F.lit(kind)) for kind, side in sides.items()]
        self.arriving = tagged[0].unionByName(tagged[1], allowMissingColumns=True)
        self.schema = StructType([*self.arriving.schema.fields, StructField("batch", IntegerType())])

    def _late(self, batch_id: int) -> Column:
        """Time up to which a row comes too late: ``delay`` behind the stream that had come less far two batches ago.

        These are the watermarks of a join of streams, which start at 1970 and never fall.
        """
        start = F.timestamp_millis(F.lit(0))
        if batch_id < 2:
            return start
        times = self.spark.read.schema("kind int, latest long, batch int").parquet(f"{self.folder}/times")
        latest = times.where(F.col("batch") < batch_id - 1).groupBy("kind").agg(F.max("latest").alias("latest")).collect()
        return F.greatest(start, F.timestamp_micros(F.lit(min(r.latest for r in latest))) - self.delay) if len(latest) == len(TIMES) else start

    def add(self, batch: DataFrame, batch_id: int) -> dict[int, tuple[Column, Column]]:
        """Store the rows of a batch that are not late; returns the first and last time of its runs and of its scores."""
        at = F.when(F.col("kind") == RUN, F.col(TIMES[RUN])).otherwise(F.col(TIMES[SCORE]))
        batch.where(at > self._late(batch_id)).write.mode("overwrite").partitionBy("kind").option("compression", "zstd").parquet(
            f"{self.folder}/arrived/batch={batch_id}")
        micros = F.unix_micros(at)
        self._stored().where(F.col("batch") == batch_id).groupBy("kind").agg(F.min(micros).alias("first"), F.max(micros).alias("latest")).coalesce(
            1).write.mode("overwrite").parquet(f"{self.folder}/times/batch={batch_id}")
        found = self.spark.read.schema("kind int, first long, latest long").parquet(f"{self.folder}/times/batch={batch_id}").collect()
        return {r.kind: (F.timestamp_micros(F.lit(r.first)), F.timestamp_micros(F.lit(r.latest))) for r in found}

    def _stored(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/arrived")

    def _side(self, kind: int, batch_id: int, reach: tuple[Column, Column] | None) -> DataFrame:
        """Rows of the batch, and of those before it the ones within ``reach`` of the other side's new rows."""
        fresh, earlier = F.col("batch") == batch_id, F.col("batch") < batch_id
        waiting = earlier & F.col(TIMES[kind]).between(*reach) if reach else F.lit(False)
        return self._stored().where((F.col("kind") == kind) & (fresh | waiting)).select(*self.columns[kind], fresh.alias(f"fresh_{kind}"))

    def pairs(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """Runs and scores of which the batch brought one or both; those that met in a batch before are not paired again."""
        new = self.add(batch, batch_id)
        runs = self._side(RUN, batch_id, (new[SCORE][0] - self.after, new[SCORE][1] + self.before) if SCORE in new else None)
        scores = self._side(SCORE, batch_id, (new[RUN][0] - self.before, new[RUN][1] + self.after) if RUN in new else None)
        near = F.col(TIMES[SCORE]).between(F.col(TIMES[RUN]) - self.before, F.col(TIMES[RUN]) + self.after)
        met = runs.join(scores, (F.col("run_id") == F.col("scored_run")) & near & (F.col("fresh_0") | F.col("fresh_1")))
        return met.drop("fresh_0", "fresh_1")


def stream_leaderboard(
    runs: DataFrame, scores: DataFrame, folder: str, before: str = "1 DAY", after: str = "30 DAYS", delay: str = "30 days",
) -> DataFrame:
    """Averages per model over runs and scores that arrive in streams of their own, whichever comes first.

    ``runs`` has run_timestamp, ``scores`` scored_at, which lies between ``before`` and ``after`` the run. Rows wait in tables. A batch
    reads its own rows and of the waiting ones those that its times can reach, and joins them as tables, so no batch goes through all that
    waits. Rows that come later than ``delay`` behind both streams are left out, as watermarks would.
    A batch writes counts and sums of the pairs it completed, a row per model; the board adds them up.
    """
    spark = runs.sparkSession
    tables = WaitingTables(spark, folder, runs, scores, before, after, delay)

    def sums(batch: DataFrame, batch_id: int) -> None:
        parts = [f(c).alias(f"{kind}_{name}") for name, (c, _) in AVERAGED.items() for kind, f in (("n", F.count), ("sum", F.sum))]
        tables.pairs(batch, batch_id).groupBy("model_id").agg(F.count("*").alias("run_count"), *parts).write.mode("overwrite").parquet(
            f"{folder}/rows/batch={batch_id}")

    with state_on_disk(spark), shuffles_removed(spark):  # what Spark keeps of the stream goes to disk as well
        run_batches(tables.arriving, sums, f"{folder}/checkpoint")
    rows = spark.read.parquet(f"{folder}/rows")
    averages = [report_round(F.sum(f"sum_{name}") / F.sum(f"n_{name}"), places).alias(name) for name, (_, places) in AVERAGED.items()]
    return rows.groupBy("model_id").agg(F.sum("run_count").alias("run_count"), *averages)


# --- runs -----------------------------------------------------------------------------------------

RUN_KEY = ["question_id", "model_id", "prompt_strategy", "hyperparams"]


def stream_run_dedupe(runs: DataFrame, folder: str) -> DataFrame:
    """First run of every configuration, by time and run id, whatever order the runs arrive in.

    The first run of each key is the state of a streaming aggregation, kept in RocksDB, so a batch reads its own rows and the keys
    it touches, however many batches went before. A batch writes the keys it touched; the result takes the first of each. No
    run is dropped for its age, so the state holds a row per key.
    """
    spark, columns, order = runs.sparkSession, runs.columns, ["run_timestamp", "run_id"]
    rest = [c for c in columns if c not in (*RUN_KEY, *order)]
    # the least row holds its order once, shuffled and kept
    first = runs.groupBy(*RUN_KEY).agg(F.min(F.struct(*order, *rest)).alias("row"))
    with state_on_disk(spark), shuffles_removed(spark):
        run_batches(first.select(*RUN_KEY, "row.*"), _table_writer(f"{folder}/rows"), f"{folder}/checkpoint", "update")
    return ingest.dedupe_runs(_written(spark, f"{folder}/rows", runs.schema).select(*columns), key=RUN_KEY)


def exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def file_count(spark: SparkSession, folder: str) -> int:
    """Number of Parquet files in a folder."""
    return len(_files(spark, folder)[1])


def _files(spark: SparkSession, folder: str):
    """The file system and the Parquet files of a folder."""
    found = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/*.parquet")
    system = found.getFileSystem(spark._jsc.hadoopConfiguration())
    return system, [f.getPath() for f in system.globStatus(found) or []]


def deliver(spark: SparkSession, parts: list[str], empty: str, folder: str) -> int:
    """Move the files of each part into one folder, the first part as the oldest; returns how many files every part has there.

    Streams take files by their time, so parts differ in it. Copies of the ``empty`` table's file fill up those with fewer files.
    """
    path, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    system, (blank, *_) = _files(spark, empty)
    system.mkdirs(path(folder))
    found = [_files(spark, part)[1] for part in parts]
    width, first = max(1, *map(len, found)), int(time.time() - len(parts)) * 1000
    for k, stored in enumerate(found):
        for n in range(width):
            target = path(f"{folder}/{k}-{n:05d}.parquet")
            if n >= len(stored):
                spark._jvm.org.apache.hadoop.fs.FileUtil.copy(system, blank, system, target, False, conf)
            elif not system.rename(stored[n], target):
                raise OSError(f"cannot move {stored[n]} to {target}")
            system.setTimes(target, first + 1000 * k, -1)
            if system.getFileStatus(target).getModificationTime() != first + 1000 * k:
                raise OSError(f"{folder}: the file system keeps no given times")
    return width


# --- telemetry ------------------------------------------------------------------------------------

SUMS = "runs long, n_latency long, sum_latency double, sum_cost double"


def _sums() -> list[Column]:
    return [F.count("*").alias("runs"), F.count("total_latency_ms").alias("n_latency"),
            F.sum("total_latency_ms").alias("sum_latency"), F.sum("cost_usd").alias("sum_cost")]


def _added() -> list[Column]:
    return [F.sum(c).alias(c) for c in ("runs", "n_latency", "sum_latency", "sum_cost")]


def _shown(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select("window_start", "window_end", *keys, "runs",
                     report_round(F.col("sum_latency") / F.col("n_latency"), 4).alias("avg_latency_ms"), report_round(F.col("sum_cost"), 4).alias("cost_usd"))


def _window_sums(telemetry: DataFrame, folder: str, window: Column, key: str, delay: str) -> DataFrame:
    """Counts and sums per window, a row per batch, window and key; ``late`` says that the window had ended ``delay`` before the batch.

    Sums of a window add up whatever batch they come from, so no row is dropped: those of a late batch correct what was shown.
    How far the stream had come before a batch is read from the table of the batches before.
    """
    spark = telemetry.sparkSession
    kind = telemetry.schema[key].dataType.simpleString()
    schema = f"window_start timestamp, window_end timestamp, {key} {kind}, {SUMS}, late boolean, batch long"

    def write(batch: DataFrame, batch_id: int) -> None:
        seen = None
        if batch_id and exists(spark, f"{folder}/seen"):
            times = spark.read.schema("seen timestamp, batch long").parquet(f"{folder}/seen")
            seen = times.where(F.col("batch") < batch_id).agg(F.max("seen")).first()[0]
        passed = F.lit(False) if seen is None else F.col("window_end") <= F.lit(seen) - F.expr(f"INTERVAL {delay}")
        parts = event_time(batch, "ts").groupBy(window.alias("w"), key).agg(*_sums())
        parts.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), key, "runs", "n_latency", "sum_latency", "sum_cost").withColumn(
            "late", passed).write.mode("overwrite").parquet(f"{folder}/rows/batch={batch_id}")
        event_time(batch, "ts").agg(F.max("ts").alias("seen")).write.mode("overwrite").parquet(f"{folder}/seen/batch={batch_id}")

    run_batches(telemetry, write, f"{folder}/checkpoint")
    return _written(spark, f"{folder}/rows", schema)


def stream_windows(telemetry: DataFrame, folder: str, size: str, slide: str | None = None, delay: str = "1 HOUR") -> DataFrame:
    """Latency and cost per strategy in tumbling, or with a slide overlapping, windows; late rows are added to their window."""
    key = "prompt_strategy"
    rows = _window_sums(telemetry, folder, F.window("ts", size, slide), key, delay)
    return _shown(rows.groupBy("window_start", "window_end", key).agg(*_added()), [key])


def late_windows(spark: SparkSession, folder: str) -> DataFrame:
    """What late rows added to windows that had ended: the corrections of a stream of windows, per batch."""
    return spark.read.parquet(f"{folder}/rows").where("late").drop("late")


def stream_sessions(telemetry: DataFrame, folder: str, gap: str, delay: str = "1 HOUR") -> DataFrame:
    """Latency and cost per model session, in whatever batches its rows arrive; the last sessions are closed by the end of the run.

    A batch writes its own sessions. Sessions of one model that overlap are one: the rows merged here are a few per
    model and batch, not its telemetry.
    """
    key = "model_id"
    rows = _window_sums(telemetry, folder, F.session_window("ts", gap), key, delay)
    in_order = Window.partitionBy(key).orderBy("window_start", "window_end")
    reach = F.max("window_end").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    begins = rows.withColumn("fresh", (reach.isNull() | (F.col("window_start") >= reach)).cast("int"))
    numbered = begins.withColumn("session", F.sum("fresh").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = numbered.groupBy(key, "session").agg(F.min("window_start").alias("window_start"), F.max("window_end").alias("window_end"), *_added())
    return _shown(merged, [key])


def stream_elo(
    log: DataFrame, folder: str, segment_size: int = 200_000, delay: Column | None = None, close: bool = True,
) -> DataFrame:
    """Elo history of contests whose entries arrive in any files and batches.

    ``log`` is as for ``elo_replay``. A contest waits until ``entrants`` different models are there and until no earlier one is
    awaited: until its league has seen a contest ``delay`` later (an interval, or a number where times are numbers; none: the
    batch itself). Contests that are due are rated in time order, so without late ones the history is
    that of ``elo_replay``. A contest that is complete only after later ones of its league were rated is late: it moves no rating
    and is listed by ``late_contests``. With ``close`` the run ends by rating all that is complete; what then still waits is listed by
    ``open_contests``. A later run goes on from there. A batch writes the ratings it changed; a full table every few batches bounds
    what a batch reads.
    """
    spark = log.sparkSession
    tables = contests.ContestTables(spark, folder, log.schema)
    run_batches(log, lambda batch, n: contests.play_step(tables, batch, 2 * n, delay, segment_size), f"{folder}/checkpoint")
    last = tables.before(1 << 62)
    if close and last is not None and last % 2 == 0:
        contests.play_step(tables, None, last + 1, delay, segment_size)
    return tables.all_of("history", tables.moves)
