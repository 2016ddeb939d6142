"""Registered streaming queries with the SQL of their final state."""

from pyspark.sql import functions as F

from scoreloom.plans.mart_sql import rounded, with_marts
from scoreloom.plans.marts import Marts
from scoreloom.plans.rating_queries import REPLAY
from scoreloom.plans.report_queries import DONE, MCS
from scoreloom.session import new_folder, settings, shuffles_removed
from scoreloom.streaming import live

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = lambda spark, folder: fn(Marts(spark, folder))
        if sql:
            SQL[name] = sql
        return fn
    return add


ROWS_PER_FILE = 500_000


def arriving(m, df, name, files, file):
    """The rows as a stream of ``files`` deliveries, one per batch; ``file`` is the number of a row's delivery.

    The rows are written once, by the tasks that have them, and the files dealt out as they are. Every delivery is of the same number of files.
    """
    folder, dealt = new_folder(m.spark, name), new_folder(m.spark, f"{name}-dealt")
    rows = df.withColumn("file", file).where(F.col("file").between(0, files - 1))
    # a file is open for every delivery, so nothing is sorted; small row groups keep that in memory
    with shuffles_removed(m.spark), settings(m.spark, {"spark.sql.maxConcurrentOutputFileWriters": str(files)}):
        rows.write.partitionBy("file").options(maxRecordsPerFile=ROWS_PER_FILE, compression="zstd", **{"parquet.block.size": 16 << 20}).parquet(f"{dealt}/rows")
    m.spark.createDataFrame([], df.schema).coalesce(1).write.parquet(f"{dealt}/empty")
    width = live.deliver(m.spark, [f"{dealt}/rows/file={k}" for k in range(files)], f"{dealt}/empty", folder)
    return live.file_stream(m.spark, df.schema, folder, per_batch=width)


def slices(column):
    """Three slices of time: to 1996, to 1998, later."""
    return F.when(F.year(column) <= 1996, 0).when(F.year(column) <= 1998, 1).otherwise(2)


@query("stream_leaderboard", with_marts("runs judge_scores", f"""
SELECT model_id, count(*) AS run_count, {rounded(f'avg({MCS})', 2)} AS mcs_score, {rounded('avg(db_correctness_score)', 2)} AS db_correctness,
  {rounded('avg(llm_quality_score)', 2)} AS llm_quality, {rounded('avg(total_latency_ms)', 1)} AS avg_latency_ms
FROM runs JOIN judge_scores USING (run_id) WHERE {DONE} GROUP BY model_id"""))
def _(m):
    # a score comes up to 20 days before or after its run; odd ones arrive a file later, and runs of even models too
    runs = m.runs().filter(F.col("status") == "completed").select("run_id", "model_id", "total_latency_ms", "run_timestamp")
    days = F.make_dt_interval((F.crc32("run_id") % 41 - 20).cast("int"))
    scores = m.judge_scores().select("run_id", "master_composite_score", "db_correctness_score", "llm_quality_score").join(
        runs.select("run_id", (F.col("run_timestamp") + days).alias("scored_at")), "run_id")
    on_time = slices("run_timestamp")
    return live.stream_leaderboard(
        arriving(m, runs, "runs", 4, on_time + (F.col("model_id") % 2 == 0).cast("int")),
        arriving(m, scores, "scores", 4, slices("scored_at") + (F.crc32("run_id") % 2).cast("int")),
        new_folder(m.spark, "stream-leaderboard"), before="20 DAYS", after="20 DAYS", delay="1096 days")


@query("stream_run_dedupe", with_marts("runs", """
SELECT run_id, question_id, model_id, prompt_strategy, '{}' AS hyperparams, total_latency_ms, run_timestamp FROM runs
QUALIFY row_number() OVER (PARTITION BY question_id, model_id, prompt_strategy ORDER BY run_timestamp, run_id) = 1"""))
def _(m):
    # one configuration only, so that keys repeat, and files that are not in order of time
    runs = m.runs().withColumn("hyperparams", F.lit("{}")).select(
        "run_id", "question_id", "model_id", "prompt_strategy", "hyperparams", "total_latency_ms", "run_timestamp")
    stream = arriving(m, runs, "runs", 4, (F.crc32("run_id") % 4).cast("int"))
    return live.stream_run_dedupe(stream, new_folder(m.spark, "stream-dedupe"))


def telemetry(m):
    """Events in four files by their user, so every file covers the whole time and all but the first bring late rows."""
    events = m.raw("events").select(
        "ts", F.col("user_id").alias("model_id"), F.col("event_type").alias("prompt_strategy"),
        (F.col("value") * 10).alias("total_latency_ms"), (F.col("value") / 1000).alias("cost_usd"))
    return arriving(m, events, "events", 4, (F.crc32(F.concat_ws("|", "model_id", "ts")) % 4).cast("int"))


WINDOW_COLUMNS = f"""count(*) AS runs, {rounded('avg(value * 10)', 4)} AS avg_latency_ms, {rounded('sum(value / 1000)', 4)} AS cost_usd"""


def without_zone(df):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


@query("stream_telemetry", f"""
SELECT time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') AS window_start, window_start + INTERVAL 6 HOURS AS window_end,
  event_type AS prompt_strategy, {WINDOW_COLUMNS} FROM events GROUP BY ALL""")
def _(m):
    return without_zone(live.stream_windows(telemetry(m), new_folder(m.spark, "stream-windows"), "6 hours"))


@query("stream_telemetry_sliding", f"""
SELECT time_bucket(INTERVAL 3 HOURS, ts, TIMESTAMP '1970-01-01') - o * INTERVAL 3 HOURS AS window_start, window_start + INTERVAL 6 HOURS AS window_end,
  event_type AS prompt_strategy, {WINDOW_COLUMNS} FROM events, range(2) r(o) GROUP BY ALL""")
def _(m):
    return without_zone(live.stream_windows(telemetry(m), new_folder(m.spark, "stream-sliding"), "6 hours", "3 hours"))


@query("stream_telemetry_sessions", f"""
WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOURS THEN 0 ELSE 1 END AS is_first FROM events),
s AS (SELECT *, sum(is_first) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session_no FROM g)
SELECT min(ts) AS window_start, max(ts) + INTERVAL 2 HOURS AS window_end, user_id AS model_id, {WINDOW_COLUMNS}
FROM s GROUP BY user_id, session_no""")
def _(m):
    return without_zone(live.stream_sessions(telemetry(m), new_folder(m.spark, "stream-sessions"), "2 hours"))


@query("stream_elo", REPLAY + """ SELECT league, contest_id, v.model_id AS model_id, v.placement::INT AS placement,
  v.old_rating AS old_rating, v.new_rating AS new_rating, v.new_rating - v.old_rating AS delta FROM moves""")
def _(m):
    # one entry in three comes a file later than the others of its contest, so contests wait for up to three years
    log = m.contest_log()
    stream = arriving(m, log, "contest-log", 4, slices("contest_ts") + (F.col("model_id") % 3 == 0).cast("int"))
    state = new_folder(m.spark, "stream-elo")
    return live.stream_elo(stream, state, delay=F.expr("INTERVAL 1096 DAYS")).drop("contest_ts")
