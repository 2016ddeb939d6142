"""Exact deduplication by a distributed content sort."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.session import new_folder


def normalised(text: Column) -> Column:
    """Null counts as empty; every run of ASCII white space becomes one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _frequent(keyed: DataFrame, rows: int, hits: int) -> list[str]:
    """Digests met at least ``hits`` times in a sample of about ``rows``: at most rows / hits of them."""
    total = keyed.count()
    share = min(1.0, rows / max(total, 1))
    seen = keyed.sample(share, 7).groupBy("digest").count().where(F.col("count") >= hits)
    return [r.digest for r in seen.collect()]


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None,
    sample_rows: int = 20_000, sample_hits: int = 20, lanes: int = 64,
) -> DataFrame:
    """One row per document with the document that stays for its text.

    Spark samples splitters over (first 64 characters, digest, lane) and range-partitions
    the normalised texts by them; the external sort inside each partition places equal
    texts next to each other, and each text is compared in full with its neighbour. Texts
    that a sample shows to hold over about ``sample_hits / sample_rows`` of all rows are
    dealt over ``lanes``; the first row of each lane is then compared in full with
    those of the other lanes, so no task holds a hot group. Whole texts cross one shuffle.

    Defined results: null text equals empty text; null ids sort last and keep_id is null
    only if every id of the group is null; of repeated rows with the smallest id one is
    kept; an empty table gives no rows; other input columns are ignored.
    Returns doc_id (named ``id_col``), keep_id, group_size, kept, text_sha256.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = (
        docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("body"))
        .withColumn("head", F.substring("body", 1, 64))
        .withColumn("digest", F.sha2("body", 256))
    )
    hot = _frequent(keyed, sample_rows, sample_hits)
    is_hot = F.col("digest").isin(hot) if hot else F.lit(False)
    lane = F.when(is_hot, F.pmod(F.xxhash64("id"), F.lit(lanes))).otherwise(F.lit(0).cast("long"))
    sort_key = ["head", "digest", "lane"]
    ranged = keyed.withColumn("lane", lane).repartitionByRange(parts, *sort_key)

    in_order = Window.partitionBy(*sort_key).orderBy("body", F.col("id").asc_nulls_last())
    before = F.lag("body").over(in_order)
    compared = ranged.withColumn("fresh", before.isNull() | (before != F.col("body")))
    runs = compared.select(
        "id", *sort_key,
        F.sum(F.col("fresh").cast("int")).over(in_order.rowsBetween(Window.unboundedPreceding, 0)).alias("run"),
        F.when(is_hot & F.col("fresh"), F.col("body")).alias("lane_text"),
    )
    of_run = Window.partitionBy(*sort_key, "run")
    sized = runs.select(
        "*",
        F.min("id").over(of_run).alias("lane_first"),
        F.count(F.lit(1)).over(of_run).alias("lane_size"),
        F.row_number().over(of_run.orderBy(F.col("id").asc_nulls_last())).alias("place"),
    )
    if hot:
        # both sides of the stitching read these rows: without texts, but for the first of each hot lane
        staged = new_folder(spark, "lanes")
        sized.write.parquet(staged)
        sized = spark.read.parquet(staged)
        lane_rows = sized.where("lane_text IS NOT NULL").select(
            "digest", "lane", "run", "lane_text", "lane_first", "lane_size"
        )
        whole = lane_rows.groupBy("digest", "lane_text").agg(
            F.min("lane_first").alias("first"), F.sum("lane_size").alias("size")
        )
        # at most lanes * sample_rows / sample_hits rows without text
        stitched = lane_rows.join(whole, ["digest", "lane_text"]).select("digest", "lane", "run", "first", "size")
        sized = (
            sized.drop("lane_text")
            .join(F.broadcast(stitched), ["digest", "lane", "run"], "left")
            .withColumn("first", F.when(F.col("size").isNull(), F.col("lane_first")).otherwise(F.col("first")))
            .withColumn("size", F.coalesce("size", "lane_size"))
        )
    else:
        sized = sized.withColumn("first", F.col("lane_first")).withColumn("size", F.col("lane_size"))
    return sized.select(
        F.col("id").alias(id_col),
        F.col("first").alias("keep_id"),
        F.col("size").alias("group_size"),
        ((F.col("place") == 1) & F.col("lane_first").eqNullSafe(F.col("first"))).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
