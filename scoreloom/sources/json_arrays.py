"""Large JSON files of objects, read by many tasks.

Spark splits a text file at any line separator. With the closing brace as separator, a file of one large array falls into pieces
that tasks read side by side; a prefix scan over quotes and braces then tells which closing braces end an object.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from scoreloom.session import new_folder

BLOCK = ["file", "block"]


def _count(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """Pieces of the files in order of file, block and at, with their quotes and the braces they open.

    An escape never reaches over a closing brace. opens0 and opens1 are the opening braces outside texts if the piece begins
    outside or inside of one.
    """
    meta = F.col("_metadata")
    read = spark.read.option("lineSep", "}").text(path).select(
        meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), meta["file_size"].alias("file_size"),
        F.monotonically_increasing_id().alias("at"), F.col("value"), F.regexp_replace("value", r"(?s)\\.", "").alias("plain"),
    )
    texts = r'"[^"]*("|$)'
    return read.select(
        *BLOCK, "file_size", "at", "value", (F.octet_length("value") + 1).alias("size"), _count(F.col("plain"), '"').alias("quotes"),
        _count(F.regexp_replace("plain", texts, ""), "{").alias("opens0"),
        _count(F.regexp_replace(F.concat(F.lit('"'), "plain"), texts, ""), "{").alias("opens1"),
    )


def _net(start: int) -> Column:
    """Braces that a piece opens less those it closes, if its block begins outside (0) or inside (1) of a text."""
    begins, ends = (F.col("quotes_before") + start) % 2, (F.col("quotes_before") + F.col("quotes") + start) % 2
    return F.when(begins == 0, F.col("opens0")).otherwise(F.col("opens1")) - F.when(ends == 0, 1).otherwise(0)


def _levelled(pieces: DataFrame) -> DataFrame:
    """The pieces with ``ends``: whether the closing brace after them ends an object of the file.

    Inside a block sums run over its pieces; from block to block only one row with its sums is handed on.
    """
    inside = Window.partitionBy(*BLOCK).orderBy("at")
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    local = pieces.withColumn("quotes_before", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)))
    blocks = local.groupBy(*BLOCK).agg(
        F.sum("quotes").alias("quotes"), F.sum(_net(0)).alias("net0"), F.sum(_net(1)).alias("net1"), F.sum("size").alias("size"),
        F.max("at").alias("last_at"), F.max("file_size").alias("file_size"))
    in_file = Window.partitionBy("file").orderBy("block")
    before = in_file.rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.withColumn("start", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2)
    net = F.when(F.col("start") == 0, F.col("net0")).otherwise(F.col("net1"))
    # the last piece of a file has no closing brace, unless the file ends with one
    short = (F.sum("size").over(Window.partitionBy("file")) > F.col("file_size")) & (F.lead("block").over(in_file).isNull())
    starts = starts.withColumn("depth", F.coalesce(F.sum(net).over(before), F.lit(0))).select(
        *BLOCK, "start", "depth", F.when(short, F.col("last_at")).alias("open_at"))
    placed = local.join(starts, BLOCK)
    own = F.when(F.col("start") == 0, _net(0)).otherwise(_net(1))
    closes = ((F.col("quotes_before") + F.col("quotes") + F.col("start")) % 2 == 0) & ~F.col("at").eqNullSafe(F.col("open_at"))
    depth = F.col("depth") + F.sum(own).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return placed.withColumn("ends", closes & (depth == 0)).select(*BLOCK, "at", "value", "ends")


def read_json_objects(spark: SparkSession, path: str, schema: StructType, most_bytes: int | None = None) -> DataFrame:
    """The objects of JSON files: one array of objects, or objects one after the other, whatever their size and nesting.

    Most objects are one piece of text and are parsed where they are; only those with inner objects, or with a closing
    brace in a text, are put together by a grouping. ``most_bytes`` replaces Spark's bytes per task for this read. What cannot be parsed gives a row of nulls.
    """
    setting = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(setting)
    try:
        if most_bytes:
            spark.conf.set(setting, str(most_bytes))
        levelled = _levelled(_pieces(spark, path))
        folder = new_folder(spark, "json")
        levelled.write.parquet(folder)
    finally:
        spark.conf.set(setting, before)
    stored = spark.read.schema(levelled.schema).parquet(folder)
    inside = Window.partitionBy(*BLOCK).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    last = F.max(F.when(F.col("ends"), F.col("at"))).over(inside)
    blocks = stored.groupBy(*BLOCK).agg(F.max(F.when(F.col("ends"), F.col("at"))).alias("end"), F.min("at").alias("first"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    handed = blocks.select(*BLOCK, "first", F.last("end", ignorenulls=True).over(earlier).alias("handed"))
    # an object is named by the closing brace that ended the one before it
    named = stored.withColumn("last", last).join(handed, BLOCK).withColumn("owner", F.coalesce("last", "handed", F.lit(-1)))
    alone = F.col("ends") & (F.lag("ends", 1).over(Window.partitionBy(*BLOCK).orderBy("at")))
    named = named.withColumn("alone", F.coalesce(alone, F.lit(False)))
    whole = named.where("alone").select(F.concat("value", F.lit("}")).alias("text"))
    part = F.struct("block", "at", F.concat(F.col("value"), F.when(F.col("ends"), "}").otherwise("")).alias("value"), "ends")
    rest = named.where("NOT alone").groupBy("file", "owner").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    inner = F.array_join(F.transform("parts", lambda p, k: F.when(~p["ends"] & (k + 1 < F.size("parts")), F.concat(p["value"], F.lit("}"))).otherwise(p["value"])), "")
    texts = whole.unionByName(rest.select(inner.alias("text"))).select(F.regexp_extract("text", r"(?s)\{.*", 0).alias("text")).where("text != ''")
    return texts.select(F.from_json("text", schema).alias("record")).select("record.*")
