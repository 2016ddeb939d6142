"""Mixing sources to target weights by systematic sampling."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
SEED = "mix"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights=WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """Target words per source for rows (source, source_size), one row per source.

    Sources by code point, null last, take the weights in turn and share all words.
    A target stops at ``most`` times its source; the rest is shared again by weight:
    target = min(weight * level, most * source_size), with the level found by prefix
    sums over the sources in order of the level at which each is full. One task orders
    the sources; there is one row per source here, not per document.
    """
    named = Window.orderBy(F.col("source").asc_nulls_last())
    filled = Window.orderBy("full_at", "place")
    earlier = filled.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    turn = F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1
    placed = sources.withColumn("place", F.row_number().over(named)).withColumn(
        "weight", F.element_at(F.array(*[F.lit(w) for w in weights]), turn.cast("int"))
    )
    levels = placed.withColumn("ceiling", F.col("source_size") * most).withColumn(
        "full_at", F.col("ceiling") / F.col("weight")
    ).withColumn(
        "level",
        (F.sum("source_size").over(every) - F.coalesce(F.sum("ceiling").over(earlier), F.lit(0)))
        / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(earlier), F.lit(0))),
    )
    fits = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "place", "level"))).over(every)
    return levels.withColumn("share", F.col("weight") * F.coalesce(fits["level"], F.lit(0.0))).select(
        "source", "source_size", F.least(F.col("share"), F.col("ceiling").cast("double")).alias("target")
    )


def mix_counts(
    docs: DataFrame, weights=WEIGHTS, most: int = MOST_COPIES, seed: str = SEED,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """Copies that the mix takes of every document.

    Each document of a source expects target / source_size copies. Documents of a source
    are ordered by size class (length and first five digits of the size in base 2), then by a digest
    of the id; the prefix sum of the expected copies plus one offset per source gives a
    copy for every integer that a document's step crosses. Size order makes the taken
    words come near the target. The prefix sum is kept per (source, size class, lane): lanes are
    256 ranges of the digest, so a hot source, or a size that a third of all rows share,
    is spread over tasks, and only counts per lane meet in one window per source.

    Defined results: null text has size 0; null source is a source of its own, the last;
    null ids order like the text ``null``; repeated rows are documents of their own; an empty
    table gives no rows. The same rows and seed give the same copies.
    Returns doc_id (named ``id_col``), size, source_size, target, copies, taken.
    """
    return _counted(docs, [], weights, most, seed, id_col, text_col, source_col).withColumnRenamed("id", id_col)


def _counted(docs: DataFrame, carried: list[Column], weights, most: int, seed: str, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """The counts of ``mix_counts`` (with the id as ``id``) and, beside them, the carried columns of the same row."""
    name = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    bits = F.bin("size")
    sized = (
        docs.select(
            F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
            F.md5(F.concat(F.lit(f"{seed}:"), name)).alias("draw"), F.xxhash64(text_col).alias("body"), *carried,
        )
        .withColumn("key", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")))
        .withColumn("class", F.concat(F.lpad(F.length(bits).cast("string"), 2, "0"), F.substring(bits, 1, 5)))
        .withColumn("lane", F.substring("draw", 1, 2))
    )
    cell = ["key", "class", "lane"]
    cells = sized.groupBy(*cell).agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"), F.first("source").alias("source")
    )
    sources = cells.groupBy("key").agg(F.first("source").alias("source"), F.sum("words").alias("source_size"))
    targets = source_targets(sources, weights, most).select(
        F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("key"), "source_size", "target"
    )
    in_source = Window.partitionBy("key").orderBy("class", "lane").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        cells.withColumn("ahead", F.coalesce(F.sum("n").over(in_source), F.lit(0)))
        .join(targets, "key").select(*cell, "ahead", "source_size", "target")
    )
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("key"))), 1, 6), 16, 10).cast("double") / (1 << 24)
    in_cell = Window.partitionBy(*cell).orderBy("draw", F.col("id").asc_nulls_last(), "size", "body")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return (
        sized.join(placed, cell)
        .withColumn("step", F.col("ahead") + F.row_number().over(in_cell))
        .withColumn("rate", rate).withColumn("offset", offset)
        .withColumn(
            "copies",
            F.floor(F.col("rate") * F.col("step") + F.col("offset"))
            - F.floor(F.col("rate") * (F.col("step") - 1) + F.col("offset")),
        )
        .select(
            "id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"),
            *[c for c in sized.columns if c == "row"],
        )
    )


def emit_mix(
    docs: DataFrame, weights=WEIGHTS, most: int = MOST_COPIES, seed: str = SEED,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """The mix itself: each document once per copy, with ``copy`` from 1.

    Every row brings its own copies, so rows with a null id and rows that repeat an id are taken as
    ``mix_counts`` counts them. An input column called ``copy`` is replaced.
    """
    row = F.struct(*docs.columns).alias("row")
    counted = _counted(docs, [row], weights, most, seed, id_col, text_col, source_col).where("copies > 0")
    taken = counted.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    return taken.select(*[F.col("row")[c].alias(c) if c != "copy" else F.col(c) for c in docs.columns],
                        *[c for c in ["copy"] if c not in docs.columns])
