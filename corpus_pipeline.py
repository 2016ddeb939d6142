"""The corpus pipeline: stages over documents, each calling one operator of scoreloom.llm."""

from pyspark.sql import functions as F

from scoreloom.llm.decontaminate import decontaminate
from scoreloom.llm.jaccard_join import keep_one_of_each
from scoreloom.llm.langid import keep_identified
from scoreloom.llm.line_templates import drop_recurring_lines
from scoreloom.llm.mixing import emit_mix, word_count
from scoreloom.session import new_folder

BATCH_BYTES = "2m"


def _small_batches(spark):
    """Whole texts go to Python in batches of 2 MiB instead of 64: an executor holds several of them at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def language_id(spark, docs, sf_dir):
    """Documents whose language is recognised.

    The model learns from the labelled rows of the documents table itself. Null texts and texts without a letter are not recognised and go;
    texts of any length are read whole; repeated rows are judged alike; an empty table gives no rows.
    """
    _small_batches(spark)
    return keep_identified(docs, spark.read.parquet(f"{sf_dir}/documents.parquet"), least=0.35)


def line_dedup(spark, docs, sf_dir):
    """Texts without lines of recurring templates; a document of which no word is left goes.

    Documents that had no word before stay as they are.
    """
    columns = docs.columns
    kept = drop_recurring_lines(docs, exact_fallback=True)
    left = kept.where((F.col("n_dropped") == 0) | (word_count(F.col("text")) > 0))
    return left.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else c for c in columns])


def ngram_jaccard(spark, docs, sf_dir):
    """One document of each group of near duplicates, the one with the smallest id.

    Documents without words and rows with a null id stay, but of rows that agree in id and text one stays; ties
    do not arise otherwise, since ids name the documents; an empty table gives no rows.
    """
    _small_batches(spark)
    return keep_one_of_each(docs)


def benchmark_decontamination(spark, docs, sf_dir):
    """Texts without benchmark passages; a document that is mostly passages goes.

    Null and empty texts stay as they are; long texts are scanned whole; repeated rows are cut alike; an empty table gives no rows.
    """
    _small_batches(spark)
    clean = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def mix_sources(spark, docs, sf_dir):
    """Systematic sampling of every source to its target words; one row per copy.

    Null texts have size 0 and a null source is the last; rows that repeat, or have no id, have copies of their own; an empty table gives no rows.
    """
    return emit_mix(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mix_sources", mix_sources),
]
ORACLE_SQL = None  # a language model and connected components are beyond SQL; see tests/llm


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):  # the next stage reads its input more than once
            folder = new_folder(spark, name)
            docs.write.parquet(folder)
            docs = spark.read.schema(docs.schema).parquet(folder)
    return docs
