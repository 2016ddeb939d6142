"""Line deduplication with a log-template tree."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.llm.bitfilter import likely_among
from scoreloom.session import new_folder

VARIABLE = "<*>"
LEAF_LINES = 20_000  # distinct lines of a leaf that one task works on
LINE = ["leaf", "a", "b"]


def _staged(df: DataFrame, name: str) -> DataFrame:
    folder = new_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def cleaned(text: Column) -> Column:
    """Text with blanks inside lines as one space."""
    return F.regexp_replace(text, r"[\x20\x09\x0B-\x0D]+", " ")


def masked(line: Column) -> Column:
    """Cleaned text with tokens that hold a digit as the variable mark."""
    # a token starts after a blank or line break; the possessive run keeps the search linear
    return F.regexp_replace(line, r"(?<![^ \n])[^ \n0-9]*+[0-9][^ \n]*", VARIABLE)


def _tokens(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(" "))) + 1


def _lines(docs: DataFrame, depth: int, min_tokens: int, id_col: str, text_col: str) -> DataFrame:
    """Lines with tokens (id, pos, clean line, long, leaf); only the tokens that name the leaf are masked here."""
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.posexplode(F.split(cleaned(F.col(text_col)), "\n")).alias("pos", "x"))
    clean = rows.select("id", "pos", F.trim("x").alias("clean")).where("clean != ''")
    n, head = _tokens(F.col("clean")), masked(F.substring_index("clean", " ", depth))
    return clean.select("id", "pos", "clean", (n >= min_tokens).alias("long"), F.xxhash64(n, head).alias("leaf"))


def _tokens_of(texts: DataFrame) -> DataFrame:
    """A row per token of the distinct lines: their columns, the token's place and its hash, null for the variable mark."""
    return texts.select(*LINE, "docs", F.posexplode(F.split("line", " ")).alias("at", "token")).select(
        *LINE, "docs", "at", F.when(F.col("token") != VARIABLE, F.xxhash64("token")).alias("token")
    )


def _placed_within(texts: DataFrame, min_docs: int) -> DataFrame:
    """Tokens with ``constant`` (1, 0): a line crosses one shuffle, to the task of its leaf, and its tokens none."""
    support = F.sum("docs").over(Window.partitionBy("leaf", "at", "token"))
    return _tokens_of(texts.repartition("leaf")).withColumn("support", support).select(
        *LINE, "at", "token", (F.col("token").isNotNull() & (F.col("support") >= min_docs)).cast("int").alias("constant")
    )


def _placed_across(texts: DataFrame, min_docs: int) -> DataFrame:
    """The same for leaves of very many lines, which no task may hold: tokens are dealt by place and token."""
    tokens = _tokens_of(texts)
    constant = tokens.where("token IS NOT NULL").groupBy("leaf", "at", "token").agg(F.sum("docs").alias("support")).where(
        F.col("support") >= min_docs
    ).select("leaf", "at", "token", F.lit(1).alias("constant"))
    return tokens.drop("docs").join(constant, ["leaf", "at", "token"], "left").select(
        *LINE, "at", "token", F.coalesce("constant", F.lit(0)).alias("constant")
    )


def _shapes(placed: DataFrame, least_constant: float) -> DataFrame:
    """Of each line (leaf, a, b): whether its template is general, and if so 128 bits of it (p, q)."""
    # a template is the set of its constant (place, token) pairs; the leaf has its length
    return placed.groupBy(*LINE).agg(
        F.avg("constant").alias("share"),
        *[F.bit_xor(F.when(F.col("constant") == 1, F.xxhash64(F.lit(k), "at", "token"))).alias(f"x{k}") for k in (0, 1)],
    ).select(*LINE, (F.col("share") >= least_constant).alias("general"), F.col("x0").alias("p"), F.col("x1").alias("q"))


def recurring_lines(
    docs: DataFrame, min_docs: int = 5, depth: int = 2, min_tokens: int = 4, least_constant: float = 0.6,
    id_col: str = "doc_id", text_col: str = "text", exact_fallback: bool = True,
) -> DataFrame:
    """(id, pos): the lines to drop.

    The tree has two levels, token count and the first ``depth`` tokens (tokens with digits are
    variables). In a leaf, a token is constant where ``min_docs`` or more documents' lines have it at its
    place, and variable otherwise; a line's template is its tokens with the variable ones masked, if at least
    ``least_constant`` of them are constant, and the line itself if not: as it stands, so that rows of numbers are
    templates of their copies only, or with its numbers masked without ``exact_fallback``. A line of fewer than ``min_tokens`` tokens
    has too few to tell fields from words and is a template as it stands. A template of ``min_docs`` or more documents
    recurs; every line of it goes but the first by id and place. Lines without a token stay.

    Leaves and tokens go by 64-bit hashes, lines and templates by 128 bits; texts are sent only for the distinct
    lines of leaves that ``min_docs`` documents reach (and of a few others, which the bit filter takes for such and in
    which no template can recur), twice: to tell them apart, and to the task of their leaf. Tokens are sent only for leaves of more
    than LEAF_LINES distinct lines, whose work is dealt over all tasks.
    """
    lines = _lines(docs, depth, min_tokens, id_col, text_col)
    busy = _staged(
        lines.select("leaf", "id").distinct().groupBy("leaf").agg(F.count(F.lit(1)).alias("docs"))
        .where(F.col("docs") >= min_docs).select("leaf"), "leaves",
    )
    own = ("u", "v") if exact_fallback else ("a", "b")
    digests = [("line", "a", "b"), ("clean", "u", "v")][: 1 + exact_fallback]
    inside = _staged(
        likely_among(lines, F.col("leaf"), busy.select(F.col("leaf").alias("key"))).where("likely").withColumn("line", masked(F.col("clean"))).select(
            "id", "pos", "long", "leaf", "line",
            *[x for text, c, d in digests for x in (F.xxhash64(text).alias(c), F.xxhash64(F.lit(1), text).alias(d))],
        ), "lines",
    )
    long, short = inside.where("long"), inside.where("NOT long")
    in_docs = _staged(long.select(*LINE, "id").distinct().groupBy(*LINE).agg(F.count(F.lit(1)).alias("docs")), "in_docs")
    texts = long.groupBy(*LINE).agg(F.first("line").alias("line")).join(in_docs, LINE)
    wide = _staged(in_docs.groupBy("leaf").agg(F.count(F.lit(1)).alias("lines")).where(F.col("lines") > LEAF_LINES).select("leaf"), "wide")
    if wide.isEmpty():
        shapes = _shapes(_placed_within(texts, min_docs), least_constant)
    else:  # at most one leaf for each LEAF_LINES lines
        within, across = texts.join(F.broadcast(wide), "leaf", "left_anti"), texts.join(F.broadcast(wide), "leaf", "left_semi")
        shapes = _shapes(_placed_within(within, min_docs), least_constant).unionByName(_shapes(_placed_across(across, min_docs), least_constant))
    shapes = _staged(shapes, "shapes")
    fallback = [F.when(F.col("general"), F.col(c)).otherwise(F.col(o)).alias(c) for c, o in zip(("p", "q"), own)]
    shaped = long.select("id", "pos", *dict.fromkeys((*LINE, *own))).join(shapes, LINE).select("id", "pos", "leaf", "general", *fallback)
    shaped = shaped.unionByName(short.select(
        "id", "pos", "leaf", F.lit(False).alias("general"), *[F.col(o).alias(c) for c, o in zip(("p", "q"), own)]
    ))
    key = ["leaf", "general", "p", "q"]
    per_doc = shaped.groupBy(*key, "id").agg(F.min("pos").alias("pos"))
    many = per_doc.groupBy(*key).agg(F.count(F.lit(1)).alias("docs"), F.min("id").alias("first_id")).where(F.col("docs") >= min_docs)
    gone = many.join(per_doc.withColumnsRenamed({"id": "first_id", "pos": "first_pos"}), [*key, "first_id"]).select(*key, "first_id", "first_pos")
    return shaped.join(gone, key).where((F.col("id") != F.col("first_id")) | (F.col("pos") != F.col("first_pos"))).select("id", "pos")


def drop_recurring_lines(
    docs: DataFrame, min_docs: int = 5, depth: int = 2, min_tokens: int = 4, least_constant: float = 0.6,
    id_col: str = "doc_id", text_col: str = "text", exact_fallback: bool = True,
) -> DataFrame:
    """All rows, with the lines of recurring templates dropped from the text (see ``recurring_lines``).

    Other columns stay; ``n_lines`` and ``n_dropped`` are added and replace input columns of these names.
    Texts of documents that may have lines to drop cross one shuffle, by id; the others stay where they are.

    Defined results: null text has no lines and stays null; empty text is one empty line; rows with a null id
    stay as they are and count for no template; rows that repeat an id count as one document, and lines
    dropped from one at a place are dropped from all at that place.
    """
    dropped = recurring_lines(docs, min_docs, depth, min_tokens, least_constant, id_col, text_col, exact_fallback)
    per_doc = _staged(dropped.groupBy("id").agg(F.collect_set("pos").alias("gone")), "dropped")
    others = [c for c in docs.columns if c not in (text_col, "n_lines", "n_dropped")]
    rows = docs.select(F.struct(*others).alias("row"), F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    marked = likely_among(rows, F.when(F.col("key").isNotNull(), F.xxhash64("key")), per_doc.select(F.xxhash64("id").alias("key")))
    untouched = marked.where("NOT likely").withColumn("gone", F.lit(None).cast("array<int>"))
    # the lists follow the input, so none is broadcast, small as their files may be
    checked = marked.where("likely").join(per_doc.hint("merge"), F.col("key") == F.col("id"), "left").drop("id")
    joined = untouched.unionByName(checked).withColumn("lines", F.split("text", "\n"))
    inside = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    kept = F.array_join(F.transform(inside, lambda i: F.get(F.col("lines"), i)), "\n")
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias(text_col)
    return joined.select(
        *[text if c == text_col else F.col("row")[c].alias(c) for c in docs.columns if c in others or c == text_col],
        F.coalesce(F.size("lines"), F.lit(0)).alias("n_lines"),
        F.when(F.col("gone").isNull() | F.col("lines").isNull(), F.lit(0)).otherwise(F.size("lines") - F.size(inside)).alias("n_dropped"),
    )
