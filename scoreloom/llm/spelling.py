"""Groups of spelling variants: words at one edit, found in k-d trees over letter counts."""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.session import new_folder

LETTERS = r"A-Za-zÀ-ÿ"
LEAST_LENGTH, LEAST_COUNT, MOST_TIMES = 7, 2, 10
SAMPLE_WORDS = 200_000  # words from which cells are fitted; every word is placed and searched
CELL_WORDS = 8_000
LEAF_WORDS = 24
BLOCK = 4_000_000  # bytes compared at a time
TOP = {"length": pa.int32(), "cell": pa.int32(), "part": pa.int32(), "word": pa.string(), "n": pa.int64(), "asks": pa.bool_()}
TOP_SCHEMA = "length int, cell int, part int, word string, n long, asks boolean"
NEAR_SCHEMA = "word string, n long, n_near long, best_n long, best string"

# letters as places of a count vector: a to z, then U+00C0 to U+00FF; capitals A to Z do not occur
_PLACE = np.zeros(256, np.uint8)
_PLACE[97:123] = np.arange(26)
_PLACE[192:256] = np.arange(26, 90)
DIMS = 90


def letters_of(words: pa.Array, length: int) -> np.ndarray:
    """The letters of words of one length: a row per word, a byte (the place of the letter) per code point."""
    return _PLACE[np.frombuffer("".join(words.to_pylist()).encode("latin-1"), np.uint8).reshape(-1, length)]


def counts_of(letters: np.ndarray) -> np.ndarray:
    """Letter-count vectors of rows of letters."""
    rows, length = letters.shape
    flat = (np.arange(rows, dtype=np.int64)[:, None] * DIMS + letters).ravel()
    return np.bincount(flat, minlength=rows * DIMS).reshape(rows, DIMS).astype(np.int16 if length < 32_000 else np.int32)


def _halved(counts: np.ndarray, rows: np.ndarray):
    """The split of rows nearest to half and half along the letter of largest spread; None if all vectors are equal."""
    own = counts[rows]
    wide = int(np.argmax(own.var(axis=0)))
    column = own[:, wide]
    values, times = np.unique(column, return_counts=True)
    if len(values) == 1:
        return None
    below = np.cumsum(times)[:-1]
    at = values[int(np.argmin(np.abs(below - len(rows) / 2)))]
    left = column <= at
    return wide, int(at), rows[left], rows[~left]


# --- cells: a k-d tree per length, fitted on a sample ------------------------------------------


@dataclass
class Cells:
    """A k-d tree: per node its letter and threshold and its two children, or the cell and its parts."""

    letter: list
    at: list
    children: list
    cell: list
    parts: list


def fit_cells(counts: np.ndarray, least: int, share: float, most: int) -> Cells:
    """Split until a cell holds about ``most`` words of which ``share`` is sampled, but at least ``least`` sampled ones.

    A cell that cannot be split, since its words have the same letters, is dealt over parts instead.
    """
    tree = Cells([], [], [], [], [])

    def grow(rows: np.ndarray) -> int:
        node = len(tree.cell)
        for column, value in ((tree.letter, -1), (tree.at, 0), (tree.children, (0, 0)), (tree.cell, -1), (tree.parts, 1)):
            column.append(value)
        full = len(rows) > max(least, most * share)
        split = _halved(counts, rows) if full else None
        if split:
            tree.letter[node], tree.at[node], left, right = split
            tree.children[node] = (grow(left), grow(right))
        else:
            tree.cell[node] = node
            tree.parts[node] = int(-(-len(rows) // max(least, most * share))) if full else 1
        return node

    grow(np.arange(len(counts)))
    return tree


ONE_CELL = Cells([-1], [0], [(0, 0)], [0], [1])


def cells_of(tree: Cells, counts: np.ndarray, up: int, down: int) -> Iterator[tuple[int, np.ndarray]]:
    """(node of a cell, rows) for every cell that may hold a vector with at most ``up`` letters more and ``down`` fewer.

    With both 0 each row has the one cell that it lies in. A step across a border uses up what the letter count is away from it.
    """
    rows = np.arange(len(counts))
    zero = np.zeros(len(rows), np.int64)
    # the largest number of letters that the box of the node lies above or below the row, per letter seen so far
    stack = [(0, rows, zero, zero, {})]
    while stack:
        node, rows, more, fewer, seen = stack.pop()
        if not len(rows):
            continue
        if tree.letter[node] < 0:
            yield node, rows
            continue
        letter, at = tree.letter[node], tree.at[node]
        column = counts[rows, letter].astype(np.int64)
        over, under = seen.get(letter, (np.zeros(len(rows), np.int64),) * 2)
        for child, over_new, under_new in (
            (tree.children[node][0], over, np.maximum(under, column - at)),
            (tree.children[node][1], np.maximum(over, at + 1 - column), under),
        ):
            more_new, fewer_new = more + over_new - over, fewer + under_new - under
            kept = (more_new <= up) & (fewer_new <= down)
            known = {k: (a[kept], b[kept]) for k, (a, b) in {**seen, letter: (over_new, under_new)}.items()}
            stack.append((child, rows[kept], more_new[kept], fewer_new[kept], known))


def _routes(batch: pa.RecordBatch, trees: dict[int, Cells], least: int) -> Iterator[pa.RecordBatch]:
    """Words to the cell they lie in, and as questions to the cells that may hold a neighbour.

    A word asks among the words of its length for one replaced letter and among those one shorter for one
    letter left out; insertions are the same pairs from the other side.
    """
    words, n = batch.column("word"), batch.column("n")
    lengths = batch.column("length").to_numpy()
    spread = batch.column("spread").to_numpy()
    for length in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == length)
        some, times = words.take(pa.array(rows)), n.take(pa.array(rows))
        counts = counts_of(letters_of(some, length))
        for asks, target, up, down in ((False, length, 0, 0), (True, length, 1, 1), (True, length - 1, 0, 1)):
            if target < least:
                continue
            tree = trees.get(target, ONE_CELL)
            for node, at in cells_of(tree, counts, up, down):
                parts = tree.parts[node]
                own = [spread[rows[at]] % parts] if not asks else [np.full(len(at), k) for k in range(parts)]
                index = pa.array(at)
                for part in own:
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(at), target), pa.int32()), pa.array(np.full(len(at), node), pa.int32()),
                        pa.array(part, pa.int32()), some.take(index), times.take(index), pa.array(np.full(len(at), asks)),
                    ], list(TOP))


# --- the search inside a cell ---------------------------------------------------------------


def _one_replaced(asked: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (asked, held) that differ at exactly one place, found from the side of the larger letter."""
    differ = asked[:, None, :] != held[None, :, :]
    i, j = np.nonzero(differ.sum(axis=2, dtype=np.int32) == 1)
    place = differ[i, j].argmax(axis=1)
    larger = asked[i, place] > held[j, place]
    return i[larger], j[larger]


def _one_left_out(asked: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (asked, held) where held is asked without one letter: the equal start and the equal end cover it."""
    length = held.shape[1]
    front = np.ones((len(asked), len(held), length + 1), bool)
    front[:, :, :length] = asked[:, None, :-1] != held[None, :, :]
    back = np.ones((len(asked), len(held), length + 1), bool)
    back[:, :, :length] = (asked[:, None, 1:] != held[None, :, :])[:, :, ::-1]
    return np.nonzero(front.argmax(axis=2) + back.argmax(axis=2) >= length)


def near_in_cell(held: np.ndarray, asked: np.ndarray, leaf: int = LEAF_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Rows (asked, held) of all pairs at one edit; asked words are as long as the held ones, or one longer.

    The held words form a k-d tree of tight boxes. Going down it, a question is dropped where the box needs more letters
    changed than one edit changes: one more and one fewer, or one fewer. What reaches a leaf is compared letter by letter.
    """
    longer = asked.shape[1] - held.shape[1]
    up, down = (0, 1) if longer else (1, 1)
    match = _one_left_out if longer else _one_replaced
    counts, questions = counts_of(held), counts_of(asked)
    used = counts.any(axis=0) | questions.any(axis=0)
    counts, questions = counts[:, used], questions[:, used]
    found = [], []
    stack = [(np.arange(len(held)), np.arange(len(asked)))]
    while stack:
        rows, open_ = stack.pop()
        if not len(open_) or not len(rows):
            continue
        low, high = counts[rows].min(axis=0), counts[rows].max(axis=0)
        here = questions[open_]
        near = (np.maximum(low - here, 0).sum(axis=1) <= up) & (np.maximum(here - high, 0).sum(axis=1) <= down)
        open_ = open_[near]
        split = _halved(counts, rows) if len(rows) > leaf and len(open_) else None
        if split:
            stack += [(split[2], open_), (split[3], open_)]
            continue
        # words of equal letters cannot be split: any number of them is compared block by block
        wide = max(1, BLOCK // (held.shape[1] + 1) // leaf)
        for r in range(0, len(rows), leaf):
            for q in range(0, len(open_), wide):
                i, j = match(asked[open_[q: q + wide]], held[rows[r: r + leaf]])
                found[0].append(open_[q + i])
                found[1].append(rows[r + j])
    return tuple(np.concatenate(f) if f else np.zeros(0, np.int64) for f in found)


def _summed(words: pa.Array, n: np.ndarray, me: np.ndarray, other: np.ndarray, names: pa.Array, times: np.ndarray):
    """Per word of ``me``: its pairs, and the other word of most occurrences (ties: smallest) with them."""
    rank = np.empty(len(names), np.int64)
    rank[pc.sort_indices(names).to_numpy()] = np.arange(len(names))
    order = np.lexsort((rank[other], -times[other], me))
    me, other = me[order], other[order]
    first = np.flatnonzero(np.r_[True, me[1:] != me[:-1]]) if len(me) else np.zeros(0, np.int64)
    size = np.diff(np.r_[first, len(me)])
    who = pa.array(me[first])
    best = pa.array(other[first])
    return [words.take(who), pa.array(n[me[first]]), pa.array(size), pa.array(times[other[first]]), names.take(best)]


def _near_of_cell(table: pa.Table) -> pa.Table:
    """What one cell knows: a row for every word it holds, and one for every question that found a neighbour."""
    length = table.column("length")[0].as_py()
    table = table.combine_chunks()
    asks = table.column("asks").combine_chunks()
    words = table.column("word").combine_chunks()
    sizes = pc.utf8_length(words)
    held = table.filter(pc.invert(asks))
    names = held.column("word").combine_chunks()
    times = held.column("n").combine_chunks().to_numpy()
    empty = pa.array([None] * len(names), pa.string())
    nothing = np.zeros(len(names), np.int64)
    out = [[names, pa.array(times), pa.array(nothing), pa.array(nothing), empty]]
    if len(names):
        letters = letters_of(names, length)
        for asked_length in (length, length + 1):
            some = table.filter(pc.and_(asks, pc.equal(sizes, asked_length)))
            if not some.num_rows:
                continue
            asked = some.column("word").combine_chunks()
            n = some.column("n").combine_chunks().to_numpy()
            i, j = near_in_cell(letters, letters_of(asked, asked_length))
            out.append(_summed(asked, n, i, j, names, times))
            out.append(_summed(names, times, j, i, asked, n))
    schema = pa.schema([("word", pa.string()), ("n", pa.int64()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])
    return pa.concat_tables([pa.Table.from_arrays([a.cast(f.type) for a, f in zip(columns, schema)], schema=schema) for columns in out])


# --- the operator ---------------------------------------------------------------------------------


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slips: int = 31, least: int = LEAST_LENGTH, count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): maximal runs of letters in lower case (A to Z only), of at least ``least`` letters and ``count`` occurrences.

    Where ``slips`` divides h, the CRC-32 of ``<id>:<run>``, the letter h % length is left out, as a slip of the pen (0: never).
    Runs shorter than ``least`` cannot become a word, so they are not cut out. Null ids count as the text ``null``.
    """
    runs = F.regexp_extract_all(F.col(text_col), F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))
    lowered = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("id"), F.explode(runs).alias("run")).select(
        "id", F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("run")
    )
    word = F.col("run")
    if slips:
        lowered = lowered.withColumn("h", F.crc32(F.encode(F.concat("id", F.lit(":"), "run"), "UTF-8")))
        at = (F.col("h") % F.length("run")).cast("int")
        cut = F.concat(F.substring("run", F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
        word = F.when(F.col("h") % slips == 0, cut).otherwise(word)
    words = lowered.select(word.alias("word")).where(F.length("word") >= least)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= count)


def near_words(words: DataFrame, sample_words: int = SAMPLE_WORDS, cell_words: int = CELL_WORDS, least: int = LEAST_LENGTH) -> DataFrame:
    """(word, n, n_near, best_n, best) for rows (word, n) of distinct words of letters a to z and U+00C0 to U+00FF.

    n_near words differ by exactly one inserted, deleted or replaced code point; best is the one of most occurrences
    best_n, of ties the smallest. ``words`` is read twice. The cells of the k-d trees follow from a sample of bounded size, one tree per
    length; all words are placed and searched. Each pair is found in one cell from one side, and a cell sends
    sums, so no pair is written.
    """
    spark = words.sparkSession
    keyed = words.withColumn("length", F.length("word")).withColumn("spread", F.xxhash64("word").bitwiseAND(F.lit((1 << 30) - 1)))
    total = words.count()
    share = min(1.0, sample_words / max(total, 1))
    drawn = keyed.where(F.pmod(F.xxhash64("word", F.lit(7)), F.lit(1 << 20)) < int(share * (1 << 20))).select("word", "length").toArrow()
    lengths = drawn.column("length").to_numpy()
    trees = {}
    for length in np.unique(lengths).tolist():
        some = drawn.column("word").filter(pa.array(lengths == length)).combine_chunks()
        trees[length] = fit_cells(counts_of(letters_of(some, length)), 16, share, cell_words)
    held = spark.sparkContext.broadcast(trees)  # at most an entry per 8 sampled words

    def route(batches):
        for batch in batches:
            yield from _routes(batch, held.value, least)

    routed = keyed.mapInArrow(route, TOP_SCHEMA)
    parts = routed.groupBy("length", "cell", "part").applyInArrow(_near_of_cell, NEAR_SCHEMA)
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("k"), F.col("best").alias("w"))))
    return parts.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("b")).select(
        "word", "n", "n_near", (-F.col("b.k")).alias("best_n"), F.col("b.w").alias("best")
    )


def last_forms(links: DataFrame) -> DataFrame:
    """(word, root) for links (word, form): the end of the chain of forms.

    Chains double their reach every round; since a form is ten times as frequent as its word, a few rounds do.
    """
    spark, folder = links.sparkSession, new_folder(links.sparkSession, "forms")
    reach = links.select("word", F.col("form").alias("root"))
    step = 0
    while True:
        ahead = reach.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = reach.join(ahead, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        path = f"{folder}/{step}"
        moved.write.parquet(path)
        moved = spark.read.schema(moved.schema).parquet(path)
        reach = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return reach
        step += 1


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", times: int = MOST_TIMES, **options) -> DataFrame:
    """Words of the documents with the form that each is a variant of.

    A word's form is its near word (see ``near_words``) of most occurrences, if those are at least ``times`` its own;
    root is the end of the chain of forms, the word itself if it has none.

    Defined results: null and empty texts have no words; a text of any length is read whole; repeated rows count
    each; ties between forms go to the smallest word in code-point order; an empty table, or one without words, gives no rows; other input columns
    are ignored.
    Returns word, form, root, n, n_near, form_n.
    """
    spark, folder = docs.sparkSession, new_folder(docs.sparkSession, "spelling")
    counted = word_counts(docs, id_col, text_col)
    counted.write.parquet(f"{folder}/words")
    words = spark.read.schema(counted.schema).parquet(f"{folder}/words")
    found = near_words(words, **options)
    found.write.parquet(f"{folder}/near")
    near = spark.read.schema(found.schema).parquet(f"{folder}/near")
    is_form = F.col("best_n") >= F.col("n") * times
    near = near.select(
        "word", "n", "n_near", F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n"))
    roots = last_forms(near.where("form IS NOT NULL"))
    return near.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
