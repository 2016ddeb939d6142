"""Benchmark decontamination with a generalised suffix automaton over words."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from scoreloom.llm import text as T
from scoreloom.llm.bitfilter import likely_among
from scoreloom.session import new_folder

WINDOW = 10
SLICE_BYTES = 1 << 18  # texts worked on at once; the arrays of a slice take some 50 times as much
WORD_BYTES = np.ones(256, bool)
WORD_BYTES[0x00:0x30] = False
WORD_BYTES[0x3A:0x61] = False
WORD_BYTES[0x7B:0x80] = False

SCAN = "n_words bigint, n_hit bigint, items array<string>, positions array<int>, clean string"


class Automaton:
    """Every run of consecutive words of the items, as states with word transitions.

    ``items`` are (id, list of word hashes). Windows are ``window`` words, or the whole item
    where it has fewer. ``found[length][state]`` names the items of the window of that
    length that ends in the state.
    """

    def __init__(self, items: list[tuple[str | None, list[int]]], window: int = WINDOW):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        items = [(i, w) for i, w in items if w]
        vocabulary = sorted({w for _, words in items for w in words})
        self.vocabulary = np.array(vocabulary, np.uint64)
        number = {w: k for k, w in enumerate(vocabulary)}
        numbered = [(i, [number[w] for w in words]) for i, words in items]
        pairs = set()
        for _, words in numbered:
            last = 0
            for w in words:
                last = self._extend(last, w)
            pairs.update(a * len(vocabulary) + b for a, b in zip(words, words[1:]))
        self.pairs = np.array(sorted(pairs), np.int64)
        lengths = sorted({min(window, len(words)) for _, words in numbered})
        self.shortest = lengths[0] if lengths else 0
        self.anchors = {n: self._anchors(n) for n in lengths}
        self.found: dict[int, dict[int, set]] = {n: {} for n in lengths}
        for item, words in numbered:
            n, state = min(window, len(words)), 0
            for k, w in enumerate(words):
                state = self.next[state][w]
                if k + 1 >= n:
                    self.found[n].setdefault(self.anchors[n][state], set()).add(item)

    def _add(self, length: int, link: int, after: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(after)
        return len(self.length) - 1

    def _split(self, p: int, w: int) -> int:
        """The state for the longest string that p's shorter suffixes share with p's successor by w."""
        q = self.next[p][w]
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._add(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            return self._split(last, w)
        state = self._add(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = state
            p = self.link[p]
        if p >= 0:
            self.link[state] = self._split(p, w)
        return state

    def _anchors(self, n: int) -> list[int]:
        """For each state, the one on its chain of suffixes that holds the string of n words."""
        anchors = [-1] * len(self.length)
        for state in sorted(range(len(self.length)), key=self.length.__getitem__):
            if self.length[state] >= n:
                up = self.link[state]
                anchors[state] = anchors[up] if up >= 0 and self.length[up] >= n else state
        return anchors

    def scan(self, words: list[int]):
        """(first, last, items) of the windows in a stream of word numbers, by matched lengths."""
        state = matched = 0
        for k, w in enumerate(words):
            while state and w not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if w in self.next[state]:
                state = self.next[state][w]
                matched += 1
            for n, found in self.found.items():
                if matched >= n:
                    items = found.get(self.anchors[n][state])
                    if items:
                        yield k + 1 - n, k, items

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Word numbers, -1 for words of no item."""
        if not len(self.vocabulary):
            return np.full(len(hashes), -1, np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at, -1)

    def runs(self, numbers: np.ndarray, row: np.ndarray):
        """(first, end) of the runs of words that can hold a window.

        Each pair of neighbours inside a window occurs in an item, so a shorter run of such
        pairs cannot hold one; the automaton reads only the longer runs.
        """
        if not self.shortest or not len(numbers):
            return []
        inside = np.zeros(len(numbers) + 1, bool)
        if self.shortest == 1:
            inside[1:] = numbers >= 0
            reach = 0
        else:
            both = (numbers[:-1] >= 0) & (numbers[1:] >= 0) & (row[:-1] == row[1:])
            pair = numbers[:-1] * len(self.vocabulary) + numbers[1:]
            at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            inside[1:-1] = both & (self.pairs[at] == pair)
            reach = 1
        edges = np.diff(np.concatenate([inside, [False]]).astype(np.int8))
        firsts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1) + reach
        if self.shortest == 1:  # a run must not cross documents
            cuts = np.flatnonzero(np.diff(row)) + 1
            out = []
            for a, b in zip(firsts, ends):
                inner = cuts[np.searchsorted(cuts, a, "right"): np.searchsorted(cuts, b, "left")]
                borders = [a, *inner, b]
                out += list(zip(borders, borders[1:]))
            return out
        keep = ends - firsts >= self.shortest
        return list(zip(firsts[keep], ends[keep]))


def words_of(texts: pa.Array):
    """For each slice of rows: its bytes, borders, word starts, ends, rows and hashes."""
    for data, borders in T.slices(texts, SLICE_BYTES):
        data = T.LOWER[data]
        starts, ends, row = T.spans(data, borders, WORD_BYTES)
        yield data, borders, starts, ends, row, T.hashes(data, starts, ends)


def _without(text: str, positions: np.ndarray, starts: np.ndarray, ends: np.ndarray, border: int) -> str:
    """The text without the words at the sorted positions; words are spans of the slice, the text starts at ``border``."""
    raw = text.encode()
    breaks = np.flatnonzero(np.diff(positions) > 1)
    opens = starts[positions[np.concatenate([[0], breaks + 1])]] - border
    closes = ends[positions[np.concatenate([breaks, [len(positions) - 1]])]] - border
    return b"".join(raw[x:y] for x, y in zip([0, *closes], [*opens, len(raw)])).decode()


def cut_texts(texts: pa.Array, positions: pa.Array) -> pa.Array:
    """The texts without the words at the positions, sorted word numbers from 0; null or none leave a text as it is."""
    out, at = [], 0
    for _, borders, starts, ends, row, _ in words_of(texts):
        n = len(borders) - 1
        first_word = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))])
        for doc in range(n):
            text, gone = texts[at + doc].as_py(), positions[at + doc].as_py()
            out.append(_without(text, first_word[doc] + np.array(gone), starts, ends, borders[doc]) if gone else text)
        at += n
    return pa.array(out, pa.string())


@F.arrow_udf(ST.StringType())
def _cut(texts: pa.Array, positions: pa.Array) -> pa.Array:
    return cut_texts(texts, positions)


def scan_texts(texts: pa.Array, automaton: Automaton, cut: bool) -> pa.Array:
    """SCAN rows for the texts; ``clean`` is the text without hit words, null where nothing was hit."""
    out, at = [], 0
    for data, borders, starts, ends, row, hashed in words_of(texts):
        n_words = np.bincount(row, minlength=len(borders) - 1)
        first_word = np.concatenate([[0], np.cumsum(n_words)])
        numbers = automaton.numbers(hashed)
        hits: dict[int, tuple[set, set]] = {}
        for a, b in automaton.runs(numbers, row):
            doc = int(row[a])
            for first, last, items in automaton.scan(numbers[a:b].tolist()):
                positions, names = hits.setdefault(doc, (set(), set()))
                positions.update(range(a + first, a + last + 1))
                names.update(items)
        for doc in range(len(borders) - 1):
            if doc not in hits:
                out.append((int(n_words[doc]), 0, [], [], None))
                continue
            positions = np.array(sorted(hits[doc][0]))
            clean = None
            if cut:
                clean = _without(texts[at + doc].as_py(), positions, starts, ends, borders[doc])
            names = sorted(x for x in hits[doc][1] if x is not None)
            out.append((int(n_words[doc]), len(positions), names, (positions - first_word[doc]).tolist(), clean))
        at += len(borders) - 1
    fields = [("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
              ("positions", pa.list_(pa.int32())), ("clean", pa.string())]
    columns = list(zip(*out)) if out else [[]] * len(fields)
    return pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields)], [n for n, _ in fields])


def scanner(items: DataFrame, window: int, item_col: str, text_col: str, shard_words: int, cut: bool):
    """One text-column function per shard of the items.

    A shard holds about ``shard_words`` words at most, so the automaton that is broadcast
    keeps its size when the items grow; more items mean more shards and more scans.
    """
    wanted = items.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    size = wanted.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(1, -(-size // (5 * shard_words)))
    found = []
    for k in range(shards):
        rows = wanted.where(F.pmod(F.xxhash64("text"), F.lit(shards)) == k).toArrow()
        texts, ids, words, at = rows["text"].combine_chunks(), rows["item"].to_pylist(), [], 0
        for _, borders, _, _, row, hashed in words_of(texts):
            n = len(borders) - 1
            cuts = np.searchsorted(row, np.arange(1, n))
            words += [(ids[at + d], part.tolist()) for d, part in enumerate(np.split(hashed, cuts))]
            at += n
        found.append(_scan(items.sparkSession.sparkContext.broadcast(Automaton(words, window)), cut))
    return found


def _scan(automaton, cut: bool):
    @F.arrow_udf(SCAN)
    def scan(column: pa.Array) -> pa.Array:
        return scan_texts(column, automaton.value, cut)

    # else Spark moves filters on its result below it and scans every text twice, in two workers per task
    return scan.asNondeterministic()


def _staged(df: DataFrame, name: str) -> DataFrame:
    folder = new_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def _keyed(docs: DataFrame) -> DataFrame:
    """The rows in a table with a key each, so that all shards see the same rows under the same keys."""
    return _staged(docs.withColumn("key", F.monotonically_increasing_id()), "rows")


def _joined(keyed: DataFrame, scans: list, hits_only: bool) -> DataFrame:
    """(key, n_words, items, positions) over all shards, which scan the original texts (column text)."""
    found = []
    for k, f in enumerate(scans):
        seen = keyed.select("key", f("text").alias("s")).select("key", "s.n_words", "s.n_hit", "s.items", "s.positions")
        # rows without a hit come from the first shard
        found.append(seen.where("n_hit > 0") if hits_only or k else seen)
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.groupBy("key").agg(
        F.first("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("positions")))).alias("positions"),
    )


def contamination(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", shard_words: int = 2_000_000,
) -> DataFrame:
    """Per document the words that lie inside an occurrence of a test window.

    Words are runs of digits, letters and non-ASCII characters after lower-casing A-Z. A generalised
    suffix automaton holds all runs of item words; the words of each text stream through it
    with the longest matching length, and a length of at least ``window`` words (or of a whole
    shorter item) marks a hit.

    Defined results: null and empty texts have no words; an item without words has no window;
    an item with a null id marks words but is not listed; repeated items are listed once;
    repeated documents are judged one by one; no items, no hits. The number of shards does not change the result.
    Returns doc_id (named ``id_col``), n_words, n_hit, n_items, items, positions (word numbers from 0), contaminated.
    """
    scans = scanner(items, window, item_col, item_text_col, shard_words, cut=False)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if len(scans) == 1:
        seen = rows.select("id", scans[0]("text").alias("s")).select("id", "s.n_words", "s.n_hit", "s.items", "s.positions")
    else:
        keyed = _keyed(rows)
        seen = keyed.select("key", "id").join(_joined(keyed, scans, hits_only=False), "key").withColumn(
            "n_hit", F.size("positions").cast("long")
        )
    return seen.select(
        F.col("id").alias(id_col), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        "items", "positions", (F.col("n_hit") > 0).alias("contaminated"),
    )


def items_digest(items: Column) -> Column:
    return F.sha2(F.array_join(items, ","), 256)


def decontaminate(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, most_covered: float = 0.5, text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", shard_words: int = 2_000_000,
) -> DataFrame:
    """Documents without test passages, all columns kept.

    Spans of hit words (see ``contamination``) are cut out of the text; a document of which
    more than ``most_covered`` of the words is hit goes whole. Other rows stay as they
    are, null and empty texts included. With several shards every shard scans the original texts; their hits are
    joined per row before the limit and one cut. The rows are then written once, and only those with hits are shuffled.
    """
    scans = scanner(items, window, item_col, item_text_col, shard_words, cut=True)
    row = F.struct(*[F.col(c) for c in docs.columns]).alias("row")
    if len(scans) == 1:
        seen = docs.select(row, scans[0](F.col(text_col)).alias("scan"))
        seen = seen.where(F.col("scan.n_hit") <= F.col("scan.n_words") * most_covered)
        clean = F.coalesce("scan.clean", F.col("row")[text_col])
    else:
        keyed = _keyed(docs.select(row))
        hits = _staged(_joined(keyed.select("key", F.col("row")[text_col].alias("text")), scans, hits_only=True).drop("items"), "hits")
        marked = likely_among(keyed, F.xxhash64("key"), hits.select(F.xxhash64("key").alias("key")))
        checked = marked.where("likely").join(hits, "key", "left")
        checked = checked.where(F.col("positions").isNull() | (F.size("positions") <= F.col("n_words") * most_covered))
        untouched = marked.where("NOT likely").select("row", F.col("row")[text_col].alias("clean"))
        seen = untouched.unionByName(checked.select("row", _cut(F.col("row")[text_col], F.col("positions")).alias("clean")))
        clean = F.col("clean")
    return seen.select(*[clean.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])
