"""N-gram Jaccard join: rare-first prefix filtering, then exact verification inside hub groups."""

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from scoreloom.llm import text as T
from scoreloom.llm.bitfilter import likely_among
from scoreloom.llm.components import component_labels
from scoreloom.session import new_folder

WORDS = 5
NUMERATOR, DENOMINATOR = 75, 100  # a link: DENOMINATOR * shared >= NUMERATOR * union
SKETCH_BITS = 22
SLICE_BYTES = 1 << 18  # texts worked on at once; the arrays of a slice take 30 to 55 times as much
CHUNK_TOKENS = 400_000  # prefix shingles that a task holds before it sends them, at some 100 bytes while they are sorted
BUCKET_TOKENS = 12_000_000  # shingles of the corpus per bucket; about a third are in prefixes, at 12 bytes
SEEN = 500_000
STRAGGLERS, MEMBERS = 1000, 2000  # rows of one verification task
RANGES = 16
_WEIGHTS = T.mixed(np.arange(1, WORDS + 1, dtype=np.uint64)) | np.uint64(1)
KEY = ST.StructType([ST.StructField(name, ST.LongType()) for name in ("n", "h1", "h2")])
NOT_BLANK = (~T.BLANKS).astype(np.uint8)


def shingles(texts: pa.Array):
    """For each slice of rows: number of rows, row and hash of the distinct shingles, sorted by both."""
    for data, borders in T.slices(texts, SLICE_BYTES):
        data = T.LOWER[data]
        starts, ends, row = T.spans(data, borders, NOT_BLANK)
        word = T.hashes(data, starts, ends)
        n = len(borders) - 1
        size = np.bincount(row, minlength=n)
        first = np.cumsum(size) - size
        rows, values = [], []
        if len(word) >= WORDS:
            whole = np.flatnonzero(row[: len(row) - WORDS + 1] == row[WORDS - 1:])
            total = np.zeros(len(whole), np.uint64)
            for k in range(WORDS):
                total += word[whole + k] * _WEIGHTS[k]
            rows.append(row[whole])
            values.append(T.mixed(total))
        for k in range(1, WORDS):  # shorter texts are one shingle
            short = np.flatnonzero(size == k)
            total = np.full(len(short), k, np.uint64)
            for j in range(k):
                total += word[first[short] + j] * _WEIGHTS[j]
            rows.append(short)
            values.append(T.mixed(total))
        rows, values = np.concatenate(rows), np.concatenate(values)
        order = np.lexsort((values, rows))
        rows, values = rows[order], values[order]
        fresh = np.ones(len(rows), bool)
        fresh[1:] = (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])
        yield n, rows[fresh], values[fresh]


def _keys(n: int, rows: np.ndarray, values: np.ndarray):
    """Set size and a 128-bit key of the set of every row."""
    size = np.bincount(rows, minlength=n)
    key = np.zeros((2, n), np.uint64)
    if len(rows):
        first = np.flatnonzero(np.diff(rows, prepend=-1))
        for k in range(2):
            key[k, rows[first]] = np.add.reduceat(T.mixed(values + np.uint64(0x5851F42D4C957F2D * (k + 1) % (1 << 64))), first)
    return size, key[0].view(np.int64), key[1].view(np.int64)


@F.arrow_udf(KEY)
def set_key(texts: pa.Array) -> pa.Array:
    parts = [_keys(*s) for s in shingles(texts)]
    n, h1, h2 = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in range(3))
    return pa.StructArray.from_arrays([pa.array(n), pa.array(h1), pa.array(h2)], ["n", "h1", "h2"])


def least_overlap(size):
    """Fewest shared shingles with which a set of this size can link at all."""
    return -(-size * NUMERATOR // DENOMINATOR)


def _extra(size):
    """Shared prefix shingles asked for: the prefix is longer by as many, less one."""
    return np.maximum(size // 10, 1)


# --- document frequencies in a sketch of fixed size ---------------------------------------------

def _sketch(batches, bits: int, hashed):
    """Partial counts of hashes in 2 ** bits cells: bytes that stop at 255, one row per used block."""
    cells = np.zeros(1 << bits, np.uint8)
    for batch in batches:
        for values in hashed(batch):
            at, count = np.unique((values >> np.uint64(64 - bits)).astype(np.int64), return_counts=True)
            cells[at] = np.minimum(cells[at].astype(np.int64) + count, 255)
    blocks = cells.reshape(-1, 1 << 12)
    used = np.flatnonzero(blocks.any(1))
    yield pa.RecordBatch.from_arrays(
        [pa.array(used, pa.int32()), pa.array([blocks[k].tobytes() for k in used], pa.binary())], ["block", "cells"]
    )


def _summed(table: pa.Table, kind) -> np.ndarray:
    return sum(np.frombuffer(x, kind).astype(np.int64) for x in table["cells"].to_pylist())


def _add_tasks(table: pa.Table) -> pa.Table:
    total = np.minimum(_summed(table, np.uint8), 2**31 - 1).astype(np.int32)
    return pa.table({"block": table["block"][:1], "cells": pa.array([total.tobytes()], pa.binary())})


def _add_groups(table: pa.Table) -> pa.Table:
    # four steps to a doubling are enough for an order
    level = np.minimum(4 * np.log2(_summed(table, np.int32) + 1), 255).astype(np.uint8)
    return pa.table({"block": table["block"][:1], "cells": pa.array([level.tobytes()], pa.binary())})


def sketch(rows: DataFrame, hashed, bits: int = SKETCH_BITS) -> np.ndarray:
    """Levels (4 log2 of the count plus 1) of the hashes that ``hashed`` finds in each batch.

    Tasks add up in two steps; the result has 2 ** bits bytes for every input.
    """
    parts = rows.mapInArrow(lambda batches: _sketch(batches, bits, hashed), "block int, cells binary")
    some = parts.withColumn("lane", F.pmod(F.spark_partition_id(), F.lit(64)))
    whole = (
        some.groupBy("block", "lane").applyInArrow(_add_tasks, "block int, cells binary")
        .groupBy("block").applyInArrow(_add_groups, "block int, cells binary")
    )
    cells = np.zeros((1 << (bits - 12), 1 << 12), np.uint8)
    for r in whole.collect():  # 2 ** bits bytes
        cells[r.block] = np.frombuffer(bytes(r.cells), np.uint8)
    return cells.ravel()


def _text_hashes(batch):
    return (values for _, _, values in shingles(batch.column(0)))


def _id_hashes(batch):
    yield T.mixed(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))


def _rare_first(rows: np.ndarray, values: np.ndarray, levels: np.ndarray) -> np.ndarray:
    level = levels[(values >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
    return np.lexsort((values, level, rows))


# --- which sets have enough repeated shingles in their prefix -------------------------------------

PACKED = "kind int, bucket int, keys binary, values binary"
PAIRS, COUNTS = 0, 1


def _blocks(kind: int, hashed: np.ndarray, keys: np.ndarray, values: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Pairs of numbers as one packed row per bucket of ``hashed``."""
    bucket = ((hashed.view(np.uint64) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    keys, values, used = keys[order], values[order], np.flatnonzero(np.diff(edges))
    parts = [[x[edges[b]: edges[b + 1]].tobytes() for b in used] for x in (keys, values)]
    return pa.RecordBatch.from_arrays(
        [pa.array([kind] * len(used), pa.int32()), pa.array(used, pa.int32()), *(pa.array(x, pa.binary()) for x in parts)],
        ["kind", "bucket", "keys", "values"],
    )


def _unpacked(table: pa.Table, key_kind, value_kind) -> list[np.ndarray]:
    return [
        np.concatenate([np.frombuffer(x, kind) for x in table[c].to_pylist()])
        for c, kind in (("keys", key_kind), ("values", value_kind))
    ]


def _prefix_blocks(batches, levels, buckets: int):
    """(shingle, set) of the prefixes of the task's distinct sets, packed by bucket of shingles.

    Shingles go with 32 bits of their hash beside the bucket and sets with 64 bits of their key, 0 for
    "several": chance meetings only let a set pass that could go. A shingle that several sets of a
    chunk hold is sent once and counted for them here, so a frequent one costs one pair per chunk. After
    SEEN sets a task forgets them, and a copy of an earlier one is sent again, which has the same effect.
    """
    levels, seen, held, tokens = levels.value, set(), [], 0

    def flush():
        sets, values = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(values, kind="stable")
        sets, values = sets[order], values[order]
        first = np.flatnonzero(np.diff(values, prepend=~values[:1]) != 0)
        times = np.diff(np.append(first, len(values)))
        known, count = np.unique(sets[np.repeat(times > 1, times)], return_counts=True)
        values, sets = values[first], np.where(times > 1, 0, sets[first])
        return [_blocks(PAIRS, values, values.astype(np.uint32), sets, buckets),
                _blocks(COUNTS, known, known, count.astype(np.int32), buckets)]

    for batch in batches:
        for n, rows, values in shingles(batch.column(0)):
            size, h1, h2 = _keys(n, rows, values)
            fresh = np.zeros(n, bool)
            for d in np.flatnonzero(size):
                key = (h1[d], h2[d])
                if key not in seen:
                    seen.add(key)
                    fresh[d] = True
            order = _rare_first(rows, values, levels)
            rows, values = rows[order], values[order]
            place = np.arange(len(rows)) - np.repeat(np.cumsum(size) - size, size)
            reach = size - least_overlap(size) + _extra(size)
            chosen = fresh[rows] & (place < reach[rows])
            held.append((h1[rows[chosen]], values[chosen]))
            tokens += int(chosen.sum())
            if tokens >= CHUNK_TOKENS:
                yield from flush()
                held, tokens = [], 0
                if len(seen) > SEEN:
                    seen.clear()
    if tokens:
        yield from flush()


def _shared_in(buckets: int):
    """Of one bucket of shingles: how many of them each set shares with other sets; counts pass through."""

    def shared_counts(table: pa.Table) -> pa.Table:
        pairs = table.filter(pa.compute.equal(table["kind"], PAIRS))
        known, count = _unpacked(table.filter(pa.compute.equal(table["kind"], COUNTS)), np.int64, np.int32) if len(pairs) < len(table) else [
            np.zeros(0, np.int64), np.zeros(0, np.int32)]
        if len(pairs):
            shingle, sets = _unpacked(pairs, np.uint32, np.int64)
            order = np.lexsort((sets, shingle))
            shingle, sets = shingle[order], sets[order]
            opens = np.diff(shingle, prepend=~shingle[:1]) != 0
            other = np.zeros(len(sets), bool)  # copies of a set in several tasks are one set
            other[1:] = ~opens[1:] & (sets[1:] != sets[:-1])
            first = np.flatnonzero(opens)
            several = np.add.reduceat((other | (opens & (sets == 0))).astype(np.int64), first) > 0
            shared = np.repeat(several, np.diff(np.append(first, len(sets))))
            used, times = np.unique(sets[shared & (opens | other) & (sets != 0)], return_counts=True)
            known, count = np.concatenate([known, used]), np.concatenate([count, times.astype(np.int32)])
        return pa.Table.from_batches([_blocks(COUNTS, known, known, count, buckets)])

    return shared_counts


def _summed_counts(table: pa.Table) -> pa.Table:
    sets, count = _unpacked(table, np.int64, np.int32)
    sets, at = np.unique(sets, return_inverse=True)
    return pa.table({"h1": pa.array(sets), "shared": pa.array(np.bincount(at, count, len(sets)).astype(np.int64))})


# --- sets and verification -----------------------------------------------------------------------

def _set_rows(batches, levels, wanted):
    """(id, n, tokens in rare-first order) of the rows whose id hash is in the filter."""
    levels, wanted = levels.value, wanted.value
    for batch in batches:
        cell = (next(_id_hashes(batch.select(["draw"]))) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)
        batch = batch.filter(pa.array(wanted[cell] > 0))
        at = 0
        for n, rows, values in shingles(batch["text"]):
            values = values[_rare_first(rows, values, levels)]
            size = np.bincount(rows, minlength=n)
            parts = [x.tobytes() for x in np.split(values, np.cumsum(size)[:-1])]
            yield pa.RecordBatch.from_arrays(
                [batch["id"].slice(at, n), pa.array(size.astype(np.int64)), pa.array(parts, pa.binary())], ["id", "n", "tokens"]
            )
            at += n


@F.arrow_udf(ST.ArrayType(ST.LongType()))
def prefix_tokens(tokens: pa.Array) -> pa.Array:
    out = []
    for x in tokens.to_pylist():
        x = np.frombuffer(x, np.int64)
        out.append(x[: len(x) - least_overlap(len(x)) + 1])
    return pa.array(out, pa.list_(pa.int64()))


def _may_link(nx, ny, shared):
    return DENOMINATOR * shared >= NUMERATOR * (nx + ny - shared)


@F.arrow_udf(ST.BooleanType())
def linked(left: pa.Array, right: pa.Array) -> pa.Array:
    """Exact test of two token sets."""
    out = []
    for a, b in zip(left.to_pylist(), right.to_pylist()):
        a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
        ok = _may_link(len(a), len(b), min(len(a), len(b)))  # length filter
        out.append(bool(ok and _may_link(len(a), len(b), len(np.intersect1d(a, b, assume_unique=True)))))
    return pa.array(out, pa.bool_())


def _verified(table: pa.Table) -> pa.Table:
    """Links between the stragglers and the members of one task, as a spanning forest.

    Pairs pass the length filter, the positional filter (shared prefix tokens and the rest beyond
    the prefix) and the suffix filter (tokens per range of hashes) before the shared tokens are
    counted, as products of 0/1 matrices. A pair that also meets at a lower hub is left to that group, and
    two stragglers are compared in one of their two tasks, so a pair is verified once.
    """
    ids, group = table["id"], np.array(table["straggler"].to_pylist(), bool)
    alone = np.array(table["alone"].to_pylist(), bool)
    turn = np.empty(len(ids), np.int64)
    turn[pa.compute.sort_indices(ids).to_numpy()] = np.arange(len(ids))
    sets = [np.frombuffer(x, np.uint64) for x in table["tokens"].to_pylist()]
    size = np.array([len(s) for s in sets])
    token, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), size)
    place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    x, y = np.flatnonzero(group), np.flatnonzero(np.array(table["member"].to_pylist(), bool))
    nx, ny = size[x][:, None], size[y][None, :]
    ok = _may_link(nx, ny, np.minimum(nx, ny)) & (x[:, None] != y[None, :])
    ok &= ~alone[y][None, :] | (turn[x][:, None] < turn[y][None, :])
    lower = table["lower"].to_pylist()
    hub, at_hub = np.unique(np.array([h for each in lower for h in each], np.int64), return_inverse=True)
    if len(hub):
        ok &= _products(np.repeat(np.arange(len(sets)), [len(each) for each in lower]), at_hub, x, y, len(sets)) == 0
    in_range = np.zeros((len(sets), RANGES), np.int32)
    np.add.at(in_range, (row, (token[column] >> np.uint64(60)).astype(np.int64)), 1)
    most = sum(np.minimum(in_range[x, k][:, None], in_range[y, k][None, :]) for k in range(RANGES))
    ok &= _may_link(nx, ny, most)
    reach = size - least_overlap(size) + 1
    early = place < reach[row]
    if ok.any():
        head = _products(row[early], column[early], x, y, len(sets))
        # in the common order, a shared token lies in both prefixes or beyond the one that ends first
        rest = np.maximum((size - reach)[x][:, None], (size - reach)[y][None, :])
        ok &= (head > 0) & _may_link(nx, ny, np.minimum(head + rest, np.minimum(nx, ny)))
    edges = []
    if ok.any():
        a, b = np.nonzero(ok & _may_link(nx, ny, _products(row, column, x, y, len(sets))))
        parent = list(range(len(sets)))

        def root(k):
            while parent[k] != k:
                parent[k] = parent[parent[k]]
                k = parent[k]
            return k

        for p, q in zip(x[a].tolist(), y[b].tolist()):
            rp, rq = root(p), root(q)
            if rp != rq:
                parent[rp] = rq
                edges.append((p, q))
    return pa.table({"a": ids.take(pa.array([e[0] for e in edges], pa.int64())),
                     "b": ids.take(pa.array([e[1] for e in edges], pa.int64()))})


def _products(row, column, x, y, n, width: int = 4096) -> np.ndarray:
    """Shared columns of each row of x with each row of y."""
    at_x, at_y = np.full(n, -1), np.full(n, -1)
    at_x[x], at_y[y] = np.arange(len(x)), np.arange(len(y))
    in_x, in_y = at_x[row] >= 0, at_y[row] >= 0
    both = np.intersect1d(column[in_x], column[in_y])
    shared = np.zeros((len(x), len(y)), np.float32)
    for first in range(0, len(both), width):
        part = both[first: first + width]
        sides = []
        for at, inside, m in ((at_x, in_x, len(x)), (at_y, in_y, len(y))):
            k = np.minimum(np.searchsorted(part, column), len(part) - 1)
            hit = inside & (part[k] == column)
            side = np.zeros((m, len(part)), np.float32)
            side[at[row[hit]], k[hit]] = 1
            sides.append(side)
        shared += sides[0] @ sides[1].T
    return shared.astype(np.int64)


def _staged(df: DataFrame, name: str) -> DataFrame:
    folder = new_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(sets, edges): every row's set key, and links that connect the classes of equal sets.

    sets has id, n, h1, h2 (a 128-bit key of the set) and first, the smallest id with
    that set. edges (a, b) joins such first ids: each edge is a verified link, and two
    classes that link are always connected by edges.
    """
    spark = docs.sparkSession
    context = spark.sparkContext
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    texts = rows.where(F.col("text").isNotNull())
    sets = _staged(rows.select("id", set_key("text").alias("k")).select("id", "k.n", "k.h1", "k.h2"), "sets")
    classes = sets.where("n > 0").groupBy("h1", "h2").agg(F.min("id").alias("id"), F.first("n").alias("n"))
    # a task holds one bucket at a time as a table, so their number follows the input
    total = classes.agg(F.sum("n")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_TOKENS))
    levels = context.broadcast(sketch(texts.select("text"), _text_hashes))

    blocks = texts.select("text").mapInArrow(lambda it: _prefix_blocks(it, levels, buckets), PACKED)
    shared = blocks.groupBy("bucket").applyInArrow(_shared_in(buckets), PACKED).groupBy("bucket").applyInArrow(
        _summed_counts, "h1 bigint, shared bigint"
    )
    able = classes.join(shared, "h1").where(F.col("shared") >= F.greatest(F.floor(F.col("n") / 10), F.lit(1)))
    survivors = _staged(
        able.select(
            "id", F.xxhash64("id").alias("draw"),
            # first the sets of which the largest part is shared: they link to most others
            (F.floor(F.least(F.col("shared") / F.col("n"), F.lit(1.0)) * 0x7FFF) * (1 << 47)
             + F.shiftrightunsigned(F.xxhash64("id"), 17)).alias("rank"),
        ), "survivors",
    )
    wanted = context.broadcast(sketch(survivors.select("draw"), _id_hashes))
    kind = rows.schema["id"].dataType.simpleString()
    found = texts.select("id", F.xxhash64("id").alias("draw"), "text").mapInArrow(
        lambda it: _set_rows(it, levels, wanted), f"id {kind}, n bigint, tokens binary"
    )
    tokens = _staged(found.join(survivors.select("id", "rank"), "id").dropDuplicates(["id"]), "tokens")

    prefixes = tokens.select("id", "rank", F.explode(prefix_tokens("tokens")).alias("token"))
    hubs = prefixes.groupBy("token").agg(F.max("rank").alias("hub"), F.min("id").alias("low"), F.max("id").alias("high")).where("low != high")
    groups = _staged(prefixes.join(hubs.select("token", "hub"), "token").select("hub", "id", "rank").distinct(), "groups")

    inside = groups.join(tokens.select("id", "tokens"), "id")
    centre = inside.where("hub = rank").select("hub", F.col("id").alias("hub_id"), F.col("tokens").alias("hub_tokens"))
    tested = _staged(
        inside.where("hub != rank").join(centre, "hub").select("hub", "id", "hub_id", linked("tokens", "hub_tokens").alias("ok")),
        "tested",
    )
    # classes that do not link with their hub meet all others of the group
    single = tested.where("NOT ok").select("hub", "id").distinct()
    per_hub = groups.groupBy("hub").agg(F.count(F.lit(1)).alias("size"))
    left = single.groupBy("hub").agg(F.count(F.lit(1)).alias("alone")).join(per_hub, "hub").where("size > 2").select(
        "hub", F.ceil(F.col("alone") / STRAGGLERS).alias("lots"), F.ceil(F.col("size") / MEMBERS).alias("parts"),
    )
    some = groups.where("hub != rank").join(left, "hub").join(single.withColumn("alone", F.lit(True)), ["hub", "id"], "left").select(
        "hub", "id", "lots", "parts", F.coalesce("alone", F.lit(False)).alias("alone"),
        F.pmod(F.xxhash64("id", F.lit(1)), F.col("lots")).alias("own_lot"),
        F.pmod(F.xxhash64("id", F.lit(2)), F.col("parts")).alias("own_part"),
    )
    lower = some.groupBy("id").agg(F.collect_set("hub").alias("hubs"))  # as many as prefix tokens at most
    spread = some.withColumn(
        "task", F.explode(F.expr(
            # a straggler goes to its lot against every part; each row goes to its part against every lot
            "array_distinct(concat(transform(sequence(0, lots - 1), l -> struct(l AS lot, own_part AS part)),"
            " CASE WHEN alone THEN transform(sequence(0, parts - 1), p -> struct(own_lot AS lot, p AS part))"
            " ELSE array() END))")),
    ).select(
        "hub", "task.lot", "task.part", "id", "alone",
        (F.col("alone") & (F.col("task.lot") == F.col("own_lot"))).alias("straggler"),
        (F.col("task.part") == F.col("own_part")).alias("member"),
    )
    more = spread.join(tokens.select("id", "tokens"), "id").join(lower, "id").withColumn(
        "lower", F.filter("hubs", lambda h: h < F.col("hub"))
    ).drop("hubs").groupBy("hub", "lot", "part").applyInArrow(
        _verified, f"a {kind}, b {kind}"
    )
    edges = tested.where("ok").select(F.col("id").alias("a"), F.col("hub_id").alias("b")).unionByName(more).distinct()
    return sets.join(classes.select("h1", "h2", F.col("id").alias("first")), ["h1", "h2"], "left"), _staged(edges, "edges")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of documents whose 5-word shingle sets have a Jaccard similarity of 0.75 or more.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased. Rows with equal
    sets are one class from the start. Shingles are ordered by a sketch of their document frequency,
    rarest first; two sets that link share at least n / 10 shingles among the first n - ceil(0.75 n)
    + n / 10 of each, which removes most classes after one packed shuffle of prefixes. The rest
    are grouped by the shared shingles of the usual prefix: every shingle names the highest-ranked class
    with it as its hub, and classes with a common hub meet in one group. Each is compared with its hub;
    only classes that do not link to it are compared with the other members, in tasks of bounded size. No
    pair that shares a prefix shingle is missed, and pairs are not listed.

    The sketch and the id filter have a fixed size: with more documents they order and prune less
    sharply, and the result stays the same. Sets are compared by 64-bit hashes of shingles.

    Defined results: null, empty and blank texts have no shingles and component_id is their own
    id; a text of fewer than five words is one shingle; repeated rows are one class; rows with a null id
    are left out of the links and keep a null component.
    Returns doc_id (named ``id_col``), n_shingles, component_id.
    """
    known = docs.where(F.col(id_col).isNotNull())
    sets, edges = links(known, id_col, text_col)
    labels = component_labels(edges)
    found = sets.join(labels, sets["first"] == labels["node"], "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("label", "first", "id").alias("component_id")
    )
    none = docs.where(F.col(id_col).isNull()).select(
        id_col, set_key(text_col).alias("k")
    ).select(id_col, F.col("k.n").alias("n_shingles"), F.col(id_col).alias("component_id"))
    return found.unionByName(none)


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents without near duplicates: of each component the row with the smallest id, all columns kept.

    Rows without shingles stay, and so do rows with a null id, which is no name for a component; but of rows that agree in id
    (null included) and text, one stays, the one whose columns have the smallest hash. Other rows that repeat an id all stay or all go.
    """
    found = near_duplicates(docs, id_col, text_col)
    goes = _staged(
        found.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("gone")).distinct(), "gone"
    )
    same = F.xxhash64("id", "body")
    again = _staged(
        docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("body")).groupBy("id", "body").count()
        .where("count > 1").select(same.alias("key")), "again"
    )
    row = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("body"))
    marked = likely_among(row, F.when(F.col("id").isNotNull(), F.xxhash64("id")), goes.select(F.xxhash64("gone").alias("key")))
    # only rows that may go are shuffled
    checked = marked.where("likely").join(goes, F.col("id") == F.col("gone"), "left_anti")
    kept = marked.where("NOT likely").unionByName(checked).select("row", "id", "body")
    repeats = likely_among(kept, same, again)
    once = repeats.where("likely").groupBy("id", F.col("row")[text_col].alias("text")).agg(
        F.min_by("row", F.xxhash64("row")).alias("row"))
    return repeats.where("NOT likely").select("row").unionByName(once.select("row")).select(
        *[F.col("row")[c].alias(c) for c in docs.columns])
