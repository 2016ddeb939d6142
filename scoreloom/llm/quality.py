"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.llm import text as T
from scoreloom.llm.langid import held_out

SLOTS, WIDTH, ENTRIES, REACH = 4096, 32, 4, 2
BLOCK = 64  # word slots per row of partial sums
KINDS = np.full(256, 2, np.uint8)  # runs of symbols are words as well
KINDS[T.BLANKS] = 0
KINDS[0x30:0x3A] = KINDS[0x41:0x5B] = KINDS[0x61:0x7B] = KINDS[0x80:] = 1


def _tokens(texts: pa.Array):
    for data, borders in T.slices(texts):
        starts, ends, row = T.spans(data, borders, KINDS)
        yield T.hashes(data, starts, ends), row, len(borders) - 1


def _slot(hashed: np.ndarray) -> np.ndarray:
    return (hashed >> np.uint64(52)).astype(np.int64)


def _context_sums(batches):
    """Sums of the neighbours' sparse index vectors for each word slot, over all texts of a task."""
    total = np.zeros(SLOTS * WIDTH, np.int64)
    for batch in batches:
        for hashed, row, _ in _tokens(batch.column(0)):
            slot = _slot(hashed)
            for step in range(1, REACH + 1):
                near = np.flatnonzero(row[:-step] == row[step:]) if len(row) > step else np.zeros(0, np.int64)
                for word, other in ((near, near + step), (near + step, near)):
                    for k in range(ENTRIES):  # the index vector: ENTRIES places and signs from the word's hash
                        bits = hashed[other] >> np.uint64(8 * k)
                        cell = slot[word] * WIDTH + (bits & np.uint64(WIDTH - 1)).astype(np.int64)
                        plus = (bits >> np.uint64(6)) & np.uint64(1) == 1
                        total += np.bincount(cell[plus], minlength=len(total)) - np.bincount(cell[~plus], minlength=len(total))
    blocks = total.reshape(SLOTS // BLOCK, BLOCK * WIDTH)
    used = np.flatnonzero(blocks.any(1))
    yield pa.RecordBatch.from_arrays(
        [pa.array(used, pa.int32()), pa.array([blocks[k].tobytes() for k in used], pa.binary())], ["block", "sums"]
    )


def _added(table: pa.Table) -> pa.Table:
    sums = sum(np.frombuffer(x, np.int64) for x in table["sums"].to_pylist())
    return pa.table({"block": table["block"][:1], "sums": pa.array([sums.tobytes()], pa.binary())})


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Unit vectors of the word slots, from the neighbours of every word of every document.

    Words share SLOTS hashed slots, so each task sends SLOTS * WIDTH numbers at most and the
    result has that fixed size whatever the corpus.
    """
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(text_col))
    rows = texts.mapInArrow(_context_sums, "block int, sums binary").groupBy("block").applyInArrow(_added, "block int, sums binary")
    total = np.zeros((SLOTS // BLOCK, BLOCK * WIDTH))
    for r in rows.collect():  # SLOTS / BLOCK rows
        total[r.block] = np.frombuffer(bytes(r.sums), np.int64)
    vectors = total.reshape(SLOTS, WIDTH)
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    return (vectors / np.where(length > 0, length, 1)).astype(np.float32)


def pooled(texts: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Mean, deviation and mean step between neighbours of the word vectors of each text; zeros without words."""
    out = []
    for hashed, row, n in _tokens(texts):
        x = vectors[_slot(hashed)]
        rows = np.zeros((n, 3 * WIDTH), np.float32)
        if len(x):
            first = np.flatnonzero(np.diff(row, prepend=-1))
            at, count = row[first], np.diff(np.append(first, len(row)))[:, None]
            mean = np.add.reduceat(x, first, axis=0, dtype=np.float64) / count
            square = np.add.reduceat(x * x, first, axis=0, dtype=np.float64) / count
            step = np.abs(np.diff(x, axis=0, prepend=x[:1]))
            step[first] = 0
            rows[at] = np.hstack([
                mean, np.sqrt(np.maximum(square - mean * mean, 0)),
                np.add.reduceat(step, first, axis=0, dtype=np.float64) / np.maximum(count - 1, 1),
            ])
        out.append(rows)
    return np.concatenate(out) if out else np.zeros((0, 3 * WIDTH), np.float32)


class Network:
    """Two layers over scaled features; scores are sigmoid(logit / temperature)."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 60, batch: int = 128, seed: int = 5):
        draw = np.random.default_rng(seed)
        self.centre, self.scale = x.mean(0), x.std(0) + 1e-6
        self.parts = [draw.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden),
                      draw.normal(0, hidden ** -0.5, hidden), np.zeros(1)]
        self.temperature = 1.0
        check = np.arange(len(x)) % 5 == 0  # calibration rows, not used for the weights
        fit = np.flatnonzero(~check) if (~check).any() else np.arange(len(x))
        z = (x - self.centre) / self.scale
        m, v, t = [np.zeros_like(p) for p in self.parts], [np.zeros_like(p) for p in self.parts], 0
        for _ in range(epochs):
            for part in np.array_split(draw.permutation(fit), max(1, len(fit) // batch)):
                w1, b1, w2, b2 = self.parts
                h = np.tanh(z[part] @ w1 + b1)
                off = (_sigmoid(h @ w2 + b2) - y[part]) / len(part)
                back = np.outer(off, w2) * (1 - h * h)
                slopes = [z[part].T @ back + 1e-4 * w1, back.sum(0), h.T @ off + 1e-4 * w2, off.sum(keepdims=True)]
                t += 1
                for k, g in enumerate(slopes):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.parts[k] = self.parts[k] - 0.003 * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(v[k] / (1 - 0.999 ** t)) + 1e-8)
        if check.any():
            logit, wanted = self.logit(x[check]), y[check]
            self.temperature = float(min(
                np.geomspace(0.25, 8, 61),
                key=lambda c: np.logaddexp(0, np.where(wanted > 0, -logit, logit) / c).mean(),
            ))

    def logit(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.parts
        return np.tanh((x - self.centre) / self.scale @ w1 + b1) @ w2 + b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logit(x) / self.temperature)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.exp(-np.logaddexp(0, -x))


def _pool(vectors: np.ndarray):
    @F.arrow_udf("array<float>")
    def pool(texts: pa.Array) -> pa.Array:
        x = pooled(texts, vectors)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))

    return pool


def _scorer(vectors: np.ndarray, network: Network):
    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(network.score(pooled(texts, vectors)), pa.float64())

    return score


def quality_scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    threshold: float = 0.3, train_rows: int = 6000,
) -> DataFrame:
    """doc_id (named ``id_col``), held_out, score and predicted of every document.

    Word vectors come from the texts of all documents. The network learns from at most
    ``train_rows`` labelled rows, those with the smallest hashes of their ids among the rows not held
    out (crc32 of the id as text, modulo 5, not 0); this bound is the fitting sample's only.

    Defined results: null and empty texts pool to zeros and get the score of zeros; null ids are
    not held out and match no label; labels other than 0 and 1 are not used; a document with several
    labels is used once for each; no usable labels give 0.5 throughout; repeated rows score alike.
    """
    vectors = word_vectors(docs, text_col)
    chosen = (
        labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
        .select(F.col(id_col).alias("id"), F.col(label_col).alias("label"))
        .orderBy(F.xxhash64("id"), "id", "label").limit(train_rows)
    )
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    sample = rows.select("id", "label", F.xxhash64("text").alias("body"), _pool(vectors)("text").alias("x")).toArrow()
    sample = sample.sort_by([("id", "ascending"), ("label", "ascending"), ("body", "ascending")])
    if sample.num_rows:
        x = np.array(sample["x"].to_pylist(), np.float64)
        score = _scorer(vectors, Network(x, sample["label"].to_numpy().astype(float)))(F.col("text"))
    else:
        score = F.lit(0.5)
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).select(
        F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), score.alias("score")
    ).withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
