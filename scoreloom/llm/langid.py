"""Language identification: blended-spectrum string kernel, Nyström landmarks, kernel ridge regression."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.llm import text as T

GRAMS = 4096  # slots of each n-gram length
ORDERS = (1, 2, 3, 4)
UNKNOWN = "und"


def presence(texts: pa.Array, rows_at_once: int = 256):
    """0/1 rows over n-gram slots, scaled to length 1, for the bytes of lower-cased texts.

    Each order has its own slots (hashed for orders over 1) and the same weight in the kernel,
    so the product of two rows is the blended-spectrum presence kernel.
    """
    for data, borders in T.slices(texts):
        data = T.LOWER[data]
        for first in range(0, len(borders) - 1, rows_at_once):
            edges = borders[first: first + rows_at_once + 1]
            part = data[edges[0]: edges[-1]]
            edges = edges - edges[0]
            n = len(edges) - 1
            row = np.repeat(np.arange(n), np.diff(edges))
            out = np.zeros((n, GRAMS * len(ORDERS)), np.float32)
            gram = np.zeros(len(part), np.uint64)
            for k, order in enumerate(ORDERS):
                if len(part) < order:
                    break
                gram = gram[: len(part) - order + 1] * np.uint64(257) + part[order - 1:]
                slot = gram if order == 1 else (gram * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(52)
                same = row[: len(gram)] == row[order - 1:]
                block = out[:, k * GRAMS: (k + 1) * GRAMS]
                block[row[: len(gram)][same], slot[same].astype(np.int64)] = 1
                norm = np.sqrt(block.sum(1, keepdims=True))
                block /= np.where(norm > 0, norm, 1)
            out /= np.float32(np.sqrt(len(ORDERS)))
            yield out


class Model:
    """Scoring matrix of the one-versus-rest regressions over n-gram slots."""

    def __init__(self, langs: list[str], weights: np.ndarray, sharpness: float):
        self.langs, self.weights, self.sharpness = langs, weights, np.float32(sharpness)

    def probabilities(self, texts: pa.Array) -> np.ndarray:
        parts = []
        for rows in presence(texts):
            margin = (rows @ self.weights[:-1] + self.weights[-1]) * self.sharpness
            e = np.exp(margin - margin.max(1, keepdims=True))
            parts.append(e / e.sum(1, keepdims=True))
        return np.concatenate(parts) if parts else np.zeros((0, len(self.langs)), np.float32)


def fit(rows, landmarks: int, ridge: float) -> Model | None:
    """Kernel ridge regression on the Nyström map of (text, lang) rows, classes weighted evenly."""
    if rows.num_rows == 0:
        return None
    lang = np.array(rows["lang"].to_pylist())
    langs = sorted(set(lang.tolist()))
    texts = rows["text"].combine_chunks()
    # landmarks: rows of all languages in turn, the table being in order of (turn, lang)
    points = np.concatenate(list(presence(texts[:landmarks], 64)))
    values, vectors = np.linalg.eigh((points @ points.T).astype(np.float64))
    good = values > values[-1] * 1e-5
    to_map = points.T @ (vectors[:, good] / np.sqrt(values[good])).astype(np.float32)  # slots -> Nyström features
    del points
    # the gram rows of the sample are made and mapped a few at a time
    z = np.concatenate([x @ to_map for x in presence(texts, 64)]).astype(np.float64)
    z = np.hstack([z, np.ones((len(z), 1))])
    share = np.array([1.0 / (lang == s).sum() for s in lang])[:, None]
    target = np.where(lang[:, None] == np.array(langs)[None, :], 1.0, -1.0)
    inner = z.T @ (z * share) + ridge * np.diag([1.0] * (z.shape[1] - 1) + [0.0])
    beta = np.linalg.solve(inner + 1e-9 * np.eye(len(inner)), z.T @ (target * share))
    weights = np.vstack([to_map @ beta[:-1].astype(np.float32), beta[-1:].astype(np.float32)])
    margin = z @ beta
    # sharpness: the softmax that fits the training rows best, on a fixed grid
    best = min((1.0, 2.0, 3.0, 4.0, 6.0, 8.0), key=lambda s: _loss(margin * s, target, share))
    return Model(langs, weights, best)


def _loss(margin, target, share) -> float:
    e = margin - margin.max(1, keepdims=True)
    log = e - np.log(np.exp(e).sum(1, keepdims=True))
    return float(-(log * (target > 0) * share).sum())


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
          per_lang: int = 400, landmarks: int = 400, ridge: float = 1e-3) -> Model | None:
    """Model from at most ``per_lang`` labelled rows of each language, chosen by a hash of the id.

    The bound is the fitting sample's only; it holds for every size of table. Rows without a text or
    language are not used. No labelled row: None.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col)).alias("draw"), F.xxhash64(F.col(text_col)).alias("body"),
        F.col(text_col).alias("text"),
    )
    counts = rows.groupBy("lang").count().select("lang", F.least(F.lit(1.0), 3.0 * per_lang / F.col("count")).alias("share"))
    thinned = rows.join(F.broadcast(counts), "lang").where(  # one row per language
        F.pmod("draw", F.lit(1 << 30)) <= F.col("share") * (1 << 30)
    )
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "body"))
    picked = thinned.withColumn("turn", turn).where(F.col("turn") <= per_lang)
    return fit(picked.select("turn", "lang", "text").toArrow().sort_by([("turn", "ascending"), ("lang", "ascending")]),
               landmarks, ridge)


def predict(text: Column, model: Model | None) -> Column:
    """struct<lang_pred, score> for a text column; ``und`` with score 0 without a letter or a model."""
    if model is None:
        return F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))

    @F.arrow_udf("lang_pred string, score double")
    def classify(texts: pa.Array) -> pa.Array:
        p = model.probabilities(texts)
        best = p.argmax(1)
        return pa.StructArray.from_arrays(
            [pa.array([model.langs[k] for k in best], pa.string()), pa.array(p[np.arange(len(p)), best].astype(np.float64))],
            ["lang_pred", "score"],
        )

    letter = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    scored = classify(text)
    return F.struct(
        F.when(letter, scored["lang_pred"]).otherwise(F.lit(UNKNOWN)).alias("lang_pred"),
        F.when(letter, scored["score"]).otherwise(F.lit(0.0)).alias("score"),
    )


def identify(docs: DataFrame, train_rows: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang", per_lang: int = 400, landmarks: int = 400) -> DataFrame:
    """doc_id (named ``id_col``), held_out, lang_pred and score of every document.

    Learns from the rows of ``train_rows`` (default: ``docs``) that are not held out: crc32 of the
    id as text, modulo 5, not 0. Kernel of two texts: shared distinct byte n-grams of 1 to 4
    bytes, each order normalised; Nyström features from ``landmarks`` training texts; one ridge
    regression per language; softmax of the regressions as score. A batch is scored by one product
    of its n-gram rows with the regressions carried back through the landmarks.

    Defined results: null texts and texts without a letter are ``und`` with score 0; a null id counts
    as not held out; repeated rows are scored alike; no labelled rows give ``und`` throughout.
    """
    known = docs if train_rows is None else train_rows
    model = train(known.where(~held_out(F.col(id_col))), text_col, lang_col, id_col, per_lang, landmarks)
    scored = predict(F.col(text_col), model)
    return docs.select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"), scored.alias("p")).select(
        id_col, "held_out", "p.lang_pred", "p.score"
    )


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def keep_identified(docs: DataFrame, train_rows: DataFrame | None = None, least: float = 0.5, id_col: str = "doc_id",
                    text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Documents whose language is recognised: not ``und`` and a score of ``least`` or more; all columns kept."""
    known = docs if train_rows is None else train_rows
    model = train(known.where(~held_out(F.col(id_col))), text_col, lang_col, id_col)
    row = F.struct(*[F.col(c) for c in docs.columns]).alias("row")
    seen = docs.select(row, predict(F.col(text_col), model).alias("p"))
    return seen.where((F.col("p.lang_pred") != UNKNOWN) & (F.col("p.score") >= least)).select(
        *[F.col("row")[c].alias(c) for c in docs.columns]
    )
