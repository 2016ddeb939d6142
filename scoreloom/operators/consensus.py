"""Similarity, consistency under perturbation and consensus of samples."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.functions import answer_text as at
from scoreloom.functions import fixed_values as fv
from scoreloom.functions.numbers import report_round
from scoreloom.functions.perturb import PERTURBATIONS
from scoreloom.session import new_folder


def perturb_questions(questions: DataFrame) -> DataFrame:
    """Five rows per question, one per kind of perturbation."""
    questions, text = at.searchable(questions, "question_text")
    kinds = F.array(*[
        F.struct(F.lit(kind).alias("perturbation_type"), build(text).alias("perturbed_question"))
        for kind, build in PERTURBATIONS.items()
    ])
    return questions.select("question_id", F.inline(kinds))


def jaccard_pairs(originals: DataFrame, perturbed: DataFrame) -> DataFrame:
    """Word overlap of every perturbed answer with its original.

    ``originals`` has original_id and answer; ``perturbed`` has original_id,
    perturbation_type, run_id and answer. Only distinct words are shuffled.
    """
    left = originals.select("original_id", at.words(F.col("answer")).alias("original_words"))
    right = perturbed.select(
        "original_id", "perturbation_type", "run_id",
        (F.coalesce(F.col("answer"), F.lit("")) == "").alias("is_empty"),
        at.words(F.col("answer")).alias("perturbed_words"),
    )
    return right.join(left, "original_id").select(
        "original_id", "perturbation_type", "run_id", "is_empty",
        report_round(at.jaccard(F.col("original_words"), F.col("perturbed_words")), 4).alias("similarity"),
    )


def consistency_score(originals: DataFrame, perturbed: DataFrame) -> DataFrame:
    """Average similarity over the kinds of perturbation of each original.

    1 without perturbations, 0 if all of them are empty. The last run of a kind
    counts; there are five kinds, so the state per original is fixed in size.
    """
    kinds = list(PERTURBATIONS)
    pairs = jaccard_pairs(originals, perturbed)
    kept = ~F.col("is_empty")
    per_kind = pairs.groupBy("original_id").agg(*[
        F.max_by("similarity", F.when(kept & (F.col("perturbation_type") == kind), F.col("run_id"))).alias(kind)
        for kind in kinds
    ], F.lit(True).alias("tried"))
    found = F.filter(
        F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("similarity")) for k in kinds]),
        lambda s: s["similarity"].isNotNull(),
    )
    total = F.aggregate("found", F.lit(0.0), lambda acc, s: acc + s["similarity"])
    score = (
        F.when(F.col("tried").isNull(), F.lit(1.0))
        .when(F.size("found") == 0, F.lit(0.0))
        .otherwise(report_round(total / F.size("found"), 4))
    )
    rows = originals.select("original_id").join(per_kind, "original_id", "left").withColumn("found", found)
    return rows.select(
        "original_id", score.alias("consistency_score"), F.map_from_entries("found").alias("per_perturbation")
    )


def self_consistency_plan(questions: DataFrame, k: int = fv.SELF_CONSISTENCY_K) -> DataFrame:
    """k sampling rows per question, told apart by their seeds."""
    return questions.select(
        "question_id", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("sample_idx")
    ).select(
        "question_id", "sample_idx",
        F.lit("self-consistency").alias("prompt_strategy"),
        F.lit(float(fv.SELF_CONSISTENCY_TEMPERATURE)).alias("temperature"),
        (F.col("sample_idx") + fv.SELF_CONSISTENCY_FIRST_SEED).alias("seed"),
    )


def word_hashes(text: Column) -> Column:
    """The distinct words of a text as 64-bit hashes; two different words of one pair of texts hardly ever share one."""
    return F.array_distinct(F.transform(at.words(text), lambda w: F.xxhash64(w)))


def _slots(samples: DataFrame, k: int) -> DataFrame:
    """One row per model and question with its k samples side by side.

    A sample's index comes from the plan's seeds, so k columns hold all of a
    group; an index outside the plan, or one that repeats, is an error, not a dropped row.
    """
    index = F.when(
        (F.col("sample_idx") >= 0) & (F.col("sample_idx") < k), F.col("sample_idx")
    ).otherwise(F.raise_error(F.lit("sample_idx lies outside the plan")))
    # texts stay behind: only hashes of their words are grouped
    rows = samples.filter(F.coalesce("answer", F.lit("")) != "").select(
        "model_id", "question_id", index.alias("sample_idx"), word_hashes(F.col("answer")).alias("words"))

    def slot(i):
        here = F.col("sample_idx") == i
        return F.when(F.count_if(here) > 1, F.raise_error(F.lit("a sample_idx repeats"))).otherwise(
            F.max_by("words", F.when(here, F.lit(1)))
        )

    return rows.groupBy("model_id", "question_id").agg(*[slot(i).alias(f"words_{i}") for i in range(k)])


def _mean_similarities(slots: DataFrame, k: int) -> DataFrame:
    pairs = [(i, j) for i in range(k) for j in range(i + 1, k)]
    # one lambda for all pairs: ten copies of it would be too much code for one method
    sides = F.array(*[F.struct(F.col(f"words_{i}").alias("left"), F.col(f"words_{j}").alias("right")) for i, j in pairs])
    similarity = F.transform(sides, lambda p: F.when(
        p["left"].isNotNull() & p["right"].isNotNull(), at.jaccard(p["left"], p["right"])))
    rows = slots.withColumn("similarity", similarity)

    def mean(i: int) -> Column:
        sims = [F.get("similarity", F.lit(place)) for place, pair in enumerate(pairs) if i in pair]
        total = sum((F.coalesce(s, F.lit(0.0)) for s in sims), F.lit(0.0))
        others = sum((s.isNotNull().cast("int") for s in sims), F.lit(0))
        return F.when(F.col(f"words_{i}").isNotNull(), F.when(others > 0, F.round(total / others, 9)).otherwise(F.lit(1.0)))

    return rows.withColumns({f"mean_{i}": mean(i) for i in range(k)})


def pairwise_similarity(samples: DataFrame, k: int = fv.SELF_CONSISTENCY_K) -> DataFrame:
    """Mean similarity of every sample to the other samples of its group."""
    rows = _mean_similarities(_slots(samples, k), k)
    per_sample = F.array(*[
        F.struct(F.lit(i).alias("sample_idx"), F.col(f"mean_{i}").alias("mean_similarity")) for i in range(k)
    ])
    return rows.select("model_id", "question_id", F.inline(per_sample)).filter(
        F.col("mean_similarity").isNotNull()
    )


def plurality_vote(samples: DataFrame, k: int = fv.SELF_CONSISTENCY_K) -> DataFrame:
    """The sample closest to all others of its group, ties to the lowest index."""
    rows = _mean_similarities(_slots(samples, k), k)
    best = F.array_max(F.array(*[
        F.when(F.col(f"mean_{i}").isNotNull(), F.struct(
            F.col(f"mean_{i}").alias("mean"), F.lit(-i).alias("order"),
        )) for i in range(k)
    ]))
    count = sum((F.col(f"words_{i}").isNotNull().cast("int") for i in range(k)), F.lit(0))
    voted = rows.select("model_id", "question_id", best.alias("best"), count.alias("samples")).select(
        "model_id", "question_id", "samples", (-F.col("best.order")).alias("best_idx"), F.col("best.mean").alias("mean_similarity"))
    # the narrow votes are written, or the join would repeat the whole comparison in a null check of its key
    folder = new_folder(samples.sparkSession, "votes")
    voted.write.parquet(folder)
    voted = samples.sparkSession.read.schema(voted.schema).parquet(folder)
    # the text of the winner is fetched by its key
    texts = samples.filter(F.coalesce("answer", F.lit("")) != "").select(
        "model_id", "question_id", F.col("sample_idx").cast("int").alias("best_idx"), F.col("answer").alias("best_answer"))
    return voted.join(texts, ["model_id", "question_id", "best_idx"]).select(*voted.columns, "best_answer")


def token_set_ops(pairs: DataFrame) -> DataFrame:
    """Sizes of the common and joint word sets of two texts per row.

    ``pairs`` has pair_id and left_text and right_text, or left_words and right_words (see ``word_hashes``) where the texts were
    reduced before they were joined. No words on a side count as none.
    """
    none = F.array().cast("array<bigint>")
    sides = {
        side: F.coalesce(F.col(f"{side}_words") if f"{side}_words" in pairs.columns else word_hashes(F.col(f"{side}_text")), none)
        for side in ("left", "right")
    }
    return pairs.select("pair_id", *[c.alias(side) for side, c in sides.items()]).select(
        "pair_id", F.size(F.array_intersect("left", "right")).alias("common_words"), F.size(F.array_union("left", "right")).alias("all_words"))
