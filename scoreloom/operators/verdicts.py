"""Contest verdicts: from the judge's reply to ranked models and the contest row."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.functions.strict_json import reply_object
from scoreloom.operators.ratings import UNPLACED
from scoreloom.session import new_folder

RANKINGS = "array<struct<label:string,placement:string,justification:string>>"
TIES = "array<array<string>>"


def parse_contest_replies(replies: DataFrame) -> DataFrame:
    """Rankings, ties and reasoning of every reply (contest_id, reply).

    Rankings are in order of placement, a missing or unreadable placement counting as the last
    one, and ties among them in the order listed. An unreadable reply has none and parse_error set.
    """
    body = F.col("body")
    listed = F.coalesce(F.from_json(F.get_json_object(body, "$.rankings"), RANKINGS), F.array().cast(RANKINGS))
    places = F.transform(listed, lambda r, i: F.struct(
        F.coalesce(r["placement"].try_cast("int"), F.lit(UNPLACED)).alias("placement"), i.alias("listed"),
        F.coalesce(r["label"], F.lit("")).alias("label"), F.coalesce(r["justification"], F.lit("")).alias("justification"),
    ))
    ties = F.coalesce(F.from_json(F.get_json_object(body, "$.ties"), TIES), F.array().cast(TIES))
    return replies.withColumn("body", reply_object(F.col("reply"))).select(
        "contest_id", F.sort_array(places).alias("rankings"), F.filter(ties, lambda t: t.isNotNull()).alias("ties"),
        F.coalesce(F.get_json_object(body, "$.reasoning"), F.lit("")).alias("reasoning"),
        body.isNull().alias("parse_error"), F.col("reply").alias("raw_reply"),
    )


def contest_placements(parsed: DataFrame, label_map: DataFrame) -> DataFrame:
    """One row per ranked label with its model: what placements and ratings are computed from.

    ``label_map`` has contest_id, label and model_id. A label outside the map has a null model.
    """
    # an inner explode would add a filter on the list and so read every reply twice
    rows = parsed.select("contest_id", "ties", F.posexplode_outer("rankings").alias("at", "r")).filter(F.col("at").isNotNull()).select(
        "contest_id", F.col("r.label").alias("label"), F.col("r.placement").alias("placement"),
        (F.col("at") + 1).alias("position"), F.col("r.justification").alias("justification"),
        F.exists("ties", lambda t: F.array_contains(t, F.col("r.label"))).alias("tied"),
    )
    return rows.join(label_map.select("contest_id", "label", "model_id"), ["contest_id", "label"], "left")


def contest_results(parsed: DataFrame, label_map: DataFrame) -> DataFrame:
    """The contest row of every reply: ranked and tied models, label map, reasoning and raw reply.

    The parsed replies are written first, so that each is parsed once. Lists hold one entry per label of a reply, which is itself one text. Labels the map does not know
    stand for themselves; tie_model_ids is null without a tie.
    """
    folder = new_folder(parsed.sparkSession, "verdicts")
    parsed.write.parquet(folder)
    parsed = parsed.sparkSession.read.schema(parsed.schema).parquet(folder)
    ranks = F.transform("rankings", lambda r, i: F.struct(F.lit(None).cast("int").alias("nth"), i.alias("at"), r["label"].alias("label")))
    groups = F.flatten(F.transform(F.filter("ties", lambda g: g.isNotNull()), lambda g, n: F.transform(g, lambda x, i: F.struct(n.alias("nth"), i.alias("at"), x.alias("label")))))
    every = F.concat(ranks, groups)
    model = F.coalesce(F.col("model_id").cast("string"), F.col("label"))
    ranking, known = F.col("nth").isNull(), F.col("model_id").isNotNull()
    decoded = parsed.select("contest_id", F.explode(every).alias("x")).select("contest_id", "x.*").join(
        label_map.select("contest_id", "label", "model_id"), ["contest_id", "label"], "left"
    ).groupBy("contest_id").agg(
        F.sort_array(F.collect_list(F.when(ranking, F.struct("at", model.alias("model"))))).alias("ranked"),
        F.map_from_entries(F.sort_array(F.collect_set(F.when(ranking & known, F.struct("label", model.alias("model")))))).alias("anonymized_map"),
        F.sort_array(F.collect_list(F.when(~ranking, F.struct("nth", "at", model.alias("model"))))).alias("tied"),
    )
    return parsed.join(decoded, "contest_id", "left").select(
        "contest_id", F.coalesce(F.col("ranked.model"), F.array().cast("array<string>")).alias("ranked_model_ids"),
        F.coalesce("anonymized_map", F.create_map().cast("map<string,string>")).alias("anonymized_map"),
        (F.size("ties") > 0).alias("tie_exists"), F.when(F.size("tied") > 0, F.col("tied.model")).alias("tie_model_ids"),
        F.col("reasoning").alias("judge_reasoning"), "parse_error", F.col("raw_reply").alias("raw_judge_response"),
    )


def contest_entries(placements: DataFrame, contests: DataFrame) -> DataFrame:
    """Entries for the rating operators: placements of known models with the contest's columns and size."""
    known = placements.filter(F.col("model_id").isNotNull()).select("contest_id", "model_id", "placement")
    sizes = known.groupBy("contest_id").agg(F.count(F.lit(1)).alias("entrants"))
    return known.join(contests.join(sizes, "contest_id"), "contest_id")
