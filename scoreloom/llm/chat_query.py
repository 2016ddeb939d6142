"""The registered query of chat formatting and its SQL."""

from pyspark.sql import functions as F

from scoreloom.llm.chat import CONTROLS, FIELDS, Template, chat_format, read_back

PROBE = "</s>[INST] ok [/INST]"


def records_of(rows):
    """Conversations as records of all layouts, by their roles and the digest of their id, one layout a record.

    ``rows`` has conv_id, turn, role, text and added; turns stand by turn, then role, then text, nulls first.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    convs = rows.groupBy("conv_id", "added").agg(F.sort_array(F.collect_list(turn)).alias("t")).select(
        "conv_id", F.col("t.role").alias("r"), F.col("t.text").alias("x"), F.size("t").alias("n"),
        F.coalesce(F.crc32(F.col("conv_id").cast("string")), F.lit(0)).alias("draw"))
    draw = F.col("draw") % 3
    roles = lambda *names: F.col("r") == F.array(*[F.lit(x) for x in names])
    known = F.forall("r", lambda r: r.isin("user", "assistant", "system"))
    other = F.forall(F.transform("r", lambda r, i: r == F.when(i % 2 == 0, "user").otherwise("assistant")), lambda same: same)
    kind = (
        F.when(roles("user") | roles("user", "assistant") & (draw == 0), "prompt")
        .when((roles("user", "assistant") | roles("system", "user", "assistant")) & (draw == 1), "instruction")
        .when(other & (F.col("n") >= 3) & (draw == 0), "history")
        .when(known & (draw == 1), "share")
        .otherwise("messages")
    )
    convs = convs.withColumn("kind", kind).withColumn("full", F.floor((F.col("n") - 1) / 2).cast("int"))
    text = lambda at: F.get("x", at)
    theirs = lambda r: F.when(r == "user", "human").when(r == "assistant", "gpt").otherwise(r)
    has_system = F.when(F.get("r", F.lit(0)) == "system", 1).otherwise(0)
    when = lambda *kinds: F.when(F.col("kind").isin(*kinds), F.lit(True))
    fields = {
        "messages": F.when(when("messages"), F.zip_with("r", "x", lambda r, x: F.struct(r.alias("role"), x.alias("content")))),
        "conversations": F.when(when("share"), F.zip_with("r", "x", lambda r, x: F.struct(theirs(r).alias("from"), x.alias("value")))),
        "history": F.when(when("history"), F.transform(
            F.sequence(F.lit(0), F.col("full") - 1), lambda k: F.array(F.get("x", 2 * k), F.get("x", 2 * k + 1)))),
        "system": F.when(when("instruction") & (has_system == 1), text(F.lit(0))),
        "instruction": F.when(when("instruction"), text(has_system)).when(when("history"), text(2 * F.col("full"))),
        "input": F.lit(None),
        "output": F.when(when("instruction"), text(has_system + 1)).when(when("history"), text(2 * F.col("full") + 1)),
        "prompt": F.when(when("prompt"), text(F.lit(0))),
        "completion": F.when(when("prompt"), text(F.lit(1))),
    }
    return convs.select("conv_id", *[fields[name].cast(kind).alias(name) for name, kind in FIELDS.items()])


def op11_chat_formatting(spark, folder):
    """All conversations and the probe, as records of mixed layouts, formatted and read back."""
    table = spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text", F.lit(False).alias("added"))
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PROBE).alias("text"), F.lit(True).alias("added"))
    back = read_back(chat_format(records_of(table.unionByName(probe))))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
                         F.array_join("loss_texts", "").alias("learnt"), F.length("formatted").cast("long").alias("formatted_chars"))
    return learnt.select("conv_id", "n_turns", "turns_sha256", F.length("learnt").cast("long").alias("loss_chars"),
                         F.sha2("learnt", 256).alias("loss_sha256"), "formatted_chars")


def _controls_sql(text: str) -> str:
    """How many control strings, with or without backslashes, a text holds."""
    firsts = "".join(sorted({c[0] for c in CONTROLS})).replace("[", r"\[")
    rests = "|".join(c[1:].replace("|", r"\|").replace("]", r"\]").replace("[", r"\[") for c in CONTROLS)
    return rf"len(regexp_extract_all({text}, '[{firsts}]\\*({rests})'))"


_PERCENT = "replace(replace(role, '%', '%25'), chr(10), '%0A')"
SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, false AS added FROM conversations
  UNION ALL
  SELECT -1, turn, role, '{PROBE}', true FROM (VALUES (0, 'user'), (1, 'assistant')) v(turn, role)),
sized AS (
  SELECT *, {len(Template().open) + 1 + len(Template().close)} + length({_PERCENT}) + {_controls_sql(_PERCENT)} + length(text) + {_controls_sql("text")} AS chars FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id, added
"""
