"""Experiment grids, pending work, few-shot examples and prompts."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.functions import fixed_values as fv
from scoreloom.functions import prompt_texts as pt
from scoreloom.functions import tags as tg
from scoreloom.functions.keys import config_digest, config_text
from scoreloom.operators.answer_scan import cut
from scoreloom.operators.ordering import with_row_number
from scoreloom.session import new_folder
from scoreloom.sources.files import staged


# --- grids --------------------------------------------------------------------------


def _literal_rows(rows: list[dict]) -> Column:
    return F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in row.items()]) for row in rows])


def sweep_configs(params: list[str]) -> list[dict[str, str]]:
    """One-axis-at-a-time overrides: every grid value of a parameter but its default."""
    return [{p: v} for p in params for v in fv.HYPERPARAM_GRID[p] if v != fv.DEFAULT_HYPERPARAMS[p]]


MODEL_BLOCK = 1000
FEW_MODELS = 100_000  # so many ids are broadcast; more are joined by their block


def model_blocks(models: DataFrame) -> DataFrame:
    """(block, model_ids): the models in order, a thousand to a row."""
    numbered = with_row_number(models.select("model_id"), ["model_id"], "nth")
    block = F.floor((F.col("nth") - 1) / MODEL_BLOCK).alias("block")
    return numbered.groupBy(block).agg(F.sort_array(F.collect_list("model_id")).alias("model_ids"))


def grid(questions: DataFrame, models: DataFrame, strategies: list[str], configs: list[dict], phase: str) -> DataFrame:
    """Questions x models x strategies x configurations, of any number of models.

    ``models`` has model_id. Strategies and configurations are the lists of the request. A cell is a number in mixed radix: block of
    models, model in the block, row of the request. Every question generates the numbers of the blocks and joins their
    models; generators over one block at a time then make the cells, so no row or task holds those of a question.
    """
    rows = [{"prompt_strategy": s, "hyperparams": config_text(c), "hyperparam_hash": config_digest(c)} for s in strategies for c in configs]
    count = models.count()
    blocks = model_blocks(models)
    last = F.lit(max(0, -(-count // MODEL_BLOCK) - 1)).cast("long")  # without models the one block finds no partner
    numbered = questions.select("question_id", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"))
    joined = numbered.join(F.broadcast(blocks) if count <= FEW_MODELS else blocks, "block")
    cells = joined.select("question_id", F.explode("model_ids").alias("model_id"))
    return cells.select(F.lit(phase).alias("phase"), "question_id", "model_id", F.inline(_literal_rows(rows)))


def experiment_grid(questions: DataFrame, sample: DataFrame, models: DataFrame, params: list[str]) -> DataFrame:
    """The three phases: baseline on all, other strategies on a sample, sweeps on all."""
    others = [s for s in fv.STRATEGIES if s != fv.BASELINE_STRATEGY]
    baseline = [fv.BASELINE_STRATEGY]
    return (
        grid(questions, models, baseline, [{}], "phase1")
        .unionByName(grid(sample, models, others, [{}], "phase2"))
        .unionByName(grid(questions, models, baseline, sweep_configs(params), "phase3"))
    )


def sweep_metadata(models: DataFrame, params: list[str]) -> DataFrame:
    """One sweep record per model and parameter with its grid of values."""
    rows = [{"sweep_param": p, "param_grid": "[" + ", ".join(fv.HYPERPARAM_GRID[p]) + "]"} for p in params]
    return models.select("model_id", F.inline(_literal_rows(rows)), F.lit("dispatched").alias("status"))


def comparison_metadata(models: DataFrame) -> DataFrame:
    """One strategy-comparison record per model."""
    return models.select(
        "model_id", F.array(*[F.lit(s) for s in fv.STRATEGIES]).alias("strategies"),
        F.lit("dispatched").alias("status"),
    )


RUN_KEY = ["question_id", "model_id", "prompt_strategy", "hyperparam_hash"]


def pending_runs(planned: DataFrame, runs: DataFrame) -> DataFrame:
    """Planned cells that have no run yet."""
    return planned.join(runs.select(*RUN_KEY), RUN_KEY, "left_anti")


def contest_ready(scored: DataFrame, required: list) -> DataFrame:
    """Questions for which every required model has a scored baseline run.

    One boolean per required model, merged before the shuffle.
    """
    rows = scored.filter(F.col("prompt_strategy") == fv.BASELINE_STRATEGY).filter(F.col("model_id").isin(required))
    seen = [F.max(F.col("model_id") == m).alias(f"seen_{i}") for i, m in enumerate(required)]
    ready = F.lit(True)
    for i in range(len(required)):
        ready = ready & F.col(f"seen_{i}")
    return rows.groupBy("question_id").agg(*seen).filter(ready).select("question_id")


def contestable(scored: DataFrame) -> DataFrame:
    """Questions with scored baseline runs of at least two models."""
    rows = scored.filter(F.col("prompt_strategy") == fv.BASELINE_STRATEGY)
    return rows.groupBy("question_id").agg(
        F.min("model_id").alias("low"), F.max("model_id").alias("high")
    ).filter(F.col("low") < F.col("high")).select("question_id")


# --- few-shot examples -----------------------------------------------------------------

STORED_STRATEGIES = ["few-shot", "few-shot-cot"]


def seed_few_shot(questions: DataFrame, stored: DataFrame) -> DataFrame:
    """Two examples per answered question, without those that are stored already."""
    answer = F.col("expected_answer")
    names = F.array(*[F.lit(s) for s in STORED_STRATEGIES])
    # the keys decide what is new; a question that has something new is then read with its texts, which are built last
    new = questions.filter(answer.isNotNull()).select("question_id", F.explode(names).alias("prompt_strategy")).join(
        stored.select("question_id", "prompt_strategy"), ["question_id", "prompt_strategy"], "left_anti")
    wanted = new.groupBy("question_id").agg(F.sort_array(F.collect_set("prompt_strategy")).alias("wanted"))
    rows = questions.filter(answer.isNotNull()).join(wanted, "question_id").select(
        F.explode("wanted").alias("prompt_strategy"), "question_id", "subtopic_id", "difficulty",
        F.col("question_text").alias("example_question"), answer.alias("answer"))
    built = F.when(F.col("prompt_strategy") == "few-shot-cot", F.format_string(pt.COT_EXAMPLE_ANSWER, "answer")).otherwise(F.col("answer"))
    return rows.select("question_id", "prompt_strategy", "subtopic_id", "difficulty", "example_question", built.alias("example_answer"))


def _first_examples(store: DataFrame, keys: list[str], count: int, name: str) -> DataFrame:
    """The first examples of every key as one short array.

    Spark keeps ``count`` rows per key in each map task (window group limit).
    """
    reasoning = F.col("example_reasoning") if "example_reasoning" in store.columns else F.lit(None)
    example = F.struct(
        "question_id", "prompt_strategy", F.col("example_question").alias("question"),
        F.col("example_answer").alias("answer"), reasoning.cast("string").alias("reasoning"),
    )
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("question_id", "prompt_strategy"))
    return store.withColumn("__rank", rank).filter(F.col("__rank") <= count).groupBy(*keys).agg(
        F.sort_array(F.collect_list(example)).alias(name))


def _measured(examples: DataFrame) -> DataFrame:
    spark = examples.sparkSession
    return spark.read.schema(examples.schema).parquet(staged(examples, new_folder(spark, "examples")))


def few_shot_lookup(questions: DataFrame, store: DataFrame, strategy: str = "few-shot", n: int = 3) -> DataFrame:
    """Up to n examples per question that are not the question itself.

    Same subtopic and difficulty first; if those are fewer than n, the first n
    of the subtopic replace them. A question is stored once per strategy, so the
    first n plus that many examples of a key always leave n others; a store that repeats one is an error. Ids
    are of any type; an optional example_reasoning goes with its example.
    """
    again = store.groupBy("question_id", "prompt_strategy").count().filter("count > 1")
    if not again.isEmpty():
        raise ValueError("a question is stored twice for one strategy")
    wanted = [strategy] if "cot" in strategy else [strategy, "few-shot-cot"]
    strict = _first_examples(
        store.filter(F.col("prompt_strategy").isin(wanted)), ["subtopic_id", "difficulty"],
        n + len(STORED_STRATEGIES), "strict",
    )
    relaxed = _first_examples(store, ["subtopic_id"], n + len(STORED_STRATEGIES), "relaxed")
    # a few rows per key: written first, so that Spark knows their size and need not gather the questions by their few keys
    strict, relaxed = (_measured(examples) for examples in (strict, relaxed))

    def others(name):
        kept = F.filter(name, lambda e: e["question_id"] != F.col("question_id"))
        return F.coalesce(F.slice(kept, 1, n), F.array().cast(relaxed.schema["relaxed"].dataType))

    return (
        questions.join(strict, ["subtopic_id", "difficulty"], "left").join(relaxed, "subtopic_id", "left")
        .withColumns({"strict": others("strict"), "relaxed": others("relaxed")})
        .withColumn("is_relaxed", F.size("strict") < n)
        .withColumn("examples", F.when(F.col("is_relaxed"), F.col("relaxed")).otherwise(F.col("strict")))
        .drop("strict", "relaxed")
    )


# --- prompts --------------------------------------------------------------------------


def fill(template: str, *values: Column) -> Column:
    """Put values in the places marked %s."""
    parts = template.split("%s")
    pieces = [F.lit(parts[0])]
    for value, rest in zip(values, parts[1:]):
        pieces += [value, F.lit(rest)]
    return F.concat(*pieces)


def system_prompt(strategy: Column, style: Column) -> Column:
    expr = F.when(strategy == "role-prompting", F.lit(pt.ROLE_SYSTEM_PROMPT))
    for name, text in pt.SYSTEM_PROMPTS.items():
        expr = expr.when(style == name, F.lit(text))
    return expr.otherwise(F.lit(pt.SYSTEM_PROMPTS[pt.DEFAULT_STYLE]))


def with_schema(question: Column, ddl: Column) -> Column:
    """Put the table definitions of a question in front of it, data lines left out."""
    lines = F.filter(F.split(ddl, "\n"), lambda l: _any_word(F.upper(l)))
    summary = F.trim(F.array_join(lines, "\n"))
    return F.when(F.coalesce(summary, F.lit("")) != "", fill(pt.SCHEMA_PREFIX, summary, question)).otherwise(question)


def _any_word(line: Column) -> Column:
    hit = F.lit(False)
    for word in pt.DDL_LINE_WORDS:
        hit = hit | F.contains(line, F.lit(word))
    return hit


def _example(e: Column, reasoned: bool = False) -> Column:
    block = F.lit("")
    if reasoned:
        why = F.nullif(e["reasoning"], F.lit(""))
        block = F.coalesce(F.concat(F.lit("\nReasoning:\n"), why), block)
    return F.concat(F.lit("Question: "), e["question"], block, F.lit("\nAnswer: "), e["answer"])


def _numbered(examples: Column, reasoned: bool) -> Column:
    return F.array_join(F.transform(examples, lambda e, i: F.concat(
        F.lit("Example "), (i + 1).cast("string"), F.lit(":\n"), _example(e, reasoned))), "\n\n")


def user_prompt(strategy: Column, question: Column, examples: Column, variant: Column, reasoned: bool) -> Column:
    """The prompt of a strategy; without examples the example strategies fall back.

    The step-by-step strategy has an implicit ``variant``; its fallbacks are always explicit. Examples with steps show their
    reasoning if they are ``reasoned``, which is that they have the field.
    """
    count = F.size(examples).cast("string")
    has = F.size(examples) > 0
    steps = F.when((strategy == "cot") & (variant == "implicit"), pt.COT_IMPLICIT_SUFFIX).otherwise(pt.COT_SUFFIX)
    return (
        F.when((strategy == "one-shot") & has, fill(pt.ONE_SHOT, _example(F.get(examples, F.lit(0))), question))
        .when((strategy == "few-shot") & has, fill(pt.FEW_SHOT, count, _numbered(examples, False), question))
        .when((strategy == "few-shot-cot") & has, fill(pt.FEW_SHOT_COT, count, _numbered(examples, reasoned), question))
        .when(strategy.isin("cot", "few-shot-cot", "self-consistency"), F.concat(question, steps))
        .when(strategy == "least-to-most", fill(pt.LEAST_TO_MOST, question))
        .when(strategy == "react", fill(pt.REACT, question))
        .otherwise(question)
    )


def prompt_label(strategy: Column, has_examples: Column) -> Column:
    """The strategy a prompt really follows after the fallbacks."""
    return (
        F.when(strategy.isin("one-shot", "few-shot") & ~has_examples, fv.BASELINE_STRATEGY)
        .when((strategy == "few-shot-cot") & ~has_examples, "cot")
        .when(strategy == "self-consistency", "cot")
        .otherwise(strategy)
    )


def render_prompts(planned: DataFrame, style: str = pt.DEFAULT_STYLE) -> DataFrame:
    """System and user prompt of planned rows.

    ``planned`` has prompt_strategy, question_text, schema_fixture and examples (see ``few_shot_lookup``), and optionally cot_variant.
    """
    strategy = F.col("prompt_strategy")
    variant = F.col("cot_variant") if "cot_variant" in planned.columns else F.lit("explicit")
    question = with_schema(F.col("question_text"), F.col("schema_fixture"))
    reasoned = "reasoning" in planned.schema["examples"].dataType.elementType.fieldNames()
    return planned.withColumns({
        "system_prompt": system_prompt(strategy, F.lit(style)),
        "user_prompt": user_prompt(strategy, question, F.col("examples"), F.coalesce(variant, F.lit("explicit")), reasoned),
        "label": prompt_label(strategy, F.size("examples") > 0),
    }).drop("question_text", "schema_fixture", "examples", "cot_variant")


def reference_for_judge(text: Column) -> Column:
    """A reference as the judge sees it; cut before texts are joined."""
    return cut(text, pt.REFERENCE_CHAR_LIMIT, pt.REFERENCE_NOTE)


def answer_for_judge(text: Column) -> Column:
    return cut(text, pt.ANSWER_CHAR_LIMIT, pt.ANSWER_NOTE)


def judge_prompts(rows: DataFrame) -> DataFrame:
    """The judge's prompt of every answer.

    ``rows`` has question_text, tags, the reference and the answer as ``reference_for_judge`` and ``answer_for_judge`` give them, and
    the optional context columns judge_hint and execution_context.
    """
    c = F.col
    rubric = F.when(tg.needs_sql_rubric(c("tags")), pt.SQL_RUBRIC).otherwise(pt.DEFAULT_RUBRIC)
    blocks = F.concat_ws(
        "\n\n",
        F.when(F.coalesce("judge_hint", F.lit("")) != "", F.concat(F.lit(pt.HINT_BLOCK), "judge_hint")),
        F.when(F.coalesce("execution_context", F.lit("")) != "", F.concat(F.lit(pt.EXECUTION_BLOCK), "execution_context")),
    )
    full_rubric = F.when(blocks == "", rubric).otherwise(F.concat(blocks, F.lit("\n\nScoring Rubric:\n"), rubric))

    def given(text, default):
        return F.coalesce(F.nullif(text, F.lit("")), F.lit(default))

    reference = given(c("reference"), pt.NO_REFERENCE)
    answer = given(c("answer"), pt.NO_ANSWER)
    prompt = fill(pt.JUDGE_PROMPT, c("question_text"), reference, answer, full_rubric)
    return rows.select("answer_id", F.lit(pt.JUDGE_SYSTEM_PROMPT).alias("system_prompt"), prompt.alias("judge_prompt"))


def contest_prompts(labelled: DataFrame, question: Column, reference: Column) -> DataFrame:
    """The judge's prompt of every contest as numbered parts, whatever its size.

    ``labelled`` has contest_id, label, label_no, entrants and answer (see ``anonymise_contest``). Part 0
    opens the prompt, one part per answer follows, the last part closes it; their texts
    in order of ``part`` are the prompt. No row or task holds a contest.
    """
    # the answers stand between the two pieces that the answers' place divides
    before, after = _around(pt.CONTEST_PROMPT, 3)
    count = F.col("entrants").cast("string")
    given = F.coalesce(F.nullif(reference, F.lit("")), F.lit(pt.NO_CONTEST_REFERENCE))
    answer = F.concat(
        F.when(F.col("label_no") > 1, F.lit("\n\n")).otherwise(F.lit("")), F.lit("Answer "), F.col("label"), F.lit(":\n"),
        F.coalesce(F.nullif("answer", F.lit("")), F.lit(pt.NO_ANSWER)),
    )

    def part(number, text):
        return F.struct(number.cast("long").alias("part"), text.alias("text"))

    body = part(F.col("label_no"), answer)
    frame = F.array(part(F.lit(0), fill(before, count, question, given)), body, part(F.col("entrants") + 1, fill(after, count, count)))
    parts = F.when(F.col("label_no") == 1, frame).otherwise(F.array(body))
    return labelled.select("contest_id", F.inline(parts)).withColumn("system_prompt", F.lit(pt.JUDGE_SYSTEM_PROMPT))


def _around(template: str, place: int) -> tuple[str, str]:
    """The template before and after one of its places, counted from 0."""
    pieces = template.split("%s")
    return "%s".join(pieces[: place + 1]), "%s".join(pieces[place + 1:])
