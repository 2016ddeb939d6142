"""Evaluation tables derived from the driver tables.

Each mart is a lazy projection of one or two driver tables, so filters and
column pruning of a query still reach the Parquet scan.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scoreloom.functions import fixed_values as fv
from scoreloom.functions.pillars import composite

LINE_STRATEGY = {
    "NO": "zero-shot", "NF": "few-shot", "AF": "cot",
    "AO": "few-shot-cot", "RF": "role-prompting", "RO": "react",
}
PROVIDERS = ["openai", "anthropic", "google", "groq"]
SQL_FENCE = "\n```sql\n"


def choose(value: Column, options: dict, default=None) -> Column:
    """CASE over literal options."""
    expr = None
    for key, result in options.items():
        result = result if isinstance(result, Column) else F.lit(result)
        expr = F.when(value == key, result) if expr is None else expr.when(value == key, result)
    return expr if default is None else expr.otherwise(default)


class Marts:
    """The evaluation tables over one folder of driver tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def spread(self, name: str) -> DataFrame:
        """A driver table over all cores.

        Only a table with fewer splits than cores is spread: the small test files
        have one split each. A large table is read as it is.
        """
        table, cores = self.raw(name), self.spark.sparkContext.defaultParallelism
        if table.isStreaming or table.rdd.getNumPartitions() >= cores:
            return table
        return table.repartition(cores)

    def texts(self) -> DataFrame:
        return self.spread("documents")

    def lines(self) -> DataFrame:
        return self.spread("lineitem")

    # --- dimensions -----------------------------------------------------------

    def topics(self) -> DataFrame:
        return self.raw("region").select(
            F.col("r_regionkey").alias("topic_id"), F.col("r_name").alias("topic")
        )

    def subtopics(self) -> DataFrame:
        return self.raw("nation").select(
            F.col("n_nationkey").alias("subtopic_id"),
            F.col("n_name").alias("subtopic"),
            F.col("n_regionkey").alias("topic_id"),
        )

    def models(self) -> DataFrame:
        key = F.col("s_suppkey")
        return self.raw("supplier").select(
            key.alias("model_id"),
            F.col("s_name").alias("display_name"),
            choose(F.col("s_nationkey") % 4, dict(enumerate(PROVIDERS))).alias("provider"),
            ((key % 5 + 1) * 0.001).alias("cost_per_1k_input"),
            ((key % 7 + 1) * 0.002).alias("cost_per_1k_output"),
        )

    def questions(self) -> DataFrame:
        """Orders as questions; the customer's nation is the subtopic."""
        urgency = F.substring("o_orderpriority", 1, 1)
        customers = self.raw("customer").select("c_custkey", "c_nationkey")
        return self.raw("orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
            F.col("o_orderkey").alias("question_id"),
            F.col("c_nationkey").alias("subtopic_id"),
            choose(urgency, {"1": "hard", "2": "hard", "3": "medium"}, "easy").alias("difficulty"),
            F.when(F.col("o_orderstatus") == "F", "practical").otherwise("conceptual")
            .alias("question_type"),
            choose(urgency, {
                "1": F.array(F.lit("sql")),
                "2": F.array(F.lit("sql"), F.lit("transactions")),
                "3": F.array(F.lit("transactions")),
                "4": F.array(F.lit("normalization")),
            }, F.array(F.lit("database_concepts"))).alias("tags"),
            F.col("o_orderdate").alias("created_at"),
        )

    # --- facts ----------------------------------------------------------------

    def _run_id(self) -> Column:
        # the line keys alone repeat in the driver tables
        day = F.date_format("l_shipdate", "yyyyMMdd")
        return F.concat_ws("-", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", day)

    def runs(self) -> DataFrame:
        price, part = F.col("l_extendedprice"), F.col("l_partkey")
        latency = price / 20
        return self.raw("lineitem").select(
            self._run_id().alias("run_id"),
            F.col("l_orderkey").alias("question_id"),
            F.col("l_suppkey").alias("model_id"),
            choose(F.concat("l_returnflag", "l_linestatus"), LINE_STRATEGY).alias("prompt_strategy"),
            F.concat(
                F.lit('{"temperature": '), F.col("l_tax").cast("string"),
                F.lit(', "top_p": '), F.col("l_discount").cast("string"), F.lit("}"),
            ).alias("hyperparams"),
            (part % 900 + 100).cast("int").alias("input_tokens"),
            (F.col("l_quantity") * 20).cast("int").alias("output_tokens"),
            latency.alias("total_latency_ms"),
            (part % 3 == 0).cast("int").alias("retry_count"),
            F.col("l_shipdate").alias("run_timestamp"),
            F.when(F.col("l_quantity") <= 2, "failed").otherwise("completed").alias("status"),
            F.col("l_linenumber").cast("int").alias("attempt"),
        )

    def judge_scores(self) -> DataFrame:
        """Stored score rows; runs with a small quantity are not scored."""
        quantity, part = F.col("l_quantity"), F.col("l_partkey")
        db, quality = quantity * 2, F.col("l_discount") * 1000
        prompting, eff = F.col("l_tax") * 1250, F.least(F.lit(100.0), F.col("l_extendedprice") / 1050)
        return self.raw("lineitem").filter(quantity > 5).select(
            self._run_id().alias("run_id"),
            (quantity / 5).alias("judge_score_0_10"),
            db.alias("db_correctness_score"),
            quality.alias("llm_quality_score"),
            prompting.alias("prompting_effectiveness_score"),
            eff.alias("efficiency_score"),
            composite(db, quality, prompting, eff).alias("master_composite_score"),
            ((part % 5) / 4.0).alias("format_compliance_score"),
            ((part % 4) / 4.0).alias("hallucination_rate"),
            (F.col("l_discount") * 10).alias("factual_correctness"),
            (F.col("l_tax") / 0.08).alias("completeness"),
            (1 - F.col("l_discount") * 5).alias("absence_of_contradiction"),
            (F.col("l_linenumber") / 7.0).alias("topic_specificity"),
            (part % 11 / 10.0).alias("result_set_f1"),
            F.when(part % 3 != 0, ((part % 2) * 1.0)).alias("syntactic_parse_success"),
            (part % 7 / 7.0).alias("idiomatic_postgresql"),
            (part % 6 == 0).alias("has_finding"),
            (part % 400 / 100.0).alias("verbosity_ratio"),
        )

    def contest_entries(self) -> DataFrame:
        """One row per contest and model, with its best price as the judged value.

        Placements share a rank where the price falls in the same thousand. A contest has one row per
        model, so the window of a contest holds at most as many rows as there are models; lines are reduced to
        those rows before they meet by contest.
        """
        contest = Window.partitionBy("contest_id")
        return (
            self.raw("lineitem").filter(F.col("l_orderkey").isNotNull())
            .groupBy(F.col("l_orderkey").alias("contest_id"), F.col("l_suppkey").alias("model_id"))
            .agg(F.max("l_extendedprice").alias("price"), F.min("l_shipdate").alias("seen"))
            .withColumn("step", F.floor(F.col("price") / 1000))
            .select(
                "contest_id", "model_id", "step",
                F.rank().over(contest.orderBy(F.col("step").desc())).alias("placement"),
                F.count(F.lit(1)).over(contest).alias("entrants"),
                F.min("seen").over(contest).alias("contest_ts"),
            )
            .filter((F.col("entrants") >= 2) & F.col("step").isNotNull()).drop("step")
        )

    def contest_log(self) -> DataFrame:
        """Contest entries with the league they count for (the customer's nation)."""
        leagues = self.questions().select(
            F.col("question_id").alias("contest_id"), F.col("subtopic_id").alias("league")
        )
        return self.contest_entries().join(leagues, "contest_id")

    # --- answer texts ---------------------------------------------------------

    def answers(self) -> DataFrame:
        """Documents as answers; a suffix or prefix by doc_id adds SQL, steps and claims."""
        doc, text = F.col("doc_id"), F.col("text")
        decorated = choose(doc % 12, {
            0: F.concat(text, F.lit(DECORATION[0])),
            1: F.concat(F.lit(DECORATION[1]), text),
            2: F.concat(F.lit(DECORATION[2]), text),
            3: F.concat(text, F.lit(DECORATION[3])),
            4: F.concat(text, F.lit(DECORATION[4])),
            5: F.concat(text, F.lit(DECORATION[5])),
            6: F.concat(F.lit(DECORATION[6]), text),
            7: F.concat(F.lit(DECORATION[7]), doc.cast("string"), F.lit("}\n```")),
            8: F.concat(text, F.lit(DECORATION[8])),
            9: F.concat(text, F.lit(DECORATION[9])),
            10: F.concat(text, F.lit(DECORATION[10])),
        }, text)
        bucket = F.floor(doc / 9).cast("long")
        return self.texts().select(
            doc.alias("answer_id"),
            bucket.alias("question_id"),
            F.col("lang").alias("model_id"),
            choose(doc % 9, dict(enumerate(fv.STRATEGIES))).alias("prompt_strategy"),
            F.when(bucket % 2 == 0, "practical").otherwise("conceptual").alias("question_type"),
            choose(bucket % 5, {
                0: F.array(F.lit("sql")),
                1: F.array(F.lit("sql"), F.lit("transactions")),
                2: F.array(F.lit("transactions")),
                3: F.array(F.lit("normalization")),
            }, F.array(F.lit("database_concepts"))).alias("tags"),
            choose(doc % 3, {
                0: "Answer in one paragraph.", 1: "List 3 key points about it.",
            }).alias("length_instruction"),
            decorated.alias("answer"),
            F.col("source"),
            F.col("n_chars"),
        )

    def answer_runs(self) -> DataFrame:
        """The answers with run telemetry made from their length."""
        size = F.col("n_chars")
        return self.answers().withColumns({
            "hyperparams": F.lit("{}"),
            "total_latency_ms": F.when(size % 10 == 0, F.lit(0.0)).otherwise(size * 2.0),
            "ttft_ms": size * 0.3,
            "tokens_per_second": (size % 300).cast("double"),
            "cost_usd": size % 7 * 0.004,
        }).drop("source", "n_chars", "length_instruction")

    def harness(self) -> DataFrame:
        """Outcome of the answers' SQL: parse success and F1, null F1 where there is no SQL."""
        doc, size = F.col("doc_id"), F.col("n_chars")
        return self.texts().select(
            doc.alias("answer_id"),
            F.when(size % 3 != 0, (size % 2).cast("double")).alias("syntactic_parse_success"),
            F.when((doc % 12).isin(0, 8, 9, 10), size % 11 / 10.0).alias("result_set_f1"),
        )

    def references(self) -> DataFrame:
        """Expected answers of the questions, for those that have one."""
        return self.raw("benchmark").select(
            F.col("item_id").alias("question_id"), F.col("text").alias("expected_answer")
        )

    def judge_replies(self) -> DataFrame:
        """Raw judge replies for the labelled documents, some fenced, wrapped or broken."""
        doc, quality, toxic = F.col("doc_id"), F.col("quality"), F.col("toxic")
        body = F.concat(
            F.lit('{"score": '), (quality * 5 + doc % 5).cast("string"),
            F.lit(', "factual_correctness": '), (doc % 10 / 10.0).cast("string"),
            F.lit(', "completeness": '), (doc % 7 / 8.0).cast("string"),
            F.when(toxic == 1, F.lit(
                ', "hallucinations": [{"type": "contradiction", "text": "claim", "severity": "medium"}]'
            )).otherwise(F.lit("")),
            F.lit("}"),
        )
        reply = choose(doc % 6, {
            1: F.concat(F.lit("```json\n"), body, F.lit("\n```")),
            2: F.concat(F.lit("My verdict: "), body, F.lit(" as asked")),
            3: F.concat(F.lit("score is high {"), quality.cast("string")),
            4: F.when(doc % 24 == 4, F.lit(BROKEN_REPLIES[0])).when(doc % 24 == 10, F.lit(BROKEN_REPLIES[1])).otherwise(body),
        }, body)
        return self.raw("labels").select(doc.alias("answer_id"), reply.alias("reply"))

    def perturbable(self) -> DataFrame:
        """Documents as questions that the perturbation rules apply to."""
        doc, text = F.col("doc_id"), F.col("text")
        return self.texts().select(
            doc.alias("question_id"),
            choose(doc % 8, {
                i: F.concat(F.lit(head), text, F.lit(tail)) for i, (head, tail) in QUESTION_FRAMES.items()
            }).alias("question_text"),
        )

    def bank(self) -> DataFrame:
        """Documents as raw bank questions with a subtopic and an optional exercise prefix."""
        doc, text = F.col("doc_id"), F.col("text")
        prefixed = choose(doc % 4, {
            0: F.concat(F.lit("Exercise 3."), (doc % 10).cast("string"), F.lit(": "), text),
            1: F.concat(F.lit("## exercise 4."), (doc % 7).cast("string"), F.lit("\n\n"), text),
        }, text)
        subtopics = dict(enumerate([*fv.SUBTOPIC_TYPES, "OTHER"]))
        return self.texts().select(
            doc.alias("question_id"), choose(doc % len(subtopics), subtopics).alias("subtopic"),
            prefixed.alias("question_text"),
        )

    def example_questions(self) -> DataFrame:
        """Documents as questions of a few-shot store; some have no expected answer."""
        doc = F.col("doc_id")
        return self.texts().select(
            doc.alias("question_id"),
            F.col("source").alias("subtopic_id"),
            choose(F.col("n_chars") % 3, dict(enumerate(fv.DIFFICULTIES))).alias("difficulty"),
            F.col("text").alias("question_text"),
            F.when(F.col("n_chars") % 4 != 0, F.concat(F.lit("Answer of "), F.col("lang"), F.lit(" "), doc.cast("string")))
            .alias("expected_answer"),
            F.when(doc % 10 == 0, F.lit(SCHEMA_FIXTURE)).alias("schema_fixture"),
        )

    # --- result sets ------------------------------------------------------------

    def candidate_rows(self) -> DataFrame:
        """Rows returned by up to three candidate queries per order, some with renamed columns."""
        order, name = F.col("l_orderkey"), F.col("value_name")
        index = choose(F.col("l_returnflag"), {"A": 0, "N": 1}, F.lit(2))
        return self.lines().select(
            order.alias("case_id"), index.alias("candidate_idx"),
            F.when((order + index) % 3 == 0, "qty").otherwise("amount").alias("value_name"),
            F.col("l_partkey").cast("string").alias("part"), F.col("l_quantity").alias("quantity"),
        ).select(
            "case_id", "candidate_idx", "value_name", "quantity",
            F.create_map(F.lit("part"), F.col("part"), name, F.col("quantity").cast("string")).alias("row"),
        )

    def candidates(self) -> DataFrame:
        """Candidate queries; one fails where any quantity is tiny."""
        return self.candidate_rows().groupBy("case_id", "candidate_idx").agg(
            (F.min("quantity") > 3).alias("ok"),
            F.array(F.lit("part"), F.min("value_name")).alias("columns"),
        )

    def expected_rows(self) -> DataFrame:
        quantity = F.col("l_quantity") + F.when(F.col("l_linenumber") % 4 == 0, 1).otherwise(0)
        return self.lines().filter(F.col("l_linestatus") == "F").select(
            F.col("l_orderkey").alias("case_id"),
            F.create_map(F.lit("part"), F.col("l_partkey").cast("string"), F.lit("qty"), quantity.cast("string")).alias("row"),
        )

    def sheet(self) -> DataFrame:
        """Pages as rows of a question sheet: topic only on every fifth row."""
        page = F.col("page_id")
        title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
        return self.raw("pages").select(
            page.alias("row_no"),
            F.when(page % 5 == 0, F.concat(F.lit(" topic "), (page / 5).cast("long").cast("string")))
            .alias("topic"),
            F.when(page % 7 == 3, F.lit("  ")).otherwise(
                F.concat(F.lit("sub "), (page % 11).cast("string"), F.lit(" "))
            ).alias("subtopic"),
            F.when(page % 3 == 0, F.concat(
                F.lit('questions = ["Exercise '), (page % 9).cast("string"), F.lit('.1: What is it?", "'),
                F.regexp_replace(title, r'["\\]', ""), F.lit('", " "]'),
            )).otherwise(title).alias("questions"),
            F.when(page % 3 == 0, F.lit('["first answer"]')).otherwise(F.lit("plain answer")).alias("answers"),
        )


# Replies with a field that is no number.
BROKEN_REPLIES = ['{"score": "8/10", "completeness": 0.5}', '{"score": 7, "completeness": "high"}']

# Texts added to the driver documents, by doc_id % 12.
DECORATION = {
    0: "\n\n```sql\nSELECT a, count(*) FROM t GROUP BY a;\n```\nDone.",
    1: "1. Identify the keys\n2) Apply the rules\nStep 3: conclude\n",
    2: "(1) Only one step here\n",
    3: "\nCREATE TABLE emp (id int);\nALTER TABLE emp ADD FOREIGN KEY (did) REFERENCES dept;\n",
    4: "\nUse a TEMPORAL KEY together with a sequential  index.",
    5: "\nCall pg_fake(1), MY_FUNC (2), lower(x), pg_table_size(t), foo(3) and MY_FUNC(4).",
    6: "Note: 2PL guarantees no deadlock and B+ tree insertion is O(1).\n",
    7: '```json\n{"id": ',
    8: "\nWITH x AS (SELECT 1::int) INSERT INTO t SELECT * FROM x ON CONFLICT DO NOTHING RETURNING id;",
    9: "\nselect cast(a AS int) from (select a from t) s; select 2",
    10: "\n```sql\n-- first\nthis line is only prose and rather long\nSELECT 1\n"
        "another line that says nothing useful\n```\nThen:\n```sql\nSELECT name, age FROM emp\n```",
}

# Texts around the driver documents, by doc_id % 8, for the perturbation rules.
QUESTION_FRAMES = {
    0: ("What is ", "?"),
    1: ("how does ", " of employees and a department?"),
    2: ("Define ", " for every student and customer"),
    3: ("List (alpha, beta , gamma) of ", " salary"),
    4: ("Parts:\n1. one\n2. two\n 3. three ", "\n"),
    5: ("A Transaction with a constraint is not ", " what it does?"),
    6: ("Explain sid and eid ", " are not, do"),
    7: ("", ""),
}
SCHEMA_FIXTURE = "CREATE TABLE t (\n  id INTEGER PRIMARY KEY,\n  name varchar(10)\n);\nINSERT INTO t VALUES (1, 'a');\nCHECK (1)"
