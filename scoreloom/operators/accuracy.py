"""Result-set accuracy of candidate queries against expected rows.

Rows are maps of column name to value text. A value in plain numeric form (no leading zeros, no
suffix) is compared as a number of any length, so 5 and 5.0 are equal; all others are compared as text.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.functions.numbers import harmonic, ratio, report_round

MISSING = "\u0000null"
WHOLE = r"-?(?:0|[1-9][0-9]*)(?:[.][0-9]+)?"
PLAIN, SCIENTIFIC = rf"^{WHOLE}$", rf"^{WHOLE}[eE][+-]?[0-9]+$"
FOUR_PLACES = r"^-?(?:0|[1-9][0-9]{0,25})(?:[.][0-9]{1,4})?$"  # rounding to four places changes nothing


def _shortest(number: Column) -> Column:
    """Digits without zeros that carry nothing: 5.0 and 5 read 5, -0 reads 0."""
    short = F.when(F.contains(number, F.lit(".")), F.rtrim(F.rtrim(number, F.lit("0")), F.lit("."))).otherwise(number)
    return F.when(short == "-0", F.lit("0")).otherwise(short)


def _plain(value: Column) -> Column:
    wide = value.try_cast("decimal(38,18)").cast("string")
    return F.coalesce(
        F.when(value.rlike(PLAIN), _shortest(value)).when(value.rlike(SCIENTIFIC), _shortest(wide)), value, F.lit(MISSING)
    )


def _rounded(value: Column) -> Column:
    number = F.when(value.rlike(PLAIN) | value.rlike(SCIENTIFIC), F.round(value.try_cast("decimal(38,12)"), 4))
    return F.coalesce(F.when(value.rlike(FOUR_PLACES), _shortest(value)), _shortest(number.cast("string")), value, F.lit(MISSING))


def _digest(values: Column) -> Column:
    """128 bits from two differently seeded hashes: fixed width, and no text to build."""
    return F.struct(F.xxhash64(values).alias("a"), F.xxhash64(F.lit(1), values).alias("b"))


def row_key(row: Column) -> Column:
    """Digest of a row as a set of (column, value) pairs, whatever their order."""
    pairs = F.transform(F.map_entries(row), lambda e: F.struct(e["key"].alias("k"), _plain(e["value"]).alias("v")))
    return _digest(F.sort_array(pairs))


def value_key(row: Column) -> Column:
    """Digest of a row as a set of values without names, numbers rounded to four places."""
    values = F.transform(F.map_values(row), _rounded)
    return _digest(F.sort_array(F.array_distinct(values)))


KEYS = {"names": row_key, "values": value_key}


def _sides(returned: DataFrame, expected: DataFrame, kinds) -> DataFrame:
    def side(df, is_returned):
        keys = F.array(*[F.struct(F.lit(kind).alias("kind"), KEYS[kind](F.col("row")).alias("key")) for kind in kinds])
        return df.select("case_id", F.explode(keys).alias("k")).select(
            "case_id", "k.kind", "k.key.a", "k.key.b",
            F.lit(is_returned).alias("returned"), F.lit(not is_returned).alias("expected"),
        )

    return side(returned, True).unionByName(side(expected, False))


def set_counts(returned: DataFrame, expected: DataFrame, kinds=tuple(KEYS)) -> DataFrame:
    """Sizes of both row sets and of their common part, by names and by values alone, or by one of these ``kinds``.

    One pass: the narrow (case, digest) rows are deduplicated by a grouped
    aggregate and counted by another; the two sides are never joined.
    """
    rows = _sides(returned, expected, kinds).groupBy("case_id", "kind", "a", "b").agg(
        F.max("returned").alias("returned"), F.max("expected").alias("expected")
    )

    def count(kind, condition):
        return F.count_if((F.col("kind") == kind) & condition)

    r, e = F.col("returned"), F.col("expected")
    return rows.groupBy("case_id").agg(*[
        count(kind, cond).alias(f"{kind}_{name}")
        for kind in kinds
        for name, cond in {"common": r & e, "returned": r, "expected": e}.items()
    ])


def _scores(kind: str) -> tuple[Column, Column, Column]:
    common, returned, expected = (F.col(f"{kind}_{n}") for n in ("common", "returned", "expected"))
    precision, recall = ratio(common, returned), ratio(common, expected)
    return precision, recall, harmonic(precision, recall)


def result_set_f1(returned: DataFrame, expected: DataFrame, by_values: bool = False) -> DataFrame:
    """Precision, recall and F1 of every case as sets of rows.

    ``by_values`` lets a zero F1 of two non-empty sets rise to the F1 of the
    values alone, which forgives renamed columns.
    """
    counts = set_counts(returned, expected, tuple(KEYS) if by_values else ("names",))
    picked = named = _scores("names")
    if by_values:
        valued = _scores("values")
        upgrade = (named[2] == 0) & (valued[2] > 0)
        picked = [F.when(upgrade, v).otherwise(n) for n, v in zip(named, valued)]
    picked = [report_round(p, 4) for p in picked]
    return counts.select(
        "case_id", picked[0].alias("precision"), picked[1].alias("recall"), picked[2].alias("f1"),
        F.col("names_returned").alias("returned_count"), F.col("names_expected").alias("expected_count"),
    )


NO_SQL, NO_ROWS, ALL_FAILED = "No SQL found in answer", "Missing SQL or expected rows", "All SQL candidates failed to execute"


def pick_candidate(cases: DataFrame, candidates: DataFrame, expected: DataFrame) -> DataFrame:
    """The candidate that counts for each case, or why none does.

    The first candidate with exactly the expected columns wins, else the first
    that ran. ``candidates`` holds case_id, candidate_idx, ok and columns (sorted
    names, empty for an empty result).
    """
    # every expected row of a case has the same columns, so any row will do
    wanted = expected.groupBy("case_id").agg(
        F.min(F.sort_array(F.map_keys("row"))).alias("wanted"), F.lit(True).alias("has_rows")
    )
    preference = F.struct((F.sort_array("columns") != F.col("wanted")).alias("other"), "candidate_idx")
    picks = candidates.join(wanted, "case_id", "left").groupBy("case_id").agg(
        F.min_by("candidate_idx", F.when(F.col("ok") & F.col("has_rows"), preference)).alias("chosen_idx"), F.lit(True).alias("tried"),
    )
    return (
        cases.join(wanted, "case_id", "left").join(picks, "case_id", "left")
        .select(
            "case_id", "chosen_idx",
            F.when(F.col("wanted").isNull(), NO_ROWS)
            .when(F.col("tried").isNull(), NO_SQL)
            .when(F.col("chosen_idx").isNull(), ALL_FAILED).alias("error"),
        )
    )


def candidate_accuracy(
    cases: DataFrame, candidates: DataFrame, candidate_rows: DataFrame, expected: DataFrame
) -> DataFrame:
    """F1 of the picked candidate of every case; null where the answer holds no SQL."""
    picks = pick_candidate(cases, candidates, expected)
    chosen = candidate_rows.join(
        picks.filter(F.col("chosen_idx").isNotNull())
        .select("case_id", F.col("chosen_idx").alias("candidate_idx")),
        ["case_id", "candidate_idx"], "left_semi",
    )
    scores = result_set_f1(chosen, expected, by_values=True).select("case_id", "f1")
    f1 = F.when(F.col("error") == NO_SQL, F.lit(None)).otherwise(
        F.when(F.col("error").isNull(), F.coalesce("f1", F.lit(0.0))).otherwise(F.lit(0.0))
    )
    return picks.join(scores, "case_id", "left").select("case_id", "chosen_idx", "error", f1.alias("f1"))
