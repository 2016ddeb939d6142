"""Small numeric expressions used by every report."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Bound a value; a null counts as the lower bound."""
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(value, F.lit(low))))


def report_round(value: Column, digits: int) -> Column:
    """Round half up for a report.

    The inner rounding drops the noise in the last bits of a floating sum, so
    the figure does not depend on the order in which tasks were merged.
    """
    return F.round(F.round(value.cast("double"), 9), digits)


def weighted(weights: dict, parts: dict) -> Column:
    """Sum of weight x part, in the order of the weights, bounded to 0..1."""
    total = None
    for name, weight in weights.items():
        term = F.lit(weight) * parts[name]
        total = term if total is None else total + term
    return clamp(total)


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom, 0 where the bottom is 0."""
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top / bottom)


def harmonic(precision: Column, recall: Column) -> Column:
    """F1 of precision and recall, 0 where both are 0."""
    return ratio(2 * precision * recall, precision + recall)
