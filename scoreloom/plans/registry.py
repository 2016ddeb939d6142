"""All registered queries and their SQL."""

from scoreloom.plans import (
    bank_queries, compare_queries, plan_queries, rating_queries, report_queries, scan_queries, score_queries,
    stream_queries,
)

MODULES = [
    report_queries, scan_queries, score_queries, compare_queries, rating_queries, bank_queries, plan_queries,
    stream_queries,
]


def queries() -> dict:
    return {name: fn for module in MODULES for name, fn in module.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
