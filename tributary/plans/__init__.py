"""Registered queries and their SQL twins."""

from tributary.plans import core, graphs, risk  # noqa: F401  they register their queries
from tributary.plans.registry import QUERIES, SQL


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
