"""Every query on the reference's own operators, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from .plans import citation_queries, fold_queries, logic_queries, lowering_queries, measure_queries, model_queries, relation_queries, repair_queries, routing_queries, score_queries, source_queries, text_queries  # noqa: F401  they register themselves
from .plans.registry import QUERIES, SQL


def queries() -> dict[str, Callable]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
