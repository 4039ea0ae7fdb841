"""All queries of the engine; importing the modules registers them."""

from __future__ import annotations

from loomquery.plans import affinity, archive, assets, hierarchy, jobs, ranking, scoring, search, soft, streams, structure, textual, vectors  # noqa: F401
from loomquery.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL
