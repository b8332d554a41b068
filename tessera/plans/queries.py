"""All queries of the engine and their SQL."""

from __future__ import annotations

from . import file_queries, graph_queries, image_queries, layout_queries, metadata_queries, table_queries  # noqa: F401  they register
from .registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
