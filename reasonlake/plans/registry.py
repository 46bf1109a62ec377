"""All registered queries outside the llm subpackage, each with its SQL."""

from __future__ import annotations

from . import cell_queries, detection_queries, path_queries, run_queries, session_queries, source_queries, stream_queries

MODULES = (detection_queries, path_queries, session_queries, cell_queries, run_queries, source_queries, stream_queries)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    from .fixtures import sql

    return {k: sql(s.strip()) for m in MODULES for k, s in m.SQL.items()}
