"""Every query of the engine's own operators over the driver's tables, with its SQL."""

from __future__ import annotations

from eventloom.plans import catalog_events, catalog_graph, catalog_more, catalog_reads, catalog_search, catalog_sql, catalog_state

PARTS = (catalog_events, catalog_state, catalog_search, catalog_graph, catalog_sql, catalog_more, catalog_reads)


def queries() -> dict:
    return {k: q for part in PARTS for k, (q, _) in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for part in PARTS for k, (_, sql) in part.QUERIES.items() if sql}
