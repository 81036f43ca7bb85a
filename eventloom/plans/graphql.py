"""A small GraphQL reader: { events(entity_id: "...", event_type: "...", limit: 10) { id event_type } } as an EventQuery."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.operators.filters import EventQuery, query

FIELDS = ("id", "event_type", "entity_id", "tenant_id", "payload", "timestamp", "metadata", "version")
ARGUMENTS = {"entity_id": str, "event_type": str, "tenant_id": str, "since": str, "until": str, "limit": int}


def parse(text: str) -> tuple[EventQuery, list[str]]:
    """The query and its fields; no variables, aliases or fragments. Unknown fields are left out, none stands for all."""
    found = re.fullmatch(r"\s*(?:query\b[^{]*)?\{\s*events\s*(?:\((.*?)\))?\s*(?:\{([^{}]*)\})?\s*\}\s*", text, flags=re.S)
    if not found:
        raise ValueError("expected { events(arguments) { fields } }")
    arguments = {}
    for name, quoted, plain in re.findall(r'(\w+)\s*:\s*(?:"((?:[^"\\]|\\.)*)"|([\w.-]+))', found[1] or ""):
        if name not in ARGUMENTS:
            raise ValueError(f"no such argument: {name}")
        arguments[name] = ARGUMENTS[name](plain or quoted)
    wanted = [f for f in re.findall(r"\w+", found[2] or "") if f in FIELDS]
    return EventQuery(**arguments), wanted or list(FIELDS)


def run(events: DataFrame, text: str) -> DataFrame:
    """One JSON object per event, with the named fields."""
    q, fields = parse(text)
    return query(events, q).select(F.to_json(F.struct(*fields)).alias("event"))
