"""Reads of the event table: filters, time travel, patterns, paging. Every function is a Column or a DataFrame, no action."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDER = ("timestamp", "version", "id")


def valid_from() -> Column:
    """When an event began to hold: valid_from, or else the time of its record."""
    return F.coalesce("valid_from", "timestamp")


def as_of(when) -> Column:
    """Recorded by then, inclusive."""
    return F.col("timestamp") <= F.lit(when)


def as_of_valid(when) -> Column:
    """Held then: from valid_from, inclusive, to valid_to, exclusive."""
    return (valid_from() <= F.lit(when)) & (F.col("valid_to").isNull() | (F.col("valid_to") > F.lit(when)))


def json_equal(column: str, key: str, value) -> Column:
    """Top-level member key of a JSON text equals value, by JSON type; a missing member equals nothing."""
    got = F.variant_get(F.try_parse_json(F.col(column)), f"$.{key}", "variant")
    kind = F.schema_of_variant(got)
    if value is None:
        return F.is_variant_null(got) & got.isNotNull()
    if isinstance(value, bool):
        return (kind == "BOOLEAN") & (F.try_variant_get(F.try_parse_json(F.col(column)), f"$.{key}", "boolean") == F.lit(value))
    if isinstance(value, (int, float)):
        number = kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL")
        return number & (F.try_variant_get(F.try_parse_json(F.col(column)), f"$.{key}", "double") == F.lit(float(value)))
    if isinstance(value, str):
        return (kind == "STRING") & (F.try_variant_get(F.try_parse_json(F.col(column)), f"$.{key}", "string") == F.lit(value))
    return F.to_json(got) == F.lit(json.dumps(value, separators=(",", ":")))


@dataclass(frozen=True)
class EventQuery:
    """A read of the event table. A prefix wins over an exact type; exclusions and payload filters hold before the limit."""

    tenant_id: str | None = None
    entity_id: str | None = None
    event_type: str | None = None
    event_type_prefix: str | None = None
    exclude_event_type_prefix: str | None = None  # comma-separated
    since: object = None
    until: object = None
    as_of: object = None
    as_of_valid: object = None
    since_valid: object = None
    until_valid: object = None
    payload_filter: dict = field(default_factory=dict)
    limit: int | None = None
    offset: int = 0
    descending: bool = False

    def condition(self) -> Column:
        parts = [F.lit(True)]
        if self.tenant_id is not None:
            parts.append(F.col("tenant_id") == self.tenant_id)
        if self.entity_id is not None:
            parts.append(F.col("entity_id") == self.entity_id)
        if self.event_type_prefix is not None:
            parts.append(F.col("event_type").startswith(self.event_type_prefix))
        elif self.event_type is not None:
            parts.append(F.col("event_type") == self.event_type)
        for prefix in filter(None, (self.exclude_event_type_prefix or "").split(",")):
            parts.append(~F.col("event_type").startswith(prefix.strip()))
        if self.since is not None:
            parts.append(F.col("timestamp") >= F.lit(self.since))
        if self.until is not None:
            parts.append(F.col("timestamp") <= F.lit(self.until))
        if self.as_of is not None:
            parts.append(as_of(self.as_of))
        if self.as_of_valid is not None:
            parts.append(as_of_valid(self.as_of_valid))
        if self.since_valid is not None:
            parts.append(valid_from() >= F.lit(self.since_valid))
        if self.until_valid is not None:
            parts.append(valid_from() <= F.lit(self.until_valid))
        parts += [json_equal("payload", k, v) for k, v in self.payload_filter.items()]
        return reduce(lambda a, b: a & b, parts)


def query(events: DataFrame, q: EventQuery) -> DataFrame:
    """The events that q selects, in the total order (timestamp, version, id) or its reverse, from offset on, at most limit."""
    out = events.where(q.condition()).orderBy(*[F.col(c).desc() if q.descending else F.col(c).asc() for c in ORDER])
    out = out.offset(q.offset) if q.offset else out
    return out.limit(q.limit) if q.limit is not None else out


def page(events: DataFrame, q: EventQuery) -> DataFrame:
    """query() with total (rows before limit and offset) and has_more on each row; the count is a second aggregate, not a window."""
    total = events.where(q.condition()).agg(F.count(F.lit(1)).alias("total"))
    rows = query(events, q)
    shown = rows.agg(F.count(F.lit(1)).alias("shown_"))
    one = total.crossJoin(shown)  # one row by one row
    return rows.join(F.broadcast(one)).withColumn("has_more", F.col("shown_") + q.offset < F.col("total")).drop("shown_")


# predicate trees ---------------------------------------------------------------------------------------------------------


def predicate(tree: dict) -> Column:
    """{"after": t} and {"before": t} (strict), {"between": [a, b]} (inclusive), {"type_prefix": p}, {"entity_prefix": p},
    {"tenant": t}, {"and": [...]} (empty: all), {"or": [...]} (empty: none)."""
    ((op, arg),) = tree.items()
    ts = F.col("timestamp")
    simple = {
        "after": lambda: ts > F.lit(arg),
        "before": lambda: ts < F.lit(arg),
        "between": lambda: (ts >= F.lit(arg[0])) & (ts <= F.lit(arg[1])),
        "type_prefix": lambda: F.col("event_type").startswith(arg),
        "entity_prefix": lambda: F.col("entity_id").startswith(arg),
        "tenant": lambda: F.col("tenant_id") == arg,
        "and": lambda: reduce(lambda a, b: a & b, map(predicate, arg), F.lit(True)),
        "or": lambda: reduce(lambda a, b: a | b, map(predicate, arg), F.lit(False)),
    }
    return simple[op]()


def dsl(op: str, column: str | None = None, value=None) -> Column:
    """The query language's predicates by name: eq ne gt gte lt lte contains in not_in between, and or not over Columns."""
    c = F.col(column) if column else None
    return {
        "eq": lambda: c == value,
        "ne": lambda: c != value,
        "gt": lambda: c > value,
        "gte": lambda: c >= value,
        "lt": lambda: c < value,
        "lte": lambda: c <= value,
        "contains": lambda: c.contains(value),
        "in": lambda: c.isin(list(value)),
        "not_in": lambda: ~c.isin(list(value)),
        "between": lambda: c.between(*value),
        "and": lambda: reduce(lambda a, b: a & b, value),
        "or": lambda: reduce(lambda a, b: a | b, value),
        "not": lambda: ~value,
    }[op]()


# type patterns -----------------------------------------------------------------------------------------------------------


def consumer_match(pattern: str) -> Column:
    """"a.*" matches a and everything below it; other patterns match themselves."""
    t = F.col("event_type")
    if pattern.endswith(".*"):
        return (t == pattern[:-2]) | t.startswith(pattern[:-1])
    return t == pattern


def websocket_match(pattern: str) -> Column:
    """"a.*" matches everything below a, not a itself; other patterns match themselves."""
    t = F.col("event_type")
    return t.startswith(pattern[:-1]) if pattern.endswith(".*") else t == pattern


def webhook_match(pattern: str) -> Column:
    """"*" matches all, "a.*" everything below a; other patterns match themselves."""
    return F.lit(True) if pattern == "*" else websocket_match(pattern)


def fan_out(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """events x subscriptions (subscription_id, pattern) that match as webhooks do.

    Patterns become join keys, so no pair is looked at that does not match: an exact type is a key, "a.*" is the key of
    every event below a, "*" is a key of every event.
    """
    parts = F.split("event_type", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.concat(F.array_join(F.slice(parts, F.lit(1), i), "."), F.lit(".*")))
    keys = F.array_distinct(F.concat(F.array("event_type", F.lit("*")), F.when(F.size(parts) > 1, above).otherwise(F.array().cast("array<string>"))))
    return events.withColumn("key_", F.explode(keys)).join(subscriptions.withColumnRenamed("pattern", "key_"), "key_").drop("key_")


# shapes ------------------------------------------------------------------------------------------------------------------


def contains_all(column: str, needles: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(column).contains(n) for n in needles], F.lit(True))


def json_path(path: str) -> str:
    """A dot path as a JSON path; numeric segments index arrays."""
    return "$" + "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in path.split("."))


def project_paths(column: str, paths: list[str]) -> list[Column]:
    """One text column per dot path, null where the path is missing."""
    return [F.get_json_object(F.col(column), json_path(p)).alias(p) for p in paths]


def payload_shape(column: str, shape: str, fields: list[str] | None = None) -> Column:
    """full: the text; keys: its top-level names; fields: an object of the named paths."""
    if shape == "keys":
        return F.json_object_keys(column)
    if shape == "fields":
        return F.to_json(F.struct(*project_paths(column, fields or [])))
    return F.col(column)


def allowed(events: DataFrame, entities: DataFrame) -> DataFrame:
    """Events of the entities that a reader may see."""
    return events.join(entities.select("entity_id").distinct(), "entity_id", "left_semi")


def namespace(event_type: str = "event_type") -> Column:
    """First segment of a type; null without a dot."""
    t = F.col(event_type)
    return F.when(t.contains("."), F.substring_index(t, ".", 1))


def action(event_type: str = "event_type") -> Column:
    """Last segment of a type; null without a dot."""
    t = F.col(event_type)
    return F.when(t.contains("."), F.substring_index(t, ".", -1))


def valid_type(event_type: str = "event_type") -> Column:
    """1 to 128 bytes of a-z, 0-9, dot and underscore, without leading, trailing or double dots."""
    t = F.col(event_type)
    return F.octet_length(t).between(1, 128) & t.rlike(r"^[a-z0-9_]+(\.[a-z0-9_]+)*$")


def valid_entity(entity_id: str = "entity_id") -> Column:
    """1 to 128 bytes without control characters or white space around."""
    t = F.col(entity_id)
    return F.octet_length(t).between(1, 128) & ~t.rlike(r"\p{Cntrl}") & (F.trim(t) == t)
