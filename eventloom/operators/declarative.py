"""Declarative folds: merge policies with provenance, and views reduced from events by rules."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: policy -> order columns, all descending; ties go to the smaller source_event_id.
POLICIES = {
    "last_write": ("observed_at", "recorded_at"),
    "highest_priority": ("source_priority", "observed_at", "recorded_at"),
    "most_specific": ("specificity_score", "observed_at", "recorded_at"),
}


def winners(observations: DataFrame, policy: str) -> DataFrame:
    """observations (entity_id, field, value, observed_at, recorded_at, source_priority, specificity_score, source_event_id)
    -> the winning row by entity and field, with contributors, the number of rows that had a say.

    The order is total, so the result does not depend on the order of rows; null recorded_at is lowest."""
    keys = Window.partitionBy("entity_id", "field")
    order = [F.desc_nulls_last(c) for c in POLICIES[policy]] + [F.asc("source_event_id")]
    got = observations.withColumn("place_", F.row_number().over(keys.orderBy(*order))).withColumn("contributors", F.count(F.lit(1)).over(keys))
    return got.where("place_ = 1").drop("place_")


def merged_arrays(observations: DataFrame) -> DataFrame:
    """observations (entity_id, field, values array) -> entity_id, field, values: the sorted union.

    Elements are made distinct before they are gathered, so a field that many rows repeat stays as small as its union."""
    each = observations.select("entity_id", "field", F.explode("values").alias("v")).distinct()
    return each.groupBy("entity_id", "field").agg(F.sort_array(F.collect_list("v")).alias("values"))


def template(text: str, columns: dict[str, Column]) -> Column:
    """A key template such as "user:{entity_id}" as a Column; null if a part is missing."""
    parts, rest = [], text
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        parts += [F.lit(before), columns[name]]
    return F.concat(*parts, F.lit(rest))


def numeric_view(events: DataFrame, key: Column, ops: list[tuple[str, str, Column]]) -> DataFrame:
    """key, then a column per op: ("increment" | "max" | "min" | "set", name, value).

    These commute, or need the last event only, so they are one aggregation in parts; ops that depend on the whole order
    are in folded_view()."""
    at = F.struct("timestamp", "id")
    made = {
        "increment": lambda v: F.sum(v),
        "max": lambda v: F.max(v),
        "min": lambda v: F.min(v),
        "set": lambda v: F.max_by(v, F.when(v.isNotNull(), at)),
    }
    return events.groupBy(key.alias("key")).agg(*[made[op](value).alias(name) for op, name, value in ops])


def step(state: dict | None, event_type: str, payload: dict, ops: list[dict]) -> tuple[dict | None, int]:
    """One event's ops on one key's row: the row after it (None: no row) and how many status changes were refused.

    Each op has "on" (event types; none for all), "when" (members that must be equal; missing equals null), "op", "field" and
    "value" (a payload member, or "=text" for a constant). Ops go in their order:

    set        puts the value; a missing member changes nothing
    unset      takes the field away; without a row there is none after it
    increment  adds a whole number to the field, which counts as 0 unless it is one; any other value adds nothing
    max, min   put the value if there is none, or both are numbers or texts and it is larger (smaller)
    append     adds the value to the list unless it is there; a field that is no list counts as empty
    remove     takes the first equal element out of a list; anything else stays as it is
    status     puts the value unless "from", the states it may leave, or "transitions", the states that each state may turn
               into, refuse it; the value already held is no change and not refused
    delete     takes the row away

    A set, increment, max, min, append, remove or permitted status makes a row where there is none."""
    refused = 0
    for op in ops:
        if op.get("on") and event_type not in op["on"]:
            continue
        if any(payload.get(k) != v for k, v in op.get("when", {}).items()):
            continue
        kind, field, source = op["op"], op.get("field"), op.get("value", "")
        constant = source.startswith("=")
        missing = not constant and source not in payload
        value = source[1:] if constant else payload.get(source)
        row = {} if state is None else dict(state)
        held = row.get(field)
        if kind == "delete":
            state = None
            continue
        if kind == "unset":
            if state is not None:
                row.pop(field, None)
                state = row
            continue
        if kind == "status":
            if missing:
                continue
            if held is not None and held != value and not _may(op, held, value):
                refused += 1
                continue
            row[field] = value
        elif kind == "set":
            if not missing:
                row[field] = value
        elif kind == "increment":
            if _whole(value):
                row[field] = (held if _whole(held) else 0) + value
        elif kind in ("max", "min"):
            like = _number(value) and _number(held) or isinstance(value, str) and isinstance(held, str)
            if not missing and (held is None or like and (value > held if kind == "max" else value < held)):
                row[field] = value
        elif kind == "append":
            own = held if isinstance(held, list) else []
            if not missing and value not in own:
                row[field] = [*own, value]
        elif kind == "remove":
            if not missing and isinstance(held, list) and value in held:
                row[field] = [*held[: held.index(value)], *held[held.index(value) + 1 :]]
        else:
            raise ValueError(f"no such op: {kind}")
        state = row
    return state, refused


def _may(op: dict, held, value) -> bool:
    if "transitions" in op:
        return value in op["transitions"].get(held if isinstance(held, str) else json.dumps(held), [])
    return held in op.get("from", [held])


def _whole(x) -> bool:
    return isinstance(x, int) and not isinstance(x, bool)


def _number(x) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def folded_view(events: DataFrame, key: Column, ops: list[dict]) -> DataFrame:
    """key, state (JSON), events, refused: the view by ordered fold, streamed through sorted partitions, so that a key with
    any number of events holds one state and never its history."""
    placed = events.select(key.alias("key"), "event_type", "payload", "timestamp", "id").where("key is not null")
    dealt = placed.repartition("key").sortWithinPartitions("key", "timestamp", "id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, n, refused = None, None, 0, 0
        for frame in frames:
            out = []
            for k, event_type, payload in zip(frame["key"], frame["event_type"], frame["payload"], strict=True):
                if k != now:
                    if now is not None and state is not None:
                        out.append((now, json.dumps(state, sort_keys=True), n, refused))
                    now, state, n, refused = k, None, 0, 0
                state, more = step(state, event_type, json.loads(payload or "{}"), ops)
                n, refused = n + 1, refused + more
            yield pd.DataFrame(out, columns=["key", "state", "events", "refused"])
        if now is not None and state is not None:
            yield pd.DataFrame([(now, json.dumps(state, sort_keys=True), n, refused)], columns=["key", "state", "events", "refused"])

    return dealt.mapInPandas(run, "key string, state string, events long, refused long")
