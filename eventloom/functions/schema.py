"""Schemas of payloads: observed, checked, compared; typed checks of graph properties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KINDS = {"STRING": "string", "BOOLEAN": "boolean", "VOID": "null"}


def kind_of(value: Column) -> Column:
    """JSON kind of a variant: string, number, boolean, array, object, null; null where there is none."""
    s = F.schema_of_variant(value)
    simple = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    number = s.isin("BIGINT", "DOUBLE", "FLOAT") | s.startswith("DECIMAL")
    return F.when(value.isNull(), None).when(number, "number").when(s.startswith("ARRAY"), "array").when(s.startswith("OBJECT"), "object").otherwise(F.element_at(simple, s))


def observed(events: DataFrame) -> DataFrame:
    """event_type, field, kinds (sorted list as text), seen, share: what members the payloads of a type have, to depth 2.

    An aggregate of members, so the result does not depend on the order of events."""
    top = events.select("event_type", F.explode(F.expr("try_variant_get(try_parse_json(payload), '$', 'map<string,variant>')")).alias("field", "v"))
    inner = top.select("event_type", "field", F.explode(F.expr("try_variant_get(v, '$', 'map<string,variant>')")).alias("sub", "w"))
    rows = top.select("event_type", "field", kind_of(F.col("v")).alias("kind")).unionByName(inner.select("event_type", F.concat_ws(".", "field", "sub").alias("field"), kind_of(F.col("w")).alias("kind")))
    totals = events.groupBy("event_type").agg(F.count(F.lit(1)).alias("all_"))
    got = rows.groupBy("event_type", "field").agg(F.array_join(F.sort_array(F.collect_set("kind")), "|").alias("kinds"), F.count(F.lit(1)).alias("seen"))
    return got.join(totals, "event_type").select("event_type", "field", "kinds", "seen", (F.col("seen") / F.col("all_")).alias("share"))


def schema_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """observed() of two times -> event_type, field, change: added, removed or type_changed."""
    a, b = old.select("event_type", "field", F.col("kinds").alias("k1")), new.select("event_type", "field", F.col("kinds").alias("k2"))
    got = a.join(b, ["event_type", "field"], "full_outer")
    change = F.when(F.col("k1").isNull(), "added").when(F.col("k2").isNull(), "removed").when(F.col("k1") != F.col("k2"), "type_changed")
    return got.select("event_type", "field", change.alias("change")).where("change is not null")


def violations(schema: dict, column: str = "payload", path: str = "$") -> Column:
    """Array of texts: required members that are missing and members of another kind, nested objects included. "integer" is
    a number without fraction."""
    found = []
    value = lambda p: F.try_variant_get(F.try_parse_json(F.col(column)), p, "variant")
    here = value(path)
    if "type" in schema:
        wanted = schema["type"]
        kind = kind_of(here)
        whole = (kind == "number") & (F.try_variant_get(here, "$", "double") % 1 == 0)
        found.append(F.when(here.isNotNull() & ~(whole if wanted == "integer" else kind == wanted), F.lit(f"{path}: not {wanted}")))
    for name in schema.get("required", []):
        found.append(F.when(value(f"{path}.{name}").isNull(), F.lit(f"{path}.{name}: required")))
    out = F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")
    for name, sub in schema.get("properties", {}).items():
        out = F.concat(out, violations(sub, column, f"{path}.{name}"))
    return out


def compatible(old: dict, new: dict, mode: str) -> list[str]:
    """Problems of going from old to new: backward (new readers, old data), forward (old readers, new data), full, none."""
    a, b = set(old.get("required", [])), set(new.get("required", []))
    problems = []
    if mode in ("backward", "full"):
        problems += [f"{x}: newly required" for x in sorted(b - a)]
    if mode in ("forward", "full"):
        problems += [f"{x}: no longer required" for x in sorted(a - b)]
    return problems


def property_errors(rules: dict[str, dict], column: str = "properties") -> Column:
    """Array of texts for typed properties: {"name": {"type": integer | number | string | enum | datetime, "min", "max",
    "max_length", "values", "required"}}. Required holds always."""
    out = []
    for name, r in rules.items():
        text = F.get_json_object(F.col(column), f"$.{name}")
        bad = F.lit(False)
        if r["type"] in ("integer", "number"):
            x = text.try_cast("double")
            bad = x.isNull() | ((x % 1 != 0) if r["type"] == "integer" else F.lit(False))
            bad = bad | (x < r["min"]) if "min" in r else bad
            bad = bad | (x > r["max"]) if "max" in r else bad
        elif r["type"] == "enum":
            bad = ~text.isin(r["values"])
        elif r["type"] == "datetime":
            bad = F.try_to_timestamp(text).isNull()
        elif "max_length" in r:
            bad = F.length(text) > r["max_length"]
        missing = F.lit(f"{name}: required") if r.get("required") else F.lit(None).cast("string")
        out.append(F.when(text.isNull(), missing).when(bad, F.lit(f"{name}: not a valid {r['type']}")))
    return F.array_compact(F.array(*out))


def over_cardinality(edges: DataFrame, relation: str, most: int) -> DataFrame:
    """src, n of nodes with more than ``most`` edges of a relation."""
    return edges.where(F.col("relation") == relation).groupBy("src").agg(F.count_distinct("dst").alias("n")).where(F.col("n") > most)


def payload_text(column: str = "payload", fields: tuple[str, ...] = ("text", "content", "message", "title", "description", "name", "body", "summary")) -> Column:
    """Text for search: the first of the named members that is there, else all top-level texts whose names are no ids, times or
    begin with "_", by name."""
    first = F.coalesce(*[F.get_json_object(F.col(column), f"$.{f}") for f in fields])
    held = F.expr(f"map_entries(try_variant_get(try_parse_json({column}), '$', 'map<string,variant>'))")
    texts = F.filter(held, lambda e: (F.schema_of_variant(e["value"]) == "STRING") & ~e["key"].startswith("_") & ~e["key"].isin("id", "timestamp"))
    return F.coalesce(first, F.array_join(F.transform(F.array_sort(texts, lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)), lambda e: F.try_variant_get(e["value"], "$", "string")), " "))


def dedup_by_clock(events: DataFrame) -> DataFrame:
    """Events (entity_id, event_type, hlc struct<ms,counter,node>) by the newest clock of each entity and type."""
    w = Window.partitionBy("entity_id", "event_type").orderBy(F.desc("hlc"))
    return events.withColumn("at_", F.row_number().over(w)).where("at_ = 1").drop("at_")
