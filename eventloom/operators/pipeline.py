"""Event pipelines: a list of steps compiled to one chain of Columns; the same chain runs over batches and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.operators.analytics import with_trailing
from eventloom.operators.filters import json_equal, json_path


def member(path: str, column: str = "payload") -> Column:
    """The member at a dot path as text; null where it is missing."""
    return F.get_json_object(F.col(column), json_path(path))


def number(path: str, column: str = "payload") -> Column:
    return member(path, column).try_cast("double")


def keeps(op: str, field: str, value) -> Column:
    """Whether a payload passes: eq, ne, gt, lt, contains; a missing member passes ne only. Unknown names are an error."""
    simple = "." not in field
    same = json_equal("payload", field, value) if simple else member(field) == F.lit(str(value))
    rules = {
        "eq": lambda: same,
        "ne": lambda: ~F.coalesce(same, F.lit(False)),
        "gt": lambda: number(field) > F.lit(float(value)),
        "lt": lambda: number(field) < F.lit(float(value)),
        "contains": lambda: member(field).contains(str(value)),
    }
    return F.coalesce(rules[op](), F.lit(False))


def mapped(field: str, transform: str) -> Column:
    """A top-level member changed: uppercase, lowercase, trim, multiply:n, add:n; others, missing members and members of
    another type stay as they are. The result is the payload with that member replaced."""
    name, _, arg = transform.partition(":")
    text, num = member(field), number(field)
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json("payload"), f"$.{field}", "variant"))
    is_text = kind == "STRING"
    is_number = kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL")
    value = {
        "uppercase": lambda: F.when(is_text, F.to_json(F.struct(F.upper(text).alias("v")))),
        "lowercase": lambda: F.when(is_text, F.to_json(F.struct(F.lower(text).alias("v")))),
        "trim": lambda: F.when(is_text, F.to_json(F.struct(F.trim(text).alias("v")))),
        "multiply": lambda: F.when(is_number, F.to_json(F.struct((num * float(arg)).alias("v")))),
        "add": lambda: F.when(is_number, F.to_json(F.struct((num + float(arg)).alias("v")))),
    }.get(name)
    if value is None:
        return F.col("payload")
    new = F.try_variant_get(F.try_parse_json(value()), "$.v", "variant")
    held = F.try_variant_get(F.try_parse_json("payload"), "$", "map<string,variant>")
    changed = F.to_json(F.map_from_entries(F.transform(F.map_entries(held), lambda e: F.struct(e["key"].alias("key"), F.when(e["key"] == field, new).otherwise(e["value"]).alias("value")))))
    return F.when(value().isNotNull(), changed).otherwise(F.col("payload"))


def routed(branches: list[tuple[str, str, object, str]]) -> Column:
    """Name of the first branch (op, field, value, name) that a payload passes; null if none does."""
    out = F.lit(None).cast("string")
    for op, field, value, name in reversed(branches):
        out = F.when(keeps(op, field, value), name).otherwise(out)
    return out


def group_of(field: str | None) -> Column:
    """The text member that groups; "default" where it is missing or no text."""
    if field is None:
        return F.lit("default")
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json("payload"), f"$.{field}", "variant"))
    return F.coalesce(F.when(kind == "STRING", member(field)), F.lit("default"))


def reduced(events: DataFrame, function: str, field: str | None = None, group_by: str | None = None) -> DataFrame:
    """group, n, value: count, sum, avg, min or max of a numeric member. A missing number adds 0 and counts for avg; min and
    max pass over it."""
    x = number(field) if field else F.lit(1.0)
    value = {
        "count": F.count(F.lit(1)).cast("double"),
        "sum": F.sum(F.coalesce(x, F.lit(0.0))),
        "avg": F.avg(F.coalesce(x, F.lit(0.0))),
        "min": F.min(x),
        "max": F.max(x),
    }[function]
    return events.groupBy(group_of(group_by).alias("group")).agg(F.count(F.lit(1)).alias("n"), value.alias("value"))


def running(events: DataFrame, function: str, field: str, group: Column) -> DataFrame:
    """events with running: the reduction so far, event by event in order within each group."""
    w = Window.partitionBy("group_").orderBy("timestamp", "id").rowsBetween(Window.unboundedPreceding, 0)
    x = F.col(field)
    value = {"count": F.count(F.lit(1)), "sum": F.sum(F.coalesce(x, F.lit(0.0))), "avg": F.avg(F.coalesce(x, F.lit(0.0))), "min": F.min(x), "max": F.max(x)}[function]
    return events.withColumn("group_", group).withColumn("running", value.over(w)).drop("group_")


def apply_steps(events: DataFrame, steps: list[dict]) -> DataFrame:
    """events through the steps in order: {"filter": (op, field, value)}, {"map": (field, transform)}, {"branch": [...]}.

    Stateless, so it serves a stream as well; every step becomes a Column of one projection or filter."""
    out = events
    for step in steps:
        ((kind, arg),) = step.items()
        if kind == "filter":
            out = out.where(keeps(*arg))
        elif kind == "map":
            out = out.withColumn("payload", mapped(*arg))
        elif kind == "branch":
            out = out.withColumn("route", routed(arg))
        else:
            raise ValueError(f"no such step: {kind}")
    return out


def tumbling(events: DataFrame, size: str, slide: str | None = None, keys: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """start, end, *keys, n, total: windows by event time, tumbling or sliding; for streams give a watermark first."""
    w = F.window("timestamp", size, slide) if slide else F.window("timestamp", size)
    got = events.groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return got.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


def trailing(events: DataFrame, seconds: int, keys: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """events with n and total over the ``seconds`` up to each event, in each key."""
    return with_trailing(events, seconds, keys, n=F.lit(1).cast("long"), total=F.col("value"))


def enriched(events: DataFrame, lookup: DataFrame, key: str) -> DataFrame:
    """events with lookup's columns by key; left, and broadcast only if Spark's own size check allows it."""
    return events.join(lookup, key, "left")
