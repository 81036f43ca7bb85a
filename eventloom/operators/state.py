"""States folded out of events: entity snapshots, time travel, listings, lifecycles, projection templates, agent projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.operators.filters import valid_from

LAST = F.struct  # a struct orders by its members in turn


def merged_members(events: DataFrame, order: tuple[Column, ...] | None = None, keys: tuple[str, ...] = ("tenant_id", "entity_id")) -> DataFrame:
    """*keys, name, value (JSON text): each top-level payload member's last value in fold order.

    The shallow merge of all payloads, as rows: an aggregate by member, so an entity's history is never gathered.
    Payloads that are no objects take no part.
    """
    order = order or (F.col("timestamp"), F.col("version"), F.col("id"))
    members = F.explode(F.expr("cast(try_variant_get(try_parse_json(payload), '$', 'map<string,variant>') as map<string,variant>)"))
    rows = events.select(*keys, F.struct(*order).alias("at_"), members.alias("name", "v"))
    return rows.groupBy(*keys, "name").agg(F.max_by(F.to_json("v"), "at_").alias("value"))


def entity_state(events: DataFrame, valid_order: bool = False, keys: tuple[str, ...] = ("tenant_id", "entity_id")) -> DataFrame:
    """*keys, state (map of JSON texts), event_count, version, last_at. Filter events first to travel in time; reads in valid
    time fold by (valid_from, timestamp, version)."""
    order = (valid_from(), F.col("timestamp"), F.col("version"), F.col("id")) if valid_order else None
    state = merged_members(events, order, keys).groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "value")))).alias("state"))
    counts = events.groupBy(*keys).agg(F.count(F.lit(1)).alias("event_count"), F.max("version").alias("version"), F.max("timestamp").alias("last_at"))
    return counts.join(state, list(keys), "left")


def history(events: DataFrame, keys: tuple[str, ...] = ("tenant_id", "entity_id")) -> DataFrame:
    """events numbered in their entity's order."""
    return events.withColumn("seq", F.row_number().over(Window.partitionBy(*keys).orderBy("timestamp", "version", "id")))


def list_entities(events: DataFrame, prefix: str | None = None) -> DataFrame:
    """entity_id, event_count, last_event_type, last_event_at; order by last_event_at desc, entity_id to page."""
    got = events.where(F.col("entity_id").startswith(prefix)) if prefix else events
    last = F.max(F.struct("timestamp", "id", "event_type"))
    return got.groupBy("entity_id").agg(F.count(F.lit(1)).alias("event_count"), last["event_type"].alias("last_event_type"), F.max("timestamp").alias("last_event_at"))


def detect_duplicates(events: DataFrame, fields: list[Column]) -> DataFrame:
    """fields, entities: groups of equal fields that more than one distinct entity has."""
    return events.groupBy(*fields).agg(F.count_distinct("entity_id").alias("entities")).where("entities > 1")


def counts_by(events: DataFrame, column: str) -> DataFrame:
    """value, n, entities; null counts as "unknown"."""
    return events.groupBy(F.coalesce(column, F.lit("unknown")).alias("value")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("entity_id").alias("entities"))


def expected_version(current: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (entity_id, expected) -> with current version (0 if unknown) and ok."""
    got = wanted.join(current.groupBy("entity_id").agg(F.max("version").alias("version")), "entity_id", "left")
    return got.withColumn("version", F.coalesce("version", F.lit(0))).withColumn("ok", F.col("expected").isNull() | (F.col("expected") == F.col("version")))


def gapless(events: DataFrame, keys: tuple[str, ...] = ("tenant_id", "entity_id")) -> DataFrame:
    """*keys, version, ok: whether an entity's versions are 1 to n without a gap."""
    got = events.groupBy(*keys).agg(F.max("version").alias("version"), F.count_distinct("version").alias("n"), F.min("version").alias("least"))
    return got.select(*keys, "version", ((F.col("version") == F.col("n")) & (F.col("least") == 1)).alias("ok"))


def lifecycle(events: DataFrame, prefix: str, keys: tuple[str, ...] = ("tenant_id", "entity_id")) -> DataFrame:
    """*keys, state, n, since: the newest "<prefix><state>" of each entity; entities without one are absent."""
    got = events.where(F.col("event_type").startswith(prefix)).withColumn("state", F.substring(F.col("event_type"), len(prefix) + 1, 128))
    return got.groupBy(*keys).agg(F.max_by("state", F.struct("timestamp", "id")).alias("state"), F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("since"))


# projection templates ----------------------------------------------------------------------------------------------------


def leaderboard(events: DataFrame) -> DataFrame:
    counts = events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "event_type")))  # one row by type


def events_per_day(events: DataFrame, days: int = 90) -> DataFrame:
    """day, n of the newest ``days`` days with events."""
    return events.groupBy(F.date_format("timestamp", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("day")).limit(days)


def entity_activity(events: DataFrame) -> DataFrame:
    last = F.max(F.struct("timestamp", "id", "event_type"))
    return events.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"), last["event_type"].alias("last_type"), F.max("timestamp").alias("last_at"))


def active_entities(events: DataFrame, k: int = 50) -> DataFrame:
    """entity_id, last_at of the k most recent, and how many distinct ones there are (exactly)."""
    each = events.groupBy("entity_id").agg(F.max("timestamp").alias("last_at"))
    total = each.agg(F.count(F.lit(1)).alias("distinct"))
    return each.orderBy(F.desc("last_at"), "entity_id").limit(k).join(F.broadcast(total))


# agent projections -------------------------------------------------------------------------------------------------------


def token_usage(calls: DataFrame) -> DataFrame:
    """calls (entity_id, model, input_tokens, output_tokens, cost) -> sums; cost is rounded to micro-dollars call by call."""
    micro = F.round(F.col("cost") * 1e6).cast("long")
    return calls.groupBy("entity_id", "model").agg(
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), (F.sum(micro) / F.lit(1e6)).alias("cost"), F.count(F.lit(1)).alias("calls")
    )


def tool_audit(calls: DataFrame, last: int = 1000) -> DataFrame:
    """calls (entity_id, tool, ok, ms, timestamp, id) -> calls, success_rate over all; p50 and p95 by index over the last 1000.

    p50 is sorted[n / 2], p95 is sorted[min(ceil(0.95 n), n - 1)]: found by rank, so no list of durations is gathered.
    """
    keys = ["entity_id", "tool"]
    totals = calls.groupBy(*keys).agg(F.count(F.lit(1)).alias("calls"), F.avg(F.col("ok").cast("double")).alias("success_rate"))
    w = Window.partitionBy(*keys)
    recent = calls.withColumn("back", F.row_number().over(w.orderBy(F.desc("timestamp"), F.desc("id")))).where(F.col("back") <= last)
    ranked = recent.withColumn("at", F.row_number().over(w.orderBy("ms", "id")) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    low, high = F.floor(F.col("n") / 2), F.least(F.ceil(F.col("n") * 0.95), F.col("n") - 1)
    marks = ranked.groupBy(*keys).agg(F.max(F.when(F.col("at") == low, F.col("ms"))).alias("p50"), F.max(F.when(F.col("at") == high, F.col("ms"))).alias("p95"))
    return totals.join(marks, keys)


def waiting(events: DataFrame, requested: str, answered: tuple[str, ...]) -> DataFrame:
    """entity_id, requested_at: entities whose last request or answer is a request."""
    got = events.where(F.col("event_type").isin(requested, *answered))
    last = got.groupBy("entity_id").agg(F.max(F.struct("timestamp", "id", "event_type")).alias("x"))
    return last.where(F.col("x.event_type") == requested).select("entity_id", F.col("x.timestamp").alias("requested_at"))


def first_claim(events: DataFrame, claim: str, done: tuple[str, ...]) -> DataFrame:
    """entity_id, claimed_at, claims, status: the first claim wins; done once a final event follows it."""
    first = F.min(F.when(F.col("event_type") == claim, F.struct("timestamp", "id")))
    final = F.max(F.when(F.col("event_type").isin(*done), F.struct("timestamp", "id")))
    got = events.groupBy("entity_id").agg(first.alias("c"), final.alias("d"), F.count_if(F.col("event_type") == claim).alias("claims"))
    status = F.when(F.col("d") > F.col("c"), "done").otherwise("claimed")
    return got.where("c is not null").select("entity_id", F.col("c.timestamp").alias("claimed_at"), "claims", status.alias("status"))


def utilization(events: DataFrame, begins: str, ends: str, until) -> DataFrame:
    """entity_id, busy_seconds, open: time between each begin and the next begin or end of the entity, the last one to ``until``."""
    w = Window.partitionBy("entity_id").orderBy("timestamp", "id")
    got = events.where(F.col("event_type").isin(begins, ends)).withColumn("next_", F.lead("timestamp").over(w))
    got = got.where(F.col("event_type") == begins)
    seconds = F.timestamp_diff("SECOND", F.col("timestamp"), F.coalesce("next_", F.lit(until).cast("timestamp")))
    return got.groupBy("entity_id").agg(F.sum(seconds).alias("busy_seconds"), F.count_if(F.col("next_").isNull()).cast("long").alias("open"))


def compact_tokens(tokens: DataFrame) -> DataFrame:
    """tokens (entity_id, at, token) -> entity_id, text, tokens in order."""
    return tokens.groupBy("entity_id").agg(F.expr("listagg(token, '') within group (order by at)").alias("text"), F.count(F.lit(1)).alias("tokens"))
