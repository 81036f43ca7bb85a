"""Ordered feeds of a tenant's events, durable consumers, and a stream command surface over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventloom.shared import new_path


def positioned(events: DataFrame, internal: str = "system.") -> DataFrame:
    """events with position from 1 in their tenant's order; internal types take no part."""
    w = Window.partitionBy("tenant_id").orderBy("timestamp", "version", "id")
    return events.where(~F.col("event_type").startswith(internal)).withColumn("position", F.row_number().over(w).cast("long"))


def feed_page(feed: DataFrame, tenant_id: str, after: int = 0, limit: int = 100, prefixes: tuple[str, ...] = (), entity_id: str | None = None) -> DataFrame:
    """A page of positioned() events after a position; filters hold before the limit, positions do not change by them."""
    got = feed.where((F.col("tenant_id") == tenant_id) & (F.col("position") > after))
    if prefixes:
        hit = F.lit(False)
        for p in prefixes:
            hit = hit | F.col("event_type").startswith(p)
        got = got.where(hit)
    if entity_id is not None:
        got = got.where(F.col("entity_id") == entity_id)
    return got.orderBy("position").limit(limit)


class Consumers:
    """Durable consumers' positions, an append-only table in the shared folder; the largest position of a consumer counts."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or new_path(spark, "consumers")

    def _write(self, name: str, position: int) -> None:
        self.spark.createDataFrame([(name, position)], "name string, position long").coalesce(1).write.mode("append").parquet(self.path)

    def register(self, name: str) -> None:
        self._write(name, 0)

    def position(self, name: str) -> int:
        row = self.spark.read.schema("name string, position long").parquet(self.path).where(F.col("name") == name).agg(F.max("position").alias("p")).collect()[0]
        if row.p is None:
            raise KeyError(name)
        return row.p

    def poll(self, feed: DataFrame, tenant_id: str, name: str, limit: int = 100, prefixes: tuple[str, ...] = ()) -> DataFrame:
        return feed_page(feed, tenant_id, self.position(name), limit, prefixes)

    def ack(self, feed: DataFrame, tenant_id: str, name: str, position: int) -> int:
        """Moves forward only; a position beyond the feed's head is an error."""
        head = feed.where(F.col("tenant_id") == tenant_id).agg(F.coalesce(F.max("position"), F.lit(0)).alias("h")).collect()[0].h
        if position > head:
            raise ValueError(f"position {position} is beyond the head {head}")
        now = self.position(name)
        if position > now:
            self._write(name, position)
        return max(now, position)


def stream_key(key: str):
    """"entity:x", "type:x" or a tenant as a Column."""
    kind, colon, rest = key.partition(":")
    if colon and kind == "entity":
        return F.col("entity_id") == rest
    if colon and kind == "type":
        return F.col("event_type") == rest
    return F.col("tenant_id") == key


def xlen(events: DataFrame, key: str) -> DataFrame:
    return events.where(stream_key(key)).agg(F.count(F.lit(1)).alias("n"))


def xrange(events: DataFrame, key: str, start_ms: int | None = None, end_ms: int | None = None, count: int | None = None) -> DataFrame:
    """Events of a key between two times in milliseconds, inclusive."""
    ms = F.unix_millis("timestamp")
    got = events.where(stream_key(key))
    got = got.where(ms >= start_ms) if start_ms is not None else got
    got = got.where(ms <= end_ms) if end_ms is not None else got
    got = got.orderBy("timestamp", "version", "id")
    return got.limit(count) if count is not None else got


def toon(columns: list[str], rows: list[tuple], name: str = "rows") -> str:
    """A result as a header line and one line a row: for showing, not for data."""
    cell = lambda v: "null" if v is None else str(v).lower() if isinstance(v, bool) else f'"{v}"' if isinstance(v, str) and (not v or any(c in v for c in ',:"\n')) else str(v)
    return "\n".join([f"{name}[{len(rows)}]{{{','.join(columns)}}}:"] + ["  " + ",".join(map(cell, r)) for r in rows])
