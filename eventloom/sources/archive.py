"""Files: the Parquet archive, write-ahead logs, JSON ingest, backups, exports, erasure, and optional connectors."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.sources.adapter import EVENT, canonical


def write_archive(events: DataFrame, path: str, mode: str = "append") -> None:
    """Partitioned by tenant and day, in entity order within files, so reads of one entity skip row groups by statistics."""
    out = events.withColumn("day", F.to_date("timestamp"))
    out.repartition("tenant_id", "day").sortWithinPartitions("entity_id", "timestamp", "version").write.partitionBy("tenant_id", "day").mode(mode).option("compression", "snappy").parquet(path)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Old files without some columns read as null there."""
    return canonical(spark.read.option("mergeSchema", "true").parquet(path))


def union_by_id(archive: DataFrame, live: DataFrame) -> DataFrame:
    """Archive and live events, each id once; the archive's copy wins."""
    rest = live.join(archive.select("id"), "id", "left_anti")
    return archive.unionByName(rest, allowMissingColumns=True)


WAL = f"sequence long, wal_timestamp string, event struct<{EVENT.replace(' ', ':').replace(',:', ',')}>, checksum long, _corrupt_record string"


def read_wal(spark: SparkSession, path: str) -> DataFrame:
    """Lines of write-ahead logs as ok (parsed, checksum holds) or not. The checksum is the CRC-32 of sequence, time and event
    id, with the time written as "2024-01-15 10:00:00.123456 UTC"."""
    lines = spark.read.schema(WAL).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    at = F.to_timestamp("wal_timestamp")
    micros = F.date_format(at, "SSSSSS")
    part = F.when(micros == "000000", "").when(F.substring(micros, 4, 3) == "000", F.concat(F.lit("."), F.substring(micros, 1, 3))).otherwise(F.concat(F.lit("."), micros))
    text = F.concat(F.col("sequence").cast("string"), F.date_format(at, "yyyy-MM-dd HH:mm:ss"), part, F.lit(" UTC"), F.col("event.id"))
    return lines.withColumn("ok", F.coalesce(F.crc32(text.cast("binary")) == F.col("checksum"), F.lit(False)) & F.col("_corrupt_record").isNull())


def recover_wal(spark: SparkSession, path: str) -> DataFrame:
    """Events of the lines that hold, each id once."""
    return canonical(read_wal(spark, path).where("ok").select("event.*").dropDuplicates(["id"]))


def parse_batch(lines: DataFrame, column: str = "value") -> DataFrame:
    """JSON texts as events, with ok: whether the text parsed and has an event type and an entity."""
    got = lines.select(F.from_json(column, EVENT, {"mode": "PERMISSIVE"}).alias("e")).select("e.*")
    named = got.withColumn("tenant_id", F.coalesce("tenant_id", F.lit("default")))
    return named.withColumn("ok", F.col("event_type").isNotNull() & F.col("entity_id").isNotNull())


def next_versions(events: DataFrame, new: DataFrame) -> DataFrame:
    """new events with versions that go on from their entities' last ones."""
    from pyspark.sql import Window

    last = events.groupBy("tenant_id", "entity_id").agg(F.max("version").alias("held_"))
    w = Window.partitionBy("tenant_id", "entity_id").orderBy("timestamp", "id")
    got = new.drop("version").join(last, ["tenant_id", "entity_id"], "left")
    return got.withColumn("version", F.coalesce("held_", F.lit(0)) + F.row_number().over(w)).drop("held_")


def idempotent(events: DataFrame, hours: int = 24) -> DataFrame:
    """The first event of each tenant, metadata.idempotency_key and period of ``hours``: an event is dropped if it is less than
    that after the last one kept of its key. Events without key all stay. Keyed events stream through sorted partitions, so
    a key with any number of them holds one time."""
    key = F.get_json_object("metadata", "$.idempotency_key")
    own = [F.coalesce("tenant_id", F.lit("")).alias("tenant_"), key.alias("key_"), F.unix_micros("timestamp").alias("micros_")]
    keyed = events.where(key.isNotNull()).select("*", *own).repartition("tenant_", "key_").sortWithinPartitions("tenant_", "key_", "timestamp", "id")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, since = None, 0
        for batch in batches:
            keep = []
            for tenant, k, at in zip(*(batch.column(c).to_pylist() for c in ("tenant_", "key_", "micros_")), strict=True):
                fresh = (tenant, k) != held or at is None or at - since >= hours * 3_600_000_000
                if fresh:
                    held, since = (tenant, k), at or 0
                keep.append(fresh)
            yield batch.filter(pa.array(keep, pa.bool_()))

    left = keyed.mapInArrow(first, keyed.schema).select(*events.columns)
    return events.where(key.isNull()).unionByName(left)


def backup(events: DataFrame, path: str) -> DataFrame:
    """Compressed JSON and its manifest: rows and a digest that does not depend on order."""
    canonical(events).write.mode("error").option("compression", "gzip").json(path)
    return manifest(events.sparkSession.read.schema(EVENT).json(path))


def manifest(events: DataFrame) -> DataFrame:
    each = F.conv(F.substring(F.sha2(F.to_json(F.struct(*canonical(events).columns)), 256), 1, 12), 16, 10).cast("long")
    return canonical(events).agg(F.count(F.lit(1)).alias("rows"), F.sum(each.cast("decimal(20,0)")).cast("string").alias("digest"))


def restore(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVENT).json(path)


def export(events: DataFrame, path: str, kind: str) -> None:
    """json, csv or parquet."""
    writer = events.write.mode("error")
    {"json": writer.json, "csv": lambda p: writer.option("header", True).csv(p), "parquet": writer.parquet}[kind](path)


def erased(events: DataFrame, entities: DataFrame) -> DataFrame:
    """events without those of the entities."""
    return events.join(entities.select("entity_id").distinct(), "entity_id", "left_anti")


def redacted(events: DataFrame, entities: DataFrame, members: tuple[str, ...]) -> DataFrame:
    """events with the named payload members of these entities' events removed."""
    held = F.expr("try_variant_get(try_parse_json(payload), '$', 'map<string,variant>')")
    left = F.to_json(F.map_filter(held, lambda k, v: ~k.isin(*members)))
    marked = events.join(entities.select("entity_id", F.lit(True).alias("hit_")).distinct(), "entity_id", "left")
    return marked.withColumn("payload", F.when(F.col("hit_"), left).otherwise(F.col("payload"))).drop("hit_")


def merge_replicas(events: DataFrame) -> DataFrame:
    """Replicated events (id, region, hlc struct<ms,counter,node>, ...): each id once, the smallest clock's copy."""
    from pyspark.sql import Window

    w = Window.partitionBy("id").orderBy("hlc", "region")
    return events.withColumn("at_", F.row_number().over(w)).where("at_ = 1").drop("at_")


def last_writer(events: DataFrame, prefixes: tuple[str, ...]) -> DataFrame:
    """Of events whose types have one of the prefixes, the largest clock of each entity and type; others all stay."""
    from functools import reduce

    from pyspark.sql import Window

    lww = reduce(lambda a, b: a | b, [F.col("event_type").startswith(p) for p in prefixes], F.lit(False))
    w = Window.partitionBy("entity_id", "event_type").orderBy(F.desc("hlc"), F.desc("id"))
    return events.withColumn("at_", F.row_number().over(w)).where(~lww | (F.col("at_") == 1)).drop("at_")


def fork(events: DataFrame, at_version: int, own: DataFrame) -> DataFrame:
    """A branch of the store: the parent's events up to a version of each entity, and the branch's own after them."""
    return events.where(F.col("version") <= at_version).unionByName(own, allowMissingColumns=True)


def kafka_stream(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """Events from a Kafka topic; needs Spark's Kafka package on the class path."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()
    return parse_batch(raw.select(F.col("value").cast("string").alias("value")))


def jdbc_table(spark: SparkSession, url: str, table: str, column: str, low: int, high: int, parts: int = 32) -> DataFrame:
    """A table of a database, read in parts of a numeric column's range; needs its driver on the class path."""
    return canonical(spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=parts).load())
