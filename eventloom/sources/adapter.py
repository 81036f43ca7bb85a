"""The canonical event table, and other tables in its terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EVENT = (
    "id string, event_type string, entity_id string, tenant_id string, payload string, timestamp timestamp, "
    "metadata string, version long, valid_from timestamp, valid_to timestamp"
)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def canonical(df: DataFrame) -> DataFrame:
    """df in the event table's columns and types: missing ones are null, unsigned versions become long."""
    held = {f.split()[0]: f.split()[1] for f in EVENT.split(", ")}
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in held.items()])


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's events as canonical ones. Types get the namespace "app"; versions count each entity's events."""
    raw = read_table(spark, sf_dir, "events")
    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    payload = F.to_json(F.struct(F.get_json_object("props", "$.k").cast("int").alias("k"), F.col("value")))
    return raw.select(
        F.col("event_id").cast("string").alias("id"),
        F.concat(F.lit("app."), "event_type").alias("event_type"),
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("entity_id"),
        F.concat(F.lit("t"), (F.col("user_id") % 3).cast("string")).alias("tenant_id"),
        payload.alias("payload"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.lit(None).cast("string").alias("metadata"),
        F.row_number().over(own).cast("long").alias("version"),
        F.lit(None).cast("timestamp").alias("valid_from"),
        F.lit(None).cast("timestamp").alias("valid_to"),
    )


def flat_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events() without versions, with value and k as columns: for operators that need no version and so no shuffle."""
    raw = read_table(spark, sf_dir, "events")
    return raw.select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("app."), "event_type").alias("event_type"),
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("entity_id"),
        F.concat(F.lit("t"), (F.col("user_id") % 3).cast("string")).alias("tenant_id"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def stamp(c: Column | str) -> Column:
    """A time as text, the same in every engine."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")
