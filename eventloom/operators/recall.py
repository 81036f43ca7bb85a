"""Recall: ranked seeds widened over the graph, traces over ids, steps paired, entities side by side, run timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.shared import forget, written


def expand(seeds: DataFrame, edges: DataFrame, depth: int = 1, weights: tuple[float, float, float] = (0.5, 0.3, 0.2), recency: DataFrame | None = None) -> DataFrame:
    """seeds (node, score) -> node, score: similarity, graph proximity 1 / (1 + hops) and recency (0 to 1), weighed."""
    both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    near = written(seeds.select("node", F.lit(0).alias("hops")), "recall")
    for d in range(1, depth + 1):
        front = near.where(F.col("hops") == d - 1).select(F.col("node").alias("src"))
        new = both.join(front, "src", "left_semi").select(F.col("dst").alias("node")).distinct().join(near, "node", "left_anti")
        after = written(near.unionByName(new.withColumn("hops", F.lit(d))), "recall")
        forget(near)
        near = after
    got = near.join(seeds, "node", "left")
    got = got.join(recency, "node", "left") if recency is not None else got.withColumn("recency", F.lit(0.0))
    s, p, r = weights
    return got.select("node", (F.coalesce("score", F.lit(0.0)) * s + F.lit(p) / (1 + F.col("hops")) + F.coalesce("recency", F.lit(0.0)) * r).alias("score"))


def trace(links: DataFrame, start: str, depth: int = 3, hub: int = 20) -> DataFrame:
    """links (value, entity_id): entities that share values with start, step by step; values of more than ``hub`` entities do
    not lead on. -> entity_id, hops."""
    spread = links.distinct().groupBy("value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n").between(2, hub)).select("value")
    useful = written(links.distinct().join(spread, "value", "left_semi"), "trace-links")
    seen = written(links.sparkSession.createDataFrame([(start, 0)], "entity_id string, hops int"), "trace")
    for d in range(1, min(depth, 3) + 1):
        front = seen.where(F.col("hops") == d - 1).select("entity_id")
        values = useful.join(front, "entity_id", "left_semi").select("value").distinct()
        new = useful.join(values, "value", "left_semi").select("entity_id").distinct().join(seen, "entity_id", "left_anti")
        after = written(seen.unionByName(new.withColumn("hops", F.lit(d))), "trace")
        forget(seen)
        seen = after
    return seen


def steps(events: DataFrame, start: str, terminal: tuple[str, ...], keys: tuple[str, ...] = ("tenant_id", "entity_id")) -> DataFrame:
    """*keys, started, ended, outcome, seconds: each start with the next start or terminal event of its key."""
    w = Window.partitionBy(*keys).orderBy("timestamp", "id")
    got = events.where(F.col("event_type").isin(start, *terminal))
    got = got.withColumn("t_", F.lead("timestamp").over(w)).withColumn("k_", F.lead("event_type").over(w)).where(F.col("event_type") == start)
    ends = F.col("k_").isin(*terminal)
    return got.select(*keys, F.col("timestamp").alias("started"), F.when(ends, F.col("t_")).alias("ended"), F.when(ends, F.col("k_")).otherwise("open").alias("outcome"), F.when(ends, F.timestamp_diff("SECOND", F.col("timestamp"), F.col("t_"))).alias("seconds"))


def side_by_side(events: DataFrame, entities: list[str], types: list[str]) -> DataFrame:
    """entity_id and a count per type."""
    return events.where(F.col("entity_id").isin(entities)).groupBy("entity_id").agg(*[F.count_if(F.col("event_type") == t).alias(t.replace(".", "_")) for t in types])


def run_timeline(events: DataFrame, most: int = 1000) -> DataFrame:
    """events (run, version, causation, id) -> run, n, valid: versions 1 to n without gap, each caused by the one before it, at
    most ``most``. Times repair no order."""
    w = Window.partitionBy("run").orderBy("version")
    fine = (F.col("version") == F.row_number().over(w)) & (F.col("causation").isNull() | F.col("causation").eqNullSafe(F.lag("id").over(w)))
    got = events.withColumn("fine_", fine).groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.min("fine_").alias("f"))
    return got.select("run", "n", (F.col("f") & (F.col("n") <= most)).alias("valid"))
