"""Reads of the property graph: at a time, by type or relation, property folds, timelines, statistics, similar nodes.

All are declarative plans over the events of nodes and edges; a read at a time filters the events before anything is folded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.operators import graph, search


def known_at(at, valid=None) -> Column:
    """Of events with timestamp, and valid_from and valid_to if valid is given: recorded until at, and valid then."""
    out = F.col("timestamp") <= F.lit(at).cast("timestamp")
    if valid is None:
        return out
    v = F.lit(valid).cast("timestamp")
    return out & (F.coalesce("valid_from", "timestamp") <= v) & (F.col("valid_to").isNull() | (F.col("valid_to") > v))


def edges_as_of(created: DataFrame, deleted: DataFrame, at, valid=None) -> DataFrame:
    """created (edge, timestamp, ...), deleted (edge, timestamp) -> edges alive at a time: of an edge created twice the later
    form holds, and once deleted it stays dead."""
    rest = [c for c in created.columns if c not in ("edge", "timestamp")]
    last = created.where(known_at(at, valid)).groupBy("edge").agg(F.max(F.struct("timestamp", *rest)).alias("x")).select("edge", "x.*")
    return last.join(deleted.where(known_at(at, valid)).select("edge").distinct(), "edge", "left_anti")


def neighbors_as_of(created: DataFrame, deleted: DataFrame, node, at, relation: str | None = None, direction: str = "out") -> DataFrame:
    return graph.neighbors(edges_as_of(created, deleted, at), node, direction, relation)


def bfs_as_of(created: DataFrame, deleted: DataFrame, start, depth: int, at) -> DataFrame:
    return graph.bfs(edges_as_of(created, deleted, at), start, depth)


def node_properties(events: DataFrame) -> DataFrame:
    """events (node, kind in created | updated | deleted, properties map, timestamp, id) -> node, name, value of nodes alive.

    A node's last creation sets its properties anew, each later update replaces the members that it names. A row for each
    member: no node's history is gathered."""
    at = F.struct("timestamp", "id")
    made = F.max(F.when(F.col("kind") == "created", at))
    gone = F.max(F.when(F.col("kind") == "deleted", at))
    alive = events.groupBy("node").agg(made.alias("made"), gone.alias("gone")).where("made is not null and (gone is null or made > gone)").select("node", "made")
    since = events.where("kind <> 'deleted'").join(alive, "node").where(at >= F.col("made"))
    each = since.select("node", at.alias("at"), F.explode("properties").alias("name", "value"))
    return each.groupBy("node", "name").agg(F.max_by("value", "at").alias("value"))


def timeline(events: DataFrame, node, since, until) -> DataFrame:
    """A node's events in [since, until], in order."""
    held = events.where((F.col("node") == node) & F.col("timestamp").between(F.lit(since).cast("timestamp"), F.lit(until).cast("timestamp")))
    return held.orderBy("timestamp", "id")


def full_graph(nodes: DataFrame, edges: DataFrame, node_type: str | None = None, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """nodes (node, node_type, ...) of a type, the first ones by name if there is a limit, and the edges among them."""
    kept = nodes.where(F.col("node_type") == node_type) if node_type is not None else nodes
    kept = kept.orderBy("node").limit(limit) if limit is not None else kept
    ends = kept.select("node").distinct()
    inner = edges.join(ends.withColumnRenamed("node", "src"), "src", "left_semi").join(ends.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return kept, inner


def graph_stats(events: DataFrame) -> DataFrame:
    """events (kind, node_type) -> node_type, created, updated, deleted, live."""
    kinds = [F.count_if(F.col("kind") == k).alias(k) for k in ("created", "updated", "deleted")]
    return events.groupBy("node_type").agg(*kinds).withColumn("live", F.col("created") - F.col("deleted"))


def domain_counts(nodes: DataFrame, samples: int = 5) -> DataFrame:
    """nodes (node, domain) -> domain, n, samples: an array of at most so many nodes, the first by name."""
    place = F.row_number().over(Window.partitionBy("domain").orderBy("node"))
    first = nodes.select("domain", "node").distinct().withColumn("place", place).where(F.col("place") <= samples)
    shown = first.groupBy("domain").agg(F.array_sort(F.collect_list("node")).alias("samples"))
    return nodes.groupBy("domain").agg(F.count_distinct("node").alias("n")).join(shown, "domain")


def similar(vectors: DataFrame, node, k: int = 10, least: float | None = None, max_distance: float | None = None, metric: str = "cosine") -> DataFrame:
    """vectors (id, embedding) -> id, score of the k vectors most similar to a node's own, without it; none if it has none.

    max_distance bounds 1 - cosine, or the distance itself for euclidean. One vector is broadcast."""
    probe = vectors.where(F.col("id") == node).select(F.col("embedding").alias("probe")).limit(1)
    others = vectors.where(F.col("id") != node).join(F.broadcast(probe), F.size("embedding") == F.size("probe"))
    got = others.select("id", search.similarity(F.col("embedding"), F.col("probe"), metric).alias("score"))
    if least is not None:
        got = got.where(F.col("score") >= least)
    if max_distance is not None:
        got = got.where((1 / F.col("score") - 1 if metric == "euclidean" else 1 - F.col("score")) <= max_distance)
    return got.orderBy(F.desc("score"), "id").limit(k)
