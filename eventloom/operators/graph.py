"""A property graph folded out of events: states, traversal, paths, ranks, communities, contradictions, domains.

Loops cut their lineage with tables in the shared folder each round and stop at an empty frontier or a small change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.shared import forget, written


def node_states(events: DataFrame) -> DataFrame:
    """events (node, kind in created | updated | deleted, payload, timestamp, id) -> node, alive, updates, last_at: by the last
    create or delete."""
    at = F.struct("timestamp", "id")
    made = F.max(F.when(F.col("kind") == "created", at))
    gone = F.max(F.when(F.col("kind") == "deleted", at))
    got = events.groupBy("node").agg(made.alias("m"), gone.alias("g"), F.count_if(F.col("kind") == "updated").alias("updates"), F.max("timestamp").alias("last_at"))
    return got.select("node", (F.col("m").isNotNull() & (F.col("g").isNull() | (F.col("m") > F.col("g")))).alias("alive"), "updates", "last_at")


def edges_at(created: DataFrame, deleted: DataFrame) -> DataFrame:
    """Edges (edge, src, dst, ...) created and never deleted: once deleted an edge stays dead; created twice it counts once."""
    first = created.groupBy("edge").agg(F.min(F.struct("timestamp", *[c for c in created.columns if c not in ("edge", "timestamp")])).alias("x")).select("edge", "x.*")
    return first.join(deleted.select("edge").distinct(), "edge", "left_anti")


def neighbors(edges: DataFrame, node, direction: str = "both", relation: str | None = None) -> DataFrame:
    edges = edges.where(F.col("relation") == relation) if relation is not None else edges
    out = edges.where(F.col("src") == node).select(F.col("dst").alias("node"))
    back = edges.where(F.col("dst") == node).select(F.col("src").alias("node"))
    return {"out": out, "in": back, "both": out.union(back)}[direction].distinct()


def bfs(edges: DataFrame, start, depth: int) -> DataFrame:
    """node, depth of all nodes within ``depth`` edges along their direction; the start has depth 0."""
    spark = edges.sparkSession
    kind = edges.schema["src"].dataType.simpleString()
    links = edges.select("src", "dst").distinct()
    seen = written(spark.range(1).select(F.lit(start).cast(kind).alias("node"), F.lit(0).alias("depth")), "bfs")
    for d in range(1, depth + 1):
        front = seen.where(F.col("depth") == d - 1)
        new = links.join(front.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti")
        after = written(seen.unionByName(new.withColumn("depth", F.lit(d))), "bfs")
        forget(seen)
        seen = after
        if seen.where(F.col("depth") == d).limit(1).isEmpty():
            break
    return seen


def shortest_paths(edges: DataFrame, start, rounds: int = 64) -> DataFrame:
    """edges (src, dst, weight >= 0) -> node, cost, parent of every node reachable from start, by relaxation; ties by parent."""
    spark = edges.sparkSession
    kind = edges.schema["src"].dataType.simpleString()
    links = edges.groupBy("src", "dst").agg(F.min(F.coalesce("weight", F.lit(1.0))).alias("weight"))
    now = written(spark.range(1).select(F.lit(start).cast(kind).alias("node"), F.lit(0.0).alias("cost"), F.lit(None).cast(kind).alias("parent"), F.lit(True).alias("fresh")), "paths")
    for _ in range(rounds):
        tried = now.where("fresh").join(links, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), (F.col("cost") + F.col("weight")).alias("c"), F.col("node").alias("p"))
        best = tried.groupBy("node").agg(F.min(F.struct("c", "p")).alias("b"))
        got = now.join(best, "node", "full_outer")
        better = F.col("b").isNotNull() & (F.col("cost").isNull() | (F.col("b.c") < F.col("cost")))
        after = written(got.select("node", F.when(better, F.col("b.c")).otherwise(F.col("cost")).alias("cost"), F.when(better, F.col("b.p")).otherwise(F.col("parent")).alias("parent"), better.alias("fresh")), "paths")
        forget(now)
        now = after
        if now.where("fresh").limit(1).isEmpty():
            return now.drop("fresh")
    raise RuntimeError(f"paths not settled in {rounds} rounds")


def subgraph(edges: DataFrame, start, depth: int) -> DataFrame:
    """The edges among the nodes within ``depth`` of start."""
    near = bfs(edges, start, depth).select("node")
    return edges.join(near.withColumnRenamed("node", "src"), "src", "left_semi").join(near.withColumnRenamed("node", "dst"), "dst", "left_semi")


def pagerank(edges: DataFrame, rounds: int = 50, damping: float = 0.85, epsilon: float = 1e-9) -> DataFrame:
    """node, rank: parallel edges count each, dangling nodes spread evenly; stops when the ranks' L1 change is under epsilon."""
    links = written(edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("m")), "rank-links")
    nodes = written(links.select(F.col("src").alias("node")).union(links.select("dst")).distinct(), "rank-nodes")
    n = nodes.count()
    outs = links.groupBy("src").agg(F.sum("m").alias("outs"))
    shares = written(links.join(outs, "src").select("src", "dst", (F.col("m") / F.col("outs")).alias("share")), "rank-shares")
    ranks = written(nodes.join(outs.withColumnRenamed("src", "node"), "node", "left").select("node", F.lit(1.0 / max(n, 1)).alias("rank"), F.col("outs").isNull().alias("dangling")), "rank")
    for _ in range(rounds):
        loose = ranks.agg(F.coalesce(F.sum(F.when(F.col("dangling"), F.col("rank"))), F.lit(0.0)).alias("x")).collect()[0].x
        flow = shares.join(ranks.select(F.col("node").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") * F.col("share")).alias("in"))
        after = written(ranks.join(flow, "node", "left").select("node", F.lit((1 - damping) / n + damping * loose / n) + F.lit(damping) * F.coalesce("in", F.lit(0.0)), "dangling", F.col("rank").alias("old")).toDF("node", "rank", "dangling", "old"), "rank")
        change = after.agg(F.sum(F.abs(F.col("rank") - F.col("old"))).alias("x")).collect()[0].x
        forget(ranks)
        ranks = after.drop("old")
        if change is None or change < epsilon:
            break
    return ranks.select("node", "rank")


def communities(edges: DataFrame, rounds: int = 20) -> DataFrame:
    """node, community by label propagation: in each round every node takes its neighbours' most frequent label, the smallest
    of ties; nodes change in two turns by parity of their hash, so that pairs do not swap labels for ever."""
    both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct()
    both = written(both, "label-links")
    labels = written(both.select(F.col("src").alias("node")).distinct().select("node", F.col("node").alias("label")), "labels")
    for i in range(rounds):
        votes = both.join(labels.select(F.col("node").alias("dst"), "label"), "dst").groupBy("src", "label").agg(F.count(F.lit(1)).alias("n"))
        best = votes.groupBy(F.col("src").alias("node")).agg(F.min(F.struct((-F.col("n")).alias("n"), "label"))["label"].alias("best"))
        turn = F.pmod(F.xxhash64("node"), F.lit(2)) == i % 2
        differs = F.col("best") != F.col("label")
        chosen = F.when(turn, F.col("best")).otherwise(F.col("label"))
        after = written(labels.join(best, "node").select("node", chosen.alias("label"), differs.alias("unsettled")), "labels")
        forget(labels)
        labels = after
        if labels.where("unsettled").limit(1).isEmpty():
            break
    return labels.select("node", F.col("label").alias("community"))


def contradictions(edges: DataFrame, exclusive: tuple[str, ...]) -> DataFrame:
    """src, relation, first, other, at: later edges of an exclusive relation to another target than the first one."""
    w = Window.partitionBy("src", "relation").orderBy("timestamp", "edge")
    got = edges.where(F.col("relation").isin(*exclusive)).withColumn("first", F.first("dst").over(w))
    return got.where(F.col("first") != F.col("dst")).select("src", "relation", "first", F.col("dst").alias("other"), F.col("timestamp").alias("at"), "edge")


def cross_domain(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """nodes (node, domain) -> a, b, n: edges between two domains, by unordered pair."""
    one = edges.join(nodes.select(F.col("node").alias("src"), F.col("domain").alias("d1")), "src").join(nodes.select(F.col("node").alias("dst"), F.col("domain").alias("d2")), "dst")
    return one.where("d1 <> d2").groupBy(F.least("d1", "d2").alias("a"), F.greatest("d1", "d2").alias("b")).agg(F.count(F.lit(1)).alias("n"))


def merged_nodes(edges: DataFrame, same: DataFrame) -> DataFrame:
    """edges with duplicates relabelled: same (node, keep)."""
    a, b = same.select(F.col("node").alias("src"), F.col("keep").alias("k1")), same.select(F.col("node").alias("dst"), F.col("keep").alias("k2"))
    got = edges.join(a, "src", "left").join(b, "dst", "left")
    return got.select(*[F.coalesce("k1", "src").alias("src") if c == "src" else F.coalesce("k2", "dst").alias("dst") if c == "dst" else F.col(c) for c in edges.columns])


def graph_diff(events: DataFrame, since, until) -> DataFrame:
    """kind, n of changes in (since, until]."""
    return events.where((F.col("timestamp") > F.lit(since)) & (F.col("timestamp") <= F.lit(until))).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def relevance(touches: DataFrame, now, rate: float = 0.01) -> DataFrame:
    """touches (node, kind in created | touched, timestamp) -> node, score = (1 + touches from creation on) * exp(-rate * hours
    since the last)."""
    made = touches.where("kind = 'created'").groupBy("node").agg(F.min("timestamp").alias("made"))
    got = touches.join(made, "node").where("timestamp >= made").groupBy("node").agg(F.count_if(F.col("kind") == "touched").alias("n"), F.max("timestamp").alias("last"))
    hours = F.timestamp_diff("SECOND", F.col("last"), F.lit(now).cast("timestamp")) / 3600.0
    return got.select("node", ((1 + F.col("n")) * F.exp(-rate * hours)).alias("score"))
