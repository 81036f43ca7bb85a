"""Graph queries: customers, parts and suppliers as nodes, their trade as edges; nations for small dense graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.operators import graph as G
from eventloom.plans.catalog_events import EV
from eventloom.sources.adapter import flat_events, read_table, stamp


def user_edges(spark, d):
    """Users linked by rule: an event links its user to a user given by its k, with its value as weight."""
    ev = flat_events(spark, d)
    return ev.select(
        F.col("id").alias("edge"), F.regexp_replace("entity_id", "user-", "").cast("long").alias("src"), ((F.col("k") * 7 + F.col("id") % 5) % 150).alias("dst"), F.col("event_type").alias("relation"), F.col("value").alias("weight"), "timestamp"
    ).where("src <> dst")


def few_edges(spark, d):
    """The part of the edges that the recursive SQL twins can walk; the queries graph_all_* take all edges."""
    return user_edges(spark, d).where("relation = 'app.signup'")


EDGES = f"WITH RECURSIVE {EV}, e AS (SELECT id AS edge, CAST(substr(entity_id, 6) AS BIGINT) AS src, CAST((k * 7 + id % 5) % 150 AS BIGINT) AS dst, event_type AS relation, value AS weight, ts FROM ev WHERE CAST(substr(entity_id, 6) AS BIGINT) <> (k * 7 + id % 5) % 150), few AS (SELECT * FROM e WHERE relation = 'app.signup')"
BFS = "walk(node, depth) AS (SELECT 7::BIGINT, 0 UNION SELECT few.dst, depth + 1 FROM walk JOIN few ON few.src = walk.node WHERE depth < {n})"


def shortest(spark, d, edges=few_edges):
    return G.shortest_paths(edges(spark, d), 7).select("node", F.round("cost", 4).alias("cost"))


def node_events(spark, d):
    ev = flat_events(spark, d)
    kind = F.when(F.col("event_type") == "app.signup", "created").when(F.col("event_type") == "app.error", "deleted").otherwise("updated")
    return ev.select(F.col("entity_id").alias("node"), kind.alias("kind"), "timestamp", "id")


def states(spark, d):
    return G.node_states(node_events(spark, d)).select("node", "alive", "updates", stamp("last_at").alias("last_at"))


def alive_edges(spark, d):
    e = user_edges(spark, d)
    return G.edges_at(e.where("edge % 4 <> 0").select((F.col("edge") % 900).alias("edge"), "timestamp", "src", "dst"), e.where("edge % 4 = 0").select((F.col("edge") % 300).alias("edge"))).select("edge", "src", "dst")


def ends(edges):
    """All nodes of the edges, however many users there are."""
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


def domains(spark, d):
    e = user_edges(spark, d)
    nodes = ends(e).select("node", F.concat(F.lit("d"), (F.col("node") % 6).cast("string")).alias("domain"))
    return G.cross_domain(e, nodes)


def merged(spark, d):
    e = user_edges(spark, d).select("edge", "src", "dst")
    same = ends(e).where("node % 10 = 1").select("node", (F.col("node") - 1).alias("keep"))
    return G.merged_nodes(e, same)


def trade(spark, d):
    """Trade links between nations: lineitems from a supplier's nation to a customer's."""
    li, o = read_table(spark, d, "lineitem"), read_table(spark, d, "orders")
    s, c = read_table(spark, d, "supplier"), read_table(spark, d, "customer")
    got = li.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    return got.groupBy(F.col("s_nationkey").alias("src"), F.col("c_nationkey").alias("dst")).agg(F.count(F.lit(1)).alias("n"))


RANK = """p AS (SELECT src, dst, count(*) AS m FROM few GROUP BY ALL), nd AS (SELECT src AS node FROM p UNION SELECT dst FROM p), o AS (SELECT src, sum(m) AS outs FROM p GROUP BY src)"""


def rank_sql(rounds: int) -> str:
    """PageRank as a chain of CTEs, a round each."""
    out = [EDGES, RANK, "n AS (SELECT count(*) AS n FROM nd)", "r0 AS MATERIALIZED (SELECT node, 1.0::DOUBLE / n AS rank FROM nd, n)"]
    for i in range(rounds):
        out.append(
            f"l{i} AS (SELECT coalesce(sum(rank), 0) AS x FROM r{i} WHERE node NOT IN (SELECT src FROM o)), f{i} AS (SELECT p.dst AS node, sum(rank * m / outs) AS inn FROM r{i} JOIN p ON p.src = r{i}.node JOIN o ON o.src = p.src GROUP BY p.dst), "
            f"r{i + 1} AS MATERIALIZED (SELECT r{i}.node, (0.15::DOUBLE + 0.85::DOUBLE * x) / n + 0.85::DOUBLE * coalesce(inn, 0) AS rank FROM r{i} LEFT JOIN f{i} USING (node), l{i}, n)"
        )
    return ", ".join(out) + f" SELECT node, round(rank, 8) AS rank FROM r{rounds}"


QUERIES = {
    "graph_node_states": (
        states,
        f"WITH {EV} SELECT entity_id AS node, coalesce(max(ts) FILTER (event_type = 'app.signup') > coalesce(max(ts) FILTER (event_type = 'app.error'), TIMESTAMP '1970-01-01'), false) AS alive, count(*) FILTER (event_type NOT IN ('app.signup', 'app.error')) AS updates, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_at FROM ev GROUP BY entity_id",
    ),
    "graph_edges_alive": (alive_edges, f"{EDGES}, m AS (SELECT edge % 900 AS edge, src, dst, row_number() OVER (PARTITION BY edge % 900 ORDER BY ts, src, dst) AS place FROM e WHERE edge % 4 <> 0) SELECT edge, src, dst FROM m WHERE place = 1 AND edge NOT IN (SELECT edge % 300 FROM e WHERE edge % 4 = 0)"),
    "graph_neighbors": (lambda spark, d: G.neighbors(user_edges(spark, d), 7), f"{EDGES} SELECT dst AS node FROM e WHERE src = 7 UNION SELECT src FROM e WHERE dst = 7"),
    "graph_bfs2": (lambda spark, d: G.bfs(few_edges(spark, d), 7, 2), f"{EDGES}, {BFS.format(n=2)} SELECT node, min(depth) AS depth FROM walk GROUP BY node"),
    "graph_subgraph": (lambda spark, d: G.subgraph(few_edges(spark, d), 7, 2).select("edge", "src", "dst"), f"{EDGES}, {BFS.format(n=2)} SELECT edge, src, dst FROM few WHERE src IN (SELECT node FROM walk) AND dst IN (SELECT node FROM walk)"),
    "graph_shortest_path": (
        shortest,
        f"{EDGES}, w(node, cost, hops) AS (SELECT 7::BIGINT, 0.0::DOUBLE, 0 UNION ALL SELECT dst, min(cost + weight), hops + 1 FROM w JOIN few ON few.src = w.node WHERE hops < 40 GROUP BY dst, hops) SELECT node, round(min(cost), 4) AS cost FROM w GROUP BY node",
    ),
    "graph_pagerank10": (lambda spark, d: G.pagerank(few_edges(spark, d), 10).select("node", F.round("rank", 8).alias("rank")), rank_sql(10)),
    "graph_all_bfs2": (lambda spark, d: G.bfs(user_edges(spark, d), 7, 2), None),
    "graph_all_subgraph": (lambda spark, d: G.subgraph(user_edges(spark, d), 7, 2).select("edge", "src", "dst"), None),
    "graph_all_shortest_path": (lambda spark, d: shortest(spark, d, user_edges), None),
    "graph_all_pagerank10": (lambda spark, d: G.pagerank(user_edges(spark, d), 10).select("node", F.round("rank", 8).alias("rank")), None),
    "graph_communities": (lambda spark, d: G.communities(user_edges(spark, d)), None),
    "graph_contradictions": (
        lambda spark, d: G.contradictions(user_edges(spark, d), ("app.signup",)).select("src", "first", "other", "edge"),
        f"{EDGES}, f AS (SELECT *, first_value(dst) OVER (PARTITION BY src, relation ORDER BY ts, edge) AS first FROM few) SELECT src, first, dst AS other, edge FROM f WHERE first <> dst",
    ),
    "graph_cross_domain": (domains, f"{EDGES} SELECT 'd' || least(src % 6, dst % 6) AS a, 'd' || greatest(src % 6, dst % 6) AS b, count(*) AS n FROM e WHERE src % 6 <> dst % 6 GROUP BY ALL"),
    "graph_merged": (merged, f"{EDGES} SELECT edge, CASE WHEN src % 10 = 1 THEN src - 1 ELSE src END AS src, CASE WHEN dst % 10 = 1 THEN dst - 1 ELSE dst END AS dst FROM e"),
    "graph_diff": (
        lambda spark, d: G.graph_diff(node_events(spark, d), "2024-01-05 00:00:00", "2024-01-09 00:00:00"),
        f"WITH {EV} SELECT CASE event_type WHEN 'app.signup' THEN 'created' WHEN 'app.error' THEN 'deleted' ELSE 'updated' END AS kind, count(*) AS n FROM ev WHERE ts > '2024-01-05' AND ts <= '2024-01-09' GROUP BY 1",
    ),
    "graph_relevance": (
        lambda spark, d: G.relevance(node_events(spark, d).select("node", F.when(F.col("kind") == "created", "created").otherwise("touched").alias("kind"), "timestamp"), "2024-01-31 00:00:00").select("node", F.round("score", 6).alias("score")),
        f"WITH {EV}, m AS (SELECT entity_id, min(ts) AS made FROM ev WHERE event_type = 'app.signup' GROUP BY ALL), t AS (SELECT ev.entity_id, count(*) FILTER (event_type <> 'app.signup') AS n, max(ts) AS l FROM ev JOIN m ON m.entity_id = ev.entity_id AND ts >= made GROUP BY ALL) SELECT entity_id AS node, round((1 + n) * exp(-0.01::DOUBLE * ((epoch_us(TIMESTAMP '2024-01-31') - epoch_us(l)) // 1000000 / 3600.0::DOUBLE)), 6) AS score FROM t",
    ),
    "graph_trade": (trade, "SELECT s_nationkey AS src, c_nationkey AS dst, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL"),
}
