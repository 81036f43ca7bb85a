"""Graph reads at a time, by type and relation, and fielded keyword queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.operators import graph as G
from eventloom.operators import graph_reads as R
from eventloom.operators import search as V
from eventloom.plans.catalog_events import AT, EV
from eventloom.plans.catalog_graph import EDGES, node_events, user_edges
from eventloom.plans.catalog_search import vectors
from eventloom.sources.adapter import flat_events, read_table, stamp

WHEN = "2024-01-15 12:00:00"


def history(spark, d):
    """Creations and deletions of edges that are created more than once, by rule."""
    e = user_edges(spark, d)
    made = e.where("edge % 4 <> 0").select((F.col("edge") % 900).alias("edge"), "timestamp", "src", "dst", "relation")
    return made, e.where("edge % 4 = 0").select((F.col("edge") % 300).alias("edge"), "timestamp")


LIVE = f"""{EDGES}, made AS (SELECT edge % 900 AS edge, src, dst, relation, row_number() OVER (PARTITION BY edge % 900 ORDER BY ts DESC, src DESC, dst DESC, relation DESC) AS place FROM e WHERE edge % 4 <> 0 AND ts <= '{WHEN}'),
live AS (SELECT edge, src, dst, relation FROM made WHERE place = 1 AND edge NOT IN (SELECT edge % 300 FROM e WHERE edge % 4 = 0 AND ts <= '{WHEN}'))"""


def edges_as_of(spark, d):
    return R.edges_as_of(*history(spark, d), WHEN).select("edge", "src", "dst", "relation")


def described(spark, d):
    """Node events with properties: even k's as such, the ids of others."""
    ev = flat_events(spark, d).select("id", F.when(F.col("k") % 2 == 0, F.create_map(F.lit("k"), F.col("k").cast("string"))).otherwise(F.create_map(F.lit("id"), F.col("id").cast("string"))).alias("properties"))
    return node_events(spark, d).join(ev, "id")


KINDS = "CASE event_type WHEN 'app.signup' THEN 'created' WHEN 'app.error' THEN 'deleted' ELSE 'updated' END"


def timeline(spark, d):
    return R.timeline(node_events(spark, d), "user-7", "2024-01-05 00:00:00", WHEN).select("id", "kind", stamp("timestamp").alias("at"))


def typed_nodes(spark, d):
    """Customers as nodes of their market segment."""
    return read_table(spark, d, "customer").select(F.col("c_custkey").alias("node"), F.col("c_mktsegment").alias("node_type"), F.col("c_nationkey").alias("domain"))


def typed_edges(spark, d):
    return R.full_graph(typed_nodes(spark, d), user_edges(spark, d).select("edge", "src", "dst"), "BUILDING", 25)[1]


def typed(spark, d):
    return R.full_graph(typed_nodes(spark, d), user_edges(spark, d), "BUILDING")[0].select("node", "node_type")


def stats(spark, d):
    return R.graph_stats(node_events(spark, d).withColumn("node_type", F.substring("node", -1, 1)))


def counts(spark, d):
    return R.domain_counts(typed_nodes(spark, d)).select("domain", "n", F.array_join(F.col("samples").cast("array<string>"), ",").alias("samples"))


def alike(spark, d):
    return R.similar(vectors(spark, d), 7, 10, least=-0.5, max_distance=1.2).select("id", F.round("score", 6).alias("score"))


def fielded(spark, d):
    docs = read_table(spark, d, "documents")
    return docs.where(V.boolean_query("lang:en the OR o?f -tion t*n", F.col("text"), {"lang": F.col("lang")})).select(F.col("doc_id").alias("id"))


PADDED = r"' ' || array_to_string(list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> ''), ' ') || ' '"

QUERIES = {
    "graph_edges_as_of": (edges_as_of, f"{LIVE} SELECT edge, src, dst, relation FROM live"),
    "graph_neighbors_as_of": (lambda spark, d: R.neighbors_as_of(*history(spark, d), 7, WHEN, "app.click"), f"{LIVE} SELECT DISTINCT dst AS node FROM live WHERE src = 7 AND relation = 'app.click'"),
    "graph_bfs_as_of": (
        lambda spark, d: R.bfs_as_of(*history(spark, d), 7, 3, WHEN),
        f"{LIVE}, d1 AS (SELECT DISTINCT dst AS node FROM live WHERE src = 7 AND dst <> 7), d2 AS (SELECT DISTINCT dst AS node FROM live JOIN d1 ON src = node), d3 AS (SELECT DISTINCT dst AS node FROM live JOIN d2 ON src = node), every AS (SELECT 7::BIGINT AS node, 0 AS depth UNION ALL SELECT node, 1 FROM d1 UNION ALL SELECT node, 2 FROM d2 UNION ALL SELECT node, 3 FROM d3) SELECT node, min(depth) AS depth FROM every GROUP BY node",
    ),
    "graph_neighbors_relation": (lambda spark, d: G.neighbors(user_edges(spark, d), 7, "out", "app.purchase"), f"{EDGES} SELECT DISTINCT dst AS node FROM e WHERE src = 7 AND relation = 'app.purchase'"),
    "graph_node_properties": (
        lambda spark, d: R.node_properties(described(spark, d)),
        f"WITH {EV}, n AS (SELECT *, {KINDS} AS kind, row_number() OVER (PARTITION BY entity_id ORDER BY ts, id) AS turn FROM ev), a AS (SELECT entity_id, max(turn) FILTER (kind = 'created') AS made, coalesce(max(turn) FILTER (kind = 'deleted'), 0) AS gone FROM n GROUP BY entity_id), p AS (SELECT entity_id, turn, CASE WHEN k % 2 = 0 THEN 'k' ELSE 'id' END AS name, CASE WHEN k % 2 = 0 THEN k ELSE id END AS value FROM n JOIN a USING (entity_id) WHERE made > gone AND turn >= made AND kind <> 'deleted') SELECT entity_id AS node, name, CAST(arg_max(value, turn) AS VARCHAR) AS value FROM p GROUP BY ALL",
    ),
    "graph_timeline": (timeline, f"WITH {EV} SELECT id, {KINDS} AS kind, {AT} AS at FROM ev WHERE entity_id = 'user-7' AND ts BETWEEN '2024-01-05' AND '{WHEN}'"),
    "graph_nodes_by_type": (typed, "SELECT c_custkey AS node, c_mktsegment AS node_type FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "graph_full_of_type": (typed_edges, f"{EDGES}, n AS (SELECT c_custkey AS node FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY 1 LIMIT 25) SELECT edge, src, dst FROM e WHERE src IN (FROM n) AND dst IN (FROM n)"),
    "graph_stats": (stats, f"WITH {EV}, n AS (SELECT right(entity_id, 1) AS node_type, {KINDS} AS kind FROM ev) SELECT node_type, count(*) FILTER (kind = 'created') AS created, count(*) FILTER (kind = 'updated') AS updated, count(*) FILTER (kind = 'deleted') AS deleted, count(*) FILTER (kind = 'created') - count(*) FILTER (kind = 'deleted') AS live FROM n GROUP BY node_type"),
    "graph_domain_counts": (counts, "SELECT c_nationkey AS domain, count(*) AS n, array_to_string(list_sort(list(c_custkey))[1:5], ',') AS samples FROM customer GROUP BY 1"),
    "graph_similar": (alike, "SELECT v.vec_id AS id, round(list_cosine_similarity(v.embedding::DOUBLE[], p.embedding::DOUBLE[]), 6) AS score FROM embeddings v, embeddings p WHERE p.vec_id = 7 AND v.vec_id <> 7 AND list_cosine_similarity(v.embedding::DOUBLE[], p.embedding::DOUBLE[]) >= -0.2 ORDER BY list_cosine_similarity(v.embedding::DOUBLE[], p.embedding::DOUBLE[]) DESC, 1 LIMIT 10"),
    "search_fielded": (fielded, f"WITH p AS (SELECT doc_id AS id, {PADDED.format('text')} AS t, {PADDED.format('lang')} AS l FROM documents) SELECT id FROM p WHERE contains(l, ' en ') AND (contains(t, ' the ') OR regexp_matches(t, ' o[^ ]f ')) AND NOT contains(t, ' tion ') AND regexp_matches(t, ' t[^ ]*n ')"),
}
