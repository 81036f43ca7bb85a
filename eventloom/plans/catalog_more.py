"""Feeds, schemas, recall and identifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.functions import ids, schema
from eventloom.operators import recall as R
from eventloom.plans.catalog_events import EV
from eventloom.plans.catalog_graph import EDGES, few_edges, user_edges
from eventloom.sources import archive, feed
from eventloom.sources.adapter import events, flat_events


def page(spark, d):
    return feed.feed_page(feed.positioned(events(spark, d)), "t1", 100, 25, ("app.click", "app.view")).select("id", "event_type", "position")


def ranged(spark, d):
    return feed.xrange(events(spark, d), "entity:user-7", 1704400000000, 1705500000000).select("id", "event_type")


def observed(spark, d):
    return schema.observed(events(spark, d)).select("event_type", "field", "kinds", "seen", F.round("share", 6).alias("share"))


def violating(spark, d, which="version <= 2"):
    rule = {"type": "object", "required": ["k", "z"], "properties": {"k": {"type": "integer"}, "value": {"type": "string"}}}
    return events(spark, d).where(which).select("id", F.array_join(schema.violations(rule), ",").alias("problems"))


def properties(spark, d):
    rules = {"k": {"type": "integer", "min": 10, "max": 80, "required": True}, "value": {"type": "number", "max": 100}, "name": {"type": "string", "required": True}}
    return events(spark, d).select("id", F.size(schema.property_errors(rules, "payload")).alias("errors"))


def expanded(spark, d, edges=few_edges):
    e = edges(spark, d)
    seeds = spark.createDataFrame([(7, 0.9), (11, 0.5)], "node long, score double")
    return R.expand(seeds, e, 1).select("node", F.round("score", 6).alias("score"))


def traced(spark, d, which="event_type = 'app.signup'"):
    links = flat_events(spark, d).where(which).select(F.concat_ws(":", F.col("k"), F.to_date("timestamp")).alias("value"), "entity_id")
    return R.trace(links, "user-7", 2)


def paired(spark, d):
    return R.steps(flat_events(spark, d), "app.view", ("app.purchase", "app.error")).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.sum("seconds").alias("seconds"))


def wire(spark, d):
    ev = flat_events(spark, d)
    w = F.when(F.col("id") % 3 == 0, ids.node_id("event_type", "entity_id")).when(F.col("id") % 3 == 1, ids.edge_id(F.col("id").cast("string"))).otherwise(ids.vector_id("entity_id"))
    return ev.select(ids.parse_id(w).alias("p")).groupBy("p.kind", "p.type").agg(F.count_distinct("p.name").alias("names"))


def replicas(spark, d):
    ev = flat_events(spark, d)
    two = ev.select("id", F.lit("a").alias("region"), ids.clock(F.unix_millis("timestamp"), F.col("k"), F.lit(1)).alias("hlc"), "entity_id", "event_type").unionByName(
        ev.where("k % 2 = 0").select("id", F.lit("b").alias("region"), ids.clock(F.unix_millis("timestamp"), F.col("k") - 1, F.lit(2)).alias("hlc"), "entity_id", "event_type")
    )
    one = archive.merge_replicas(two)
    last = archive.last_writer(one, ("app.view", "app.click"))
    return last.groupBy("region", "event_type").agg(F.count(F.lit(1)).alias("n"))


def forked(spark, d):
    ev = events(spark, d)
    own = ev.where("version = 1").withColumn("id", F.concat(F.lit("f"), "id")).withColumn("version", F.lit(11).cast("long"))
    return archive.fork(ev, 10, own).groupBy("entity_id").agg(F.max("version").alias("version"), F.count(F.lit(1)).alias("n"))


def erasure(spark, d):
    ev = events(spark, d)
    gone = ev.where("entity_id like 'user-1%'")
    left = archive.erased(archive.redacted(ev, ev.where("entity_id like 'user-2%'"), ("k",)), gone)
    return left.groupBy(F.substring("entity_id", 1, 6).alias("who")).agg(F.count(F.lit(1)).alias("n"), F.count(F.get_json_object("payload", "$.k")).alias("with_k"), F.count(F.get_json_object("payload", "$.value")).alias("with_value"))


def side(spark, d):
    return R.side_by_side(flat_events(spark, d), ["user-7", "user-11"], ["app.click", "app.view"])


QUERIES = {
    "feed_page": (page, f"WITH {EV}, p AS (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY ts, version, id) AS position FROM ev) SELECT CAST(id AS VARCHAR) AS id, event_type, position FROM p WHERE tenant_id = 't1' AND position > 100 AND event_type IN ('app.click', 'app.view') ORDER BY position LIMIT 25"),
    "stream_range": (ranged, f"WITH {EV} SELECT CAST(id AS VARCHAR) AS id, event_type FROM ev WHERE entity_id = 'user-7' AND epoch_ms(ts) BETWEEN 1704400000000 AND 1705500000000"),
    "stream_length": (lambda spark, d: feed.xlen(flat_events(spark, d), "type:app.click"), f"WITH {EV} SELECT count(*) AS n FROM ev WHERE event_type = 'app.click'"),
    "schema_observed": (observed, f"WITH {EV} SELECT event_type, f AS field, 'number' AS kinds, count(*) AS seen, 1.0::DOUBLE AS share FROM ev CROSS JOIN (VALUES ('k'), ('value')) v(f) GROUP BY ALL"),
    "schema_all_violations": (lambda spark, d: violating(spark, d, "true"), None),
    "recall_all_expand": (lambda spark, d: expanded(spark, d, user_edges), None),
    "id_all_trace": (lambda spark, d: traced(spark, d, "true"), None),
    "schema_violations": (violating, f"WITH {EV} SELECT CAST(id AS VARCHAR) AS id, '$.z: required,$.value: not string' AS problems FROM ev WHERE version <= 2"),
    "property_checks": (properties, f"WITH {EV} SELECT CAST(id AS VARCHAR) AS id, CAST(1 + CASE WHEN k NOT BETWEEN 10 AND 80 THEN 1 ELSE 0 END + CASE WHEN value > 100 THEN 1 ELSE 0 END AS INT) AS errors FROM ev"),
    "recall_expand": (
        expanded,
        f"{EDGES}, s AS (SELECT * FROM (VALUES (7::BIGINT, 0.9::DOUBLE), (11, 0.5)) v(node, sc)), nb AS (SELECT dst AS node FROM few WHERE src IN (7, 11) UNION SELECT src FROM few WHERE dst IN (7, 11)), a AS (SELECT node, 0 AS h FROM s UNION ALL SELECT node, 1 FROM nb WHERE node NOT IN (7, 11)) SELECT a.node, round(coalesce(sc, 0) * 0.5::DOUBLE + 0.3::DOUBLE / (1 + h), 6) AS score FROM a LEFT JOIN s USING (node)",
    ),
    "id_trace": (
        traced,
        f"WITH {EV}, l AS (SELECT DISTINCT k || ':' || ts::DATE AS v, entity_id FROM ev WHERE event_type = 'app.signup'), u AS (SELECT * FROM l WHERE v IN (SELECT v FROM l GROUP BY v HAVING count(*) BETWEEN 2 AND 20)), h1 AS (SELECT DISTINCT b.entity_id FROM u a JOIN u b ON a.v = b.v WHERE a.entity_id = 'user-7' AND b.entity_id <> 'user-7'), h2 AS (SELECT DISTINCT b.entity_id FROM h1 JOIN u a ON a.entity_id = h1.entity_id JOIN u b ON a.v = b.v WHERE b.entity_id <> 'user-7' AND b.entity_id NOT IN (SELECT entity_id FROM h1)) SELECT 'user-7' AS entity_id, 0 AS hops UNION ALL SELECT entity_id, 1 FROM h1 UNION ALL SELECT entity_id, 2 FROM h2",
    ),
    "step_pairs": (
        paired,
        f"WITH {EV}, n AS (SELECT *, lead(ts) OVER w AS t, lead(event_type) OVER w AS kd FROM ev WHERE event_type IN ('app.view', 'app.purchase', 'app.error') WINDOW w AS (PARTITION BY entity_id ORDER BY ts, id)) SELECT CASE WHEN kd IN ('app.purchase', 'app.error') THEN kd ELSE 'open' END AS outcome, count(*) AS n, CAST(sum(CASE WHEN kd IN ('app.purchase', 'app.error') THEN (epoch_us(t) - epoch_us(ts)) // 1000000 END) AS BIGINT) AS seconds FROM n WHERE event_type = 'app.view' GROUP BY 1",
    ),
    "wire_ids": (wire, f"WITH {EV} SELECT 'node' AS kind, event_type AS type, count(DISTINCT entity_id) AS names FROM ev WHERE id % 3 = 0 GROUP BY ALL UNION ALL SELECT 'edge', NULL, count(DISTINCT id) FROM ev WHERE id % 3 = 1 UNION ALL SELECT 'vec', NULL, count(DISTINCT entity_id) FROM ev WHERE id % 3 = 2"),
    "replica_merge": (
        replicas,
        f"WITH {EV}, o AS (SELECT *, CASE WHEN k % 2 = 0 THEN 'b' ELSE 'a' END AS region, CASE WHEN k % 2 = 0 THEN k - 1 ELSE k END AS c FROM ev), r AS (SELECT *, row_number() OVER (PARTITION BY entity_id, event_type ORDER BY epoch_ms(ts) DESC, c DESC, region DESC, id DESC) AS place FROM o) SELECT region, event_type, count(*) AS n FROM r WHERE event_type NOT IN ('app.view', 'app.click') OR place = 1 GROUP BY ALL",
    ),
    "fork_overlay": (forked, f"WITH {EV}, f AS (SELECT entity_id, version FROM ev WHERE version <= 10 UNION ALL SELECT entity_id, 11 FROM ev WHERE version = 1) SELECT entity_id, max(version) AS version, count(*) AS n FROM f GROUP BY ALL"),
    "erase_redact": (erasure, f"WITH {EV} SELECT substr(entity_id, 1, 6) AS who, count(*) AS n, count(*) FILTER (entity_id NOT LIKE 'user-2%') AS with_k, count(*) AS with_value FROM ev WHERE entity_id NOT LIKE 'user-1%' GROUP BY 1"),
    "side_by_side": (side, f"WITH {EV} SELECT entity_id, count(*) FILTER (event_type = 'app.click') AS app_click, count(*) FILTER (event_type = 'app.view') AS app_view FROM ev WHERE entity_id IN ('user-7', 'user-11') GROUP BY ALL"),
}

