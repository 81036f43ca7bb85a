"""Reads and analytics over the canonical events."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.operators import analytics as A
from eventloom.operators import filters as Q
from eventloom.operators import pipeline as P
from eventloom.sources.adapter import events, flat_events, stamp

#: The canonical events in SQL.
EV = """ev AS (
  SELECT event_id AS id, 'app.' || event_type AS event_type, 'user-' || user_id AS entity_id, 't' || (user_id % 3) AS tenant_id,
         ts, value, CAST(json_extract(props, '$.k') AS INT) AS k,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version
  FROM events
)"""
TS = "strftime({}, '%Y-%m-%d %H:%M:%S')"
AT = TS.format("ts")


def frequency(unit: str):
    def run(spark, d):
        return A.event_frequency(flat_events(spark, d), unit).select(stamp("bucket").alias("bucket"), "event_type", "n")

    sql = f"""WITH {EV}, c AS (SELECT date_trunc('{unit}', ts) AS b, event_type, count(*) AS n FROM ev GROUP BY 1, 2),
    g AS (SELECT unnest(generate_series((SELECT date_trunc('{unit}', min(ts)) FROM ev), (SELECT date_trunc('{unit}', max(ts)) FROM ev), INTERVAL 1 {unit})) AS b)
    SELECT {TS.format('g.b')} AS bucket, t.event_type, CAST(coalesce(c.n, 0) AS BIGINT) AS n
    FROM g CROSS JOIN (SELECT DISTINCT event_type FROM c) t LEFT JOIN c ON c.b = g.b AND c.event_type = t.event_type"""
    return run, sql


def selected(q: Q.EventQuery, where: str, tail: str = ""):
    def run(spark, d):
        return Q.query(events(spark, d), q).select("id", "event_type", "entity_id", "version", stamp("timestamp").alias("at"))

    sql = f"WITH {EV} SELECT CAST(id AS VARCHAR) AS id, event_type, entity_id, version, {AT} AS at FROM ev WHERE {where} {tail}"
    return run, sql


def page(spark, d):
    q = Q.EventQuery(event_type="app.click", limit=20, offset=10, descending=True)
    return Q.page(events(spark, d), q).select("id", "total", "has_more")


def tree(spark, d):
    ev = flat_events(spark, d)
    p = {"and": [{"after": "2024-01-03 00:00:00"}, {"or": [{"type_prefix": "app.p"}, {"entity_prefix": "user-1"}]}, {"between": ["2024-01-02 00:00:00", "2024-01-20 12:00:00"]}]}
    return ev.where(Q.predicate(p)).groupBy("event_type", "tenant_id").agg(F.count(F.lit(1)).alias("n"))


def dsl_predicates(spark, d):
    ev = flat_events(spark, d)
    c = Q.dsl("and", value=[Q.dsl("gte", "value", 5.0), Q.dsl("not", value=Q.dsl("in", "event_type", ["app.view", "app.error"])), Q.dsl("or", value=[Q.dsl("between", "k", (10, 40)), Q.dsl("contains", "entity_id", "7")])])
    return ev.where(c).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


def fan_out(spark, d):
    subs = spark.createDataFrame([("s1", "*"), ("s2", "app.*"), ("s3", "app.click"), ("s4", "app"), ("s5", "other.*")], "subscription_id string, pattern string")
    return Q.fan_out(flat_events(spark, d), subs).groupBy("subscription_id").agg(F.count(F.lit(1)).alias("n"))


def patterns(spark, d):
    ev = flat_events(spark, d)
    count = lambda c: F.count_if(c)
    return ev.agg(count(Q.consumer_match("app.*")).alias("consumer"), count(Q.consumer_match("app")).alias("exact"), count(Q.websocket_match("app.*")).alias("websocket"), count(Q.webhook_match("*")).alias("webhook"))


def projected(spark, d):
    ev = events(spark, d)
    return ev.where(Q.contains_all("payload", ['"k":', "value"])).groupBy(Q.namespace().alias("namespace"), Q.action().alias("action")).agg(F.sum(F.get_json_object("payload", "$.k").cast("long")).alias("k"), F.count_if(Q.valid_type() & Q.valid_entity()).alias("valid"))


def scoped(spark, d):
    seen = flat_events(spark, d).where("event_type = 'app.purchase' and value > 50").select("entity_id")
    return Q.allowed(flat_events(spark, d), seen).groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))


def summary(spark, d):
    got = A.summary_totals(flat_events(spark, d))
    return got.select("total", "entities", "types", stamp("first_at").alias("first_at"), stamp("last_at").alias("last_at"), "days", F.round("events_per_day", 6).alias("events_per_day"))


def top(column: str):
    run = lambda spark, d: A.top_counts(flat_events(spark, d), column).select("value", "n", F.round("share", 6).alias("share"))
    return run, f"WITH {EV} SELECT {column} AS value, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM ev), 6)::DOUBLE AS share FROM ev GROUP BY 1 ORDER BY n DESC, value LIMIT 10"


def correlation(spark, d):
    got = A.correlation(flat_events(spark, d), "app.view", "app.purchase", 3600)
    return got.select("total_a", "total_b", "pairs", F.round("percent", 6).alias("percent"), F.round("mean_gap_s", 6).alias("mean_gap_s"))


def sliding(spark, d):
    return A.sliding(flat_events(spark, d), "hour", 6, 3).select(stamp("start").alias("start"), stamp("end").alias("end"), "n")


def sessions(spark, d):
    return A.sessions(flat_events(spark, d)).select("entity_id", "session", "n", stamp("started").alias("started"), "seconds")


def usage(spark, d):
    return A.daily_usage(flat_events(spark, d)).select("tenant_id", stamp("bucket").alias("bucket"), "n")


def bursts(spark, d):
    return A.anomalies(flat_events(spark, d), "app.error", 2, 6 * 3600)


def volume(spark, d):
    return A.unusual_volume(flat_events(spark, d), 1.9).select("entity_id", stamp("hour").alias("hour"), "n", F.round("mean", 6).alias("mean"))


def pipeline_steps(spark, d):
    steps = [{"filter": ("gt", "value", 20)}, {"map": ("value", "multiply:2")}, {"map": ("value", "add:1")}, {"branch": [("gt", "k", 50, "high"), ("lt", "k", 20, "low")]}]
    out = P.apply_steps(events(spark, d), steps)
    return out.groupBy("event_type", F.coalesce("route", F.lit("none")).alias("route")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(P.number("value")), 4).alias("total"))


def pipeline_reduce(spark, d):
    made = events(spark, d).withColumn("payload", F.concat(F.regexp_replace("payload", r"\}$", ""), F.lit(',"type":"'), "event_type", F.lit('"}')))
    out = None
    for f in ("count", "sum", "avg", "min", "max"):
        got = P.reduced(made, f, "value", "type").select("group", F.lit(f).alias("function"), "n", F.round("value", 6).alias("value"))
        out = got if out is None else out.unionByName(got)
    return out


def running(spark, d):
    got = P.running(flat_events(spark, d), "sum", "value", F.col("entity_id"))
    return got.select("id", F.round("running", 4).alias("running"))


def tumbling(spark, d):
    got = P.tumbling(flat_events(spark, d), "6 hours")
    return got.select(stamp("start").alias("start"), stamp("end").alias("end"), "event_type", "n", F.round("total", 4).alias("total"))


def hopping(spark, d):
    got = P.tumbling(flat_events(spark, d), "2 hours", "1 hour", ("tenant_id",))
    return got.select(stamp("start").alias("start"), "tenant_id", "n", F.round("total", 4).alias("total"))


def trailing(spark, d):
    return P.trailing(flat_events(spark, d), 7200).select("id", "n", F.round("total", 4).alias("total"))


def enrich(spark, d):
    nations = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("k"), "n_name")
    got = P.enriched(flat_events(spark, d), nations, "k")
    return got.groupBy(F.coalesce("n_name", F.lit("none")).alias("name")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "event_frequency_day": frequency("day"),
    "event_frequency_hour": frequency("hour"),
    "event_frequency_week": (
        lambda spark, d: A.event_frequency(flat_events(spark, d), "week", by=()).select(stamp("bucket").alias("bucket"), "n"),
        f"WITH {EV} SELECT {TS.format('b')} AS bucket, count(*) AS n FROM (SELECT date_trunc('week', ts)::TIMESTAMP AS b FROM ev) GROUP BY 1",
    ),
    "query_by_entity_page": selected(Q.EventQuery(entity_id="user-7", limit=25, offset=5), "entity_id = 'user-7'", "ORDER BY ts, version, id LIMIT 25 OFFSET 5"),
    "query_time_range": selected(Q.EventQuery(since="2024-01-05 00:00:00", until="2024-01-06 12:00:00"), "ts BETWEEN '2024-01-05' AND '2024-01-06 12:00:00'"),
    "query_prefix_exclude": selected(Q.EventQuery(tenant_id="t1", event_type_prefix="app.", exclude_event_type_prefix="app.click,app.view"), "tenant_id = 't1' AND event_type NOT LIKE 'app.click%' AND event_type NOT LIKE 'app.view%'"),
    "query_payload_filter": selected(Q.EventQuery(payload_filter={"k": 42}), "k = 42"),
    "query_as_of": selected(Q.EventQuery(as_of="2024-01-02 00:00:00", descending=True, limit=50), "ts <= '2024-01-02'", "ORDER BY ts DESC, version DESC, id DESC LIMIT 50"),
    "query_window_page": (
        page,
        f"WITH {EV} SELECT CAST(id AS VARCHAR) AS id, (SELECT count(*) FROM ev WHERE event_type = 'app.click') AS total, (SELECT count(*) FROM ev WHERE event_type = 'app.click') > 30 AS has_more FROM ev WHERE event_type = 'app.click' ORDER BY ts DESC, version DESC, id DESC LIMIT 20 OFFSET 10",
    ),
    "predicate_tree": (tree, f"WITH {EV} SELECT event_type, tenant_id, count(*) AS n FROM ev WHERE ts > '2024-01-03' AND (event_type LIKE 'app.p%' OR entity_id LIKE 'user-1%') AND ts BETWEEN '2024-01-02' AND '2024-01-20 12:00:00' GROUP BY ALL"),
    "dsl_predicates": (dsl_predicates, f"WITH {EV} SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM ev WHERE value >= 5 AND event_type NOT IN ('app.view', 'app.error') AND (k BETWEEN 10 AND 40 OR entity_id LIKE '%7%') GROUP BY ALL"),
    "webhook_fan_out": (fan_out, f"WITH {EV} SELECT s AS subscription_id, count(*) AS n FROM ev JOIN (VALUES ('s1', '%'), ('s2', 'app.%'), ('s3', 'app.click')) v(s, p) ON event_type LIKE p GROUP BY ALL"),
    "type_patterns": (patterns, f"WITH {EV} SELECT count(*) AS consumer, CAST(0 AS BIGINT) AS exact, count(*) AS websocket, count(*) AS webhook FROM ev"),
    "payload_projection": (projected, f"WITH {EV} SELECT 'app' AS namespace, substr(event_type, 5) AS action, CAST(sum(k) AS BIGINT) AS k, count(*) AS valid FROM ev GROUP BY ALL"),
    "read_scope": (scoped, f"WITH {EV} SELECT entity_id, count(*) AS n FROM ev WHERE entity_id IN (SELECT entity_id FROM ev WHERE event_type = 'app.purchase' AND value > 50) GROUP BY ALL"),
    "summary_totals": (
        summary,
        f"WITH {EV}, s AS (SELECT count(*) AS total, count(DISTINCT entity_id) AS entities, count(DISTINCT event_type) AS types, min(ts) AS lo, max(ts) AS hi FROM ev) SELECT total, entities, types, {TS.format('lo')} AS first_at, {TS.format('hi')} AS last_at, CAST(greatest(floor((epoch(date_trunc('second', hi)) - epoch(date_trunc('second', lo))) / 86400), 1) AS BIGINT) AS days, round(total / greatest(floor((epoch(date_trunc('second', hi)) - epoch(date_trunc('second', lo))) / 86400), 1), 6)::DOUBLE AS events_per_day FROM s",
    ),
    "summary_top_types": top("event_type"),
    "summary_top_entities": top("entity_id"),
    "correlation_pairs": (
        correlation,
        f"""WITH {EV}, q AS (SELECT count(*) AS pairs, avg(gap) AS g FROM (SELECT abs(epoch_us(a.ts) - epoch_us(b.ts)) // 1000000 AS gap FROM ev a JOIN ev b ON a.entity_id = b.entity_id AND a.event_type = 'app.view' AND b.event_type = 'app.purchase') WHERE gap <= 3600)
        SELECT (SELECT count(*) FROM ev WHERE event_type = 'app.view') AS total_a, (SELECT count(*) FROM ev WHERE event_type = 'app.purchase') AS total_b, pairs, round(pairs * 100.0 / (SELECT count(*) FROM ev WHERE event_type = 'app.view'), 6)::DOUBLE AS percent, round(g, 6) AS mean_gap_s FROM q""",
    ),
    "percentiles_value": (
        lambda spark, d: A.percentiles(flat_events(spark, d), "value", by=("event_type",)).select("event_type", "rank", F.round("value", 6).alias("value")),
        f"WITH {EV} SELECT event_type, r AS rank, round(quantile_cont(value, r / 100), 6) AS value FROM (SELECT event_type, value, 1 AS one FROM ev) CROSS JOIN (VALUES (50.0::DOUBLE), (90.0), (95.0), (99.0)) v(r) GROUP BY event_type, r".replace("quantile_cont(value, r / 100)", "CASE r WHEN 50 THEN quantile_cont(value, 0.5) WHEN 90 THEN quantile_cont(value, 0.9) WHEN 95 THEN quantile_cont(value, 0.95) ELSE quantile_cont(value, 0.99) END"),
    ),
    "stddev_value": (
        lambda spark, d: A.spread(flat_events(spark, d), "value", ("event_type",)).select("event_type", "n", *[F.round(c, 5).alias(c) for c in ("mean", "variance", "stddev", "min", "max")]),
        f"WITH {EV} SELECT event_type, count(value) AS n, round(avg(value), 5) AS mean, round(var_pop(value), 5) AS variance, round(stddev_pop(value), 5) AS stddev, round(min(value), 5) AS min, round(max(value), 5) AS max FROM ev GROUP BY ALL",
    ),
    "sliding_hours": (
        sliding,
        f"""WITH {EV}, g AS (SELECT unnest(generate_series((SELECT date_trunc('hour', min(ts)) FROM ev), (SELECT date_trunc('hour', max(ts)) FROM ev), INTERVAL 1 hour)) AS b),
        c AS (SELECT g.b, count(ev.ts) AS n FROM g LEFT JOIN ev ON date_trunc('hour', ev.ts) = g.b GROUP BY g.b),
        w AS (SELECT b, row_number() OVER (ORDER BY b) AS place, sum(n) OVER f AS n, count(*) OVER f AS held, max(b) OVER f AS e FROM c WINDOW f AS (ORDER BY b ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING))
        SELECT {TS.format('b')} AS start, {TS.format('e')} AS "end", CAST(n AS BIGINT) AS n FROM w WHERE held = 6 AND (place - 1) % 3 = 0""",
    ),
    "session_per_user": (
        sessions,
        f"""WITH {EV}, m AS (SELECT *, CASE WHEN (epoch_us(ts) - epoch_us(lag(ts) OVER w)) // 1000000 <= 1800 THEN 0 ELSE 1 END AS new FROM ev WINDOW w AS (PARTITION BY entity_id ORDER BY ts, id)),
        s AS (SELECT *, sum(new) OVER (PARTITION BY entity_id ORDER BY ts, id) AS session FROM m)
        SELECT entity_id, CAST(session AS BIGINT) AS session, count(*) AS n, {TS.format('min(ts)')} AS started, CAST((epoch_us(max(ts)) - epoch_us(min(ts))) // 1000000 AS BIGINT) AS seconds FROM s GROUP BY entity_id, session""",
    ),
    "daily_usage": (usage, f"WITH {EV} SELECT tenant_id, {TS.format('b')} AS bucket, count(*) AS n FROM (SELECT tenant_id, date_trunc('day', ts)::TIMESTAMP AS b FROM ev) GROUP BY ALL"),
    "anomaly_bursts": (
        bursts,
        f"WITH {EV}, m AS (SELECT tenant_id, entity_id, count(*) OVER (PARTITION BY entity_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW) AS near FROM ev WHERE event_type = 'app.error') SELECT tenant_id, entity_id, count(*) AS alerts, max(near) AS most FROM m WHERE near >= 2 GROUP BY ALL",
    ),
    "anomaly_volume": (
        volume,
        f"WITH {EV}, h AS (SELECT entity_id, date_trunc('hour', ts)::TIMESTAMP AS hour, count(*) AS n FROM ev GROUP BY ALL), m AS (SELECT *, avg(n) OVER (PARTITION BY entity_id) AS mean FROM h) SELECT entity_id, {TS.format('hour')} AS hour, n, round(mean, 6) AS mean FROM m WHERE n > mean * 1.9::DOUBLE",
    ),
    "pipeline_filter_map_branch": (
        pipeline_steps,
        f"WITH {EV} SELECT event_type, CASE WHEN k > 50 THEN 'high' WHEN k < 20 THEN 'low' ELSE 'none' END AS route, count(*) AS n, round(sum(value * 2 + 1), 4) AS total FROM ev WHERE value > 20 GROUP BY ALL",
    ),
    "pipeline_reduce": (
        pipeline_reduce,
        f"""WITH {EV} SELECT event_type AS "group", 'count' AS "function", count(*) AS n, count(*)::DOUBLE AS value FROM ev GROUP BY ALL
        UNION ALL SELECT event_type, 'sum', count(*), round(sum(value), 6) FROM ev GROUP BY ALL UNION ALL SELECT event_type, 'avg', count(*), round(avg(value), 6) FROM ev GROUP BY ALL
        UNION ALL SELECT event_type, 'min', count(*), round(min(value), 6) FROM ev GROUP BY ALL UNION ALL SELECT event_type, 'max', count(*), round(max(value), 6) FROM ev GROUP BY ALL""",
    ),
    "pipeline_running_sum": (running, f"WITH {EV} SELECT id, round(sum(value) OVER (PARTITION BY entity_id ORDER BY ts, id), 4) AS running FROM ev"),
    "tumbling_window": (
        tumbling,
        f"WITH {EV}, b AS (SELECT *, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS s FROM ev) SELECT {TS.format('s')} AS start, {TS.format('s + INTERVAL 6 HOUR')} AS \"end\", event_type, count(*) AS n, round(sum(value), 4) AS total FROM b GROUP BY s, event_type",
    ),
    "sliding_window": (
        hopping,
        f"WITH {EV}, b AS (SELECT *, date_trunc('hour', ts) - INTERVAL 1 HOUR * o AS s FROM ev CROSS JOIN (VALUES (0), (1)) v(o)) SELECT {TS.format('s')} AS start, tenant_id, count(*) AS n, round(sum(value), 4) AS total FROM b GROUP BY s, tenant_id",
    ),
    "trailing_window": (
        trailing,
        f"WITH {EV} SELECT id, count(*) OVER w AS n, round(sum(value) OVER w, 4) AS total FROM ev WINDOW w AS (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 2 HOUR PRECEDING AND CURRENT ROW)",
    ),
    "enrich_lookup": (enrich, f"WITH {EV} SELECT coalesce(n_name, 'none') AS name, count(*) AS n FROM ev LEFT JOIN nation ON n_nationkey = k GROUP BY ALL"),
}
