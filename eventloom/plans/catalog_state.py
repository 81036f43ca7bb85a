"""State folds, projection templates, agent projections, declarative views and product analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.operators import declarative as D
from eventloom.operators import filters as Q
from eventloom.operators import product as P
from eventloom.operators import state as S
from eventloom.plans.catalog_events import AT, EV, TS
from eventloom.sources.adapter import events, flat_events, stamp


def state_rows(ev):
    got = S.entity_state(ev)
    return got.select("entity_id", "event_count", "version", F.col("state")["k"].cast("int").alias("k"), F.round(F.col("state")["value"].cast("double"), 4).alias("value"))


def as_of_state(spark, d):
    return state_rows(events(spark, d).where(Q.as_of("2024-01-10 00:00:00")))


def bitemporal_events(spark, d):
    """Events that hold from k hours before their record for k days, those with k over 90 without end."""
    ev = events(spark, d)
    k = F.get_json_object("payload", "$.k").cast("int")
    begin = F.timestamp_add("HOUR", -k, "timestamp")
    return ev.withColumn("valid_from", begin).withColumn("valid_to", F.when(k <= 90, F.timestamp_add("DAY", k + 1, begin)))


def bitemporal_state(spark, d):
    ev = bitemporal_events(spark, d).where(Q.as_of("2024-01-20 00:00:00") & Q.as_of_valid("2024-01-15 00:00:00"))
    got = S.entity_state(ev, valid_order=True)
    return got.select("entity_id", "event_count", F.col("state")["k"].cast("int").alias("k"), F.round(F.col("state")["value"].cast("double"), 4).alias("value"))


def listing(spark, d):
    return S.list_entities(flat_events(spark, d), "user-1").orderBy(F.desc("last_event_at"), "entity_id").limit(30).select("entity_id", "event_count", "last_event_type", stamp("last_event_at").alias("last_at"))


def duplicates(spark, d):
    return S.detect_duplicates(flat_events(spark, d), [F.col("event_type"), F.col("k")])


def occ(spark, d):
    wanted = spark.createDataFrame([(f"user-{i}", i % 80) for i in range(0, 300, 3)], "entity_id string, expected long")
    return S.expected_version(events(spark, d), wanted).select("entity_id", "version", "ok")


def token_cost(spark, d):
    ev = flat_events(spark, d)
    calls = ev.select("entity_id", F.concat(F.lit("m"), (F.col("k") % 3).cast("string")).alias("model"), F.col("k").alias("input_tokens"), (F.col("k") * 2).alias("output_tokens"), (F.col("k") / 1024).alias("cost"))
    return S.token_usage(calls).select("entity_id", "model", "input_tokens", "output_tokens", F.round("cost", 6).alias("cost"), "calls")


def tool_latency(spark, d):
    ev = flat_events(spark, d)
    calls = ev.select(F.col("tenant_id").alias("entity_id"), F.col("event_type").alias("tool"), (F.col("k") > 10).alias("ok"), F.round(F.col("value") * 100).cast("long").alias("ms"), "timestamp", "id")
    return S.tool_audit(calls, 200).select("entity_id", "tool", "calls", F.round("success_rate", 6).alias("success_rate"), "p50", "p95")


def busy(spark, d):
    return S.utilization(flat_events(spark, d), "app.view", "app.click", "2024-01-31 00:00:00")


def compaction(spark, d):
    ev = flat_events(spark, d).where("event_type = 'app.purchase'")
    return S.compact_tokens(ev.select("entity_id", F.struct("timestamp", "id").alias("at"), F.concat(F.col("k").cast("string"), F.lit(" ")).alias("token")))


def observations(spark, d):
    ev = flat_events(spark, d)
    return ev.select(
        "entity_id", F.col("event_type").alias("field"), F.round("value", 2).alias("value"), F.date_trunc("day", "timestamp").alias("observed_at"),
        F.when(F.col("k") % 4 != 0, F.date_trunc("hour", "timestamp")).alias("recorded_at"), (F.col("k") % 5).alias("source_priority"), (F.col("k") % 7).alias("specificity_score"), F.col("id").cast("string").alias("source_event_id"),
    )


def winner(policy: str, order: str):
    def run(spark, d):
        return D.winners(observations(spark, d), policy).select("entity_id", "field", "value", "source_event_id", "contributors")

    sql = f"""WITH {EV}, o AS (SELECT entity_id, event_type AS field, round(value, 2) AS value, date_trunc('day', ts) AS observed_at, CASE WHEN k % 4 <> 0 THEN date_trunc('hour', ts) END AS recorded_at, k % 5 AS source_priority, k % 7 AS specificity_score, CAST(id AS VARCHAR) AS source_event_id FROM ev),
    r AS (SELECT *, row_number() OVER (PARTITION BY entity_id, field ORDER BY {order}, source_event_id) AS place, count(*) OVER (PARTITION BY entity_id, field) AS contributors FROM o)
    SELECT entity_id, field, value, source_event_id, contributors FROM r WHERE place = 1"""
    return run, sql


def arrays(spark, d):
    ev = flat_events(spark, d).select("entity_id", F.col("event_type").alias("field"), F.array(F.col("k") % 10, F.col("k") % 3).alias("values"))
    return D.merged_arrays(ev).select("entity_id", "field", F.array_join(F.col("values").cast("array<string>"), ",").alias("joined"))


def view(spark, d):
    ev = flat_events(spark, d)
    key = D.template("user:{entity}", {"entity": F.col("entity_id")})
    got = D.numeric_view(ev, key, [("increment", "total_k", F.col("k")), ("max", "most", F.col("value")), ("min", "least", F.col("value")), ("set", "last_k", F.when(F.col("event_type") == "app.click", F.col("k")))])
    return got


VIEW_OPS = [
    {"on": ["app.signup"], "op": "set", "field": "name", "value": "=member"},
    {"op": "increment", "field": "k", "value": "k"},
    {"op": "max", "field": "most", "value": "value"},
    {"on": ["app.purchase"], "op": "append", "field": "ks", "value": "k"},
    {"on": ["app.view"], "op": "status", "field": "status", "value": "=seen", "from": []},
    {"on": ["app.purchase"], "op": "status", "field": "status", "value": "=bought", "from": ["seen"]},
    {"on": ["app.error"], "when": {"k": 99}, "op": "delete"},
]


def folded_view(spark, d):
    return D.folded_view(events(spark, d), F.col("entity_id"), VIEW_OPS)


def attribution(model: str, weight: str):
    def run(spark, d):
        got = P.attribution(flat_events(spark, d), ("app.view", "app.click", "app.signup"), "app.purchase", model)
        return got.select("event_type", F.round("credit", 4).alias("credit"))

    sql = f"""WITH {EV}, m AS (SELECT g.id AS goal, g.value, s.event_type, s.id, s.ts, (epoch_us(g.ts) - epoch_us(s.ts)) // 1000000 AS age FROM ev g JOIN ev s ON g.entity_id = s.entity_id AND g.event_type = 'app.purchase' AND s.event_type IN ('app.view', 'app.click', 'app.signup') AND s.ts < g.ts),
    w AS (SELECT *, {weight} AS w FROM m WHERE age <= 604800), t AS (SELECT *, sum(w) OVER (PARTITION BY goal) AS all_w FROM w)
    SELECT event_type, round(sum(value * w / all_w), 4) AS credit FROM t GROUP BY event_type"""
    return run, sql


def rfm(spark, d):
    got = P.rfm(flat_events(spark, d), "app.purchase", "2024-01-31 00:00:00")
    return got.select("entity_id", "recency_days", "frequency", F.round("monetary", 4).alias("monetary"), "r", "f", "m")


def cohorts(spark, d):
    return P.cohorts(flat_events(spark, d)).select(stamp("cohort").alias("cohort"), "age", "entities")


def ltv(spark, d):
    got = P.lifetime_value(flat_events(spark, d), "app.purchase")
    return got.select("entities", "buyers", *[F.round(c, 4).alias(c) for c in ("revenue", "per_entity", "per_buyer")])


def waiting(spark, d):
    return S.waiting(flat_events(spark, d), "app.signup", ("app.purchase", "app.error")).select("entity_id", stamp("requested_at").alias("requested_at"))


def claims(spark, d):
    return S.first_claim(flat_events(spark, d), "app.signup", ("app.purchase",)).select("entity_id", stamp("claimed_at").alias("claimed_at"), "claims", "status")


STATE_SQL = """SELECT entity_id, count(*) AS event_count, {version} arg_max(k, o) AS k, round(arg_max(value, o), 4) AS value FROM (SELECT *, {order} AS o FROM {source}) GROUP BY entity_id"""
BI = """bi AS (SELECT *, ts - INTERVAL 1 HOUR * k AS vf, CASE WHEN k <= 90 THEN ts - INTERVAL 1 HOUR * k + INTERVAL 1 DAY * (k + 1) END AS vt FROM ev)"""

QUERIES = {
    "entity_state": (lambda spark, d: state_rows(events(spark, d)), f"WITH {EV} " + STATE_SQL.format(version="max(version) AS version,", order="version", source="ev")),
    "as_of_state": (as_of_state, f"WITH {EV}, p AS (SELECT * FROM ev WHERE ts <= '2024-01-10') " + STATE_SQL.format(version="max(version) AS version,", order="version", source="p")),
    "bitemporal_state": (bitemporal_state, f"WITH {EV}, {BI}, p AS (SELECT * FROM bi WHERE ts <= '2024-01-20' AND vf <= '2024-01-15' AND (vt IS NULL OR vt > '2024-01-15')) " + STATE_SQL.format(version="", order="epoch_us(vf)::HUGEINT * 100000000 + version", source="p")),
    "list_entities": (listing, f"WITH {EV} SELECT entity_id, count(*) AS event_count, arg_max(event_type, ts) AS last_event_type, {TS.format('max(ts)')} AS last_at FROM ev WHERE entity_id LIKE 'user-1%' GROUP BY entity_id ORDER BY max(ts) DESC, entity_id LIMIT 30"),
    "detect_duplicates": (duplicates, f"WITH {EV} SELECT event_type, k, count(DISTINCT entity_id) AS entities FROM ev GROUP BY ALL HAVING count(DISTINCT entity_id) > 1"),
    "count_by_type": (lambda spark, d: S.counts_by(flat_events(spark, d), "event_type"), f"WITH {EV} SELECT event_type AS value, count(*) AS n, count(DISTINCT entity_id) AS entities FROM ev GROUP BY ALL"),
    "expected_version": (occ, f"WITH {EV}, w AS (SELECT 'user-' || i AS entity_id, i % 80 AS e FROM range(0, 300, 3) t(i)), v AS (SELECT entity_id, max(version) AS v FROM ev GROUP BY ALL) SELECT w.entity_id, coalesce(v, 0) AS version, e = coalesce(v, 0) AS ok FROM w LEFT JOIN v USING (entity_id)"),
    "gapless_versions": (lambda spark, d: S.gapless(events(spark, d)), f"WITH {EV} SELECT tenant_id, entity_id, max(version) AS version, true AS ok FROM ev GROUP BY ALL"),
    "lifecycle_latest": (
        lambda spark, d: S.lifecycle(flat_events(spark, d), "app.").select("entity_id", "state", "n", stamp("since").alias("since")),
        f"WITH {EV} SELECT entity_id, substr(arg_max(event_type, ts), 5) AS state, count(*) AS n, {TS.format('min(ts)')} AS since FROM ev GROUP BY entity_id",
    ),
    "type_leaderboard": (lambda spark, d: S.leaderboard(flat_events(spark, d)), f"WITH {EV}, c AS (SELECT event_type, count(*) AS n FROM ev GROUP BY ALL) SELECT event_type, n, CAST(row_number() OVER (ORDER BY n DESC, event_type) AS INT) AS place FROM c"),
    "events_per_day_90": (lambda spark, d: S.events_per_day(flat_events(spark, d)), f"WITH {EV} SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM ev GROUP BY 1 ORDER BY 1 DESC LIMIT 90"),
    "entity_activity": (
        lambda spark, d: S.entity_activity(flat_events(spark, d)).select("entity_id", "n", "last_type", stamp("last_at").alias("last_at")),
        f"WITH {EV} SELECT entity_id, count(*) AS n, arg_max(event_type, ts) AS last_type, {TS.format('max(ts)')} AS last_at FROM ev GROUP BY entity_id",
    ),
    "active_entities": (
        lambda spark, d: S.active_entities(flat_events(spark, d)).select("entity_id", stamp("last_at").alias("last_at"), "distinct"),
        f"WITH {EV} SELECT entity_id, {TS.format('max(ts)')} AS last_at, (SELECT count(DISTINCT entity_id) FROM ev) AS \"distinct\" FROM ev GROUP BY entity_id ORDER BY max(ts) DESC, entity_id LIMIT 50",
    ),
    "token_cost_by_model": (token_cost, f"WITH {EV} SELECT entity_id, 'm' || (k % 3) AS model, CAST(sum(k) AS BIGINT) AS input_tokens, CAST(sum(k * 2) AS BIGINT) AS output_tokens, round(sum(CAST(round(k / 1024.0::DOUBLE * 1e6::DOUBLE) AS BIGINT)) / 1e6::DOUBLE, 6) AS cost, count(*) AS calls FROM ev GROUP BY ALL"),
    "tool_latency_p95": (
        tool_latency,
        f"""WITH {EV}, c AS (SELECT tenant_id AS entity_id, event_type AS tool, k > 10 AS ok, CAST(round(value * 100) AS BIGINT) AS ms, row_number() OVER (PARTITION BY tenant_id, event_type ORDER BY ts DESC, id DESC) AS back FROM ev),
        l AS (SELECT entity_id, tool, list_sort(list(ms)) AS s FROM c WHERE back <= 200 GROUP BY ALL)
        SELECT c.entity_id, c.tool, count(*) AS calls, round(avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS success_rate, any_value(s[len(s) // 2 + 1]) AS p50, any_value(s[least(ceil(len(s) * 0.95), len(s) - 1)::INT + 1]) AS p95 FROM c JOIN l USING (entity_id, tool) GROUP BY ALL""",
    ),
    "human_queue": (waiting, f"WITH {EV} SELECT entity_id, {TS.format('max(ts)')} AS requested_at FROM ev WHERE event_type IN ('app.signup', 'app.purchase', 'app.error') GROUP BY entity_id HAVING arg_max(event_type, ts) = 'app.signup'"),
    "workflow_claims": (
        claims,
        f"WITH {EV} SELECT entity_id, {TS.format('min(ts) FILTER (event_type = $$app.signup$$)')} AS claimed_at, count(*) FILTER (event_type = 'app.signup') AS claims, CASE WHEN max(ts) FILTER (event_type = 'app.purchase') > min(ts) FILTER (event_type = 'app.signup') THEN 'done' ELSE 'claimed' END AS status FROM ev GROUP BY entity_id HAVING count(*) FILTER (event_type = 'app.signup') > 0",
    ),
    "agent_utilization": (
        busy,
        f"WITH {EV}, n AS (SELECT *, lead(ts) OVER (PARTITION BY entity_id ORDER BY ts, id) AS nx FROM ev WHERE event_type IN ('app.view', 'app.click')) SELECT entity_id, CAST(sum((epoch_us(coalesce(nx, TIMESTAMP '2024-01-31')) - epoch_us(ts)) // 1000000) AS BIGINT) AS busy_seconds, count(*) FILTER (nx IS NULL) AS open FROM n WHERE event_type = 'app.view' GROUP BY entity_id",
    ),
    "token_compaction": (compaction, f"WITH {EV} SELECT entity_id, string_agg(k || ' ', '' ORDER BY ts, id) AS text, count(*) AS tokens FROM ev WHERE event_type = 'app.purchase' GROUP BY entity_id"),
    "fold_last_write": winner("last_write", "observed_at DESC, recorded_at DESC NULLS LAST"),
    "fold_highest_priority": winner("highest_priority", "source_priority DESC, observed_at DESC, recorded_at DESC NULLS LAST"),
    "fold_most_specific": winner("most_specific", "specificity_score DESC, observed_at DESC, recorded_at DESC NULLS LAST"),
    "fold_merge_array": (arrays, f"WITH {EV} SELECT entity_id, field, array_to_string(list_sort(list(DISTINCT v)), ',') AS joined FROM (SELECT entity_id, event_type AS field, unnest([k % 10, k % 3]) AS v FROM ev) GROUP BY ALL"),
    "view_increment_max": (
        view,
        f"WITH {EV} SELECT 'user:' || entity_id AS key, CAST(sum(k) AS BIGINT) AS total_k, max(value) AS most, min(value) AS least, arg_max(k, ts) FILTER (event_type = 'app.click') AS last_k FROM ev GROUP BY entity_id",
    ),
    "view_folded": (folded_view, None),
    "cohorts": (cohorts, f"WITH {EV}, a AS (SELECT DISTINCT entity_id, date_trunc('week', ts)::TIMESTAMP AS w FROM ev), f AS (SELECT entity_id, min(w) AS c FROM a GROUP BY ALL) SELECT {TS.format('c')} AS cohort, CAST(date_diff('day', c, w) // 7 AS BIGINT) AS age, count(*) AS entities FROM a JOIN f USING (entity_id) GROUP BY c, w"),
    "funnel": (
        lambda spark, d: P.funnel(flat_events(spark, d), ("app.view", "app.click", "app.purchase")),
        f"WITH {EV}, a AS (SELECT entity_id, min(ts) AS t FROM ev WHERE event_type = 'app.view' GROUP BY ALL), b AS (SELECT ev.entity_id, min(ts) AS t FROM ev JOIN a ON a.entity_id = ev.entity_id AND ts > t WHERE event_type = 'app.click' GROUP BY ALL), c AS (SELECT ev.entity_id FROM ev JOIN b ON b.entity_id = ev.entity_id AND ts > t WHERE event_type = 'app.purchase' GROUP BY ALL) SELECT 1 AS step, 'app.view' AS event_type, (SELECT count(*) FROM a) AS entities UNION ALL SELECT 2, 'app.click', (SELECT count(*) FROM b) UNION ALL SELECT 3, 'app.purchase', (SELECT count(*) FROM c)",
    ),
    "paths": (lambda spark, d: P.paths(flat_events(spark, d)), f"WITH {EV}, p AS (SELECT event_type AS a, lead(event_type) OVER w AS b, lead(event_type, 2) OVER w AS c FROM ev WINDOW w AS (PARTITION BY entity_id ORDER BY ts, id)) SELECT a || ' > ' || b || ' > ' || c AS path, count(*) AS n FROM p WHERE c IS NOT NULL GROUP BY 1"),
    "attribution_first": attribution("first", "CASE WHEN row_number() OVER (PARTITION BY goal ORDER BY ts, id) = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"),
    "attribution_last": attribution("last", "CASE WHEN row_number() OVER (PARTITION BY goal ORDER BY ts DESC, id DESC) = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"),
    "attribution_linear": attribution("linear", "1.0::DOUBLE"),
    "attribution_decay": attribution("time_decay", "power(0.5::DOUBLE, age / 86400.0::DOUBLE)"),
    "rfm": (
        rfm,
        f"WITH {EV}, g AS (SELECT entity_id, date_diff('day', max(ts)::DATE, DATE '2024-01-31') AS recency_days, count(*) AS frequency, sum(value) AS monetary FROM ev WHERE event_type = 'app.purchase' GROUP BY ALL) SELECT entity_id, CAST(recency_days AS INT) AS recency_days, frequency, round(monetary, 4) AS monetary, CAST(ntile(4) OVER (ORDER BY recency_days, entity_id) AS INT) AS r, CAST(ntile(4) OVER (ORDER BY frequency DESC, entity_id) AS INT) AS f, CAST(ntile(4) OVER (ORDER BY round(monetary, 6) DESC, entity_id) AS INT) AS m FROM g",
    ),
    "churn": (lambda spark, d: P.churn(flat_events(spark, d), "2024-01-31 00:00:00", 1), f"WITH {EV}, l AS (SELECT entity_id, max(ts) AS t FROM ev GROUP BY ALL) SELECT date_diff('day', t::DATE, DATE '2024-01-31') > 1 AS churned, count(*) AS entities FROM l GROUP BY 1"),
    "lifetime_value": (ltv, f"WITH {EV}, e AS (SELECT entity_id, sum(value) FILTER (event_type = 'app.purchase') AS v FROM ev GROUP BY ALL) SELECT count(*) AS entities, count(v) AS buyers, round(sum(v), 4) AS revenue, round(sum(v) / count(*), 4) AS per_entity, round(avg(v), 4) AS per_buyer FROM e"),
    "forecast": (
        lambda spark, d: P.forecast(flat_events(spark, d)).select("day_number", F.round("n", 5).alias("n")),
        f"WITH {EV}, c AS (SELECT ts::DATE AS d, count(*) AS n FROM ev GROUP BY 1), x AS (SELECT date_diff('day', (SELECT min(d) FROM c), d) AS x, n FROM c), l AS (SELECT regr_slope(n, x) AS a, regr_intercept(n, x) AS b, max(x) AS hi FROM x) SELECT CAST(hi + i AS INT) AS day_number, round(a * (hi + i) + b, 5) AS n FROM l CROSS JOIN range(1, 8) t(i)",
    ),
    "sample_stratified": (
        lambda spark, d: P.stratified(flat_events(spark, d), "event_type", 5).select("id", "event_type"),
        f"WITH {EV}, r AS (SELECT id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY md5(CAST(id AS VARCHAR)), id) AS place FROM ev) SELECT id, event_type FROM r WHERE place <= 5",
    ),
}
