"""SQL through the read-only entry point, over events and the star-schema tables, and the same text (or its twin) on DuckDB."""

from __future__ import annotations

from eventloom.plans import graphql, sql
from eventloom.plans.catalog_events import EV
from eventloom.sources.adapter import events, read_table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def over_events(statement: str, oracle: str | None = None):
    def run(spark, d):
        sql.register(spark)
        ev = events(spark, d).selectExpr("*", "cast(get_json_object(payload, '$.value') as double) as value", "cast(get_json_object(payload, '$.k') as int) as k")
        return sql.run(ev, statement)

    twin = oracle or statement
    return run, f"WITH {EV}, evs AS (SELECT *, ts AS \"timestamp\" FROM ev) " + twin.replace("FROM events", "FROM evs").replace("JOIN events", "JOIN evs")


def over_tables(statement: str, oracle: str | None = None):
    def run(spark, d):
        sql.register(spark)
        return sql.over({t: read_table(spark, d, t) for t in TABLES}, statement)

    return run, oracle or statement


def by_graphql(spark, d):
    got = graphql.run(events(spark, d), '{ events(entity_id: "user-7", event_type: "app.click", limit: 5) { id event_type nothing } }')
    return got


QUERIES = {
    "sql_group_having": over_events("SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean FROM events GROUP BY event_type HAVING count(*) > 100 ORDER BY n DESC NULLS FIRST"),
    "sql_self_join": over_events(
        "SELECT a.entity_id, count(*) AS n FROM events a JOIN events b ON a.entity_id = b.entity_id AND b.version = a.version + 1 AND a.event_type = 'app.view' AND b.event_type = 'app.purchase' GROUP BY a.entity_id"
    ),
    "sql_left_join": over_events("SELECT a.entity_id, count(b.entity_id) AS later FROM events a LEFT JOIN events b ON a.entity_id = b.entity_id AND b.version = a.version + 30 WHERE a.version <= 3 GROUP BY a.entity_id"),
    "sql_full_join": over_tables("SELECT r_name, n_name FROM region FULL OUTER JOIN (SELECT * FROM nation WHERE n_nationkey < 7) n ON r_regionkey = n_regionkey AND n_nationkey % 2 = 0"),
    "sql_semi_anti": over_tables("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000) AND c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)"),
    "sql_lateral": over_tables("SELECT n_nationkey, x.c_custkey, x.c_acctbal FROM nation, LATERAL (SELECT c_custkey, c_acctbal FROM customer WHERE c_nationkey = n_nationkey ORDER BY c_acctbal DESC, c_custkey LIMIT 2) x"),
    "sql_cube": over_tables("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice), 2) AS price FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)"),
    "sql_rollup": over_tables("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)"),
    "sql_grouping_sets": over_tables("SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())"),
    "sql_filter_aggregates": over_tables("SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(DISTINCT o_custkey) AS custs, round(stddev_samp(o_totalprice), 3) AS sd, round(corr(o_totalprice, o_custkey), 6) AS co FROM orders GROUP BY o_orderpriority"),
    "sql_median_array": over_tables("SELECT n_regionkey, median(n_nationkey) AS mid, string_agg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, median(n_nationkey) AS mid, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey"),
    "sql_ranking": over_events("SELECT id, row_number() OVER w AS rn, rank() OVER (PARTITION BY event_type ORDER BY k) AS rk, dense_rank() OVER (PARTITION BY event_type ORDER BY k) AS dr, ntile(4) OVER w AS nt FROM events WINDOW w AS (PARTITION BY event_type ORDER BY value, id)", "SELECT CAST(id AS VARCHAR) AS id, row_number() OVER w AS rn, rank() OVER (PARTITION BY event_type ORDER BY k) AS rk, dense_rank() OVER (PARTITION BY event_type ORDER BY k) AS dr, ntile(4) OVER w AS nt FROM events WINDOW w AS (PARTITION BY event_type ORDER BY value, CAST(id AS VARCHAR))"),
    "sql_offsets": over_events("SELECT id, lag(k) OVER w AS prev, lead(k, 2, -1) OVER w AS nxt, first_value(k) OVER w AS fst, nth_value(k, 3) OVER w AS third FROM events WINDOW w AS (PARTITION BY entity_id ORDER BY version)", "SELECT CAST(id AS VARCHAR) AS id, lag(k) OVER w AS prev, lead(k, 2, -1) OVER w AS nxt, first_value(k) OVER w AS fst, nth_value(k, 3) OVER w AS third FROM events WINDOW w AS (PARTITION BY entity_id ORDER BY version)"),
    "sql_range_frame": over_events("SELECT id, count(*) OVER (PARTITION BY entity_id ORDER BY timestamp RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS n FROM events", "SELECT CAST(id AS VARCHAR) AS id, count(*) OVER (PARTITION BY entity_id ORDER BY \"timestamp\" RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS n FROM events"),
    "sql_qualify": over_events("SELECT id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY value DESC, id) <= 3", "SELECT CAST(id AS VARCHAR) AS id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY value DESC, CAST(id AS VARCHAR)) <= 3"),
    "sql_union_intersect": over_tables("(SELECT n_regionkey AS k FROM nation INTERSECT ALL SELECT n_nationkey FROM nation) UNION ALL (SELECT r_regionkey FROM region EXCEPT SELECT n_nationkey FROM nation WHERE n_nationkey < 3)"),
    "sql_except_all": over_tables("SELECT n_regionkey AS k FROM nation EXCEPT ALL SELECT r_regionkey FROM region"),
    "sql_recursive": over_tables("WITH RECURSIVE t(n, f) AS (SELECT 1, 1 UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 10) SELECT n, f FROM t"),
    "sql_scalar_subquery": over_tables("SELECT p_partkey FROM part WHERE p_retailprice > (SELECT avg(p_retailprice) * 1.2 FROM part) AND p_size IN (SELECT max(p_size) FROM part GROUP BY p_brand)", "SELECT p_partkey FROM part WHERE p_retailprice > (SELECT avg(p_retailprice) * 1.2::DOUBLE FROM part) AND p_size IN (SELECT max(p_size) FROM part GROUP BY p_brand)"),
    "sql_values_unnest": over_tables("SELECT a, explode(array(b, b + 1)) AS x FROM VALUES (1, 10), (2, 20) AS t(a, b)", "SELECT a, unnest([b, b + 1]) AS x FROM (VALUES (1, 10), (2, 20)) t(a, b)"),
    "sql_dialect_functions": over_tables("SELECT n_nationkey, strpos(n_name, 'A') AS p, starts_with(n_name, 'N') AS s, make_array(n_nationkey, n_regionkey)[1] AS m FROM nation", "SELECT n_nationkey, CAST(strpos(n_name, 'A') AS INT) AS p, starts_with(n_name, 'N') AS s, n_regionkey AS m FROM nation"),
    "sql_date_bin": over_events("SELECT date_format(date_bin(INTERVAL '6' HOUR, timestamp), 'yyyy-MM-dd HH:mm:ss') AS b, count(*) AS n FROM events GROUP BY 1", "SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S') AS b, count(*) AS n FROM events GROUP BY 1"),
    "sql_pricing_summary": over_tables(
        "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS disc, round(avg(l_discount), 6) AS ad, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus"
    ),
    "sql_join_order": over_tables(
        "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey = 1 GROUP BY n_name"
    ),
    "graphql_events": (by_graphql, f"""WITH {EV} SELECT '{{"id":"' || id || '","event_type":"' || event_type || '"}}' AS event FROM ev WHERE entity_id = 'user-7' AND event_type = 'app.click' ORDER BY ts, version, id LIMIT 5"""),
}
