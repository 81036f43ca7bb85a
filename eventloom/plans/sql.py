"""The SQL entry point: one read-only statement over a tenant's events view, with a few functions of other dialects."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns that SQL sees.
COLUMNS = ("id", "event_type", "entity_id", "tenant_id", "payload", "metadata", "timestamp", "version")
#: Nodes of a parsed plan that change or set something, or read what is not a query.
READS = frozenset("""
Project Filter Aggregate Sort Distinct Union Intersect Except Join SubqueryAlias UnresolvedRelation UnresolvedWith UnresolvedHaving
GlobalLimit LocalLimit Limit Offset LocalRelation OneRowRelation UnresolvedInlineTable Generate LateralJoin Window WithWindowDefinition
UnresolvedSubqueryColumnAliases Pivot Unpivot UnresolvedTableValuedFunction Deduplicate ResolvedHint UnresolvedHint Sample AsOfJoin
TableValuedFunction UnresolvedOrdinal Expand View With UnionLoop UnresolvedTVFAliases GroupingAnalytics
""".split())


class NotReadOnly(ValueError):
    """A statement that is no query."""


def parsed_nodes(spark: SparkSession, statement: str) -> tuple[list[str], list[list[str]], set[str]]:
    """Of a statement's parsed plan, subqueries and common tables included: the names of all nodes, the relations it names, part
    by part, and the names it gives to common tables. The one place that uses the JVM's parser."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(statement)
    each = lambda seq: [seq.apply(i) for i in range(seq.size())]
    names, relations, common, todo = [], [], set(), [plan]
    while todo:
        node = todo.pop()
        names.append(node.nodeName())
        kind = node.getClass().getSimpleName()
        if kind == "UnresolvedRelation":
            relations.append(each(node.multipartIdentifier()))
        elif kind == "UnresolvedWith":
            for held in each(node.cteRelations()):
                common.add(held._1().lower())
                todo.append(held._2())
        todo += each(node.children())
        inside = each(node.expressions())
        while inside:
            e = inside.pop()
            if e.getClass().getSuperclass().getSimpleName() == "SubqueryExpression":
                todo.append(e.plan())
            inside += each(e.children())
    return names, relations, common


def check_read_only(spark: SparkSession, statement: str, tables: frozenset[str] = frozenset({"events"})) -> None:
    """Raises unless every node of the parsed statement is one of a query's and reads nothing but the named tables and the
    statement's own common tables; text tricks such as leading comments do not help."""
    names, relations, common = parsed_nodes(spark, statement)
    for name in names:
        if name.strip("'").split("(")[0].split()[0] not in READS:
            raise NotReadOnly(f"only queries are allowed, not {name}")
    if common & tables:
        raise NotReadOnly(f"taken names: {', '.join(sorted(common & tables))}")
    for parts in relations:
        if len(parts) != 1 or parts[0].lower() not in common | tables:
            raise NotReadOnly(f"not a table of this statement's: {'.'.join(parts)}")


#: Functions that other dialects call otherwise, as SQL functions of the session.
SHIMS = (
    "CREATE OR REPLACE TEMPORARY FUNCTION strpos(s STRING, t STRING) RETURNS INT RETURN instr(s, t)",
    "CREATE OR REPLACE TEMPORARY FUNCTION starts_with(s STRING, t STRING) RETURNS BOOLEAN RETURN startswith(s, t)",
    "CREATE OR REPLACE TEMPORARY FUNCTION ends_with(s STRING, t STRING) RETURNS BOOLEAN RETURN endswith(s, t)",
    "CREATE OR REPLACE TEMPORARY FUNCTION date_bin(width INTERVAL DAY TO SECOND, at TIMESTAMP) RETURNS TIMESTAMP "
    "RETURN timestamp_micros(CAST(floor(unix_micros(at) / (extract(DAY FROM width) * 86400e6 + extract(HOUR FROM width) * 3600e6 "
    "+ extract(MINUTE FROM width) * 60e6 + extract(SECOND FROM width) * 1e6)) * (extract(DAY FROM width) * 86400e6 "
    "+ extract(HOUR FROM width) * 3600e6 + extract(MINUTE FROM width) * 60e6 + extract(SECOND FROM width) * 1e6) AS BIGINT))",
    "CREATE OR REPLACE TEMPORARY FUNCTION haversine_km(a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE) RETURNS DOUBLE "
    "RETURN 2 * 6371.0 * asin(sqrt(least(power(sin(radians(c - a) / 2), 2) + cos(radians(a)) * cos(radians(c)) * power(sin(radians(d - b) / 2), 2), 1.0)))",
)


def register(spark: SparkSession) -> None:
    for s in SHIMS:
        spark.sql(s)


def translated(statement: str) -> str:
    """make_array, approx_distinct, approx_percentile_cont and string_agg by Spark's names; a QUALIFY at the end as a subquery."""
    for a, b in (("make_array", "array"), ("approx_distinct", "approx_count_distinct"), ("approx_percentile_cont", "approx_percentile"), ("string_agg", "listagg")):
        statement = re.sub(rf"\b{a}\s*\(", f"{b}(", statement, flags=re.I)
    found = re.search(r"\bQUALIFY\b", statement, flags=re.I)
    if found:
        head, tail = statement[: found.start()], statement[found.end() :]
        order = re.search(r"\bORDER\s+BY\b(?![^()]*\))", tail, flags=re.I)
        test, rest = (tail[: order.start()], tail[order.start() :]) if order else (tail, "")
        body = re.sub(r"\bFROM\b", f", ({test.strip()}) AS qualify__ FROM", head, count=1, flags=re.I)
        statement = f"SELECT * EXCEPT (qualify__) FROM ({body}) WHERE qualify__ {rest}"
    return statement


def over(tables: dict[str, DataFrame], statement: str) -> DataFrame:
    """statement over the tables, by their lower-case names, and nothing else. Their views have names of their own, so calls
    with other tables of the same names do not meet."""
    spark = next(iter(tables.values())).sparkSession
    statement = translated(statement)
    check_read_only(spark, statement, frozenset(tables))
    views = {name: f"{name}_{uuid.uuid4().hex}" for name in tables}
    for name, view in views.items():
        tables[name].createOrReplaceTempView(view)
    try:
        held = ", ".join(f"{name} AS (SELECT * FROM {view})" for name, view in views.items())
        return spark.sql(f"WITH {held} ({statement.strip().rstrip(';')}\n)")
    finally:
        for view in views.values():
            spark.catalog.dropTempView(view)


def run(events: DataFrame, statement: str, tenant_id: str | None = None) -> DataFrame:
    """statement over ``events``, one tenant's events (all, without tenant_id). The tenant's filter is part of the plan, so it
    reaches the scan."""
    rows = events if tenant_id is None else events.where(F.col("tenant_id") == tenant_id)
    return over({"events": rows.select(*[c for c in COLUMNS if c in events.columns], *[c for c in events.columns if c not in COLUMNS])}, statement)
