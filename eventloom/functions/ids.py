"""Identifiers: wire ids of nodes, edges and vectors, partitions, clocks, relative times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def node_id(kind: Column, name: Column) -> Column:
    return F.concat(F.lit("node:"), kind, F.lit(":"), name)


def edge_id(name: Column) -> Column:
    return F.concat(F.lit("edge:"), name)


def vector_id(name: Column) -> Column:
    return F.concat(F.lit("vec:"), name)


def parse_id(wire: Column) -> Column:
    """struct<kind, type, name>; a node's name may hold colons."""
    kind = F.substring_index(wire, ":", 1)
    rest = F.regexp_replace(wire, "^[^:]*:", "")
    node = kind == "node"
    return F.struct(kind.alias("kind"), F.when(node, F.substring_index(rest, ":", 1)).alias("type"), F.when(node, F.regexp_replace(rest, "^[^:]*:", "")).otherwise(rest).alias("name"))


def partition_of(entity: Column, parts: int = 32) -> Column:
    return F.pmod(F.xxhash64(entity), F.lit(parts))


def clock(ms: Column, counter: Column, node: Column) -> Column:
    """A hybrid clock; structs compare member by member."""
    return F.struct(ms.cast("long").alias("ms"), counter.cast("long").alias("counter"), node.cast("long").alias("node"))


def ago(n: int, unit: str) -> Column:
    """n days, hours or minutes before now."""
    return F.current_timestamp() - F.expr(f"interval {int(n)} {unit}")
