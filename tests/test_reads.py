"""Graph reads and fielded queries on small cases; the queries themselves are compared with SQL in test_catalog."""

import pytest
from pyspark.sql import functions as F

from eventloom.operators import graph, search
from eventloom.operators import graph_reads as R


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def times(df):
    return df.withColumn("timestamp", F.col("timestamp").cast("timestamp"))


@pytest.fixture(scope="module")
def edges(spark):
    made = [("e1", "2026-01-01", "a", "b", "knows"), ("e2", "2026-01-02", "b", "c", "knows"), ("e1", "2026-01-04", "a", "d", "owns"), ("e3", "2026-01-03", "a", "c", "owns")]
    gone = [("e2", "2026-01-03")]
    return times(spark.createDataFrame(made, "edge string, timestamp string, src string, dst string, relation string")), times(spark.createDataFrame(gone, "edge string, timestamp string"))


def test_edges_at_times(edges):
    assert rows(R.edges_as_of(*edges, "2026-01-02"), "edge", "dst") == [("e1", "b"), ("e2", "c")]
    assert rows(R.edges_as_of(*edges, "2026-01-05"), "edge", "dst") == [("e1", "d"), ("e3", "c")]
    assert rows(R.edges_as_of(*edges, "2025-01-01"), "edge") == []
    assert rows(R.neighbors_as_of(*edges, "a", "2026-01-05", "owns"), "node") == [("c",), ("d",)]
    assert rows(R.bfs_as_of(*edges, "a", 2, "2026-01-02"), "node", "depth") == [("a", 0), ("b", 1), ("c", 2)]
    assert rows(graph.neighbors(edges[0], "a", "out", "knows"), "node") == [("b",)]


def test_valid_time(spark):
    made = [("doc", "2026-01-01", "2026-01-01", None), ("fix", "2026-03-05", "2026-02-01", "2026-03-01")]
    table = times(spark.createDataFrame(made, "node string, timestamp string, valid_from string, valid_to string"))
    table = table.withColumn("valid_from", F.col("valid_from").cast("timestamp")).withColumn("valid_to", F.col("valid_to").cast("timestamp"))
    at = lambda system, valid: rows(table.where(R.known_at(system, valid)), "node")
    assert at("2026-03-10", "2026-02-15") == [("doc",), ("fix",)]
    assert at("2026-03-01", "2026-02-15") == [("doc",)]
    assert at("2026-03-10", "2026-03-01") == [("doc",)]


def test_properties_follow_creations_updates_and_deletes(spark):
    events = [
        (1, "n", "updated", {"early": "1"}), (2, "n", "created", {"a": "1", "b": "1"}), (3, "n", "updated", {"b": "2"}), (4, "n", "updated", None),
        (5, "gone", "created", {"a": "1"}), (6, "gone", "deleted", None), (7, "gone", "updated", {"a": "2"}),
        (8, "again", "created", {"a": "1"}), (9, "again", "deleted", None), (10, "again", "created", {"c": "1"}),
    ]
    table = spark.createDataFrame([(i, f"2026-01-{i:02d}", *x) for i, *x in events], "id long, timestamp string, node string, kind string, properties map<string, string>")
    assert rows(R.node_properties(times(table)), "node", "name", "value") == [("again", "c", "1"), ("n", "a", "1"), ("n", "b", "2")]
    assert R.node_properties(times(table).limit(0)).count() == 0


def test_similar_leaves_the_node_out(spark):
    table = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.1]), ("c", [0.0, 1.0]), ("d", [1.0])], "id string, embedding array<double>")
    assert [r.id for r in R.similar(table, "a", 5).collect()] == ["b", "c"]
    assert [r.id for r in R.similar(table, "a", 5, max_distance=0.5).collect()] == ["b"]
    assert [r.id for r in R.similar(table, "a", 5, max_distance=0.5, metric="euclidean").collect()] == ["b"]
    assert R.similar(table, "nobody").count() == 0


def test_fielded_queries(spark):
    docs = spark.createDataFrame([(1, "The order shipped", "en"), (2, "refund of the order", "en"), (3, "la commande", "fr"), (4, None, "en")], "id long, text string, lang string")

    def found(query):
        return [i for (i,) in rows(docs.where(search.boolean_query(query, F.col("text"), {"lang": F.col("lang")})), "id")]

    assert found("order") == [1, 2]
    assert found("shipped OR refund") == [1, 2]
    assert found("shipped OR refund OR commande -lang:fr") == [1, 2]
    assert found("lang:en sh*ed") == [1] and found("ord?r -refund") == [1]
    assert found('"the order"') == [1, 2] and found('"order the"') == []
    with pytest.raises(ValueError, match="unknown field"):
        found("tenant:x")
