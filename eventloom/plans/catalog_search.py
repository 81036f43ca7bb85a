"""Vectors, keywords, fusion and geo queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.functions import geo
from eventloom.operators import search as V
from eventloom.plans.catalog_events import EV
from eventloom.sources.adapter import flat_events, read_table

WORDS = "onent thereon inand the of"
#: A query vector by rule.
PROBE = [((i * 37) % 64 - 31.5) / 32 for i in range(64)]


def vectors(spark, d):
    return read_table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def docs(spark, d):
    return read_table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


def vector(metric: str, sql: str):
    def run(spark, d):
        return V.nearest(vectors(spark, d), PROBE, 10, metric).select("id", F.round("score", 6).alias("score"))

    q = "[" + ", ".join(f"{x}" for x in PROBE) + "]::DOUBLE[]"
    return run, f"SELECT vec_id AS id, round({sql.format(e='embedding::DOUBLE[]', q=q)}, 6) AS score FROM embeddings ORDER BY {sql.format(e='embedding::DOUBLE[]', q=q)} DESC, vec_id LIMIT 10"


BM25 = r"""toks AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda t: t <> '') AS ts FROM documents),
c AS (SELECT id, len(ts) AS dl, len(list_filter(ts, lambda t: t = 'shipped')) AS tf0, len(list_filter(ts, lambda t: t = 'the')) AS tf1, len(list_filter(ts, lambda t: t = 'tion')) AS tf2 FROM toks),
s AS (SELECT count(*) AS n, greatest(avg(dl), 1.0::DOUBLE) AS av, count(*) FILTER (tf0 > 0) AS d0, count(*) FILTER (tf1 > 0) AS d1, count(*) FILTER (tf2 > 0) AS d2 FROM c),
bm AS (SELECT id, CASE WHEN tf0 > 0 THEN ln((n - d0 + 0.5::DOUBLE) / (d0 + 0.5::DOUBLE) + 1) * tf0 * 2.2::DOUBLE / (tf0 + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / av)) ELSE 0 END
 + CASE WHEN tf1 > 0 THEN ln((n - d1 + 0.5::DOUBLE) / (d1 + 0.5::DOUBLE) + 1) * tf1 * 2.2::DOUBLE / (tf1 + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / av)) ELSE 0 END
 + CASE WHEN tf2 > 0 THEN ln((n - d2 + 0.5::DOUBLE) / (d2 + 0.5::DOUBLE) + 1) * tf2 * 2.2::DOUBLE / (tf2 + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / av)) ELSE 0 END AS score
 FROM c, s WHERE tf0 + tf1 + tf2 > 0)"""


def keyword(spark, d):
    return V.bm25(docs(spark, d), "shipped the tion").select("id", F.round("score", 6).alias("score"))


def keyword_normalized(spark, d):
    return V.normalized(V.bm25(docs(spark, d), "shipped the tion")).select("id", F.round("score", 6).alias("score"))


def hybrid(spark, d):
    """Vectors and documents share ids; each gives 30 and the fusion the best 10."""
    a = V.nearest(vectors(spark, d), PROBE, 30)
    b = V.bm25(docs(spark, d), "shipped the tion").select("id", F.round("score", 9).alias("score"))
    return V.top(V.fused(a, V.top(b, 30)), 10).select("id", F.round("score", 9).alias("score"))


def boolean(spark, d):
    return docs(spark, d).where(V.boolean_query('the "of the" -tion th*', F.col("text"))).select("id")


def places(spark, d):
    """Events at places given by rule: latitude and longitude follow the id and k."""
    ev = flat_events(spark, d)
    return ev.select("id", "event_type", ((F.col("id") * 13) % 1800 / 10.0 - 90).alias("lat"), ((F.col("id") * 29) % 3600 / 10.0 - 180).alias("lng"))


PLACES = f"WITH {EV}, pl AS (SELECT id, event_type, ((id * 13) % 1800 / 10.0::DOUBLE - 90) AS lat, ((id * 29) % 3600 / 10.0::DOUBLE - 180) AS lng FROM ev), di AS (SELECT *, 2 * 6371.0::DOUBLE * asin(sqrt(least(1.0::DOUBLE, power(sin(radians(lat - 48.0::DOUBLE) / 2), 2) + cos(radians(48.0::DOUBLE)) * cos(radians(lat)) * power(sin(radians(lng - 11.0::DOUBLE) / 2), 2)))) AS km FROM pl)"


def geo_json(spark, d):
    """Coordinates in several JSON shapes, read back."""
    p = places(spark, d)
    text = F.when(F.col("id") % 3 == 0, F.to_json(F.struct(F.struct("lat", "lng").alias("location")))).when(F.col("id") % 3 == 1, F.to_json(F.struct(F.col("lat").alias("latitude"), F.col("lng").alias("longitude")))).otherwise(F.to_json(F.struct((F.col("lat") + 200).alias("lat"), "lng")))
    got = p.select("id", text.alias("payload")).select("id", geo.coordinates("payload").alias("c"))
    return got.groupBy((F.col("id") % 3).alias("shape")).agg(F.count("c").alias("found"), F.round(F.sum("c.lat"), 4).alias("lat"))


def grid(spark, d):
    return places(spark, d).groupBy(geo.cell(F.col("lat"), 10.0).alias("y"), geo.cell(F.col("lng"), 10.0).alias("x")).agg(F.count(F.lit(1)).alias("n"))


def identifiers(spark, d):
    rows = read_table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("getPart"), F.initcap(F.regexp_replace("p_type", " ", "_"))).alias("name"))
    return rows.select("id", F.size(V.camel_words(F.col("name"))).alias("words"), F.round(V.lexical_score(["part", "get"], F.col("name"), F.lit("a part of it")), 6).alias("score"))


def budget(spark, d):
    return docs(spark, d).select("id", V.estimate_tokens(F.col("text")).alias("tokens"))


QUERIES = {
    "vector_topk_cosine": vector("cosine", "list_cosine_similarity({e}, {q})"),
    "vector_topk_dot": vector("dot", "list_inner_product({e}, {q})"),
    "vector_topk_euclidean": vector("euclidean", "1.0::DOUBLE / (1.0::DOUBLE + list_distance({e}, {q}))"),
    "bm25_scores": (keyword, f"WITH {BM25} SELECT id, round(score, 6) AS score FROM bm"),
    "bm25_normalized": (keyword_normalized, f"WITH {BM25} SELECT id, round(score / (SELECT max(score) FROM bm), 6) AS score FROM bm"),
    "hybrid_rrf": (
        hybrid,
        f"WITH {BM25}, q AS (SELECT [{', '.join(map(str, PROBE))}]::DOUBLE[] AS q), v AS (SELECT vec_id AS id, list_cosine_similarity(embedding::DOUBLE[], q) AS s FROM embeddings, q ORDER BY s DESC, id LIMIT 30), a AS (SELECT id, row_number() OVER (ORDER BY s DESC, id) AS r FROM v), b0 AS (SELECT id, round(score, 9) AS s FROM bm ORDER BY s DESC, id LIMIT 30), b AS (SELECT id, row_number() OVER (ORDER BY s DESC, id) AS r FROM b0) SELECT coalesce(a.id, b.id) AS id, round(coalesce(0.5::DOUBLE / (60 + a.r), 0) + coalesce(0.5::DOUBLE / (60 + b.r), 0), 9) AS score FROM a FULL JOIN b ON a.id = b.id ORDER BY coalesce(0.5::DOUBLE / (60 + a.r), 0) + coalesce(0.5::DOUBLE / (60 + b.r), 0) DESC, 1 LIMIT 10",
    ),
    "boolean_search": (boolean, r"""WITH p AS (SELECT doc_id AS id, ' ' || array_to_string(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda t: t <> ''), ' ') || ' ' AS t FROM documents) SELECT id FROM p WHERE contains(t, ' the ') AND contains(t, ' of the ') AND NOT contains(t, ' tion ') AND contains(t, ' th')"""),
    "geo_radius": (lambda spark, d: V.geo_query(places(spark, d), (48.0, 11.0), 900.0).select("id", F.round("distance_km", 4).alias("km")), f"{PLACES} SELECT id, round(km, 4) AS km FROM di WHERE km <= 900"),
    "geo_radius_box": (
        lambda spark, d: V.geo_query(places(spark, d), (48.0, 11.0), 1500.0, (40.0, 0.0, 50.0, 30.0)).select("id"),
        f"{PLACES} SELECT id FROM di WHERE km <= 1500 AND lat BETWEEN 40 AND 50 AND lng BETWEEN 0 AND 30",
    ),
    "geo_coordinates": (geo_json, f"{PLACES} SELECT id % 3 AS shape, count(*) FILTER (id % 3 < 2 OR lat + 200 <= 90) AS found, CASE WHEN id % 3 < 2 THEN round(sum(lat), 4) END AS lat FROM di GROUP BY id % 3"),
    "geo_grid": (grid, f"{PLACES} SELECT CAST(floor(lat / 10.0::DOUBLE) AS BIGINT) AS y, CAST(floor(lng / 10.0::DOUBLE) AS BIGINT) AS x, count(*) AS n FROM di GROUP BY ALL"),
    "identifier_lexical": (identifiers, None),
    "token_budget": (budget, r"SELECT doc_id AS id, CAST(CASE WHEN trim(text, ' ') = '' THEN 0 ELSE ceil(len(regexp_split_to_array(trim(text, ' '), '[ \t\n\x0b\f\r]+')) * 1.3::DOUBLE) END AS BIGINT) AS tokens FROM documents"),
}
