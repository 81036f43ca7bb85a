"""Search: exact vectors, BM25, reciprocal rank fusion, geo queries."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions import geo


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def similarity(a: Column, b: Column, metric: str = "cosine") -> Column:
    """cosine (0 where a norm is under 1e-10), dot, or euclidean as 1 / (1 + distance)."""
    if metric == "cosine":
        return F.when((norm(a) < 1e-10) | (norm(b) < 1e-10), F.lit(0.0)).otherwise(dot(a, b) / (norm(a) * norm(b)))
    if metric == "dot":
        return dot(a, b)
    gap = F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x)
    return 1.0 / (1.0 + F.sqrt(gap))


def nearest(vectors: DataFrame, query: list[float], k: int = 10, metric: str = "cosine", least: float | None = None, prefix: str | None = None) -> DataFrame:
    """The k vectors (id, embedding) most similar to one query: id, score; ties by id. A scan and a top-k, no shuffle of vectors."""
    rows = vectors.where(F.col("id").startswith(prefix)) if prefix else vectors
    q = F.array(*[F.lit(float(x)) for x in query])
    got = rows.where(F.size("embedding") == len(query)).select("id", similarity(F.col("embedding"), q, metric).alias("score"))
    got = got.where(F.col("score") >= least) if least is not None else got
    return got.orderBy(F.desc("score"), "id").limit(k)


# keywords ----------------------------------------------------------------------------------------------------------------


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def postings(docs: DataFrame) -> DataFrame:
    """docs (id, text) -> id, term, tf, dl."""
    each = docs.select("id", tokens(F.coalesce("text", F.lit(""))).alias("ts")).select("id", F.size("ts").alias("dl"), F.explode("ts").alias("term"))
    return each.groupBy("id", "term", "dl").agg(F.count(F.lit(1)).alias("tf"))


def bm25(docs: DataFrame, query: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """docs (id, text) -> id, score of all that hold a query term: idf = ln((n - df + 0.5) / (df + 0.5) + 1), mean length at
    least 1. Term counts are taken in each row; only rows with a hit leave the scan, so nothing is exploded or shuffled but them.
    """
    terms = sorted(set(re.findall(r"[^\W_]+", query.lower())))
    if not terms:
        return docs.select("id", F.lit(0.0).alias("score")).limit(0)
    ts = docs.select("id", tokens(F.coalesce("text", F.lit(""))).alias("ts"))
    counted = ts.select("id", F.size("ts").alias("dl"), *[F.size(F.filter("ts", _is(t))).alias(f"tf{i}") for i, t in enumerate(terms)])
    stats = counted.agg(F.count(F.lit(1)).alias("n"), F.greatest(F.avg("dl"), F.lit(1.0)).alias("avgdl"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    hits = counted.where(reduce(lambda x, y: x | y, [F.col(f"tf{i}") > 0 for i in range(len(terms))]))
    parts = []
    for i in range(len(terms)):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log((F.col("n") - df + 0.5) / (df + 0.5) + 1)
        parts.append(F.when(tf > 0, idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))).otherwise(0.0))
    return hits.join(F.broadcast(stats)).select("id", sum(parts[1:], parts[0]).alias("score"))  # stats: one row


def _is(term: str):
    return lambda t: t == term


def top(scores: DataFrame, k: int = 10) -> DataFrame:
    return scores.orderBy(F.desc("score"), "id").limit(k)


def normalized(scores: DataFrame) -> DataFrame:
    """Scores by the largest one."""
    best = scores.agg(F.max("score").alias("best"))
    return scores.join(F.broadcast(best)).select("id", (F.col("score") / F.col("best")).alias("score"))


def fused(first: DataFrame, second: DataFrame, weights: tuple[float, float] = (0.5, 0.5), k0: int = 60) -> DataFrame:
    """Reciprocal rank fusion of two top lists (id, score): sum of weight / (k0 + rank), ranks from 1; ties by id.

    The lists are results of top(), so ranking them takes one task of bounded size."""
    w = Window.orderBy(F.desc("score"), "id")
    a = first.select("id", F.row_number().over(w).alias("r1"))
    b = second.select("id", F.row_number().over(w).alias("r2"))
    part = lambda r, x: F.coalesce(F.lit(x) / (F.lit(k0) + F.col(r)), F.lit(0.0))
    return a.join(b, "id", "full_outer").select("id", (part("r1", weights[0]) + part("r2", weights[1])).alias("score"))


def boolean_query(query: str, text: Column, fields: dict[str, Column] | None = None) -> Column:
    """A small query language: words, "phrases", wild*c?rds, field:word, -negated, a OR b; all clauses must hold.

    OR binds the clauses beside it. A field that is not among ``fields`` is an error."""
    padded = {name: F.concat(F.lit(" "), F.array_join(tokens(c), " "), F.lit(" ")) for name, c in {"": text, **(fields or {})}.items()}
    held: list[Column] = []
    joined = False
    for minus, field, phrase, word in re.findall(r'(-?)(?:([A-Za-z_]\w*):)?(?:"([^"]*)"|(\S+))', query):
        if word == "OR" and not minus and not field:
            joined = bool(held)
            continue
        if field not in padded:
            raise ValueError(f"unknown field {field}")
        body = (phrase or word).lower()
        words = re.findall(r"[^\W_]+" if phrase else r"(?:[^\W_]|[*?])+", body)
        if not words:
            continue
        if any(c in w for w in words for c in "*?"):
            wild = {"*": r"[^ ]*", "?": r"[^ ]"}
            hit = padded[field].rlike(" " + " ".join("".join(wild.get(c, c) for c in w) for w in words) + " ")
        else:
            hit = padded[field].contains(" " + " ".join(words) + " ")
        hit = ~hit if minus else hit
        held[len(held) - joined :] = [held[-1] | hit if joined else hit]
        joined = False
    return reduce(lambda x, y: x & y, held, F.lit(True))


def geo_query(events: DataFrame, center: tuple[float, float] | None = None, radius_km: float | None = None, box: tuple[float, float, float, float] | None = None, compat: bool = False) -> DataFrame:
    """events (lat, lng) within the radius and the box, with distance_km. With compat a radius makes the box count for nothing."""
    lat, lng = F.col("lat"), F.col("lng")
    away = geo.haversine_km(F.lit(center[0]), F.lit(center[1]), lat, lng) if center else F.lit(None).cast("double")
    out = events.withColumn("distance_km", away)
    if radius_km is not None:
        reach = radius_km / (geo.EARTH_KM * 3.141592653589793 / 180)
        out = out.where(lat.between(center[0] - reach - 1e-9, center[0] + reach + 1e-9)).where(F.col("distance_km") <= radius_km)
    if box is not None and not (compat and radius_km is not None):
        out = out.where(geo.in_box(lat, lng, *box))
    return out


def camel_words(text: Column) -> Column:
    """Parts of an identifier at case changes and delimiters, of two characters or more, lower-case, and the whole of it."""
    spaced = F.regexp_replace(F.regexp_replace(text, r"([a-z0-9])([A-Z])", "$1 $2"), r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    parts = F.filter(F.split(F.lower(spaced), r"[^\p{L}\p{N}]+"), lambda t: F.length(t) >= 2)
    return F.array_distinct(F.concat(parts, F.array(F.lower(text))))


def lexical_score(terms: list[str], title: Column, body: Column) -> Column:
    """Mean over terms of the best match: 1 exact, 0.75 prefix, 0.5 inside, in the title's words; 0.6 of that in the body's."""

    def best(words: Column, term: str) -> Column:
        each = F.transform(words, lambda w: F.when(w == term, 1.0).when(w.startswith(term), 0.75).when(w.contains(term), 0.5).otherwise(0.0))
        return F.coalesce(F.array_max(each), F.lit(0.0))

    parts = [F.greatest(best(camel_words(title), t), best(tokens(body), t) * 0.6) for t in terms]
    return sum(parts[1:], parts[0]) / len(parts)


def estimate_tokens(text: Column) -> Column:
    trimmed = F.trim(text)
    return F.when(trimmed == "", 0).otherwise(F.ceil(F.size(F.split(trimmed, r"\s+")) * F.lit(1.3))).cast("long")
