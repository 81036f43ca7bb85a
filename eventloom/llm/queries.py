"""The queries of this subpackage, one per operator, with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm import bpe, embed_dedup, exact_dedup, jaccard_join, license_scan, lm_score, mixing, pii, quality, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), sums AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS INT)]::DOUBLE AS weight,
         row_number() OVER (ORDER BY source ASC NULLS LAST) AS turn
  FROM sized GROUP BY source
), limits AS (
  SELECT *, source_size * 2.0::DOUBLE AS most, sum(source_size) OVER () * 1.5::DOUBLE AS everything FROM sums
), marked AS (
  SELECT *, (everything - coalesce(sum(most) OVER (ORDER BY most / weight, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * weight
         >= most * sum(weight) OVER (ORDER BY most / weight, turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS filled
  FROM limits
), rest AS (
  SELECT *, everything - sum(CASE WHEN filled THEN most ELSE 0.0::DOUBLE END) OVER () AS remaining,
         sum(CASE WHEN filled THEN 0.0::DOUBLE ELSE weight END) OVER () AS heft
  FROM marked
), targets AS (
  SELECT source, source_size, CAST(CASE WHEN filled THEN most ELSE weight * (remaining / heft) END AS DOUBLE) AS target FROM rest
), rates AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate,
         CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(s.doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS draw
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM rates
"""


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH norm AS (
  SELECT doc_id, coalesce(length(text), 0) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents
), ranked AS (
  SELECT doc_id, t, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS turn, count(*) OVER (PARTITION BY t) AS group_size
  FROM norm WINDOW w AS (PARTITION BY t ORDER BY n DESC, doc_id ASC NULLS LAST)
)
SELECT doc_id, keep_id, group_size, turn = 1 AS kept, sha256(t) AS text_sha256 FROM ranked
"""


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_column(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


OP5_SQL = r"""
WITH RECURSIVE unit AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), good AS (
  SELECT vec_id, e FROM unit
  WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), linked AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM good a JOIN good b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95
), reach(u, v) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.u, l.v FROM reach r JOIN linked l ON r.v = l.u
), comp AS (
  SELECT u AS vec_id, min(v) AS component_id FROM reach GROUP BY u
)
SELECT c.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, c.vec_id = component_id AS kept
FROM comp c LEFT JOIN (SELECT u, count(*) AS n FROM linked GROUP BY u) l ON c.vec_id = l.u
"""


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_labels(table(spark, sf_dir, "documents"))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.scores(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), least=0)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii(table(spark, sf_dir, "documents"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components(table(spark, sf_dir, "documents"), words=3, percent=90)


OP10_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM words
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), firsts AS (
  SELECT doc_id, n, min(doc_id) OVER (PARTITION BY n, t) AS first FROM
    (SELECT doc_id, count(*) AS n, md5(string_agg(s, '|' ORDER BY s)) AS t FROM shingles GROUP BY doc_id)
), own AS (
  SELECT s.doc_id, s.s, f.n FROM shingles s JOIN firsts f ON s.doc_id = f.doc_id AND f.first = f.doc_id
), rare AS (
  SELECT doc_id, s, n, row_number() OVER (PARTITION BY doc_id ORDER BY df, s) AS turn FROM (SELECT *, count(*) OVER (PARTITION BY s) AS df FROM own)
), met AS (
  SELECT DISTINCT a.doc_id AS u, b.doc_id AS v, a.n AS nu, b.n AS nv FROM rare a JOIN rare b ON a.s = b.s AND a.doc_id < b.doc_id
  WHERE 10 * (a.turn - 1) <= a.n AND 10 * (b.turn - 1) <= b.n AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
), linked AS (
  SELECT u, v FROM met JOIN own a ON a.doc_id = u JOIN own b ON b.doc_id = v AND a.s = b.s GROUP BY u, v, nu, nv
  HAVING 100 * count(*) >= 90 * (nu + nv - count(*))
), both_ways AS (
  SELECT u, v FROM linked UNION SELECT v, u FROM linked
), reach(u, v) AS (
  SELECT first, first FROM firsts UNION SELECT r.u, l.v FROM reach r JOIN both_ways l ON r.v = l.u
), comp AS (
  SELECT u, min(v) AS c FROM reach GROUP BY u
)
SELECT d.doc_id, CAST(coalesce(f.n, 0) AS BIGINT) AS n_shingles, coalesce(c, d.doc_id) AS component_id
FROM documents d LEFT JOIN firsts f ON d.doc_id = f.doc_id LEFT JOIN comp ON f.first = comp.u
"""


def queries() -> dict:
    return {
        "op1_mix": op1_mix,
        "op2_exact_dedup": op2_exact_dedup,
        "op3_quality": op3_quality,
        "op4_bpe": op4_bpe,
        "op5_embedding_near_dedup": op5_embedding_near_dedup,
        "op6_license_scan": op6_license_scan,
        "op7_lm_score": op7_lm_score,
        "op8_warc": op8_warc,
        "op9_pii": op9_pii,
        "op10_jaccard_join": op10_jaccard_join,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_mix": OP1_SQL, "op2_exact_dedup": OP2_SQL, "op5_embedding_near_dedup": OP5_SQL, "op10_jaccard_join": OP10_SQL}
