"""Embeddings, archives and the pipeline, and the registered queries against their SQL."""

import gzip
import io
import math

import duckdb
import numpy as np
import pytest

from eventloom.llm import embed_dedup, queries, warc
from tools.compare import TABLES, rows


# embeddings --------------------------------------------------------------------------------------------------------------


def brute_links(vectors, t):
    good = {}
    for i, v in enumerate(vectors):
        if v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float64)
            good[i] = x / np.linalg.norm(x)
    root = list(range(len(vectors)))
    n = [0] * len(vectors)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in good:
        for j in good:
            if i < j and float(good[i] @ good[j]) >= t:
                n[i] += 1
                n[j] += 1
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return n, [find(i) for i in range(len(vectors))]


@pytest.mark.parametrize("tile", [7, 64, 4096])
@pytest.mark.parametrize("dims", [3, 40])
def test_links_equal_brute_force(spark, dims, tile):
    r = np.random.default_rng(dims)
    base = r.standard_normal((12, dims))
    x = [list(map(float, b * s + r.standard_normal(dims) * 0.12 * np.linalg.norm(b) / np.sqrt(dims))) for b in base for s in (0.01, 1.0, 1e12) for _ in range(5)]
    x += [None, [], [0.0] * dims, [math.nan] * dims, [None] * dims, [math.inf] + [1.0] * (dims - 1), x[0], x[0], [1e-40] * dims]
    x = [v if v is None else [None if c is None else float(np.float32(c)) for c in v] for v in x]
    df = spark.createDataFrame([(i, v, 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, n_links int").repartition(3)
    got = {q.vec_id: q for q in embed_dedup.near_duplicates(df, 0.95, tile).collect()}
    n, root = brute_links(x, 0.95)
    assert [got[i].n_links for i in range(len(x))] == n
    assert [got[i].component_id for i in range(len(x))] == root
    assert all(q.kept == (q.vec_id == q.component_id) for q in got.values()) and max(n) > 2


def test_repeated_ids_and_empty_tables(spark):
    kind = "vec_id long, embedding array<float>"
    got = embed_dedup.near_duplicates(spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.01]), (2, [0.0, 1.0])], kind)).collect()
    assert sorted((q.vec_id or -1, q.n_links, q.component_id) for q in got) == [(-1, 2, 1), (1, 2, 1), (1, 2, 1), (2, 0, 2)]
    assert embed_dedup.near_duplicates(spark.createDataFrame([], kind)).count() == 0
    assert embed_dedup.near_duplicates(spark.createDataFrame([(1, None)], kind)).collect()[0].n_links == 0


# archives ----------------------------------------------------------------------------------------------------------------

PAGES = [
    (3, "http://a/ü", "<p>same</p>"), (1, "http://b", "<p>same</p>"), (2, None, "<p>same</p>"), (4, "http://c\r\nX: y", ""), (5, "http://d", None), (None, "http://e", "<p>same</p>"),
    (6, "http://f", "\r\n\r\nWARC/1.1\r\n\r\n" * 50), (7, "http://g", "é" * 300_000), (8, "http://h", "z"), (8, "http://h", "z"), (None, None, "q"),
]


def test_archives_round_trip(spark):
    pages = spark.createDataFrame([(*p, 1) for p in PAGES], "page_id long, url string, html string, key int")
    got = warc.round_trip(pages).collect()
    first = {}
    for i, _, h in PAGES:
        first.setdefault(h or "", []).append(i)
    assert len(got) == len(PAGES)
    want = []
    for i, _, h in PAGES:
        data = (h or "").encode()
        known = [x for x in first[h or ""] if x is not None]
        keeper = min(known) if known else None
        again = len(first[h or ""]) > 1 and i != keeper
        want.append((-1 if i is None else i, len(data), warc.base32_sha1(data), "revisit" if again else "response", keeper if again else None))
    assert sorted(map(str, want)) == sorted(str((-1 if r.page_id is None else r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got)
    assert warc.round_trip(pages.limit(0)).count() == 0
    few = warc.round_trip(pages, least=8).collect()
    assert sum(r.record_type == "revisit" for r in few) == 3  # short payloads are all responses


def test_archives_roll_over_and_payloads_return(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://x/{i}", f"page {i}" * 20) for i in range(50)], "page_id long, url string, html string").coalesce(1)
    manifest = warc.write_archives(warc.plan_records(pages), f"file://{tmp_path}/warc", most=400)
    assert manifest.count() > 3
    back = {r.page_id: bytes(r.payload).decode() for r in warc.read_archives(manifest, payloads=True).collect()}
    assert back == {i: f"page {i}" * 20 for i in range(50)}


def test_reader_refuses_damage():
    good = [warc.record(i, "http://x", b"payload %d" % i, None, False, "2024-01-01T00:00:00Z") for i in range(3)]
    assert [f["warc-record-id"] for f, _ in warc.read(io.BytesIO(b"".join(good)))] == ["<urn:page:0>", "<urn:page:1>", "<urn:page:2>"]
    assert len(list(warc.members(io.BytesIO(b"".join(good))))) == 3 and gzip.decompress(good[0]).startswith(b"WARC/1.1")
    plain = gzip.decompress(good[0])
    for bad in (good[0][:-9], b"junk" + good[0], gzip.compress(plain.replace(b"payload 0", b"payload 9")), gzip.compress(plain[:-4]), gzip.compress(plain.replace(b"Content-Length: 9", b"Content-Length: 8"))):
        with pytest.raises(warc.WarcError):
            list(warc.read(io.BytesIO(bad)))


# queries and the pipeline ------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, small, name):
    df = queries.queries()[name](spark, small)
    got = rows(df.columns, df.collect())
    table = {"op5": "embeddings", "op8": "pages"}.get(name.split("_")[0], "documents")
    assert len(got) == spark.read.parquet(f"{small}/{table}.parquet").count()
    if name in queries.oracle_sql():
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
        res = con.execute(queries.oracle_sql()[name])
        assert got == rows([d[0] for d in res.description], res.fetchall())


def test_pipeline_stages(spark, small):
    import corpus_pipeline
    from eventloom.llm import exact_dedup, mixing, quality
    from tests.llm.test_documents import brute_components, squeezed

    docs = spark.read.parquet(f"{small}/documents.parquet")
    (_, f1), (_, f2), (_, f3), (_, f4), (_, f5) = corpus_pipeline.STAGES
    labels = spark.read.parquet(f"{small}/labels.parquet")
    scored = {r.doc_id: r.score for r in quality.quality(docs, labels).collect()}
    one = f1(spark, docs, small).cache()
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == {i for i, s in scored.items() if s >= 0.5}
    two = f2(spark, one, small).cache()
    groups = {}
    for r in one.collect():
        groups.setdefault(squeezed(r.text), []).append((-len(r.text), r.doc_id))
    assert sorted(r.doc_id for r in two.collect()) == sorted(min(g)[1] for g in groups.values())
    three = f3(spark, two, small).cache()
    comps = brute_components([(r.doc_id, r.text) for r in two.collect()], 5, 80)
    assert sorted(r.doc_id for r in three.collect()) == sorted(i for i, (_, c) in comps.items() if i == c)
    four = f4(spark, three, small).cache()
    planned = {r.doc_id: r.copies for r in mixing.mix_plan(three).collect() if r.copies}
    from collections import Counter

    assert Counter(r.doc_id for r in four.collect()) == Counter(planned)
    assert f5(spark, four, small).count() == four.count()
    assert corpus_pipeline.run(spark, small).count() == four.count()
    assert exact_dedup.exact_dedup(three).where("not kept").count() == 0


def test_vectors_of_every_length_link(spark):
    rows = [(1, [1.0, 2.0, 3.0]), (2, [2.0, 4.0, 6.0]), (3, [3.0, -1.0, 0.0]), (4, [1.0, 2.0]), (5, [1.0, 2.0]), (6, [5.0]), (7, [-2.0, 1.0]), (8, None), (9, [1.0, 2.0, 3.0, 4.0])]
    got = embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == [
        (1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 0, 6, True), (7, 0, 7, True), (8, 0, 8, True), (9, 0, 9, True),
    ]


def test_pipeline_hands_bpe_few_rows_at_once(spark, small, monkeypatch):
    import corpus_pipeline
    from eventloom.shared import ARROW_ROWS

    kept, seen, write = spark.conf.get(ARROW_ROWS), [], corpus_pipeline.written
    monkeypatch.setattr(corpus_pipeline, "written", lambda df, what: seen.append(spark.conf.get(ARROW_ROWS)) or write(df, what))
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(50)
    assert corpus_pipeline.encoded(spark, docs, small).count() == docs.count()
    assert seen == ["1000"] and spark.conf.get(ARROW_ROWS) == kept


def test_tiles_meet_without_a_shuffle(spark, monkeypatch):
    plans, write = {}, embed_dedup.written

    def seen(df, what):
        plans[what] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, what)

    monkeypatch.setattr(embed_dedup, "written", seen)
    r = np.random.default_rng(5)
    base = r.standard_normal((6, 8))
    x = [list(map(float, b + r.standard_normal(8) * 0.05)) for b in base for _ in range(30)] + [[1.0] * 8] * 60
    df = spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<double>").repartition(3)
    got = {q.vec_id: q for q in embed_dedup.near_duplicates(df, 0.95, 8).collect()}
    n, root = brute_links(x, 0.95)
    assert [got[i].n_links for i in range(len(x))] == n and [got[i].component_id for i in range(len(x))] == root
    assert "Exchange" not in plans["links"] and "CartesianProduct" in plans["links"]  # a shuffle would hold both tiles of each pair
    assert "row#" in plans["tiles"].split("rangepartitioning(", 1)[1].split(")")[0]  # equal vectors are dealt over partitions
