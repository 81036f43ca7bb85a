"""N-gram Jaccard join: an exact metric-space join over sets of word shingles.

Distance is 1 - Jaccard similarity, a metric; the radius r is the distance at which documents still link. Pivots are documents.
Every document goes to its nearest pivot within r, its Voronoi region, and is replicated to the regions of all other pivots
within 2r: if x and y link and p is y's pivot, d(x, p) <= d(x, y) + d(y, p) <= 2r by the triangle inequality, so x and y meet
in p's region. There x is compared only with y of d(y, p) >= d(x, p) - r. Documents farther than r from all pivots make the
far region, which joins recursively with pivots of its own.

Unrelated documents share no shingle and are at distance 1, so pivots are found by an inverted index: shingles are ordered by
the number of sets that hold them, rare ones first, and two sets within 2r share one of the first n - ceil((1 - 2r) n) + 1 of
each. A set with more shingles that no other one holds than r allows is farther than r from all others: a region of its own,
which leaves before any pivot is chosen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm.common import connected_components, forget, is_empty, text_slabs, written

UPPER, LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
LOWERED = bytes.maketrans(UPPER, LOWER)
SLAB = 1_000_000  #: bytes of text hashed at once
LEAF = 1500  #: documents of a region that meet in one task
SHINGLES = 2_000_000  #: shingles of those documents
LEVELS = 6  #: levels of pivots after which what is far is joined in blocks, as soon as a level leaves more than half
SEEN = 2.5  #: of all shingles, this many radii are counted to find the sets that are far from all others


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fold(words: np.ndarray, k: int) -> np.ndarray:
    """A hash for each k consecutive words."""
    acc = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + words[i : len(words) - k + 1 + i])
    return acc


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of every text's k-word shingles; with fewer words, of the whole sequence; without words, none."""
    hashes, counts, rows = _Hashes(), [], []
    for text in texts:
        words = text.translate(LOWERED).split()  # splits at [\x20\x09-\x0D]+
        counts.append(len(words))
        rows.append(np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)))
    flat = np.concatenate(rows) if rows else np.zeros(0, np.uint64)
    all_k = fold(flat, k) if len(flat) >= k else None
    out, at = [], 0
    for n, row in zip(counts, rows, strict=True):
        if n >= k:
            out.append(np.unique(all_k[at : at + n - k + 1]))
        else:
            out.append(fold(row, n) if n else row)
        at += n
    return out


def prints(docs: DataFrame, words: int) -> DataFrame:
    """docs (doc_id, text) -> rid (the row's number), doc_id, n, key (of the whole set; null if empty), own (its first half), set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slabs(batches, 2, SLAB):
            sets = shingle_sets([t.encode("utf-8", "replace") for t in texts], words)
            keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            own = [int.from_bytes(k[:8], "big", signed=True) if k else None for k in keys]
            sizes = np.array([len(s) for s in sets], np.int64)
            flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat, pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sizes), pa.array(keys, pa.binary()), pa.array(own, pa.int64()), lists], ["rid", "doc_id", "n", "key", "own", "set"])

    numbered = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return numbered.mapInArrow(run, "rid long, doc_id long, n long, key binary, own long, set array<long>")


def company(table: DataFrame, firsts: DataFrame, percent: int) -> DataFrame:
    """rid, n, set of one row of each set that can be within the radius of another.

    Shingles in a fixed share of their hashes' space are counted; a set with more of them to itself than the radius lets two
    linked sets differ by is far from all others. ``own`` stands for the set, so copies of it count as one.
    """
    share = min(1.0, SEEN * (100 - percent) / 100)
    counted = F.filter("set", lambda s: F.pmod(F.shiftrightunsigned(s, 17), F.lit(1 << 20)) < int(share * (1 << 20)))
    held = table.where("n > 0").select("own", F.explode(counted).alias("s")).groupBy("s").agg(F.min("own").alias("lo"), F.max("own").alias("hi"))
    alone = held.where("lo = hi").groupBy(F.col("lo").alias("own")).agg(F.count(F.lit(1)).alias("alone"))
    near = firsts.join(alone, "own", "left").where(F.coalesce("alone", F.lit(0)) * 100 <= F.lit(100 - percent) * F.col("n"))
    chosen = written(near.select(F.col("first").alias("rid")), "jaccard-chosen")
    out = written(table.select("rid", "n", "set").join(chosen, "rid", "left_semi"), "jaccard-members")
    forget(chosen)
    return out


def inverted(members: DataFrame, percent: int) -> DataFrame:
    """members (rid, n, set) -> the inverted index: rid, n, s, c (sets here that hold s), turn (its place in the order of rare
    shingles first) of the shingles that the bound for 2r needs; near tells those that the bound for r needs. Sets with more
    shingles of their own than r allows are left out, as they have no link here."""
    each = members.select("rid", "n", F.explode("set").alias("s"))
    shared = written(each.groupBy("s").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "jaccard-shared")
    own = Window.partitionBy("rid")
    placed = each.join(shared, "s").select("rid", "n", "s", "c", F.row_number().over(own.orderBy("c", "s")).alias("i"), (F.col("n") - F.count(F.lit(1)).over(own)).alias("alone"))
    placed = placed.withColumn("turn", F.col("i") + F.col("alone")).where(F.col("alone") * 100 <= F.lit(100 - percent) * F.col("n"))
    bound = lambda radii: F.floor(F.col("n") * radii * (100 - percent) / 100) + 1
    index = written(placed.where(F.col("turn") <= bound(2)).select("rid", "n", "s", "c", "turn", (F.col("turn") <= bound(1)).alias("near")), "jaccard-index")
    forget(shared)
    return index


def leaders(index: DataFrame) -> DataFrame:
    """s, leader of every list of the index with two documents or more: the one with the smallest hash."""
    first = F.min(F.struct(F.xxhash64("rid").alias("h"), "rid"))["rid"]
    return written(index.groupBy("s").agg(first.alias("leader"), F.count(F.lit(1)).alias("k")).where("k > 1").select("s", "leader"), "jaccard-leaders")


def nominees(index: DataFrame, led: DataFrame) -> DataFrame:
    """rid, pivot: every document that can have a link names the leader of the longest of its lists. Those that name
    themselves are the pivots: hashes fall along the names, so every group has one, and dense groups have few."""
    return written(index.where("near").join(led, "s").groupBy("rid").agg(F.max_by("leader", F.struct("c", "s")).alias("pivot")), "jaccard-named")


def distances(members: DataFrame, index: DataFrame, pivots: DataFrame, percent: int) -> DataFrame:
    """rid, n, pivot, away, linked of every document of the index and every pivot within 2r of it, itself included."""
    least = 2 * percent - 100  # the similarity at 2r, in percent
    entries = written(index.join(pivots, F.col("rid") == F.col("pivot")).select("s", "pivot", F.col("n").alias("m"), F.col("turn").alias("at")), "jaccard-entries")
    most = 1 + F.least(F.col("n") - F.col("turn"), F.col("m") - F.col("at"))  # that they can share if s is the first they do
    pairs = index.join(entries, "s").where(most * (100 + least) >= F.lit(least) * (F.col("n") + F.col("m"))).select("rid", "pivot").distinct()
    own = members.select("rid", "n", "set")
    theirs = members.select(F.col("rid").alias("pivot"), F.col("n").alias("m"), F.col("set").alias("pivot_set"))
    both = pairs.join(own, "rid").join(theirs, "pivot").select("rid", "n", "pivot", (F.col("n") + F.col("m")).alias("sum"), F.size(F.array_intersect("set", "pivot_set")).cast("long").alias("both"))
    union = F.col("sum") - F.col("both")
    near = both.where(F.col("both") * 100 >= F.lit(least) * union)
    out = written(near.select("rid", "n", "pivot", (1 - F.col("both") / union).alias("away"), (F.col("both") * 100 >= F.lit(percent) * union).alias("linked")), "jaccard-near")
    forget(entries)
    return out


def compare(percent: int):
    """Of a block of a region, the documents of other regions (outer) against those of its own: an edge for each outer one that
    links with one of them."""

    def run(table: pa.Table) -> pa.Table:
        outer = np.array(table.column("outer").to_pylist(), bool)
        away = table.column("away").to_numpy()
        sets = [np.asarray(x.values if x.values is not None else [], np.int64) for x in table.column("set")]
        u, v = [], []
        inner = np.flatnonzero(~outer)
        if len(inner) and outer.any():
            inner = inner[np.argsort(-away[inner], kind="stable")]  # farthest first, so that the window is a prefix
            sizes = np.array([len(sets[i]) for i in inner], np.int64)
            starts = np.concatenate([[0], np.cumsum(sizes)])
            values, flat = np.unique(np.concatenate([sets[i] for i in inner]), return_inverse=True)
            mark = np.zeros(len(values) + 1, np.int32)
            owner, pivot = table.column("owner").to_pylist(), table.column("pivot")[0].as_py()
            radius = 1 - percent / 100 + 1e-9
            for x in np.flatnonzero(outer):
                until = int(np.searchsorted(-away[inner], -(away[x] - radius), "right"))
                if not until:
                    continue
                at = np.searchsorted(values, sets[x])
                at = at[(at < len(values)) & (values[np.minimum(at, len(values) - 1)] == sets[x])]
                mark[at] = 1
                both = np.add.reduceat(mark[flat[: starts[until]]], starts[:until])
                mark[at] = 0
                if np.any(100 * both >= percent * (len(sets[x]) + sizes[:until] - both)):
                    u.append(owner[x])
                    v.append(pivot)
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def across(members: DataFrame, near: DataFrame, cores: DataFrame, direct: DataFrame, percent: int, leaf: int) -> DataFrame | None:
    """Edges (u, v) between regions: documents within 2r of a pivot and not of its region against those that are. Of two
    regions the one with the larger pivot does it; regions already linked by a document within r of both pivots need not.

    Both sides are dealt into blocks of at most about ``leaf`` documents, so that no region meets in one task."""
    radius = 1 - percent / 100 + 1e-9
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / leaf), F.ceil(F.sum("n") / SHINGLES)).cast("int")
    reach = written(cores.groupBy("core").agg(F.max("away").alias("reach"), blocks.alias("columns")).where("reach > 0"), "jaccard-reach")
    outer = near.where("not linked").join(reach, F.col("pivot") == F.col("core")).where(F.col("away") - radius <= F.col("reach")).select("rid", "n", "pivot", "away")
    held = cores.select("rid", F.col("core").alias("own"))
    outer = outer.join(held, "rid", "left").where("own is null or own < pivot")
    outer = outer.join(direct.select(F.col("u").alias("pivot"), F.col("v").alias("own")), ["pivot", "own"], "left_anti")
    outer = written(outer.select("pivot", "rid", "n", "away", F.coalesce("own", "rid").alias("owner")), "jaccard-outer")
    if is_empty(outer):
        found = None
    else:
        rows = outer.groupBy("pivot").agg(blocks.alias("rows"), F.min("away").alias("least"))
        shape = written(rows.join(reach, F.col("pivot") == F.col("core")).select("pivot", "rows", "columns", "least"), "jaccard-shape")

        def dealt(side: DataFrame, own: str, other: str, is_outer: bool) -> DataFrame:
            number = F.pmod(F.xxhash64("rid"), F.col(own)).cast("int").alias(own[:3])
            held = side.join(shape, "pivot").where(F.lit(is_outer) | (F.col("away") >= F.col("least") - radius))
            return held.select("pivot", number, F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other[:3]), "rid", "away", "owner", F.lit(is_outer).alias("outer"))

        inner = cores.select(F.col("core").alias("pivot"), "rid", "away", F.col("core").alias("owner"))
        met = dealt(outer, "rows", "columns", True).unionByName(dealt(inner, "columns", "rows", False)).join(members.select("rid", "set"), "rid")
        found = written(met.groupBy("pivot", "row", "col").applyInArrow(compare(percent), "u long, v long"), "jaccard-across")
        forget(shape)
    forget(outer)
    forget(reach)
    return found


def join_level(members: DataFrame, index: DataFrame, led: DataFrame, percent: int, leaf: int) -> tuple[list[DataFrame], DataFrame, bool]:
    """One level: tables of cores (rid, n, core, away) of the documents that have a pivot within the radius and of edges (u, v)
    between pivots or documents of the far region, the far region's members, and whether they are more than half of all."""
    named = nominees(index, led)
    near = distances(members, index, named.where("rid = pivot").select("pivot"), percent)
    nearest = F.min(F.struct("away", "pivot", "n"))
    cores = near.where("linked").groupBy("rid").agg(nearest.alias("c")).select("rid", "c.n", F.col("c.pivot").alias("core"), "c.away")
    cores = written(cores, "jaccard-cores")
    ends = near.where("linked").join(cores.select("rid", "core"), "rid").where("core <> pivot")
    direct = written(ends.select(F.greatest("core", "pivot").alias("u"), F.least("core", "pivot").alias("v")).distinct(), "jaccard-direct")
    more = across(members, near, cores, direct, percent, leaf)
    far = written(members.join(named.select("rid"), "rid", "left_semi").join(cores.select("rid"), "rid", "left_anti"), "jaccard-far")
    slow = 2 * far.count() > named.count()
    forget(named)
    forget(near)
    return [cores, direct] if more is None else [cores, direct, more], far, slow


def join_region(ids: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Edges that connect the ids exactly as all links among them do.

    A pivot is compared with all others left that its size allows. Those within the radius are linked with it; they leave,
    after they are compared with those between one and two radii from the pivot, which alone can be linked with them.
    """
    order = np.argsort([len(s) for s in sets], kind="stable")
    ids, sets = ids[order], [sets[i] for i in order]
    size = np.array([len(s) for s in sets], np.int64)
    starts = np.concatenate([[0], np.cumsum(size)])
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int64)
    radius = 1 - percent / 100 + 1e-9
    root = np.arange(len(ids))
    here = np.ones(len(ids), bool)
    mark = np.zeros(int(flat.max()) + 1, bool)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    def common(one: int, rest: np.ndarray) -> np.ndarray:
        own = flat[starts[one] : starts[one + 1]]
        mark[own] = True
        if len(rest) and rest[-1] - rest[0] + 1 == len(rest):
            got = np.add.reduceat(mark[flat[starts[rest[0]] : starts[rest[-1] + 1]]].astype(np.int32), starts[rest] - starts[rest[0]])
        else:
            n = size[rest]
            ends = np.cumsum(n)
            got = np.add.reduceat(mark[flat[np.repeat(starts[rest] - ends + n, n) + np.arange(ends[-1])]].astype(np.int32), ends - n) if len(rest) else np.zeros(0, np.int64)
        mark[own] = False
        return got

    edges = []
    for p in range(len(ids)):
        if not here[p]:
            continue
        here[p] = False
        # sizes ascend: from p on those that 1/t of its size allows, and of smaller ones only what two radii reach
        lo = np.searchsorted(size, size[p] * (1 - 2 * radius), "left")
        hi = np.searchsorted(size, size[p] / max(1 - 2 * radius, 1e-9), "right")
        rest = np.flatnonzero(here[lo:hi]) + lo
        if not len(rest):
            continue
        both = common(p, rest)
        union = size[p] + size[rest] - both
        linked = 100 * both >= percent * union
        ball, shell = rest[linked], rest[~linked & (1 - both / union <= 2 * radius)]
        for x in ball.tolist():
            edges.append((int(ids[x]), int(ids[p])))
            root[find(x)] = find(p)
        here[ball] = False
        if len(ball):
            for y in shell.tolist():
                if find(y) == find(p):
                    continue
                shared = common(y, ball)
                hit = np.flatnonzero(100 * shared >= percent * (size[y] + size[ball] - shared))
                if len(hit):
                    edges.append((int(ids[y]), int(ids[ball[hit[0]]])))
                    root[find(y)] = find(p)
    return edges


def regions_of(index: DataFrame, led: DataFrame) -> DataFrame:
    """rid, region: a document is in the region of every leader of the lists that the bound for r needs, so any two that link
    have one in common."""
    return written(index.where("near").join(led, "s").select("rid", F.col("leader").alias("region")).distinct(), "jaccard-regions")


def join_leaves(members: DataFrame, regions: DataFrame, percent: int, leaf: int) -> DataFrame:
    """Edges (u, v) of all regions (rid, region), each joined by pivots within a task. A region over ``leaf`` documents is dealt
    into blocks by hash, and any two of its blocks meet, so two of its documents meet in one task at least."""

    def joined(table: pa.Table) -> pa.Table:
        ids, sets = table.column("rid").to_numpy(), [np.asarray(x.values, np.int64) for x in table.column("set")]
        edges = join_region(ids, sets, percent) if len(ids) > 1 else []
        return pa.table({"u": pa.array([u for u, _ in edges], pa.int64()), "v": pa.array([v for _, v in edges], pa.int64())})

    sizes = written(regions.groupBy("region").agg(F.count(F.lit(1)).alias("m")).select("region", F.when(F.col("m") > leaf, F.ceil(F.col("m") * 2 / leaf)).otherwise(1).cast("int").alias("blocks")), "jaccard-sizes")
    own, other = F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    met = regions.join(sizes, "region").select("region", "rid", "blocks", own, other).where("own <> other or blocks = 1")
    met = met.select("region", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "rid").join(members.select("rid", "set"), "rid")
    out = written(met.groupBy("region", "lo", "hi").applyInArrow(joined, "u long, v long"), "jaccard-leaves")
    forget(sizes)
    return out


def join(members: DataFrame, percent: int, leaf: int = LEAF, levels: int = LEVELS) -> tuple[list[DataFrame], list[DataFrame]]:
    """members (rid, n, set; sets are distinct) -> tables of cores (rid, core) and of edges (u, v) between cores, or documents
    without one. Together they connect exactly what the links do. Each level joins the far region of the one before by
    pivots of its own, until its regions are no larger than ``leaf``; what pivots don't separate is joined in blocks."""
    if not 50 < percent <= 100:
        raise ValueError("percent: over 50, as documents at distance 2r must share a shingle; at most 100")
    cores, edges, now, slow, level = [], [], members, False, 0
    while not is_empty(now):
        index = inverted(now, percent)
        led = leaders(index)
        regions = regions_of(index, led) if level else None
        last = level and (slow or level == levels or is_empty(regions.groupBy("region").count().where(F.col("count") > leaf)))
        if last:
            edges.append(join_leaves(now, regions, percent, leaf))
            far = None
        else:
            (own, *links), far, slow = join_level(now, index, led, percent, leaf)
            cores.append(own)
            edges += links
        for t in (index, led, *([regions] if level else [])):
            forget(t)
        if level:
            forget(now)
        if last:
            break
        now, level = far, level + 1
    return cores, edges


def union(tables: list[DataFrame], spark, schema: str) -> DataFrame:
    out = spark.createDataFrame([], schema)
    for t in tables:
        out = out.unionByName(t)
    return out


def components(docs: DataFrame, words: int = 5, percent: int = 80, leaf: int = LEAF) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_shingles, component_id: one row per input row.

    Words are [^\\x20\\x09-\\x0D]+ after lowering A-Z. Two documents link when 100 * intersection >= percent * union of
    their sets of distinct ``words``-word shingles; with fewer words the whole sequence is one shingle. Documents without
    words (null and empty texts) link with nothing and are their own component. component_id is the smallest doc_id
    reachable by links. Rows with equal sets are joined once, so copies need no comparison. Rows repeated with one doc_id
    are one document of several sets; rows with null doc_id take the component of their set and give it no id. Empty
    tables give no rows. Other columns are ignored.

    A shingle is a 64-bit hash: a set of n shingles is told wrong with a chance of n^2 / 2^65. Equal sets are those of equal
    128-bit hashes.
    """
    spark = docs.sparkSession
    table = written(prints(docs, words), "jaccard-prints")
    firsts = table.where("key is not null").groupBy("key").agg(F.min("rid").alias("first"), F.min("doc_id").alias("id"), F.first("own").alias("own"), F.first("n").alias("n"))
    firsts = written(firsts, "jaccard-firsts")
    members = company(table, firsts, percent)
    cores, edges = join(members, percent, leaf)
    forget(members)
    held = union([t.select("rid", "core") for t in cores], spark, "rid long, core long")
    owners = firsts.select("key", "id", "first").join(held, F.col("first") == F.col("rid"), "left").select("key", "id", F.coalesce("core", "first").alias("node"))
    owners = written(owners, "jaccard-owners")
    links = union(edges, spark, "u long, v long")
    # one document of several sets connects them
    named = table.where("key is not null and doc_id is not null").select("doc_id", "key", "own")
    twice = written(named.groupBy("doc_id").agg(F.min("own").alias("lo"), F.max("own").alias("hi")).where("lo <> hi").select("doc_id"), "jaccard-twice")
    if not is_empty(twice):
        sets = named.join(twice, "doc_id").select("doc_id", "key").distinct().join(owners, "key").select("doc_id", "node")
        least = sets.groupBy("doc_id").agg(F.min("node").alias("least"))
        links = links.unionByName(sets.join(least, "doc_id").select(F.col("node").alias("u"), F.col("least").alias("v")))
    trees = written(connected_components(links), "jaccard-trees")
    placed = written(owners.join(trees, "node", "left").select("key", "id", F.coalesce("root", "node").alias("root")), "jaccard-placed")
    ids = written(placed.groupBy("root").agg(F.min("id").alias("component_id")), "jaccard-ids")
    found = written(placed.join(ids, "root").select("key", "component_id"), "jaccard-found")
    for t in (*cores, *edges, owners, twice, trees, placed, ids, firsts):
        forget(t)
    rows = table.select("doc_id", F.col("n").alias("n_shingles"), "key")
    full = rows.where("key is not null").join(found, "key").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return full.unionByName(rows.where("key is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def keep_first(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each component, the one with the smallest doc_id, in docs' own columns, whatever their names.

    Rows with null doc_id and documents without words stay.
    """
    gone = components(docs, words, percent).where("doc_id <> component_id").select(F.col("doc_id").alias("jj__id")).distinct()
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("jj__row"))
    return held.join(gone, F.col("jj__row.doc_id") == F.col("jj__id"), "left_anti").select("jj__row.*")
