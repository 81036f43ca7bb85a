"""Near-duplicate embeddings by a PCA-ordered tiled comparison.

An orthogonal rotation (eigenvectors of the second moments of all unit vectors) puts the most telling dimensions first.
Vectors are cut into tiles along the first of them; only tiles whose ranges can hold a pair above the threshold meet. For a
pair of tiles the products of the leading dimensions are accumulated, the rest is bounded by the product of the suffix
norms (Cauchy-Schwarz), and pairs that cannot reach the threshold stop there; survivors go on with more dimensions and
are decided by the cosine of the given components in double precision. Tiles meet in a product of the table of tiles with
itself, each task reading two parts of it, so that no vector is shuffled with a pair; a task returns link counts and a
spanning forest, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import connected_components, forget, written
from eventloom.shared import arrow_rows

TILE = 4096  #: vectors by tile
LEAD = (16, 32)  #: dimensions after which the bound is looked at
SLACK = 1e-5  #: what single precision may add to a bound; larger than its error, so no link is lost
BLOCK = 1 << 16  #: surviving pairs decided at once
PAIRS = 8  #: pairs of tiles handed to Python at once


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows in double precision and of length 1; scaled first, so that no square over- or underflows."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def usable(vectors: DataFrame) -> DataFrame:
    """vectors with a column fit_: not null, not empty, no null or non-finite component, not all zero."""
    fine = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    return vectors.withColumn("fit_", F.coalesce(fine, F.lit(False)))


def rotation(good: DataFrame, dims: int) -> np.ndarray:
    """Eigenvectors, largest eigenvalue first, of the second moments over all rows. Tasks send one matrix each, as rows summed by cell."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for b in batches:
            x = unit_rows(np.array(b.column(0).to_pylist(), np.float64).reshape(-1, dims)) if b.num_rows else np.zeros((0, dims))
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims * dims)), pa.array(total.ravel())], ["cell", "value"])

    cells = good.select("embedding").mapInArrow(moments, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value"))
    total = np.zeros(dims * dims)
    for r in cells.collect():  # dims * dims numbers, whatever the input
        total[r.cell] = r.value
    values, axes = np.linalg.eigh(total.reshape(dims, dims))
    return np.ascontiguousarray(axes[:, np.argsort(-values, kind="stable")])


def tiles_of(good: DataFrame, axes: np.ndarray, tile: int, held: type) -> DataFrame:
    """Tiles: tile, lo and hi on the first axis, the rows' vec_id and their components as given, of type ``held``, a tile by row."""
    dims = len(axes)
    first = axes[:, 0].tolist()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.array(b.column(1).to_pylist(), np.float64).reshape(-1, dims)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in x.astype(held)], pa.binary()), pa.array(unit_rows(x) @ first)], ["vec_id", "x", "at"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, k, waiting, n = TaskContext.get().partitionId() << 24, 0, [], 0

        def out(part: pa.Table) -> pa.RecordBatch:
            at = part.column("at").to_numpy()
            blob = b"".join(part.column("x").to_pylist())
            return pa.RecordBatch.from_pylist([{"tile": base + k, "lo": at.min(), "hi": at.max(), "ids": part.column("vec_id").to_pylist(), "xs": blob}], schema=kind)

        kind = pa.schema([("tile", pa.int64()), ("lo", pa.float64()), ("hi", pa.float64()), ("ids", pa.list_(pa.int64())), ("xs", pa.binary())])
        for b in batches:
            waiting.append(b)
            n += b.num_rows
            while n >= tile:
                rows = pa.Table.from_batches(waiting)
                yield out(rows.slice(0, tile))
                waiting, n, k = rows.slice(tile).to_batches(), n - tile, k + 1
        if n:
            yield out(pa.Table.from_batches(waiting))

    rows = good.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(place, "vec_id long, x binary, at double")
    placed = written(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    count = placed.count()
    parts = max(1, -(-count // tile))  # one tile or two by partition
    # the row's number keeps equal vectors from sharing one partition
    ordered = placed.repartitionByRange(parts, "at", "row").sortWithinPartitions("at") if parts > 1 else placed.coalesce(1).sortWithinPartitions("at")
    out = written(ordered.select("vec_id", "x", "at").mapInArrow(cut, "tile long, lo double, hi double, ids array<long>, xs binary"), "tiles")
    forget(placed)
    return out


Side = tuple[np.ndarray, np.ndarray, list[np.ndarray]]


def prepared(x: np.ndarray, axes: np.ndarray) -> Side:
    """Unit rows of x, then their form for the first bound in single precision, and their forms for further bounds.

    A form holds the leading dimensions on the axes and the norm of the rest: the product of two such rows bounds their cosine.
    """
    r = unit_rows(x)
    p = r @ axes
    steps = [d for d in LEAD if d < len(axes)] or [len(axes)]
    forms = [np.hstack([p[:, :d], np.sqrt(np.maximum(0, (p[:, d:] ** 2).sum(1)))[:, None]]) for d in steps]
    return r, forms[0].astype(np.float32), forms[1:]


def links(a: Side, b: Side, same: bool, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of rows of a and b with cosine >= threshold, in blocks; of one tile with itself, each pair once."""
    (ra, xa, more_a), (rb, xb, more_b) = a, b
    rows = max(1, (1 << 22) // max(1, len(rb)))
    for at in range(0, len(ra), rows):
        bound = xa[at : at + rows] @ xb.T
        i, j = np.divmod(np.flatnonzero(bound >= np.float32(threshold - SLACK)), len(rb))
        i += at
        if same:
            i, j = i[i < j], j[i < j]
        for k in range(0, len(i), BLOCK):
            p, q = i[k : k + BLOCK], j[k : k + BLOCK]
            for ya, yb in zip(more_a, more_b, strict=True):
                keep = np.einsum("nd,nd->n", ya[p], yb[q]) >= threshold - SLACK
                p, q = p[keep], q[keep]
            keep = np.einsum("nd,nd->n", ra[p], rb[q]) >= threshold
            if keep.any():
                yield p[keep], q[keep]


def merge_labels(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Joins the trees of u and v in label, an array of parents in which no parent is larger than its child."""
    while len(u):
        u, v = label[u], label[v]
        while True:
            pu, pv = label[u], label[v]
            if (pu == u).all() and (pv == v).all():
                break
            u, v = pu, pv
        apart = u != v
        u, v = u[apart], v[apart]
        hi, lo = np.maximum(u, v), np.minimum(u, v)
        np.minimum.at(label, hi, lo)
    while True:
        up = label[label]
        if (up == label).all():
            return
        label[:] = up


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, tile: int = TILE) -> DataFrame:
    """vectors (vec_id, embedding) -> vec_id, n_links, component_id, kept: one row per input row.

    Rows link when the cosine of their vectors, in double precision, is at least ``threshold``. Vectors that are null, empty
    or zero or hold null or non-finite components link with nothing; others link with vectors of their own length, each length
    by a run of its own. A row's component is the smallest vec_id reachable from it; rows repeated with one vec_id are rows of their own
    and link like others. Null ids count as largest and are returned as null. Empty tables give no rows.
    """
    marked = usable(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"))
    sizes = marked.where("fit_").groupBy(F.size("embedding").alias("d")).count().where("count > 1").orderBy(F.desc("count"), "d").collect()
    lengths = [r.d for r in sizes]  # one vector of its length has none to link with
    marked = marked.withColumn("fit_", F.col("fit_") & F.size("embedding").isin(lengths))
    out = marked.where("not fit_").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    held = np.float32 if dict(vectors.dtypes)["embedding"] == "array<float>" else np.float64
    for dims in lengths:
        out = of_length(marked.where(F.col("fit_") & (F.size("embedding") == dims)), dims, held, threshold, tile).unionByName(out)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def of_length(good: DataFrame, dims: int, held: type, threshold: float, tile: int) -> DataFrame:
    """good (vec_id, embedding), usable vectors of dims components -> vec_id, n_links, component_id."""
    axes = rotation(good, dims)
    tiles = tiles_of(good, axes, tile, held)

    # tiles meet where their ranges are no farther apart than linked unit vectors can be
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK)
    sides = tiles.select("tile", "lo", "hi", "xs"), tiles.select(*[F.col(c).alias(c + "2") for c in ("tile", "lo", "hi", "xs")])
    near = F.expr("tile <= tile2") & (F.col("lo2") - F.col("hi") <= reach) & (F.col("lo") - F.col("hi2") <= reach)
    pairs = sides[0].hint("shuffle_replicate_nl").join(sides[1], near).select("tile", "tile2", "xs", "xs2")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin: dict[int, int] = {}  # a tile's first place in what follows, for the tiles that the task meets
        node, count, label = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        last, left = None, None
        for batch in batches:
            for r in range(batch.num_rows):
                t1, t2, x1, x2 = (batch.column(c)[r].as_py() for c in range(4))
                same = t1 == t2
                if t1 != last:  # a product keeps its left row for all right ones
                    last, left = t1, prepared(np.frombuffer(x1, held).reshape(-1, dims), axes)
                right = left if same else prepared(np.frombuffer(x2, held).reshape(-1, dims), axes)
                ends = [(t1, len(left[0]))] if same else [(t1, len(left[0])), (t2, len(right[0]))]
                for t, n in ends:
                    if t not in begin:
                        begin[t] = len(node)
                        node, count, label = np.append(node, (t << 20) + np.arange(n)), np.append(count, np.zeros(n, np.int64)), np.append(label, len(label) + np.arange(n))
                place = np.concatenate([begin[t] + np.arange(n) for t, n in ends])
                own = np.arange(len(place))
                for i, j in links(left, right, same, threshold):
                    j = j if same else j + ends[0][1]
                    count[place] += np.bincount(i, minlength=len(place)) + np.bincount(j, minlength=len(place))
                    merge_labels(own, i, j)
                hit = np.flatnonzero(own != np.arange(len(own)))
                if len(hit):
                    merge_labels(label, place[hit], place[own[hit]])
        hit = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(node[hit]), pa.array(count[hit]), pa.array(node[label[hit]])], ["node", "n", "root"])

    with arrow_rows(good.sparkSession, PAIRS):
        found = written(pairs.mapInArrow(compare, "node long, n long, root long"), "links")
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    trees = connected_components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))

    nodes = tiles.select("tile", F.posexplode("ids").alias("k", "vec_id")).select(F.expr("shiftleft(tile, 20) + k").alias("node"), "vec_id")
    linked = nodes.join(counts, "node", "left").join(trees, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = linked.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    return linked.join(least, "root").select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), "component_id")
