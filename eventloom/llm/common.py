"""What the operators share: text helpers and connected components, and tables in the shared folder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.shared import forget, is_empty, new_path, remove, shared_dir, written

__all__ = ["connected_components", "forget", "is_empty", "new_path", "remove", "shared_dir", "text_slabs", "unit_hash", "without_spaces", "word_count", "written"]

#: The white space that the contracts name: [\x20\x09-\x0D].
SPACES = " \t\n\x0b\f\r"


def without_spaces(text: Column) -> Column:
    """text without the characters of SPACES; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for c in SPACES:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def word_count(text: Column) -> Column:
    """Number of matches of [^\\x20\\x09-\\x0D]+ in text; null: 0."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(F.coalesce(trimmed, F.lit("")) == "", 0).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))).cast("long")


def unit_hash(seed: str, *cols: Column) -> Column:
    """A double in [0, 1) from the MD5 of seed and the columns; the same in any engine."""
    key = F.concat_ws(":", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("null")) for c in cols])
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def text_slabs(batches: Iterator[pa.RecordBatch], column: int, size: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches with their texts, of about ``size`` bytes of text each; null texts are empty."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        slab = np.cumsum(sizes, dtype=np.int64) // size
        cuts = np.flatnonzero(np.concatenate([[True], slab[1:] != slab[:-1]])).tolist() if len(slab) else []
        for a, b in zip(cuts, [*cuts[1:], len(slab)], strict=False):
            part = batch.slice(a, b - a)
            yield part, [t or "" for t in part.column(column).to_pylist()]


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Components of an undirected graph: edges (u, v) of longs -> (node, root), root the smallest node reachable.

    Large-star and small-star rounds: every round hangs a node's larger neighbours under its smallest one, until all
    trees are stars. What a join reads is a table in the shared folder, so that adaptive execution can split a node with
    many neighbours; minima are taken within each task first. Nodes without an edge to another node are absent.
    """
    now = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")

    def hung(ends: DataFrame, least: DataFrame) -> DataFrame:
        """Each v of ends (u, v) under the smallest neighbour m of u."""
        return ends.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))

    for _ in range(rounds):
        # stars: no root has a smaller neighbour, and every node has one root
        ends = now.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(now.select("v", F.lit(0), F.lit(1)))
        if is_empty(ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up > 0 and down > 0)")):
            break
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = written(hung(both.where("v > u"), least).distinct(), "edges")
        forget(least)
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        own = least.select("u", F.col("m").alias("v"))
        after = written(hung(large, least).where("u <> v").union(own).distinct(), "edges")
        for table in (now, large, least):
            forget(table)
        now = after
    else:
        raise RuntimeError(f"components not found in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
