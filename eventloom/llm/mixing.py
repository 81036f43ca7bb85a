"""Mixing sources to target weights, with DataFrame functions only.

Sizes are summed by source, every source gets a target by weight with an upper limit, and a document is emitted
floor(rate) times plus one copy drawn by a hash of its id with the fraction as probability.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm.common import unit_hash, word_count

WEIGHTS = (5, 2, 1)
SEED = "mix-1"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sizes (source, source_size) -> (source, source_size, target).

    Sources by code point, null last, have the weights in turn. They share ``share`` times all sizes by weight; no target
    exceeds ``most`` times its source's size, and what is above is shared again. In order of limit by weight, a source is
    at its limit if the share of those from it on, by weight, reaches that limit. The windows run over one row per source.
    An empty table gives no rows; sources of size 0 have target 0.
    """
    everything = Window.partitionBy(F.lit(0))
    by_limit = everything.orderBy(F.col("limit_") / F.col("weight_"), "turn_")
    turn = F.row_number().over(everything.orderBy(F.asc_nulls_last("source"))) - 1
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("turn_") % len(weights) + 1).cast("int"))
    out = sizes.withColumn("turn_", turn).withColumn("weight_", pick)
    out = out.withColumn("limit_", F.col("source_size") * F.lit(float(most))).withColumn("all_", F.sum("source_size").over(everything) * F.lit(float(share)))
    before = F.coalesce(F.sum("limit_").over(by_limit.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    onward = F.sum("weight_").over(by_limit.rowsBetween(0, Window.unboundedFollowing))
    out = out.withColumn("full_", (F.col("all_") - before) * F.col("weight_") >= F.col("limit_") * onward)
    rest = F.col("all_") - F.sum(F.when(F.col("full_"), F.col("limit_")).otherwise(0.0)).over(everything)
    heft = F.sum(F.when(F.col("full_"), 0.0).otherwise(F.col("weight_"))).over(everything)
    return out.withColumn("rest_", rest).withColumn("heft_", heft).select(
        "source", "source_size", F.when(F.col("full_"), F.col("limit_")).otherwise(F.col("weight_") * (F.col("rest_") / F.col("heft_"))).alias("target")
    )


def copies(rate: Column, *keys: Column, seed: str = SEED) -> Column:
    """floor(rate), and one more with the fraction as probability, by a hash of the keys."""
    return (F.floor(rate) + F.when(unit_hash(seed, *keys) < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def mix_plan(docs: DataFrame, seed: str = SEED, **shares) -> DataFrame:
    """docs (doc_id, text, source) -> doc_id, size, source_size, target, copies, taken: one row per input row.

    Null text has size 0, null source is a source of its own, rows with one doc_id draw alike. Only sizes are shuffled,
    never texts; a hot source is summed in part before the shuffle.
    """
    sized = docs.select("doc_id", F.col("source").alias("source_"), word_count(F.col("text")).alias("size"))
    sums = docs.select("source", word_count(F.col("text")).alias("size_")).groupBy("source").agg(F.sum("size_").alias("source_size"))
    targets = source_targets(sums, **shares)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    out = sized.join(targets, F.col("source_").eqNullSafe(F.col("source")), "left").withColumn("copies", copies(rate, F.col("doc_id"), seed=seed))
    return out.select("doc_id", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mix_documents(docs: DataFrame, seed: str = SEED, **shares) -> DataFrame:
    """docs with every row as often as the mix takes it, in docs' own columns, whatever their names.

    Rows of size 0 follow their source's rate like others. Sources of size 0 give no rows.
    """
    sums = docs.select(F.col("source"), word_count(F.col("text")).alias("size_")).groupBy("source").agg(F.sum("size_").alias("source_size"))
    targets = source_targets(sums, **shares).where("source_size > 0")
    rates = targets.select(F.struct("source").alias("mix__source"), (F.col("target") / F.col("source_size")).alias("mix__rate"))
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("mix__row"))
    taken = held.join(rates, F.col("mix__row.source").eqNullSafe(F.col("mix__source.source"))).withColumn(
        "mix__copies", copies(F.col("mix__rate"), F.col("mix__row.doc_id"), seed=seed)
    )
    return taken.where("mix__copies > 0").select("mix__row", F.explode(F.sequence(F.lit(1), F.col("mix__copies").cast("int")))).select("mix__row.*")
