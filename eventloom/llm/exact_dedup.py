"""Exact deduplication by a stateful stream, with DataFrame functions only.

A table of digests is read as a stream. Keyed state on disk (RocksDB, checkpointed in the shared folder) keeps, for every
digest and without expiry, the row that stays - its length, identifier and content locator - and the number of rows.
Digests with several rows are hits: their full texts are compared, and a digest with different texts is split by text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import forget, new_path, remove, without_spaces, written

#: State on disk, and no disk set aside in advance by each of its instances.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _first(df: DataFrame) -> DataFrame:
    """df of digest and row_ -> the row that stays and the number of rows, by digest."""
    return df.groupBy("digest").agg(F.min("row_").alias("first_"), F.count(F.lit(1)).alias("n_"))


def stream_state(prints: DataFrame, path: str, most: int = 4_000_000_000) -> DataFrame:
    """The final state of the stream over the table of digests at path, read in batches of ``most`` bytes: digest, first_, n_."""
    spark = prints.sparkSession
    kept, checkpoint = {k: spark.conf.get(k, None) for k in STATE}, new_path(spark, "dedup-state")
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        stream = spark.readStream.schema(prints.schema).option("maxBytesPerTrigger", most).parquet(path)
        query = _first(stream).writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        states = spark.read.format("statestore").load(checkpoint)
        kinds = dict(states.select("value.*").dtypes)
        (number,) = [c for c, kind in kinds.items() if kind == "bigint"]
        (first,) = [c for c in kinds if c != number]
        out = written(states.select("key.digest", F.col(f"value.`{first}`").alias("first_"), F.col(f"value.`{number}`").alias("n_")), "dedup-groups")
    finally:
        for k, v in kept.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    remove(spark, checkpoint)
    return out


def _texts(docs: DataFrame, hit: DataFrame, digest, salts: int) -> DataFrame:
    """digest, salt, norm: the texts whose digests are in hit."""
    norm = without_spaces(F.col("text"))
    salted = hit.select("digest", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    salt = F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(salts)).cast("int")
    return docs.select(digest(norm).alias("digest"), norm.alias("norm"), salt.alias("salt")).join(salted.hint("merge"), ["digest", "salt"])


def exact_dedup(docs: DataFrame, digest=sha256, salts: int = 16) -> DataFrame:
    """docs (doc_id, text) -> doc_id, keep_id, group_size, kept, text_sha256: one row per input row.

    Texts are equal when they are identical without white space ([\\x20\\x09-\\x0D]); null counts as empty, so all null,
    empty and blank texts are one group. The row with the most code points in its text stays, then the smallest doc_id
    (null last); of rows repeated with one doc_id exactly one stays. Empty tables give no rows. Other columns are ignored.
    The locator is the row's partition and place in it. The digest decides the state's key; equality is decided by the full texts of the hits.
    """
    spark = docs.sparkSession
    norm = without_spaces(F.col("text"))
    length = F.coalesce(F.length("text"), F.lit(0))
    row = F.struct((-length).alias("neg"), F.col("doc_id").isNull().alias("no_id"), "doc_id", F.monotonically_increasing_id().alias("locator"))
    path = new_path(spark, "dedup-digests")
    docs.select(digest(norm).alias("digest"), row.alias("row_"), sha256(norm).alias("text_sha256")).write.parquet(path)
    prints = spark.read.parquet(path)
    slim = prints.select("digest", "row_")
    groups = stream_state(slim, path) if prints.limit(1).count() else _first(slim)

    # hits: all texts of a digest with several rows, compared in full; digest and salt deal the texts, so no group meets in one
    # task. Both joins with the groups merge at any size: hits grow with the input, and the disk of a small run is that of a large
    # one in proportion
    hit = written(groups.where("n_ > 1").select("digest"), "dedup-hits")
    ends = _texts(docs, hit, digest, salts).groupBy("digest", "salt").agg(F.min("norm").alias("lo"), F.max("norm").alias("hi")).groupBy("digest").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    clashes = written(ends.where("lo <> hi").select("digest"), "dedup-clashes")
    forget(hit)

    whole = "digest"
    if clashes.limit(1).count():  # equal digests of different texts: these digests are keyed by the text itself
        texts = docs.select(digest(norm).alias("digest"), norm.alias("norm"), row.alias("row_"), sha256(norm).alias("text_sha256"))
        texts = written(texts.join(clashes, "digest", "left_semi").withColumn("digest", F.concat_ws("/", "digest", "norm")).drop("norm"), "dedup-clash-rows")
        prints = prints.join(clashes, "digest", "left_anti").unionByName(texts)
        groups = groups.join(clashes, "digest", "left_anti").unionByName(_first(texts.select("digest", "row_")))
    out = prints.join(groups.hint("merge"), whole)
    return out.select(
        F.col("row_.doc_id").alias("doc_id"),
        F.col("first_.doc_id").alias("keep_id"),
        F.col("n_").cast("long").alias("group_size"),
        (F.col("row_.locator") == F.col("first_.locator")).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """docs without the rows that exact_dedup() does not keep, in docs' own columns, whatever their names."""
    keys = exact_dedup(docs).where("kept").select(F.col("doc_id").alias("dd__id"), F.col("text_sha256").alias("dd__sha")).distinct()
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("dd__row"), sha256(without_spaces(F.col("text"))).alias("dd__own"))
    same = F.col("dd__row.doc_id").eqNullSafe(F.col("dd__id")) & (F.col("dd__own") == F.col("dd__sha"))
    left = held.join(keys, same, "left_semi")
    # rows repeated with one doc_id and one text: the longest text stays, of equally long ones the last in text and in a hash
    longest = F.max_by("dd__row", F.struct(F.coalesce(F.length("dd__row.text"), F.lit(0)), "dd__row.text", F.xxhash64("dd__row")))
    twice = docs.groupBy("doc_id").count().where("`count` > 1").select(F.col("doc_id").alias("dd__twice"))
    hit = F.col("dd__row.doc_id").eqNullSafe(F.col("dd__twice"))
    single = left.join(twice, hit, "left_anti").select("dd__row.*")
    again = left.join(twice, hit, "left_semi").groupBy(F.col("dd__row.doc_id").alias("i"), "dd__own").agg(longest.alias("dd__row")).select("dd__row.*")
    return single.unionByName(again)
