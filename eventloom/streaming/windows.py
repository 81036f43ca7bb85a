"""Continuous forms: windows with watermarks, idempotent ingest, keyed state, upserts of read models."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from eventloom.operators import declarative
from eventloom.shared import new_path


def file_stream(spark: SparkSession, path: str, schema, files: int = 100) -> DataFrame:
    """Events from new Parquet files of a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def windowed(stream: DataFrame, size: str, late: str, slide: str | None = None, keys: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Counts and sums by event-time window; rows later than ``late`` are dropped once their window is closed."""
    timed = stream.withWatermark("timestamp", late)
    w = F.window("timestamp", size, slide) if slide else F.window("timestamp", size)
    got = timed.groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return got.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


def session_windows(stream: DataFrame, gap: str, late: str, keys: tuple[str, ...] = ("entity_id",)) -> DataFrame:
    timed = stream.withWatermark("timestamp", late)
    got = timed.groupBy(F.session_window("timestamp", gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return got.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def once(stream: DataFrame, key: str = "idempotency_key", ttl: str = "24 hours") -> DataFrame:
    """The first event of each key within the time to live; state expires with the watermark."""
    return stream.withWatermark("timestamp", ttl).dropDuplicatesWithinWatermark([key])


def folded(stream: DataFrame, key: str, ops: list[dict]) -> DataFrame:
    """The declarative view as a stream of changes: key, state (JSON; null: deleted), events, refused, an update per batch and key.
    Each batch's events of a key are folded in order of (timestamp, id) onto the state."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        text, n, refused = state.get if state.exists else ("null", 0, 0)
        row = json.loads(text)
        frame = pd.concat(list(frames)).sort_values(["timestamp", "id"])  # one key's events of one micro-batch
        for event_type, payload in zip(frame["event_type"], frame["payload"], strict=True):
            row, more = declarative.step(row, event_type, json.loads(payload or "{}"), ops)
            n, refused = n + 1, refused + more
        text = json.dumps(row, sort_keys=True)
        state.update((text, n, refused))
        yield pd.DataFrame({"key": [k[0]], "state": [None if row is None else text], "events": [n], "refused": [refused]})

    rows = stream.select(key, "event_type", "payload", "timestamp", "id")
    return rows.groupBy(key).applyInPandasWithState(step, "key string, state string, events long, refused long", "state string, events long, refused long", "update", GroupStateTimeout.NoTimeout)


class ReadModel:
    """A keyed table in the shared folder, one folder a revision: (key, state, version, deleted).

    A commit joins the changes with the current revision, newest per key, and writes the next folder whole; the revision
    counts only once its marker file is there. So a batch that is repeated after a failure gives the same revision again.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or new_path(spark, "read-model")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def revision(self) -> int:
        """The newest complete revision, 0 before any."""
        fs, p = self._fs(self.path)
        if not fs.exists(p):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        done = [int(n[1:]) for n in names if n.startswith("r") and n[1:].isdigit() and fs.exists(self._fs(f"{self.path}/{n}/_SUCCESS")[1])]
        return max(done, default=0)

    def rows(self, revision: int | None = None, deleted: bool = False) -> DataFrame:
        r = self.revision() if revision is None else revision
        if not r:
            return self.spark.createDataFrame([], "key string, state string, version long, deleted boolean")
        got = self.spark.read.parquet(f"{self.path}/r{r}")
        return got if deleted else got.where("not deleted")

    def commit(self, changes: DataFrame, expected: int | None = None) -> int:
        """changes (key, state; null deletes) as the revision after ``expected`` (default: the current one). Raises if another
        commit came between."""
        now = self.revision()
        if expected is not None and expected != now:
            raise ValueError(f"revision is {now}, not {expected}")
        new = changes.select("key", "state", F.lit(now + 1).cast("long").alias("version"), F.col("state").isNull().alias("deleted"))
        both = self.rows(deleted=True).unionByName(new)
        newest = both.withColumn("at_", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("version")))).where("at_ = 1").drop("at_")
        newest.write.mode("overwrite").parquet(f"{self.path}/r{now + 1}")
        return now + 1

    def changes(self, since: int) -> DataFrame:
        """Rows changed after a revision, deletions included."""
        return self.rows(deleted=True).where(F.col("version") > since)

    def page(self, prefix: str = "", after: str = "", limit: int = 500) -> DataFrame:
        return self.rows().where(F.col("key").startswith(prefix) & (F.col("key") > after)).orderBy("key").limit(limit)


def into(model: ReadModel) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: commits each batch's changes once; batch b gives revision b + 1, so a repeated batch is passed over."""

    def sink(batch: DataFrame, number: int) -> None:
        if model.revision() <= number:
            model.commit(batch.select("key", "state"), expected=number)

    return sink


def run_to_end(out: DataFrame, sink: Callable[[DataFrame, int], None], mode: str = "update", checkpoint: str | None = None) -> None:
    """Drives a stream over all that is there, then stops."""
    path = checkpoint or new_path(out.sparkSession, "stream-checkpoint")
    out.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", path).trigger(availableNow=True).start().awaitTermination()
