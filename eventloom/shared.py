"""The folder all executors share, and tables written there to cut lineage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no spark.checkpoint.dir, as in local tests.
LOCAL_CHECKPOINTS = "/tmp/checkpoints"
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session, or a local one where that is unset."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return (named or LOCAL_CHECKPOINTS).rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Within, the shuffle files of a job go when it ends."""
    kept = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, kept)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within, jobs hand at most so many rows to Python at once: both sides hold a whole batch in memory."""
    kept = spark.conf.get(ARROW_ROWS)
    spark.conf.set(ARROW_ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(ARROW_ROWS, kept)


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and survives lost executors."""
    spark, path = df.sparkSession, new_path(df.sparkSession, what)
    with passing(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def is_empty(df: DataFrame) -> bool:
    """Whether df has no row; leaves no shuffle files."""
    with passing(df.sparkSession):
        return df.limit(1).isEmpty()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table or folder that no later plan reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def forget(df: DataFrame) -> None:
    """Deletes the files of a table made by written()."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()[:1]}:
        remove(df.sparkSession, folder)
