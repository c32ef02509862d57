"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where none is
    set, a temporary folder if all run on this machine (tests); an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tessella-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


#: Rows that go to a Python worker at once; whole texts are large beside Spark's default of 10,000.
BATCH_ROWS = 1000


@contextmanager
def small_batches(spark: SparkSession):
    """Python stages run inside get at most ``BATCH_ROWS`` rows at once; the session's own setting returns."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = spark.conf.get(key)
    if 0 < int(own) <= BATCH_ROWS:
        yield
        return
    spark.conf.set(key, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(key, own)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``."""
    for batch in batches:
        for lo in range(0, len(batch), rows):
            yield batch.slice(lo, rows)


def materialise(df: DataFrame, tag: str, small: bool = False) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back, so that its
    lineage ends there and lost executors cost nothing. ``small``: its Python
    stages get small batches."""
    return write_and_read(df, fresh_path(df.sparkSession, tag), small)


def write_and_read(df: DataFrame, path: str, small: bool) -> DataFrame:
    with small_batches(df.sparkSession) if small else nullcontext():
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables that one operator writes and needs no longer once its own result is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def table(self, df: DataFrame, tag: str, small: bool = False) -> DataFrame:
        path = fresh_path(self.spark, tag)
        self.paths.append(path)
        return write_and_read(df, path, small)

    def drop(self) -> None:
        remove(self.spark, self.paths)
        self.paths = []


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Deletes folders of the shared folder, whatever its file system."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def broadcast_if_small(df: DataFrame, max_rows: int, width: Column | None = None) -> DataFrame:
    """A broadcast hint only if df has at most ``max_rows`` rows or, where rows have
    no bounded width, at most that sum of ``width``. Beyond that the join shuffles
    and adaptive execution splits skewed partitions. Hand over a materialised df."""
    if width is None:
        small = df.limit(max_rows + 1).count() <= max_rows
    else:
        small = (df.agg(F.sum(width)).first()[0] or 0) <= max_rows
    return F.broadcast(df) if small else df


def row_keys(doc_id: Column, text: Column) -> list[Column]:
    """128 bits of an id and a text, to find a row again; rows of equal keys are alike."""
    return [F.xxhash64(doc_id, text).alias("key_a"), F.xxhash64(text, F.lit("b"), doc_id).alias("key_b")]


def hashed_sample(df: DataFrame, key: str, limit: int) -> DataFrame:
    """At most ``limit`` rows of df (one a key): those with the least hashes of the key. A
    cut by the counted rows goes first, so that no task gets more than the sample."""
    n = df.count()
    place = F.pmod(F.xxhash64(key), F.lit(1 << 32))
    if n > 2 * limit:
        df = df.where(place < F.lit(int((1 << 32) * 1.5 * limit / n)))
    return df.orderBy(place, key).limit(limit)
