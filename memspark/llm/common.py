"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import AbstractContextManager, contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the folder; only Spark opens the path."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file is installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only in local mode, where none is set."""
    name = spark.conf.get("spark.checkpoint.dir", None)
    if not name:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        name = tempfile.mkdtemp(prefix="memspark-")
        spark.conf.set("spark.checkpoint.dir", name)
        spark.sparkContext.setCheckpointDir(name)
    return name.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


@contextmanager
def _set(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session while the actions inside run."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def shuffles_dropped(spark: SparkSession) -> AbstractContextManager[None]:
    """Shuffle files of the actions inside go when each action ends, as their result is in a table."""
    return _set(spark, _CLEANUP, "true")


def small_batches(spark: SparkSession, size: int) -> AbstractContextManager[None]:
    """Actions inside send wide rows to Python in batches of about ``size`` bytes, of which the JVM holds several outside of its heap."""
    return _set(spark, "spark.sql.execution.arrow.maxBytesPerBatch", f"{size}b")


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends, executors may be lost."""
    spark = df.sparkSession
    path = new_path(spark, label)
    with shuffles_dropped(spark):
        df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._cut_path = path
    return table


def drop(*tables: DataFrame) -> None:
    """Delete tables that cut() has written, when nothing will read them any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table._cut_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def key128(*cols: Column) -> Column:
    """Two independent 64-bit hashes; equal for equal values, and in practice only for them."""
    return F.struct(F.xxhash64(*cols).alias("a"), F.xxhash64(F.lit(7), *cols).alias("b"))


def slices(batch: pa.RecordBatch, column: str, chars: int = 1_000_000, rows: int = 1 << 31) -> Iterator[pa.RecordBatch]:
    """Parts of a batch holding about ``chars`` characters each, a row at least and ``rows`` at most."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and (total + n > chars or i - start >= rows):
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)
