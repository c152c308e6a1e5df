"""The driver's tables as the tables that the jobs take."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.functions.scoring import importance
from memspark.functions.vectors import normalise
from memspark.schemas import MEMORY_TYPES, SEMANTIC_TYPES

AS_OF = "2024-02-01 00:00:00"


def as_of() -> Column:
    return F.to_timestamp(F.lit(AS_OF))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def memories(spark: SparkSession, sf_dir: str, user: str = "source") -> DataFrame:
    """A memory for each document; ``user``: the column that names its user."""
    docs = table(spark, sf_dir, "documents")
    accesses = table(spark, sf_dir, "events").select((F.col("event_id") % docs.count()).alias("doc_id")).groupBy("doc_id").agg(F.count("*").alias("access_count"))
    created = F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60)
    kind = F.element_at(F.array(*map(F.lit, MEMORY_TYPES)), (F.col("doc_id") % 7 + 1).cast("int"))
    confirmed = F.col("doc_id") % 23 == 0
    return docs.join(accesses, "doc_id", "left").select(
        F.col("doc_id").cast("string").alias("memory_id"),
        "doc_id",
        F.col(user).alias("user_id"),
        F.concat(F.lit("user:"), F.col(user)).alias("namespace"),
        F.col("text").alias("content"),
        kind.alias("memory_type"),
        F.when(kind.isin(SEMANTIC_TYPES), "semantic").otherwise("episodic").alias("memory_layer"),
        created.alias("created_at"),
        created.alias("updated_at"),
        F.when(F.col("doc_id") % 10 != 0, created).alias("event_time"),
        F.when(F.col("doc_id") % 17 == 0, "superseded").otherwise("active").alias("status"),
        importance(F.col("text")).alias("importance_score"),
        F.when(confirmed, "confirmed").otherwise("none").alias("contradiction_status"),
        F.when(confirmed, F.lit(0.5) + (F.col("doc_id") % 5) / 10).alias("contradiction_confidence"),
        F.coalesce("access_count", F.lit(0)).alias("access_count"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """memory_id and embedding from the embeddings table."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("memory_id"), F.col("embedding").cast("array<double>").alias("embedding"))


def text_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """memory_id and embedding: signed hashed runs of three words of the text, 64 buckets, of length 1."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lower("text").cast("binary").alias("text")).filter("text IS NOT NULL")
    sums = docs.mapInArrow(_run_sums, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, s array<bigint>")
    # Rows of one doc_id count as one text each, and add up.
    held = sums.groupBy("doc_id").agg(F.collect_list("s").alias("s"))
    added = F.aggregate(F.slice("s", 2, F.size("s")), F.get("s", F.lit(0)), lambda a, x: F.zip_with(a, x, lambda y, z: y + z))
    raw = F.when(F.size("s") == 1, F.get("s", F.lit(0))).otherwise(added).cast("array<double>")
    return held.select("doc_id", raw.alias("raw")).select(F.col("doc_id").cast("string").alias("memory_id"), normalise(F.col("raw")).alias("embedding"))


def _run_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text the sum of signs in each of 64 buckets, by the first four bytes of the MD5 of its runs; in columns, a run costs ten times as much."""
    for batch in batches:
        sums = np.zeros((batch.num_rows, 64), np.int64)
        for i, text in enumerate(batch.column("text")):
            words = text.as_py().split()  # at ASCII white space, as the text is bytes
            runs = map(b" ".join, zip(words, words[1:], words[2:])) if len(words) >= 3 else [b" ".join(words)]
            h = np.frombuffer(b"".join([hashlib.md5(run, usedforsecurity=False).digest() for run in runs]), ">u4")[::4].astype(np.int64)
            sums[i] = np.bincount(h % 64 * 2 + h // 64 % 2, minlength=128).reshape(64, 2) @ (-1, 1)
        offsets = pa.array(np.arange(0, sums.size + 1, 64, dtype=np.int32))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(offsets, pa.array(sums.ravel()))], ["doc_id", "s"])


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query for each 25th vector, asked by its document's user."""
    own = table(spark, sf_dir, "embeddings").filter("vec_id % 25 = 0")
    return own.join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), F.col("source").alias("user_id")), "vec_id").select(
        F.concat(F.lit("q"), F.col("vec_id")).alias("query_id"), "user_id", F.lit("").alias("namespace"), F.lit("").alias("query_text"), F.col("embedding").cast("array<double>").alias("embedding"), "label"
    )


def text_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query of each benchmark text."""
    return table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("b"), F.col("item_id")).alias("query_id"),
        F.col("text").alias("query_text"),
        F.concat(F.lit("src"), F.col("item_id") % 20).alias("user_id"),
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An observation for each event."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.concat(F.lit("e"), F.col("event_id")).alias("observation_id"),
        F.concat(F.lit("s"), F.col("user_id") % 10).alias("session_id"),
        F.concat(F.lit("u"), F.col("user_id")).alias("user_id"),
        F.lit("agent").alias("agent_id"),
        F.concat_ws(" ", "event_type", "props").alias("content"),
        F.lit("user_message").alias("source_type"),
        F.col("ts").cast("timestamp").alias("observed_at"),
        F.element_at(F.array(*map(F.lit, MEMORY_TYPES)), (F.col("event_id") % 7 + 1).cast("int")).alias("memory_type"),
        F.when(F.col("event_id") % 11 == 0, (F.col("event_id") % 13) / 10).alias("importance_override"),
    )
