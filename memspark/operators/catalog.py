"""Listing, counting, soft deletion and the audit log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def list_memories(memories: DataFrame, user_id: str = "", namespace: str = "", memory_type: str = "", status: str = "", limit: int | None = 50, offset: int = 0) -> DataFrame:
    """Newest first within each user; an empty condition is none. ``limit`` and ``offset`` hold for each user."""
    for name, value in (("user_id", user_id), ("namespace", namespace), ("memory_type", memory_type), ("status", status)):
        if value:
            memories = memories.filter(F.col(name) == value)
    if limit is None:
        return memories
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("created_at"), "memory_id"))
    return memories.withColumn("place", place).filter((F.col("place") > offset) & (F.col("place") <= offset + limit))


def count_active(memories: DataFrame, *by: str) -> DataFrame:
    return memories.filter("status = 'active'").groupBy(*(by or ("user_id",))).agg(F.count("*").alias("n"))


def user_stats(memories: DataFrame) -> DataFrame:
    """For each user the memories and the distinct namespaces, sorted."""
    return memories.groupBy("user_id").agg(F.count("*").alias("total_memories"), F.array_sort(F.collect_set("namespace")).alias("namespaces"))


def facts_of_user(facts: DataFrame, user_id: str = "", subject: str = "") -> DataFrame:
    rows = facts.filter("status = 'active'")
    for name, value in (("user_id", user_id), ("subject", subject)):
        if value:
            rows = rows.filter(F.col(name) == value)
    return rows.select("user_id", "fact_id", "subject", "predicate", "object", "confidence")


def list_contradictions(reports: DataFrame, resolved: bool | None = None) -> DataFrame:
    return reports if resolved is None else reports.filter(F.col("resolved") == resolved)


def soft_delete(memories: DataFrame, ids: DataFrame, as_of: Column) -> DataFrame:
    """Memories whose id is in ``ids`` (memory_id) get status deleted."""
    hit = ids.select("memory_id").distinct().withColumn("_hit", F.lit(True))
    joined = memories.join(hit, "memory_id", "left")
    return joined.withColumn("status", F.when(F.col("_hit"), "deleted").otherwise(F.col("status"))).withColumn("updated_at", F.when(F.col("_hit"), as_of).otherwise(F.col("updated_at"))).select(*memories.columns)


def preview(content: Column, length: int = 200) -> Column:
    return F.substring(content, 1, length)


def audit_log(before: DataFrame, after: DataFrame, as_of: Column) -> DataFrame:
    """Rows of operation_log for what differs: created ids, deleted ones (status), and other changes of status, version or accesses."""
    watched = ["status", "version", "access_count", "contradiction_status"]
    watched = [c for c in watched if c in before.columns and c in after.columns]
    old = before.select("memory_id", F.struct(*watched).alias("old"))
    both = after.select("memory_id", "user_id", F.struct(*watched).alias("new")).join(old, "memory_id", "left")
    operation = F.when(F.col("old").isNull(), "create").when((F.col("new.status") == "deleted") & (F.col("old.status") != "deleted"), "delete").when(F.col("old") != F.col("new"), "update")
    details = F.create_map(F.lit("before"), F.to_json("old"), F.lit("after"), F.to_json("new"))
    rows = both.withColumn("operation", operation).filter("operation IS NOT NULL")
    return rows.select(F.substring(F.sha2(F.concat_ws("|", "memory_id", "operation", as_of.cast("string")), 256), 1, 32).alias("log_id"), "memory_id", "user_id", "operation", details.alias("details"), as_of.alias("created_at"))


def audit_trail(log: DataFrame, memory_id: str | None = None) -> DataFrame:
    """What happened to one memory, oldest first, or to each of them; ``place`` counts from 1 within a memory."""
    place = F.row_number().over(Window.partitionBy("memory_id").orderBy("created_at", "log_id"))
    return log.withColumn("place", place) if memory_id is None else log.filter(F.col("memory_id") == memory_id).withColumn("place", place).orderBy("place")
