"""Reflections: when they are due, what goes in, and how they are stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspark.config import DEFAULTS, Defaults
from memspark.operators.catalog import count_active
from memspark.schemas import with_defaults


def due(memories: DataFrame, d: Defaults = DEFAULTS) -> DataFrame:
    """Users and namespaces whose active memories have reached a multiple of the threshold."""
    return count_active(memories, "user_id", "namespace").filter(F.col("n") % d.reflect_every == 0)


def inputs(memories: DataFrame, d: Defaults = DEFAULTS) -> DataFrame:
    """user_id, namespace, ids (newest first) and text of the newest active observations, if there are enough."""
    own = memories.filter("status = 'active' AND memory_type = 'observation'")
    place = F.row_number().over(Window.partitionBy("user_id", "namespace").orderBy(F.desc("created_at"), "memory_id"))
    newest = own.withColumn("place", place).filter(F.col("place") <= d.reflect_newest)
    lists = newest.groupBy("user_id", "namespace").agg(F.array_sort(F.collect_list(F.struct("place", "memory_id", "content"))).alias("r"))
    text = F.array_join(F.transform("r", lambda x: F.concat(F.lit("- "), x["content"])), "\n")
    return lists.filter(F.size("r") >= d.reflect_least).select("user_id", "namespace", F.transform("r", lambda x: x["memory_id"]).alias("ids"), text.alias("text"))


def supporting_ids(indices: Column, ids: Column) -> Column:
    """Ids at the given places; places out of range are passed over."""
    return F.transform(F.filter(indices, lambda i: (i >= 0) & (i < F.size(ids))), lambda i: F.get(ids, i))


def store(asked: DataFrame, replies: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """Memories and reflection rows of ``replies`` (user_id, namespace, reflections: content, confidence, supporting_indices) to the inputs ``asked``."""
    each = replies.join(asked.select("user_id", "namespace", "ids"), ["user_id", "namespace"]).select("user_id", "namespace", "ids", F.posexplode("reflections").alias("k", "r"))
    rows = each.select(
        F.substring(F.sha2(F.concat_ws("|", "user_id", "namespace", F.col("k").cast("string"), "r.content"), 256), 1, 32).alias("reflection_id"), "user_id", F.lit("").alias("agent_id"), "namespace",
        F.col("r.content").alias("content"), supporting_ids(F.col("r.supporting_indices"), F.col("ids")).alias("derivation_ids"), F.coalesce("r.confidence", F.lit(0.7)).alias("confidence"),
        F.lit(1).alias("version"), as_of.alias("created_at"), as_of.alias("updated_at"),
    )
    memories = rows.select(
        F.col("reflection_id").alias("memory_id"), "user_id", "agent_id", "namespace", "content", F.col("confidence").alias("confidence_score"), F.col("derivation_ids").alias("parent_memory_ids"),
        F.lit("reflection").alias("memory_type"), F.lit("semantic").alias("memory_layer"), F.lit("reflection").alias("source_type"), "created_at", "updated_at",
    )
    return with_defaults(memories), rows
