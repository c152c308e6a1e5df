"""Versioned updates: match new content to a memory, decide, apply."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspark.config import DEFAULTS, Defaults
from memspark.operators.vector_search import top_per_query
from memspark.schemas import with_defaults

ACTIONS = ["skip", "create", "update", "supersede", "merge"]


def match(contents: DataFrame, memories: DataFrame, vectors: DataFrame, d: Defaults = DEFAULTS) -> DataFrame:
    """``contents`` (decision_id, user_id, new_content, embedding) with existing_memory_id and score of the nearest active memory, and action create where it is not near enough.

    With own_memory_id in ``contents``, that memory is not taken for its own match.
    """
    asked = contents.select(F.col("decision_id").alias("query_id"), "user_id", "embedding")
    held = memories.filter("status = 'active'").select("memory_id", "user_id").join(vectors, "memory_id")
    own = "own_memory_id" in contents.columns
    best = top_per_query(asked, held, 2 if own else 1).select(F.col("query_id").alias("decision_id"), F.col("memory_id").alias("existing_memory_id"), "score", "place")
    if own:
        best = best.join(contents.select("decision_id", "own_memory_id"), "decision_id").filter(F.coalesce(F.col("existing_memory_id") != F.col("own_memory_id"), F.lit(True)))
    best = best.groupBy("decision_id").agg(F.min_by("existing_memory_id", "place").alias("existing_memory_id"), F.min_by("score", "place").alias("score"))
    out = contents.join(best, "decision_id", "left")
    far = F.col("score").isNull() | (F.col("score") < d.update_from)
    return out.withColumn("existing_memory_id", F.when(~far, F.col("existing_memory_id"))).withColumn("action", F.when(far, "create"))


def decide(matched: DataFrame, replies: DataFrame | None = None) -> DataFrame:
    """Decisions: a reply (decision_id, action, reason, merged_content, confidence) where a memory matched; without fields skip and 0.8; without a reply create and 0.5."""
    if replies is None:
        replies = matched.select("decision_id").limit(0).selectExpr("decision_id", "cast(null as string) action", "cast(null as string) reason", "cast(null as string) merged_content", "cast(null as double) confidence")
    r = replies.select("decision_id", F.col("action").alias("_action"), F.col("reason").alias("_reason"), "merged_content", F.col("confidence").alias("_confidence"), F.lit(True).alias("_replied"))
    out = matched.drop("merged_content").join(r, "decision_id", "left")
    created = F.col("action") == "create"
    action = F.when(created, "create").when(F.col("_replied"), F.coalesce("_action", F.lit("skip"))).otherwise("create")
    confidence = F.when(created, 1.0).when(F.col("_replied"), F.coalesce("_confidence", F.lit(0.8))).otherwise(0.5)
    return out.withColumn("confidence", confidence).withColumn("reason", F.coalesce("_reason", F.lit(""))).withColumn("action", action).drop("_action", "_reason", "_confidence", "_replied")


def apply_decisions(memories: DataFrame, decisions: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """Memories after the decisions, and the decisions with applied.

    Several decisions on one memory form a chain in order of decision_id: each supersedes the version before it.
    """
    known = F.col("action").isin(ACTIONS)
    versions = decisions.filter(F.col("action").isin("update", "supersede", "merge") & F.col("existing_memory_id").isNotNull())
    target = with_defaults(memories).select(*(F.col(c).alias(f"o_{c}") for c in ("memory_id", "user_id", "agent_id", "namespace", "memory_type", "source_type", "importance_score", "version", "parent_memory_ids")))
    chain = Window.partitionBy("existing_memory_id").orderBy("decision_id")
    new_id = lambda *c: F.substring(F.sha2(F.concat_ws("|", *c), 256), 1, 32)
    made = versions.join(target, versions["existing_memory_id"] == target["o_memory_id"])
    made = made.withColumn("step", F.row_number().over(chain)).withColumn("new_id", new_id("existing_memory_id", "decision_id"))
    made = made.withColumn("last", F.lead("decision_id").over(chain).isNull())
    before = F.array_sort(F.collect_list(F.struct("step", "new_id")).over(chain.rowsBetween(Window.unboundedPreceding, -1)))
    parents = F.concat(F.reverse(F.transform(before, lambda x: x["new_id"])), F.array("existing_memory_id"), F.coalesce("o_parent_memory_ids", F.array().cast("array<string>")))
    content = F.when(F.col("action") == "merge", F.coalesce(F.when(F.col("merged_content") != "", F.col("merged_content")), F.col("new_content"))).otherwise(F.col("new_content"))
    versions_made = with_defaults(
        made.withColumn("parent_memory_ids", parents).select(
            F.col("new_id").alias("memory_id"), F.col("o_namespace").alias("namespace"), F.col("o_user_id").alias("user_id"), F.col("o_agent_id").alias("agent_id"), F.col("o_memory_type").alias("memory_type"),
            content.alias("content"), F.col("o_source_type").alias("source_type"), F.col("o_importance_score").alias("importance_score"), (F.col("o_version") + F.col("step")).alias("version"),
            "parent_memory_ids", F.when(F.col("last"), "active").otherwise("superseded").alias("status"), as_of.alias("created_at"), as_of.alias("updated_at"),
        )
    )
    created = with_defaults(
        decisions.filter("action = 'create'").select(
            new_id("user_id", "decision_id").alias("memory_id"), F.concat(F.lit("user:"), F.col("user_id")).alias("namespace"), "user_id", F.col("new_content").alias("content"), as_of.alias("created_at"), as_of.alias("updated_at")
        )
    )
    gone = made.select(F.col("existing_memory_id").alias("memory_id")).distinct().withColumn("_gone", F.lit(True))
    old = with_defaults(memories).join(gone, "memory_id", "left")
    old = old.withColumn("status", F.when(F.col("_gone"), "superseded").otherwise(F.col("status"))).withColumn("updated_at", F.when(F.col("_gone"), as_of).otherwise(F.col("updated_at"))).drop("_gone")
    applied = decisions.withColumn("applied", known & ((F.col("action") == "create") | F.col("existing_memory_id").isNotNull()))
    return old.unionByName(versions_made).unionByName(created), applied


def drop_vectors(vectors: DataFrame, decisions: DataFrame) -> DataFrame:
    """The vectors without those of memories that a decision replaced."""
    gone = decisions.filter(F.col("action").isin("update", "supersede", "merge")).select(F.col("existing_memory_id").alias("memory_id"))
    return vectors.join(gone, "memory_id", "left_anti")
