"""Observations to memories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.functions.scoring import importance
from memspark.schemas import SEMANTIC_TYPES, validate, with_defaults


def memory_layer(memory_type: Column) -> Column:
    return F.when(memory_type.isin(SEMANTIC_TYPES), "semantic").otherwise("episodic")


def from_observations(observations: DataFrame, as_of: Column) -> DataFrame:
    """A canonical memory for each observation; an importance given as null or 0 is computed. Ids follow from the observation, so a rerun gives the same."""
    kind = F.coalesce("memory_type", F.lit("observation"))
    given = F.when(F.col("importance_override") != 0, F.col("importance_override"))
    identity = F.sha2(F.concat_ws("|", "user_id", "content", F.col("observed_at").cast("string"), "observation_id"), 256)
    return with_defaults(
        observations.select(
            F.substring(identity, 1, 32).alias("memory_id"), F.concat(F.lit("user:"), F.col("user_id")).alias("namespace"), "user_id", "agent_id",
            kind.alias("memory_type"), memory_layer(kind).alias("memory_layer"), "content", "source_type", F.col("session_id").alias("source_ref"),
            as_of.alias("created_at"), as_of.alias("updated_at"), F.col("observed_at").alias("event_time"),
            F.coalesce(given, importance(F.col("content"))).alias("importance_score"),
            *([F.col("metadata")] if "metadata" in observations.columns else []),
        )
    )


def ingest(observations: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """Valid memories, and the rejected rows with their reason."""
    return validate(from_observations(observations, as_of))


def ingest_summary(valid: DataFrame, rejected: DataFrame) -> DataFrame:
    """ingested and failed, in one row. The ids are the memory_id column of ``valid``; they grow with the batch, so they are not gathered into the row."""
    both = valid.select(F.lit(1).alias("ok")).union(rejected.select(F.lit(0).alias("ok")))
    return both.agg(F.coalesce(F.sum("ok"), F.lit(0)).alias("ingested"), F.coalesce(F.sum(1 - F.col("ok")), F.lit(0)).alias("failed"))
