"""Schemas of the canonical tables, and the row checks of ingest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, MapType, StringType, StructField, StructType, TimestampType

# Members of the enumerations.
MEMORY_TYPES = ["observation", "fact", "episode", "procedure", "reflection", "working", "summary"]
SEMANTIC_TYPES = ["fact", "procedure", "reflection", "summary"]
STATUSES = ["active", "superseded", "archived", "deleted", "pending"]
SOURCE_TYPES = ["user_message", "agent_observation", "tool_output", "reflection", "ingestion", "system"]
CONTRADICTION_STATES = ["none", "suspected", "confirmed", "resolved"]
LAYERS = ["episodic", "semantic"]
CONTRADICTION_TYPES = ["direct_conflict", "preference_change", "temporal_update", "none"]

_TYPES = {
    "STRING": StringType(), "TIMESTAMP": TimestampType(), "DOUBLE": DoubleType(), "BIGINT": LongType(), "INT": IntegerType(),
    "ARRAY<STRING>": ArrayType(StringType()), "MAP<STRING,STRING>": MapType(StringType(), StringType()),
}


def _schema(ddl: str) -> StructType:
    """Of "name TYPE, ..."; Spark's own parser needs a session, which an import has not."""
    return StructType([StructField(name, _TYPES[kind]) for name, kind in (field.split() for field in ddl.split(", "))])


MEMORIES = _schema(
    "memory_id STRING, namespace STRING, user_id STRING, agent_id STRING, memory_type STRING, memory_layer STRING, "
    "content STRING, source_type STRING, source_ref STRING, created_at TIMESTAMP, updated_at TIMESTAMP, "
    "event_time TIMESTAMP, valid_from TIMESTAMP, valid_to TIMESTAMP, importance_score DOUBLE, recency_score DOUBLE, "
    "confidence_score DOUBLE, access_count BIGINT, retrieval_count BIGINT, successful_retrieval_count BIGINT, "
    "version INT, parent_memory_ids ARRAY<STRING>, status STRING, contradiction_status STRING, "
    "contradicted_by ARRAY<STRING>, contradiction_confidence DOUBLE, metadata MAP<STRING,STRING>, tags ARRAY<STRING>"
)
OBSERVATIONS = _schema(
    "observation_id STRING, session_id STRING, user_id STRING, agent_id STRING, content STRING, source_type STRING, "
    "observed_at TIMESTAMP, metadata MAP<STRING,STRING>, memory_type STRING, importance_override DOUBLE"
)


def with_defaults(memories: DataFrame) -> DataFrame:
    """All canonical columns; those that are missing or null get their defaults."""
    given = set(memories.columns)
    empty = {"agent_id": "''", "source_ref": "''", "source_type": "'user_message'", "importance_score": "0.5D", "recency_score": "1.0D", "confidence_score": "0.8D",
             "access_count": "0L", "retrieval_count": "0L", "successful_retrieval_count": "0L", "version": "1", "parent_memory_ids": "cast(array() as array<string>)",
             "status": "'active'", "contradiction_status": "'none'", "contradicted_by": "cast(array() as array<string>)",
             "metadata": "cast(map() as map<string,string>)", "tags": "cast(array() as array<string>)", "memory_type": "'observation'", "memory_layer": "'episodic'"}
    out = []
    for field in MEMORIES:
        value = F.col(field.name).cast(field.dataType) if field.name in given else F.lit(None).cast(field.dataType)
        if field.name in empty:
            value = F.coalesce(value, F.expr(empty[field.name]).cast(field.dataType))
        out.append(value.alias(field.name))
    return memories.select(*out)


def reject_reason(has: set[str]) -> Column:
    """Why a row is not a valid memory; null for a valid one. ``has``: the columns that are there."""
    reason = F.when(F.coalesce(F.length("content"), F.lit(0)) == 0, "empty content")
    reason = reason.when(F.coalesce(F.length(F.trim("namespace")), F.lit(0)) == 0, "blank namespace")
    for score in ("importance_score", "recency_score", "confidence_score"):
        if score in has:
            reason = reason.when((F.col(score) < 0) | (F.col(score) > 1) | F.isnan(score), f"{score} out of range")
    for counter in ("access_count", "retrieval_count", "successful_retrieval_count"):
        if counter in has:
            reason = reason.when(F.col(counter) < 0, f"{counter} negative")
    if "version" in has:
        reason = reason.when(F.col("version") < 1, "version below 1")
    for name, members in (("memory_type", MEMORY_TYPES), ("status", STATUSES), ("memory_layer", LAYERS), ("contradiction_status", CONTRADICTION_STATES)):
        if name in has:
            reason = reason.when(~F.col(name).isin(members), f"unknown {name}")
    return reason.otherwise(None)


def validate(memories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows (namespace trimmed), and the rejected ones with their reason."""
    judged = memories.withColumn("reject_reason", reject_reason(set(memories.columns)))
    valid = judged.filter("reject_reason IS NULL").drop("reject_reason").withColumn("namespace", F.trim("namespace"))
    return valid, judged.filter("reject_reason IS NOT NULL")
