"""Working memory of sessions: turns in order, and the last tool outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memspark.config import DEFAULTS, Defaults


def working_memory(events: DataFrame, d: Defaults = DEFAULTS) -> DataFrame:
    """session_id, turns (role, content) and tool_outputs (tool, output), both in order of seq; of tool outputs the last ones."""
    late = F.row_number().over(Window.partitionBy("session_id", "kind").orderBy(F.desc("seq")))
    kept = events.withColumn("_late", late).filter((F.col("kind") == "turn") | (F.col("_late") <= d.tool_outputs))
    of = lambda kind, a, b: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("seq", "role_or_tool", "content")))), lambda x: F.struct(x["role_or_tool"].alias(a), x["content"].alias(b)))
    return kept.groupBy("session_id").agg(of("turn", "role", "content").alias("turns"), of("tool", "tool", "output").alias("tool_outputs"))
