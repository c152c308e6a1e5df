"""Contradictions between memories of one user: candidates, judgement, application, resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.config import DEFAULTS, Defaults
from memspark.operators.vector_search import top_per_query
from memspark.schemas import CONTRADICTION_TYPES

# Signals of the keyword judge, found as substrings, and words that don't count as shared.
NEGATIONS = ["never", "hates", "allergic", "deathly", "strict", "only", "exclusively", "refuses", "single", "not currently", "always", "every day"]
POSITIVES = ["moved to", "joined", "recently", "now", "bought", "ate", "drinks", "ordered", "commutes", "set up", "returned from", "completed", "wife", "husband"]
MOVES = ["lives", "moved", "works", "joined"]
FILLERS = ["the", "a", "an", "is", "in", "and", "to", "for", "of", "at", "on", "user"]


def candidates(focus: DataFrame, memories: DataFrame, vectors: DataFrame, d: Defaults = DEFAULTS) -> DataFrame:
    """a, b, score: each focus memory with its nearest active ones; it takes a place itself, which goes. a is the earlier memory."""
    asked = focus.select(F.col("memory_id").alias("query_id"), "user_id").join(vectors.withColumnRenamed("memory_id", "query_id"), "query_id")
    held = memories.filter("status = 'active'").select("memory_id", "user_id").join(vectors, "memory_id")
    near = top_per_query(asked, held, d.contradiction_top).filter((F.col("query_id") != F.col("memory_id")) & (F.col("score") >= d.contradiction_from))
    born = {x: memories.select(F.col("memory_id").alias(x), F.struct("created_at", "memory_id").alias(f"born_{x}")) for x in ("query_id", "memory_id")}
    both = near.join(born["query_id"], "query_id").join(born["memory_id"], "memory_id")
    ends = F.array_sort(F.array("born_query_id", "born_memory_id"))
    return both.groupBy(ends[0]["memory_id"].alias("a"), ends[1]["memory_id"].alias("b")).agg(F.max("score").alias("score"))


def _any(text: Column, signals: list[str]) -> Column:
    out = text.contains(signals[0])
    for s in signals[1:]:
        out = out | text.contains(s)
    return out


def judge(pairs: DataFrame, a: str = "content_a", b: str = "content_b") -> DataFrame:
    """``pairs`` with overlap, contradicts and confidence by keyword rules; a null text has no signals."""
    x, y = (F.lower(F.coalesce(c, F.lit(""))) for c in (a, b))
    words = lambda t: F.array_except(F.array_distinct(F.filter(F.split(t, r"\s+"), lambda w: w != "")), F.array(*map(F.lit, FILLERS)))
    overlap = F.size(F.array_intersect(words(x), words(y)))
    opposed = (_any(x, NEGATIONS) & _any(y, POSITIVES)) | (_any(y, NEGATIONS) & _any(x, POSITIVES))
    moved = _any(x, MOVES) & _any(y, MOVES) & (F.col("overlap") >= 1)
    bucket = F.conv(F.substring(F.md5(F.concat(x, y).cast("binary")), 1, 8), 16, 10).cast("long") % 100
    close = (F.col("overlap") >= 3) & (bucket < 30)
    out = pairs.withColumn("overlap", overlap).withColumn("contradicts", opposed | moved | close)
    return out.withColumn("confidence", F.when(moved, 0.80).when(opposed & (F.col("overlap") >= 1), 0.85).when(opposed, 0.65).when(close, 0.55).otherwise(0.5))


def known_type(kind: Column) -> Column:
    return F.when(kind.isin(CONTRADICTION_TYPES), kind).otherwise("direct_conflict")


def reports(judged: DataFrame, as_of: Column) -> DataFrame:
    """A contradiction row for each pair (a, b) that contradicts."""
    kind = F.col("contradiction_type") if "contradiction_type" in judged.columns else F.lit("none")
    return judged.filter("contradicts").select(
        F.substring(F.sha2(F.concat_ws("|", "a", "b"), 256), 1, 32).alias("report_id"), F.col("a").alias("memory_a_id"), F.col("b").alias("memory_b_id"), kind.alias("contradiction_type"),
        "confidence", as_of.alias("detected_at"), F.lit(False).alias("resolved"), F.lit("").alias("resolution_note"), F.lit(None).cast("timestamp").alias("resolved_at"),
    )


def apply_reports(memories: DataFrame, found: DataFrame, d: Defaults = DEFAULTS) -> DataFrame:
    """Both memories of a sure report become confirmed and point at each other, those of another suspected.

    Several reports on a memory: one sure one confirms, and the highest confidence stays. A sure temporal update supersedes the earlier memory.
    """
    born = {x: memories.select(F.col("memory_id").alias(f"memory_{x}_id"), F.col("created_at").alias(f"born_{x}")) for x in "ab"}
    sure = F.col("confidence") >= d.confirm_from
    rows = found.join(born["a"], "memory_a_id").join(born["b"], "memory_b_id").withColumn("a_first", F.col("born_a") <= F.col("born_b"))
    older = sure & (F.col("contradiction_type") == "temporal_update")
    side = lambda own, other, first: F.struct(F.col(own).alias("memory_id"), F.when(sure, F.col(other)).alias("other"), F.col("confidence"), sure.alias("sure"), (older & first).alias("older"))
    each = rows.select(F.explode(F.array(side("memory_a_id", "memory_b_id", F.col("a_first")), side("memory_b_id", "memory_a_id", ~F.col("a_first")))).alias("x")).select("x.*")
    change = each.groupBy("memory_id").agg(F.max("sure").alias("_sure"), F.max(F.when(F.col("sure"), F.col("confidence"))).alias("_confidence"), F.collect_set("other").alias("_others"), F.max("older").alias("_older"))
    own = [c for c in memories.columns if c not in ("contradicted_by",)]
    had = F.col("contradicted_by") if "contradicted_by" in memories.columns else F.array().cast("array<string>")
    out = memories.join(change, "memory_id", "left")
    out = out.withColumn("contradicted_by", F.array_sort(F.array_union(F.coalesce(had, F.array().cast("array<string>")), F.coalesce("_others", F.array().cast("array<string>")))))
    out = out.withColumn("contradiction_status", F.when(F.col("_sure"), "confirmed").when(F.col("_sure").isNotNull(), "suspected").otherwise(F.col("contradiction_status")))
    out = out.withColumn("contradiction_confidence", F.coalesce("_confidence", "contradiction_confidence")).withColumn("status", F.when(F.col("_older"), "superseded").otherwise(F.col("status")))
    return out.select(*own, "contradicted_by")


def resolve(found: DataFrame, memories: DataFrame, resolutions: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """``resolutions`` (report_id, winning_memory_id, note) close reports and supersede the memory that lost. New reports and memories."""
    given = resolutions.select("report_id", "winning_memory_id", F.col("note").alias("_note")).dropDuplicates(["report_id"])
    both = found.join(given, "report_id", "left")
    hit = F.col("winning_memory_id").isNotNull()
    loser = F.when(F.col("winning_memory_id") == F.col("memory_a_id"), F.col("memory_b_id")).when(F.col("winning_memory_id") == F.col("memory_b_id"), F.col("memory_a_id"))
    losers = both.filter(hit).select(loser.alias("memory_id")).filter("memory_id IS NOT NULL").distinct().withColumn("_lost", F.lit(True))
    closed = both.withColumn("resolved", hit | F.col("resolved")).withColumn("resolution_note", F.when(hit, F.col("_note")).otherwise(F.col("resolution_note"))).withColumn("resolved_at", F.when(hit, as_of).otherwise(F.col("resolved_at"))).select(*found.columns)
    return closed, supersede(memories, losers)


def supersede(memories: DataFrame, losers: DataFrame) -> DataFrame:
    hit = losers.select("memory_id").distinct().withColumn("_lost", F.lit(True))
    out = memories.join(hit, "memory_id", "left")
    return out.withColumn("status", F.when(F.col("_lost"), "superseded").otherwise(F.col("status"))).select(*memories.columns)


def contradiction_edges(found: DataFrame) -> DataFrame:
    """One undirected edge for each pair."""
    return found.select(F.least("memory_a_id", "memory_b_id").alias("src"), F.greatest("memory_a_id", "memory_b_id").alias("dst"), F.lit("CONTRADICTS").alias("rel")).dropDuplicates()
