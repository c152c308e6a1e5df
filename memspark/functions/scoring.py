"""Scores of memories as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from memspark.config import DEFAULTS, Defaults

# Signals of an important text, each found as a substring of the lower-case text.
HIGH_SIGNALS = [
    "prefer", "always", "never", "important", "critical", "love", "hate", "goal", "objective", "plan", "deadline",
    "must", "need", "require", "password", "address", "phone", "birthday", "allerg", "medical", "work at", "job",
]
MEDIUM_SIGNALS = ["like", "dislike", "want", "hope", "think", "believe", "usually", "often", "sometimes"]


def recency(as_of: Column, updated_at: Column, created_at: Column, decay_hours: Column | float | None = None) -> Column:
    """exp(-age / decay) of the last change; no decay, or 0, means the default."""
    given = decay_hours if isinstance(decay_hours, Column) else F.lit(decay_hours).cast("double")
    decay = F.when(given.isNull() | (given == 0), F.lit(DEFAULTS.decay_hours)).otherwise(given)
    hours = (F.unix_micros(as_of) - F.unix_micros(F.coalesce(updated_at, created_at))) / F.lit(3.6e9)
    return F.exp(-F.greatest(hours, F.lit(0.0)) / decay)


def importance(content: Column) -> Column:
    """A base, a step for each signal that occurs and for length, 1 at most."""
    low = F.lower(content)
    high = sum((low.contains(s).cast("int") for s in HIGH_SIGNALS[1:]), low.contains(HIGH_SIGNALS[0]).cast("int"))
    medium = sum((low.contains(s).cast("int") for s in MEDIUM_SIGNALS[1:]), low.contains(MEDIUM_SIGNALS[0]).cast("int"))
    long = (F.length(content) > 200).cast("int") + (F.length(content) > 500).cast("int")
    return F.least(F.lit(1.0), F.lit(0.4) + high * F.lit(0.08) + medium * F.lit(0.04) + long * F.lit(0.05))


def access(count: Column) -> Column:
    return F.log1p(count.cast("double")) / F.log1p(F.lit(100.0))


def contradiction_penalty(status: Column, confidence: Column, d: Defaults = DEFAULTS) -> Column:
    hit = (status == "confirmed") & (F.coalesce(confidence, F.lit(1.0)) >= d.penalty_from)
    return F.when(hit, F.lit(d.penalty)).otherwise(F.lit(0.0))


def composite(semantic: Column, recent: Column, important: Column, accessed: Column, penalty: Column, d: Defaults = DEFAULTS) -> Column:
    total = semantic * d.weight_semantic + recent * d.weight_recency + important * d.weight_importance + accessed * d.weight_access - penalty
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))


def retrieval_score(semantic: Column, as_of: Column, d: Defaults = DEFAULTS) -> Column:
    """The whole score of a memory row (its columns by name): composite, then the boost of the semantic layer, 1 at most."""
    score = composite(
        semantic,
        recency(as_of, F.col("updated_at"), F.col("created_at"), d.decay_hours),
        F.col("importance_score"),
        access(F.col("access_count")),
        contradiction_penalty(F.col("contradiction_status"), F.col("contradiction_confidence"), d),
        d,
    )
    boost = F.when(F.col("memory_layer") == "semantic", F.lit(d.layer_boost)).otherwise(F.lit(0.0))
    return F.least(F.lit(1.0), score + boost)
