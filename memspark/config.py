"""Defaults of the jobs; every function takes them as arguments."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Defaults:
    decay_hours: float = 168.0
    weight_semantic: float = 0.40
    weight_recency: float = 0.25
    weight_importance: float = 0.25
    weight_access: float = 0.10
    penalty: float = 0.40
    penalty_from: float = 0.70
    layer_boost: float = 0.05
    candidates: int = 30
    most_candidates: int = 50
    top_k: int = 5
    diversity: float = 0.92
    fallback_score: float = 0.5
    promote_accesses: int = 3
    promote_importance: float = 0.6
    merge_from: float = 0.90
    contradiction_top: int = 5
    contradiction_from: float = 0.70
    confirm_from: float = 0.70
    update_from: float = 0.80
    reflect_every: int = 10
    reflect_newest: int = 20
    reflect_least: int = 3
    tool_outputs: int = 20


DEFAULTS = Defaults()
