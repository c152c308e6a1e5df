"""Hybrid retrieval for many queries at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspark.config import DEFAULTS, Defaults
from memspark.functions.scoring import retrieval_score
from memspark.operators.vector_search import top_per_query
from memspark.schemas import MEMORY_TYPES


def _optional(queries: DataFrame, name: str, kind: str) -> Column:
    return F.col(name).cast(kind) if name in queries.columns else F.lit(None).cast(kind)


def known_types(types: Column) -> Column:
    """Memory types of a request that exist; the others are dropped, and none left means no filter."""
    return F.array_intersect(types, F.array(*map(F.lit, MEMORY_TYPES)))


def _asked(queries: DataFrame, d: Defaults) -> DataFrame:
    """Queries with all their conditions, under names of their own."""
    return queries.select(
        "query_id", "user_id", F.coalesce(_optional(queries, "top_k", "int"), F.lit(d.top_k)).alias("top_k"), F.coalesce(_optional(queries, "namespace", "string"), F.lit("")).alias("q_namespace"),
        F.coalesce(_optional(queries, "min_importance", "double"), F.lit(0.0)).alias("min_importance"),
        known_types(F.coalesce(_optional(queries, "memory_types", "array<string>"), F.array().cast("array<string>"))).alias("types"),
        F.coalesce(_optional(queries, "memory_layers", "array<string>"), F.array().cast("array<string>")).alias("layers"),
        _optional(queries, "time_range_start", "timestamp").alias("from_time"), _optional(queries, "time_range_end", "timestamp").alias("to_time"),
        F.coalesce(_optional(queries, "include_archived", "boolean"), F.lit(False)).alias("include_archived"),
    )


def semantic_candidates(queries: DataFrame, memories: DataFrame, vectors: DataFrame, d: Defaults = DEFAULTS) -> DataFrame:
    """query_id, memory_id, score: the nearest memories of the query's user, max(candidates, 4 * top_k) of them and 50 at most."""
    asked = _asked(queries, d)
    held = memories.select("memory_id", "user_id", (F.coalesce("status", F.lit("")) != "active").alias("hidden")).join(vectors, "memory_id")
    own = queries.select("query_id", "user_id", "embedding").join(asked.select("query_id", F.col("include_archived").alias("all"), "top_k"), "query_id")
    limit = F.least(F.lit(d.most_candidates), F.greatest(F.lit(d.candidates), 4 * F.col("top_k")))
    near = top_per_query(own, held, d.most_candidates)
    return near.join(own.select("query_id", limit.alias("n")), "query_id").filter("place <= n").select("query_id", "memory_id", "score")


def scored(queries: DataFrame, memories: DataFrame, vectors: DataFrame, as_of: Column, d: Defaults = DEFAULTS) -> DataFrame:
    """Candidates with the memory's columns, semantic_score and composite_score (6 decimals).

    Queries without any candidate fall back to the newest 2 * top_k active memories of the user and namespace.
    Both lists are short and stand in one row for each query.
    """
    asked = _asked(queries, d)
    listed = lambda score: F.collect_list(F.struct("memory_id", score.alias("semantic_score")))
    hits = semantic_candidates(queries, memories, vectors, d).groupBy("query_id").agg(listed(F.col("score")).alias("hits"))
    both = asked.join(hits, "query_id", "left").select("query_id", "user_id", "q_namespace", "top_k", "hits")
    left = both.filter("hits IS NULL").select("query_id", F.col("user_id").alias("_user"), "q_namespace", "top_k")
    newest = left.join(memories.filter("status = 'active'"), (F.col("_user") == memories["user_id"]) & ((F.col("q_namespace") == "") | (F.col("q_namespace") == memories["namespace"])))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("created_at"), "memory_id"))
    fallback = newest.withColumn("_place", place).filter(F.col("_place") <= 2 * F.col("top_k")).groupBy("query_id").agg(listed(F.lit(d.fallback_score)).alias("newest"))
    chosen = both.join(fallback, "query_id", "left").select("query_id", F.explode(F.coalesce("hits", "newest")).alias("x")).select("query_id", "x.*")
    # A score outside 0..1 is no valid candidate; the top-N cut came first.
    found = chosen.filter("semantic_score BETWEEN 0 AND 1").join(memories, "memory_id")
    return found.withColumn("composite_score", F.round(retrieval_score(F.col("semantic_score"), as_of, d), 6))


def symbolic_filters(candidates: DataFrame, queries: DataFrame, d: Defaults = DEFAULTS) -> DataFrame:
    """Candidates that meet their query's conditions, with total_found; a null event_time passes any time range, the namespace is a prefix."""
    c = candidates.join(_asked(queries, d).drop("user_id"), "query_id")
    fits = (
        (F.col("importance_score") >= F.col("min_importance"))
        & ((F.size("types") == 0) | F.array_contains("types", F.col("memory_type")))
        & ((F.size("layers") == 0) | F.array_contains("layers", F.col("memory_layer")))
        & (F.col("event_time").isNull() | F.col("from_time").isNull() | (F.col("event_time") >= F.col("from_time")))
        & (F.col("event_time").isNull() | F.col("to_time").isNull() | (F.col("event_time") <= F.col("to_time")))
        & ((F.col("q_namespace") == "") | (F.coalesce("namespace", F.lit("")) == "") | F.col("namespace").startswith(F.col("q_namespace")))
    )
    kept = c.filter(fits).drop("q_namespace", "min_importance", "types", "layers", "from_time", "to_time", "include_archived")
    return kept.withColumn("total_found", F.count("*").over(Window.partitionBy("query_id")))


def rerank(candidates: DataFrame, threshold: float = DEFAULTS.diversity) -> DataFrame:
    """query_id, memory_id, rank (from 1): candidates in order of score, without those whose words are too close to one that stays; top_k of them.

    A query has 50 candidates at most, so its fold is small.
    """
    words = F.array_distinct(F.filter(F.split(F.lower("content"), r"\s+"), lambda w: w != ""))
    item = F.struct((-F.col("composite_score")).alias("a"), (-F.col("semantic_score")).alias("b"), F.col("memory_id").alias("id"), words.alias("w"))
    lists = candidates.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("items"), F.max("top_k").alias("top_k"))

    def alike(x: Column, y: Column) -> Column:
        shared = F.size(F.array_intersect(x["w"], y["w"]))
        return (F.size(x["w"]) > 0) & (F.size(y["w"]) > 0) & (shared / (F.size(x["w"]) + F.size(y["w"]) - shared) > threshold)

    none = F.filter("items", lambda x: F.lit(False))
    kept = F.aggregate("items", none, lambda kept, x: F.when(F.exists(kept, lambda k: alike(k, x)), kept).otherwise(F.concat(kept, F.array(x))))
    return lists.select("query_id", "top_k", F.posexplode(kept).alias("p", "x")).filter("p < top_k").select("query_id", F.col("x.id").alias("memory_id"), (F.col("p") + 1).alias("rank"))


def retrieve(
    queries: DataFrame, memories: DataFrame, vectors: DataFrame, as_of: Column, d: Defaults = DEFAULTS, reranker: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """The whole retrieval: a row for each query and rank, with scores, total_found and the memory's columns.

    ``reranker`` takes the candidates (query_id, memory_id, scores, top_k, the memory's columns) and returns query_id, memory_id, rank; rerank() if none is given.
    """
    found = symbolic_filters(scored(queries, memories, vectors, as_of, d), queries, d)
    ranked = reranker(found) if reranker else rerank(found, d.diversity)
    return found.join(ranked.select("query_id", "memory_id", "rank"), ["query_id", "memory_id"]).drop("top_k")


def access_feedback(memories: DataFrame, results: DataFrame, as_of: Column) -> DataFrame:
    """Memories with access_count raised by the times they were returned, and updated_at set."""
    hits = results.groupBy("memory_id").agg(F.count("*").alias("_hits"))
    joined = memories.join(hits, "memory_id", "left")
    return joined.withColumn("access_count", F.col("access_count") + F.coalesce("_hits", F.lit(0))).withColumn("updated_at", F.when(F.col("_hits").isNotNull(), as_of).otherwise(F.col("updated_at"))).drop("_hits").select(*memories.columns)


def context_window(results: DataFrame) -> DataFrame:
    """query_id and context: a heading and a line for each result, by rank; api_context: the short form."""
    line = F.format_string("%d. [%s] %s (importance=%.2f, score=%.2f)", "rank", "memory_type", "content", "importance_score", "composite_score")
    short = F.format_string("[%d] %s", "rank", "content")
    rows = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"), short.alias("short"))))
    lists = results.groupBy("query_id").agg(rows.alias("r"))
    join = lambda field: F.array_join(F.transform("r", lambda x: x[field]), "\n")
    return lists.select("query_id", F.concat(F.lit("# Relevant Memories\n\n"), join("line")).alias("context"), join("short").alias("api_context"))
