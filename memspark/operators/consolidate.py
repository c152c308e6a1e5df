"""Promotion of episodic memories and merging of near duplicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspark.config import DEFAULTS, Defaults
from memspark.operators.vector_search import pairs_over
from memspark.sources import tables


def promotable(d: Defaults = DEFAULTS) -> Column:
    return (F.col("status") == "active") & (F.col("memory_layer") == "episodic") & (F.col("access_count") >= d.promote_accesses) & (F.col("importance_score") >= d.promote_importance)


def promote(memories: DataFrame, as_of: Column, d: Defaults = DEFAULTS) -> DataFrame:
    """Often used, important episodic memories become semantic; ``promoted`` says which, and metadata is stamped if there."""
    out = memories.withColumn("promoted", F.coalesce(promotable(d), F.lit(False)))
    out = out.withColumn("memory_layer", F.when(F.col("promoted"), "semantic").otherwise(F.col("memory_layer"))).withColumn("updated_at", F.when(F.col("promoted"), as_of).otherwise(F.col("updated_at")))
    if "metadata" in memories.columns:
        held = F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin("promoted_from_episodic", "promoted_at"))
        stamp = F.create_map(F.lit("promoted_from_episodic"), F.lit("true"), F.lit("promoted_at"), as_of.cast("string"))
        out = out.withColumn("metadata", F.when(F.col("promoted"), F.map_concat(held, stamp)).otherwise(F.col("metadata")))
    return out


def near_duplicate_pairs(memories: DataFrame, vectors: DataFrame, d: Defaults = DEFAULTS) -> DataFrame:
    """user_id, a, b, score of active semantic memories of one user that are near duplicates."""
    own = memories.filter("status = 'active' AND memory_layer = 'semantic'").select("memory_id", "user_id").join(vectors, "memory_id")
    return pairs_over(tables.materialise(own, "own"), d.merge_from)


def near_duplicate_classes(memories: DataFrame, vectors: DataFrame, d: Defaults = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """The same pairs without those of copies: pairs (user_id, a, b, score) of the representatives of equal vectors, and copies.

    copies: user_id, memory_id, rep (the smallest memory_id with this user and vector), alike (there are several, near each other).
    """
    own = memories.filter("status = 'active' AND memory_layer = 'semantic'").select("memory_id", "user_id").join(vectors, "memory_id")
    own = tables.materialise(own.select("memory_id", "user_id", "embedding").filter("size(embedding) > 0 AND user_id IS NOT NULL"), "own")
    near = F.when(F.exists("embedding", lambda x: x != 0), 1.0).otherwise(0.0) >= d.merge_from
    held = own.groupBy("user_id", "embedding").agg(F.min("memory_id").alias("rep"), (F.count("*") > 1).alias("several"))
    held = tables.materialise(held.withColumn("alike", F.col("several") & near).drop("several"), "classes")
    copies = own.join(held, ["user_id", "embedding"]).select("user_id", "memory_id", "rep", "alike")
    return pairs_over(held.select(F.col("rep").alias("memory_id"), "user_id", "embedding"), d.merge_from), copies


def _turns(records: DataFrame, near: DataFrame) -> DataFrame:
    """The ``records`` that take a turn in the walk: those that no earlier one near them with a turn and no less importance has beaten.

    Each round decides the records that none of those still waiting could beat; what they beat has no turn. The rounds are the
    longest chain of records that wait for each other, few where importance and order do not run together.
    """
    ends = records.select(F.col("memory_id").alias("u"), F.col("rep").alias("rep_u"), F.col("place").alias("place_u"), F.col("imp").alias("imp_u"))
    met = records.select(F.col("memory_id").alias("v"), F.col("rep").alias("rep_v"), "place", "imp")
    edges = ends.join(near, F.col("rep_u") == F.col("rep")).join(met, F.col("other") == F.col("rep_v")).filter("place_u < place AND imp_u >= imp").select("u", "v")
    waiting, edges, turns = tables.materialise(records.select("memory_id"), "waiting"), tables.materialise(edges, "beats"), []
    while not edges.isEmpty():
        now = tables.materialise(waiting.join(edges.select(F.col("v").alias("memory_id")).distinct(), "memory_id", "left_anti"), "turns")
        beaten = edges.join(now.withColumnRenamed("memory_id", "u"), "u", "left_semi").select(F.col("v").alias("memory_id"))
        waiting = tables.materialise(waiting.join(now.unionByName(beaten).distinct(), "memory_id", "left_anti"), "waiting")
        edges = tables.materialise(edges.join(waiting.withColumnRenamed("memory_id", "u"), "u", "left_semi").join(waiting.withColumnRenamed("memory_id", "v"), "v", "left_semi"), "beats")
        turns.append(now)
    return reduce(DataFrame.unionByName, turns, waiting)


def merges(memories: DataFrame, pairs: DataFrame, copies: DataFrame | None = None) -> DataFrame:
    """user_id, winner, loser, step (turn, met; in order of the walk): what the greedy merge does.

    The walk, in listing order: each memory that has not lost meets the later ones near it that have not; the more important stays,
    the earlier on a tie, and one that loses while it is its turn still meets the later ones. So a memory has a turn unless an
    earlier one near it has a turn and no less importance: turns are decided in rounds, for all users and groups at once, and
    everything else follows from them. Of equal vectors only those more important than all earlier ones can have a turn.

    ``pairs`` may be of representatives, with ``copies`` as of near_duplicate_classes; else each memory stands for itself.
    """
    links = tables.materialise(pairs.select("user_id", "a", "b"), "near")
    if copies is None:
        copies = links.select("user_id", F.explode(F.array("a", "b")).alias("memory_id")).distinct().select("user_id", "memory_id", F.col("memory_id").alias("rep"), F.lit(False).alias("alike"))
    near = links.select(F.col("a").alias("rep"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("rep"), F.col("a").alias("other")))
    near = tables.materialise(near.unionByName(copies.filter("alike").select("rep", F.col("rep").alias("other"))).distinct(), "near-classes")
    order = F.format_string("%020d|%s", -F.unix_micros("created_at") + F.lit(9 * 10**18), F.col("memory_id"))
    rank = memories.select("memory_id", order.alias("place"), F.coalesce("importance_score", F.lit(-1.0)).alias("imp"))
    members = copies.join(near.select("rep").distinct(), "rep", "left_semi").select("user_id", "memory_id", "rep").join(rank, "memory_id")
    members = tables.materialise(members, "members")

    firsts = members.groupBy("rep", "imp").agg(F.min(F.struct("place", "memory_id")).alias("first")).select("rep", "imp", "first.*")
    higher = F.min("place").over(Window.partitionBy("rep").orderBy(F.desc("imp")).rowsBetween(Window.unboundedPreceding, -1))
    records = tables.materialise(firsts.withColumn("higher", higher).filter("higher IS NULL OR place < higher").drop("higher"), "records")
    turns = records.join(_turns(records, near), "memory_id", "left_semi").select(F.col("rep").alias("other"), F.col("memory_id").alias("u"), F.col("place").alias("turn"), F.col("imp").alias("imp_u"))
    turns = tables.materialise(near.join(turns, "other").select("rep", "u", "turn", "imp_u"), "turns-near")

    # The first turn that beats members of a class with this importance, if they come later.
    beats = firsts.select("rep", "imp").join(turns, "rep").filter("imp_u >= imp").groupBy("rep", "imp").agg(F.min("turn").alias("beaten"))
    met = members.join(beats, ["rep", "imp"], "left").join(turns, "rep").filter("turn < place AND (beaten IS NULL OR turn <= beaten)")
    wins = F.coalesce(F.col("turn") == F.col("beaten"), F.lit(False))
    winner, loser = F.when(wins, F.col("u")).otherwise(F.col("memory_id")), F.when(wins, F.col("memory_id")).otherwise(F.col("u"))
    return met.select("user_id", winner.alias("winner"), loser.alias("loser"), F.struct("turn", F.col("place").alias("met")).alias("step"))


def gains(memories: DataFrame, done: DataFrame) -> DataFrame:
    """memory_id, gained: the accesses that winners take over. One that lost before it won passes on what it has gained since.

    Losers that never win pass on their own accesses at once; each round then settles the steps whose loser has no unsettled win before.
    """
    steps = done.join(memories.select(F.col("memory_id").alias("loser"), F.col("access_count").alias("n")), "loser").select("winner", "loser", "step", "n")
    winners = done.select(F.col("winner").alias("loser")).distinct()
    settled = [tables.materialise(steps.join(winners, "loser", "left_anti").select("winner", "step", F.col("n").alias("amount")), "settled")]
    left = tables.materialise(steps.join(winners, "loser", "left_semi"), "left")
    while not left.isEmpty():
        open_ = left.groupBy(F.col("winner").alias("loser")).agg(F.min("step").alias("open"))
        ready = tables.materialise(left.join(open_, "loser", "left").filter("open IS NULL OR open >= step").drop("open"), "ready")
        won = reduce(DataFrame.unionByName, settled).join(ready.select(F.col("loser").alias("winner")).distinct(), "winner", "left_semi")
        rows = won.select(F.col("winner").alias("x"), "step", "amount", F.lit(None).cast("string").alias("winner")).unionByName(ready.select(F.col("loser").alias("x"), "step", F.lit(0).cast("long").alias("amount"), "winner", "n"), allowMissingColumns=True)
        before = F.sum("amount").over(Window.partitionBy("x").orderBy("step").rowsBetween(Window.unboundedPreceding, -1))
        rows = rows.withColumn("held", F.coalesce(before, F.lit(0))).filter("winner IS NOT NULL")
        settled.append(tables.materialise(rows.select("winner", "step", (F.col("n") + F.col("held")).alias("amount")), "settled"))
        left = tables.materialise(left.join(ready.select("winner", "step"), ["winner", "step"], "left_anti"), "left")
    return reduce(DataFrame.unionByName, settled).groupBy(F.col("winner").alias("memory_id")).agg(F.sum("amount").alias("gained"))


def apply_merges(memories: DataFrame, done: DataFrame) -> DataFrame:
    """Losers become superseded by their winner (merged_into); winners gain the losers' accesses and merged_ids, in order. One that lost several times names its last winner."""
    won = done.groupBy(F.col("winner").alias("memory_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "loser"))), lambda x: x["loser"]).alias("merged_ids"))
    into = done.groupBy(F.col("loser").alias("memory_id")).agg(F.max_by("winner", "step").alias("merged_into"))
    out = memories.join(gains(memories, done), "memory_id", "left").join(won, "memory_id", "left").join(into, "memory_id", "left")
    out = out.withColumn("access_count", F.col("access_count") + F.coalesce("gained", F.lit(0))).withColumn("status", F.when(F.col("merged_into").isNotNull(), "superseded").otherwise(F.col("status")))
    if "parent_memory_ids" in memories.columns:
        out = out.withColumn("parent_memory_ids", F.concat("parent_memory_ids", F.coalesce("merged_ids", F.array().cast("array<string>"))))
    return out.drop("gained")


def consolidate(memories: DataFrame, vectors: DataFrame, as_of: Column, d: Defaults = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """The cycle: promote, then merge. The new memories, and promoted and merged counts for each user."""
    promoted = promote(memories, as_of, d)
    done = tables.materialise(merges(promoted, *near_duplicate_classes(promoted, vectors, d)), "merges")
    merged = done.groupBy("user_id").agg(F.count("*").alias("merged"))
    counts = promoted.groupBy("user_id").agg(F.sum(F.col("promoted").cast("long")).alias("promoted")).join(merged, "user_id", "left").fillna(0, ["merged"])
    return apply_merges(promoted, done), counts
