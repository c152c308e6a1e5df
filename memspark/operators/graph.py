"""The memory graph: edges, related entities, version chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memspark.sources import tables


def link(edges: DataFrame, entities: DataFrame, order: str | None = None) -> DataFrame:
    """Edges whose ends both exist, one for each (src, dst, rel); the last props win."""
    ids = entities.select("entity_id")
    both = edges.join(ids.withColumnRenamed("entity_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("entity_id", "dst"), "dst", "left_semi")
    latest = F.row_number().over(Window.partitionBy("src", "dst", "rel").orderBy(F.desc(order) if order else F.desc(F.to_json("props"))))
    return both.withColumn("_k", latest).filter("_k = 1").drop("_k")


def related(seeds: DataFrame, edges: DataFrame, depth: int = 2, relationship: str = "", limit: int = 50) -> DataFrame:
    """seed, node, rel (of the path's first edge), hops: paths of up to ``depth`` edges either way, no edge twice; the first ``limit`` of each seed by hops, node, rel.

    The limit is pushed into each hop: a path goes on over the first ``limit + depth`` neighbours of its end alone. If there
    are more, these fill the seed's places, as a path leaves out ``depth`` of them at most (its own edges, and the seed);
    if not, nothing is left out. A seed whose places are filled goes no further. So a hub with any number of edges
    makes ``limit`` times ``limit + depth`` rows for a seed at most, for each kind of edge between two nodes.
    """
    if relationship:
        edges = edges.filter(F.col("rel") == relationship)
    e = edges.select("src", "dst", "rel", F.concat_ws("|", "src", "dst", "rel").alias("id"))
    ways = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "rel", "id"))
    near = F.dense_rank().over(Window.partitionBy("at").orderBy("to"))
    step = ways.select(F.col("src").alias("at"), F.col("dst").alias("to"), F.col("rel").alias("by"), "id").withColumn("_near", near)
    step = tables.materialise(step.filter(F.col("_near") <= limit + depth).drop("_near"), "steps")
    place = F.row_number().over(Window.partitionBy("seed").orderBy("hops", "node", "rel", F.array_join("used", ",")))
    found, paths = None, None
    for k in range(1, depth + 1):
        if k == 1:
            paths = seeds.select(F.col("entity_id").alias("seed")).join(step, F.col("seed") == F.col("at")).select("seed", F.col("to").alias("node"), F.col("by").alias("rel"), F.array("id").alias("used"), F.lit(1).alias("hops"))
        else:
            full = found.groupBy("seed").count().filter(F.col("count") >= limit).select("seed")
            onward = paths.join(full, "seed", "left_anti").join(step, F.col("node") == F.col("at")).filter(~F.array_contains("used", F.col("id")))
            paths = onward.select("seed", F.col("to").alias("node"), "rel", F.concat("used", F.array("id")).alias("used"), F.lit(k).alias("hops"))
        paths = tables.materialise(paths, "paths") if k < depth else paths
        own = paths.filter("node <> seed")
        found = own if found is None else found.unionByName(own)
    return found.withColumn("place", place).filter(F.col("place") <= limit).select("seed", "node", "rel", "hops", "place")


def version_chain(memories: DataFrame) -> DataFrame:
    """memory_id, ancestor, position: the parents of each memory, nearest first."""
    return memories.select("memory_id", F.posexplode("parent_memory_ids").alias("position", "ancestor")).select("memory_id", "ancestor", (F.col("position") + 1).alias("position"))


def ancestors(memories: DataFrame, depth: int | None = None) -> DataFrame:
    """memory_id, ancestor, hops: all ancestors through parents of parents, each at its fewest hops; with ``depth`` those up to so many hops.

    Each round doubles the hops that are known: what is further away than those is reached by a shortest path over an ancestor
    at exactly so many hops, and its rest is known. So the rounds are the logarithm of the depth, and a chain makes each pair once.
    """
    parents = memories.select("memory_id", F.explode("parent_memory_ids").alias("ancestor")).distinct().withColumn("hops", F.lit(1))
    known = tables.materialise(parents, "parents")
    reach = 1
    while depth is None or reach < depth:
        onward = known.select(F.col("memory_id").alias("middle"), F.col("ancestor").alias("far"), F.col("hops").alias("more"))
        edge = known.filter(F.col("hops") == reach).join(onward, F.col("ancestor") == F.col("middle"))
        new = edge.filter("far <> memory_id").groupBy("memory_id", F.col("far").alias("ancestor")).agg((F.min("more") + reach).alias("hops"))
        new = tables.materialise(new.join(known, ["memory_id", "ancestor"], "left_anti"), "ancestors")
        reach *= 2
        if new.isEmpty():
            break
        known = known.unionByName(new)
    return known if depth is None else known.filter(F.col("hops") <= depth)
