"""Connected components of links that Spark holds, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.llm.common import cut


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours (the larger ones if ``large``, else the smaller ones and itself) are tied to the least of its neighbours and itself."""
    both = links.union(links.select("v", "u")) if large else links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
    tied = both.join(least, "u")
    if large:
        tied = tied.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        tied = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return cut(tied.filter("u <> v").distinct(), "star")


def components(links: DataFrame) -> DataFrame:
    """node and label (the least node that can be reached) of each node of ``links`` (u, v) that is not its own label.

    The rounds grow with the logarithm of the number of nodes; only two sums reach the driver.
    """
    before = None
    while True:
        links = _star(_star(links, True), False)
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return links.select(F.col("u").alias("node"), F.col("v").alias("label"))
        before = now
