"""Quality of retrieval, contradiction detection and updates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KS = (1, 3, 5)


def first_of_text(queries: DataFrame, order: str) -> DataFrame:
    """The first query of each text."""
    k = F.row_number().over(Window.partitionBy("query_text").orderBy(order))
    return queries.withColumn("_k", k).filter("_k = 1").drop("_k")


def _discounts(start: Column, end: Column) -> Column:
    places = F.when(end >= start, F.sequence(start, end)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, F.lit(0.0), lambda a, i: a + math.log(2) / F.ln(i + F.lit(1.0)))


def per_query(queries: DataFrame, results: DataFrame, relevance: DataFrame) -> DataFrame:
    """For each of ``queries``: precision and recall at 1, 3, 5, reciprocal rank and nDCG at 5 of ``results`` (query_id, memory_id, rank).

    nDCG's ideal holds the relevant of what was returned, and missed ones only in places that were left empty.
    """
    hits = results.join(relevance.select("query_id", "memory_id").distinct().withColumn("_rel", F.lit(1)), ["query_id", "memory_id"], "left").fillna(0, ["_rel"])
    top = (F.col("rank") <= 5).cast("int")
    aggs = [F.sum(F.when(F.col("rank") <= k, F.col("_rel")).otherwise(0)).alias(f"h{k}") for k in KS]
    got = hits.groupBy("query_id").agg(*aggs, F.min(F.when(F.col("_rel") == 1, F.col("rank"))).alias("first"), F.sum(top).cast("int").alias("returned"), F.sum(F.col("_rel") * top / F.log2(F.col("rank") + 1)).alias("dcg"))
    wanted = relevance.select("query_id", "memory_id").distinct().groupBy("query_id").agg(F.count("*").alias("relevant"))
    rows = queries.select("query_id").join(got, "query_id", "left").join(wanted, "query_id", "left").fillna(0, ["h1", "h3", "h5", "returned", "relevant", "dcg"])
    ideal = _discounts(F.lit(1), F.col("h5").cast("int")) + _discounts(F.col("returned") + 1, F.least(F.lit(5), F.col("relevant").cast("int")))
    share = lambda x, n: F.when(n > 0, x / n).otherwise(F.lit(0.0))
    return rows.select(
        "query_id", *((F.col(f"h{k}") / k).alias(f"p{k}") for k in KS), *(share(F.col(f"h{k}"), F.col("relevant")).alias(f"r{k}") for k in KS),
        F.when(F.col("first").isNotNull(), 1 / F.col("first")).otherwise(F.lit(0.0)).alias("rr"), share(F.col("dcg"), ideal).alias("ndcg5"),
    )


def summary(rows: DataFrame) -> DataFrame:
    """Means over queries, and F1 of the mean precision and recall."""
    means = rows.agg(*(F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in rows.columns if c != "query_id"))
    f1 = lambda k: F.when(F.col(f"p{k}") + F.col(f"r{k}") > 0, 2 * F.col(f"p{k}") * F.col(f"r{k}") / (F.col(f"p{k}") + F.col(f"r{k}"))).otherwise(0.0).alias(f"f{k}")
    return means.select("*", *map(f1, KS))


def contradiction_quality(judged: DataFrame) -> DataFrame:
    """Of rows with contradicts and is_contradiction: counts, precision, recall and F1, 0 where undefined."""
    cell = lambda a, b: F.coalesce(F.sum(((F.col("contradicts") == a) & (F.col("is_contradiction") == b)).cast("long")), F.lit(0))
    c = judged.agg(cell(True, True).alias("tp"), cell(True, False).alias("fp"), cell(False, True).alias("fn"), cell(False, False).alias("tn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.withColumn("precision", p).withColumn("recall", r).withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(F.lit(0.0)))


def update_accuracy(decisions: DataFrame) -> DataFrame:
    """Of rows with action and expected_action."""
    return decisions.agg(F.count("*").alias("cases"), F.coalesce(F.avg(F.when(F.col("action") == F.col("expected_action"), 1.0).otherwise(0.0)), F.lit(0.0)).alias("accuracy"))


def eval_row(metrics: DataFrame, name: str, run_id: str, config: dict[str, str], as_of: Column) -> DataFrame:
    """The metrics of one run as a row to append."""
    settings = F.create_map(*(F.lit(x) for kv in sorted(config.items()) for x in kv)) if config else F.expr("cast(map() as map<string,string>)")
    return metrics.select(F.lit(name).alias("eval_name"), F.lit(run_id).alias("run_id"), F.to_json(F.struct(*metrics.columns)).alias("metrics"), settings.alias("config"), as_of.alias("created_at"))
