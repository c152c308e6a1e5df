"""The k best memories of each query by lexical score, through inverted indexes with score bounds.

A query's token adds 0.5 / n to the score where it is a token of the content, 0.3 / n where it is a
part of it, with n tokens in the query; a phrase adds 0.2 at most, and 0.8 by the number of words
unless the whole query is in the content. As in max-score, each query's tokens are ordered by the
length of their lists:

1. The shortest lists give ``k`` memories, whose exact scores give a least score for the k-th place.
2. Where that score is out of reach for parts and phrases alone, the lists of tokens are read up to
   the one from where the other tokens could not lift a memory to it. Memories whose sum and
   bounds reach it are kept, and those that may hold the whole query: these have its rarest inner token.
3. Other queries read a second index too, of the content's runs of ``[a-z0-9']``: a token is in a
   content exactly if it is in one of its runs. Which runs hold it is looked up among the distinct
   runs, by the rarest of the token's grams of three letters (shorter tokens are grams themselves),
   and verified. A phrase of stop words alone is looked up by its middle word. Queries with tokens of
   one or two letters, which are part of nearly all contents, don't gain from lists, nor do few
   queries gain from making them: their user's memories are scored one by one, but for phrases
   where these could not matter.
4. What is kept is scored exactly, from the texts.

So results equal scoring all pairs. Queries without any token, whose only score is that of a
phrase, are scored against all of their user's memories.

Defined cases: memories that score 0 are not returned, so a query can have fewer than ``k`` rows;
ties go to the smaller memory_id; a null content or query has no score; a query_id has to be unique.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspark.functions import lexical
from memspark.sources import tables

RUN = "[a-z0-9']+"
GRAM = 3
#: If so few pairs for each content are left to parts of words, scoring them costs less than an index of the content's runs.
DIRECT = 10
#: What all tokens, all parts and a phrase add at most; scores are compared to 6 decimals.
OVERLAP, KEYWORD, PHRASE, SLACK = 0.5, 0.3, 0.2, 2e-6


def _grams(text: Column, n: int) -> Column:
    """Distinct stretches of ``n`` characters; none if the text is shorter."""
    starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(n))))


class LexicalIndex:
    """The indexes of ``memories`` (user_id, memory_id, content); each table is written when it is asked for first, and may be read often."""

    def __init__(self, memories: DataFrame):
        held = memories.filter("content IS NOT NULL AND user_id IS NOT NULL")
        self.contents = tables.materialise(held.select("user_id", "memory_id", *lexical.content_parts(F.col("content"))), "contents")

    @cached_property
    def tokens(self) -> DataFrame:
        """user_id, term, memory_id."""
        return self.contents.select("user_id", F.explode(F.array_distinct("c_tokens")).alias("term"), "memory_id")

    @cached_property
    def token_counts(self) -> DataFrame:
        return tables.materialise(self.tokens.groupBy("user_id", "term").agg(F.count("*").alias("n")), "token-counts")

    @cached_property
    def runs(self) -> DataFrame:
        """user_id, run, memory_id."""
        runs = F.array_distinct(F.regexp_extract_all("c_low", F.lit(RUN), F.lit(0)))
        return tables.materialise(self.contents.select("user_id", F.explode(runs).alias("run"), "memory_id"), "runs")

    @cached_property
    def run_counts(self) -> DataFrame:
        return tables.materialise(self.runs.groupBy("user_id", "run").agg(F.count("*").alias("n")), "run-counts")

    @cached_property
    def grams(self) -> DataFrame:
        """gram, run: all stretches of up to GRAM characters of each distinct run."""
        all_grams = F.concat(*(_grams(F.col("run"), n) for n in range(1, GRAM + 1)))
        return tables.materialise(self.run_counts.select("run").distinct().select(F.explode(all_grams).alias("gram"), "run"), "grams")


def holding_runs(terms: DataFrame, grams: DataFrame) -> DataFrame:
    """term, run, exact: the runs that hold each distinct ``term``; exact if it is one of the run's tokens."""
    own = terms.select("term", F.explode(F.when(F.length("term") <= GRAM, F.array("term")).otherwise(_grams(F.col("term"), GRAM))).alias("gram"))
    asked = grams.join(own.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    rarest = own.join(asked, "gram", "left").groupBy("term").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    found = rarest.join(grams, "gram").filter(F.contains("run", "term"))
    return found.select("term", "run", F.array_contains(F.regexp_extract_all("run", F.lit(lexical.TOKEN), F.lit(0)), F.col("term")).alias("exact"))


def _scored(pairs: DataFrame, asked: DataFrame, index: LexicalIndex) -> DataFrame:
    """``pairs`` (query_id, memory_id) with overlap, keyword, phrase and lexical, to 6 decimals."""
    rows = pairs.join(asked.drop("user_id"), "query_id").join(index.contents.drop("user_id"), "memory_id").select("query_id", "memory_id", *lexical.scores_of_parts())
    parts = [F.round(c, 6).alias(c) for c in ("overlap", "keyword", "phrase")]
    return rows.select("query_id", "memory_id", *parts, F.round(lexical.total("overlap", "keyword", "phrase"), 6).alias("lexical"))


def _in_order(terms: DataFrame, lengths: DataFrame) -> DataFrame:
    """``terms`` with n and adds of their lists, before (rows of shorter lists) and onwards (what this list and longer ones add together)."""
    by_length = Window.partitionBy("query_id").orderBy("n", "term")
    ordered = terms.join(lengths, ["user_id", "term"]).withColumn("adds", F.col("weight") / F.col("n_tokens"))
    ordered = ordered.withColumn("before", F.coalesce(F.sum("n").over(by_length.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return tables.materialise(ordered.withColumn("onwards", F.sum("adds").over(by_length.rowsBetween(0, Window.unboundedFollowing))), "ordered")


def _reaching(ordered: DataFrame, limits: DataFrame, aside: Column, sums) -> DataFrame:
    """Pairs of the lists that have to be read which can reach their query's limit; ``aside`` is what a memory gets besides the lists at most, ``sums`` reads them."""
    bounded = ordered.join(limits, "query_id").withColumn("aside", aside)
    read = tables.materialise(bounded.filter(F.col("onwards") + F.col("aside") >= F.col("limit")), "read")
    rest = bounded.filter(F.col("onwards") + F.col("aside") < F.col("limit")).groupBy("query_id").agg(F.sum("adds").alias("rest"))
    bounds = read.groupBy("query_id").agg(F.max("limit").alias("limit"), F.max("aside").alias("aside")).join(rest, "query_id", "left").fillna(0.0, ["rest"])
    return sums(read).join(bounds, "query_id").filter(F.col("partial") + F.col("rest") + F.col("aside") >= F.col("limit")).select("query_id", "memory_id")


def candidates(queries: DataFrame, index: LexicalIndex, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """The queries' parts, and the pairs (query_id, memory_id) among which the ``k`` best of each query are."""
    words = lexical.query_words(F.col("query_text"))
    inner = lexical.tokens(F.array_join(F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))), " "))
    asked = queries.filter("query_text IS NOT NULL AND user_id IS NOT NULL").select("query_id", "user_id", *lexical.query_parts(F.col("query_text")), inner.alias("q_inner"))
    asked = tables.materialise(asked, "asked")
    terms = asked.select("query_id", "user_id", "q_n", F.size("q_tokens").alias("n_tokens"), F.explode("q_tokens").alias("term"))
    ordered = _in_order(terms, index.token_counts.withColumn("weight", F.lit(OVERLAP)))

    def of_tokens(lists: DataFrame) -> DataFrame:
        return lists.select("query_id", "user_id", "term", "adds").join(index.tokens, ["user_id", "term"]).groupBy("query_id", "memory_id").agg(F.sum("adds").alias("partial"))

    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("partial"), "memory_id"))
    tried = of_tokens(ordered.filter(F.col("before") < 4 * k)).withColumn("place", best).filter(F.col("place") <= k)
    limits = _scored(tried.select("query_id", "memory_id"), asked, index).groupBy("query_id").agg(F.min("lexical").alias("limit"), F.count("*").alias("found"))
    limits = asked.select("query_id", "q_n", F.size("q_inner").alias("n_inner")).join(limits.filter(F.col("found") >= k), "query_id", "left")
    limits = tables.materialise(limits.select("query_id", "q_n", "n_inner", (F.coalesce("limit", F.lit(0.0)) - SLACK).alias("limit")), "limits")

    part = F.when(F.col("q_n") < 5, PHRASE).otherwise(PHRASE * 4 / F.col("q_n"))
    by_tokens = (F.col("q_n") >= 5) & (F.col("n_inner") > 0) & (F.col("limit") > KEYWORD + part)
    found = _reaching(ordered.drop("q_n"), limits.filter(by_tokens), KEYWORD + part, of_tokens)
    # What holds the whole query has its inner words between spaces, so their tokens too.
    rarest = asked.join(limits.filter(by_tokens).select("query_id"), "query_id", "left_semi").select("query_id", "user_id", F.explode("q_inner").alias("term"))
    rarest = rarest.join(index.token_counts, ["user_id", "term"], "left").groupBy("query_id", "user_id").agg(F.min_by("term", F.struct(F.coalesce("n", F.lit(0)), "term")).alias("term"))
    found = found.unionByName(rarest.join(index.tokens, ["user_id", "term"]).select("query_id", "memory_id"))
    others = asked.join(limits.filter(~by_tokens).select("query_id", "limit"), "query_id")
    users = index.contents.groupBy("user_id").agg(F.count("*").alias("own"))
    others = tables.materialise(others.withColumn("short", F.exists("q_tokens", lambda t: F.length(t) < GRAM)).join(users, "user_id"), "others")
    pairs, held = others.agg(F.coalesce(F.sum("own"), F.lit(0))).first()[0], index.contents.count()
    if pairs <= DIRECT * held:
        others = others.withColumn("short", F.lit(True))
    others = others.drop("own")
    for short, path in ((False, _by_parts), (True, _directly)):
        own = others.filter(F.col("short") == short).drop("short")
        if not own.isEmpty():
            found = found.unionByName(path(own, part, index, k))
    return asked, found.distinct()


def _directly(asked: DataFrame, part: Column, index: LexicalIndex, k: int) -> DataFrame:
    """Pairs of queries that lists don't help: all of a user's are scored but for phrases, which only those need that they may lift to the k-th score."""
    shares = lexical.scores_of_parts()[:2]
    pairs = asked.join(index.contents, "user_id").select("query_id", "memory_id", "q_n", "limit", *shares, F.contains("c_low", "q_low").alias("whole"))
    pairs = pairs.select("query_id", "memory_id", "limit", (F.col("overlap") * OVERLAP + F.col("keyword") * KEYWORD).alias("partial"), F.when(F.col("whole"), PHRASE).otherwise(part).alias("aside"))
    pairs = tables.materialise(pairs.filter(F.col("partial") + F.col("aside") >= F.col("limit")), "partly-scored")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("partial"), "memory_id"))
    kth = pairs.select("query_id", "memory_id", "partial").withColumn("place", place).filter(F.col("place") <= k).groupBy("query_id").agg(F.min("partial").alias("kth"), F.count("*").alias("n"))
    kth = kth.select("query_id", F.when(F.col("n") >= k, F.col("kth") - SLACK).alias("kth"))
    return pairs.join(kth, "query_id").filter(F.col("kth").isNull() | (F.col("partial") + F.col("aside") >= F.col("kth"))).select("query_id", "memory_id")


def _by_parts(asked: DataFrame, part: Column, index: LexicalIndex, k: int) -> DataFrame:
    """Pairs of queries whose memories may have their score from parts of words and phrases."""
    terms, limits = asked.select("query_id", "user_id", F.size("q_tokens").alias("n_tokens"), F.explode("q_tokens").alias("term")), asked.select("query_id", "limit")
    runs = tables.materialise(holding_runs(terms.select("term").distinct(), index.grams), "held")
    lengths = terms.select("user_id", "term").distinct().join(runs, "term").join(index.run_counts, ["user_id", "run"])
    weight = F.when(F.max("exact"), OVERLAP + KEYWORD).otherwise(KEYWORD)
    ordered = _in_order(terms, lengths.groupBy("user_id", "term").agg(F.sum("n").alias("n"), weight.alias("weight")))

    def of_runs(lists: DataFrame) -> DataFrame:
        adds = F.when(F.col("exact"), OVERLAP + KEYWORD).otherwise(KEYWORD) / F.col("n_tokens")
        each = lists.select("query_id", "user_id", "term", "n_tokens").join(runs, "term").join(index.runs, ["user_id", "run"]).groupBy("query_id", "memory_id", "term").agg(F.max(adds).alias("adds"))
        return each.groupBy("query_id", "memory_id").agg(F.sum("adds").alias("partial"))

    found = _reaching(ordered, limits, F.lit(PHRASE), of_runs)
    return found.unionByName(_by_phrase_alone(asked, part, index))


def _by_phrase_alone(asked: DataFrame, part: Column, index: LexicalIndex) -> DataFrame:
    """Pairs that may score by a phrase without any of the query's tokens.

    A run of three words without tokens stands in a content only if its middle word does, between spaces, so that what RUN
    finds in that word are runs of the content. That matters only where such a score reaches the limit.
    """
    own = index.contents.select("user_id", "memory_id")
    bare = asked.filter(F.size("q_tokens") == 0).select("query_id", "user_id").join(own, "user_id")
    open_ = asked.filter((F.size("q_tokens") > 0) & (F.col("q_n") >= 3) & (F.col("limit") <= part))
    without = F.filter("q_threes", lambda r: ~F.exists("q_tokens", lambda t: F.contains(r, t)))
    middle = F.get(F.regexp_extract_all(F.split("three", " ")[1], F.lit(RUN), F.lit(0)), F.lit(0))
    threes = open_.select("query_id", "user_id", F.explode(without).alias("three")).select("query_id", "user_id", middle.alias("run")).distinct()
    by_run = threes.filter("run IS NOT NULL").join(index.runs, ["user_id", "run"])
    signs = threes.filter("run IS NULL").join(own, "user_id")
    return bare.select("query_id", "memory_id").unionByName(by_run.select("query_id", "memory_id")).unionByName(signs.select("query_id", "memory_id"))


def top_k(queries: DataFrame, memories: DataFrame | LexicalIndex, k: int = 10) -> DataFrame:
    """query_id, rank, memory_id, overlap, keyword, phrase and lexical of the ``k`` best memories of each query's user.

    ``queries``: query_id, user_id, query_text; ``memories``: user_id, memory_id, content, or their index.
    """
    index = memories if isinstance(memories, LexicalIndex) else LexicalIndex(memories)
    asked, pairs = candidates(queries, index, k)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("lexical"), "memory_id"))
    found = _scored(pairs, asked, index).filter("lexical > 0").withColumn("rank", rank).filter(F.col("rank") <= k)
    return found.select("query_id", "rank", "memory_id", "overlap", "keyword", "phrase", "lexical")
