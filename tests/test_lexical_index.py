"""The lexical index against scores of all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from memspark.functions import lexical
from memspark.operators import lexical_index


def tables_of(spark, seed, n=120):
    rng = random.Random(seed)
    words = ["rain", "brain", "train", "o'neil's", "it", "the", "to", "be", "or", "not", "5", "x", "s", "sun", "sunny", "don't", "ab", "abc", "--", "été", "A1", "a1b2", "''", "moon"]
    common = lambda n: " ".join(rng.choices(words, weights=[6, 1, 2, 1, 8, 9, 6, 4, 4, 2, 1, 1, 2, 5, 1, 1, 2, 1, 1, 1, 1, 1, 1, 1], k=n))
    texts = [common(rng.randint(0, 30)) for _ in range(n)] + [None, "", "  ", texts_same := common(9), texts_same]
    memories = [(f"u{i % 3}", f"m{i}", t) for i, t in enumerate(texts)]
    asked = [common(rng.randint(1, 12)) for _ in range(40)] + [None, "", "the", "to be or", "to be or not", "rain sun moon", "s", "zz unknown", "--", texts_same, " Rain  the SUN "]
    queries = [(f"q{i}", f"u{i % 4}", t) for i, t in enumerate(asked)]
    return spark.createDataFrame(queries, "query_id string, user_id string, query_text string"), spark.createDataFrame(memories, "user_id string, memory_id string, content string").repartition(3)


def all_pairs(queries, memories):
    both = queries.filter("query_text IS NOT NULL").join(memories.filter("content IS NOT NULL"), "user_id").withColumn("lexical", F.round(lexical.lexical_score(F.col("query_text"), F.col("content")), 6)).filter("lexical > 0")
    out = {}
    for r in both.select("query_id", "memory_id", "lexical").collect():
        out.setdefault(r.query_id, []).append((-r.lexical, r.memory_id))
    return {q: sorted(x) for q, x in out.items()}


def test_whole_query_within_words(spark):
    """A content that holds the whole query inside of longer words has its inner tokens only; it must not be lost."""
    query = "ain sun moon star lake ear"
    texts = ["brain sun moon star lake earth"] + [f"ain ear word{i} lake" for i in range(30)] + [f"ain ear sun star word{i}" for i in range(30)]
    memories = spark.createDataFrame([("u", f"m{i:02}", t) for i, t in enumerate(texts)], "user_id string, memory_id string, content string")
    queries = spark.createDataFrame([("q", "u", query)], "query_id string, user_id string, query_text string")
    want = all_pairs(queries, memories)["q"]
    for k in (1, 2, 40):
        got = lexical_index.top_k(queries, memories, k).orderBy("rank").collect()
        assert [(-r.lexical, r.memory_id) for r in got] == want[:k]


@pytest.mark.parametrize("seed, k", [(1, 3), (3, 1000)])
@pytest.mark.parametrize("gram, direct", [(3, 10), (3, 0), (1, 0)])
def test_equals_all_pairs(spark, monkeypatch, seed, k, gram, direct):
    monkeypatch.setattr(lexical_index, "DIRECT", direct)
    monkeypatch.setattr(lexical_index, "GRAM", gram)  # the fewer letters a gram has, the more queries go through the lists of runs
    queries, memories = tables_of(spark, seed)
    want = {(q, i + 1, m, -s) for q, x in all_pairs(queries, memories).items() for i, (s, m) in enumerate(x[:k])}
    got = {(r.query_id, r["rank"], r.memory_id, r.lexical) for r in lexical_index.top_k(queries, memories, k).collect()}
    assert got == want


def test_reads_few_pairs(spark):
    """Of memories that share frequent words with a query only those with its rare ones are scored."""
    rng = random.Random(4)
    text = lambda i: " ".join(rng.choices([f"common{j}" for j in range(12)], k=8)) + f" rare{i // 5} thing{i // 5} odd{i // 5}"
    memories = spark.createDataFrame([("u", f"m{i:04}", text(i)) for i in range(1500)], "user_id string, memory_id string, content string")
    queries = spark.createDataFrame([(f"q{j}", "u", f"with rare{j} thing{j} odd{j} and common1") for j in range(30)], "query_id string, user_id string, query_text string")
    index = lexical_index.LexicalIndex(memories)
    _, pairs = lexical_index.candidates(queries, index, 3)
    assert pairs.count() < 30 * 1500 / 50
    want = {q: x[:3] for q, x in all_pairs(queries, memories).items()}
    got = {}
    for r in lexical_index.top_k(queries, index, 3).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((-r.lexical, r.memory_id))
    assert got == want


def test_holding_runs(spark):
    """Equal to contains() over all runs, for terms shorter than a gram too."""
    rng = random.Random(5)
    runs = sorted({"".join(rng.choice("ab'") for _ in range(rng.randint(1, 7))) for _ in range(300)})
    terms = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 5))) for _ in range(60)} | {"zzzz", "ab'b"})
    grams = lexical_index.LexicalIndex(spark.createDataFrame([("u", "m", " ".join(runs))], "user_id string, memory_id string, content string")).grams
    got = {(r.term, r.run) for r in lexical_index.holding_runs(spark.createDataFrame([(t,) for t in terms], "term string"), grams).collect()}
    assert got == {(t, r) for t in terms for r in runs if t in r}


def test_empty(spark):
    queries, memories = tables_of(spark, 1, 3)
    assert lexical_index.top_k(queries.limit(0), memories).count() == 0 and lexical_index.top_k(queries, memories.limit(0)).count() == 0
