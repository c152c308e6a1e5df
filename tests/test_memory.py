"""The memory operators on small rows with values worked out by hand."""

import datetime as dt
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from memspark import fixtures
from memspark.config import DEFAULTS, Defaults
from memspark.functions import lexical, replies, scoring, vectors
from memspark.operators import catalog, consolidate, contradict, evaluate, graph, ingest, reflect, retrieve, sessions, update, vector_search
from memspark.operators.vector_search import pairs_over, top_per_query
from memspark.plans import queries
from memspark.schemas import MEMORIES, OBSERVATIONS, with_defaults
from memspark.sources import tables
from memspark.streaming import jobs

NOW = dt.datetime(2024, 2, 1)
AS_OF = None


@pytest.fixture(autouse=True, scope="module")
def _as_of(spark):
    global AS_OF
    AS_OF = F.to_timestamp(F.lit("2024-02-01 00:00:00"))


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def memory(spark, *rows):
    """Rows as dicts; what is missing gets defaults."""
    base = {"memory_id": "m", "user_id": "u", "namespace": "user:u", "content": "text", "created_at": NOW, "updated_at": NOW}
    full = [base | r for r in rows]
    return with_defaults(spark.createDataFrame([tuple(r.get(f.name) for f in MEMORIES) for r in full], MEMORIES))


def test_recency(spark):
    at = lambda h: F.to_timestamp(F.lit(str(NOW - dt.timedelta(hours=h))))
    assert value(spark, scoring.recency(AS_OF, at(168), at(168))) == pytest.approx(math.exp(-1))
    assert value(spark, scoring.recency(AS_OF, at(-5), at(0))) == 1
    assert value(spark, scoring.recency(AS_OF, F.lit(None).cast("timestamp"), at(24), 24.0)) == pytest.approx(math.exp(-1))
    assert value(spark, scoring.recency(AS_OF, at(168), at(0), 0.0)) == pytest.approx(math.exp(-1))


@pytest.mark.parametrize("text, want", [("plain", 0.4), ("I dislike rain", 0.48), ("You must never miss the deadline", 0.64), ("x" * 201, 0.45), ("x" * 501, 0.5), (" ".join(scoring.HIGH_SIGNALS), 1.0)])
def test_importance(spark, text, want):
    assert value(spark, scoring.importance(F.lit(text))) == pytest.approx(want)


def test_composite(spark):
    c = lambda *x: value(spark, scoring.composite(*map(F.lit, x)))
    assert c(0.0, 0.0, 0.0, 0.0, 0.0) == 0
    assert c(1.0, 1.0, 1.0, 1.0, 0.0) == pytest.approx(1)
    assert c(0.1, 0.0, 0.0, 0.0, 0.4) == 0
    assert value(spark, scoring.contradiction_penalty(F.lit("confirmed"), F.lit(None).cast("double"))) == 0.4
    assert value(spark, scoring.contradiction_penalty(F.lit("confirmed"), F.lit(0.6))) == 0
    assert value(spark, scoring.access(F.lit(100))) == pytest.approx(1)


def test_lexical(spark):
    q, c = F.lit("Where does Anna keep the red bicycle"), F.lit("Anna keeps her red bicycle in the cellar")
    assert value(spark, lexical.tokens(F.lit("It's the Cat's 2nd hat"))) == ["it's", "cat's", "2nd", "hat"]
    assert value(spark, lexical.token_overlap(q, c)) == pytest.approx(3 / 4)
    assert value(spark, lexical.keyword_boost(q, c)) == 1
    assert value(spark, lexical.phrase_bonus(F.lit("a b c d e"), F.lit("x b c d y"))) == pytest.approx(3 / 5)
    assert value(spark, lexical.phrase_bonus(F.lit(""), c)) == 1 and value(spark, lexical.phrase_bonus(F.lit("zz yy"), c)) == 0
    assert value(spark, lexical.jaccard(F.lit("a b c"), F.lit("B c d"))) == pytest.approx(0.5)


def test_ingest(spark):
    rows = [("o1", "s", "u", "a", "I love tea", "user_message", NOW, None, "fact", None), ("o2", "s", "u", "a", "", "user_message", NOW, None, None, None), ("o3", "s", "u", "a", "x", "user_message", NOW, None, None, 0.0), ("o4", "s", "u", "a", "x", "user_message", NOW, None, "odd", 0.9)]
    valid, rejected = ingest.ingest(spark.createDataFrame(rows, OBSERVATIONS), AS_OF)
    got = {r["source_ref"] + r["content"]: (r["memory_layer"], round(r["importance_score"], 2), r["namespace"], r["version"]) for r in valid.collect()}
    assert got == {"sI love tea": ("semantic", 0.48, "user:u", 1), "sx": ("episodic", 0.4, "user:u", 1)}
    assert {r["reject_reason"] for r in rejected.collect()} == {"empty content", "unknown memory_type"}
    assert ingest.ingest_summary(valid, rejected).first().asDict() == {"ingested": 2, "failed": 2}


def _search(spark, block):
    v = spark.createDataFrame([("a", "u", [1.0, 0.0]), ("b", "u", [1.0, 1.0]), ("c", "u", [0.0, 1.0]), ("d", "w", [1.0, 0.0]), ("e", "u", None), ("f", "u", [0.0, 0.0])], "memory_id string, user_id string, embedding array<double>")
    q = spark.createDataFrame([("q", "u", [1.0, 0.1])], "query_id string, user_id string, embedding array<double>")
    top = [(r["memory_id"], r["place"]) for r in top_per_query(q, v, 2, block).orderBy("place").collect()]
    pairs = sorted((r["a"], r["b"], r["score"]) for r in pairs_over(v, 0.7, block).collect())
    return top, pairs


def test_search_does_not_depend_on_blocks(spark):
    assert _search(spark, 2048) == _search(spark, 1) == ([("a", 1), ("b", 2)], [("a", "b", 0.707107), ("b", "c", 0.707107)])


def test_retrieve_fallback_diversity_and_filters(spark):
    m = memory(spark, {"memory_id": "1", "content": "red fox jumps"}, {"memory_id": "2", "content": "Red fox  jumps", "updated_at": NOW - dt.timedelta(days=1)}, {"memory_id": "3", "content": "other", "importance_score": 0.1}, {"memory_id": "4", "user_id": "w", "namespace": "user:w"}, {"memory_id": "5", "status": "superseded"})
    v = spark.createDataFrame([(str(i), [1.0, i / 10]) for i in (1, 2, 3, 5)], "memory_id string, embedding array<double>")
    q = spark.createDataFrame([("q", "u", [1.0, 0.0], 0.2), ("r", "w", [1.0, 0.0], 0.0)], "query_id string, user_id string, embedding array<double>, min_importance double")
    got = {(r["query_id"], r["rank"]): (r["memory_id"], r["total_found"], r["semantic_score"]) for r in retrieve.retrieve(q, m, v, AS_OF).collect()}
    assert got == {("q", 1): ("1", 2, pytest.approx(0.995037)), ("r", 1): ("4", 1, 0.5)}
    back = {r["memory_id"]: r["access_count"] for r in retrieve.access_feedback(m, retrieve.retrieve(q, m, v, AS_OF), AS_OF).collect()}
    assert back == {"1": 1, "2": 0, "3": 0, "4": 1, "5": 0}
    text = retrieve.context_window(retrieve.retrieve(q, m, v, AS_OF)).filter("query_id = 'r'").first()
    assert text["context"].startswith("# Relevant Memories\n\n1. [observation] text (importance=0.50, score=") and text["api_context"] == "[1] text"
    assert value(spark, retrieve.known_types(F.array(F.lit("fact"), F.lit("gossip")))) == ["fact"]


def test_access_feedback_touches_what_was_returned(spark, tmp_path):
    """44640 is made at the very time of the feedback: it is touched only where it was returned."""
    spark.createDataFrame([(25, "red fox", "s"), (26, "blue hare", "s"), (44640, "old owl", "t"), (44641, "new owl", "t")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(25, [1.0, 0.0], 1), (26, [0.9, 0.1], 1)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(25,), (29,)], "event_id long").write.parquet(f"{tmp_path}/events.parquet")
    found = lambda: {r.memory_id: (r.access_count, r.touched) for r in queries.access_feedback(spark, str(tmp_path)).collect()}
    assert found() == {"25": (1, True), "26": (1, True), "44640": (0, False), "44641": (0, False)}
    spark.createDataFrame([(44640, [1.0, 0.0], 1), (44650, [1.0, 0.0], 1)], "vec_id long, embedding array<float>, label int").write.mode("append").parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(44650, "grey wolf", "t")], "doc_id long, text string, source string").write.mode("append").parquet(f"{tmp_path}/documents.parquet")
    assert found()["44640"] == (1, True)


def _text_vector(*texts):
    """By hand: signs of runs of three words in 64 buckets, of length 1."""
    sums = [0] * 64
    for text in texts:
        words = re.findall(r"[^ \t\n\x0b\f\r]+", text.lower())
        for run in [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]:
            h = int(hashlib.md5(run.encode()).hexdigest()[:8], 16)
            sums[h % 64] += 1 if h // 64 % 2 else -1
    size = math.sqrt(sum(x * x for x in sums))
    return [x / size for x in sums]


def test_text_vectors(spark, tmp_path):
    """Only ASCII white space parts words, texts of one doc_id add up, and a null text has none."""
    texts = [(1, "One two\u00a0three FOUR\tfive\x0bsix \u00c9t\u00e9"), (2, "a b"), (3, ""), (4, " \n "), (5, None), (6, "x y z x y"), (6, "p q r"), (7, " ".join(f"w{i % 977}x{i % 13}" for i in range(20_000)))]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.memory_id: r.embedding for r in fixtures.text_vectors(spark, str(tmp_path)).collect()}
    want = {}
    for i, x in texts:
        if x is not None:
            want.setdefault(str(i), []).append(x)
    assert got == {i: _text_vector(*x) for i, x in want.items()}


@pytest.mark.parametrize(("block", "threshold"), [(8192, 0.9), (16, 0.9), (1, 0.9), (16, 0.3), (16, 0.0)])
def test_pairs_over_by_pieces(spark, monkeypatch, block, threshold):
    """Shelves of pieces and parts of those that pass by: the pairs are those of all against all, also at the threshold and of odd vectors."""
    monkeypatch.setattr(vector_search, "LEAST", 1)
    monkeypatch.setattr(vector_search, "HELD", 2)
    monkeypatch.setattr(vector_search, "PART", 3)
    rng = random.Random(4)
    own = [[rng.gauss(0, 1) for _ in range(3)] for _ in range(80)] + [[1.0, 0.0, 0.0], [0.9, math.sqrt(1 - 0.81), 0.0], [0.8999994, math.sqrt(1 - 0.8999994**2), 0.0], [0.8999996, math.sqrt(1 - 0.8999996**2), 0.0]]
    own += [[0.0] * 3, [math.nan, 1.0, 0.0], [math.inf, 1.0, 0.0], [1e200, 1e200, 0.0], [3.0, 0.0, 0.0], [1.0, 2.0], [2.0, 4.0]]
    rows = [(f"m{i}", "u" if i % 9 else "w", x) for i, x in enumerate(own)]
    got = {(r.user_id, r.a, r.b): r.score for r in vector_search.pairs_over(spark.createDataFrame(rows, "memory_id string, user_id string, embedding array<double>").repartition(3), threshold, block).collect()}
    want = {}
    for i, u, x in rows:
        for j, w, y in rows:
            if u == w and i < j and len(x) == len(y):
                with np.errstate(all="ignore"):
                    size = np.linalg.norm(x) * np.linalg.norm(y)
                    score = round(float(np.dot(x, y) / size), 6) if size > 0 else 0.0
                if score >= threshold:
                    want[u, i, j] = pytest.approx(score, abs=1.1e-6)
    assert got == want


def _shuffled(spark):
    """Bytes that all stages so far have written for others."""
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_pairs_over_copies_vectors_for_shelves_only(spark):
    """Pairs of 96 blocks would copy each vector about a hundred times."""
    rng = np.random.default_rng(6)
    v = rng.normal(size=(1920, 64))
    rows = spark.createDataFrame([(f"m{i}", "u", x.tolist()) for i, x in enumerate(v)], "memory_id string, user_id string, embedding array<double>").coalesce(2)
    before = _shuffled(spark)
    assert vector_search.pairs_over(rows, 0.9, 20).count() == 0
    assert _shuffled(spark) - before < 15 * v.nbytes, _shuffled(spark) - before


def test_promote(spark):
    m = memory(spark, {"memory_id": "1", "access_count": 3, "importance_score": 0.6}, {"memory_id": "2", "access_count": 2, "importance_score": 0.9}, {"memory_id": "3", "access_count": 9, "importance_score": 0.9, "memory_layer": "semantic"})
    got = {r["memory_id"]: (r["memory_layer"], r["promoted"], "promoted_at" in r["metadata"]) for r in consolidate.promote(m, AS_OF).collect()}
    assert got == {"1": ("semantic", True, True), "2": ("episodic", False, False), "3": ("semantic", False, False)}


def test_merge_walks_in_listing_order(spark):
    """1 meets 2 and loses, still meets 3 and wins."""
    rows = [{"memory_id": str(i), "memory_layer": "semantic", "created_at": NOW - dt.timedelta(hours=i), "importance_score": s, "access_count": n} for i, s, n in ((1, 0.5, 1), (2, 0.9, 2), (3, 0.1, 4), (4, 0.1, 8))]
    m = memory(spark, *rows)
    pairs = spark.createDataFrame([("u", "1", "2", 1.0), ("u", "1", "3", 1.0), ("u", "3", "4", 1.0)], "user_id string, a string, b string, score double")
    done = consolidate.merges(m, pairs)
    assert [(r["winner"], r["loser"]) for r in done.orderBy("step").collect()] == [("2", "1"), ("1", "3")]
    got = {r["memory_id"]: (r["status"], r["merged_into"], r["access_count"], r["parent_memory_ids"]) for r in consolidate.apply_merges(m, done).collect()}
    assert got == {"1": ("superseded", "2", 5, ["3"]), "2": ("active", None, 3, ["1"]), "3": ("superseded", "1", 4, []), "4": ("active", None, 8, [])}


def test_merge_by_classes_and_components(spark):
    """The walk over copies and components is that over all pairs, and copies are never paired."""
    rng = random.Random(3)
    base = [[1.0, 0.0, 0.0], [0.95, 0.312, 0.0], [0.8, 0.6, 0.0], [0.0, 0.0, 1.0], [0.0, 0.0, 0.0], [0.0, -1.0, 0.0]]
    own = [(str(i), rng.choice([*base, base[0]]) if i < 59 else [0.0, -0.6, -0.8], rng.choice([0.2, 0.5, 0.9]), rng.randint(0, 9)) for i in range(60)]
    m = memory(spark, *({"memory_id": i, "memory_layer": "semantic", "created_at": NOW - dt.timedelta(hours=int(i) % 7), "importance_score": s, "access_count": n} for i, _, s, n in own))
    v = spark.createDataFrame([(i, x) for i, x, _, _ in own], "memory_id string, embedding array<double>")
    d = Defaults(merge_from=0.9)
    place = {i: (int(i) % 7, i) for i, *_ in own}
    near = {(r["a"], r["b"]) for r in consolidate.near_duplicate_pairs(m, v, d).collect()}
    imp, held, lost, want, into = {i: s for i, _, s, _ in own}, {i: n for i, _, _, n in own}, set(), [], {}
    for a in sorted(place, key=place.get):
        for b in sorted(place, key=place.get) if a not in lost else ():
            if place[b] > place[a] and b not in lost and (min(a, b), max(a, b)) in near:
                w, x = (a, b) if imp[a] >= imp[b] else (b, a)
                lost.add(x)
                want.append((w, x))
                into[x] = w
                held[w] += held[x]
    pairs, copies = consolidate.near_duplicate_classes(m, v, d)
    assert pairs.count() == 2 and len(near) > 100
    done = consolidate.merges(m, pairs, copies)
    assert sorted((r["winner"], r["loser"]) for r in done.collect()) == sorted(want)
    after, counts = consolidate.consolidate(m, v, AS_OF, d)
    assert sorted((r["memory_id"], r["merged_into"], r["access_count"]) for r in after.collect()) == sorted((i, into.get(i), held[i]) for i in held)


def _walk(place, imp, access, near):
    """The merge as it is described, one memory after the other."""
    held, lost, want, into = dict(access), set(), [], {}
    for a in sorted(place, key=place.get):
        for b in sorted(near.get(a, ()), key=place.get) if a not in lost else ():
            if place[b] > place[a] and b not in lost:
                w, x = (a, b) if imp[a] >= imp[b] else (b, a)
                lost.add(x)
                want.append((w, x))
                into[x] = w
                held[w] += held[x]
    return want, into, held


@pytest.mark.parametrize("n, links, grades", [(80, 150, 4), (60, 50, 60), (3000, 3300, 1000)])
def test_merge_in_rounds_is_the_walk(spark, n, links, grades):
    """Random graphs: small dense ones, long chains of wins and losses, and one large group of near pairs."""
    rng = random.Random(n)
    ids = [f"m{i:05}" for i in range(n)]
    imp, access, hours = ({i: f(i) for i in ids} for f in (lambda _: rng.randrange(grades) / grades, lambda _: rng.randint(0, 9), lambda _: rng.randrange(n // 2)))
    edges = {tuple(sorted(rng.sample(ids, 2))) for _ in range(links)} | ({(ids[i], ids[i + 1]) for i in range(n - 1)} if n > 100 else set())
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want, into, held = _walk({i: (hours[i], i) for i in ids}, imp, access, near)
    m = memory(spark, *({"memory_id": i, "memory_layer": "semantic", "created_at": NOW - dt.timedelta(hours=hours[i]), "importance_score": imp[i], "access_count": access[i]} for i in ids))
    done = tables.materialise(consolidate.merges(m, spark.createDataFrame([("u", a, b, 1.0) for a, b in edges], "user_id string, a string, b string, score double")), "done")
    assert [(r.winner, r.loser) for r in done.orderBy("step").collect()] == want
    got = consolidate.apply_merges(m, done).select("memory_id", "merged_into", "access_count", "merged_ids").collect()
    assert {r.memory_id: (r.merged_into, r.access_count) for r in got} == {i: (into.get(i), held[i]) for i in ids}
    assert {r.memory_id: r.merged_ids for r in got if r.merged_ids} == {w: [x for v, x in want if v == w] for w, _ in want}


def test_ancestors_take_rounds_by_the_logarithm(spark, monkeypatch):
    """A chain of 1,024 versions: eleven rounds; and hops up to a bound."""
    rows = spark.createDataFrame([(f"v{i}", [f"v{i - 1}"] if i else []) for i in range(1024)], "memory_id string, parent_memory_ids array<string>")
    labels, write = [], tables.materialise
    monkeypatch.setattr(tables, "materialise", lambda df, label: labels.append(label) or write(df, label))
    found = graph.ancestors(rows)
    assert len(labels) <= 13
    got = found.agg(F.count("*"), F.sum("hops"), F.max("hops")).first()
    assert tuple(got) == (1024 * 1023 // 2, sum(h * (1024 - h) for h in range(1024)), 1023)
    assert found.filter("int(substring(memory_id, 2)) - int(substring(ancestor, 2)) <> hops").count() == 0
    assert graph.ancestors(rows, 5).groupBy("hops").count().count() == 5 and graph.ancestors(rows, 5).count() == sum(1024 - h for h in range(1, 6))


def _paths(edges, seed, depth, limit):
    """All paths of related(), by trying every edge."""
    ways = [(a, b, r, "|".join((a, b, r))) for a, b, r in edges]
    ways += [(b, a, r, i) for a, b, r, i in ways]
    out, paths = [], [(seed, None, [])]
    for k in range(1, depth + 1):
        paths = [(b, rel or r, [*used, i]) for at, rel, used in paths for a, b, r, i in ways if a == at and i not in used]
        out += [(k, node, rel, ",".join(used)) for node, rel, used in paths if node != seed]
    return [(node, rel, k) for k, node, rel, _ in sorted(out)[:limit]]


@pytest.mark.parametrize("depth, limit", [(1, 4), (2, 3), (2, 12), (3, 7), (3, 200)])
def test_related_with_hubs(spark, depth, limit):
    """The limit that is pushed into hops changes nothing: hubs, loops, edges both ways and several of one kind."""
    rng = random.Random(depth * limit)
    nodes = [f"n{i:02}" for i in range(25)]
    edges = {("hub", n, "r") for n in nodes} | {(n, "hub", "s") for n in nodes[:9]} | {("n01", "n01", "r"), ("n02", "hub", "t")}
    edges |= {(*rng.sample(nodes, 2), rng.choice("rs")) for _ in range(20)}
    e = spark.createDataFrame(sorted(edges), "src string, dst string, rel string")
    seeds = ["hub", "n00", "n01", "n02", "n17", "alone"]
    got = {}
    for r in graph.related(spark.createDataFrame([(x,) for x in seeds], "entity_id string"), e, depth, limit=limit).orderBy("seed", "place").collect():
        got.setdefault(r.seed, []).append((r.node, r.rel, r.hops))
    assert got == {x: p for x in seeds if (p := _paths(sorted(edges), x, depth, limit))}


def test_related_reads_little_of_a_hub(spark):
    hub = spark.range(20000).select(F.lit("hub").alias("src"), F.format_string("n%06d", "id").alias("dst"), F.lit("r").alias("rel"))
    seeds = spark.createDataFrame([(f"n{i:06}",) for i in range(0, 20000, 100)], "entity_id string")
    found = graph.related(seeds, hub, limit=10)
    assert found.count() == 200 * 10
    rows = [m for m in found._jdf.queryExecution().executedPlan().toString().split("\n") if "Join" in m]
    assert rows and graph.related(seeds, hub, limit=10).filter("node = 'hub' AND hops = 1").count() == 200


def test_ancestors_of_a_long_chain(spark):
    """A chain of 15 versions, with a way back at its end and a shorter way between; the query has no bound either."""
    rows = [(str(i), [str(i - 1)] if i else ["3"]) for i in range(15)] + [("x", ["14", "9"])]
    got = {(r["memory_id"], r["ancestor"]): r["hops"] for r in graph.ancestors(spark.createDataFrame(rows, "memory_id string, parent_memory_ids array<string>")).collect()}
    assert got[("14", "0")] == 14 and got[("x", "0")] == 10 and got[("x", "10")] == 5 and got[("0", "1")] == 3 and len(got) == 4 * 3 + sum(range(4, 15)) + 15
    found = queries.version_chain(spark, "/root/testdata/sf0.001")
    n = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    want = {(str(i), str(i >> h)): h for i in range(n) for h in range(i.bit_length(), 0, -1)}
    assert {(r["memory_id"], r["ancestor"]): r["hops"] for r in found.collect()} == want


def test_judge(spark):
    rows = [("user hates fish", "user now ate fish"), ("never", "moved to Rome"), ("Anna lives in Rome", "Anna moved to Oslo"), ("a b", "c d"), (None, "x")]
    got = [(r["contradicts"], r["confidence"]) for r in contradict.judge(spark.createDataFrame(rows, "content_a string, content_b string").coalesce(1)).collect()]
    assert got == [(True, 0.85), (True, 0.65), (True, 0.8), (False, 0.5), (False, 0.5)]


def test_apply_and_resolve_reports(spark):
    m = memory(spark, *({"memory_id": str(i), "created_at": NOW - dt.timedelta(days=i)} for i in range(4)))
    judged = spark.createDataFrame([("1", "0", True, 0.9, "temporal_update"), ("1", "2", True, 0.6, "direct_conflict"), ("3", "2", False, 0.5, "none")], "a string, b string, contradicts boolean, confidence double, contradiction_type string")
    found = contradict.reports(judged, AS_OF)
    got = {r["memory_id"]: (r["contradiction_status"], r["contradicted_by"], r["status"]) for r in contradict.apply_reports(m, found).collect()}
    assert got == {"0": ("confirmed", ["1"], "active"), "1": ("confirmed", ["0"], "superseded"), "2": ("suspected", [], "active"), "3": ("none", [], "active")}
    chosen = found.filter("memory_b_id = '2'").select("report_id", F.lit("2").alias("winning_memory_id"), F.lit("newer").alias("note"))
    closed, after = contradict.resolve(found, m, chosen, AS_OF)
    assert closed.filter("resolved").count() == 1 and [r["memory_id"] for r in after.filter("status = 'superseded'").collect()] == ["1"]
    assert catalog.list_contradictions(closed, False).count() == 1
    assert value(spark, contradict.known_type(F.lit("quarrel"))) == "direct_conflict"


def test_updates_chain_on_one_memory(spark):
    m = memory(spark, {"memory_id": "1", "parent_memory_ids": ["0"], "version": 2, "importance_score": 0.9, "memory_layer": "semantic"})
    rows = [("d1", "u", "one", "1", "update", ""), ("d2", "u", "two", "1", "merge", "both"), ("d3", "u", "new", None, "create", ""), ("d4", "u", "odd", "1", "forget", ""), ("d5", "u", "same", "1", "skip", "")]
    decisions = spark.createDataFrame(rows, "decision_id string, user_id string, new_content string, existing_memory_id string, action string, merged_content string")
    after, applied = update.apply_decisions(m, decisions, AS_OF)
    got = sorted((r["content"], r["version"], r["status"], len(r["parent_memory_ids"]), r["importance_score"], r["memory_layer"]) for r in after.collect())
    assert got == [("both", 4, "active", 3, 0.9, "episodic"), ("new", 1, "active", 0, 0.5, "episodic"), ("one", 3, "superseded", 2, 0.9, "episodic"), ("text", 2, "superseded", 1, 0.9, "semantic")]
    assert {r["decision_id"] for r in applied.filter("applied").collect()} == {"d1", "d2", "d3", "d5"}
    matched = spark.createDataFrame([("x", "create"), ("y", None), ("z", None)], "decision_id string, action string").withColumn("merged_content", F.lit(None).cast("string"))
    given = spark.createDataFrame([("y", None, None, None, None)], "decision_id string, action string, reason string, merged_content string, confidence double")
    assert {r["decision_id"]: (r["action"], r["confidence"]) for r in update.decide(matched, given).collect()} == {"x": ("create", 1.0), "y": ("skip", 0.8), "z": ("create", 0.5)}


def test_reflections(spark):
    m = memory(spark, *({"memory_id": str(i), "created_at": NOW - dt.timedelta(hours=i), "content": f"c{i}"} for i in range(10)))
    assert reflect.due(m).first()["n"] == 10 and reflect.due(m.limit(9)).count() == 0
    asked = reflect.inputs(m, Defaults(reflect_newest=4))
    assert asked.first()["ids"] == ["0", "1", "2", "3"] and asked.first()["text"].startswith("- c0\n- c1")
    given = asked.select("user_id", "namespace", F.expr("array(named_struct('content', 'r', 'confidence', cast(null as double), 'supporting_indices', array(1, 9, -1)))").alias("reflections"))
    r = reflect.store(asked, given, AS_OF)[0].first()
    assert (r["memory_type"], r["memory_layer"], r["parent_memory_ids"], r["confidence_score"]) == ("reflection", "semantic", ["1"], 0.7)


def test_graph(spark):
    e = spark.createDataFrame([("a", "b", "knows"), ("b", "c", "knows"), ("c", "d", "knows"), ("a", "x", "owns")], "src string, dst string, rel string")
    got = {(r["node"], r["hops"], r["rel"]) for r in graph.related(spark.createDataFrame([("a",)], "entity_id string"), e).collect()}
    assert got == {("b", 1, "knows"), ("x", 1, "owns"), ("c", 2, "knows")}
    m = memory(spark, {"memory_id": "3", "parent_memory_ids": ["2"]}, {"memory_id": "2", "parent_memory_ids": ["1", "3"]})
    assert {(r["memory_id"], r["ancestor"], r["hops"]) for r in graph.ancestors(m).collect()} == {("3", "2", 1), ("3", "1", 2), ("2", "1", 1), ("2", "3", 1)}
    assert graph.link(e.withColumn("props", F.expr("map('k', '1')")), spark.createDataFrame([("a",), ("b",)], "entity_id string")).count() == 1


def test_evaluation(spark):
    q = spark.createDataFrame([("q",), ("none",)], "query_id string")
    results = spark.createDataFrame([("q", "m1", 1), ("q", "m2", 2), ("q", "m3", 3)], "query_id string, memory_id string, rank int")
    wanted = spark.createDataFrame([("q", "m2"), ("q", "m8"), ("q", "m9"), ("q", "m7"), ("q", "m6")], "query_id string, memory_id string")
    r = evaluate.per_query(q, results, wanted).filter("query_id = 'q'").first()
    ideal = 1 + 1 / math.log2(5) + 1 / math.log2(6)
    assert (r["p1"], r["p3"], r["p5"], r["r5"], r["rr"]) == (0, pytest.approx(1 / 3), 0.2, 0.2, 0.5) and r["ndcg5"] == pytest.approx(1 / math.log2(3) / ideal)
    s = evaluate.summary(evaluate.per_query(q, results, wanted)).first()
    assert s["p3"] == pytest.approx(1 / 6) and s["f3"] == pytest.approx(2 * (1 / 6) * 0.1 / (1 / 6 + 0.1))
    judged = spark.createDataFrame([(True, True), (True, False), (False, True), (False, False)], "contradicts boolean, is_contradiction boolean")
    assert evaluate.contradiction_quality(judged).first()["f1"] == 0.5
    assert evaluate.contradiction_quality(judged.limit(0)).first()["f1"] == 0
    assert evaluate.eval_row(s and judged.limit(1), "e", "r", {"k": "v"}, AS_OF).first()["config"] == {"k": "v"}
    assert evaluate.first_of_text(spark.createDataFrame([(1, "a"), (2, "a")], "n int, query_text string"), "n").first()["n"] == 1


def test_catalog_and_sources(spark, tmp_path):
    m = memory(spark, *({"memory_id": str(i), "created_at": NOW - dt.timedelta(hours=i)} for i in range(6)))
    assert [r["memory_id"] for r in catalog.list_memories(m, user_id="u", limit=2, offset=1).orderBy("place").collect()] == ["1", "2"]
    gone = catalog.soft_delete(m, m.filter("memory_id = '3'"), AS_OF)
    assert catalog.count_active(gone).first()["n"] == 5
    assert [(r["memory_id"], r["operation"]) for r in catalog.audit_log(m, gone, AS_OF).collect()] == [("3", "delete")]
    tables.write_table(m, f"{tmp_path}/m", "overwrite", buckets=2)
    assert tables.read_table(spark, f"{tmp_path}/m", MEMORIES).count() == 6
    v = spark.createDataFrame([("1", [1.0], 1), ("2", [2.0], 1)], "memory_id string, embedding array<double>, seq int")
    new = spark.createDataFrame([("1", [9.0], 2)], "memory_id string, embedding array<double>, seq int")
    assert [(r["memory_id"], r["embedding"]) for r in tables.upsert_vectors(v, new, v.filter("memory_id = '2'")).collect()] == [("1", [9.0])]


def test_sessions_vectors_replies(spark):
    e = spark.createDataFrame([("s", i, "tool" if i % 2 else "turn", f"r{i}", f"c{i}") for i in range(10)], "session_id string, seq long, kind string, role_or_tool string, content string")
    r = sessions.working_memory(e, Defaults(tool_outputs=2)).first()
    assert [t["content"] for t in r["turns"]] == ["c0", "c2", "c4", "c6", "c8"] and [t["output"] for t in r["tool_outputs"]] == ["c7", "c9"]
    assert value(spark, vectors.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0
    rows = vectors.embed(spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "k int, content string"), dim=16).collect()
    by = {r["k"]: r["embedding"] for r in rows}
    assert by[1] == by[2] != by[3] and by[4] is None and len(by[1]) == 16
    reply = value(spark, replies.contradiction_reply(F.lit('```json\n{"contradicts": true, "contradiction_type": "odd"}\n```')))
    assert (reply["contradicts"], reply["confidence"], reply["contradiction_type"]) == (True, 0.5, "direct_conflict")
    assert value(spark, replies.classify(F.lit(" Yes "), ["no", "yes"])) == "yes" and value(spark, replies.classify(F.lit("?"), ["no", "yes"])) == "no"
    assert value(spark, replies.prompt("A {x}", x=F.lit("b"))) == "A b"


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(f"o{i}", "s", "u", "a", f"text {i}" if i else "", "user_message", NOW, None, None, None) for i in range(25)], OBSERVATIONS)
    rows.coalesce(1).write.json(f"{tmp_path}/in")
    jobs.stream_ingest(tables.read_observations(spark, f"{tmp_path}/in", streaming=True), AS_OF, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 24
    stream = spark.readStream.schema(MEMORIES).parquet(f"{tmp_path}/out")
    q = jobs.reflection_triggers(stream).writeStream.format("memory").queryName("due").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/s2").start()
    q.awaitTermination()
    assert sorted(r["n"] for r in spark.table("due").collect()) == [10, 20]


def test_session_memory_over_several_batches(spark, tmp_path):
    """The state carries turns and the last tool outputs from batch to batch; the latest row is that of the whole session."""
    schema = "session_id string, seq long, kind string, role_or_tool string, content string"
    rows = [("s", i, "tool" if i % 2 else "turn", f"r{i}", f"c{i}" if i != 4 else None) for i in range(10)] + [("t", 0, "tool", "x", "")]
    for part in (rows[:6], rows[6:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    jobs.session_memory(stream, 2, None).writeStream.format("memory").queryName("sessions").outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/s").start().awaitTermination()
    got = {r["session_id"]: r for r in spark.table("sessions").orderBy("n_events").collect()}
    assert got["s"]["n_events"] == 10 and got["t"]["turns"] == []
    assert sorted((t["role"], t["content"] or "") for t in got["s"]["turns"]) == [("r0", "c0"), ("r2", "c2"), ("r4", ""), ("r6", "c6"), ("r8", "c8")]
    assert len(got["s"]["tool_outputs"]) == 2 and [tuple(t) for t in got["t"]["tool_outputs"]] == [("x", "")]


def test_session_updates_and_restart(spark, tmp_path):
    """Each micro-batch gives what is new; state and tool outputs survive a restart from the checkpoint."""
    schema = "session_id string, seq long, kind string, role_or_tool string, content string"
    rows = [("s", i, "tool" if i % 3 else "turn", f"r{i}", f"c{i}" if i != 6 else None) for i in range(24)] + [("t", 30, "turn", "x", "")]
    jobs.keep_state_in_rocksdb(spark)
    try:
        for k, part in enumerate((rows[:7], rows[7:12], rows[12:])):
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
            query = jobs.session_updates(stream, 2, None).writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/state")
            query.foreachBatch(lambda batch, n: batch.write.mode("append").parquet(f"{tmp_path}/out")).start().awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    updates = spark.read.parquet(f"{tmp_path}/out")
    assert sorted((r.session_id, r.n_events, len(r.turns)) for r in updates.collect()) == [("s", 7, 3), ("s", 12, 1), ("s", 24, 4), ("t", 1, 1)]
    got = {r.session_id: r for r in jobs.whole_sessions(updates).collect()}
    assert [tuple(t) for t in got["s"].turns] == [(f"r{i}", f"c{i}" if i != 6 else None) for i in range(0, 24, 3)] and got["s"].n_events == 24
    assert [tuple(t) for t in got["s"].tool_outputs] == [("r22", "c22"), ("r23", "c23")] and got["t"].tool_outputs == []


def test_defaults():
    assert DEFAULTS.weight_semantic + DEFAULTS.weight_recency + DEFAULTS.weight_importance + DEFAULTS.weight_access == pytest.approx(1)
