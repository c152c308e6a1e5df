"""The vector operators against brute force."""

import math
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from memspark.llm import embedding_dedup, nearest
from memspark.llm.components import components


@pytest.fixture(scope="session")
def vectors(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(120, 8))
    rows = [list(v) for v in base] + [list(base[3])] * 30 + [list(base[5] + rng.normal(size=8) * 0.15) for _ in range(40)] + [list(base[7] * 4)]
    rows = [[float(x) for x in v] for v in rows]
    table = [(i, v, 1) for i, v in enumerate(rows)]
    odd = [None, [], [0.0] * 8, [1.0, None] + [0.0] * 6, [math.nan] + [1.0] * 7, [math.inf] + [1.0] * 7, [1.0, 2.0]]
    table += [(500 + i, v, None) for i, v in enumerate(odd)] + [(None, rows[0], 2)]
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>, label int").repartition(3)
    return df, {i: np.array(v) for i, v, _ in table if i is not None and i < 500}, [500 + i for i in range(len(odd))]


def test_embedding_dedup(spark, vectors):
    df, good, odd = vectors
    ids = sorted(good)
    v = np.array([good[i] for i in ids])
    u = v / np.linalg.norm(v, axis=1)[:, None]
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    label = {i: i for i in ids}
    for _ in ids:
        for a, b in zip(*np.nonzero(link)):
            label[a] = label[b] = min(label[a], label[b])
    for block in (2048, 16):
        got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.link(df, sample=64, block=block).collect()}
        assert {i: got[i] for i in ids} == {i: (int(link[i].sum()), label[i], label[i] == i) for i in ids}
        assert {i: got[i] for i in odd} == {i: (0, i, True) for i in odd}
        assert got[None] == (0, None, False)
    assert embedding_dedup.link(df.limit(0)).count() == 0


def test_dual_traversal_loses_nothing():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 16))
    a, b = (embedding_dedup._unit(centres[rng.integers(0, 20, n)] + rng.normal(size=(n, 16)) * 0.3).astype(np.float32) for n in (300, 200))
    mask = embedding_dedup.dual_traversal(a, embedding_dedup.Tree(a), b, embedding_dedup.Tree(b), 0.9)
    assert not ((a @ b.T >= 0.9) & ~mask).any() and mask.mean() < 0.5


def test_nearest(spark, vectors):
    df, good, _ = vectors
    got = {}
    for r in nearest.search(df, F.col("vec_id") % 20 == 0, 20).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    found = 0
    for q in (i for i in good if i % 20 == 0):
        want = sorted(((-float((good[q] * v).sum()), i) for i, v in good.items() if i != q))[:20]
        assert [k for k, _, _ in got[q]] == list(range(1, 21))
        found += len({i for _, i in want} & {i for _, i, _ in got[q]})
        assert all(s == pytest.approx(float((good[q] * good[i]).sum())) for _, i, s in got[q])
    assert found >= 0.9 * 20 * len(got)
    assert nearest.search(df.limit(0), F.lit(True)).count() == 0
    few = nearest.search(df.filter("vec_id < 5"), F.lit(True)).collect()
    assert len(few) == 5 * 4


def test_vec_ids_with_several_vectors(spark):
    """They tie their components together; equal rows are one."""
    rows = [(5, [1.0, 0.0]), (7, [1.0, 0.0]), (7, [0.0, 1.0]), (9, [0.0, 1.0]), (9, [0.0, 1.0]), (11, [-1.0, 0.0]), (12, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.link(df).collect())
    assert got == [(5, 1, 5, True), (7, 1, 5, False), (7, 1, 5, False), (9, 1, 5, False), (9, 1, 5, False), (11, 0, 11, True), (12, 0, 12, True)]


def test_nearest_by_length_ties_and_shared_ids(spark):
    """Each length is searched by itself, ties go to the smaller vec_id, and a vec_id is one candidate."""
    rows = [(i, [1.0, 0.0]) for i in range(6)] + [(6, [2.0, 0.0]), (6, [3.0, 0.0]), (7, [0.5, 0.0])] + [(20 + i, [float(i), 1.0, 0.0]) for i in range(4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in nearest.search(df, F.col("vec_id").isin(0, 7, 20, 23), 3).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got == {0: [(6, 3.0), (1, 1.0), (2, 1.0)], 7: [(6, 1.5), (0, 0.5), (1, 0.5)], 20: [(21, 1.0), (22, 1.0), (23, 1.0)], 23: [(22, 7.0), (21, 4.0), (20, 1.0)]}


@pytest.mark.parametrize("spread", [0.0, 0.5])
def test_nearest_recall_with_blocks(spark, monkeypatch, spread):
    """Forty lists and more, some in several blocks; vectors of one norm and of many: recall against brute force."""
    monkeypatch.setattr(nearest, "BLOCK", 64)
    rng = np.random.default_rng(11)
    v = np.vstack([rng.normal(size=(1200, 12)), rng.normal(size=12) + rng.normal(size=(800, 12)) * 0.1])
    v = v / np.linalg.norm(v, axis=1)[:, None] * np.exp(rng.normal(size=len(v)) * spread)[:, None]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(3)
    score = v @ v.T
    np.fill_diagonal(score, -np.inf)
    hits = total = 0
    for r in nearest.search(df, F.col("vec_id") % 20 == 0).collect():
        least = np.sort(score[r["query_id"]])[-20]
        hits += score[r["query_id"], r["vec_id"]] >= least - 1e-9
        total += 1
    assert total == 100 * 20 and hits >= 0.9 * total


def test_nearest_with_many_small_lists(spark):
    """Dozens of lists, outliers that own a centroid, and groups of fewer rows than are asked for: all places are filled."""
    rng = np.random.default_rng(3)
    hot = rng.normal(size=16)
    rows = [hot + rng.normal(size=16) * 0.05 for _ in range(150)]
    rows += [c + rng.normal(size=16) * 0.02 for c in rng.normal(size=(25, 16)) for _ in range(12)]
    rows += list(rng.normal(size=(50, 16)))
    v = np.array(rows)
    v /= np.linalg.norm(v, axis=1)[:, None]
    table = [(i, x.tolist()) for i, x in enumerate(v)] + [(n, v[0].tolist()) for n in (0, 0, 1)]
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>").repartition(3)
    score = v @ v.T
    score[:, 1] = np.maximum(score[:, 1], score[:, 0])
    for size, k in ((10, 20), (40, 20), (10, 600)):
        got = {}
        for r in nearest.search(df, F.col("vec_id") % 5 == 0, k, size).collect():
            got.setdefault(r["query_id"], set()).add(r["vec_id"])
        assert {q: len(x) for q, x in got.items()} == {q: min(k, len(v) - 1) for q in range(0, len(v), 5)}
        if k == 20:
            # Groups of 12: the 11 others of the group are the nearest.
            assert all(len(got[q] & set(range(q - (q - 150) % 12, q - (q - 150) % 12 + 12))) == 11 for q in range(150, 450, 5))


def test_components(spark):
    links = [(i + 1, i) for i in range(40)] + [(100, 101), (103, 100), (105, 104)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and got[101] == got[103] == 100 and got[105] == 104


@pytest.mark.parametrize("huge", [1e154, 1e200, 1.7e308, 1e-200])
def test_nearest_with_norms_far_apart(spark, huge):
    """One vector whose square leaves the doubles (or all others' do): every query keeps all its places."""
    rng = np.random.default_rng(5)
    v = rng.normal(size=(60, 6))
    v[7] *= huge / np.abs(v[7]).max()
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(3)
    got = {}
    for r in nearest.search(df, F.lit(True), 10, 5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    with np.errstate(over="ignore", invalid="ignore"):
        score = np.array([[np.nan_to_num((a * b).sum(), nan=-np.inf, posinf=np.inf, neginf=-np.inf) for b in v] for a in v])
    hits = 0
    for q in range(60):
        want = sorted((-score[q, i], i) for i in range(60) if i != q)[:10]
        assert [k for k, _, _ in sorted(got[q])] == list(range(1, 11))
        assert all(x == score[q, i] or math.isclose(x, score[q, i], rel_tol=1e-9) for _, i, x in got[q])
        hits += len({i for _, i in want} & {i for _, i, _ in got[q]})
    assert hits >= 0.9 * 600


def test_centroids_of_many_lists_in_bounded_memory():
    """4096 lists: distances are held in parts, and the graph and the lists are those of whole matrices."""
    import tracemalloc

    rng = np.random.default_rng(2)
    points = rng.normal(size=(20000, 8))
    points /= np.linalg.norm(points, axis=1)[:, None]
    tracemalloc.start()
    graph = nearest.CentroidGraph(nearest.balanced_centroids(points, 4096, rounds=1))
    rows, lists = nearest._lists_of(points, graph.centroids)
    assert tracemalloc.get_traced_memory()[1] < 300e6
    tracemalloc.stop()
    some = rng.integers(0, len(points), 200)
    nearest_list = ((points[some][:, None] - graph.centroids[None]) ** 2).sum(2).argmin(1)
    held = {}
    for i, j in zip(rows.tolist(), lists.tolist()):
        held.setdefault(i, set()).add(j)
    assert len(held) == len(points) and all(j in held[i] for i, j in zip(some.tolist(), nearest_list.tolist()))


def test_nearest_copies_a_query_once_for_a_group(spark):
    """What is written between the steps grows with the rows, not with the lists that a query reads; batches of addressed queries are bounded."""
    rng = np.random.default_rng(17)
    v = rng.normal(size=(3000, 16))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(2)
    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    held = lambda: sum(p.stat().st_size for p in folder.rglob("*.parquet"))
    before = held()
    assert nearest.search(df, F.lit(True)).count() == 3000 * 20
    assert held() - before < 4 * v.nbytes

    lists, queries, dim = 4096, 256, 64
    first, parts = nearest._groups(np.full(lists, 100), rng.normal(size=(lists, dim)), 400, 8192)
    assert sorted(np.bincount(first)) == [4] * (lists // 4) and set(parts) == {1}
    who, at = np.repeat(np.arange(queries), lists), np.tile(np.arange(lists), queries)
    reads = 0
    for batch in nearest._addressed(0, np.arange(queries), rng.normal(size=(queries, dim)), who, at, first, parts):
        assert batch.nbytes < 2 * nearest.SENT
        reads += sum(len(x.as_py()) // 2 for x in batch.column("who"))
    assert reads == lists * queries


def test_lists_are_put_together_and_cut():
    """Empty lists have no group, small ones share one, large ones have several of their own."""
    first, parts = nearest._groups(np.array([0, 10, 250, 20, 60]), np.arange(5.0)[:, None], 50, 100)
    assert parts.tolist() == [0, 1, 3, 1, 1]
    assert first.tolist()[1:] == [0, 1, 4, 5]
    rows = [nearest._addressed(0, np.arange(2), np.eye(2), np.array([0, 0, 0, 1]), np.array([0, 1, 2, 4]), first, parts)]
    got = [(r["grp"], np.frombuffer(r["ids"], "<i8").tolist(), np.frombuffer(r["lists"], "<u2").tolist(), np.frombuffer(r["who"], "<u2").tolist()) for batches in rows for b in batches for r in b.to_pylist()]
    assert got == [(0, [0], [1], [0]), (1, [0], [2], [0]), (2, [0], [2], [0]), (3, [0], [2], [0]), (5, [1], [4], [0])]


def test_nearest_where_a_part_of_a_list_is_empty(spark, monkeypatch):
    """Rows of one vec_id go to one part of a list, however many parts its rows ask for."""
    monkeypatch.setattr(nearest, "BLOCK", 4)
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1])] + [(3, [0.8, 0.1])] * 30, "vec_id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in nearest.search(df, F.col("vec_id") < 3, 5).collect())
    assert got == [(1, 1, 2), (1, 2, 3), (2, 1, 1), (2, 2, 3)]
