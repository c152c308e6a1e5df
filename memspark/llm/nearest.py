"""Operator 9: approximate nearest neighbours by balanced posting lists.

There are about twice the square root of the rows in lists. Its centroids come from a bounded
sample and stay in memory as a graph of their neighbours, which is searched best first. Each
vector is written to the list of its nearest centroid and, if it lies near a boundary, to
further lists whose centroids are nearly as close. A query reads the lists whose centroids are
within a ratio of the distance to the nearest ones, and further ones in order of distance until
they hold more than ``k`` vec_ids, or all that there are. The ratio is measured: for
``MEASURED`` sampled rows the nearest of all rows are found by brute force, in one pass, and the
ratio is the least that reaches ``RECALL`` of them.

Lists are put together, or cut, to groups of bounded size, and queries to blocks; a block's queries
go once to each group that they read from, with the numbers of the lists that each of them reads.
Groups, and parts of the blocks, are the keys of the work, so a long list is work for many tasks.

Inner products become distances by one more coordinate, ``sqrt(1 - |v|**2)`` of vectors divided
by the largest norm, so no square overflows. Groups give each query its best ``k`` by the inner
product of the original vectors in double precision, and the best of all groups remain.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no
part, nor rows without vec_id; vectors of each length are searched by themselves, as products
between lengths do not exist; ties go to the smaller vec_id; equal vec_ids are one candidate
with their best score; products beyond doubles are infinite, and those of infinities of both signs
count as minus infinity; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memspark.llm.common import cut, small_batches
from memspark.llm.vectors import matrix, usable

K = 20
#: Sampled rows at least, and for each centroid; centroids at most; neighbours of a centroid in the graph.
SAMPLE, SAMPLE_EACH, MOST_CENTROIDS, DEGREE = 8192, 16, 4096, 16
#: A vector goes to lists within this ratio of its nearest distance, this many at most.
BOUNDARY, REPLICAS = 1.005, 4
#: Distances of a query are measured against the mean of so many least ones: the least alone says little where all are alike.
BASE = 16
#: Share of nearest rows that the reading ratio has to reach, and sampled rows whose nearest are found by brute force for that.
RECALL, MEASURED = 0.94, 256
#: Rows of a group and of a block of queries at most, numbers in them at most, and how many of both there are at least where rows suffice.
BLOCK, Q_BLOCK, VALUES, Q_VALUES, PARALLEL, LEAST = 8192, 1024, 1 << 19, 1 << 16, 64, 64
#: Blocks of queries that are compared with a group by one task.
PART = 64
#: Bytes of a batch that is sent on.
SENT = 4 << 20
#: Products of queries and rows that are held at once.
PRODUCTS = 1 << 21
#: Distances of points to centroids that are held at once.
DISTANCES = 4_000_000
#: Rows that a task holds before it reduces or sends them.
HELD = 400_000


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``a`` and ``b``."""
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None, :], 0)


def _chunks(n: int, width: int) -> Iterator[slice]:
    """``n`` rows in parts whose distances to ``width`` centroids may be held at once."""
    step = max(1, DISTANCES // max(1, width))
    return (slice(a, a + step) for a in range(0, n, step))


class CentroidGraph:
    """Centroids, each tied to its nearest ones; best-first search visits neighbours while they are within the ratio."""

    def __init__(self, centroids: np.ndarray, degree: int = DEGREE):
        self.centroids = centroids
        k = len(centroids)
        near = np.vstack([np.argsort(_squared(centroids[part], centroids), 1, kind="stable")[:, 1 : degree + 1] for part in _chunks(k, k)])
        ties: list[set[int]] = [set(x) for x in near.tolist()]
        for i, own in enumerate(near.tolist()):
            for j in own:
                ties[j].add(i)
        # A ring keeps the graph in one piece.
        for i in range(len(centroids)):
            ties[i] |= {(i + 1) % len(centroids), (i - 1) % len(centroids)} - {i}
        self.ties = [sorted(t) for t in ties]

    def search(self, v: np.ndarray, ratio: float) -> list[int]:
        """Centroids within ``ratio`` of the mean distance of the BASE nearest ones found, nearest first."""
        start = float(np.sqrt(((self.centroids[0] - v) ** 2).sum()))
        seen, queue, found = {0}, [(start, 0)], []
        nearest = [-start]  # the BASE least distances met, negated, as a heap
        limit = start
        while queue:
            d, i = heapq.heappop(queue)
            if d > limit * ratio * 1.05 and len(found) >= BASE:
                break
            found.append((d, i))
            new = [j for j in self.ties[i] if j not in seen]
            if new:
                seen.update(new)
                for g, j in zip(np.sqrt(((self.centroids[new] - v) ** 2).sum(1)).tolist(), new):
                    heapq.heappush(queue, (g, j))
                    if len(nearest) < BASE:
                        heapq.heappush(nearest, -g)
                    elif g < -nearest[0]:
                        heapq.heapreplace(nearest, -g)
                limit = -sum(nearest) / len(nearest)
        return [i for d, i in sorted(found) if d <= limit * ratio] or [min(found)[1]]


def balanced_centroids(points: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k-means on a sphere from evenly spread starts; a distance is weighted by how full its list is, so lists even out.

    ``points`` are of one norm, and centres are given it too: one in the middle of all would be near every query.
    """
    norm = float(np.sqrt((points * points).sum(1).max()))
    centres, load = points[np.linspace(0, len(points) - 1, k).astype(int)].copy(), np.ones(k)
    for _ in range(rounds):
        own = np.concatenate([(_squared(points[part], centres) * np.sqrt(load)[None, :]).argmin(1) for part in _chunks(len(points), k)])
        size = np.bincount(own, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        length = np.sqrt((sums * sums).sum(1))
        moved = length > 1e-9 * norm
        centres[moved] = sums[moved] * (norm / length[moved])[:, None]
        load = np.maximum(size / size.mean(), 0.25)
    return centres


def _lists_of(raised: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) of each vector's nearest centroid and of those nearly as close."""
    rows, lists = [np.zeros(0, int)], [np.zeros(0, int)]
    for part in _chunks(len(raised), len(centroids)):
        d = np.sqrt(_squared(raised[part], centroids))
        order = np.argsort(d, 1, kind="stable")[:, :REPLICAS]
        near = np.take_along_axis(d, order, 1)
        i, j = np.nonzero(near <= near[:, :1] * BOUNDARY + 1e-12)
        rows.append(i + part.start)
        lists.append(order[i, j])
    return np.concatenate(rows), np.concatenate(lists)


def _products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of the rows of ``q`` and the columns of ``v``; minus infinity where a product is no number."""
    with np.errstate(over="ignore", invalid="ignore"):
        out = q @ v
    out[np.isnan(out)] = -np.inf
    return out


def _true_nearest(rows: DataFrame, asked: pa.Table, k: int) -> list[tuple[int, np.ndarray]]:
    """(place of a query in ``asked``, its ``k`` nearest of all rows) by brute force; ``asked`` (vec_id, embedding) is small.

    A task keeps the best ``k`` of each query and sends their ids; the vectors of those that are left are fetched last.
    """
    ids, v = asked.column("vec_id").to_numpy(), matrix(asked.column("embedding"))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, found = np.full((len(v), 0), -np.inf), np.zeros((len(v), 0), np.int64)
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                new = part.column("vec_id").to_numpy()
                products = _products(v, matrix(part.column("embedding")).T)
                products[ids[:, None] == new[None, :]] = -np.inf
                score = np.hstack([score, products])
                found = np.hstack([found, np.broadcast_to(new, (len(v), len(new)))])
                top = np.argsort(-score, 1, kind="stable")[:, :k]
                score, found = np.take_along_axis(score, top, 1), np.take_along_axis(found, top, 1)
        q, m = np.nonzero(score > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(found[q, m]), pa.array(score[q, m])], ["q", "vec_id", "score"])

    found = rows.select("vec_id", "embedding").mapInArrow(best, "q int, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    kept = found.withColumn("place", place).filter(F.col("place") <= k).select("q", "vec_id").toArrow()
    wanted = rows.sparkSession.createDataFrame(pa.table({"vec_id": pa.array(sorted(set(kept.column("vec_id").to_pylist())), pa.int64())}))
    # One vector of each id that was found, MEASURED times k at most.
    vectors = rows.join(F.broadcast(wanted), "vec_id", "left_semi").groupBy("vec_id").agg(F.min("embedding").alias("embedding")).toArrow()
    by_id = dict(zip(vectors.column("vec_id").to_pylist(), matrix(vectors.column("embedding")))) if len(vectors) else {}
    return [(q, by_id[i]) for q, i in zip(kept.column("q").to_pylist(), kept.column("vec_id").to_pylist())]


def reading_ratio(asked: np.ndarray, near: list[tuple[int, np.ndarray]], centroids: np.ndarray, recall: float = RECALL) -> float:
    """The ratio of distances within which queries find a list of ``recall`` of their nearest rows; ``asked`` and ``near`` as points among the centroids."""
    if not near:
        return 1.0
    away = np.sqrt(_squared(asked, centroids))
    base = np.sort(away, 1)[:, :BASE].mean(1)
    row, held = _lists_of(np.array([v for _, v in near]), centroids)
    q = np.array([q for q, _ in near])[row]
    reached = np.full(len(near), np.inf)
    np.minimum.at(reached, row, away[q, held] / np.maximum(base[q], 1e-12))
    return float(np.sort(reached)[max(0, math.ceil(recall * len(reached)) - 1)])


def _as_queries(v: np.ndarray) -> np.ndarray:
    """Vectors as points among the raised ones: of norm 1, without height."""
    v = v / np.abs(v).max(1, keepdims=True)
    return np.hstack([v / np.sqrt((v * v).sum(1, keepdims=True)), np.zeros((len(v), 1))])


def _size(rows: int, most: int, values: int, dim: int) -> int:
    """Rows of a block: PARALLEL blocks of them, LEAST rows at least, and ``most`` and ``values`` numbers at most."""
    return max(1, min(most, values // dim, max(LEAST, -(-rows // PARALLEL))))


def _groups(sizes: np.ndarray, centroids: np.ndarray, each: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The first group of each list and how many it has (none if it is empty): lists are put together to about ``each`` rows, those near each other first, and cut above ``most``."""
    order = np.argsort(_squared(centroids, centroids[:: max(1, math.isqrt(len(centroids)))]).argmin(1), kind="stable")
    first, parts, group, held = np.zeros(len(sizes), np.int32), -(-sizes // most), -1, 0
    for i in order.tolist():
        if parts[i] and (parts[i] > 1 or group < 0 or held + sizes[i] > each):
            first[i], group, held = group + 1, group + parts[i], sizes[i] if parts[i] == 1 else each
        elif parts[i]:
            first[i], held = group, held + sizes[i]
    return first, parts.astype(np.int32)


def _addressed(part: int, ids: np.ndarray, v: np.ndarray, who: np.ndarray, at: np.ndarray, first: np.ndarray, parts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A block of queries, of which ``who`` reads list ``at``, as a row for each group with those that read from it; batches of about SENT bytes."""
    n = parts[at]
    group = np.repeat(first[at], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    who, at = np.repeat(who, n), np.repeat(at, n)
    order = np.lexsort((who, at, group))
    group, who, at = group[order], who[order], at[order]
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else []
    rows, size = [], 0
    for a, b in zip(starts, [*starts[1:], len(group)]):
        some, own = np.unique(who[a:b], return_inverse=True)
        rows.append((int(group[a]), part, 1, ids[some].astype("<i8").tobytes(), v[some].astype("<f8").tobytes(), at[a:b].astype("<u2").tobytes(), own.astype("<u2").tobytes()))
        size += sum(map(len, rows[-1][3:]))
        if size > SENT:
            yield _batch(rows)
            rows, size = [], 0
    if rows:
        yield _batch(rows)


_WORK = "grp int, part int, kind int, ids binary, vectors binary, lists binary, who binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32()] * 3 + [pa.binary()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)], [c.split()[0] for c in _WORK.split(", ")])


def _best(q: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each query the ``k`` best rows, a vec_id once."""
    order = np.lexsort((-score, ids, q))
    q, ids, score = q[order], ids[order], score[order]
    once = np.concatenate([[True], (q[1:] != q[:-1]) | (ids[1:] != ids[:-1])]) if len(q) else np.zeros(0, bool)
    q, ids, score = q[once], ids[once], score[once]
    order = np.lexsort((ids, -score, q))
    q, ids, score = q[order], ids[order], score[order]
    top = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[top], ids[top], score[top]


class _Group:
    """The rows of a group, in order of their ids."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, lists: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.v, lists = ids[order], v[order], lists[order]
        places = {x: np.flatnonzero(lists == x) for x in np.unique(lists).tolist()}
        self.lists = {x: (at, self.v[at].T) for x, at in places.items()}
        self.first = np.flatnonzero(np.concatenate([[True], self.ids[1:] != self.ids[:-1]]))

    def nearest(self, q_ids: np.ndarray, q: np.ndarray, at: np.ndarray, who: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, vec_id, score) of the ``k`` best rows of the lists that each query reads, for some queries at a time."""
        step = max(1, PRODUCTS // len(self.ids))
        own = np.searchsorted(self.ids, q_ids, "left"), np.searchsorted(self.ids, q_ids, "right")
        starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        reads = [(who[a:b], *self.lists[int(at[a])]) for a, b in zip(starts, [*starts[1:], len(at)]) if int(at[a]) in self.lists]
        for s in range(0, len(q), step):
            part = q[s : s + step]
            rough, may = np.full((len(part), len(self.ids)), -np.inf), np.zeros((len(part), len(self.ids)), bool)
            for x, places, v in reads:
                x = x[np.searchsorted(x, s) : np.searchsorted(x, s + step)].astype(int) - s
                if len(x):
                    rough[x[:, None], places[None, :]] = _products(part[x], v)
                    may[x[:, None], places[None, :]] = True
            for x in np.flatnonzero(own[0][s : s + step] < own[1][s : s + step]).tolist():
                mine = slice(own[0][s + x], own[1][s + x])
                rough[x, mine], may[x, mine] = -np.inf, False
            # Rows of one vec_id are one candidate, so they take one place of the k.
            each = rough if len(self.first) == len(self.ids) else np.maximum.reduceat(rough, self.first, 1)
            cut_at = np.partition(each, -k, 1)[:, [-k]] if each.shape[1] > k else np.full((len(part), 1), -np.inf)
            slack = 1e-9 * (1 + np.abs(np.where(np.isfinite(cut_at), cut_at, 0)))
            i, j = np.nonzero((rough >= cut_at - slack) & may)
            # Row by row in a fixed order, so that equal vectors have equal scores in every group.
            with np.errstate(over="ignore", invalid="ignore"):
                score = np.concatenate([(part[i[a : a + 50_000]] * self.v[j[a : a + 50_000]]).sum(1) for a in range(0, max(1, len(i)), 50_000)])
            score[np.isnan(score)] = -np.inf
            yield _best(q_ids[s + i], self.ids[j], score, k)


def search(embeddings: DataFrame, is_query, k: int = K, size: int | None = None) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` nearest rows to each row of ``embeddings`` (vec_id, embedding) for which ``is_query`` holds; ``size``: rows for each list."""
    columns = [F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")]
    rows = embeddings.select(*columns, F.coalesce(is_query, F.lit(False)).alias("asks")).filter(usable("embedding") & F.col("vec_id").isNotNull())
    lengths = [r[0] for r in rows.groupBy(F.size("embedding").alias("dim")).agg(F.max("asks").alias("asked")).filter("asked").orderBy("dim").collect()]
    if not lengths:
        return embeddings.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return reduce(DataFrame.union, (_search_length(rows.filter(F.size("embedding") == dim), dim, k, size) for dim in lengths))


def _search_length(rows: DataFrame, dim: int, k: int, size: int | None) -> DataFrame:
    """search() over vectors of one length, with the queries marked by ``asks``."""
    most = F.array_max(F.transform("embedding", F.abs))
    squares = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    total, asking, largest, norm = rows.agg(F.count("*"), F.count_if("asks"), F.max(most), F.sqrt(F.max(squares))).first()
    if not 1e-150 < norm < 1e150:  # squares may leave the doubles, so another bound of the norms is taken
        norm = min(largest * math.sqrt(dim), np.finfo(float).max)
    wanted = max(1, min(MOST_CENTROIDS, total // size if size else 2 * math.isqrt(total)))
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(SAMPLE, SAMPLE_EACH * wanted))
    sampled = drawn.select("vec_id", "embedding").toArrow()
    points = matrix(sampled.column("embedding"))

    def raise_up(v: np.ndarray) -> np.ndarray:
        v = v / norm
        return np.hstack([v, np.sqrt(np.maximum(1 - (v * v).sum(1, keepdims=True), 0))])

    raised = raise_up(points)
    graph = CentroidGraph(balanced_centroids(raised, min(wanted, len(points))))
    near = [(q, raise_up(v[None])[0]) for q, v in _true_nearest(rows, sampled.slice(0, MEASURED), k)]
    ratio = reading_ratio(_as_queries(points[:MEASURED]), near, graph.centroids)
    rows, is_query = rows.select("vec_id", "embedding", "asks"), F.col("asks")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            i, lists = _lists_of(raise_up(matrix(batch.column("embedding"))), graph.centroids)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(i)), batch.column("embedding").take(pa.array(i)), pa.array(lists.astype(np.int32))], ["vec_id", "embedding", "list"])

    def enough(v: np.ndarray, lists: list[int]) -> list[int]:
        """``lists``, and the next ones by distance while they hold ``k`` vec_ids or less."""
        if (have := sum(held[i] for i in lists)) <= k:
            for i in np.argsort(((graph.centroids - v) ** 2).sum(1), kind="stable").tolist():
                if i not in lists:
                    lists.append(i)
                    have += held[i]
                    if have > k:
                        break
        return lists

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, q_block):
                some = batch.slice(a, q_block)
                ids, v = some.column("vec_id").to_numpy(), matrix(some.column("embedding"))
                lists = [enough(x, graph.search(x, ratio)) for x in _as_queries(v)]
                who, at = np.repeat(np.arange(len(v)), [len(x) for x in lists]), np.array([x for own in lists for x in own], int)
                yield from _addressed(zlib.crc32(ids.tobytes()) % q_parts, ids, v, who, at, first, parts)

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        row = (key[0].as_py(), 0, 0, *(x.tobytes() for x in (table.column("vec_id").to_numpy().astype("<i8"), matrix(table.column("embedding")).astype("<f8"), table.column("list").to_numpy().astype("<u2"))), None)
        return pa.Table.from_batches([_batch([row])])

    postings = cut(rows.select("vec_id", "embedding").mapInArrow(assign, "vec_id long, embedding array<double>, list int"), "postings")
    # Each vec_id counts in one of its lists only, so lists together hold as many as the sum at least.
    counted = postings.groupBy("vec_id").agg(F.min("list").alias("list")).groupBy("list").count().collect()
    held, sizes = [0] * len(graph.centroids), np.zeros(len(graph.centroids), int)
    for r in counted:
        held[r["list"]] = r["count"]
    for r in postings.groupBy("list").count().collect():
        sizes[r["list"]] = r["count"]
    first, parts = _groups(sizes, graph.centroids, _size(int(sizes.sum()), BLOCK, VALUES, dim), max(1, min(BLOCK, VALUES // dim)))
    q_block = _size(asking, Q_BLOCK, Q_VALUES, dim)
    q_parts = -(-asking // (q_block * PART))

    addresses = rows.sparkSession.createDataFrame(pa.table({"list": pa.array(range(len(first)), pa.int32()), "first": pa.array(first), "parts": pa.array(parts)}))
    grouped = postings.join(F.broadcast(addresses), "list").select("vec_id", "embedding", "list", (F.col("first") + F.pmod(F.xxhash64("vec_id"), "parts")).cast("int").alias("grp"))
    packed = grouped.groupBy("grp").applyInArrow(pack, _WORK).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(q_parts - 1))))
    asked = rows.filter(is_query).select("vec_id", "embedding").mapInArrow(route, _WORK)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each group's rows come first, then the queries that read from it. What a task finds for a query in several groups is reduced before it is sent on."""
        found, size, at, group = [], 0, None, None
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r].as_py() for c in batch.schema.names}
                ids, v, lists = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["vectors"], "<f8").reshape(-1, dim), np.frombuffer(row["lists"], "<u2")
                if row["kind"] == 0:
                    at, group = (row["grp"], row["part"]), _Group(ids, v, lists)
                    continue
                if at != (row["grp"], row["part"]):  # a part of a list that got no rows
                    continue
                for some in group.nearest(ids, v, lists, np.frombuffer(row["who"], "<u2"), k):
                    found.append(some)
                    size += len(some[0])
                if size > HELD:
                    found = [_best(*map(np.concatenate, zip(*found)), k)]
                    size = len(found[0][0])
                    if size > HELD // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in found[0]], ["query_id", "vec_id", "score"])
                        found, size = [], 0
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _best(*map(np.concatenate, zip(*found)), k)], ["query_id", "vec_id", "score"])

    work = packed.unionByName(asked).repartition("grp", "part").sortWithinPartitions("grp", "part", "kind")
    found = work.mapInArrow(compare, "query_id long, vec_id long, score double")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    with small_batches(rows.sparkSession, SENT):
        return cut(once.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), "nearest")
