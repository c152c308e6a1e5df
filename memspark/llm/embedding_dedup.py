"""Operator 10: near-duplicate vectors by dual traversal of cover trees, exact.

Vectors are put on the unit sphere, where cosine >= t means a distance of at most
``sqrt(2 - 2t)``. The upper levels of a cover tree (nested nets of halving radii) come from a
bounded sample and give at most ``MOST_NODES`` nodes; every vector goes to the nearest one, and
the covering radii are measured over all vectors. Pairs of nodes that their radii keep apart
are pruned. A node's vectors lie in blocks of about ``BLOCK``, each with the lower levels as a
tree of its own; pairs of blocks are traversed level by level, and at each level node pairs
whose centres are further apart than the threshold and both radii are pruned. What is left at
the leaves is decided in double precision on the original vectors.

Equal vectors are one node with a count. A block pair returns, for each vector, how many
others it links to, and a spanning forest of the links, never the pairs: a group of near
copies costs its size. Pruning depends on the data: without any structure above the threshold
every pair of blocks is compared at the leaves.

Defined cases: a vector that is null, empty, zero or holds null or non-finite components links
with nothing, as do vectors of different lengths; rows that are equal in vec_id and vector are
one; rows of one vec_id with different vectors are in one component, and n_links is that of each
row's own vector; a null vec_id takes no part (its component is null, kept is false); an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.llm.common import cut, key128
from memspark.llm.components import components
from memspark.llm.vectors import least_nets, matrix, usable

THRESHOLD = 0.9
SAMPLE, MOST_NODES, BLOCK = 2048, 256, 2048
LEVELS = 6
#: Allowance for single precision in distances, and in cosines.
SLACK, NARROW = 1e-3, 1e-4

_BLOCK = "node int, chunk int, ids binary, counts binary, vectors binary, tree binary, dim int"


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def _unit(v: np.ndarray) -> np.ndarray:
    scaled = v / np.abs(v).max(1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


class Tree:
    """Levels of halving radii over the rows of a matrix; the last level holds every row."""

    def __init__(self, unit: np.ndarray):
        d = _distances(unit, unit)
        np.fill_diagonal(d, 0)
        radii = [2.0 / 2**i for i in range(LEVELS)]
        nets = [net for net in least_nets(d, radii) if len(net) <= len(unit) // 2] or [np.zeros(1, np.int64)]
        nets.append(np.arange(len(unit)))
        leaf = nets[-1]
        #: For each level: rows of the centres, covering radii, and the place of each centre's parent one level above.
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        ups = []
        for above, net in zip(nets, nets[1:]):
            ups.append(d[np.ix_(net, above)].argmin(1))
        for k, net in enumerate(nets):
            at = np.arange(len(leaf))
            for up in reversed(ups[k:]):
                at = up[at]
            radius = np.zeros(len(net))
            np.maximum.at(radius, at, d[leaf, net[at]])
            self.levels.append((net, radius, ups[k - 1] if k else np.zeros(len(net), np.int64)))


def dual_traversal(a: np.ndarray, tree_a: Tree, b: np.ndarray, tree_b: Tree, threshold: float) -> np.ndarray:
    """Places (i, j) that no bound keeps apart, as a boolean matrix over the rows of both; of the unit vectors ``a`` and ``b``."""
    reach = math.sqrt(2 - 2 * threshold) + SLACK
    depth = max(len(tree_a.levels), len(tree_b.levels))
    alive = np.ones((1, 1), bool)
    for k in range(depth):
        rows, radius_a, up_a = tree_a.levels[min(k, len(tree_a.levels) - 1)]
        cols, radius_b, up_b = tree_b.levels[min(k, len(tree_b.levels) - 1)]
        if k >= len(tree_a.levels):
            up_a = np.arange(len(rows))
        if k >= len(tree_b.levels):
            up_b = np.arange(len(cols))
        if k:
            alive = alive[np.ix_(up_a, up_b)]
        else:
            alive = np.ones((len(rows), len(cols)), bool)
        i, j = np.flatnonzero(alive.any(1)), np.flatnonzero(alive.any(0))
        if not len(i):
            return np.zeros((len(a), len(b)), bool)
        # In terms of cosines, so that a level costs one product: distance > reach + both radii. Leaves have no radius.
        limit = reach
        if radius_a.any() or radius_b.any():
            limit = np.minimum(np.float32(reach) + radius_a[i].astype(np.float32)[:, None] + radius_b[j].astype(np.float32)[None, :], np.float32(2))
        if len(i) == len(rows) and len(j) == len(cols):
            alive &= a[rows] @ b[cols].T >= 1 - limit * limit / 2 - NARROW
        else:
            near = a[rows[i]] @ b[cols[j]].T >= 1 - limit * limit / 2 - NARROW
            alive[np.ix_(i, j)] &= near
    return alive


def _forest(mask: np.ndarray, ids_a: np.ndarray, ids_b: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links between two blocks: no more links than vectors."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in np.flatnonzero(mask.any(1)).tolist():
        root = find(int(ids_a[i]))
        for y in np.unique([find(int(y)) for y in ids_b[np.flatnonzero(mask[i])].tolist()]).tolist():
            if y != root:
                parent[max(root, y)] = root = min(root, y)
    return [(x, r) for x in list(parent) if (r := find(x)) != x]


def _nodes(vectors: DataFrame, sample: int) -> list[np.ndarray]:
    """Centres of the upper levels, for each length of vector in a bounded sample."""
    got = vectors.orderBy(F.xxhash64("rep"), "rep").limit(sample).select("embedding").collect()
    by_dim: dict[int, list] = {}
    for (v,) in got:
        by_dim.setdefault(len(v), []).append(v)
    out = []
    for rows in by_dim.values():
        unit = _unit(np.array(rows, np.float64))
        nets = least_nets(_distances(unit, unit), [2.0 / 2**i for i in range(LEVELS)])
        out.append(unit[[n for n in nets if len(n) <= max(1, MOST_NODES // len(by_dim))][-1]])
    return out


def link(embeddings: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row of ``embeddings`` (vec_id, embedding)."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.withColumn("key", F.when(usable("embedding") & F.col("vec_id").isNotNull(), key128("embedding")))
    members = cut(rows.filter("key IS NOT NULL").groupBy("key", "vec_id").agg(F.any_value("embedding").alias("embedding")), "members")
    classes = cut(members.groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.any_value("embedding").alias("embedding")), "vectors")
    # Classes that share a vec_id are tied together.
    reps = members.select("key", "vec_id").join(classes.select("key", "rep"), "key").select("vec_id", "rep")
    several = reps.groupBy("vec_id").agg(F.min("rep").alias("v"), F.max("rep").alias("last")).filter("v < last")
    ties = reps.join(several, "vec_id").filter("rep <> v").select(F.col("rep").alias("u"), "v").distinct()
    nodes = _nodes(classes, sample)
    first = np.cumsum([0, *map(len, nodes)]).tolist()
    dims = {n.shape[1]: (n, f) for n, f in zip(nodes, first)}
    rest = first[-1]  # nodes without a centre, one for each length that the sample lacks

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column("embedding").offsets.to_numpy())
            node, away = np.zeros(batch.num_rows, np.int32), np.full(batch.num_rows, 2.0)
            for dim in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == dim)
                if dim not in dims:
                    node[own] = rest + dim
                    continue
                centres, at = dims[dim]
                d = _distances(_unit(matrix(batch.column("embedding").take(pa.array(own)))), centres)
                node[own], away[own] = at + d.argmin(1), d.min(1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("rep", "n", "embedding")), pa.array(node), pa.array(away)], ["rep", "n", "embedding", "node", "away"])

    placed = cut(classes.select("rep", "n", "embedding").mapInArrow(place, "rep long, n long, embedding array<double>, node int, away double"), "placed")
    sizes = placed.groupBy("node").agg(F.count("*").alias("vectors"), F.max("away").alias("radius"), F.first(F.size("embedding")).alias("dim")).collect()
    chunks = {r["node"]: -(-r["vectors"] // block) for r in sizes}
    centre = {f + i: (dim, n[i]) for dim, (n, f) in dims.items() for i in range(len(n))}
    reach = math.sqrt(2 - 2 * threshold) + SLACK
    pairs = []
    for i, a in enumerate(sizes):
        for b in sizes[i:]:
            if a["dim"] != b["dim"]:
                continue
            if a["node"] in centre and b["node"] in centre and float(np.linalg.norm(centre[a["node"]][1] - centre[b["node"]][1])) > reach + a["radius"] + b["radius"]:
                continue
            pairs.append((a["node"], b["node"], chunks[a["node"]], chunks[b["node"]]))

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        v = matrix(table.column("embedding"))
        ids, counts = (table.column(c).to_numpy().astype("<i8").tobytes() for c in ("rep", "n"))
        return pa.table({"node": pa.array([key[0].as_py()], pa.int32()), "chunk": pa.array([key[1].as_py()], pa.int32()), "ids": [ids], "counts": [counts], "vectors": pa.array([v.astype("<f8").tobytes()], pa.binary()), "tree": pa.array([pickle.dumps(Tree(_unit(v).astype(np.float32)))], pa.binary()), "dim": pa.array([v.shape[1]], pa.int32())})

    spark = embeddings.sparkSession
    chunk_of = F.create_map(*(F.lit(x) for kv in chunks.items() for x in kv)) if chunks else None
    if not chunks:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    own = placed.withColumn("chunk", F.pmod(F.xxhash64("rep"), chunk_of[F.col("node")]).cast("int"))
    blocks = cut(own.groupBy("node", "chunk").applyInArrow(pack, _BLOCK), "blocks")
    both = spark.createDataFrame(pairs, "a int, b int, of_a int, of_b int")
    both = both.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("of_a") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("of_b") - 1)))
    both = both.filter("a <> b OR i <= j").select("a", "b", "i", "j")
    side = lambda x, y: blocks.select(F.col("node").alias(x), F.col("chunk").alias(y), *(F.col(c).alias(f"{c}_{x}") for c in ("ids", "counts", "vectors", "tree", "dim")))
    work = both.join(side("a", "i"), ["a", "i"]).join(side("b", "j"), ["b", "j"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: dict[tuple, tuple] = {}

        def load(row: dict, x: str, key: tuple) -> tuple:
            if key not in trees:
                if len(trees) >= 8:
                    trees.pop(next(iter(trees)))
                v = np.frombuffer(row[f"vectors_{x}"], "<f8").reshape(-1, row[f"dim_{x}"])
                unit = _unit(v).astype(np.float32)
                trees[key] = np.frombuffer(row[f"ids_{x}"], "<i8"), np.frombuffer(row[f"counts_{x}"], "<i8"), v, unit, pickle.loads(row[f"tree_{x}"])
            return trees[key]

        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                same = row["a"] == row["b"] and row["i"] == row["j"]
                ids_a, n_a, v_a, unit_a, tree_a = load(row, "a", (row["a"], row["i"]))
                ids_b, n_b, v_b, unit_b, tree_b = load(row, "b", (row["b"], row["j"]))
                mask = dual_traversal(unit_a, tree_a, unit_b, tree_b, threshold)
                if same:
                    np.fill_diagonal(mask, False)
                i = np.flatnonzero(mask.any(1))
                if not len(i):
                    continue
                # Close calls are decided in double precision on the original vectors.
                for at in np.array_split(i, -(-len(i) // 256)):
                    cosine = unit_a[at] @ unit_b.T
                    near = mask[at] & (np.abs(cosine - threshold) <= NARROW)
                    mask[at] &= cosine >= threshold
                    p, q = np.nonzero(near)
                    for s in range(0, len(p), 20_000):
                        x, y = v_a[at[p[s : s + 20_000]]], v_b[q[s : s + 20_000]]
                        exact = (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))
                        mask[at[p[s : s + 20_000]], q[s : s + 20_000]] = exact >= threshold
                forest = _forest(mask, ids_a, ids_b)
                parts = [(ids_a, mask @ n_b)] if same else [(ids_a, mask @ n_b), (ids_b, n_a @ mask)]
                for ids, n in parts:
                    linked = np.flatnonzero(n)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[linked]), pa.nulls(len(linked), pa.int64()), pa.array(n[linked])], ["u", "v", "n"])
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in forest], pa.int64()), pa.array([y for _, y in forest], pa.int64()), pa.nulls(len(forest), pa.int64())], ["u", "v", "n"])

    found = cut(work.mapInArrow(compare, "u long, v long, n long"), "links")
    counts = found.filter("v IS NULL").groupBy("u").agg(F.sum("n").alias("others"))
    labels = components(cut(found.filter("v IS NOT NULL").select("u", "v").union(ties), "edges"))
    summary = cut(classes.select("key", "rep", "n").join(counts, F.col("rep") == F.col("u"), "left").join(labels, F.col("rep") == F.col("node"), "left").select("key", F.col("n").alias("copies"), F.coalesce("others", F.lit(0)).alias("others"), F.coalesce("label", "rep").alias("label")), "summary")
    joined = rows.select("vec_id", "key").join(summary, "key", "left")
    component = F.coalesce("label", "vec_id")
    return joined.select("vec_id", F.coalesce(F.col("copies") - 1 + F.col("others"), F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))
