"""Cosine search and self-join within a user: blocks of vectors, multiplied in tasks.

A user's vectors are spread over blocks of about ``block`` rows, and pairs of blocks (in the
self-join: of several blocks each), not users, are the keys, so that a large user is work for many
tasks. A pair of blocks returns its best rows or those over the threshold, never all.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memspark.sources import tables

BLOCK = 2048
#: Of pieces for pairs_over(): rows at most, numbers at most, rows at least, how many there are at least where rows suffice, how many are held together and how many pass by them.
PIECE, VALUES, LEAST, PIECES, HELD, PART = 8192, 1 << 19, 256, 32, 8, 16
#: Vectors of either side that are multiplied at once, and pairs multiplied again at once.
TILE, CHECKED = 1024, 50_000
_PACKED = "user_id string, dim int, chunk int, ids array<string>, vectors binary, flags array<boolean>"


def _blocks(vectors: DataFrame, key: str, block: int, flag: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(user_id, key, embedding) as blocks, and user_id, dim, chunks: how many; rows without a vector go, and lengths are kept apart."""
    flagged = F.col(flag) if flag and flag in vectors.columns else F.lit(False)
    rows = vectors.select("user_id", F.col(key).alias("id"), F.col("embedding").cast("array<double>").alias("v"), flagged.alias("flag"))
    rows = rows.filter("v IS NOT NULL AND size(v) > 0 AND user_id IS NOT NULL AND id IS NOT NULL").withColumn("dim", F.size("v"))
    counts = rows.groupBy("user_id", "dim").agg(F.ceil(F.count("*") / block).cast("int").alias("chunks"))
    placed = rows.join(counts, ["user_id", "dim"]).withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))

    def pack(key: tuple, t: pa.Table) -> pa.Table:
        v = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype("<f8")
        user, dim, chunk = (k.as_py() for k in key)
        ids, flags = (pa.array([t.column(c).to_pylist()], pa.list_(kind)) for c, kind in (("id", pa.string()), ("flag", pa.bool_())))
        numbers = {"dim": pa.array([dim], pa.int32()), "chunk": pa.array([chunk], pa.int32())}
        return pa.table({"user_id": [user], **numbers, "ids": ids, "vectors": pa.array([v.tobytes()], pa.binary()), "flags": flags})

    packed = placed.select("user_id", "dim", "chunk", "id", "v", "flag").groupBy("user_id", "dim", "chunk").applyInArrow(pack, _PACKED)
    return packed, counts


def _pair_up(left: tuple[DataFrame, DataFrame], right: tuple[DataFrame, DataFrame]) -> DataFrame:
    """All pairs of a user's blocks."""
    sides = [(blocks.withColumnsRenamed({c: f"{c}_{x}" for c in ("ids", "vectors", "flags", "chunk")}), counts.withColumnRenamed("chunks", f"chunks_{x}")) for x, (blocks, counts) in zip("ab", (left, right))]
    (a, counts_a), (b, counts_b) = sides
    pairs = counts_a.join(counts_b, ["user_id", "dim"]).withColumn("chunk_a", F.explode(F.sequence(F.lit(0), F.col("chunks_a") - 1)))
    pairs = pairs.withColumn("chunk_b", F.explode(F.sequence(F.lit(0), F.col("chunks_b") - 1)))
    return pairs.select("user_id", "dim", "chunk_a", "chunk_b").join(a, ["user_id", "dim", "chunk_a"]).join(b, ["user_id", "dim", "chunk_b"])


def _cosines(row: dict, epsilon: float) -> np.ndarray:
    """dot / (norms + epsilon); 0 where a norm is 0."""
    a, b = (np.frombuffer(row[f"vectors_{x}"], "<f8").reshape(-1, row["dim"]) for x in "ab")
    norms = np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :]
    return np.divide(a @ b.T, norms + epsilon, out=np.zeros_like(norms), where=norms + epsilon > 0)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _best(score: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the ``n`` largest of each row, ties to the earlier column; -inf is never among them."""
    k = min(n, score.shape[1])
    least = np.partition(score, -k, axis=1)[:, -k]
    q, m = np.nonzero((score >= least[:, None]) & (score > -np.inf))
    order = np.lexsort((m, -score[q, m], q))
    q, m = q[order], m[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    return q[place < k], m[place < k]


def top_per_query(queries: DataFrame, memories: DataFrame, n: int, block: int = BLOCK) -> DataFrame:
    """query_id, memory_id, score (6 decimals), place: the ``n`` memories of the query's user with the largest cosine; ties go to the smaller memory_id.

    ``queries``: query_id, user_id, embedding. Memories may have a boolean ``hidden``: then only queries whose boolean ``all`` is true see the hidden ones.
    """

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            score = np.round(_cosines(row, 1e-9), 6)
            sees, hidden = np.array(row["flags_a"], bool), np.array(row["flags_b"], bool)
            score[~sees[:, None] & hidden[None, :]] = -np.inf
            ids = np.array(row["ids_b"], object)
            by_id = np.argsort(ids, kind="stable")
            q, m = _best(score[:, by_id], n)
            asked, found = np.array(row["ids_a"], object)[q], ids[by_id[m]]
            yield pa.RecordBatch.from_arrays([pa.array(asked.tolist(), pa.string()), pa.array(found.tolist(), pa.string()), pa.array(score[q, by_id[m]])], ["query_id", "memory_id", "score"])

    pairs = _pair_up(_blocks(queries, "query_id", block, "all"), _blocks(memories, "memory_id", block, "hidden"))
    found = pairs.mapInArrow(best, "query_id string, memory_id string, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "memory_id"))
    return found.withColumn("place", place).filter(F.col("place") <= n)


def pairs_over(memories: DataFrame, threshold: float, block: int = PIECE) -> DataFrame:
    """user_id, a, b (a < b), score of pairs of one user's memories whose cosine, to 6 decimals, is ``threshold`` or more.

    A user's vectors are dealt into pieces. Some pieces are held together, and later ones pass by them, PART at a time: a vector is
    copied once for each of these shelves, not for each block. Single precision finds the pairs that may reach the threshold, within
    the bound of its error, and only those are multiplied again in double precision.
    """
    rows = memories.select("user_id", F.col("memory_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.filter("v IS NOT NULL AND size(v) > 0 AND user_id IS NOT NULL AND id IS NOT NULL").withColumn("dim", F.size("v"))
    size = F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.lit(VALUES) / F.col("dim")), F.greatest(F.lit(LEAST), F.ceil(F.col("n") / PIECES))))
    counts = rows.groupBy("user_id", "dim").agg(F.count("*").alias("n")).withColumn("pieces", F.ceil(F.col("n") / size).cast("int")).drop("n")
    # Only users with several pieces are sent to all tasks, so vectors aren't dealt by user, and no user is one task.
    placed = rows.join(F.broadcast(counts.filter("pieces > 1")), ["user_id", "dim"], "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
    placed = placed.withColumn("piece", F.pmod(F.xxhash64("id"), "pieces").cast("int"))

    def pack(key: tuple, t: pa.Table) -> pa.Table:
        v = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype("<f8")
        ids = pa.ListArray.from_arrays([0, len(t)], t.column("id").combine_chunks().cast(pa.string()))
        return pa.table({**{f: pa.array([k.as_py()], kind) for f, k, kind in zip(("user_id", "dim", "pieces", "piece"), key, (pa.string(), pa.int32(), pa.int32(), pa.int32()))}, "ids": ids, "vectors": pa.array([v.tobytes()], pa.binary())})

    packed = placed.select("user_id", "dim", "pieces", "piece", "id", "v").groupBy("user_id", "dim", "pieces", "piece").applyInArrow(pack, "user_id string, dim int, pieces int, piece int, ids array<string>, vectors binary")
    held = F.greatest(F.lit(1), F.least(F.lit(HELD), F.ceil(F.col("pieces") / 8).cast("int")))
    part = lambda piece: F.floor(piece / PART).cast("int")
    to = lambda shelf, at, kind: F.struct(shelf.alias("shelf"), at.alias("part"), F.lit(kind).alias("kind"))
    own = F.floor(F.col("piece") / held).cast("int")
    stays = F.transform(F.sequence(part(own * held), part(F.col("pieces") - 1)), lambda x: to(own, x, 0))
    passes = F.transform(F.sequence(F.lit(0), own), lambda x: to(x, part(F.col("piece")), 1))
    key = ["user_id", "dim", "shelf", "part"]
    work = packed.withColumn("to", F.explode(F.concat(stays, passes))).select("user_id", "dim", "to.*", "piece", "ids", "vectors")
    work = work.repartition(*key).sortWithinPartitions(*key, "kind", "piece")

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, shelf = None, []
        for batch in batches:
            for r in range(batch.num_rows):
                own = tuple(batch.column(c)[r].as_py() for c in key)
                if own != at:
                    at, shelf = own, []
                piece = _Piece(batch.column("piece")[r].as_py(), batch.column("ids")[r].values, np.frombuffer(batch.column("vectors")[r].as_py(), "<f8").reshape(-1, own[1]))
                if batch.column("kind")[r].as_py() == 0:
                    shelf.append(piece)
                    continue
                for low, high, score in _joined([p for p in shelf if p.number <= piece.number], piece, threshold):
                    yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(own[0], pa.string()), len(score)), low, high, pa.array(score)], ["user_id", "a", "b", "score"])

    return tables.materialise(work.mapInArrow(over, "user_id string, a string, b string, score double"), "pairs-over", batch=4 << 20)


class _Piece:
    """Some of a user's vectors: as they are, their lengths, and of length 1 in single precision (zero where there is no length)."""

    def __init__(self, number: int, ids: pa.Array, v: np.ndarray):
        self.number, self.ids, self.v = number, ids, v
        with np.errstate(over="ignore", invalid="ignore"):
            self.norms = np.linalg.norm(v, axis=1)
        good = np.isfinite(self.norms) & (self.norms > 0)
        self.unit = np.zeros(v.shape, np.float32)
        self.unit[good] = v[good] / self.norms[good, None]


def _joined(shelf: list[_Piece], piece: _Piece, threshold: float) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray]]:
    """(smaller id, larger id, score) of pairs over the threshold, of ``piece`` and the ones held or within it."""
    # Rounding to 6 decimals, that of the components and that of their sum.
    least = np.float32(threshold - 6e-7 - (piece.v.shape[1] + 8) * 1.3e-7)
    found, size = [], 0

    def joined() -> tuple[pa.Array, pa.Array, np.ndarray]:
        x, y = (pa.concat_arrays([f[k] for f in found]) for k in (0, 1))
        first = pc.less(x, y)
        return pc.if_else(first, x, y), pc.if_else(first, y, x), np.concatenate([f[2] for f in found])

    for p in shelf:
        for s, t in itertools.product(range(0, len(p.v), TILE), range(0, len(piece.v), TILE)):
            left, right = p.unit[s : s + TILE], piece.unit[t : t + TILE]
            i, j = np.divmod(np.flatnonzero(left @ right.T >= least), len(right))
            i, j = i + s, j + t
            if p.number == piece.number:
                i, j = i[i < j], j[i < j]
            for c in range(0, len(i), CHECKED):
                a, b = i[c : c + CHECKED], j[c : c + CHECKED]
                with np.errstate(over="ignore", invalid="ignore"):
                    norms = p.norms[a] * piece.norms[b]
                    score = np.round(np.divide((p.v[a] * piece.v[b]).sum(1), norms, out=np.zeros_like(norms), where=norms > 0), 6)
                near = score >= threshold
                if near.any():
                    found.append((p.ids.take(pa.array(a[near])), piece.ids.take(pa.array(b[near])), score[near]))
                    size += int(near.sum())
                if size > CHECKED:
                    yield joined()
                    found, size = [], 0
    if found:
        yield joined()
