"""Operator 8: best-fit packing of token sequences by the best-two-fit rule.

Only lengths decide a packing, and there are at most ``capacity`` of them: Spark counts the
pieces of each length, the driver packs the counts (its work is bounded by ``capacity``, not
by the corpus), and each piece finds its place from its rank among the pieces of its length.

A sequence is filled greedily with the longest pieces that still fit. Then its smallest piece
is taken out again if two unpacked pieces together fill the larger gap more tightly. The same
filling is used for as many sequences as the counts allow.

Defined cases: a null or empty text is a document of the end id alone; rows that share a doc_id
are separate documents; very long texts are encoded whole, then cut into pieces; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.llm.common import cut, slices

CAPACITY = 2048
#: Characters that are encoded at a time: the more, the fewer times a word is looked up.
BATCH_CHARS = 4_000_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces_of(docs: DataFrame, encode: Callable[[list], list[bytes]], capacity: int = CAPACITY) -> DataFrame:
    """Each document cut into pieces; only one longer than ``capacity`` is cut, and its first piece takes what is left over."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", BATCH_CHARS):
                rows = []
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), encode(part.column("text").to_pylist())):
                    n = len(ids) // 4
                    ends = [n % capacity or capacity] if n > capacity else [n]
                    ends += range(ends[0] + capacity, n + 1, capacity)
                    start = 0
                    for k, end in enumerate(ends):
                        rows.append((doc_id, k, start, end - start, zlib.crc32(ids[4 * start : 4 * end])))
                        start = end
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut_up, PIECES)


def _best_two(lengths: list[int], left: dict[int, int], gap: int) -> tuple[int, int] | None:
    """Two remaining pieces whose sum is largest within ``gap``."""
    best, found, i, j = 0, None, 0, bisect_right(lengths, gap) - 1
    while i <= j:
        a, b = lengths[i], lengths[j]
        if a + b > gap or (i == j and left[a] < 2):
            j -= 1
            continue
        if a + b > best:
            best, found = a + b, (a, b)
        i += 1
    return found


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Fillings that use up ``counts`` (pieces by length): (number of sequences, [(length, pieces of it)])."""
    left = {n: c for n, c in counts.items() if c}
    lengths, out = sorted(left), []

    def take(used: dict[int, int], n: int, k: int) -> None:
        used[n] = used.get(n, 0) + k
        left[n] -= k
        if not left[n]:
            lengths.remove(n)

    def put_back(used: dict[int, int], n: int) -> None:
        used[n] -= 1
        if not used[n]:
            del used[n]
        if not left[n]:
            lengths.insert(bisect_right(lengths, n), n)
        left[n] += 1

    while lengths:
        used: dict[int, int] = {}
        gap = capacity
        while lengths and gap >= lengths[0]:
            n = lengths[bisect_right(lengths, gap) - 1]
            k = min(gap // n, left[n])
            take(used, n, k)
            gap -= n * k
        if gap and sum(used.values()) > 1:
            small = min(used)
            put_back(used, small)
            pair = _best_two(lengths, left, gap + small)
            for n in pair if pair and sum(pair) > small else (small,):
                take(used, n, 1)
        times = 1 + min(left[n] // k for n, k in used.items())
        for n, k in used.items():
            if times > 1:
                take({}, n, k * (times - 1))
        out.append((times, sorted(used.items(), reverse=True)))
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with sequence_id and offset. ``pieces`` has doc_id, piece and length, and any further columns.

    The pieces are range-partitioned by length and id, so that neither a common length nor a
    large document gathers in one task; the ranks follow from the partitions' counts.
    """
    # Drawing the ranges reads its input twice, so the pieces are made first.
    ordered = cut(pieces, "lengths").repartitionByRange("length", "doc_id", "piece").sortWithinPartitions("length", "doc_id", "piece")
    placed = cut(ordered.withColumn("_at", F.monotonically_increasing_id()), "pieces")
    part = F.shiftright("_at", 33)
    runs = placed.groupBy(part.alias("part"), "length").agg(F.count("*").alias("n"), F.min("_at").alias("first")).toPandas()
    runs = runs.sort_values(["length", "part"], kind="stable")
    runs["rank"] = runs.groupby("length")["n"].cumsum() - runs["n"]
    counts = {int(k): int(v) for k, v in runs.groupby("length")["n"].sum().items()}

    segments: list[tuple[int, int, int, int, int]] = []  # length, first rank, sequence, pieces in a sequence, offset
    used, sequence = dict.fromkeys(counts, 0), 0
    for times, filling in plan(counts, capacity):
        offset = 0
        for n, k in filling:
            segments.append((n, used[n], sequence, k, offset))
            used[n] += times * k
            offset += n * k
        sequence += times
    segments.sort()
    seg = np.array(segments, np.int64).reshape(-1, 5)
    first_of = runs.sort_values("first")
    starts, base = first_of["first"].to_numpy(np.int64), (first_of["rank"] - first_of["first"]).to_numpy(np.int64)
    stride = np.int64(max([1, *counts.values()]) + 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = seg[:, 0] * stride + seg[:, 1]
        for batch in batches:
            if not batch.num_rows:
                continue
            at = batch.column("_at").to_numpy()
            length = batch.column("length").to_numpy()
            rank = at + base[np.searchsorted(starts, at, "right") - 1]
            s = seg[np.searchsorted(keys, length * stride + rank, "right") - 1]
            row = rank - s[:, 1]
            kept = [batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(s[:, 2] + row // s[:, 3]), pa.array(s[:, 4] + row % s[:, 3] * length)], [*names, "sequence_id", "offset"])

    names = pieces.columns
    schema = pieces.schema.add("sequence_id", "long").add("offset", "long")
    return placed.mapInArrow(place, schema)


def sequences(docs: DataFrame, packed: DataFrame, encode: Callable[[list], list[bytes]]) -> DataFrame:
    """The packed sequences themselves: sequence_id and ids (little-endian unsigned 32-bit). doc_id must be unique in ``docs``."""

    def slice_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for places, ids in zip(part.column("places").to_pylist(), encode(part.column("text").to_pylist())):
                    rows += [(p["sequence_id"], p["offset"], ids[4 * p["start"] : 4 * (p["start"] + p["length"])]) for p in places]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary()))], ["sequence_id", "offset", "ids"])

    places = packed.groupBy("doc_id").agg(F.collect_list(F.struct("sequence_id", "offset", "start", "length")).alias("places"))
    cuts = docs.join(places, docs["doc_id"].eqNullSafe(places["doc_id"])).select("text", "places").mapInArrow(slice_ids, "sequence_id long, offset long, ids binary")
    rows = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return cuts.groupBy("sequence_id").agg(F.aggregate(rows, F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
