"""Operator 6: token ids as length-delimited binary records with an offset index.

A file is a run of records: length (u64), masked CRC-32C of the length (u32), payload,
masked CRC-32C of the payload (u32), a line feed. All numbers are little-endian. The payload
is a flag byte (1: no doc_id, 2: four bytes an id, else two), the doc_id (i64) and the ids.
Records are in ascending doc_id order (no doc_id first), files in the order of their names.

Spark's own writer and reader move the bytes, so any store that Spark reaches will do and a
lost task is simply run again. The index is Parquet: a row for each record (file, offset,
length, ids, start within the file) and one for each file (ids of the files before it).

Defined cases: a null or empty text gives a record with the end id alone; rows that share a
doc_id are kept, in an order of their texts' hashes; a very long text is one record; an empty table gives no records; further columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memspark.llm.common import new_path, shuffles_dropped, slices

BLOCK_BYTES, BLOCKS_A_FILE = 2 << 20, 4
#: Writing tasks whose files are numbered together.
GROUP = 256
#: Characters that are encoded at a time.
BATCH_CHARS = 1_500_000

#: Fixed values of the checksum: reflected Castagnoli polynomial, and the masking constant.
CASTAGNOLI, MASK_DELTA = 0x82F63B78, 0xA282EAD8


def _advance_one_byte(v: int) -> int:
    for _ in range(8):
        v = v >> 1 ^ (CASTAGNOLI if v & 1 else 0)
    return v


def _tables(image_of_bits: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """A linear map of 32 bits as one table for the low and one for the high half."""
    halves = []
    for part in (image_of_bits[:16], image_of_bits[16:]):
        table = np.zeros(1, np.uint32)
        for image in part:
            table = np.concatenate([table, table ^ np.uint32(image)])
        halves.append(table)
    return halves[0], halves[1]


_levels: list[tuple[np.ndarray, np.ndarray]] = []


def _level(k: int) -> tuple[np.ndarray, np.ndarray]:
    """The map that carries a checksum over ``4 * 2**k`` zero bytes."""
    while len(_levels) <= k:
        if not _levels:
            images = [1 << i for i in range(32)]
            for _ in range(4):
                images = [_advance_one_byte(v) for v in images]
        else:
            low, high = _levels[-1]
            once = [int(low[1 << i]) for i in range(16)] + [int(high[1 << i]) for i in range(16)]
            images = [int(low[v & 0xFFFF] ^ high[v >> 16]) for v in once]
        _levels.append(_tables(images))
    return _levels[k]


def crc32c_of(many: list[bytes]) -> list[int]:
    """CRC-32C of each, of four bytes at least. The map is linear and zeros in front are neutral: halves are joined, for all of about one length at once."""
    out, classes = [0] * len(many), {}
    for i, data in enumerate(many):
        classes.setdefault(max(4, 1 << (len(data) - 1).bit_length()), []).append(i)
    for size, members in classes.items():
        for s in range(0, len(members), max(1, (1 << 22) // size)):
            own = members[s : s + max(1, (1 << 22) // size)]
            padded = np.zeros((len(own), size), np.uint8)
            for row, i in enumerate(own):
                at = size - len(many[i])
                padded[row, at:] = np.frombuffer(many[i], np.uint8)
                padded[row, at : at + 4] ^= 0xFF
            low, high = _level(0)
            v = padded.view("<u4")
            v = low[v & 0xFFFF] ^ high[v >> 16]
            k = 0
            while v.shape[1] > 1:
                low, high = _level(k)
                left = v[:, 0::2]
                v = low[left & 0xFFFF] ^ high[left >> 16] ^ v[:, 1::2]
                k += 1
            for i, crc in zip(own, v[:, 0].tolist()):
                out[i] = crc ^ 0xFFFFFFFF
    return out


def masked(crc: int) -> int:
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


@lru_cache(1 << 16)
def _header(n: int) -> bytes:
    size = struct.pack("<Q", n)
    return size + struct.pack("<I", masked(crc32c_of([size])[0]))


def frames(doc_ids: list[int | None], ids: list[bytes]) -> list[bytes]:
    """The records without their line feeds; ``ids``: unsigned 32-bit."""
    payloads = []
    for doc_id, own in zip(doc_ids, ids):
        numbers = np.frombuffer(own, "<u4")
        wide = bool(len(numbers)) and int(numbers.max()) > 0xFFFF
        payloads.append(struct.pack("<Bq", (doc_id is None) + 2 * wide, doc_id or 0) + (own if wide else numbers.astype("<u2").tobytes()))
    return [_header(len(p)) + p + struct.pack("<I", masked(crc)) for p, crc in zip(payloads, crc32c_of(payloads))]


def unframe(data: memoryview, places: list[int]) -> list[tuple[int | None, bytes]]:
    """doc_id and ids (unsigned 32-bit) of the records at ``places``. Raises ValueError if one is damaged."""
    payloads, sums, out = [], [], []
    for at in places:
        (n,) = struct.unpack_from("<Q", data, at)
        if data[at : at + 12] != _header(n) or at + 16 + n > len(data):
            raise ValueError(f"damaged record at byte {at}")
        payloads.append(bytes(data[at + 12 : at + 12 + n]))
        sums.append(struct.unpack_from("<I", data, at + 12 + n)[0])
    for at, payload, stored, crc in zip(places, payloads, sums, crc32c_of(payloads)):
        if masked(crc) != stored:
            raise ValueError(f"damaged record at byte {at}")
        flags, doc_id = struct.unpack_from("<Bq", payload)
        ids = payload[9:] if flags & 2 else np.frombuffer(payload, "<u2", offset=9).astype("<u4").tobytes() if len(payload) > 9 else b""
        out.append((None if flags & 1 else doc_id, ids))
    return out


def places_of(data: memoryview) -> list[int]:
    """Where the records of a file begin, by their lengths."""
    at, out = 0, []
    while at < len(data):
        out.append(at)
        at += struct.unpack_from("<Q", data, at)[0] + 17
    return out


def write_records(docs: DataFrame, path: str, encode: Callable[[list], list[bytes]]) -> None:
    """Write the ids that ``encode`` gives for each whole text under ``path``/data, and the index beside it."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[bytes] = []
        size = 0
        for batch in batches:
            for part in slices(batch, "text", BATCH_CHARS):
                for record in frames(part.column("doc_id").to_pylist(), encode(part.column("text").to_pylist())):
                    block.append(record)
                    size += len(block[-1]) + 1
                    if size >= BLOCK_BYTES:
                        yield pa.RecordBatch.from_pydict({"value": pa.array([b"\n".join(block)], pa.binary())})
                        block, size = [], 0
        if block:
            yield pa.RecordBatch.from_pydict({"value": pa.array([b"\n".join(block)], pa.binary())})

    spark = docs.sparkSession
    # A hash of the text splits the rows of a very common doc_id; only numbers are sampled for the ranges.
    lots = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("lot")).repartitionByRange("doc_id", "lot")
    ordered = lots.sortWithinPartitions("doc_id", "lot", "text").select("doc_id", "text")
    with shuffles_dropped(spark):
        (ordered.mapInArrow(blocks, "value binary").select(F.col("value").cast("string"))
            .write.option("maxRecordsPerFile", BLOCKS_A_FILE).option("lineSep", "\n").text(f"{path}/data"))
        _files(spark, path).mapInArrow(_scan, "file string, record long, offset long, length long, n_tokens long, start_in_file long").write.parquet(f"{path}/records")
        totals = spark.read.parquet(f"{path}/records").groupBy("file").agg(F.count("*").alias("n_records"), F.sum("n_tokens").alias("n_tokens"))
        _with_base(totals).write.parquet(f"{path}/files")


def _with_base(totals: DataFrame) -> DataFrame:
    """``totals`` (file, n_records, n_tokens) with base, the ids of all files before; summed within GROUP writers' files, then over the groups."""
    number = [F.regexp_extract("file", pattern, 1).cast("long") for pattern in (r"part-(\d+)-", r"-c(\d+)\.")]
    numbered = totals.withColumn("part", number[0]).withColumn("count", number[1]).withColumn("group", F.floor(F.col("part") / GROUP))
    ahead = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = numbered.groupBy("group").agg(F.sum("n_tokens").alias("n_tokens"))
    groups = groups.select("group", ahead(Window.orderBy("group")).alias("group_base"))
    placed = numbered.withColumn("base", ahead(Window.partitionBy("group").orderBy("part", "count"))).join(groups, "group")
    return placed.select("file", "n_records", "n_tokens", (F.col("base") + F.col("group_base")).alias("base"))


def _files(spark: SparkSession, path: str) -> DataFrame:
    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/data")
    return found.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The index rows of each file, from the frames alone."""
    for batch in batches:
        for file, content in zip(batch.column("file").to_pylist(), batch.column("content")):
            data, at, rows, start = memoryview(content.as_buffer()).cast("B"), 0, [], 0
            while at < len(data):
                (n,) = struct.unpack_from("<Q", data, at)
                ids = (n - 9) // (4 if data[at + 12] & 2 else 2)
                rows.append((file, len(rows), at, n + 17, ids, start))
                at, start = at + 17 + n, start + ids
            names = ("file", "record", "offset", "length", "n_tokens", "start_in_file")
            yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows)))))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit), start (ids before the record in all files), file, record; every checksum is verified."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("file").to_pylist(), batch.column("content")):
                data, start = memoryview(content.as_buffer()).cast("B"), 0
                places = places_of(data)
                for s in range(0, len(places), 500):
                    rows = []
                    for k, (doc_id, ids) in enumerate(unframe(data, places[s : s + 500]), s):
                        rows.append((doc_id, ids, start, file, k))
                        start += len(ids) // 4
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    names, types = ["doc_id", "ids", "start_in_file", "file", "record"], [pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.int64()]
    records = _files(spark, path).mapInArrow(parse, "doc_id long, ids binary, start_in_file long, file string, record long")
    files = spark.read.parquet(f"{path}/files").select("file", "base")
    return records.join(files, "file").select("doc_id", "ids", (F.col("base") + F.col("start_in_file")).alias("start"), "file", "record")


def read_shuffled(spark: SparkSession, path: str, seed: int) -> DataFrame:
    """doc_id and ids in an order drawn from ``seed``: the index alone is shuffled, then each place in it fetches its record by offset."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, wanted in zip(batch.column("content"), batch.column("wanted").to_pylist()):
                data = memoryview(content.as_buffer()).cast("B")
                rows = [(w["place"], *found) for w, found in zip(wanted, unframe(data, [w["offset"] for w in wanted]))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary()))], ["place", "doc_id", "ids"])

    index = spark.read.parquet(f"{path}/records").withColumn("place", F.xxhash64(F.lit(seed), "file", "record"))
    wanted = index.groupBy("file").agg(F.collect_list(F.struct("place", "offset")).alias("wanted"))
    found = _files(spark, path).join(wanted, "file").select("content", "wanted").mapInArrow(fetch, "place long, doc_id long, ids binary")
    return found.orderBy("place").select("doc_id", "ids")


def documents_as_records(spark: SparkSession, docs: DataFrame, encode: Callable[[list], list[bytes]]) -> DataFrame:
    """``docs`` written to the shared folder and read back: the columns of read_records()."""
    path = new_path(spark, "records")
    write_records(docs, path, encode)
    return read_records(spark, path)
