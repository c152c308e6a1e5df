"""Operator 4: near-duplicate documents by a Jaccard join of their word n-grams.

Two documents link if their sets of ``N`` -word shingles have a Jaccard similarity of
``PERCENT`` per cent or more. The steps:

1. One pass over the texts gives each set's size and hash, and its shingles, packed by range of
   the hash space and by batch of documents. A task for each range finds the shingles that
   occur in one document alone. A linked document shares ``ceil(t * size)`` of its shingles, so
   those with more lonely ones than that allows link with nothing and go.
2. Documents of equal sets form a class; the smallest doc_id stands for it.
3. Of the sets that are left, shingles are ordered rare first by their exact document
   frequency. A set that links has a shingle in common with the other in its prefix, the first
   ``size - ceil(t * size) + 1`` in that order; lonely ones need not be sent. Of shingles that
   the same documents have in their prefixes (a shared passage) one stands for all.
4. On each prefix shingle documents are paired with LEADERS leaders, by length and positional
   filter. Pairs pass the suffix filter: parity bitmaps of the sets bound from below how many
   shingles are in one set only. What passes is verified once, on whole sets.
5. On shingles whose documents are in several components still, blocks of documents are held
   against each other by the same filters, and only pairs that pass leave the task: first
   each document's closest partner in each other component, then, by longer bitmaps, all of
   these documents that are still apart.
6. Links join to components.

Shingles are 64-bit hashes.

Defined cases: a document without words has an empty set and links with nothing; one of fewer
than ``N`` words has its whole sequence as the only shingle; rows that share a doc_id are one
node, each with its own size and set; a null doc_id takes no part, its component is null; very
long texts give all their shingles, each text within one task; an empty table gives no rows; further columns are kept by ``keep_first``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memspark.llm.common import cut, drop, slices
from memspark.llm.components import components
from memspark.llm.shingles import WordHashes, shingle_set, words_of

N, PERCENT = 5, 75
LEADERS = 3
#: Documents whose shingles are packed together: so many characters, and so many rows at most.
BATCH_CHARS, BATCH_ROWS = 3_000_000, 60_000
#: Characters of text to a range of the hash space.
RANGE_CHARS = 24_000_000
#: Owner of a packed shingle that several documents of its batch have.
_SHARED = 0xFFFF
#: Bits of a parity bitmap to a shingle, and bits at most.
BITS, MOST_BITS = 2, 4096
#: The same of the bitmaps for what the first ones leave.
FINE_BITS, MOST_FINE_BITS = 8, 65536
#: Documents of one shingle that are held against others at a time.
BLOCK = 256
#: Ids of documents that are broadcast at most; beyond that many, texts are shuffled to them.
MOST_BROADCAST = 2_000_000


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc"), F.encode("text", "UTF-8").alias("text"))


def _sets(part: pa.RecordBatch, memo: WordHashes, n: int) -> list[np.ndarray]:
    texts = part.column("text").to_pylist()
    return [shingle_set(memo.of(words_of(t.lower() if t else None)), n) for t in texts]


def _set_hash(s: np.ndarray) -> tuple[int, int]:
    if not len(s):
        return 0, 0
    mixed = s * np.uint64(0x9E3779B97F4A7C15) ^ s >> np.uint64(31)
    return int(s.sum(dtype=np.uint64)), int(np.bitwise_xor.reduce(mixed))


def _pack(sets: list[np.ndarray], bits: int) -> Iterator[tuple[int, bytes]]:
    """(range, values) of a batch: the 40 bits behind the range's and the owner of each distinct shingle, by owner.

    Different shingles of equal bits only look less lonely than they are.
    """
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets), dtype=np.uint16), [len(s) for s in sets])
    order = np.argsort(every)
    ordered = every[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if len(every) else np.zeros(0, bool)
    shared = np.concatenate([~new[1:], [False]]) if len(every) else new
    owner[order[new & shared]] = _SHARED
    kept = np.zeros(len(every), bool)
    kept[order[new]] = True
    every, owner = every[kept], owner[kept]
    ranges = (every >> np.uint64(64 - bits)).astype(np.uint32 if bits > 16 else np.uint16)
    order = np.argsort(ranges, kind="stable")
    every, owner, ranges = every[order] << np.uint64(bits) >> np.uint64(24), owner[order], ranges[order]
    low, high = every.astype("<u4"), (every >> np.uint64(32)).astype(np.uint8)
    starts = np.flatnonzero(np.concatenate([[True], ranges[1:] != ranges[:-1]])) if len(ranges) else []
    for s, e in zip(starts, [*starts[1:], len(ranges)]):
        yield int(ranges[s]), b"".join([low[s:e].tobytes(), high[s:e].tobytes(), owner[s:e].astype("<u2").tobytes()])


def _unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    m = len(packed) // 7
    low, high = np.frombuffer(packed, "<u4", m), np.frombuffer(packed, np.uint8, m, 4 * m)
    return low | high.astype(np.uint64) << np.uint64(32), np.frombuffer(packed, "<u2", m, 5 * m)


def survey(docs: DataFrame, n: int, bits: int) -> DataFrame:
    """A row for each document (doc, size, two hashes a and b of its set, batch and place in it) and one for each batch and range (batch, part, packed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, batch_id = WordHashes(), TaskContext.get().partitionId() << 32
        names = ["doc", "size", "a", "b", "batch", "place", "part", "packed"]
        for whole in batches:
            for part in slices(whole, "text", BATCH_CHARS, BATCH_ROWS):
                sets = _sets(part, memo, n)
                k = len(sets)
                a, b = (np.array(x, np.uint64).view(np.int64) for x in zip(*map(_set_hash, sets)))
                sizes, batch = pa.array([len(s) for s in sets], pa.int64()), pa.array([batch_id] * k, pa.int64())
                row = [part.column("doc"), sizes, pa.array(a), pa.array(b), batch, pa.array(range(k), pa.int32())]
                yield pa.RecordBatch.from_arrays([*row, pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names)
                for number, packed in _pack(sets, bits):
                    none = [pa.nulls(1, t) for t in [pa.int64()] * 4]
                    row = [pa.array([batch_id], pa.int64()), pa.nulls(1, pa.int32()), pa.array([number], pa.int32())]
                    yield pa.RecordBatch.from_arrays([*none, *row, pa.array([packed], pa.binary())], names)
                batch_id += 1

    return _texts(docs).mapInArrow(run, "doc long, size long, a long, b long, batch long, place int, part int, packed binary")


def lonely(surveyed: DataFrame) -> DataFrame:
    """batch, place, lonely: how many shingles each document has that occur in no other."""

    def of_range(key: tuple, rows: pa.Table) -> pa.Table:
        packed = [_unpack(x) for x in rows.column("packed").to_pylist()]
        values, owners = (np.concatenate(x) for x in zip(*packed))
        order = np.argsort(values)
        ordered = values[order]
        new = np.concatenate([[True], ordered[1:] != ordered[:-1], [True]])
        alone = np.zeros(len(values), bool)
        alone[order[new[1:] & new[:-1]]] = True
        alone &= owners != _SHARED
        ends = np.cumsum([0, *(len(x) for _, x in packed)])
        found = [owners[s:e][alone[s:e]].astype("<u2").tobytes() for s, e in zip(ends, ends[1:])]
        return pa.table({"batch": rows.column("batch"), "owners": pa.array(found, pa.binary())})

    def of_batch(key: tuple, rows: pa.Table) -> pa.Table:
        counts = sum(np.bincount(np.frombuffer(x, "<u2"), minlength=_SHARED) for x in rows.column("owners").to_pylist())
        place = np.flatnonzero(counts)
        return pa.table({"batch": pa.array([key[0].as_py()] * len(place), pa.int64()), "place": pa.array(place, pa.int32()), "lonely": pa.array(counts[place], pa.int64())})

    packed = surveyed.filter("part IS NOT NULL").select("batch", "part", "packed")
    owners = packed.groupBy("part").applyInArrow(of_range, "batch long, owners binary")
    return owners.groupBy("batch").applyInArrow(of_batch, "batch long, place int, lonely long")


def _needed(size: str, percent: int):
    """Shingles that a set of this size has in common with any that it links to, at least."""
    return F.ceil(F.col(size) * percent / 100)


def _least_shared(a: str, b: str, percent: int):
    """Shared shingles that sets of these sizes need: shared * (100 + percent) >= percent * (a + b)."""
    return F.ceil((F.col(a) + F.col(b)) * percent / (100 + percent) - 1e-9)


def parities(s: np.ndarray, each: int = BITS, most: int = MOST_BITS) -> bytes:
    """For each bit of a bitmap (its length a power of two, by the set's size), whether an odd number of shingles falls on it."""
    bits = min(most, max(64, 1 << (each * len(s) - 1).bit_length()))
    odd = np.bincount((s >> np.uint64(32) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _folded(bitmap: np.ndarray, words: int) -> np.ndarray:
    """Rows of a bitmap at a shorter length: bits that fall together add up modulo two."""
    return np.bitwise_xor.reduce(bitmap.reshape(len(bitmap), -1, words), axis=1)


def _apart(p: bytes, q: bytes) -> int:
    """By how many shingles two sets differ at least."""
    words = min(len(p), len(q)) // 8
    x, y = (_folded(np.frombuffer(b, np.uint64)[None], words) for b in (p, q))
    return int(np.bitwise_count(x ^ y).sum())


def _held_sets(texts: DataFrame, n: int) -> DataFrame:
    """row (unique), doc, size, shingles and bitmap of each text that has words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, row = WordHashes(), TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch, "text"):
                sets = _sets(part, memo, n)
                own = [i for i, s in enumerate(sets) if len(s)]
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))
                columns = [part.column("doc").take(pa.array(own, pa.int64())), pa.array([len(sets[i]) for i in own], pa.int64()), lists.take(pa.array(own, pa.int64())), pa.array([parities(sets[i]) for i in own], pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array(range(row, row + len(own)), pa.int64()), *columns], ["row", "doc", "size", "shingles", "bitmap"])
                row += len(own)

    return texts.mapInArrow(run, "row long, doc long, size long, shingles array<long>, bitmap binary")


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """h, row, doc, size, pos: the prefix of each set in order of document frequency, without shingles that no other set has in its prefix."""
    each = sets.select("row", "doc", "size", F.explode("shingles").alias("h"))
    common = each.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1")
    own = Window.partitionBy("row")
    placed = each.join(common, "h").withColumn("k", F.row_number().over(own.orderBy("n", "h"))).withColumn("m", F.count("*").over(own))
    # Lonely shingles take the first places.
    pos = F.col("size") - F.col("m") + F.col("k") - 1
    return placed.withColumn("pos", pos).filter(F.col("pos") < F.col("size") - _needed("size", percent) + 1).select("h", "row", "doc", "size", "pos")


def one_of_equal(spread: DataFrame) -> DataFrame:
    """Those rows of ``spread`` whose shingle is the least of all that the same documents have in their prefixes; none of shingles that one document has alone.

    The filters bound what two sets can share from any shingle of theirs, so one of these is as good as all.
    """
    members = [F.bit_xor(F.xxhash64(F.lit(k), "row")).alias(name) for k, name in enumerate("ab")]
    groups = spread.groupBy("h").agg(F.count("*").alias("n"), *members).filter("n > 1")
    return spread.join(groups.groupBy("n", "a", "b").agg(F.min("h").alias("h")).select("h"), "h", "left_semi")


def _pairs_on_leaders(own: DataFrame, percent: int) -> DataFrame:
    """x < y (rows), distinct: each document of a prefix shingle with its leaders, by length and positional filter."""
    other = {"other": "row", "doc_other": "doc", "size_other": "size", "pos_other": "pos"}
    lots = [F.col("row"), *(F.xxhash64(F.lit(k), "row") for k in range(1, LEADERS))]
    each = [F.min_by(F.struct(*(F.col(c).alias(name) for name, c in other.items())), lot) for lot in lots]
    leaders = own.groupBy("h").agg(F.array_distinct(F.array(*each)).alias("l")).select("h", F.explode("l").alias("l")).select("h", "l.*")
    both = own.join(cut(leaders, "leaders"), "h").filter("doc <> doc_other")
    need = _least_shared("size", "size_other", percent)
    rest = F.least(F.col("size") - F.col("pos"), F.col("size_other") - F.col("pos_other")) + F.least("pos", "pos_other")
    fits = both.filter((F.least("size", "size_other") >= need) & (rest >= need))
    return fits.select(F.least("row", "other").alias("x"), F.greatest("row", "other").alias("y")).distinct()


def _by_bitmaps(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (x, y) that pass the suffix filter."""
    x, y = (sets.select(F.col("row").alias(c), F.col("size").alias(f"size_{c}"), F.col("bitmap").alias(f"bitmap_{c}")) for c in "xy")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("size_x", "size_y", "bitmap_x", "bitmap_y"))
            keep = [(100 + percent) * (m + n - _apart(p, q)) >= 2 * percent * (m + n) for m, n, p, q in zip(*columns)]
            found = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([found.column("x"), found.column("y")], ["x", "y"])

    return pairs.join(x, "x").join(y, "y").mapInArrow(near, "x long, y long")


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (x, y) that link, as u and v (documents), distinct."""
    x, y = (sets.select(F.col("row").alias(c), F.col("doc").alias(f"doc_{c}"), F.col("shingles").alias(f"set_{c}")) for c in "xy")

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for p, q in zip(batch.column("set_x"), batch.column("set_y")):
                p, q = (v.values.to_numpy(zero_copy_only=False) for v in (p, q))
                merged = np.sort(np.concatenate([p, q]))
                common = int((merged[1:] == merged[:-1]).sum())
                keep.append(100 * common >= percent * (len(merged) - common))
            found = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([found.column("doc_x"), found.column("doc_y")], ["u", "v"])

    whole = pairs.join(x, "x").join(y, "y").select("doc_x", "doc_y", "set_x", "set_y")
    return whole.mapInArrow(shared, "u long, v long").distinct()


def _block_pairs(own: DataFrame, bitmaps: DataFrame, percent: int, closest: bool) -> DataFrame:
    """x < y (rows), distinct: documents of one prefix shingle and of different labels that pass all filters; of each document's partners in one component the closest alone, if ``closest``.

    ``own``: h, row, size, pos, label; ``bitmaps``: row, bitmap. A shingle's documents are dealt into blocks, and pairs of blocks are work for many tasks.
    """
    blocks = own.groupBy("h").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    shared = own.groupBy("row").agg(F.collect_set("h").alias("on"))
    held = own.join(blocks, "h").join(bitmaps, "row").join(shared, "row")
    member = F.struct("row", "size", "pos", "label", "bitmap", "on")
    dealt = held.groupBy("h", "blocks", F.pmod(F.xxhash64("row"), F.col("blocks")).alias("k")).agg(F.collect_list(member).alias("p"))
    dealt = cut(dealt, "blocks")
    several = dealt.filter("blocks > 1")
    pairs = several.join(several.select("h", F.col("k").alias("j"), F.col("p").alias("q")), "h").filter("k <= j").select("h", "p", F.when(F.col("k") < F.col("j"), F.col("q")).alias("q"))
    pairs = dealt.filter("blocks = 1").select("h", "p", F.lit(None).cast(dealt.schema["p"].dataType).alias("q")).union(pairs)

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, p, q in zip(batch.column("h").to_pylist(), batch.column("p"), batch.column("q")):
                p = _columns(p.values)
                x, y = _near(h, p, _columns(q.values) if q.is_valid else p, percent, closest)
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["x", "y"])

    return pairs.mapInArrow(within, "x long, y long").distinct()


def _apart_still(spread: DataFrame, labels: DataFrame) -> DataFrame:
    """h, row, size, pos, label of the prefix shingles whose documents are in several components."""
    own = spread.join(labels, spread["doc"] == labels["node"], "left").select("h", "row", "size", "pos", F.coalesce("label", "doc").alias("label"))
    mixed = own.groupBy("h").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high")
    return cut(own.join(cut(mixed.select("h"), "mixed"), "h", "left_semi"), "apart")


def _fine_bitmaps(sets: DataFrame) -> DataFrame:
    """row and a longer bitmap of each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps = [parities(v.values.to_numpy(zero_copy_only=False).view(np.uint64), FINE_BITS, MOST_FINE_BITS) for v in batch.column("shingles")]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(maps, pa.binary())], ["row", "bitmap"])

    return sets.select("row", "shingles").mapInArrow(run, "row long, bitmap binary")


def _columns(members: pa.StructArray) -> dict:
    numbers = {c: members.field(c).to_numpy(zero_copy_only=False) for c in ("row", "size", "pos", "label")}
    return numbers | {"bitmap": members.field("bitmap").to_pylist(), "on": members.field("on")}


def _first_shared(p: dict, q: dict, i: np.ndarray, j: np.ndarray) -> Iterator[int]:
    """The least shingle that members ``i`` of ``p`` and ``j`` of ``q`` are both found on."""
    sets = [{k: set(side["on"][k].as_py()) for k in np.unique(ends).tolist()} for side, ends in ((p, i), (q, j))]
    return (min(sets[0][x] & sets[1][y]) for x, y in zip(i.tolist(), j.tolist()))


def _near(h: int, p: dict, q: dict, percent: int, closest: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``p`` and rows of ``q`` that pass the filters, have different labels, and share no shingle (on) before ``h``: each pair is one shingle's."""
    if p["label"].min() == p["label"].max() == q["label"].min() == q["label"].max():
        return p["row"][:0], p["row"][:0]
    i, j = np.nonzero(p["label"][:, None] != q["label"][None, :])
    if p is q:
        i, j = i[i < j], j[i < j]
    m, n = p["size"][i], q["size"][j]
    need = -(-percent * (m + n) // (100 + percent))
    rest = np.minimum(m - p["pos"][i], n - q["pos"][j]) + np.minimum(p["pos"][i], q["pos"][j])
    fits = (np.minimum(m, n) >= need) & (rest >= need)
    i, j, need, both = i[fits], j[fits], need[fits], (m + n)[fits]
    apart = np.zeros(len(i), np.int64)
    lengths = [np.array([len(b) for b in side["bitmap"]]) for side in (p, q)]
    shorter = np.minimum(lengths[0][i], lengths[1][j])
    for length in np.unique(shorter):
        at = np.flatnonzero(shorter == length)
        maps = []
        for side, ends in ((p, i[at]), (q, j[at])):
            used, back = np.unique(ends, return_inverse=True)
            rows = np.concatenate([_folded(np.frombuffer(side["bitmap"][u], np.uint64)[None], length // 8) for u in used])
            maps.append((rows, back))
        for s in range(0, len(at), 4096):
            x, y = (rows[back[s : s + 4096]] for rows, back in maps)
            apart[at[s : s + 4096]] = np.bitwise_count(x ^ y).sum(1)
    passed = both - apart >= 2 * need
    i, j, apart = i[passed], j[passed], apart[passed]
    here = np.fromiter(_first_shared(p, q, i, j), np.int64, len(i)) == h
    i, j, apart = i[here], j[here], apart[here]
    if closest:
        first = np.zeros(len(i), bool)
        for end, label in ((i, q["label"][j]), (j, p["label"][i])):
            order = np.lexsort((apart, label, end))
            change = np.ones(len(order), bool)
            change[1:] = (end[order][1:] != end[order][:-1]) | (label[order][1:] != label[order][:-1])
            first[order[change]] = True
        i, j = i[first], j[first]
    return p["row"][i], q["row"][j]


def link(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links reach) of each row of ``docs``."""
    chars = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    surveyed = cut(survey(docs, n, max(6, (chars // RANGE_CHARS).bit_length())), "survey")
    rows = surveyed.filter("part IS NULL").select("doc", "size", "a", "b", "batch", "place")
    found = rows.filter("size > 0 AND doc IS NOT NULL").join(lonely(surveyed), ["batch", "place"], "left")
    alive = cut(found.filter(F.col("size") - F.coalesce("lonely", F.lit(0)) >= _needed("size", percent)).select("doc", "size", "a", "b"), "alive")
    kept = cut(rows.drop("batch", "place"), "rows")
    drop(surveyed)

    classes = cut(alive.groupBy("a", "b", "size").agg(F.min("doc").alias("rep")), "classes")
    # Rows that share a doc_id tie their classes together.
    members = alive.join(classes, ["a", "b", "size"]).select("doc", "rep")
    several = members.groupBy("doc").agg(F.min("rep").alias("v"), F.max("rep").alias("last")).filter("v < last")
    ties = members.join(several, "doc").filter("rep <> v").select(F.col("rep").alias("u"), "v").distinct()

    wanted = cut(classes.select(F.col("rep").alias("doc")).distinct(), "wanted")
    wanted = F.broadcast(wanted) if wanted.count() <= MOST_BROADCAST else wanted
    sets = cut(_held_sets(_texts(docs).join(wanted, "doc", "left_semi"), n), "sets")
    spread = cut(prefixes(sets, percent), "prefixes")
    every, spread = spread, cut(one_of_equal(spread), "spread")
    drop(every)
    tried = cut(_by_bitmaps(_pairs_on_leaders(spread, percent), sets, percent), "tried")
    links = verify(tried, sets, percent)
    labels = cut(components(cut(links.union(ties), "links")), "labels")

    def widened(labels: DataFrame, found: DataFrame) -> DataFrame:
        if found.isEmpty():
            return labels
        more = labels.select(F.col("node").alias("u"), F.col("label").alias("v")).union(verify(found, sets, percent))
        return cut(components(cut(more, "links")), "labels")

    near = cut(_block_pairs(_apart_still(spread, labels), sets.select("row", "bitmap"), percent, True), "near")
    pairs = cut(near.join(tried, ["x", "y"], "left_anti"), "pairs")
    labels = widened(labels, pairs)
    # Whatever links still has been near something of another component before.
    ends = cut(near.select(F.explode(F.array("x", "y")).alias("row")).distinct(), "ends")
    left = _apart_still(one_of_equal(cut(spread.join(ends, "row", "left_semi"), "held")), labels)
    rest = _block_pairs(left, cut(_fine_bitmaps(sets.join(ends, "row", "left_semi")), "fine"), percent, False)
    labels = widened(labels, cut(rest.join(tried.union(pairs), ["x", "y"], "left_anti"), "rest"))

    named = classes.join(labels, F.col("rep") == F.col("node"), "left").select("a", "b", "size", F.coalesce("label", "rep").alias("least"))
    named = cut(named, "named")
    drop(sets, spread, tried, near, pairs)
    by_doc = alive.join(named, ["a", "b", "size"]).groupBy("doc").agg(F.min("least").alias("least"))
    component = F.when(F.col("doc").isNotNull(), F.coalesce("least", "doc"))
    return kept.join(by_doc, "doc", "left").select(F.col("doc").alias("doc_id"), F.col("size").alias("n_shingles"), component.alias("component_id"))


def keep_first(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """The documents that have the smallest doc_id of their component, with all their columns."""
    own = [f"c{i}" for i in range(len(docs.columns))]
    gone = link(docs, n, percent).filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    flat = docs.toDF(*own)
    return flat.join(gone, flat[own[docs.columns.index("doc_id")]] == gone["_gone"], "left_anti").toDF(*docs.columns)
