"""Operator 3: removal of repeated passages by seed and extend.

Each window of ``window`` words names one anchor, its smallest hashed run of ``ANCHOR`` words
(winnowing), so equal windows name equal anchors. Each place of an anchor is joined with the
anchor's first place (smaller doc_id, then earlier start): a seed. Seeds of two documents at one
distance, within a block of the earlier document, are one seed. The match is extended both ways
over the words themselves until they differ; stretches of at least ``window`` words are the
maximal repeats. A star of seeds on the first place is linear in the places of an anchor, where
pairs of documents would be quadratic.

Windows with a recurring anchor that differ from the anchor's first place may still equal each
other: what the extension leaves is held against itself by 64-bit hashes of whole windows (the
exact check), and only the first place of each stays. A window that equals its anchor's first
place never gets there, nor does one whose anchor occurs once.

Defined cases: a null or empty text has no words, and null stays null; documents of fewer
words than a window keep all; exact copies lose all their words to the first copy; rows that
are equal in doc_id and text are one document; rows of one doc_id with different texts are
documents of their own, in order of their texts' hashes; a null doc_id comes first (it counts
as the smallest long); an empty table gives no rows; further columns are kept by
``remove_repeats``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_, eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from memspark.llm.common import cut, drop, key128, slices
from memspark.llm.shingles import WordHashes, grams, words_of

WINDOW, ANCHOR = 20, 8
#: Words are handed to other documents by blocks of this many, and what their anchors' windows reach beyond.
BLOCK = 256
#: Texts are handled by parts of about this many characters.
PART = 400_000
#: Stands for a null doc_id.
_FIRST = -(1 << 63)


def anchors_of(hashes: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """Hashes and places of the anchors of a document, and the first and last window that each one stands for."""
    g = grams(hashes, anchor)
    span = window - anchor + 1
    if len(g) < span:
        none = np.zeros(0, np.int64)
        return g[:0], none, none, none
    chosen = np.arange(len(g) - span + 1) + np.lib.stride_tricks.sliding_window_view(g, span).argmin(1)
    lo = np.concatenate([[0], np.flatnonzero(np.diff(chosen)) + 1])
    hi = np.concatenate([lo[1:], [len(chosen)]]) - 1
    return g[chosen[lo]], chosen[lo], lo, hi


def _memo() -> WordHashes:
    """A store of word hashes small enough for several workers of an executor."""
    memo = WordHashes()
    memo.most = 150_000
    return memo


def _doc(column: str) -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(_FIRST))


def _longs(names: list[str]) -> str:
    return ", ".join(f"{c} long" for c in names)


def _first_key(key: list[str], where: Column | None = None) -> list[Column]:
    """The smallest key of a group, as columns; only rows ``where`` count."""
    order = F.col("doc") if len(key) == 1 else F.struct(*key)
    order = order if where is None else F.when(where, order)
    return [F.min_by(c, order).alias(f"{c}0") if c != "doc" else F.min("doc").alias("doc0") for c in key]


def _same_key(key: list[str]) -> Column:
    return reduce(and_, (F.col(c) == F.col(f"{c}0") for c in key))


def later_copies(docs: DataFrame, key: list[str]) -> DataFrame:
    """The columns of ``key`` of documents with the text of one of smaller doc_id."""
    texts = docs.select(_doc("doc_id").alias("doc"), F.xxhash64("text").alias("t"), F.when(F.col("text").isNotNull(), key128("text")).alias("key")).filter("key IS NOT NULL")
    # As a table of its own, so that Spark can split the join of a text with very many copies.
    groups = cut(texts.groupBy("key").agg(F.min("doc").alias("doc0"), F.count("*").alias("n")).filter("n > 1"), "groups")
    return texts.join(groups, "key").filter("doc > doc0").select(*key).distinct()


def anchor_places(texts: DataFrame, key: list[str], window: int, anchor: int) -> DataFrame:
    """The columns of ``key``, an anchor's hash h, its place p, its windows lo to hi, and lead: first place in its document."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _memo()
        for batch in batches:
            for part in slices(batch, "text", PART):
                parts, at = [], []
                for i, text in enumerate(part.column("text").to_pylist()):
                    h, p, lo, hi = anchors_of(memo.of(words_of(text)), window, anchor)
                    if len(h):
                        lead = np.zeros(len(h), bool)
                        lead[np.unique(h, return_index=True)[1]] = True
                        parts.append((h.view(np.int64), p.astype(np.int32), lo.astype(np.int32), hi.astype(np.int32), lead))
                        at += [i] * len(h)
                if parts:
                    named = [part.column(c).take(pa.array(at)) for c in key]
                    yield pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(x)) for x in zip(*parts)), *named], ["h", "p", "lo", "hi", "lead", *key])

    return texts.select(*key, "text").mapInArrow(emit, f"h long, p int, lo int, hi int, lead boolean, {_longs(key)}")


def seeds(places: DataFrame, leaders: DataFrame, key: list[str]) -> DataFrame:
    """Places of anchors joined with the anchors' first places: the two keys, the distance d, the block b of the first place, the windows lo to hi."""
    met = places.join(leaders, "h").filter(~(_same_key(key) & (F.col("p") == F.col("p0"))))
    met = met.withColumns({"d": F.col("p") - F.col("p0"), "b": F.floor(F.col("p0") / BLOCK).cast("int")})
    return met.groupBy(*key, *(f"{c}0" for c in key), "d", "b").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def pieces(texts: DataFrame, found: DataFrame, key: list[str], window: int) -> DataFrame:
    """For each seed the words of the earlier document that its windows cover, and where they would start in the later one."""

    def in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", PART):
                at, b, text = [], [], []
                for i, whole in enumerate(part.column("text").to_pylist()):
                    words = words_of(whole)
                    for j in range(0, len(words) if len(words) >= window else 0, BLOCK):
                        at.append(i)
                        b.append(j // BLOCK)
                        text.append(b" ".join(words[max(0, j - window) : j + BLOCK + window]))
                named = [part.column(c).take(pa.array(at, pa.int32())) for c in key]
                yield pa.RecordBatch.from_arrays([*named, pa.array(b, pa.int32()), pa.array(text, pa.binary())], [*(f"{c}0" for c in key), "b", "words"])

    def trim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "words", PART):
                start, kept = [], []
                for lo, hi, d, b, block in zip(*(part.column(c).to_pylist() for c in ("lo", "hi", "d", "b", "words"))):
                    offset = max(0, b * BLOCK - window)
                    first = max(0, lo - d)
                    start.append(first + d)
                    kept.append(b" ".join(block.split()[first - offset : hi - d + window - offset]))
                more = [pa.array(start, pa.int32()), pa.array(kept, pa.binary())]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in (*key, "lo", "hi")), *more], [*key, "lo", "hi", "start", "words"])

    first = [f"{c}0" for c in key]
    blocks = texts.select(*key, "text").mapInArrow(in_blocks, f"{_longs(first)}, b int, words binary")
    met = found.join(blocks, [*first, "b"]).select(*key, "lo", "hi", "d", "b", "words")
    return met.mapInArrow(trim, f"{_longs(key)}, lo int, hi int, start int, words binary")


def equal_windows(words: list[bytes], start: int, there: list[bytes], window: int) -> np.ndarray:
    """The match of ``words`` from ``start`` on with ``there``, extended until words differ: which windows lie in stretches that agree."""
    here = words[start : start + len(there)]
    if here == there:
        return np.ones(max(0, len(there) - window + 1), bool)
    agree = np.fromiter(map(eq, here, there), np.int32, len(here))
    sums = np.concatenate([[0], np.cumsum(agree)])
    return sums[window:] - sums[:-window] == window


def extended(texts: DataFrame, found: DataFrame, key: list[str], window: int) -> DataFrame:
    """The columns of ``key``; again: starts and ends of runs of windows that occurred before; w and p: hashes and places of windows still to be compared."""
    gathered = found.groupBy(*key).agg(F.collect_list(F.struct("lo", "hi", "start", "words")).alias("pieces"))
    held = texts.join(gathered, key).select(*key, "text", "pieces")

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _memo()
        for batch in batches:
            for part in slices(batch, "text", PART):
                runs, hashes, places = [], [], []
                for text, seeded in zip(part.column("text").to_pylist(), part.column("pieces").to_pylist()):
                    words = words_of(text)
                    m = len(words) - window + 1
                    again, open_ = np.zeros(m, bool), np.zeros(m, bool)
                    for s in seeded:
                        open_[s["lo"] : s["hi"] + 1] = True
                        equal = equal_windows(words, s["start"], s["words"].split(), window)
                        again[s["start"] : s["start"] + len(equal)] |= equal
                    at = np.flatnonzero(open_ & ~again)
                    w, first = np.unique(grams(memo.of(words), window)[at] if len(at) else np.zeros(0, np.uint64), return_index=True)
                    again[np.delete(at, first)] = True  # these stand earlier in the document itself
                    runs.append(np.flatnonzero(np.diff(np.concatenate([[0], again.view(np.int8), [0]]))).astype(np.int32))
                    hashes.append(w.view(np.int64))
                    places.append(at[first].astype(np.int32))
                more = [pa.array(runs, pa.list_(pa.int32())), pa.array(hashes, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in key), *more], [*key, "again", "w", "p"])

    return held.mapInArrow(extend, f"{_longs(key)}, again array<int>, w array<long>, p array<int>")


def repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """All rows and columns of ``docs``, with kept (the words left, joined by a space), n_words, n_removed and spans (word places, end behind the last, of the maximal repeats)."""
    ids = docs.select(_doc("doc_id").alias("doc"))
    single = ids.groupBy("doc").count().filter("count > 1").isEmpty()
    # What names a row: doc alone, or with t, the hash of its text, if doc_ids occur again.
    key = ["doc"] if single else ["doc", "t"]
    copies = cut(later_copies(docs, key), "copies")
    texts = docs.select(_doc("doc_id").alias("doc"), F.xxhash64("text").alias("t"), F.encode("text", "UTF-8").alias("text")).select(*key, "text")
    texts = (texts if single else texts.dropDuplicates(key)).join(copies, key, "left_anti")

    places = cut(anchor_places(texts, key, window, anchor), "places")
    leading = F.col("lead")
    by_order = F.when(leading, F.col("doc") if single else F.struct(*key))
    leaders = places.groupBy("h").agg(*_first_key(key, leading), F.min_by("p", by_order).alias("p0"), F.count("*").alias("n")).filter("n > 1").drop("n")
    leaders = cut(leaders, "leaders")
    found = cut(seeds(places, leaders, key), "seeds")
    drop(places, leaders)
    words = cut(pieces(texts, found, key, window), "pieces")
    drop(found)
    compared = cut(extended(texts, words, key, window), "extended")
    drop(words)

    # The exact check of what differs from its anchor's first place.
    rest = compared.select(*key, F.inline(F.arrays_zip("w", "p")))
    shared = cut(rest.groupBy("w").agg(*_first_key(key), F.count("*").alias("n")).filter("n > 1").drop("n"), "shared")
    later = rest.join(shared, "w").filter(~_same_key(key)).groupBy(*key).agg(F.collect_list("p").alias("later"))

    columns = docs.columns
    own = [f"c{i}" for i in range(len(columns))]
    rows = docs.toDF(*own)
    here = {"doc": _doc(own[columns.index("doc_id")]), "t": F.xxhash64(own[columns.index("text")])}
    rows = rows.withColumns({f"_{c}": here[c] for c in key})
    for noted, more in ((compared, "again"), (later, "later"), (copies.withColumn("copy", F.lit(True)), "copy")):
        rows = rows.join(noted.select(*(F.col(c).alias(f"_{c}") for c in key), more), [f"_{c}" for c in key], "left")
    rows = rows.select(*own, "again", "later", "copy")
    text_at = own[columns.index("text")]

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*own, "kept", "n_words", "n_removed", "spans"]
        spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            for part in slices(batch, text_at, PART):
                kept, sizes, gone, spans = [], [], [], []
                for text, runs, later, copy in zip(*(part.column(c).to_pylist() for c in (text_at, "again", "later", "copy"))):
                    words = words_of(text.encode() if text else None)
                    n = len(words)
                    change = np.zeros(n + 1, np.int64)
                    if copy and n >= window:
                        change[0], change[n] = 1, -1
                    elif n >= window:
                        at = np.array(later or [], np.int64)
                        starts = np.concatenate([np.array((runs or [])[::2], np.int64), at])
                        ends = np.concatenate([np.array((runs or [])[1::2], np.int64) - 1, at]) + window
                        np.add.at(change, starts, 1)
                        np.add.at(change, ends, -1)
                    covered = np.cumsum(change) > 0
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], covered.view(np.int8), [0]]))).tolist()
                    spans.append([{"start": a, "end": b} for a, b in zip(edges[::2], edges[1::2])])
                    if edges:
                        words = [words[i] for i in np.flatnonzero(~covered[:n])]
                    kept.append(b" ".join(words))
                    sizes.append(n)
                    gone.append(n - len(words))
                more = [pa.array(kept, pa.binary()).cast(pa.string()), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, spans_type)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in own), *more], names)

    schema = rows.select(*own).schema.add("kept", "string").add("n_words", "long").add("n_removed", "long").add("spans", DataType.fromDDL("array<struct<start:int,end:int>>"))
    found = rows.mapInArrow(remove, schema)
    return found.select(*(F.col(o).alias(c) for o, c in zip(own, columns)), *(F.col(c) for c in ("kept", "n_words", "n_removed", "spans")))


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """All rows of ``docs``; a text that repeats passages becomes its other words, joined by a space."""
    found = repeats(docs, window, anchor)
    n = len(docs.columns)
    flat = found.toDF(*(f"c{i}" for i in range(n)), "kept", "n_words", "n_removed", "spans")
    return flat.select(*(F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col(f"c{i}")).alias(c) if c == "text" else F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))
