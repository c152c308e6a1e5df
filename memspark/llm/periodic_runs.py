"""Operator 11: runs of words that repeat with a period, by suffix trees of a text and its reversal.

A run is a stretch of consecutive words in which words ``q`` apart are identical, ``q`` being its
smallest period, that no neighbouring word extends, and whose length is at least ``LEAST`` and
``REPEATS`` periods. Each text is handled by one task on its own:

1. Words that can't be in a run are told apart first. In a run every sequence of three words
   occurs three times at least (length - 2 >= 3 q), so only stretches of such sequences go on;
   counts are taken within each stretch again until nothing changes. Nothing in a run is lost.
2. Ukkonen's algorithm gives the suffix tree of a stretch; its Euler tour, with a table of
   least depths, answers in constant time how far two places agree to the right. The tree of
   the reversal tells how far they agree to the left.
3. The root of a run is a longest Lyndon word for one of two opposite orders of words. The
   longest Lyndon word at a place ends where the next smaller suffix begins (the next greater
   one for the opposite order). Each such word is extended both ways by its length as period.

Memory: about 700 bytes a word for the longest stretch of one text; a text without
periods needs none of that.

Defined cases: a null or empty text, or one of blanks, has no words and no runs, and collapses to
an empty text; equal rows are handled row by row, so a doc_id on several rows gives several; a
text of one word repeated is one run of period 1; very long texts are handled whole; an empty
table gives no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import gc
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from memspark.llm.common import slices

LEAST, REPEATS = 6, 4
RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
#: Places that share one entry of the table of least depths.
BLOCK = 16


def suffix_tree(symbols: list[int], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ukkonen's tree of ``symbols`` (under ``k``, the last one occurs once): edges sorted by node and symbol (parent, child), and the start and end of each node's label."""
    n = len(symbols)
    start, stop, link = array("q", [0]), array("q", [0]), array("q", [0])
    edges: dict[int, int] = {}
    find = edges.get
    node = at = length = waiting = 0
    for i, c in enumerate(symbols):
        waiting += 1
        fresh = 0
        while waiting:
            if not length:
                at = i
            key = node * k + symbols[at]
            child = find(key)
            if child is None:
                edges[key] = len(start)
                start.append(i)
                stop.append(n)
                link.append(0)
                if fresh:
                    link[fresh] = node
                    fresh = 0
            else:
                size = stop[child] - start[child]
                if length >= size:
                    node, at, length = child, at + size, length - size
                    continue
                head = start[child]
                if symbols[head + length] == c:
                    length += 1
                    if fresh:
                        link[fresh] = node
                    break
                middle = len(start)
                edges[key] = middle
                edges[middle * k + c] = middle + 1
                edges[middle * k + symbols[head + length]] = child
                start[child] = head + length
                start.extend((head, i))
                stop.extend((head + length, n))
                link.extend((0, 0))
                if fresh:
                    link[fresh] = middle
                fresh = middle
            waiting -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                at = i - waiting + 1
    keys = np.fromiter(edges.keys(), np.int64, len(edges))
    children = np.fromiter(edges.values(), np.int64, len(edges))
    order = np.argsort(keys)
    return keys[order] // k, children[order], np.array(start), np.array(stop)


class CommonExtensions:
    """How many symbols two suffixes share: the depth of their leaves' lowest common ancestor."""

    def __init__(self, symbols: list[int], k: int):
        parents, children, start, stop = suffix_tree(symbols, k)
        n, size = len(symbols), (stop - start).tolist()
        first_child = np.searchsorted(parents, np.arange(len(start) + 1)).tolist()
        children = children.tolist()
        tour, leaf_at, leaves = array("i"), array("q", bytes(8 * n)), array("q")
        # (next child, behind the last, depth) of each node on the path; a leaf of depth d is the suffix at n - d.
        path_next, path_end, path_depth = [first_child[0]], [first_child[1]], [0]
        note = tour.append
        note(0)
        while path_next:
            c = path_next[-1]
            if c == path_end[-1]:
                path_next.pop()
                path_end.pop()
                path_depth.pop()
                if path_depth:
                    note(path_depth[-1])
                continue
            path_next[-1] = c + 1
            child = children[c]
            depth = path_depth[-1] + size[child]
            a, b = first_child[child], first_child[child + 1]
            if a == b:
                leaf_at[n - depth] = len(tour)
                leaves.append(n - depth)
                note(depth)
                note(path_depth[-1])
            else:
                path_next.append(a)
                path_end.append(b)
                path_depth.append(depth)
                note(depth)
        self.leaf_at = np.array(leaf_at)
        self.rank = np.empty(n, np.int64)
        self.rank[np.array(leaves)] = np.arange(n)
        depths = np.array(tour, np.int32)
        depths = np.concatenate([depths, np.full(-len(depths) % BLOCK, np.iinfo(np.int32).max, np.int32)]).reshape(-1, BLOCK)
        # From a block's begin up to a place, from a place to its end, and the least of 2**j blocks.
        self.depths, self.up_to, self.onwards = depths.ravel(), np.minimum.accumulate(depths, 1).ravel(), np.minimum.accumulate(depths[:, ::-1], 1)[:, ::-1].ravel()
        self.table = [depths.min(1)]
        while 2 << (len(self.table) - 1) <= len(depths):
            half = 1 << (len(self.table) - 1)
            self.table.append(np.minimum(self.table[-1][:-half], self.table[-1][half:]))

    def shared(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Symbols that the suffixes at ``i`` and at ``j`` have in common from their begin, for each pair."""
        a, b = self.leaf_at[i], self.leaf_at[j]
        a, b = np.minimum(a, b), np.maximum(a, b)
        block_a, block_b = a // BLOCK, b // BLOCK
        found = np.minimum(self.onwards[a], self.up_to[b])
        same = np.flatnonzero(block_a == block_b)
        if len(same):
            found[same] = self.depths[a[same]]
            for step in range(1, BLOCK):
                inside = same[a[same] + step <= b[same]]
                found[inside] = np.minimum(found[inside], self.depths[a[inside] + step])
        between = block_b - block_a - 1
        level = np.log2(np.maximum(between, 1)).astype(int)
        for x in np.unique(level[between > 0]).tolist():
            of = np.flatnonzero((between > 0) & (level == x))
            row = self.table[x]
            found[of] = np.minimum(found[of], np.minimum(row[block_a[of] + 1], row[block_b[of] - (1 << x)]))
        return found.astype(np.int64)


def _next_less(rank: list[int]) -> list[int]:
    """For each place the next one of a smaller rank; the length where there is none."""
    n = len(rank)
    out, open_ = [n] * n, []
    for i, r in enumerate(rank):
        while open_ and rank[open_[-1]] > r:
            out[open_.pop()] = i
        open_.append(i)
    return out


def runs_in(words: np.ndarray) -> np.ndarray:
    """Rows (start, length, period) by start, then period, of all runs in a sequence of numbers."""
    n = len(words)
    if n < LEAST:
        return np.zeros((0, 3), np.int64)
    symbols = np.unique(words, return_inverse=True)[1] + 1  # 0 closes the sequence
    k = int(symbols.max()) + 1
    forward = CommonExtensions([*symbols.tolist(), 0], k)
    at = np.arange(n)
    ends = [np.array(_next_less(r.tolist()))[:n] for r in (forward.rank, n - forward.rank)]
    i, j = np.concatenate([at, at]), np.concatenate(ends)
    root = j <= n  # else the word would hold the closing symbol
    i, j = i[root], j[root]
    i, j = np.unique(np.stack([i, j], 1), axis=0).T
    period = j - i
    fits = np.maximum(LEAST, REPEATS * period) <= n
    i, j, period = i[fits], j[fits], period[fits]
    right = forward.shared(i, j)
    del forward
    backward = CommonExtensions([*symbols[::-1].tolist(), 0], k)
    left = np.where(i > 0, backward.shared(n - i, n - j), 0)
    length = left + period + right
    found = np.stack([i - left, length, period], 1)[length >= np.maximum(LEAST, REPEATS * period)]
    return np.unique(found[:, [0, 2, 1]], axis=0)[:, [0, 2, 1]]


def stretches(words: np.ndarray, texts: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of all stretches that may hold runs; ``texts`` numbers the text of each word, and no stretch spans two."""
    three, size = 3, len(words)
    if size < LEAST:
        return []
    word = words.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    spun = [word, (word << np.uint64(21)) | (word >> np.uint64(43)), (word << np.uint64(42)) | (word >> np.uint64(22))]
    mixed = (spun[0][:-2] + spun[1][1:-1] * np.uint64(3)) ^ (spun[2][2:] * np.uint64(5))
    good, group = texts[:-2] == texts[2:], texts[:-2].astype(np.uint64)
    while True:
        at = np.flatnonzero(good)
        key = (mixed[at] ^ (group[at] * np.uint64(0xBF58476D1CE4E5B9))) * np.uint64(0x94D049BB133111EB)
        _, of, count = np.unique(key, return_inverse=True, return_counts=True)
        after = np.zeros(len(good), bool)
        after[at[count[of] >= three]] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], after.view(np.int8), [0]])))
        begins, ends = edges[::2], edges[1::2]
        # Sequences that follow each other may still be of two texts.
        wide = ends - begins >= LEAST - 2
        after[:] = False
        group = np.zeros(len(good), np.uint64)
        for number, (a, b) in enumerate(zip(begins[wide].tolist(), ends[wide].tolist())):
            after[a:b] = True
            group[a:b] = number
        if after.sum() == len(at):
            return list(zip(begins[wide].tolist(), (ends[wide] + 2).tolist()))
        good = after


def _collapsed(words: list[bytes], found: np.ndarray) -> bytes:
    """The words that no run holds behind its first period, joined by a space."""
    if not len(found):
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, found[:, 0] + found[:, 2], 1)
    np.add.at(change, found[:, 0] + found[:, 1], -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()])


def _of_texts(texts: list[str | None]) -> tuple[list[int], list[np.ndarray], list[bytes]]:
    """Words, runs and the collapsed text of each."""
    split = [t.encode().split() if t else [] for t in texts]
    sizes = [len(w) for w in split]
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for words in split for w in words), np.int64, sum(sizes))
    begins = np.concatenate([[0], np.cumsum(sizes)])
    owner = np.repeat(np.arange(len(split)), sizes)
    found: list[list[np.ndarray]] = [[] for _ in split]
    for a, b in stretches(ids, owner):
        d = int(owner[a])
        rows = runs_in(ids[a:b])
        if len(rows):
            found[d].append(rows + np.array([a - begins[d], 0, 0]))
    runs = [np.concatenate(x) if x else np.zeros((0, 3), np.int64) for x in found]
    runs = [r[np.lexsort((r[:, 2], r[:, 0]))] for r in runs]
    return sizes, runs, [_collapsed(w, r) for w, r in zip(split, runs)]


def find_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (by start, then period) and collapsed (the words that stay) of each row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                gc.disable()  # nothing here is cyclic, and walking millions of edges would cost more than the work
                try:
                    sizes, runs, collapsed = _of_texts(part.column("text").to_pylist())
                finally:
                    gc.enable()
                flat = np.concatenate([*runs, np.zeros((0, 3), np.int64)])
                offsets = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int32)
                fields = pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], ["start", "length", "period"])
                columns = [part.column("doc_id"), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), fields), pa.array(collapsed, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])

    schema = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return docs.select("doc_id", "text").mapInArrow(run, schema)
