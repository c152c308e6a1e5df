"""Operator 7: exact encoding and decoding with a merge-type SentencePiece model, by backtracking.

Encoding a stretch of text: Aho-Corasick gives the longest piece at each place. A piece is
appended if it and the piece before it, joined and merged again by rank, give the same two
pieces; else the next shorter piece is tried; with none left the place is marked in a
bitfield as failed and the last piece is taken back. Adjacent pieces that all agree are the
only result that merging by rank can give, so the ids equal the library's.

Texts are cut in front of each white-space mark (no piece holds one behind another character,
which is checked when the model is loaded), and a worker encodes each distinct stretch once.

Defined cases: a null or empty text has no ids and decodes to an empty text; characters that
the model lacks become their UTF-8 bytes; rows are kept one for one, whatever their doc_id;
very long texts are encoded whole, each within one task; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.llm.common import slices

MARK = "▁"
_CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_LONGEST = 64


class Model:
    """The pieces of a model file, with encode() and decode() of one text. Pickled as its path."""

    def __init__(self, path: str, most: int = 500_000):
        import sentencepiece

        self.path, self.most = path, most
        library = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(library.vocab_size())
        plain = [i for i in ids if not (library.is_byte(i) or library.is_control(i) or library.is_unknown(i) or library.is_unused(i))]
        self.id_of = {library.id_to_piece(i): i for i in plain}
        #: Pieces of a higher score are merged first.
        order = sorted(plain, key=lambda i: (-library.get_score(i), i))
        self.rank = {library.id_to_piece(i): k for k, i in enumerate(order)}
        self.byte_ids = {int(library.id_to_piece(i)[3:5], 16): i for i in ids if library.is_byte(i)}
        self.bytes_of = [b"" if library.is_control(i) else library.id_to_piece(i).encode() for i in ids]
        for b, i in self.byte_ids.items():
            self.bytes_of[i] = bytes([b])
        self.bytes_of[library.unk_id()] = " ⁇ ".encode()
        self.byte_set = frozenset(self.byte_ids.values())
        self.cuttable = not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.id_of)
        self.known = {c for c in self.id_of if len(c) == 1}
        #: Two characters that no piece holds side by side can be cut apart.
        self.joins = {p[i : i + 2] for p in self.id_of for i in range(len(p) - 1)}
        self.automaton = ahocorasick.Automaton()
        for p in self.id_of:
            self.automaton.add_word(p, len(p))
        self.automaton.make_automaton()
        self.agreed: dict[tuple[str, str], bool] = {}
        self.after_space: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        self.runs: dict[str, bytes] = {}

    def __reduce__(self):
        return model, (self.path, self.most)

    def merge(self, text: str) -> list[str]:
        """Merging by rank, leftmost first among equals; for the short texts of agree()."""
        parts = list(text)
        while len(parts) > 1:
            best = min((self.rank.get(parts[i] + parts[i + 1], len(self.rank)), i) for i in range(len(parts) - 1))
            if best[0] == len(self.rank):
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return parts

    def agree(self, left: str, right: str) -> bool:
        """Whether the two pieces stay as they are when their text is merged again. An empty left: the right one alone."""
        found = self.agreed.get((left, right))
        if found is None:
            if len(self.agreed) > 2 * self.most:
                self.agreed.clear()
            found = self.agreed[left, right] = self.merge(left + right) == [p for p in (left, right) if p]
        return found

    def pieces(self, text: str) -> list[str]:
        """The pieces of a text whose characters are all known."""
        n = len(text)
        at: list[list[int]] = [[] for _ in range(n)]  # lengths of the pieces at each place, shortest first
        for end, length in self.automaton.iter(text):
            at[end - length + 1].append(length)
        failed, out, pos, tried = bytearray(n + 1), [], 0, [len(at[0]) - 1] if n else []
        while pos < n:
            k = tried[-1]
            last = out[-1] if out else ""
            while k >= 0:
                length = at[pos][k]
                if not failed[pos + length] and self.agree(last, text[pos : pos + length]):
                    break
                k -= 1
            if k >= 0:
                tried[-1] = k
                out.append(text[pos : pos + length])
                pos += length
                if pos < n:
                    tried.append(len(at[pos]) - 1)
            else:
                if not out:
                    raise ValueError("the model can't spell this text")
                failed[pos] = 1
                tried.pop()
                pos -= len(out.pop())
        return out

    def encode_chunk(self, text: str) -> bytes:
        """Ids of a stretch of marked text, as little-endian signed 32-bit."""
        out, start = [], 0
        for i in range(1, len(text) + 1):
            if i == len(text) or text[i - 1 : i + 1] not in self.joins:
                part = text[start:i]
                ids = self.runs.get(part)
                if ids is None:
                    spelled = [self.id_of[p] for p in self.pieces(part)] if part[0] in self.known else [self.byte_ids[b] for b in part.encode()]
                    ids = np.array(spelled, "<i4").tobytes()
                    if len(part) <= _LONGEST:
                        if len(self.runs) > self.most:
                            self.runs.clear()
                        self.runs[part] = ids
                out.append(ids)
                start = i
        return b"".join(out)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        marked = text.replace("\n", " \n")
        if not self.cuttable:
            return self.encode_chunk(MARK + text.replace(" ", MARK))
        # A word stands for itself behind a mark; one that begins with a line feed has no mark.
        memo, make = self.after_space, lambda w: w if w[:1] == "\n" else MARK + w
        words = marked.split(" ")
        if "  " in marked or MARK in text or words[0][:1] in ("", "\n") or words[-1] == "":
            memo, make, words = self.chunks, lambda w: w, _CHUNK.findall(MARK + text.replace(" ", MARK))
        ids = list(map(memo.get, words))
        if None in ids:
            if len(memo) > self.most:
                memo.clear()
            new = {w: self.encode_chunk(make(w)) for w in {w for w, x in zip(words, ids) if x is None}}
            ids = [new[w] if x is None else x for w, x in zip(words, ids)]
            memo.update((w, x) for w, x in new.items() if len(w) <= _LONGEST)
        return b"".join(ids)

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``; a byte that is not part of a character becomes U+FFFD."""
        raw = b"".join(map(self.bytes_of.__getitem__, ids))
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            text = self._decode_damaged(ids)
        first = next((i for i in ids if self.bytes_of[i]), None)
        text = text.replace(MARK, " ")
        return text[1:] if first is not None and self.bytes_of[first].startswith(MARK.encode()) else text

    def _decode_damaged(self, ids: list[int]) -> str:
        out, run = [], b""
        for i in [*ids, None]:
            if i in self.byte_set:
                run += self.bytes_of[i]
                continue
            while run:
                for n in (1, 2, 3, 4):
                    try:
                        out.append(run[:n].decode())
                        break
                    except UnicodeDecodeError:
                        pass
                else:
                    n = 1
                    out.append("�")
                run = run[n:]
            if i is not None:
                out.append(self.bytes_of[i].decode())
        return "".join(out)


_loaded: dict[tuple, Model] = {}


def model(path: str, most: int = 500_000) -> Model:
    """One model per worker and file, so that later tasks find the stretches that it has met."""
    if (path, most) not in _loaded:
        _loaded[path, most] = Model(path, most)
    return _loaded[path, most]


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of int) and decoded (the text that the ids decode to) of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            for part in slices(batch, "text"):
                raw = [m.encode(t) for t in part.column("text").to_pylist()]
                ends = np.cumsum([0, *(len(x) // 4 for x in raw)]).astype("<i4")
                values = np.frombuffer(b"".join(raw), "<i4")
                decoded = [m.decode(values[a:b].tolist()) for a, b in zip(ends, ends[1:])]
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(values))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids, pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")
