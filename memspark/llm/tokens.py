"""Token ids of whole texts by the tokenizers library, each distinct word encoded once per worker.

A text is cut only where no token can span the cut, so the ids equal those of the whole text:
before a space or line feed that follows a character that is not white space, for
vocabularies that keep white space (it starts the next token) or drop it. Texts with
double spaces or white space other than space and line feed go whole to the library.
"""

from __future__ import annotations

import gc
import os
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space besides space and line feed, as any of the engines sees it.
_ODD = [c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace() and c not in " \n"]
_ODD_ASCII = [c for c in _ODD if c.isascii()]
#: Beyond Latin letters, or a letter whose lower case is two characters: left to the library.
_WIDE = re.compile("[^\x00-\u024f]|\u0130")
_LONGEST = 64
#: In front of a text's first word, which no space precedes.
_HEAD = "\x01"
_PUNCTUATION = ".,;:!?#$%&*|()"


def _has_odd(text: str) -> bool:
    return any(map(text.__contains__, _ODD_ASCII if text.isascii() else _ODD))


def _is_wide(text: str) -> bool:
    if text.isascii():
        return False
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return _WIDE.search(text) is not None
    return False


class _Alphabet(dict):
    """For str.translate(): what the model sees for a letter (byte-level models spell it in signs of their own)."""

    def __init__(self, pre_tokenizer):
        super().__init__()
        self.pre_tokenizer = pre_tokenizer

    def __missing__(self, letter: int) -> str:
        found = self[letter] = self.pre_tokenizer.pre_tokenize_str(f"a{chr(letter)}a")[0][0][1:-1]
        return found


class Encoder:
    """Callable: texts (None: empty) to little-endian unsigned 32-bit ids, each closed by ``end_id``.

    It is pickled as its arguments; each worker loads the file and keeps the words it has met.
    When there are ``most`` of them they become the old ones, and of the former old ones those
    that were not met since go.
    """

    def __init__(self, path: str, end_id: int | None = None, most: int = 450_000):
        self.path, self.end_id, self.most = path, end_id, most

    def __reduce__(self):
        return _encoder, (self.path, self.end_id, self.most)

    def _load(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(self.path)
        self.words: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        # What the model itself is given for an ASCII word behind a space: a mark in front, and lower case or not.
        probe = " Ab"
        if self.tokenizer.normalizer:
            probe = self.tokenizer.normalizer.normalize_str(probe)
        parts = [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(probe)]
        self.plain = len(parts) == 1 and parts[0][-2:] in ("Ab", "ab") and len(parts[0]) < 4
        self.mark, self.lower = parts[0][:-2], parts[0][-2:] == "ab"
        self.tails: dict[str, bytes] = {}
        #: Vocabularies that drop white space take a line feed for a space.
        self.drops = not self.mark
        self.line_feed = b"" if self.drops else self._library(["\n"])[0]
        self.alphabet = _Alphabet(self.tokenizer.pre_tokenizer)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.end = b"" if self.end_id is None else np.array([self.end_id], "<u4").tobytes()

    def _library(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _fresh(self, new: set[str]) -> dict[str, bytes]:
        """Ids of words that follow a space, begin with a line feed, or are marked as a text's first.

        Letters and ASCII punctuation are always cut apart, so "word," is "word" and ",".
        """
        out, rest, cores = {}, [], {}
        tokenize, known, tails = self.tokenizer.model.tokenize, self.words, self.tails
        for w in new if self.plain else ():
            core = w.rstrip(_PUNCTUATION)
            letters = core[1:] if core[:1] == "\n" else core
            if not letters.isalpha():
                rest.append(w)
                continue
            spelled = letters.lower() if self.lower else letters
            if not core.isascii():
                if _WIDE.search(core):
                    rest.append(w)
                    continue
                spelled = spelled.translate(self.alphabet)
            ids = out.get(core) or known.get(core)
            if ids is None:
                ids = array("I", [t.id for t in tokenize(spelled if letters is not core else self.mark + spelled)]).tobytes()
                if letters is not core:
                    ids = self.line_feed + ids
            out[core] = ids
            if len(w) > len(core):
                tail = w[len(core) :]
                if tail not in tails:
                    if len(tails) > 10_000:
                        tails.clear()
                    tails[tail] = self._library([tail])[0]
                out[w] = ids + tails[tail]
        if not self.plain:
            rest = list(new)
        if rest:
            spelled = [w[1:] if w[:1] == _HEAD else w if w[:1] == "\n" else " " + w for w in rest]
            out.update(zip(rest, self._library(spelled)))
        return out

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        # The lists of words are short-lived; walking them for cycles would cost more than the work.
        gc.disable()
        try:
            return self._encode(texts)
        finally:
            gc.enable()

    def _encode(self, texts: list[str | None]) -> list[bytes]:
        if not hasattr(self, "tokenizer"):
            self._load()
        out: list[bytes | None] = [None] * len(texts)
        places, cut, whole = [], [], []
        for i, text in enumerate(texts):
            if not text:
                out[i] = self.end
                continue
            if self.lower and not _is_wide(text):
                text = text.lower()
            marked = text.replace("\n", " " if self.drops else " \n")
            if "  " in marked or _HEAD in text or _has_odd(text) or any(map(text.__contains__, self.specials)):
                whole.append(i)
            else:
                places.append(i)
                cut.append(_HEAD + marked)
        if cut:
            for i, ids in zip(places, self._by_words(cut)):
                out[i] = ids + self.end
        if whole:
            for i, ids in zip(whole, self._library([texts[i] for i in whole])):
                out[i] = ids + self.end
        return out

    def _by_words(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of texts that are cut at their spaces; each distinct word is looked up once."""
        words = pc.split_pattern(pa.array(texts), " ")
        coded = words.values.dictionary_encode()
        distinct, known, old = coded.dictionary.to_pylist(), self.words, self.old
        ids = list(map(known.get, distinct))
        if None in ids:
            new = {w for w, x in zip(distinct, ids) if x is None}
            again = {w: x for w in new if (x := old.get(w)) is not None}
            known.update(again)
            fresh = self._fresh(new.difference(again))
            known.update(fresh)
            ids = list(map(known.__getitem__, distinct))
            for w in [w for w in fresh if len(w) > _LONGEST]:
                del known[w]
            if len(known) > self.most:
                self.words, self.old = {}, known
        counts = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, starts, word = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(counts) - counts, coded.indices.to_numpy()
        each = counts[word]
        ends = np.cumsum(each)
        at = np.repeat(starts[word] - (ends - each), each)
        at += np.arange(len(at))
        gathered, bounds = flat[at], np.concatenate([[0], ends])[words.offsets.to_numpy()].tolist()
        for s, e in zip(bounds, bounds[1:]):
            yield gathered[s:e].tobytes()


_loaded: dict[tuple, Encoder] = {}


def _encoder(*args) -> Encoder:
    """One encoder per worker and set of arguments, so that later tasks find its words."""
    if args not in _loaded:
        _loaded[args] = Encoder(*args)
    return _loaded[args]
