"""Operator 5: language identification of whole, possibly mixed, texts.

Each word's script (by fixed Unicode ranges) narrows the languages to those that use it; the
others get the lowest score. Within them a word scores by its character n-grams. Viterbi over
the words, with a penalty for each switch, labels spans; the language of most words wins.

A text has its best single language throughout if no language leads it by the penalty on any stretch,
and the largest leads on an opening and on a closing stretch stay under the penalty together. This is
exact (see viterbi), and only other texts run the full recursion.

Learning uses at most ``per_language`` labelled documents of each language, chosen by a hash of
the id; prediction reads every document, and nothing but its text.

Defined cases: a text that is null, empty or without a letter is ``und`` with score 0 and no
spans, as is every text if nothing was learned; rows that share a doc_id are labelled one by
one; ties go to the smaller language name; very long texts are read whole, each within one task; an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.llm.common import slices

PER_LANGUAGE, MOST_LANGUAGES = 1000, 256
BUCKETS = 1 << 16
SWITCH_PENALTY, FLOOR = 12.0, -8.0
#: A language uses a script if so large a share of its letters is in it.
USES = 0.01

#: First code point of a stretch, and its script.
SCRIPTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0700, "Other"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Odia"),
    (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"),
    (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"),
    (0x13A0, "Other"), (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x18B0, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"),
    (0x2000, "Other"), (0x3040, "Kana"), (0x3100, "Other"), (0x3130, "Hangul"), (0x3190, "Other"), (0x3400, "Han"),
    (0xA000, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Other"), (0x20000, "Han"),
]
_STARTS = [s for s, _ in SCRIPTS]
_LETTERS = re.compile(r"[^\W\d_]+")


def script(letter: str) -> str:
    return SCRIPTS[bisect_right(_STARTS, ord(letter)) - 1][1]


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of one to three characters of lower-case words between marks: buckets, and whose each one is."""
    c = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le"), "<u4").astype(np.uint64)
    whose, opens, ends = np.cumsum(c == ord("<")) - 1, c == ord("<"), c == ord(">")
    places = [np.flatnonzero(~(opens | ends)), np.flatnonzero(~ends), np.flatnonzero(~ends[:-1] & ~ends[1:])]
    found = []
    for n, at in enumerate(places, 1):
        h = np.full(len(at), n, np.uint64)
        for i in range(n):
            h = (h + c[at + i]) * np.uint64(0x9E3779B97F4A7C15)
        found.append((h >> np.uint64(48)).astype(np.int64))
    return np.concatenate(found), whose[np.concatenate(places)]


def letters_of(token: str) -> str:
    return token.lower() if token.isalpha() else "".join(_LETTERS.findall(token)).lower()


def main_script(letters: str) -> str:
    """The commonest script of the letters; the one met first among equals."""
    return "Latin" if letters.isascii() or max(letters) < "\u0370" else Counter(map(script, letters)).most_common(1)[0][0]


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # log P(n-gram | language), a row for each n-gram
    uses: dict[str, list[bool]]

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Scores from FLOOR to 0 of lower-case words of letters, for each language."""
        k = len(self.languages)
        buckets, whose = grams(words)
        total = np.stack([np.bincount(whose, self.table[buckets, i], len(words)) for i in range(k)], 1)
        scripts = list(map(main_script, words))
        kinds = sorted(set(scripts))
        masks = np.array([self.uses.get(s, [True] * k) for s in kinds])
        masks[~masks.any(1)] = True
        allowed = masks[np.searchsorted(kinds, scripts)]
        top = np.where(allowed, total, -np.inf).max(1, keepdims=True)
        return np.where(allowed, np.maximum(total - top, FLOOR), FLOOR)


def viterbi(scores: np.ndarray, penalty: float) -> np.ndarray:
    """The best labels of the rows of ``scores``, where each change of label costs ``penalty``; ties keep the label, then take the smaller.

    The early return is exact. Take a path of S stretches in other languages than the best one and B in it, so of
    S + B - 1 switches. If B > 0, its gain is under S penalties, which the switches cost at least. If B = 0 < S - 1, the
    first stretch opens the text and the last closes it: these two gain under one penalty, the S - 2 between at most
    one each, and the switches cost S - 1.
    """
    best = scores.sum(0).argmax()
    lead = np.cumsum(scores - scores[:, [best]], 0)
    low = np.minimum.accumulate(np.concatenate([np.zeros((1, lead.shape[1])), lead[:-1]]))
    opening, closing = lead[:-1].max(initial=0), (lead[-1] - lead[:-1]).max(initial=0)
    if (lead - low).max() < penalty and opening + closing < penalty:
        return np.full(len(scores), best)
    n, k = scores.shape
    value, own, back = scores[0].tolist(), range(k), []
    for row in scores[1:].tolist():
        high = max(value)
        top, high = value.index(high), high - penalty
        back.append([top if high > value[j] else j for j in own])
        value = [(high if high > value[j] else value[j]) + row[j] for j in own]
    out = np.empty(n, np.int64)
    out[-1] = at = value.index(max(value))
    for i in range(n - 2, -1, -1):
        out[i] = at = back[i][at]
    return out


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> LanguageModel:
    """A model of the documents (doc_id, text, lang) with a lang."""
    known = docs.select("doc_id", "text", "lang").filter("lang IS NOT NULL AND doc_id IS NOT NULL")
    languages = sorted(r[0] for r in known.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32), {})
    sample = None
    for language in languages:
        own = known.filter(F.col("lang") == language).select(F.col("doc_id").alias("_id")).orderBy(F.xxhash64("_id"), "_id").limit(per_language)
        sample = own if sample is None else sample.union(own)
    names = [s for _, s in SCRIPTS]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words: dict[str, Counter] = {}
            for part in slices(batch, "text"):
                for text, language in zip(part.column("text").to_pylist(), part.column("lang").to_pylist()):
                    words.setdefault(language, Counter()).update((text or "").split())
            for language, own in words.items():
                spelled: Counter = Counter()
                for token, n in own.items():
                    if letters := letters_of(token):
                        spelled[letters] += n
                if not spelled:
                    continue
                found: Counter = Counter()
                for letters, n in spelled.items():
                    found.update({-1 - names.index(s): n * k for s, k in Counter(map(script, letters)).items()})
                buckets, whose = grams(list(spelled))
                total = np.bincount(buckets, np.array(list(spelled.values()))[whose], BUCKETS).astype(np.int64)
                used = np.flatnonzero(total)
                values = np.concatenate([total[used], np.array(list(found.values()), np.int64)])
                keys = np.concatenate([used, np.array(list(found), np.int64)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([language] * len(keys)), pa.array(keys), pa.array(values)], ["lang", "gram", "n"])

    joined = known.join(F.broadcast(sample), F.col("doc_id") == F.col("_id"), "left_semi").select("text", "lang")
    got = joined.mapInArrow(count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((BUCKETS, len(languages)))
    by_script = np.zeros((len(SCRIPTS), len(languages)))
    place = {x: i for i, x in enumerate(languages)}
    for language, g, n in zip(got["lang"], got["gram"], got["n"]):
        if g >= 0:
            counts[g, place[language]] += n
        else:
            by_script[-1 - g, place[language]] += n
    table = np.log((counts + 0.5) / (counts.sum(0) + 0.5 * BUCKETS))
    letters = np.maximum(by_script.sum(0), 1)
    uses = {s: (by_script[[i for i, x in enumerate(names) if x == s]].sum(0) / letters >= USES).tolist() for s in set(names)}
    return LanguageModel(languages, table.astype(np.float32), uses)


def identify(docs: DataFrame, model: LanguageModel, penalty: float = SWITCH_PENALTY) -> DataFrame:
    """doc_id, lang_pred, score (share of the words with letters that have this label) and spans (first word, word behind the last, lang)."""
    fields = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, k = model.languages, len(model.languages)
        index: dict[str, int] = {}
        table, used = np.zeros((1 << 12, max(k, 1))), 0

        def learn(tokens: set[str]) -> None:
            nonlocal table, used
            spelled = {t: x for t in tokens if (x := letters_of(t))}
            index.update(dict.fromkeys(tokens, -1))
            if spelled:
                scores = model.word_scores(list(spelled.values()))
                while used + len(scores) > len(table):
                    table = np.concatenate([table, np.zeros_like(table)])
                table[used : used + len(scores)] = scores
                index.update(zip(spelled, range(used, used + len(scores))))
                used += len(scores)

        for batch in batches:
            for part in slices(batch, "text"):
                labels, shares, spans = [], [], []
                texts = [(t or "").split() if k else [] for t in part.column("text").to_pylist()]
                if new := {w for words in texts for w in words} - index.keys():
                    if len(index) + len(new) > 600_000:
                        index.clear()
                        used = 0
                        new = {w for words in texts for w in words}
                    learn(new)
                for words in texts:
                    found = list(map(index.__getitem__, words))
                    rows = np.array(found, np.int64)
                    at = np.flatnonzero(rows >= 0)
                    if not len(at):
                        labels.append("und")
                        shares.append(0.0)
                        spans.append([])
                        continue
                    path = viterbi(table[rows[at]], penalty)
                    votes = np.bincount(path, minlength=k)
                    labels.append(names[votes.argmax()])
                    shares.append(float(votes.max() / len(path)))
                    cuts = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(path)]
                    spans.append([{"start": int(at[a]), "end": int(at[b - 1]) + 1, "lang": names[path[a]]} for a, b in zip(cuts, cuts[1:])])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(labels, pa.string()), pa.array(shares, pa.float64()), pa.array(spans, fields)], ["doc_id", "lang_pred", "score", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>")
