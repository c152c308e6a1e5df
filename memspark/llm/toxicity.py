"""Operator 1: toxicity as an ordered severity grade, by cumulative-link regression.

P(grade > k) = logistic(w.x - t_k): one weight vector for all grades, and rising thresholds.
Features are the distinct words of the whole text (letters only, lower case), hashed; those
whose presence goes with the grade are kept. Expected severity is the mean grade under the
model. Fitting uses at most ``per_grade`` labelled documents of each grade, chosen by a hash of
the id, and all of them count: near copies (equal least hashes of five-word shingles) share the
weight of one document, so that their words aren't taken for those of many. Prediction reads
every document. The model doesn't depend on the order of rows.

Defined cases: a null or empty text has no features and gets the model's base severity;
labels that are null are not used, and repeated ones count once; an id with several grades is
fitted with each; with no labels severity is null, with labels of one grade it is that grade, and
nothing is rejected; of documents that share a doc_id one is fitted (that of the least features), and all are
scored one by one; of equally likely grades the lower one is given; very long texts are read
whole; an empty table gives no rows; further columns are kept by ``filter_toxic``, ignored by ``score``.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.llm.common import slices

PER_GRADE = 4000
BUCKETS = 1 << 18
#: A feature is kept if it is in so many sampled documents and its correlation with the grade is so many standard errors.
LEAST_DOCS, LEAST_Z = 3, 4.0
MOST_GRADES = 32
REJECT_FROM = 0.5
#: Near copies agree in so many least hashes of shingles of so many words.
SKETCH, SHINGLE = 4, 5

_NOT_LETTERS = re.compile(r"[\W\d_]+")


def feature(token: str) -> int:
    """The bucket of a token; -1 if it has no letters."""
    word = _NOT_LETTERS.sub("", token).lower()
    return zlib.crc32(word.encode()) % BUCKETS if word else -1


class _Memo(dict):
    """Tokens to what ``make`` gives for them; emptied when ``most`` have been met."""

    def __init__(self, make, most: int = 200_000):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, token: str):
        if len(self) >= self.most:
            self.clear()
        found = self[token] = self.make(token)
        return found


@dataclass
class SeverityModel:
    grades: list[float]
    weights: dict[int, float]
    thresholds: list[float]

    def exceed(self, x: np.ndarray) -> np.ndarray:
        """P(grade > k) for each row of linear scores and each threshold."""
        return 1 / (1 + np.exp(-np.clip(x[:, None] - np.array(self.thresholds)[None, :], -500, 500)))


def fit_scores(rows: np.ndarray, cols: np.ndarray, n_cols: int, y: np.ndarray, n_grades: int, steps: int = 400, l2: float = 2e-4, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Weights and rising thresholds by gradient steps (Adam); y holds ranks 0 .. n_grades - 1, counts how much each row counts. The first threshold is free, each next one adds exp(d)."""
    n, k = len(y), n_grades - 1
    part = np.full(n, 1 / n) if counts is None else counts / counts.sum()
    above = np.array([part[y > j].sum() for j in range(k)]).clip(0.5 / n, 1 - 0.5 / n)
    start = -np.log(above / (1 - above))
    params = np.concatenate([np.zeros(n_cols), start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    m, v = np.zeros_like(params), np.zeros_like(params)
    for t in range(1, steps + 1):
        w, gaps = params[:n_cols], np.exp(params[n_cols + 1 :])
        theta = params[n_cols] + np.concatenate([[0.0], np.cumsum(gaps)])
        x = np.bincount(rows, w[cols], minlength=n)
        s = 1 / (1 + np.exp(-np.clip(x[:, None] - theta[None, :], -500, 500)))
        s = np.concatenate([np.ones((n, 1)), s, np.zeros((n, 1))], 1)  # P(grade > -1) .. P(grade > last)
        hi, lo = s[np.arange(n), y], s[np.arange(n), y + 1]
        p = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = part * hi * (1 - hi) / p, part * lo * (1 - lo) / p
        g_x = d_lo - d_hi
        g_theta = np.array([d_hi[y == j + 1].sum() - d_lo[y == j].sum() for j in range(k)])
        grad = np.concatenate([np.bincount(cols, g_x[rows], minlength=n_cols) + l2 * w, [g_theta.sum()], np.cumsum(g_theta[::-1])[::-1][1:] * gaps])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        rate = 0.1 * min(1.0, 2 * (1 - t / steps))  # steps of one size would circle the optimum
        params = params - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return params[:n_cols], params[n_cols] + np.concatenate([[0.0], np.cumsum(np.exp(params[n_cols + 1 :]))])


def fit(docs: DataFrame, labels: DataFrame, grade: str = "toxic", per_grade: int = PER_GRADE) -> SeverityModel:
    """The model of ``labels`` (doc_id, grade) and the texts of ``docs``; the sample's size is bounded, so it is broadcast and its features collected."""
    known = labels.select(F.col("doc_id").alias("_id"), F.col(grade).cast("double").alias("_grade")).filter("_grade IS NOT NULL AND _id IS NOT NULL").distinct()
    grades = sorted(r[0] for r in known.select("_grade").distinct().limit(MOST_GRADES + 1).collect())
    if len(grades) > MOST_GRADES:
        raise ValueError(f"more than {MOST_GRADES} grades")
    if len(grades) < 2:
        return SeverityModel(grades, {}, [])
    order = (F.xxhash64("_id"), F.col("_id"))
    sample = None
    for g in grades:
        own = known.filter(F.col("_grade") == g).orderBy(*order).limit(per_grade)
        sample = own if sample is None else sample.union(own)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Memo(feature)
        for batch in batches:
            for part in slices(batch, "text"):
                words = [(t or "").split() for t in part.column("text").to_pylist()]
                found = [sorted({memo[w] for w in set(own)} - {-1}) for own in words]
                columns = [part.column("_id"), part.column("_grade"), pa.array(found, pa.list_(pa.int32())), pa.array(map(_sketch, words), pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["_id", "_grade", "features", "sketch"])

    joined = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_id")).select("_id", "_grade", "text")
    made = joined.mapInArrow(features, "_id long, _grade double, features array<int>, sketch string")
    # One row for each sampled id, however often it occurs.
    got = made.groupBy("_id", "_grade").agg(F.min(F.struct("features", "sketch")).alias("row")).select("_id", "_grade", "row.features", "row.sketch").toArrow()
    kept = sorted(zip(*(got.column(c).to_pylist() for c in ("_grade", "_id", "sketch", "features"))))
    copies = Counter((g, sketch) for g, _, sketch, _ in kept)
    counts = np.array([1 / copies[g, sketch] for g, _, sketch, _ in kept])
    raw = np.array([f for *_, x in kept for f in x], np.int64)
    rows = np.repeat(np.arange(len(kept)), [len(x) for *_, x in kept])
    y = np.searchsorted(grades, [g for g, *_ in kept])
    if len(set(y.tolist())) < 2:
        return SeverityModel(grades[:1], {}, [])

    n = counts.sum()
    held = np.bincount(raw, counts[rows], minlength=BUCKETS)
    share, best = held / n, np.zeros(BUCKETS)
    for k in range(len(grades) - 1):  # words of a middle grade tell it from those below or above
        mean = counts[y > k].sum() / n
        centred = (y > k) - mean
        with np.errstate(divide="ignore", invalid="ignore"):
            z = np.bincount(raw, (counts * centred)[rows], minlength=BUCKETS) / np.sqrt(n * share * (1 - share) * mean * (1 - mean))
        best = np.maximum(best, np.abs(np.nan_to_num(z)))
    chosen = np.flatnonzero((held >= LEAST_DOCS - 1e-9) & (best >= LEAST_Z))
    place = np.full(BUCKETS, -1)
    place[chosen] = np.arange(len(chosen))
    used = place[raw] >= 0
    w, theta = fit_scores(rows[used], place[raw[used]], len(chosen), y, len(grades), counts=counts)
    return SeverityModel(grades, dict(zip(chosen.tolist(), w.tolist())), theta.tolist())


def _sketch(words: list[str]) -> str:
    """The least hashes of a text's shingles; a text of fewer words is one shingle."""
    shingles = {" ".join(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))}
    return " ".join(map(str, heapq.nsmallest(SKETCH, (zlib.crc32(s.encode()) for s in shingles))))


def score(docs: DataFrame, model: SeverityModel) -> DataFrame:
    """doc_id, severity (expected grade), grade (the likeliest) and rejected of each document, and p_above, P(grade > k) for each k."""
    return docs.select("doc_id", "text").mapInArrow(_scorer(model, ["doc_id"]), "doc_id long, severity double, grade double, rejected boolean, p_above array<double>")


def filter_toxic(docs: DataFrame, model: SeverityModel) -> DataFrame:
    """The documents that are not rejected, with all their columns."""
    return docs.mapInArrow(_scorer(model, docs.columns, only_kept=True), docs.schema)


def _scorer(model: SeverityModel, columns: list[str], only_kept: bool = False):
    names = [*columns, "severity", "grade", "rejected", "p_above"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = model.weights
        memo = _Memo(lambda token: f if (f := feature(token)) in weights else None)
        values = np.array(model.grades)
        for batch in batches:
            for part in slices(batch, "text"):
                n = part.num_rows
                if len(values) < 2:
                    base = float(values[0]) if len(values) else None
                    more = [pa.array([base] * n, pa.float64())] * 2 + [pa.array([False] * n), pa.array([[]] * n, pa.list_(pa.float64()))]
                else:
                    found = ({memo[w] for w in set((t or "").split())} for t in part.column("text").to_pylist())
                    above = model.exceed(np.array([sum(weights[f] for f in sorted(x - {None})) for x in found], float))
                    severity = values[0] + above @ np.diff(values)
                    single = -np.diff(np.concatenate([np.ones((n, 1)), above, np.zeros((n, 1))], 1))
                    limit = values[0] + REJECT_FROM * (values[-1] - values[0])
                    more = [pa.array(severity), pa.array(values[single.argmax(1)]), pa.array(severity >= limit), pa.array(above.tolist(), pa.list_(pa.float64()))]
                if only_kept:
                    yield part.filter(pc.invert(more[2]))
                else:
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), *more], names)

    return run
