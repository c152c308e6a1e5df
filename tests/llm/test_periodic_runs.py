"""Operator 11 against brute force over all periods, and the query on planted periods."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from memspark.llm import periodic_runs, registry

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(w):
    """All runs by trying each period; of stretches over the same words the least period counts."""
    n, found = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                found.append((i, j - i + q, q))
            i = max(j, i + 1)
    least = [x for x in found if not any(y[2] < x[2] and y[0] <= x[0] and y[0] + y[1] >= x[0] + x[1] for y in found)]
    return sorted(least, key=lambda x: (x[0], x[2]))


def kept(w, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def random_words(rng):
    n, k = rng.randint(0, 70), rng.randint(1, 4)
    w = [f"w{rng.randrange(k)}" for _ in range(n)]
    for _ in range(rng.randint(0, 2)):
        if n:
            a, p = rng.randrange(n), rng.randint(1, 9)
            b = min(n, a + p * rng.randint(1, 7) + rng.randint(0, p))
            w[a:b] = [w[a + (i - a) % p] for i in range(a, b)]
    return w


def test_runs_in_random_words():
    rng = random.Random(3)
    texts = [random_words(rng) for _ in range(1500)]
    sizes, runs, collapsed = periodic_runs._of_texts([" ".join(w) for w in texts])
    for w, size, r, c in zip(texts, sizes, runs, collapsed):
        assert size == len(w) and [tuple(x) for x in r.tolist()] == brute(w), w
        assert c.decode() == kept(w, brute(w))


def test_words_that_no_run_holds_are_the_only_ones_left_out():
    """The same runs with and without telling stretches apart."""
    rng = random.Random(4)
    for _ in range(300):
        w = np.array([int(x[1:]) for x in random_words(rng)], np.int64)
        whole = periodic_runs.runs_in(w).tolist()
        parts = [[s + a, n, q] for a, b in periodic_runs.stretches(w, np.zeros(len(w), np.int64)) for s, n, q in periodic_runs.runs_in(w[a:b]).tolist()]
        assert sorted(parts) == sorted(whole)


def test_common_extensions():
    rng = random.Random(5)
    w = [rng.randint(1, 2) for _ in range(400)]
    lce = periodic_runs.CommonExtensions([*w, 0], 3)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(2000)]
    pairs = [p for p in pairs if p[0] != p[1]]
    got = lce.shared(*map(np.array, zip(*pairs))).tolist()
    for (i, j), g in zip(pairs, got):
        n = 0
        while max(i, j) + n < 400 and w[i + n] == w[j + n]:
            n += 1
        assert g == n
    assert np.argsort(lce.rank).tolist() == sorted(range(401), key=lambda i: [*w, 0][i:])


@pytest.mark.parametrize("period", [1, 3, 700, 9000])
def test_very_long_text(period):
    w = [f"a{i}" for i in range(period)] * (40000 // period + 1)
    text = " ".join(["x", "y", *w[:40000], "z"])
    (size,), (runs,), (collapsed,) = periodic_runs._of_texts([text])
    assert size == 40003 and runs.tolist() == [[2, 40000, period]] and collapsed.decode() == " ".join(["x", "y", *w[:period], "z"])


def test_odd_rows(spark):
    schema = "runs string, doc_id long, text string, n_words int, collapsed string"
    texts = [None, "", " \n\t ", "one", "a a a a a", "a a a a a a", "a\x0bb a b a b\na b", "日 本 日 本 日 本 日 本", "x y " * 6]
    rows = [("clash", None if i == 8 else i % 7, t, 1, "clash") for i, t in enumerate(texts)] + [("clash", 5, "a a a a a a", 1, "clash")]
    got = periodic_runs.find_runs(spark.createDataFrame(rows, schema)).collect()
    have = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got)
    want = []
    for row in rows:
        w = WORDS.findall(row[2] or "")
        want.append((-1 if row[1] is None else row[1], len(w), brute(w), kept(w, brute(w))))
    assert have == sorted(want)
    assert periodic_runs.find_runs(spark.createDataFrame([], schema)).count() == 0


def test_query(spark, tmp_path):
    rng = random.Random(6)
    texts = [" ".join(random_words(rng) or [""]) for _ in range(300)] + [None, "", "a"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in registry.op11_periodic_runs(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    planted = 0
    for d, t in enumerate(texts):
        w = WORDS.findall(t or "")
        h, n = zlib.crc32(str(d).encode()), len(w)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w, planted = w[:a] + [w[a + (i - a) % p] for i in range(a, n)], planted + 1
        runs, r = brute(w), got[d]
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(kept(w, runs).encode()).hexdigest()
    assert planted > 10
