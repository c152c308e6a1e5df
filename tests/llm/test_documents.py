"""The document operators against brute force, on rows with every odd case."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from memspark.llm import binary_output, language_id, line_dedup, ngram_join, packing, sentencepiece_bpe, substring_dedup, toxicity
from memspark.llm.common import new_path
from memspark.llm.tokens import Encoder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, runs string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
BYTE, CLIP, PIECE = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))


def _texts():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeorst") for _ in range(rng.randint(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    base, passage, notice = prose(120), prose(30), "Licensed to all readers under one licence."
    near = base.split()
    near[60] = "changed"
    texts = [None, "", " \n ", "x", "one two three", base, base, " ".join(near), base.upper(), prose(40) + " " + passage, passage + "\n" + prose(25), passage, "a" * 5000, "é É ü x 日本 😀", "  lead  and   trail \n\n"]
    texts += [f"{prose(30)}\n{notice}\n{prose(10)}" for _ in range(8)] + [base.replace("a", "e", 1), " ".join(near[::-1]), "w " * 300]
    return texts


@pytest.fixture(scope="session")
def docs(spark):
    texts = _texts()
    rows = [(i, t, ["en", "de", None][i % 3], f"src{i % 6}" if i % 7 else None, None, "clash", None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3), dict(enumerate(texts))


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_substring_dedup(docs, empty):
    df, texts = docs
    seen, want = set(), {}
    for d, t in texts.items():
        w = WORDS.findall(t or "")
        gone = set()
        for p in range(len(w) - 19):
            k = tuple(w[p : p + 20])
            gone.update(range(p, p + 20) if k in seen else ())
            seen.add(k)
        want[d] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    names = ["doc_id", "text", "lang", "source", "n_chars", "c5", "c6", "kept", "n_words", "n_removed", "spans"]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup.repeats(df).toDF(*names).collect()}
    assert got == want
    assert sum(n for _, n, _ in want.values()) > 300
    assert substring_dedup.repeats(empty).count() == 0
    left = substring_dedup.remove_repeats(df)
    assert left.columns == df.columns and left.count() == len(texts)
    assert left.filter("doc_id = 0").first()["text"] is None


def test_seeds_are_extended_over_blocks_and_contexts(spark):
    """Passages in many contexts, within a document, over block edges, in documents of several blocks and near the end."""
    rng = random.Random(5)
    phrases = [[f"w{rng.randrange(40)}" for _ in range(rng.choice([6, 12, 25, 60, 400]))] for _ in range(25)]
    rows, seen, want = [], set(), {}
    for d in range(60):
        words = []
        for _ in range(rng.randrange(14)):
            words += rng.choice(phrases)[rng.randrange(3) :]
            if rng.random() < 0.4:
                words[rng.randrange(len(words))] = f"x{rng.randrange(5)}"
        rows.append((d, "\t ".join(words)))
        gone = set()
        for p in range(len(words) - 19):
            k = tuple(words[p : p + 20])
            gone.update(range(p, p + 20) if k in seen else ())
            seen.add(k)
        want[d] = (len(words), len(gone), " ".join(x for i, x in enumerate(words) if i not in gone))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup.repeats(df).collect()}
    assert got == want
    assert max(n for n, _, _ in want.values()) > 3 * substring_dedup.BLOCK and any(0 < g < n for n, g, _ in want.values())


def test_repeated_rows_and_null_ids(spark, docs):
    text = docs[1][5]
    df = spark.createDataFrame([(None, text), (None, None), (3, text), (3, text), (4, text)], "doc_id long, text string")
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_removed"]) for r in substring_dedup.repeats(df).collect())
    assert got == [(False, 0, 0), (False, 0, 0), (True, 3, 120), (True, 3, 120), (True, 4, 120)]
    links = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.link(df).collect()), key=str)
    assert links == [(3, 116, 3), (3, 116, 3), (4, 116, 3), (None, 0, None), (None, 116, None)]
    assert line_dedup.remove_lines(df.selectExpr("*", "cast(doc_id as string) source")).count() == 5


def test_texts_that_share_a_doc_id(spark):
    """Each text is judged by itself: one of them may be a copy, and another occur nowhere else."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (2, a), (2, b), (3, b + " " + c), (2, c), (None, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["text"]): r["n_removed"] for r in substring_dedup.repeats(df).collect()}
    assert got == {(1, a): 40, (2, a): 40, (2, b): 0, (3, b + " " + c): 80, (2, c): 0, (None, a): 0}
    links = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in ngram_join.link(df).collect()}
    assert links == {(1, 36): 1, (2, 36): 1, (3, 76): 3, (None, 36): None}
    near = " ".join(b.split()[:-1])
    found = ngram_join.link(spark.createDataFrame([(5, b), (4, near), (4, a), (7, a), (7, "x y z"), (8, c)], "doc_id long, text string"))
    assert {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in found.collect()} == {(4, 35): 4, (4, 36): 4, (5, 36): 4, (7, 36): 4, (7, 1): 4, (8, 36): 8}


def test_ngram_jaccard(docs, empty):
    df, texts = docs
    sets = {}
    for d, t in texts.items():
        w = WORDS.findall("".join(c.lower() if c.isascii() else c for c in t or ""))
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    label = {d: d for d in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    label[a] = label[b] = min(label[a], label[b])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.link(df).collect()}
    assert got == {d: (len(s), label[d]) for d, s in sets.items()}
    kept = ngram_join.keep_first(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d in label if label[d] == d)
    assert ngram_join.link(empty).count() == 0


def test_one_shingle_stands_for_those_of_equal_documents(spark):
    """A passage of many shingles in the same documents is one shingle for pairing, so their bitmaps aren't sent for each."""
    spread = spark.createDataFrame([(h, row, row, 90, h) for rows, shingles in (((1, 2, 3), range(40)), ((2, 3), range(40, 60)), ((4,), range(60, 70))) for h in shingles for row in rows], "h long, row long, doc long, size long, pos long")
    assert sorted(map(tuple, ngram_join.one_of_equal(spread).select("h", "row", "pos").collect())) == [(0, 1, 0), (0, 2, 0), (0, 3, 0), (40, 2, 40), (40, 3, 40)]


def test_links_between_members_that_no_leader_joins(spark):
    """A chain of documents in which each is near the next only, and a group around a common text."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[4 * i : 4 * i + 80])) for i in range(60)]
    rows += [(100 + i, " ".join(f"c{k}" if k % 100 != i else f"v{i}" for k in range(200))) for i in range(40)]
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {got[i] for i in range(60)} == {0}
    assert {got[100 + i] for i in range(40)} == {100}


@pytest.mark.parametrize("most", [line_dedup.MOST_TEXTS, 0])
def test_line_dedup(docs, empty, monkeypatch, most):
    """Whether the lists of removed lines are broadcast or not."""
    monkeypatch.setattr(line_dedup, "MOST_TEXTS", most)
    df, texts = docs
    site = {d: f"src{d % 6}" if d % 7 else "" for d in texts}
    where, first = {}, {}
    for d, t in texts.items():
        for p, line in enumerate((t or "").split("\n") if t is not None else []):
            if line.strip(" \t\n\x0b\f\r"):
                where.setdefault(line.strip(" "), set()).add(site[d])
                first.setdefault(line.strip(" "), (d, p))
    got = {r["doc_id"]: (r["text"], r["lines_removed"]) for r in line_dedup.remove_lines(df).select("doc_id", "text", "lines_removed").collect()}
    for d, t in texts.items():
        lines = t.split("\n") if t is not None else []
        keep = [x for p, x in enumerate(lines) if len(where.get(x.strip(" "), ())) < line_dedup.MIN_SITES or first[x.strip(" ")] == (d, p)]
        assert got[d] == (None if t is None else "\n".join(keep), len(lines) - len(keep))
    assert sum(n for _, n in got.values()) >= 7
    assert line_dedup.remove_lines(empty).count() == 0


def test_line_dedup_judges_short_lines(spark):
    """Lines of one to 19 characters on five sites go, those on four and blank ones stay."""
    rows = [(i, f"Les.\n\n \n\t\nown {i}\n x\nNt onor. The of it.\n{'Few.' if i < 4 else 'y'}", f"s{i}") for i in range(8)]
    got = {r["doc_id"]: (r["text"], r["lines_removed"]) for r in line_dedup.remove_lines(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got == {0: (rows[0][1], 0)} | {i: (f"\n \n\t\nown {i}\n{'Few.' if i < 4 else 'y'}", 3) for i in range(1, 8)}


@pytest.mark.parametrize("path", [BYTE, CLIP])
def test_encoder_equals_library(docs, path):
    texts = list(docs[1].values()) + ["don't we'll\nstop's ###", "x <|endoftext|> y", "a\x1cb　c İ Σς ΟΣ", "\n\nx\n", "ẞß ŉ ǅ"]
    encode, library = Encoder(path, 1), Tokenizer.from_file(path)
    want = [np.array(e.ids + [1], "<u4").tobytes() for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert encode(texts) == want and encode(texts) == want


def test_crc32c():
    assert binary_output.crc32c_of([b"123456789", b"\0" * 32, b"\xff" * 32]) == [0xE3069283, 0x8A9136AA, 0x62A8AB43]


def test_binary_records(spark, docs, empty):
    df, texts = docs
    encode, library = Encoder(CLIP, 1), Tokenizer.from_file(CLIP)
    path = new_path(spark, "records")
    binary_output.write_records(df, path, encode)
    got = sorted(binary_output.read_records(spark, path).select("doc_id", "start", "ids").collect())
    start = 0
    for (d, t), r in zip(texts.items(), got):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        assert (r["doc_id"], r["start"], np.frombuffer(r["ids"], "<u4").tolist()) == (d, start, ids)
        start += len(ids)
    a, b = ([r["doc_id"] for r in binary_output.read_shuffled(spark, path, seed).collect()] for seed in (1, 2))
    assert sorted(a) == sorted(b) == list(texts) and a != b
    assert binary_output.documents_as_records(spark, empty, encode).count() == 0
    record = bytearray(binary_output.frames([None], [np.array([5, 70000], "<u4").tobytes()])[0] + b"\n")
    assert binary_output.unframe(memoryview(record), [0]) == [(None, np.array([5, 70000], "<u4").tobytes())]
    record[20] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        binary_output.unframe(memoryview(record), [0])


def test_sentencepiece_equals_library(docs, empty):
    import sentencepiece

    df, texts = docs
    library, model = sentencepiece.SentencePieceProcessor(model_file=PIECE), sentencepiece_bpe.Model(PIECE)
    got = {r["doc_id"]: (r["ids"], r["decoded"]) for r in sentencepiece_bpe.encode_documents(df, PIECE).collect()}
    for d, t in texts.items():
        ids = library.encode(t or "")
        assert got[d] == (ids, library.decode(ids))
    rng = random.Random(2)
    for _ in range(2000):
        t = "".join(rng.choice("abcdeinort  .,\n(=-_▁é日😀<0xA>") for _ in range(rng.randint(1, 40)))
        assert np.frombuffer(model.encode(t), "<i4").tolist() == library.encode(t)
        ids = [rng.choice([rng.randrange(300), rng.randrange(32000), 28705]) for _ in range(rng.randint(1, 8))]
        assert model.decode(ids) == library.decode(ids)
    assert sentencepiece_bpe.encode_documents(empty, PIECE).count() == 0


def test_packing(docs, empty):
    df, texts = docs
    encode, library = Encoder(BYTE, 0), Tokenizer.from_file(BYTE)
    ids = {d: [*library.encode(t or "", add_special_tokens=False).ids, 0] for d, t in texts.items()}
    rows = packing.pack(packing.pieces_of(df, encode, 256), 256).collect()
    bins, at = {}, Counter()
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["piece"])):
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["start"] == at[r["doc_id"]] and r["ids_crc32"] == zlib.crc32(np.array(own, "<u4").tobytes())
        at[r["doc_id"]] += r["length"]
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert dict(at) == {d: len(x) for d, x in ids.items()}
    for places in bins.values():
        assert [o for o, _ in sorted(places)] == [0, *np.cumsum([n for _, n in sorted(places)]).tolist()[:-1]]
        assert sum(n for _, n in places) <= 256
    assert len(bins) <= math.ceil(sum(map(len, ids.values())) / 256) + 1
    packed = packing.pack(packing.pieces_of(df, encode, 256), 256)
    joined = {r["sequence_id"]: len(r["ids"]) // 4 for r in packing.sequences(df, packed, encode).collect()}
    assert sum(joined.values()) == sum(map(len, ids.values()))
    assert packing.pack(packing.pieces_of(empty, encode)).count() == 0


def test_texts_are_encoded_in_large_batches(spark):
    df = spark.createDataFrame([(i, "x" * 100_000) for i in range(30)], "doc_id long, text string").coalesce(1)
    together = lambda texts: [bytes(4 * len(texts))] * len(texts)
    assert {r["length"] for r in packing.pieces_of(df, together).collect()} == {30}


def test_packing_plan_replaces_the_smallest_by_two():
    # 6 + 3 leaves 1; 2 + 2 fill the gap of 4 that taking out 3 leaves.
    assert packing.plan({6: 1, 3: 1, 2: 2}, 10)[0] == (1, [(6, 1), (2, 2)])
    counts = {random.Random(1).randint(1, 50) + k: 1000 + k for k in range(100)}
    used = Counter()
    for times, filling in packing.plan(counts, 256):
        assert sum(n * k for n, k in filling) <= 256
        used.update({n: times * k for n, k in filling})
    assert used == counts


def test_toxicity(spark, empty):
    rng = random.Random(3)
    mild, harsh = ["silly", "dull"], ["vile", "rotten"]
    rows, labels = [], []
    for i in range(900):
        grade = i % 3
        words = ["".join(rng.choice("abcdefgh") for _ in range(3)) for _ in range(40)] + rng.sample(mild, 1) * (grade == 1) + rng.sample(harsh, 1) * (grade == 2)
        rng.shuffle(words)
        rows.append((i, " ".join(words).title() + ("," if i % 2 else "")))
        labels.append((i, grade))
    df = spark.createDataFrame([*rows, (1000, None), (1001, "")], "doc_id long, text string")
    model = toxicity.fit(df, spark.createDataFrame([*labels[:600], (5, None), (None, 1)], "doc_id long, toxic int"))
    assert model.grades == [0, 1, 2] and model.thresholds[0] < model.thresholds[1]
    got = {r["doc_id"]: r for r in toxicity.score(df, model).collect()}
    right = sum(got[i]["grade"] == i % 3 for i in range(600, 900))
    assert right > 285
    assert got[1000]["severity"] == got[1001]["severity"] and not got[1000]["rejected"]
    assert all(0 <= r["severity"] <= 2 and r["p_above"][0] >= r["p_above"][1] for r in got.values())
    nothing = toxicity.fit(df, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(df, nothing).filter("rejected OR severity IS NOT NULL").count() == 0
    assert toxicity.filter_toxic(empty, model).count() == 0 and toxicity.filter_toxic(empty, model).columns == empty.columns


def test_language_id(spark, empty):
    rng = random.Random(4)
    parts = {"aa": ["ka", "to", "mi", "ru"], "bb": ["sch", "ung", "eit", "ver"], "cc": ["бо", "ка", "ли", "ро"]}
    say = lambda x, n: " ".join("".join(rng.choice(parts[x]) for _ in range(rng.randint(1, 4))) for _ in range(n))
    rows = [(i, say(x := "abc"[i % 3] * 2, 30), x) for i in range(300)]
    model = language_id.train(spark.createDataFrame([*rows, (999, None, "aa"), (998, "x", None)], "doc_id long, text string, lang string"))
    assert model.languages == ["aa", "bb", "cc"]
    tests = [(1, say("aa", 20), None), (2, say("bb", 20), None), (3, say("aa", 30) + " " + say("bb", 12), None), (4, "12 34 !?", None), (5, None, None), (6, say("cc", 9), None), (7, "", None)]
    got = {r["doc_id"]: r for r in language_id.identify(spark.createDataFrame(tests, "doc_id long, text string, lang string"), model).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3, 4, 5, 6, 7)] == ["aa", "bb", "aa", "und", "und", "cc", "und"]
    assert [(s["start"], s["end"], s["lang"]) for s in got[3]["spans"]] == [(0, 30, "aa"), (30, 42, "bb")]
    assert got[4]["score"] == 0 and got[3]["score"] == pytest.approx(30 / 42)
    assert language_id.identify(empty, model).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(empty.union(spark.createDataFrame([(1, "a", "x", "y", 1, "", "")], SCHEMA)), language_id.train(empty)).collect()} == {"und"}


def test_viterbi_equals_enumeration():
    import itertools

    rng = np.random.default_rng(1)
    for _ in range(60):
        s = rng.normal(size=(6, 3)) * 3
        cost = lambda path: sum(s[i, x] for i, x in enumerate(path)) - 2.0 * sum(a != b for a, b in zip(path, path[1:]))
        best = max(map(cost, itertools.product(range(3), repeat=6)))
        assert cost(language_id.viterbi(s, 2.0).tolist()) == pytest.approx(best)


def test_viterbi_when_two_languages_share_a_switch():
    """A third language leads nowhere by the penalty, but two neighbouring stretches do together."""
    import itertools

    s = np.array([[0, -8, -3]] * 3 + [[-8, 0, -3]] * 3, float)
    assert language_id.viterbi(s, 12.0).tolist() == [0, 0, 0, 1, 1, 1]
    rng = np.random.default_rng(2)
    for n, k, penalty in [(1, 3, 12.0), (2, 3, 12.0), (6, 3, 12.0), (6, 4, 8.0), (5, 5, 4.0), (4, 2, 0.0)] * 60:
        s = np.maximum(-rng.exponential(4, (n, k)), -8)
        s[:, -1] = -3
        cost = lambda path: sum(s[i, x] for i, x in enumerate(path)) - penalty * sum(a != b for a, b in zip(path, path[1:]))
        assert cost(language_id.viterbi(s, penalty).tolist()) == pytest.approx(max(map(cost, itertools.product(range(k), repeat=n))))


def test_digest_of_kept_words(docs):
    from pyspark.sql import functions as F

    r = substring_dedup.repeats(docs[0].select("doc_id", "text")).select("kept", F.sha2("kept", 256).alias("h")).first()
    assert r["h"] == hashlib.sha256(r["kept"].encode()).hexdigest()
