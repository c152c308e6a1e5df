"""The corpus pipeline against brute force, stage by stage, and the fit of the toxicity model against its likelihood."""

import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from memspark.llm import line_dedup, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def _documents():
    rng = random.Random(8)
    prose = lambda n: " ".join("".join(rng.choice("abcdeorst") for _ in range(rng.randint(2, 6))) for _ in range(n))
    passage, base, texts = prose(60), prose(150), {}
    for i in range(160):
        t = prose(rng.randint(5, 60))
        t += f"\n{'vile rotten' if i % 4 == 0 else 'calm'}\n"
        t += "Share this page\n" if i % 3 == 0 else ""
        texts[i] = t + prose(10)
    texts |= {200 + i: prose(20) + " " + passage + " " + prose(20) for i in range(6)}
    texts |= {300 + i: base + f" end{i}" for i in range(5)} | {310: base, 311: base, 320: None, 321: "", 322: "vile rotten vile"}
    return texts


def _toxic(text, model):
    found = {toxicity.feature(w) for w in (text or "").split()} - {-1}
    x = sum(model.weights.get(f, 0.0) for f in found)
    severity = model.grades[0] + sum(d / (1 + math.exp(t - x)) for d, t in zip(np.diff(model.grades), model.thresholds))
    return severity >= model.grades[0] + toxicity.REJECT_FROM * (model.grades[-1] - model.grades[0])


def _without_lines(texts, site):
    where, first = {}, {}
    for d, t in sorted(texts.items()):
        for p, line in enumerate((t or "").split("\n")):
            if line.strip():
                where.setdefault(line.strip(" "), set()).add(site(d))
                first.setdefault(line.strip(" "), (d, p))
    stays = lambda d, p, x: len(where.get(x.strip(" "), ())) < line_dedup.MIN_SITES or first[x.strip(" ")] == (d, p)
    return {d: None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if stays(d, p, x)) for d, t in texts.items()}


def _without_near_copies(texts):
    words = {d: WORDS.findall((t or "").lower()) for d, t in texts.items()}
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for d, w in words.items()}
    label = {d: d for d in sets}
    while True:
        before = dict(label)
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
        if before == label:
            return {d: t for d, t in texts.items() if label[d] == d}


def _without_passages(texts):
    seen, out = set(), {}
    for d, t in sorted(texts.items()):
        w, gone = WORDS.findall(t or ""), set()
        for p in range(len(w) - 19):
            gone.update(range(p, p + 20) if tuple(w[p : p + 20]) in seen else ())
            seen.add(tuple(w[p : p + 20]))
        out[d] = " ".join(x for i, x in enumerate(w) if i not in gone) if gone else t
    return out


def _write(spark, path, texts, labels):
    rows = [(d, t, "en", f"s{d % 7}", len(t or "")) for d, t in texts.items()]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")


def test_stages_equal_brute_force(spark, tmp_path):
    texts = _documents()
    labels = [(i, 2 * (i % 4 == 0)) for i in range(120)]
    _write(spark, tmp_path, texts, labels)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    want = [texts]
    want.append({d: t for d, t in texts.items() if not _toxic(t, model)})
    want.append(_without_lines(want[-1], lambda d: d % 7))
    want.append(_without_near_copies(want[-1]))
    want.append(_without_passages(want[-1]))
    assert 322 not in want[1] and {d for d in want[1] if d < 160} == {i for i in range(160) if i % 4}
    assert sum(x != y for x, y in zip(want[1].values(), want[2].values())) > 20
    assert len(want[3]) == len(want[2]) - 6 and sum(want[3][d] != want[4][d] for d in want[4]) == 5
    names = ["toxicity", "line_dedup", "ngram_jaccard", "substring_dedup", "best_fit_packing"]
    assert [name for name, _ in corpus_pipeline.STAGES] == names
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert {r["doc_id"]: r["text"] for r in docs.collect()} == want[k + 1], name
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {d: [*library.encode(t or "", add_special_tokens=False).ids, 0] for d, t in want[4].items()}
    places, at = {}, dict.fromkeys(ids, 0)
    for r in sorted(corpus_pipeline.run(spark, str(tmp_path)).collect(), key=lambda r: (r["doc_id"], r["piece"])):
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["start"] == at[r["doc_id"]] and r["ids_crc32"] == zlib.crc32(np.array(own, "<u4").tobytes())
        at[r["doc_id"]] += r["length"]
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert at == {d: len(x) for d, x in ids.items()}
    for own in places.values():
        own.sort()
        assert [o for o, _ in own] == [0, *np.cumsum([n for _, n in own]).tolist()[:-1]] and sum(n for _, n in own) <= 2048
    assert len(places) <= math.ceil(sum(map(len, ids.values())) / 2048) + 1


@pytest.mark.parametrize("rows", [[], [(None, None), (None, "a"), (4, "a b"), (4, "a b"), (4, None), (5, "")]])
def test_odd_rows(spark, tmp_path, rows):
    """Empty tables, null ids and texts, and repeated rows pass through all stages: one piece for each row here."""
    spark.createDataFrame([(d, t, None, None, None) for d, t in rows], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    found = [r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sorted(map(str, found)) == sorted(str(d) for d, _ in rows)


def test_columns_with_clashing_names(spark, tmp_path):
    """Columns named like those that the stages make are kept with their values."""
    names = "lines_removed gone id row pos line kept n_words n_removed spans again later copy severity grade rejected p_above _id _grade features sketch c0 removed doc t h".split()
    rows = [(i, f"{['vile', 'calm'][i % 2]} words here {i}\nShare this page\nmore of the text {i}", "en", f"s{i}", None, *range(len(names))) for i in range(30)]
    spark.createDataFrame(rows, SCHEMA + "".join(f", `{n}` long" for n in names)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1 - i % 2) for i in range(30)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == [*SCHEMA.replace(" long", "").replace(" string", "").split(", "), *names], name
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert {tuple(r[5:]) for r in docs.collect()} == {tuple(range(len(names)))}, name
    assert sum("Share" in r.text for r in docs.collect()) == 1
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 15


def _model(spark, texts, labels):
    df = spark.createDataFrame([(i, t, "en", "s", None) for i, t in texts], SCHEMA).repartition(3)
    return toxicity.fit(df, spark.createDataFrame(labels, "doc_id long, toxic int").repartition(2))


def test_long_texts_of_one_vocabulary_all_count(spark, monkeypatch):
    """600 texts that share all frequent words, and so their least word hashes, are fitted as 600."""
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdeorst") for _ in range(6)) for _ in range(80)]
    texts = [(i, " ".join(rng.choices(words, k=400)) + (" vile" if i % 3 == 0 else "")) for i in range(600)]
    copies = [(1000 + i, texts[0][1] + f" end{i}") for i in range(50)]
    labels = [(i, int(i % 3 == 0)) for i in range(600)] + [(1000 + i, 1) for i in range(50)]
    seen = []
    plain = toxicity.fit_scores
    monkeypatch.setattr(toxicity, "fit_scores", lambda rows, cols, n, y, k, counts: seen.append(counts) or plain(rows, cols, n, y, k, counts=counts))
    model = _model(spark, texts + copies, labels)
    # All 650 rows are fitted; the 51 near copies weigh as much as one text.
    assert len(seen[0]) == 650 and (seen[0] == 1).sum() == 599 and seen[0].sum() == pytest.approx(600)
    assert model.weights[toxicity.feature("vile")] > 1
    # Rows the other way round, and every row thrice, give the same model.
    again = _model(spark, (texts + copies)[::-1] * 3, labels[::-1] * 2)
    assert again.weights == pytest.approx(model.weights) and again.thresholds == pytest.approx(model.thresholds)


def test_fit_reaches_the_likelihoods_optimum():
    """The gradient of the penalised likelihood, taken numerically from its definition, is zero at the fitted values."""
    rng = np.random.default_rng(3)
    n, k, l2 = 300, 6, 2e-2
    x = rng.random((n, k)) < 0.4
    lean = x @ np.array([2.0, 1.0, 0.0, -1.0, 0.5, 0.0]) + rng.logistic(size=n)
    y = (lean > 0.5).astype(int) + (lean > 1.5) + (lean > 3)
    rows, cols = np.nonzero(x)
    w, theta = toxicity.fit_scores(rows, cols, k, y, 4, steps=4000, l2=l2)

    def loss(p):
        above = 1 / (1 + np.exp(-(x @ p[:k])[:, None] + p[None, k:]))
        above = np.concatenate([np.ones((n, 1)), above, np.zeros((n, 1))], 1)
        return -np.log(above[np.arange(n), y] - above[np.arange(n), y + 1]).mean() + l2 / 2 * (p[:k] ** 2).sum()

    at = np.concatenate([w, theta])
    slope = [(loss(at + e) - loss(at - e)) / 2e-5 for e in np.eye(k + 3) * 1e-5]
    assert np.abs(slope).max() < 1e-3 and (np.diff(theta) > 0).all()
    assert loss(at) < loss(np.concatenate([np.zeros(k), theta]))
