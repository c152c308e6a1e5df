"""Operator 13 against a plain computation: patterns, tests of matches, and what terms tell."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

from memspark.llm import registry, sanitise

SCHEMA = "doc_id long, text string, email string, row long, term string, spans string"
PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
BLANK, WORD = r"\x20\x09-\x0D", r"""[("'\[]*([^\W\d_]{3,})[.,;:!?)"'\]]*"""


def digits(v):
    return re.sub("[^0-9]", "", v)


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def passes(kind, v):
    if kind == "ip":
        return all(int(p) <= 255 for p in v.split("."))
    if kind == "card":
        return 16 <= len(digits(v)) <= 19 and luhn(digits(v))
    return kind != "phone" or 8 <= len(digits(v)) <= 15


def base(text):
    return {k: [(m.start(), m.end(), m.group()) for m in p.finditer(text or "") if passes(k, m.group())] for k, p in PLAIN.items()}


def words(text):
    """(start, end, term) of the words that are terms."""
    out = []
    for m in re.finditer(f"[^{BLANK}]+", text or ""):
        if own := re.fullmatch(WORD, m.group()):
            out.append((m.start() + own.start(1), m.start() + own.end(1), own.group(1).lower()))
    return out


def whole(text, a, b):
    """The stretch between blanks around a term."""
    while a and not re.match(f"[{BLANK}]", text[a - 1]):
        a -= 1
    while b < len(text) and not re.match(f"[{BLANK}]", text[b]):
        b += 1
    return a, b


def entity(kind, v):
    return f"{kind}:" + (v.lower() if kind == "email" else v if kind == "ip" else digits(v))


def general(e):
    kind, v = e.split(":", 1)
    return {"email": f"{kind}:@{v.rpartition('@')[2]}", "ip": f"{kind}:" + ".".join(v.split(".")[:2])}.get(kind, e[: 11 if kind == "card" else 10])


def disclosing(texts):
    """What each term tells about each entity, from all texts."""
    n, both, class_both, ent, gen, contexts, df = len(texts), Counter(), Counter(), Counter(), Counter(), defaultdict(set), Counter()
    for t in texts:
        own, seen = words(t), []
        for kind, spans in base(t).items():
            bounds = [(m.start(), m.end()) for m in PLAIN[kind].finditer(t or "")]
            for s, e, v in spans:
                last, next_ = max((y for _, y in bounds if y <= s), default=-1), min((x for x, _ in bounds if x >= e), default=len(t) + 1)
                # Words between blanks, the neighbours' matches and the cut.
                front = [w for a, b, w in own if whole(t, a, b)[1] < s and whole(t, a, b)[0] > last and whole(t, a, b)[0] > s - 300]
                behind = [w for a, b, w in own if whole(t, a, b)[0] > e and whole(t, a, b)[1] < next_ and whole(t, a, b)[1] < e + 300]
                seen.append((entity(kind, v), front[-10:] + behind[:10]))
        ent.update({e for e, _ in seen})
        gen.update({general(e) for e, _ in seen})
        both.update({(e, w) for e, ws in seen for w in ws})
        class_both.update({(e, w[:3] + "*") for e, ws in seen for w in ws})
        for e, ws in seen:
            for w in ws:
                contexts[e, w].add(tuple(ws))
        df.update({w for _, _, w in own} | {w[:3] + "*" for _, _, w in own})
    found = {}
    for (e, w), c in both.items():
        limit = max(math.log2(n / gen[general(e)]), 0.95 * math.log2(n / ent[e])) - 1e-9
        if len(contexts[e, w]) >= 3 and ent[e] < n and math.log2(c * n / ent[e] / df[w]) >= limit:
            k = w[:3] + "*"
            hides = math.log2(class_both[e, k] * n / ent[e] / df[k]) < limit
            found[w] = found.get(w, True) and hides
    return {w: w[:3] + "*" if hides else "[term]" for w, hides in found.items()}


def expected(texts):
    told = disclosing(texts)
    out = []
    for t in texts:
        spans = base(t) | {"term": [(a, b, w) for a, b, w in words(t) if w in told]}
        cover, parts, upto = sorted((a, b, told[v] if k == "term" else f"[{k}]") for k, x in spans.items() for a, b, v in x), [], 0
        for a, b, label in cover:
            if a >= upto:
                parts += [t[upto:a], label]
            upto = max(upto, b)
        out.append((spans, None if t is None else "".join(parts) + t[upto:]))
    return out, told


def text_line(spans, kinds):
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b, _ in spans[k])


ODD = [
    None, "", " ", "nothing here", "a@b", "a@b.c", "x a@b.c.d-e.f. y", "@a@b.c", "a@b.c%d@e.f", "..%@-.-", "é\U0001F600ñjoe@x.org ü", "joe@x.org,ann@y.org;joe@x.org", "a@b..c a@b.c..d",
    "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1 0255.0.00.1 1.2.3.256", "999999999999999999999.1.1.1", "1.2.3", "x1.22.33.44y", "4111111111111111", "4111 1111-1111 1111", "4111  1111 1111 1111", "41111111111111111234",
    "0000000000000000", "4111111111111112", "+4915112345678", "+49 (151) 123-45.67", "+1 2", "+1(23)45678 ", "+1234567890123456", "+ 123456789", "+12345678)", "++49 1511 2345678+49 1511 2345678",
    "a" * 3000 + "@", "9" * 3000, "1." * 2000, "+1" + "(" * 2000, "a.b@" + "c." * 2000, " ".join(["4111111111111111", "x@y.zz"] * 700),
]


def corpus():
    rng = random.Random(9)
    some = ["the", "river", "runs", "over", "stones", "and", "under", "bridges", "while", "people", "walk", "home", "rivet"]
    prose = lambda n: " ".join(rng.choice(some) for _ in range(n))
    texts = [prose(25) for _ in range(60)]
    texts += [f"{prose(14)} Zorblat, ({prose(2)}) joe@acme.org {prose(12)}" for _ in range(12)] + [f"{prose(9)} about zorblat: {prose(4)}"]
    texts += [f"{prose(12)} ann@acme.org Quillon {prose(12)}" for _ in range(3)] + [f"{prose(3)} quilted {prose(3)}"] * 4
    texts += [f"same words only Hapax bob@other.net and more of the same words {'x' * 5}"] * 6
    texts += [f"{prose(12)} call +49 151 1234567 for Wexford {prose(20)}" for _ in range(4)] + [f"w:joe@acme.org {prose(11)}"] * 2
    return texts + ODD


def test_against_plain_computation(spark):
    texts = corpus()
    df = spark.createDataFrame([(i, t, "clash", 1, "clash", "clash") for i, t in enumerate(texts)], SCHEMA).repartition(5)
    want, told = expected(texts)
    assert {"zorblat", "wexford"} <= set(told) and "hapax" not in told and told["quillon"] == "qui*" and told["zorblat"] == "[term]"
    kinds = (*sanitise.BASE, "term")
    got = {r.d: r.s for r in sanitise.find_private(df).selectExpr("row.c0 d", "email", "ip", "card", "phone", "term").select("d", sanitise.listed(kinds).alias("s")).collect()}
    for i, (spans, _) in enumerate(want):
        assert got[i] == text_line(spans, kinds), texts[i]
    out = sanitise.sanitised(df)
    assert out.columns == df.columns
    got = {r.doc_id: r.text for r in out.collect()}
    assert [got[i] for i in range(len(texts))] == [t for _, t in want]


def test_only_words_that_may_disclose_are_counted(spark, monkeypatch):
    counted, cut = {}, sanitise.cut

    def held(df, label):
        out = cut(df, label)
        if label == "counted":
            counted.update((r.word, r.n) for r in out.collect())
        return out

    monkeypatch.setattr(sanitise, "cut", held)
    texts = corpus()
    told = {r.term: r.replacement or "[term]" for r in sanitise.disclosing_terms(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert told == disclosing(texts)
    assert {"zorblat": 13, "wexford": 4}.items() <= counted.items() and not {"the", "river", "stones"} & set(counted)


def test_query(spark, tmp_path):
    texts = corpus()
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want, _ = expected(texts)
    got = {r.doc_id: r for r in registry.op13_sanitise(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    for i, (spans, _) in enumerate(want):
        r = got[i]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(len(spans[k]) for k in sanitise.BASE)
        assert r.base_sha256 == hashlib.sha256(text_line(spans, sanitise.BASE).encode()).hexdigest()
        assert r.spans == text_line(spans, (*sanitise.BASE, "term"))


def test_empty_and_repeated(spark):
    assert sanitise.sanitised(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, "x joe@acme.org", None, None, None, None)] * 3 + [(None, "y 1.2.3.4", None, None, None, None)]
    got = sorted(r.text for r in sanitise.sanitised(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == ["x [email]"] * 3 + ["y [ip]"]


def test_very_long_texts(spark):
    """Texts on which a search that goes back would not end."""
    many = " ".join(["+49 151 2345678 is", "x@y.zz"] * 20000)
    texts = ["a" * 2_000_000 + "@", "9" * 2_000_000, "1." * 500_000, "+1" + "(" * 1_000_000, "a.b@" + "c." * 500_000 + "d", many]
    rows = spark.createDataFrame([(i, t, None, None, None, None) for i, t in enumerate(texts)], SCHEMA)
    got = {r.d: r for r in sanitise.find_private(rows).selectExpr("row.c0 d", "size(email) email", "size(ip) ip", "size(phone) phone", "try_element_at(email, -1).end last").collect()}
    assert [got[i].email for i in range(6)] == [0, 0, 0, 0, 1, 20000] and got[2].ip == 125_000 and got[5].phone == 20000
    assert got[5].last == len(many) and got[4].last == len(texts[4])
