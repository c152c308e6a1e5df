"""Operator 13: personal data, and the terms that give it away, with DataFrame functions only.

Base spans are e-mail addresses, IP addresses, card and phone numbers, found by patterns. Their
distinct values are the protected entities. How much a term tells about an entity is estimated
from all documents by pointwise mutual information, ``log2(p(c, t) / (p(c) p(t)))``, where a term
and an entity occur together if the term is among the ``NEAR`` terms on either side of it, up to the
next match of its kind and ``NEAR_CHARS`` characters. An
entity's information is ``-log2 p(c)``. A term discloses an entity if it tells at least as much
as the entity's generalisation does (an address's domain, a network, a number's first digits),
and the share ``disclosure`` of the entity's information, and was seen beside it between
``least_contexts`` different contexts at least, so copies of one text are no evidence.

Disclosing terms become spans of kind ``term`` wherever they stand. A term's own generalisation is
the class of words with its first letters: where that class stays below all thresholds, it
replaces the term, else the term is removed.

Only words that may matter are counted in all texts: a word's documents are at least those that hold
it beside any entity, and pairs that tell too little by that count are settled without another.

Patterns never start in the middle of a stretch that they have tried before, which gives the same
matches in linear time. Counts are summed before they are shuffled, so that an entity or a word
in a third of all documents is a row for each task. Texts are shuffled only if so many documents
hold disclosing terms that Spark can't broadcast their list.

Defined cases: a null text is an empty one and has no spans, and ``sanitised`` keeps it null; rows
with equal texts count as documents each, and get equal spans; a match that fails its test is
left out, and the search goes on behind it; overlapping spans of several kinds all count, and
``sanitised`` replaces them by the label of the one that starts first; very long texts are searched
whole; an empty table gives no rows; further columns are kept by ``sanitised``, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.llm.common import cut, drop, let

#: Patterns: fixed values of the contract, written so that each stretch is tried once.
_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]++"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_LABEL}(?:\.{_LABEL})++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
BASE = tuple(PATTERNS)
_PART = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})"
IP_PARTS = rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$"
#: A word of letters between blanks, with or without signs around it.
TERM = r"""(?<![^\x20\x09-\x0D])[("'\[]*+(\p{L}{3,}+)[.,;:!?)"'\]]*+(?![^\x20\x09-\x0D])"""
_BLANK = r"\x20\x09-\x0D"
_LETTERS, _LEADING = r"\p{L}+", r"""^[("'\[]*"""

#: Words on each side of an entity that occur together with it, and the characters that may hold them.
NEAR, NEAR_CHARS = 10, 300
DISCLOSURE, LEAST_CONTEXTS = 0.95, 3
#: Letters that a term's class keeps.
CLASS_LETTERS = 3
#: Lengths that are summed one by one; longer lists are summed in two steps.
_STEP = 64


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def _before(lengths: Column) -> Column:
    """For each entry of a list that is not empty the sum of those in front of it."""
    upto = lambda n: F.sequence(F.lit(0), n)

    def with_blocks(all_: Column, blocks: Column) -> Column:
        ahead = F.transform(upto(F.size(blocks) - 1), lambda g: _sum(F.slice(blocks, 1, g)))
        return let(ahead, lambda p: F.transform(all_, lambda _, i: p[F.floor(i / _STEP).cast("int")] + _sum(F.slice(all_, i - i % _STEP + 1, i % _STEP))))

    sums = lambda all_: F.transform(upto(F.floor((F.size(all_) - 1) / _STEP).cast("int")), lambda g: _sum(F.slice(all_, g * _STEP + 1, _STEP)))
    return let(lengths, lambda all_: let(sums(all_), lambda blocks: with_blocks(all_, blocks)))


def _found(text: Column, pattern: str, beside: bool = False) -> Column:
    """start, end (code points) and value of all matches, leftmost first, and with ``beside`` the characters in front and behind."""

    def spans(pieces: Column, values: Column) -> Column:
        lengths = F.transform(values, lambda v, i: F.length(pieces[i]) + F.length(v))
        # The text's edges count as blanks.
        front = lambda i: F.substring(F.concat(F.when(i == 0, " ").otherwise(""), pieces[i]), -NEAR_CHARS, NEAR_CHARS)
        behind = lambda i: F.substring(F.concat(pieces[i + 1], F.when(i + 1 == F.size(values), " ").otherwise("")), 1, NEAR_CHARS)
        if not beside:
            make = lambda v, start, i: F.struct(start.alias("start"), (start + F.length(v)).alias("end"), v.alias("value"))
        else:
            make = lambda v, start, i: F.struct(start.alias("start"), (start + F.length(v)).alias("end"), v.alias("value"), front(i).alias("front"), behind(i).alias("behind"))
        return let(_before(lengths), lambda before: F.transform(values, lambda v, i: make(v, before[i] + F.length(pieces[i]), i)))

    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(values, lambda v: F.when(F.size(v) > 0, let(F.split(text, pattern, -1), lambda p: spans(p, v))))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _holds(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(IP_PARTS)
    if kind == "card":
        return let(_digits(value), lambda d: F.length(d).between(16, 19) & F.call_function("luhn_check", d))
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str, beside: bool = False) -> Column:
    """The spans of one kind in ``text`` (null: empty) that pass its test."""
    may = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}.get(kind, text.rlike("[0-9]"))
    empty = "array<struct<start: int, end: int, value: string" + (", front: string, behind: string>>" if beside else ">>")
    found = F.filter(_found(text, PATTERNS[kind], beside), lambda x: _holds(kind, x["value"]))
    return F.coalesce(F.when(may, found), F.array()).cast(empty)


def _terms(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(1)), F.lower)


def _class(term: Column) -> Column:
    return F.concat(F.substring(term, 1, CLASS_LETTERS), F.lit("*"))


def _entity(kind: str, value: Column) -> Column:
    """What is protected: the value without signs that may differ, behind its kind; it has no blanks."""
    plain = {"email": F.lower, "ip": lambda v: v}.get(kind, _digits)
    return F.concat(F.lit(f"{kind}:"), plain(value))


def _general(entity: Column) -> Column:
    """An entity's generalisation: the domain, the network, or the first digits."""
    is_a = lambda kind: entity.startswith(f"{kind}:")
    domain, network = F.concat(F.lit("email:@"), F.substring_index(entity, "@", -1)), F.substring_index(entity, ".", 2)
    return F.when(is_a("email"), domain).when(is_a("ip"), network).when(is_a("card"), F.substring(entity, 1, 11)).otherwise(F.substring(entity, 1, 10))


def _occurrence(kind: str, x: Column) -> Column:
    """An entity with the terms beside it, up to the next match of its kind; words that the cut has shortened, or that touch a match, are none."""
    edges = rf"^[^{_BLANK}]*|[^{_BLANK}]*$"
    front, behind = F.regexp_replace(x["front"], edges, ""), F.regexp_replace(x["behind"], edges, "")
    near = F.concat(let(_terms(front), lambda t: F.slice(t, F.greatest(F.size(t) - NEAR + 1, F.lit(1)), NEAR)), F.slice(_terms(behind), 1, NEAR))
    return F.struct(_entity(kind, x["value"]).alias("entity"), near.alias("terms"))


def occurrences(docs: DataFrame) -> DataFrame:
    """seen: the entities of each document that has any, one for each place, with the terms beside it."""
    text = F.coalesce("text", F.lit(""))
    of_kind = lambda kind: F.transform(base_spans(text, kind, True), lambda x: _occurrence(kind, x))
    return docs.select(F.concat(*(of_kind(kind) for kind in BASE)).alias("seen")).filter(F.size("seen") > 0)


def disclosing_terms(docs: DataFrame, disclosure: float = DISCLOSURE, least_contexts: int = LEAST_CONTEXTS) -> DataFrame:
    """term and replacement (its class, or null if it has to go) of the terms that disclose an entity."""
    total, found = float(docs.count()), cut(occurrences(docs), "occurrences")

    def documents(values: Column, *names: str) -> DataFrame:
        """In how many documents each value occurs; ``names`` are the parts of a value between blanks and of the count."""
        counted = found.select(F.explode(F.array_distinct(values)).alias("value")).groupBy("value").agg(F.count("*").alias(names[-1]))
        parts = F.split("value", " ")
        return counted.select(*(parts[i].alias(name) for i, name in enumerate(names[:-1])), names[-1])

    def beside(of_term) -> Column:
        return F.flatten(F.transform("seen", lambda x: F.transform(x["terms"], lambda t: F.concat(x["entity"], F.lit(" "), of_term(t)))))

    each = found.select(F.inline("seen")).select("entity", F.xxhash64(F.array_join("terms", " ")).alias("context"), F.explode("terms").alias("term"))
    contexts = each.distinct().groupBy("entity", "term").agg(F.count("*").alias("contexts")).filter(F.col("contexts") >= least_contexts)
    pairs = contexts.join(documents(beside(lambda t: t), "entity", "term", "n_both"), ["entity", "term"]).withColumn("term_class", _class(F.col("term")))
    pairs = pairs.join(documents(beside(_class), "entity", "term_class", "n_class_both"), ["entity", "term_class"])
    pairs = pairs.join(documents(F.col("seen.entity"), "entity", "n_entity"), "entity").withColumn("general", _general(F.col("entity")))
    pairs = pairs.join(documents(F.transform("seen.entity", _general), "general", "n_general"), "general")
    near = F.flatten("seen.terms")
    # Documents that hold a word are those at least that hold it beside any entity.
    for word, of_term in (("term", lambda t: t), ("term_class", _class)):
        pairs = pairs.join(documents(F.transform(near, of_term), word, f"least_{word}"), word)

    def bits(*below: str) -> Column:
        """-log2 of a share, or what two things tell about each other: the first count is that of both."""
        top, *rest = (F.lit(1.0), *below) if len(below) == 1 else (F.col(below[0]), *below[1:])
        return F.log2(reduce(lambda a, n: a / F.col(n), rest, top * F.lit(total)))

    limit = F.greatest(bits("n_general"), disclosure * bits("n_entity")) - 1e-9
    # A word tells the less the more documents hold it, so these counts leave out what can't disclose, and what can't but hide.
    pairs = pairs.filter((bits("n_both", "n_entity", "least_term") >= limit) & (bits("n_entity") > 0)).withColumn("may_tell", bits("n_class_both", "n_entity", "least_term_class") >= limit)
    pairs = pairs_table = cut(pairs, "pairs")
    drop(found)
    if pairs.isEmpty():
        return docs.sparkSession.createDataFrame([], "term string, replacement string")

    words = let(F.array_distinct(_terms(F.coalesce("text", F.lit("")))), lambda t: F.concat(t, F.array_distinct(F.transform(t, _class))))
    asked = pairs.select(F.explode(F.array("term", F.when(F.col("may_tell"), F.col("term_class")))).alias("word")).filter("word IS NOT NULL").distinct()
    counted = docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n")).join(asked, "word", "left_semi")
    counted = cut(counted, "counted")
    for word, n in (("term", "n_term"), ("term_class", "n_class")):
        pairs = pairs.join(counted.select(F.col("word").alias(word), F.col("n").alias(n)), word, "left")

    told = pairs.filter(bits("n_both", "n_entity", "n_term") >= limit)
    hides = ~F.col("may_tell") | (bits("n_class_both", "n_entity", "n_class") < limit)
    found = told.groupBy("term", "term_class").agg(F.bool_and(hides).alias("hides"))
    held = cut(found.select("term", F.when(F.col("hides"), F.col("term_class")).alias("replacement")), "disclosing")
    drop(pairs_table, counted)
    return held


def _with_terms(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``docs`` as struct row, with text (never null) and listed: the disclosing terms (term, replacement) that it holds, null if none."""
    rows = docs.select(F.struct(*(docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns))).alias("row"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    if terms.isEmpty():
        return rows.withColumn("listed", F.lit(None).cast("map<string, string>"))
    held = rows.select(F.xxhash64("text").alias("r"), F.explode(F.array_distinct(_terms(F.col("text")))).alias("term")).join(terms, "term").distinct()
    held = cut(held.groupBy("r").agg(F.map_from_entries(F.collect_list(F.struct("term", "replacement"))).alias("listed")), "listed")
    return rows.join(held, F.xxhash64(rows["text"]) == held["r"], "left").drop("r")


def find_private(docs: DataFrame, disclosure: float = DISCLOSURE, least_contexts: int = LEAST_CONTEXTS) -> DataFrame:
    """row (the columns of ``docs`` as c0, c1, ..), text, and one column of spans (start, end, value) for each kind: email, ip, card, phone, term; those of term have a replacement too."""
    found = _with_terms(docs, disclosing_terms(docs, disclosure, least_contexts))
    words = F.transform(_found(F.col("text"), TERM), _core)
    terms = F.when(F.col("listed").isNotNull(), F.filter(words, lambda x: F.map_contains_key("listed", F.lower(x["value"]))))
    replaced = F.transform(terms, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), F.col("listed")[F.lower(x["value"])].alias("replacement")))
    none = F.array().cast("array<struct<start: int, end: int, value: string, replacement: string>>")
    return found.select("row", "text", *(base_spans(F.col("text"), kind).alias(kind) for kind in BASE), F.coalesce(replaced, none).alias("term"))


def _core(x: Column) -> Column:
    """A word's span without the signs around it."""
    start, letters = x["start"] + F.length(F.regexp_extract(x["value"], _LEADING, 0)), F.regexp_extract(x["value"], _LETTERS, 0)
    return F.struct(start.alias("start"), (start + F.length(letters)).alias("end"), letters.alias("value"))


def listed(kinds: tuple[str, ...]) -> Column:
    """kind:start:end of all spans that find_private() gave, by kind as listed, then start, joined by commas."""
    one = lambda kind: F.transform(kind, lambda x: F.concat_ws(":", F.lit(kind), x["start"], x["end"]))
    return F.array_join(F.concat(*(one(kind) for kind in kinds)), ",")


def sanitised(docs: DataFrame, disclosure: float = DISCLOSURE, least_contexts: int = LEAST_CONTEXTS) -> DataFrame:
    """All rows and columns of ``docs``; in the text base spans become their kind in brackets, disclosing terms their class or ``[term]``."""
    label = lambda kind, x: F.coalesce(x["replacement"], F.lit("[term]")) if kind == "term" else F.lit(f"[{kind}]")
    own = lambda kind: F.transform(kind, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), label(kind, x).alias("label")))
    spans = F.array_sort(F.concat(*(own(kind) for kind in (*BASE, "term"))))
    text, start = F.col("text"), F.struct(F.lit(0).alias("upto"), F.array().cast("array<string>").alias("parts"))

    def step(done: Column, x: Column) -> Column:
        inside = x["start"] < done["upto"]
        between = F.substring(text, done["upto"] + 1, x["start"] - done["upto"])
        parts = F.when(inside, done["parts"]).otherwise(F.concat(done["parts"], F.array(between, x["label"])))
        return F.struct(F.greatest(done["upto"], x["end"]).alias("upto"), parts.alias("parts"))

    rest = lambda done: F.array_join(F.concat(done["parts"], F.array(F.substring(text, done["upto"] + 1, F.length(text)))), "")
    out = F.when(F.size("spans") > 0, F.aggregate("spans", start, step, rest)).otherwise(text)
    found = find_private(docs, disclosure, least_contexts).select("row", "text", spans.alias("spans")).select("row", out.alias("text"))
    return found.select(*(F.when(F.col(f"row.c{i}").isNotNull(), F.col("text")).alias(c) if c == "text" else F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)))


def oracle() -> str:
    """The query's rows as DuckDB SQL: matches by plain patterns, places by running sums of lengths."""
    blank = "[ \\x09-\\x0D]"
    plain = {
        "email": "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+", "ip": "[0-9]+(?:\\.[0-9]+)(?:\\.[0-9]+)(?:\\.[0-9]+)", "card": "[0-9](?:[\\x20-]?[0-9])+", "phone": "\\+[0-9][\\x20().0-9-]+[0-9]",
        "word": "[^ \\x09-\\x0D]+",
    }
    raw = " UNION ALL ".join(f"SELECT doc_id, '{kind}' AS kind, {k} AS k, regexp_extract_all(text, '{p}') AS m, string_split_regex(text, '{p}') AS p FROM docs" for k, (kind, p) in enumerate(plain.items()))
    digits = "regexp_replace(v, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(range(len({digits})), lambda i: CASE WHEN i % 2 = 0 THEN substr({digits}, len({digits}) - i, 1)::INT ELSE 2 * substr({digits}, len({digits}) - i, 1)::INT // 10 + 2 * substr({digits}, len({digits}) - i, 1)::INT % 10 END)) % 10 = 0"
    part = "0*([0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
    opening, closing = """[("''\\[]*""", """[.,;:!?)"''\\]]*"""
    bits = lambda top, *below: f"log2({top} * (SELECT count(*) FROM docs)::DOUBLE / " + " / ".join(below) + ")"
    return f"""WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
raw AS ({raw}),
each AS (SELECT doc_id, kind, k, unnest(m) AS v, unnest(p[1:len(m)]) AS gap, unnest(range(len(m))) AS i FROM raw WHERE len(m) > 0),
placed AS (SELECT *, sum(len(gap) + len(v)) OVER w AS e FROM each WINDOW w AS (PARTITION BY doc_id, kind ORDER BY i)),
spans AS (SELECT doc_id, kind, k, v, e - len(v) AS s, e, coalesce(lag(e) OVER w, -1) AS last, coalesce(lead(e - len(v)) OVER w, 9e9) AS next FROM placed WINDOW w AS (PARTITION BY doc_id, kind ORDER BY i)),
base AS (SELECT * FROM spans WHERE kind = 'email' OR kind = 'ip' AND regexp_full_match(v, '{part}\\.{part}\\.{part}\\.{part}') OR kind = 'card' AND len({digits}) BETWEEN 16 AND 19 AND {luhn} OR kind = 'phone' AND len({digits}) BETWEEN 8 AND 15),
words AS (SELECT doc_id, s, e, s + len(regexp_extract(v, '^{opening}')) AS begins, lower(regexp_extract(v, '^{opening}(\\pL{{3,}}){closing}$', 1)) AS term FROM spans WHERE kind = 'word'),
terms AS (SELECT * FROM words WHERE term <> ''),
found AS (SELECT doc_id, kind, s, e, last, next, kind || ':' || CASE kind WHEN 'email' THEN lower(v) WHEN 'ip' THEN v ELSE {digits} END AS entity FROM base),
entities AS (SELECT *, CASE kind WHEN 'email' THEN 'email:@' || split_part(entity, '@', -1) WHEN 'ip' THEN split_part(entity, '.', 1) || '.' || split_part(entity, '.', 2) WHEN 'card' THEN substr(entity, 1, 11) ELSE substr(entity, 1, 10) END AS general FROM found),
beside AS (SELECT o.doc_id, o.kind, o.s, o.entity, t.s AS ts, t.term, t.e < o.s AS ahead FROM entities o JOIN terms t ON t.doc_id = o.doc_id AND (t.e < o.s AND t.s > o.last AND t.s > o.s - {NEAR_CHARS} OR t.s > o.e AND t.e < o.next AND t.e < o.e + {NEAR_CHARS})),
near AS (SELECT * FROM beside QUALIFY row_number() OVER (PARTITION BY doc_id, kind, s, ahead ORDER BY CASE WHEN ahead THEN -ts ELSE ts END) <= {NEAR}),
contexts AS (SELECT doc_id, kind, s, entity, string_agg(term, ' ' ORDER BY ts) AS context FROM near GROUP BY ALL),
n_contexts AS (SELECT n.entity, n.term, count(DISTINCT c.context) AS contexts FROM near n JOIN contexts c USING (doc_id, kind, s, entity) GROUP BY 1, 2),
n_both AS (SELECT entity, term, count(DISTINCT doc_id) AS n_both FROM near GROUP BY 1, 2),
n_class_both AS (SELECT entity, substr(term, 1, {CLASS_LETTERS}) AS class, count(DISTINCT doc_id) AS n_class_both FROM near GROUP BY 1, 2),
n_entity AS (SELECT entity, general, count(DISTINCT doc_id) AS n_entity FROM entities GROUP BY 1, 2),
n_general AS (SELECT general, count(DISTINCT doc_id) AS n_general FROM entities GROUP BY 1),
n_term AS (SELECT term, count(DISTINCT doc_id) AS n_term FROM terms GROUP BY 1),
told AS (SELECT DISTINCT term FROM n_contexts JOIN n_both USING (entity, term) JOIN n_entity USING (entity) JOIN n_general USING (general) JOIN n_term USING (term)
         WHERE contexts >= {LEAST_CONTEXTS} AND {bits("1", "n_entity")} > 0 AND {bits("n_both", "n_entity", "n_term")} >= greatest({bits("1", "n_general")}, {DISCLOSURE} * {bits("1", "n_entity")}) - 1e-9),
more AS (SELECT doc_id, 'term' AS kind, 9 AS k, begins AS s, begins + len(term) AS e FROM terms JOIN told USING (term)),
all_spans AS (SELECT doc_id, kind, k, s, e FROM base UNION ALL SELECT * FROM more),
listed AS (SELECT doc_id, string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY k, s) FILTER (kind <> 'term') AS base, string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY k, s) AS spans,
           {", ".join(f"count(*) FILTER (kind = '{kind}') AS n_{kind}" for kind in (*BASE, "term"))} FROM all_spans GROUP BY 1)
SELECT d.doc_id, {", ".join(f"coalesce(n_{kind}, 0)::BIGINT AS n_{kind}" for kind in (*BASE, "term"))}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM docs d LEFT JOIN listed USING (doc_id)"""
