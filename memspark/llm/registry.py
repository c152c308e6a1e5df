"""Queries of this subpackage and the SQL that gives the same rows, where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.llm import binary_output, embedding_dedup, language_id, line_dedup, nearest, ngram_join, packing, periodic_runs, sanitise, sentencepiece_bpe, substring_dedup, toxicity, whitening
from memspark.llm.common import let, read, vocabulary
from memspark.llm.tokens import Encoder


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))
    return found.select("doc_id", "severity", "grade", "rejected", "p_above")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.remove_lines(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.sha2("text", 256).alias("kept_sha256"), "lines_removed")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link(read(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    found = language_id.identify(docs, language_id.train(docs.filter(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "spans")


def op6_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    encode = Encoder(vocabulary("word_bpe_49k.json"), 1)
    found = binary_output.documents_as_records(spark, read(spark, sf_dir, "documents"), encode)
    return found.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sentencepiece_bpe.encode_documents(read(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))
    digest = [F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256), F.sha2("decoded", 256)]
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest[0].alias("ids_sha256"), digest[1].alias("decoded_sha256"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    encode = Encoder(vocabulary("byte_bpe_50k.json"), 0)
    return packing.pack(packing.pieces_of(read(spark, sf_dir, "documents"), encode))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.link(read(spark, sf_dir, "embeddings"))


def _with_periods(docs: DataFrame) -> DataFrame:
    """doc_id and text, where a tenth of the texts goes on with a period from some word on, both drawn by the id."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g, words = F.floor(h / 10), F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def periodic(w: Column) -> Column:
        n = F.size(w)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        tail = let(p, lambda p: let(a, lambda a: F.transform(F.sequence(a, n - 1), lambda i: w[a + (i - a) % p])))
        return F.when(n > 0, F.array_join(F.concat(F.slice(w, 1, a), tail), " ")).otherwise(F.lit(""))

    return docs.select("doc_id", F.when((h % 10 == 0) & F.col("text").isNotNull(), let(words, periodic)).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(_with_periods(read(spark, sf_dir, "documents")))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    found = found.withColumn("best", best)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), (-F.col("best.l")).alias("length"), F.col("best.period").alias("period"),
        F.floor(1000 * -F.col("best.l") / F.col("best.period")).cast("long").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


def op13_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sanitise.find_private(read(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(kind).cast("long").alias(f"n_{kind}") for kind in (*sanitise.BASE, "term")]
    return found.select(F.col("row.c0").alias("doc_id"), *counts, F.sha2(sanitise.listed(sanitise.BASE), 256).alias("base_sha256"), sanitise.listed((*sanitise.BASE, "term")).alias("spans"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


_WORDS = """words AS (SELECT doc_id, text, list_filter(regexp_split_to_array({text}, '[ \\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents)"""

#: All 20-word windows, the first place of each, and the words that later ones cover.
REPEATS = f"""WITH {_WORDS.format(text="coalesce(text, '')")},
wins AS (SELECT doc_id, p, array_to_string(w[p + 1 : p + {substring_dedup.WINDOW}], ' ') AS win FROM (SELECT *, unnest(range(0, len(w) - {substring_dedup.WINDOW - 1})) AS p FROM words)),
later AS (SELECT doc_id, p FROM (SELECT *, row_number() OVER (PARTITION BY win ORDER BY doc_id, p) AS k FROM wins) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, p + unnest(range(0, {substring_dedup.WINDOW})) AS q FROM later),
of_doc AS (SELECT doc_id, list(q) AS qs FROM gone GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(qs), 0)::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(list_filter(w, lambda x, i: NOT coalesce(list_contains(qs, i - 1), false)), ' '), '')) AS kept_sha256
FROM words d LEFT JOIN of_doc o ON o.doc_id = d.doc_id"""

#: Distinct shingles, pairs that share enough of them, and all that can be reached.
LINKS = f"""WITH RECURSIVE {_WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")},
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {ngram_join.N} THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - {ngram_join.N - 2}), lambda i: array_to_string(w[i : i + {ngram_join.N - 1}], ' ')) END) AS s FROM words),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM shared JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= {ngram_join.PERCENT} * (p.n + q.n - c)),
both_ways AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT x AS a, x AS b FROM both_ways UNION SELECT r.a, e.y FROM reach r JOIN both_ways e ON e.x = r.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(least_of, d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT a, min(b) AS least_of FROM reach GROUP BY 1) r ON r.a = d.doc_id"""

_CRC32 = "list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), list_transform(range(8), lambda i: i::BIGINT)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1))))"
#: Periods planted as in op11's query; equal words up to a quarter of a text apart, stretches of them, and those that no smaller period spans.
PERIODS = f"""WITH drawn AS (SELECT doc_id, xor({_CRC32}, 4294967295) AS h, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\x09-\\x0D]+'), lambda w: w <> '') AS w0 FROM documents),
shape AS (SELECT *, len(w0) AS n, h // 10 AS g, CASE WHEN len(w0) > 0 THEN (h // 10) % len(w0) END AS a FROM drawn),
texts AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN w0[i + 1] ELSE w0[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] END) ELSE w0 END AS w FROM shape),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(n)) AS i FROM texts),
same AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.word = y.word AND x.i < y.i JOIN texts t ON t.doc_id = x.doc_id WHERE {periodic_runs.REPEATS} * (y.i - x.i) <= t.n),
stretch AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS l FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM same) GROUP BY doc_id, q, island HAVING count(*) + q >= greatest({periodic_runs.LEAST}, {periodic_runs.REPEATS} * q)),
runs AS (SELECT * FROM stretch r WHERE NOT EXISTS (SELECT 1 FROM stretch o WHERE o.doc_id = r.doc_id AND o.q < r.q AND o.s <= r.s AND o.s + o.l >= r.s + r.l)),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS i FROM runs),
kept AS (SELECT w.doc_id, string_agg(w.word, ' ' ORDER BY w.i) AS collapsed FROM words w LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.i = w.i WHERE g.i IS NULL GROUP BY 1),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY l DESC, s, q) AS k FROM runs),
listed AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM runs GROUP BY 1)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, b.s::BIGINT AS start, b.l::BIGINT AS length, b.q::BIGINT AS period, (1000 * b.l // b.q)::BIGINT AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM documents d LEFT JOIN listed USING (doc_id) LEFT JOIN best b ON b.doc_id = d.doc_id AND b.k = 1 LEFT JOIN kept USING (doc_id)"""

_DOT = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
#: All pairs of vectors by cosine, and all that can be reached.
VECTOR_LINKS = f"""WITH RECURSIVE v AS (SELECT vec_id, embedding, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings),
link AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.n > 0 AND b.n > 0 WHERE {_DOT} / (a.n * b.n) >= {embedding_dedup.THRESHOLD}),
reach AS (SELECT x AS a, x AS b FROM link UNION SELECT r.a, e.y FROM reach r JOIN link e ON e.x = r.b)
SELECT vec_id, (SELECT count(*) FROM link WHERE x = vec_id)::BIGINT AS n_links, coalesce((SELECT min(b) FROM reach WHERE a = vec_id), vec_id) AS component_id,
       coalesce((SELECT min(b) FROM reach WHERE a = vec_id), vec_id) = vec_id AS kept FROM embeddings"""


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": line_dedup.ORACLE, "op3_substring_dedup": REPEATS, "op4_ngram_jaccard": LINKS, "op10_embedding_dedup": VECTOR_LINKS, "op11_periodic_runs": PERIODS, "op13_sanitise": sanitise.oracle()}
