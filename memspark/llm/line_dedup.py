"""Operator 2: removal of lines that stand on many sites, with DataFrame functions only.

Each line hash gets a HyperLogLog sketch of the sites it occurs on; sketches merge by
aggregation, so a common line costs one row a task. Lines whose estimate is near the threshold
get an exact distinct count. A line on at least ``min_sites`` sites is boilerplate: its first
occurrence (smallest doc_id, then earliest place) stays and all others go. The lists of lines
that go are counted, and broadcast to the texts where they are small.

Lines are compared without surrounding blanks. Every line that is not blank is judged, however
short; a caller may set ``min_chars`` to spare shorter ones. All other lines stay as they are, in order.

Defined cases: a null text stays null and has no lines, an empty one has one line; a null site
is one site of its own, a null doc_id sorts first; rows that are equal in doc_id and text are
treated alike; very long texts are judged whole; an empty table gives no rows; further columns are
kept, whatever their names, so ``lines_removed`` can occur twice in the result of ``remove_lines``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.llm.common import cut, key128

MIN_SITES = 5
#: A line that has one of these is not blank.
NOT_BLANK = r"[^ \t\n\x0B\f\r]"
#: Sketches have 2**LOG_BUCKETS buckets (standard error 3.3 %); estimates within this share of the threshold are counted exactly.
LOG_BUCKETS, NEAR = 10, 0.4
#: Lists of removed lines are broadcast up to so many texts and places (some 60 MB); beyond that texts are shuffled to their lists.
MOST_TEXTS, MOST_PLACES = 500_000, 4_000_000


def _lines(docs: DataFrame, site: str, min_chars: int) -> DataFrame:
    """Lines that are not blank as (id, row, site, pos, line): row tells texts of one doc_id apart, line is a hash."""
    lines = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("row"), F.coalesce(F.col(site).cast("string"), F.lit("")).alias("site"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.filter(F.col("line").rlike(NOT_BLANK) & (F.length(F.trim("line")) >= min_chars)).withColumn("line", key128(F.trim("line")))


def boilerplate(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, min_chars: int = 1) -> DataFrame:
    """Hashes of the lines on at least ``min_sites`` sites, with the first occurrence of each."""
    lines = _lines(docs, site, min_chars)
    spread = lines.groupBy("line").agg(F.hll_sketch_agg("site", LOG_BUCKETS).alias("sketch"), F.min(F.struct("id", "row", "pos")).alias("first"))
    spread = cut(spread.select("line", "first", F.hll_sketch_estimate("sketch").alias("sites")).filter(F.col("sites") >= min_sites * (1 - NEAR)), "spread")
    near = spread.filter(F.col("sites") <= min_sites * (1 + NEAR))
    pairs = lines.groupBy("line", "site").count()
    exact = pairs.join(near.select("line"), "line", "left_semi").groupBy("line").agg(F.count("*").alias("exact"))
    counted = near.join(exact, "line").filter(F.col("exact") >= min_sites)
    return spread.filter(F.col("sites") > min_sites * (1 + NEAR)).select("line", "first").union(counted.select("line", "first"))


def remove_lines(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, min_chars: int = 1) -> DataFrame:
    """All rows of ``docs``, with text changed and lines_removed (int) added."""
    held = cut(boilerplate(docs, site, min_sites, min_chars), "boilerplate")
    here = F.struct("id", "row", "pos")
    found = _lines(docs, site, min_chars).join(held, "line").filter(~here.eqNullSafe(F.col("first")))
    gone = cut(found.groupBy("id", "row").agg(F.collect_set("pos").alias("gone")), "gone")
    texts, places = gone.agg(F.count("*"), F.coalesce(F.sum(F.size("gone")), F.lit(0))).first()
    if texts <= MOST_TEXTS and places <= MOST_PLACES:
        gone = F.broadcast(gone)
    # Columns by number, as theirs may have any name.
    own = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    id_, text = own["doc_id"], own["text"]
    joined = docs.toDF(*own.values()).join(gone, F.col(id_).eqNullSafe(F.col("id")) & (F.xxhash64(text) == F.col("row")), "left")
    kept = F.filter(F.split(text, "\n"), lambda _, i: ~F.array_contains("gone", i))
    joined = joined.withColumn(text, F.when(F.col("gone").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n")))
    return joined.select(*own.values(), F.coalesce(F.size("gone"), F.lit(0)).alias("lines_removed")).toDF(*docs.columns, "lines_removed")


def keep_lines(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, min_chars: int = 1) -> DataFrame:
    """All rows and columns of ``docs``, and no others, with text changed."""
    found = remove_lines(docs, site, min_sites, min_chars)
    return found.toDF(*(f"c{i}" for i in range(len(docs.columns))), "removed").drop("removed").toDF(*docs.columns)


ORACLE = f"""
WITH lines AS (
  SELECT doc_id, coalesce(source, '') AS site, text, unnest(string_split(text, chr(10))) AS line,
         unnest(range(len(string_split(text, chr(10))))) AS pos
  FROM documents),
own_lines AS (SELECT doc_id, site, pos, trim(line, ' ') AS line FROM lines WHERE regexp_matches(line, '{NOT_BLANK}')),
held AS (
  SELECT line, min((doc_id, pos)) AS first FROM own_lines GROUP BY line HAVING count(DISTINCT site) >= {MIN_SITES}),
marked AS (
  SELECT l.doc_id, l.pos, l.line,
         coalesce(regexp_matches(l.line, '{NOT_BLANK}') AND h.first <> (l.doc_id, l.pos), false) AS gone
  FROM lines l LEFT JOIN held h ON h.line = trim(l.line, ' ')),
kept AS (
  SELECT doc_id, count(*) FILTER (gone) AS lines_removed,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text
  FROM marked GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE sha256(k.text) END AS kept_sha256,
       CAST(coalesce(k.lines_removed, 0) AS INTEGER) AS lines_removed
FROM documents d LEFT JOIN kept k USING (doc_id)
"""
