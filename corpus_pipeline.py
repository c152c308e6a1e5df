"""The corpus pipeline: toxicity, line dedup, near-duplicate documents, repeated passages, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and returns
a DataFrame; all but the last return the columns of documents, with n_chars following the text.
Between stages the documents are a Parquet table in the shared folder, so lost executors cost
one stage's tasks at most.

Defined cases are those of the operators: null and empty texts pass through (a null text stays
null, and packs as its end id), rows that share a doc_id are judged alike or one by one as each
operator states, and an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.llm import line_dedup, ngram_join, packing, substring_dedup, toxicity
from memspark.llm.common import cut, read, vocabulary
from memspark.llm.tokens import Encoder


def _with_length(docs: DataFrame, columns: list[str]) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*columns) if "n_chars" in columns else docs.select(*columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose expected severity is rejected go."""
    return toxicity.filter_toxic(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on many sites stay where they occur first; no document goes."""
    return _with_length(line_dedup.keep_lines(docs), docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest doc_id."""
    return ngram_join.keep_first(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occurred before go from the texts; no document goes."""
    return _with_length(substring_dedup.remove_repeats(docs), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces in sequences of at most 2048 tokens."""
    # Workers keep the encoder's words while they serve later jobs, so it remembers fewer than where it is alone.
    return packing.pack(packing.pieces_of(docs, Encoder(vocabulary("byte_bpe_50k.json"), 0, most=120_000)))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate_lines),
    ("ngram_jaccard", drop_near_copies),
    ("substring_dedup", drop_repeated_passages),
    ("best_fit_packing", pack),
]

#: SQL can't express the learned filter or the packing; tests/llm holds the operators of the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
