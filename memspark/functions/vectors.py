"""Vectors as columns: cosine, normalisation, and the seeded embedding."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def normalise(v: Column) -> Column:
    """To length 1; a zero vector stays."""
    # Within an array of one element the length is computed once, not for each component.
    divided = lambda size: F.when(size == 0, v.cast("array<double>")).otherwise(F.transform(v, lambda x: x / size))
    return F.get(F.transform(F.array(norm(v)), divided), F.lit(0))


def seeded_vector(text: str, dim: int) -> np.ndarray:
    """A direction drawn from the text's digest: equal texts have equal vectors."""
    seed = int.from_bytes(hashlib.md5(text.encode()).digest(), "big") % 2**32
    v = np.random.RandomState(seed).randn(dim)
    return (v / np.linalg.norm(v)).astype(np.float32)


def embed(rows: DataFrame, text: str = "content", dim: int = 384, embedder: Callable[[list[str]], list] | None = None) -> DataFrame:
    """``rows`` with ``embedding``. Each distinct text is embedded once; ``embedder`` takes texts and gives vectors, in a worker. A null text has none."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([list(map(float, v)) for v in (embedder(texts.tolist()) if embedder else [seeded_vector(t, dim) for t in texts])])

    distinct = rows.select(F.col(text).alias("_text")).filter("_text IS NOT NULL").distinct()
    return rows.join(distinct.withColumn("embedding", run("_text")), rows[text] == F.col("_text"), "left").drop("_text")
