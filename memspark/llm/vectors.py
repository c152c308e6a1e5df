"""What both vector operators share: which vectors count, and matrices as binary rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: str) -> Column:
    """Not null, not empty, no null or non-finite component, not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce(~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of an array of lists of one length, in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def least_nets(distances: np.ndarray, radii: list[float]) -> list[np.ndarray]:
    """Nested nets, one for each falling radius: every point is within the radius of a member, members are further apart."""
    members = np.zeros(len(distances), bool)
    out = []
    for radius in radii:
        covered = (distances[members] <= radius).any(0) if members.any() else np.zeros(len(distances), bool)
        i = 0
        while not covered.all():
            i += int(covered[i:].argmin())
            members[i] = True
            covered |= distances[i] <= radius
        out.append(np.flatnonzero(members))
    return out
