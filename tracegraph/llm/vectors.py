"""Embeddings: clean vectors, k-means on a bounded sample, top-k merging."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(c: str) -> Column:
    """True for vectors with at least one number other than zero and no null or non-finite component."""
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(F.col(c).isNotNull() & (F.size(c) > 0) & ~bad & F.exists(c, lambda x: x != 0), F.lit(False))


def matrix(col: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix of doubles."""
    n = len(col)
    flat = np.asarray(col.flatten()).astype(np.float64)
    return flat.reshape(n, -1) if n else np.zeros((0, 0))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)
