"""Vectors that take part in searches and comparisons, and bounded samples of them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows, at most, on which split directions and thresholds are fitted.
SAMPLE = 2048


def usable(v: str) -> Column:
    """Not null, not zero, no null or non-finite component."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(v).isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def as_vectors(df: DataFrame, id_col: str, vec_col: str, *more: Column) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"), *more)


def sample(df: DataFrame, key: Column, limit: int = SAMPLE) -> dict[int, np.ndarray]:
    """Up to limit vectors, the smallest by a hash of key, as one matrix for each length."""
    rows = df.select("v", F.xxhash64(key).alias("h")).orderBy("h", "v").limit(limit).collect()
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(len(r["v"]), []).append(r["v"])
    return {d: np.array(x, dtype=np.float64) for d, x in by.items()}


def matrix(column) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 0))
