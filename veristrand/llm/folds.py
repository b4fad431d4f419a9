"""Deterministic folds and bounded samples of labelled rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5
_RANGE = 1 << 30


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, mod 5; a null id has none."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(fold(id_col) == 0, F.lit(False)).alias("held_out")


def sampled(rows: DataFrame, by: str, limit: int, id_col: str = "doc_id") -> DataFrame:
    """About limit rows of each value of by: those whose hash of the id falls into limit / count of its range.

    A value with at most limit rows keeps them all. No value is left out, and nothing is
    sorted or dealt out by value. by names classes that a model tells apart, so their counts
    fit where the model does: on the driver. rows has each id once for each value.
    """
    counts = {r[by]: r["count"] for r in rows.where(F.col(by).isNotNull()).groupBy(by).count().collect()}
    if not counts:
        return rows.where(F.lit(False))
    upto = F.create_map(*(F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(_RANGE, math.ceil(limit / n * _RANGE)))))
    return rows.where(F.pmod(F.xxhash64(id_col, F.lit(11)), F.lit(_RANGE)) < F.element_at(upto, F.col(by)))
