"""Nearest neighbours by a hash-prefix (LSH) forest.

Each tree gives a row one long hash string: bit i tells on which side of hyperplane i the
row lies. A tree is the sorted array of its strings. A query finds its place in every
array (the longest matching prefix), then all trees ascend together, one prefix bit at a
time, until the union of the matching ranges holds enough candidates; those are measured
exactly. Ranges are taken whole, so equal strings are never cut apart.

Rows are dealt into blocks by hash, each with its own forest (the hash functions are
common); a query meets every block, and blocks of queries bound a task's memory, so a
group of equal vectors only fills its share of each block. Hyperplanes are differences of
pairs out of a bounded sample, cut at the sample's median.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .vectors import as_vectors, matrix, sample, usable

TREES = 16
BITS = 48
#: Candidates that a query gathers, as a share of a block's rows: what recall 0.9 takes on
#: vectors without low-dimensional structure.
SHARE = 0.5
LEAST = 1536
BLOCK_ROWS = 16384
BLOCK_QUERIES = 8192


class Hashes:
    """Hash functions of all trees for vectors of one length."""

    def __init__(self, fit: np.ndarray, trees: int, bits: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        n, d = fit.shape
        a, b = rng.integers(0, n, trees * bits), rng.integers(0, n, trees * bits)
        w = fit[a] - fit[b]
        flat = ~w.any(axis=1)
        w[flat] = rng.standard_normal((int(flat.sum()), d))
        self.w = w.T.astype(np.float64)
        self.cut = np.median(fit @ self.w, axis=0)
        self.trees, self.bits = trees, bits

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """(trees, rows) hash strings, as integers whose highest bit comes first."""
        out = np.zeros((self.trees, len(x)), dtype=np.int64)
        for i in range(0, len(x), 4096):
            side = (x[i : i + 4096] @ self.w > self.cut).reshape(-1, self.trees, self.bits)
            weight = np.int64(1) << np.arange(self.bits - 1, -1, -1, dtype=np.int64)
            out[:, i : i + 4096] = (side * weight).sum(axis=2).T
        return out


class Forest:
    """Sorted arrays of one block of rows."""

    def __init__(self, x: np.ndarray, hashes: Hashes):
        self.hashes, self.n = hashes, len(x)
        codes = hashes(x)
        self.order = np.argsort(codes, axis=1, kind="stable")
        self.codes = np.take_along_axis(codes, self.order, axis=1)

    def candidates(self, q: np.ndarray, want: int):
        """For each query the rows met when the trees have ascended far enough."""
        bits, qc = self.hashes.bits, self.hashes(q)
        low = np.zeros((bits + 1, *qc.shape), dtype=np.int32)
        high = np.full_like(low, self.n)
        for x in range(1, bits + 1):  # ranges that share a prefix of x bits
            head = qc >> (bits - x)
            for t in range(len(qc)):
                low[x, t] = np.searchsorted(self.codes[t], head[t] << (bits - x))
                high[x, t] = np.searchsorted(self.codes[t], (head[t] + 1) << (bits - x))
        total = (high - low).sum(axis=1)
        want = min(want, self.n)
        start = bits - np.argmax(total[::-1] >= want, axis=0)
        for i in range(len(q)):
            met, x = np.zeros(self.n, dtype=bool), int(start[i])
            while True:
                for t in range(len(qc)):
                    met[self.order[t, low[x, t, i] : high[x, t, i]]] = True
                if x == 0 or np.count_nonzero(met) >= want:
                    break
                x -= 1
            yield np.flatnonzero(met)


def nearest(df: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", trees: int = TREES, bits: int = BITS, share: float = SHARE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (Euclidean distance): the k nearest found.

    Candidates are all rows but those of the query's own id; ties go to the smaller id.
    Vectors null, zero or holding null or non-finite components, null ids, and vectors of
    another length than the query's take no part. Repeated rows count once; of several query
    rows with one id the nearest of all count; an empty table, and one without queries, gives
    none. Columns other than the two named (and those of is_query) are ignored.
    """
    spark = df.sparkSession
    rows = as_vectors(df, id_col, vec_col, F.coalesce(is_query, F.lit(False)).alias("q")).where(usable("v") & F.col("id").isNotNull())
    rows = rows.withColumn("dim", F.size("v"))
    n, nq = rows.agg(F.count(F.lit(1)), F.count_if("q")).first()
    blocks, query_blocks = max(1, math.ceil(n / BLOCK_ROWS)), max(1, math.ceil(nq / BLOCK_QUERIES))
    hashes = {d: Hashes(x, trees, bits) for d, x in sample(rows, F.col("id")).items()}
    hashed = F.xxhash64("id", "v")
    spread = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    base = rows.select("dim", F.lit(False).alias("asks"), "id", "v", F.pmod(hashed, F.lit(blocks)).cast("int").alias("block"), spread(query_blocks).alias("part"))
    asks = rows.where("q").select("dim", F.lit(True).alias("asks"), "id", "v", spread(blocks).alias("block"), F.pmod(hashed, F.lit(query_blocks)).cast("int").alias("part"))

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values("id", kind="stable")
        asked = pdf["asks"].to_numpy()
        ids, x = _once(pdf.loc[~asked])
        qids, q = _once(pdf.loc[asked])
        out: list[tuple] = []
        if len(ids) and len(qids):
            d = x.shape[1]
            forest = Forest(x, hashes.get(d) or Hashes(x[:2048], trees, bits))
            x2 = np.einsum("ij,ij->i", x, x)
            for i, met in enumerate(forest.candidates(q, max(LEAST, math.ceil(share * len(ids))))):
                met = met[ids[met] != qids[i]]
                if not len(met):
                    continue
                rough = x2[met] - 2 * (x[met] @ q[i])
                if len(met) > k:  # all that may be among the k nearest, ties and rounding included
                    met = met[rough <= np.partition(rough, k - 1)[k - 1] + 1e-9 * (1 + np.abs(rough).max() + q[i] @ q[i])]
                dist = np.sqrt(((x[met] - q[i]) ** 2).sum(axis=1))
                best = np.lexsort((ids[met], dist))[:k]
                out += [(qids[i], ids[met[j]], dist[j]) for j in best]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    found = base.union(asks).groupBy("dim", "block", "part").applyInPandas(run, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _once(pdf) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors, each repeated row once; sorted by id."""
    ids, x = pdf["id"].to_numpy(), matrix(pdf["v"])
    if len(ids) > 1 and (ids[1:] == ids[:-1]).any():
        keep = np.array([True] * len(ids))
        seen: set = set()
        for i, key in enumerate(zip(ids.tolist(), map(bytes, x), strict=True)):
            keep[i] = key not in seen
            seen.add(key)
        ids, x = ids[keep], x[keep]
    return ids, x
