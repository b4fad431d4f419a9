"""Embedding near-duplicates by a forest of random-projection trees.

Equal vectors of one label are united first; what follows sees one row for each class,
with its number of copies. A label of more than ``LEAF_ROWS`` classes gets trees of its own.
They grow in rounds of a few levels: of each node that is still too large a bounded sample,
taken from all of that node's rows, gives random directions and medians; rows near a split go
both ways (spill). So depth follows a label's size, whatever it is, and leaves stay small.
Classes are compared within leaves only, and every pair is verified in double precision.

Dense groups of distinct vectors are peeled off a node before it is split, so that no split
runs inside them: around a sampled vector with ``DENSE`` sampled ones within the radius, all
rows within twice the radius form a leaf, and rows beyond the radius go on. No link is lost
there: an end within the radius has the other within twice of it.

A node that splitting doesn't make smaller (vectors too alike) becomes a leaf as it is. Leaves
may be of any size: one above ``LEAF_ROWS`` is dealt out as pairs of its chunks, so
a task holds two chunks at most and no leaf is truncated. A pair that shares several leaves
is counted in the first of them only. A leaf's task returns a row for each class, with its
count of links and the smallest class of its group there, never the pairs.
"""

from __future__ import annotations

import math
import pickle
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, min_labels
from .components import connected_components
from .vectors import as_vectors, matrix, usable

THRESHOLD = 0.93
TREES = 6
#: Share of a node's rows that go both ways.
SPILL = 0.12
#: Rows that a leaf should hold, about.
LEAF_TARGET = 1024
#: Levels that a node is split at once, rows on which they are fitted, about, and dense groups peeled off at once.
LEVELS, FIT, PIVOTS = 4, 1024, 16
#: A child larger than this share of its node is no progress.
PROGRESS = 0.8
#: Rows that a task assigns at a time, about.
CHUNK = 8192
#: Sampled rows within the radius of one, itself included, that make a dense group.
DENSE = 4
#: Rows above which a leaf is dealt out in chunks.
LEAF_ROWS = 4096
_BLOCK = 1024
#: Leaves that are compared at a time.
_LEAVES = 2048


@dataclass
class Tree:
    """Nodes in heap order: direction, lower and upper bound of the spill zone."""

    dirs: np.ndarray
    low: np.ndarray
    high: np.ndarray
    depth: int

    def leaves(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for each leaf that a row of u falls into."""
        rows, node = np.arange(len(u)), np.zeros(len(u), dtype=np.int64)
        for _ in range(self.depth):
            p = np.einsum("ij,ij->i", u[rows], self.dirs[node])
            left, right = p < self.high[node], p >= self.low[node]
            rows, node = np.r_[rows[left], rows[right]], np.r_[2 * node[left] + 1, 2 * node[right] + 2]
        return rows, node - (2**self.depth - 1)


def build_tree(u: np.ndarray, depth: int, seed: int, spill: float = SPILL) -> Tree:
    """Fit one tree on sample rows u: random directions, medians, quantiles of the spill zone."""
    rng = np.random.default_rng(seed)
    n, d = 2**depth - 1, u.shape[1]
    dirs = rng.standard_normal((n, d))
    low, high = np.zeros(n), np.zeros(n)
    held: list[np.ndarray] = [u]
    for i in range(n):
        x = held[i]
        p = x @ dirs[i]
        if len(p):
            low[i], mid, high[i] = np.quantile(p, [0.5 - spill / 2, 0.5, 0.5 + spill / 2])
            low[i], high[i] = min(low[i], mid), np.nextafter(max(high[i], mid), np.inf)
        held += [x[p < high[i]], x[p >= low[i]]] if len(p) else [x, x]
    return Tree(dirs, low, high, depth)


def dense_pivots(u: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Sample rows around which dense groups are peeled off, in turn, and the rows that remain."""
    left = np.ones(len(u), dtype=bool)
    if threshold <= 0:  # twice the radius would be everything
        return u[:0], u
    close = u @ u.T >= threshold
    count, pivots = close.sum(axis=1), []
    while len(u) and len(pivots) < PIVOTS:  # others are peeled off a level further down
        i = int(np.argmax(np.where(left, count, 0)))
        if not left[i] or count[i] < DENSE:
            break
        gone = left & close[i]
        gone[i] = True
        pivots.append(i)
        left &= ~gone
        count = count - close[:, gone].sum(axis=1)
    return u[pivots], u[left]


def peel(u: np.ndarray, pivots: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, pivot) for each dense leaf that a row of u falls into, and the rows that remain."""
    rest, rows, at = np.arange(len(u)), [], []
    p = u @ pivots.T
    outer = 2 * threshold * threshold - 1  # the cosine of twice the angle
    for k in range(len(pivots)):
        q = p[rest, k]
        mine = rest[q >= outer - 1e-9]
        rows.append(mine)
        at.append(np.full(len(mine), k))
        rest = rest[q < threshold + 1e-9]
    return np.concatenate([np.zeros(0, dtype=np.int64), *rows]), np.concatenate([np.zeros(0, dtype=np.int64), *at]), rest


def near_embeddings(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, trees: int = TREES) -> DataFrame:
    """One row per row of df: vec_id, n_links, component_id, kept.

    Links: pairs of equal, non-null label and equal length with cosine >= threshold. Vectors
    that are null, zero or hold null or non-finite components, and rows with a null label,
    link with nothing (n_links 0, component_id their own id). A cosine equal to the threshold
    links. Repeated rows count as vectors of their own; an empty table gives none. Vectors have
    no text; their length may differ from row to row. A class is named by a 64-bit digest of label and vector. Columns other than
    the three named are ignored.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "embedding-dedup")
    rows = as_vectors(df, id_col, vec_col, F.col(label_col).alias("label"))
    ok = usable("v") & F.col("label").isNotNull()
    good = rows.where(ok).withColumn("cid", F.xxhash64("label", "v"))
    classes = scratch.write(good.groupBy("cid", "label", "v").agg(F.count(F.lit(1)).alias("copies")))
    found = scratch.write(_leaf_links(classes, threshold, trees, scratch))
    roots = connected_components(found.where("cid <> low").select(F.col("cid").alias("a"), F.col("low").alias("b")), scratch)
    counts = found.groupBy("cid").agg(F.sum("links").alias("links"))
    of = classes.select("cid", "copies").join(counts, "cid", "left").join(roots, F.col("cid") == F.col("node"), "left")
    of = of.select("cid", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), F.coalesce("root", "cid").alias("root"))
    low = good.groupBy("cid").agg(F.min("id").alias("low")).join(of, "cid")
    named = low.join(low.groupBy("root").agg(F.min("low").alias("component_id")), "root").select("cid", "n_links", "component_id")
    linked = good.select("id", "cid").join(named, "cid").select("id", "n_links", "component_id")
    alone = rows.where(~ok).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.union(alone).select(F.col("id").alias("vec_id"), "n_links", "component_id", (F.col("id").eqNullSafe(F.col("component_id"))).alias("kept"))


_RANGE = 1 << 30


@dataclass
class Split:
    """How a node's rows go on: dense groups, then one subtree (at the root: one for each tree)."""

    pivots: np.ndarray
    trees: list[Tree]


def _seed(*of: int) -> int:
    return int(np.random.SeedSequence([x % (1 << 63) for x in of]).generate_state(1)[0])


def fit(u: np.ndarray, node: int, rows: int, threshold: float, trees: int, target: int = LEAF_TARGET) -> Split:
    """The split of a node of so many rows, of which u is a sample (unit vectors)."""
    pivots, rest = dense_pivots(u, threshold)
    wanted = math.ceil(math.log2(max(1.0, rows * len(rest) / max(1, len(u)) / target)))
    depth = max(0, min(LEVELS, wanted, int(math.log2(max(1.0, len(rest) / 8)))))
    return Split(pivots, [build_tree(rest, depth, _seed(node, t)) for t in range(trees if node == 0 else 1)])


def _leaves(classes: DataFrame, threshold: float, trees: int, scratch: Scratch) -> DataFrame:
    """cid, leaf: every leaf that a class falls into; leaf codes are unique within label and length."""
    label = classes.schema["label"].dataType.simpleString()
    key, target = ["label", "dim", "node"], LEAF_TARGET
    state = classes.select("cid", "label", F.size("v").alias("dim"), F.lit(0).cast("long").alias("node"), "v", F.lit(None).cast("long").alias("within"), F.lit(False).alias("ball"))
    parts: list[DataFrame] = []

    def fitted(pdf):
        import pandas as pd

        x = matrix(pdf.sort_values("cid", kind="stable")["v"])
        one = pdf.iloc[:1]
        split = fit(x / np.linalg.norm(x, axis=1)[:, None], int(one["node"].iloc[0]), int(one["n"].iloc[0]), threshold, trees, target)
        return pd.DataFrame({"label": one["label"], "dim": one["dim"], "node": one["node"], "n": one["n"], "split": [pickle.dumps(split)]})

    def assign(rows, fits):
        import pandas as pd
        import xxhash

        names = ["cid", "label", "dim", "node", "v", "within", "ball"]
        if not len(rows):
            return pd.DataFrame(columns=names)
        node = int(rows["node"].iloc[0])
        if not len(fits):  # no row of the node was sampled: it stays whole
            return rows.assign(within=np.int64(0), ball=True)[names]
        split = pickle.loads(fits["split"].iloc[0])
        x = matrix(rows["v"])
        u = x / np.linalg.norm(x, axis=1)[:, None]
        at, kid, rest = peel(u, split.pivots, threshold)
        where, code, ball = [at], [2 * kid], [np.ones(len(at), dtype=bool)]
        for t, tree in enumerate(split.trees):
            r, leaf = tree.leaves(u[rest])
            where.append(rest[r])
            code.append(2 * (t << 32 | leaf) + 1)
            ball.append(np.zeros(len(r), dtype=bool))
        where, code = np.concatenate(where), np.concatenate(code)
        named = {c: np.uint64(xxhash.xxh64_intdigest(f"{node},{c}")).view(np.int64) for c in np.unique(code).tolist()}
        out = rows.iloc[where].copy()
        out["node"] = [named[c] for c in code.tolist()]
        out["within"], out["ball"] = np.int64(fits["n"].iloc[0]), np.concatenate(ball)
        return out[names]

    while True:
        sizes = state.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
        sized = state.join(sizes, key)
        shut = F.col("ball") | (F.col("n") <= LEAF_ROWS) | F.coalesce(F.col("n") > PROGRESS * F.col("within"), F.lit(False))
        parts.append(sized.where(shut).select("cid", F.col("node").alias("leaf")))
        open_ = scratch.write(sized.where(~shut).select(*key, "cid", "v", "n"))
        if open_.isEmpty():
            break
        near = F.pmod(F.xxhash64("cid", "node", F.lit(13)), F.lit(_RANGE)) < F.ceil(F.lit(FIT) / F.col("n") * _RANGE)
        fits = scratch.write(open_.where(near).groupBy(*key).applyInPandas(fitted, f"label {label}, dim int, node long, n long, split binary"))
        chunks = F.ceil(F.col("n") / CHUNK).cast("int")
        dealt = open_.withColumn("chunk", F.pmod(F.xxhash64("cid", F.lit(17)), chunks).cast("int"))
        spread = fits.withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks - 1)))
        by = [*key, "chunk"]
        state = scratch.write(dealt.groupBy(*by).cogroup(spread.groupBy(*by)).applyInPandas(assign, f"cid long, label {label}, dim int, node long, v array<double>, within long, ball boolean"))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def _leaf_links(classes: DataFrame, threshold: float, trees: int, scratch: Scratch) -> DataFrame:
    """(cid, links, low) rows whose sums of links and union of (cid, low) are the whole."""
    own = _leaves(classes, threshold, trees, scratch).groupBy("cid").agg(F.sort_array(F.collect_set("leaf")).alias("leaves"))
    placed = scratch.write(classes.join(own, "cid").select("cid", "label", "v", "copies", F.size("v").alias("dim"), "leaves"))
    key = ["label", "dim", "leaf"]
    spread = placed.withColumn("leaf", F.explode("leaves"))
    large = spread.groupBy(*key).count().where(F.col("count") > LEAF_ROWS).select(*key, F.ceil(F.col("count") / LEAF_ROWS).cast("int").alias("chunks"))
    mine = F.pmod(F.xxhash64("cid", F.lit(7)), F.col("chunks")).cast("int")
    dealt = (
        spread.join(large, key, "left")
        .withColumn("chunks", F.coalesce("chunks", F.lit(1)))
        .withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .withColumns({"one": F.least("mine", "other"), "two": F.greatest("mine", "other")})
    )

    def compare(pdf):
        import pandas as pd

        leaf, one, two = (int(pdf[c].iloc[0]) for c in ("leaf", "one", "two"))
        pdf = pdf.sort_values("cid", kind="stable")
        side = pdf["mine"].to_numpy() == one
        links, low = _compare(matrix(pdf["v"]), pdf["copies"].to_numpy(), pdf["leaves"].tolist(), leaf, side if one != two else None, threshold)
        cid = pdf["cid"].to_numpy()
        hit = (links > 0) | (low != np.arange(len(low)))
        return pd.DataFrame({"cid": cid[hit], "links": links[hit], "low": cid[low[hit]]})

    return dealt.select(*key, "one", "two", "mine", "cid", "v", "copies", "leaves").groupBy(*key, "one", "two").applyInPandas(compare, "cid long, links long, low long")


def _compare(x: np.ndarray, copies: np.ndarray, leaves: list, leaf: int, side: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of each row that this leaf counts, and the first row of its group here.

    side: rows of the first of two chunks, where only pairs across them are compared.
    """
    n = len(x)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    before = [np.asarray(own, dtype=np.int64) for own in leaves]
    before = [own[own < leaf] for own in before]
    links, lab = np.zeros(n, dtype=np.int64), np.arange(n)
    first = np.arange(n) if side is None else np.flatnonzero(side)
    second = first if side is None else np.flatnonzero(~side)
    for i in range(0, len(first), _BLOCK):
        a = first[i : i + _BLOCK]
        for j in range(i if side is None else 0, len(second), _BLOCK):
            b = second[j : j + _BLOCK]
            close = u[a] @ u[b].T >= threshold
            if side is None:
                close &= a[:, None] < b[None, :]
            if not close.any():
                continue
            p, q = np.nonzero(close)
            lab = min_labels(n, np.r_[np.arange(n), a[p]], np.r_[lab, b[q]])
            own = close
            i_, j_ = np.flatnonzero(close.any(axis=1)), np.flatnonzero(close.any(axis=0))
            own[np.ix_(i_, j_)] &= ~_meet([before[k] for k in a[i_]], [before[k] for k in b[j_]])
            np.add.at(links, a, own @ copies[b])
            np.add.at(links, b, own.T @ copies[a])
    return links, lab


def _meet(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """Which rows of one share a leaf with which of two; only leaves that both sides have are laid out, some at a time."""
    out = np.zeros((len(one), len(two)), dtype=bool)
    sides = [(np.repeat(np.arange(len(x)), [len(k) for k in x]), np.concatenate([np.zeros(0, dtype=np.int64), *x])) for x in (one, two)]
    common = np.intersect1d(sides[0][1], sides[1][1])
    for k in range(0, len(common), _LEAVES):
        some = common[k : k + _LEAVES]
        laid = []
        for (row, leaf), many in zip(sides, out.shape, strict=True):
            at = np.minimum(np.searchsorted(some, leaf), len(some) - 1)
            hit = some[at] == leaf
            table = np.zeros((many, len(some)), dtype=np.float32)
            table[row[hit], at[hit]] = 1
            laid.append(table)
        out |= laid[0] @ laid[1].T > 0
    return out
