"""SimHash near-duplicates by pivot distance tables.

Fingerprints: per bit the majority of XXH64 (seed 42) over a text's 3-word shingles.
Links: pairs at ``radius`` or fewer differing bits, found over distinct fingerprints only.

Pairs are dealt to tasks by agreement on blocks: of five blocks of bits, a pair within
three bits agrees on two whole blocks, so the ten block pairs lose no link. Inside a
bucket the pivot table works: distances of each fingerprint to ``PIVOTS`` are computed
once; by the triangle inequality a pair whose distances to one pivot differ by more than
the radius can't link and is discarded; survivors are verified. (Pivot windows alone keep
about 0.46 of random pairs for each pivot at radius 3, so they can't deal out the work.)

No pair leaves a bucket: each task unites its bucket's links and emits one link from each
fingerprint to the smallest of its group. Buckets of near copies thus cost rows, not
squares of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, map_slices, min_labels, n_partitions, one_of_each, plain_names, sorted_groups, tidied, words_of
from .components import connected_components

RADIUS = 3
SEED = 42
#: Buckets up to this size are compared by shifted arrays, larger ones by growing groups.
SMALL = 48
#: Reference fingerprints: a fixed pseudo-random sequence.
PIVOTS = np.random.default_rng(64).integers(0, 2**64, 12, dtype=np.uint64)


def fingerprint(words: list[bytes]) -> int:
    """64-bit SimHash of lower-cased words; no words: zero."""
    n = len(words)
    if n == 0:
        return 0
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if n < 3:
        return digest(joined, SEED)
    size = np.fromiter(map(len, words), dtype=np.int64, count=n) + 1
    ends = np.cumsum(size)
    starts = (ends - size)[:-2].tolist()
    return majority(np.array([digest(joined[s:e], SEED) for s, e in zip(starts, (ends[2:] - 1).tolist(), strict=True)], dtype="<u8"))


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the 64-bit digests; none: zero."""
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 1 << 15):  # bounded memory for very long texts
        part = h[i : i + (1 << 15)]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> (doc_id, th, fp): a digest of the text and the fingerprint, signed longs."""

    def run(batches: Iterator) -> Iterator:
        for pdf in batches:
            fps = np.array([fingerprint(words_of(t, lower=True)) for t in pdf["text"]], dtype=np.uint64)
            yield pdf[["doc_id", "th"]].assign(fp=fps.view(np.int64))

    return map_slices(docs.select(F.col("doc_id").cast("long"), text_digest(), F.col("text")), run, "doc_id long, th long, fp long")


def text_digest() -> Column:
    return F.xxhash64("text").alias("th")


def _blocks(parts: int) -> list[int]:
    edges = [round(64 * i / parts) for i in range(parts + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]


def block_keys(radius: int = RADIUS) -> list[int]:
    """Masks of which every pair within the radius agrees on one at least."""
    return [a | b for a, b in combinations(_blocks(radius + 2), 2)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def similar_links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Distinct fp -> links (a, b) that join the same groups as all pairs within the radius."""
    keys: list[Column] = [F.struct(F.lit(i).cast("byte").alias("k"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("v")) for i, m in enumerate(block_keys(radius))]
    n = n_partitions(fps.sparkSession)
    dealt = fps.select("fp", F.explode(F.array(*keys)).alias("key")).select("key.k", "key.v", "fp")

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in sorted_groups(batches, ["k", "v"]):
            a, b = _bucket_links(pdf["k"].to_numpy(), pdf["v"].to_numpy(), pdf["fp"].to_numpy(), radius)
            yield pd.DataFrame({"a": a, "b": b})

    return dealt.repartition(n, "k", "v").sortWithinPartitions("k", "v", "fp").mapInPandas(tidied(run), "a long, b long")


def _bucket_links(k: np.ndarray, v: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by (k, v, fp), whole buckets: for each row its group's smallest fp, where another."""
    x = fp.view(np.uint64)
    table = np.bitwise_count(x[:, None] ^ PIVOTS[None, :]).astype(np.int8)  # the pivot distance table
    first = np.r_[True, (k[1:] != k[:-1]) | (v[1:] != v[:-1])]
    start = np.flatnonzero(first)
    size = np.diff(np.r_[start, len(x)])
    bucket = np.cumsum(first) - 1
    lab = np.arange(len(x))
    small = np.flatnonzero(size[bucket] <= SMALL)
    ends = (start + size)[bucket]
    found_a, found_b = [], []
    step = 1
    left = small[small + step < ends[small]]
    while len(left):
        a, b = left, left + step
        for p in range(table.shape[1]):
            keep = np.abs(table[a, p] - table[b, p]) <= radius
            a, b = a[keep], b[keep]
        near = np.bitwise_count(x[a] ^ x[b]) <= radius
        found_a.append(a[near])
        found_b.append(b[near])
        step += 1
        left = left[left + step < ends[left]]
    if found_a:
        lab = min_labels(len(x), np.concatenate(found_a), np.concatenate(found_b))
    for i in np.flatnonzero(size > SMALL):
        s, e = start[i], start[i] + size[i]
        lab[s:e] = s + _grow(x[s:e], table[s:e], radius)
    moved = lab != np.arange(len(x))
    return fp[moved], fp[lab[moved]]


def _grow(x: np.ndarray, table: np.ndarray, radius: int) -> np.ndarray:
    """Groups of one large bucket: take a member, draw in all within the radius, go on from those.

    The bucket lies sorted by its distance to one pivot, and a member meets only rows whose
    distance is within the radius; other pivots discard before the rest is verified.
    """
    pick = int(np.argmax(table.astype(np.float64).std(axis=0)))
    order = np.argsort(table[:, pick], kind="stable")
    d, xs, ts = table[order, pick], x[order], table[order]
    bounds = np.searchsorted(d, np.arange(-radius, 65 + radius + 1))
    lab = np.full(len(x), -1)
    free: list[np.ndarray] = [np.arange(bounds[i + radius], bounds[i + radius + 1]) for i in range(65)]  # by distance to the pivot
    for seed in range(len(x)):
        if lab[seed] >= 0:
            continue
        lab[seed] = seed
        todo = [seed]
        while todo:
            m = todo.pop()
            at = int(d[m])
            for c in range(max(0, at - radius), min(64, at + radius) + 1):
                rows = free[c]
                if not len(rows):
                    continue
                rows = rows[lab[rows] < 0]
                near = rows[np.abs(ts[rows] - ts[m]).max(axis=1) <= radius]  # maximum coordinate difference
                near = near[np.bitwise_count(xs[near] ^ xs[m]) <= radius]
                lab[near] = seed
                todo.extend(near.tolist())
                free[c] = rows[lab[rows] < 0] if len(near) else rows
    out = np.empty(len(x), dtype=np.int64)
    low = np.full(len(x), len(x))
    np.minimum.at(low, lab, order)
    out[order] = low[lab]
    return out


def _grouped(docs: DataFrame, radius: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, th, fp) of each row, and (fp, root) of each fingerprint."""
    scratch = Scratch(docs.sparkSession, "simhash")
    marked = scratch.write(fingerprints(docs))
    fps = marked.select("fp").distinct()
    roots = connected_components(similar_links(fps, radius), scratch)
    return marked, fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))


def simhash_components(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, text) -> (doc_id, fingerprint, component_id), a row for each row of docs.

    component_id: smallest doc_id reachable over links, itself included. Null or empty text
    has the fingerprint zero and links like any other. A row with a null doc_id takes part
    but never names a group; a group of such rows only has a null component_id. Very long texts
    are read whole. Repeated rows each give a row; an empty table gives none. Columns other than doc_id and text are ignored.
    """
    marked, of = _grouped(docs, radius)
    low = marked.groupBy("fp").agg(F.min("doc_id").alias("low")).join(of, "fp")
    named = low.join(low.groupBy("root").agg(F.min("low").alias("component_id")), "root").select("fp", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return marked.join(named, "fp").select("doc_id", hexed, "component_id")


def simhash_dedup(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of docs for each group, with all columns: the one of the smallest doc_id.

    Between rows of one doc_id the text digest decides; of rows equal in both, the first by its
    other columns. Columns may have any names. Rows with a null doc_id stay as they are: they can't name a group.
    """
    return keep_first(docs, *_grouped(docs, radius))


def keep_first(docs: DataFrame, marked: DataFrame, of: DataFrame) -> DataFrame:
    """The rows of docs that ``simhash_dedup`` keeps, of marked (doc_id, th, fp) and of (fp, root)."""
    first = marked.where("doc_id is not null").groupBy("fp").agg(F.min(F.struct("doc_id", "th")).alias("first"))
    keep = first.join(of, "fp").groupBy("root").agg(F.min("first").alias("first")).select("first.doc_id", "first.th")
    mine, names = plain_names(docs, "doc_id", "text")
    key = ["id", "th"]
    mine = mine.withColumns({"id": F.col("doc_id").cast("long"), "th": F.xxhash64("text")}).join(keep.select(F.col("doc_id").alias("id"), "th"), key, "left_semi")
    kept = one_of_each(mine, key, names).select(*names).toDF(*docs.columns)
    return kept.union(docs.where("doc_id is null"))
