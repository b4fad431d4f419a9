"""Near copies: SimHash pivot tables and MinHash bands name candidates, exact similarity decides.

Similarity: Jaccard of the sets of ``WORDS``-word shingles of lower-cased words (a text of
fewer words is one shingle). Texts with one set are one node. Two ways lead to candidates.
SimHash fingerprints of the sets are linked within ``RADIUS`` bits by pivot distance tables,
as in ``simhash``. A pair at similarity 0.8 differs in about 10 bits, which no pivot can
tell from chance, so MinHash bands bring together what lies further apart: of ``BANDS`` bands of ``ROWS`` minima a pair at similarity 0.8 shares none with a
chance of 3e-6, a closer pair with less. Within a band's bucket nodes are compared by their
sketches, a byte of each minimum: pairs that agree in fewer than ``AGREE`` of them are no
candidates, which leaves out texts that share no more than some boilerplate, and a pair at
0.8 with a chance of 1e-6. Only nodes that candidates connect, directly or over others, are
compared as sets, and only pairs whose exact similarity reaches the threshold link.

Buckets above ``BUCKET`` nodes and groups above ``CHUNK`` bytes or ``CHUNK_ROWS`` nodes are
dealt out as pairs of their chunks, so a task is bounded and nothing is truncated. A task
emits one link from each node to the smallest of its group there, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, give_back, map_slices, sorted_groups, tidied, words_of
from .components import connected_components
from .simhash import RADIUS, SEED, keep_first, majority, similar_links, text_digest

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 4
#: Bytes of a sketch that candidates agree in at least, and nodes above which a bucket is dealt out in chunks.
AGREE, BUCKET = 57, 2048
#: Bytes of sets and nodes above which a candidate group is dealt out in chunks.
CHUNK, CHUNK_ROWS = 8 << 20, 1024
_SEEDS, _ODD = np.random.default_rng(96).integers(0, 2**64, (2, BANDS * ROWS, 1), dtype=np.uint64)
_ODD |= np.uint64(1)


def shingle_set(words: list[bytes], n: int = WORDS) -> np.ndarray:
    """Sorted distinct XXH64 digests of the n-word shingles; no words: none."""
    if not words:
        return np.zeros(0, dtype="<u8")
    return np.array(sorted({xxhash.xxh64_intdigest(b" ".join(words[i : i + n]), SEED) for i in range(max(1, len(words) - n + 1))}), dtype="<u8")


def bands(grams: np.ndarray) -> tuple[list[int], bytes]:
    """A signed digest of each band of minima, with the band's number, and the sketch; none of an empty set."""
    if not len(grams):
        return [], b""
    low = np.full(BANDS * ROWS, 2**64 - 1, dtype="<u8")
    for i in range(0, len(grams), 1 << 13):  # bounded memory for very long texts
        low = np.minimum(low, ((grams[None, i : i + (1 << 13)] ^ _SEEDS) * _ODD).min(axis=1))
    digests = [xxhash.xxh64_intdigest(low[b * ROWS : (b + 1) * ROWS].tobytes(), b) for b in range(BANDS)]
    return np.array(digests, dtype=np.uint64).view(np.int64).tolist(), (low.ravel() >> np.uint64(24)).astype(np.uint8).tobytes()


def _marked(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, th, fp, bands, sketch, simhash) of each row; fp: a digest of the shingle set."""

    def run(batches: Iterator) -> Iterator:
        for pdf in batches:
            sets = [shingle_set(words_of(t, lower=True), n) for t in pdf["text"]]
            fps = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], dtype=np.uint64)
            made = [bands(s) for s in sets]
            near = np.array([majority(s) for s in sets], dtype=np.uint64)
            yield pdf[["doc_id", "th"]].assign(fp=fps.view(np.int64), bands=[b for b, _ in made], sketch=[k for _, k in made], simhash=near.view(np.int64))

    return map_slices(docs.select(F.col("doc_id").cast("long"), text_digest(), "text"), run, "doc_id long, th long, fp long, bands array<long>, sketch binary, simhash long")


def _close(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """nodes (fp, bands, simhash) -> links (a, b) that join the nodes whose SimHashes lie within the radius."""
    held = nodes.where("size(bands) > 0")  # no words: one node, which has no set to compare
    first = held.groupBy("simhash").agg(F.min("fp").alias("low"))
    equal = held.join(first, "simhash").where("fp != low").select(F.col("fp").alias("a"), F.col("low").alias("b"))
    links = similar_links(first.select(F.col("simhash").alias("fp")), radius).join(first.toDF("a", "one"), "a").join(first.toDF("b", "two"), "b")
    return equal.union(links.select("one", "two"))


def _candidates(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """nodes (fp, bands, sketch) -> links (a, b) of nodes that share a band's bucket and agree there."""
    spread = nodes.select("fp", F.explode("bands").alias("band"))
    size = spread.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    chunks = F.ceil(F.col("n") / BUCKET).cast("int")
    shared = scratch.write(spread.join(size.select("band", chunks.alias("chunks")), "band"))
    dealt = (
        shared.join(nodes.select("fp", "sketch"), "fp")
        .withColumn("mine", F.pmod(F.xxhash64("fp", F.lit(9)), F.col("chunks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("band", F.least("mine", "other").alias("one"), F.greatest("mine", "other").alias("two"), "fp", "sketch")
    )
    key = ["band", "one", "two"]

    def run(batches: Iterator) -> Iterator:
        for pdf in sorted_groups(batches, key):
            same = np.ones(len(pdf), dtype=bool)
            for c in key:
                x = pdf[c].to_numpy()
                same &= np.r_[False, x[1:] == x[:-1]]
            fp = pdf["fp"].to_numpy()
            lab = agreeing(np.cumsum(~same) - 1, np.frombuffer(b"".join(pdf["sketch"]), dtype=np.uint8).reshape(len(pdf), -1))
            moved = lab != np.arange(len(lab))
            yield pd.DataFrame({"a": fp[moved], "b": fp[lab[moved]]})

    return dealt.repartition(*key).sortWithinPartitions(*key, "fp").mapInPandas(tidied(run), "a long, b long").distinct()


def agreeing(bucket: np.ndarray, sketch: np.ndarray, least: int = AGREE) -> np.ndarray:
    """Smallest index reachable of each row over rows of its bucket whose sketches agree; bucket: ascending from 0.

    In each round every bucket takes its next row that has been drawn in, or else its first
    free one, and draws in all free rows that agree with it, until none is free.
    """
    n = len(bucket)
    lab = np.full(n, -1)
    start = np.searchsorted(bucket, np.arange(bucket[-1] + 1)) if n else np.zeros(0, dtype=np.int64)
    drawn: dict[int, list[int]] = {}
    free = np.arange(n)
    while len(free):
        open_, first = np.unique(bucket[free], return_index=True)
        taken = np.full(len(start), -1)
        taken[open_] = free[first]
        for b in open_.tolist():
            if drawn.get(b):
                taken[b] = drawn[b].pop()
        own = taken[open_]
        new = own[lab[own] < 0]
        lab[new] = new
        free = free[lab[free] < 0]
        if not len(free):
            break
        asks = taken[bucket[free]]
        hit = free[_agree(sketch, free, asks) >= least]
        lab[hit] = lab[taken[bucket[hit]]]
        for i in hit.tolist():
            drawn.setdefault(int(bucket[i]), []).append(i)
        free = free[lab[free] < 0]
    return lab


def _agree(sketch: np.ndarray, a: np.ndarray, b: np.ndarray, at_once: int = 1 << 16) -> np.ndarray:
    """Equal bytes of the rows a and b of sketch."""
    return np.concatenate([np.zeros(0, dtype=np.int64), *((sketch[a[i : i + at_once]] == sketch[b[i : i + at_once]]).sum(axis=1) for i in range(0, len(a), at_once))])


def _groups(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Smallest index reachable of each set: take a set, draw in all similar ones, go on from those."""
    size = np.array([len(s) for s in sets])
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends = np.cumsum(size)
    mark = np.zeros(int(flat.max()) + 1, dtype=bool)
    lab = np.full(len(sets), -1)
    free, of = np.arange(len(sets)), np.repeat(np.arange(len(sets)), size)
    left = flat  # the shingles of free sets
    for seed in range(len(sets)):
        if lab[seed] >= 0:
            continue
        lab[seed] = seed
        todo = [seed]
        while todo and len(free):
            m = todo.pop()
            own = flat[ends[m] - size[m] : ends[m]]
            mark[own] = True
            both = np.add.reduceat(mark[left], np.r_[0, np.cumsum(size[free])[:-1]], dtype=np.int64)
            mark[own] = False
            near = free[(both / (size[free] + size[m] - both) >= similarity) & (lab[free] < 0)]
            lab[near] = seed
            todo.extend(near.tolist())
            if len(near) or lab[free[0]] >= 0:
                stay = lab < 0
                left, of, free = left[stay[of]], of[stay[of]], free[stay[free]]
    return lab


def _verified(docs: DataFrame, cands: DataFrame, n: int, similarity: float, scratch: Scratch) -> DataFrame:
    """cands (th, fp, root), a row for each fp -> links (a, b) of verified pairs' groups."""

    def run(batches: Iterator) -> Iterator:
        for pdf in batches:
            yield pdf[["fp", "root"]].assign(grams=[shingle_set(words_of(t, lower=True), n).tobytes() for t in pdf["text"]])

    # copies of a text merge where they are read: a text that many rows hold is not shuffled to one task that often
    texts = docs.select(text_digest(), "text").dropDuplicates(["th"]).join(cands, "th")
    sets = scratch.write(map_slices(texts.select("fp", "root", "text"), run, "fp long, root long, grams binary"))
    size = sets.groupBy("root").agg(F.sum(F.octet_length("grams")).alias("bytes"), F.count(F.lit(1)).alias("rows"))
    chunks = F.ceil(F.greatest(F.col("bytes") / CHUNK, F.col("rows") / CHUNK_ROWS)).cast("int")
    large = size.select("root", chunks.alias("chunks")).where("chunks > 1")
    dealt = (
        sets.join(large, "root", "left")
        .withColumn("chunks", F.coalesce("chunks", F.lit(1)))
        .withColumn("mine", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("chunks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("root", F.least("mine", "other").alias("one"), F.greatest("mine", "other").alias("two"), "fp", "grams")
    )

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("fp", kind="stable")
        fp, lab = pdf["fp"].to_numpy(), _groups([np.frombuffer(g, dtype="<u8") for g in pdf["grams"]], similarity)
        moved = lab != np.arange(len(lab))
        if len(lab) > 100:  # grouped workers have no end of a task to do it at
            give_back()
        return pd.DataFrame({"a": fp[moved], "b": fp[lab[moved]]})

    return dealt.groupBy("root", "one", "two").applyInPandas(compare, "a long, b long")


def near_dedup(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """One row of docs for each group of similar texts, with all columns, as ``simhash_dedup`` keeps it.

    Groups: rows linked directly or over others by pairs of at least the similarity; texts
    without words (null, empty) are alike. The smallest doc_id stays, of repeated rows one;
    rows with a null doc_id stay, since they can't name a group. Texts of any length are read
    whole, an empty table gives none. The bands and sketches fit similarities of 0.8 and above.
    """
    scratch = Scratch(docs.sparkSession, "near-dedup")
    marked = scratch.write(_marked(docs, words))
    nodes = scratch.write(marked.dropDuplicates(["fp"]).select("fp", "bands", "sketch", "simhash"))
    cands = connected_components(_candidates(nodes, scratch).union(_close(nodes)).distinct(), scratch)
    named = marked.join(cands, marked["fp"] == cands["node"]).groupBy("fp").agg(F.min("th").alias("th"), F.min("root").alias("root"))
    roots = connected_components(_verified(docs, scratch.write(named), words, similarity, scratch), scratch)
    of = marked.select("fp").distinct().join(roots, F.col("fp") == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))
    return keep_first(docs, marked.select("doc_id", "th", "fp"), of)
