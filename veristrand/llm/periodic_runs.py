"""Periodic runs of words, by longest previous factors.

A run is a maximal stretch of consecutive words in which words q apart are equal, q its
smallest period, at least ``TIMES`` periods and ``LEAST`` words long. For a group of
documents at a time, laid end to end with words that differ from document to document:

1. Prefix doubling gives the suffix array and, on the way, tables of the ranks of all
   factors of 1, 2, 4, ... words. The LCP of any two suffixes, and of any two prefixes,
   is read from the tables by descending through them.
2. The longest previous factor of a position is its larger LCP with the nearest suffixes
   on either side of it in the suffix array that start before it; jumps over these factors
   give the Lempel-Ziv blocks.
3. A run that touches the end of a block is found there (Main): for each period that the
   two blocks around a border allow, both extensions along the period are measured. If a run
   of ``TIMES`` periods ends in block k and starts by the border b(k), then a period of a
   third of both blocks or more would let block k-1 reach past the border: so borders have
   no more periods to try than there are words.
4. All other runs lie within a block, and so again, earlier, where the block was copied
   from: runs are kept in buckets by start, and each block, from left to right, copies those
   of its source.

Work is n log n for n words; memory follows the words of a group, or of one document if
that is longer.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_slices, plain_names, words_of

#: A run's words at least, and periods.
LEAST, TIMES = 6, 4
#: Words of documents that are worked on together.
GROUP_WORDS = 150_000

Run = tuple[int, int, int]


class Suffixes:
    """Suffix array of several word sequences laid end to end, and LCPs between any places of one sequence.

    words: a number each word; doc: the number of its sequence, ascending. Places of different
    sequences never match.
    """

    def __init__(self, words: np.ndarray, doc: np.ndarray):
        n = self.n = len(words)
        order, start = _grouped(doc.astype(np.int64) * (int(words.max(initial=0)) + 1) + words)
        rank = np.empty(n, dtype=np.int32)
        rank[order] = start
        self.tables = [rank]
        #: The largest factor table in which a place still shares its rank with another one; -1: none.
        self.shared = np.full(n, -1, dtype=np.int8)
        open_ = _ties(order, start)
        while len(open_):
            self.shared[open_] = len(self.tables) - 1
            width = 1 << (len(self.tables) - 1)
            last = self.tables[-1]
            ahead = open_ + width
            second = np.where(ahead < n, last[np.minimum(ahead, n - 1)].astype(np.int64) + 1, 0)
            order, start = _grouped(last[open_].astype(np.int64) * (n + 1) + second)
            # places of one old rank are together in the new order, and take the ranks from the old one on
            places = open_[order]
            old = last[places]
            head = np.r_[True, old[1:] != old[:-1]]
            first = np.maximum.accumulate(np.where(head, np.arange(len(old)), 0))
            rank = last.copy()
            rank[places] = old + (start - first).astype(np.int32)
            self.tables.append(rank)
            open_ = np.sort(_ties(places, start))
        self.array = np.empty(n, dtype=np.int32)
        self.array[self.tables[-1]] = np.arange(n, dtype=np.int32)

    def lcp(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that the suffixes at a and b begin with in common; a place of n ends at once."""
        out = np.zeros(len(a), dtype=np.int64)
        for k in range(len(self.tables) - 2, -1, -1):
            x, y = a + out, b + out
            m = np.flatnonzero((x < self.n) & (y < self.n))
            same = m[self.tables[k][x[m]] == self.tables[k][y[m]]]
            out[same] += 1 << k
        return out

    def lcs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that the prefixes before a and before b end with in common."""
        out = np.zeros(len(a), dtype=np.int64)
        for k in range(len(self.tables) - 2, -1, -1):
            x, y = a - out - (1 << k), b - out - (1 << k)
            m = np.flatnonzero((x >= 0) & (y >= 0))
            same = m[self.tables[k][x[m]] == self.tables[k][y[m]]]
            out[same] += 1 << k
        return out

    def previous_factors(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each place, the longest factor from there that also starts at an earlier place of its sequence, and that place."""
        sa, at = self.array, self.tables[-1]
        group = self.tables[0][sa]  # suffixes that begin with one word are together
        size, source = np.zeros(self.n, dtype=np.int64), np.full(self.n, -1, dtype=np.int64)
        asked = np.flatnonzero(self.shared >= 0)
        for near in (_nearest_smaller(sa, group), _mirrored(_nearest_smaller(sa[::-1], group[::-1]))):
            row = near[at[asked]]
            m = row >= 0
            here, there = asked[m], sa[row[m]].astype(np.int64)
            found = self._lcp_by_depth(here, there)
            better = found > size[here]
            size[here[better]], source[here[better]] = found[better], there[better]
        return size, source

    def _lcp_by_depth(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """lcp(a, b), where no table is asked about a place that shares no rank there."""
        out = np.zeros(len(a), dtype=np.int64)
        depth = self.shared[a]
        for k in range(len(self.tables) - 2, -1, -1):
            m = np.flatnonzero(depth >= k)
            x, y = a[m] + out[m], b[m] + out[m]
            inside = (x < self.n) & (y < self.n)
            m, x, y = m[inside], x[inside], y[inside]
            out[m[self.tables[k][x] == self.tables[k][y]]] += 1 << k
        return out


def _grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of keys, and for each place in it where its group of equal keys starts."""
    order = np.argsort(keys)
    k = keys[order]
    head = np.r_[True, k[1:] != k[:-1]] if len(k) else np.zeros(0, dtype=bool)
    return order, np.maximum.accumulate(np.where(head, np.arange(len(k)), 0))


def _ties(places: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Places that share their group with another one."""
    if not len(start):
        return places
    head = np.r_[True, start[1:] != start[:-1]]
    alone = head & np.r_[head[1:], True]
    return places[~alone]


def _nearest_smaller(x: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Of each index, the nearest before it with a smaller value in its group (-1: none); values differ.

    All between an index and its candidate are larger, so a candidate that is too large may
    pass on its own one. Groups are stretches.
    """
    near = np.arange(-1, len(x) - 1)
    near[np.r_[True, group[1:] != group[:-1]]] = -1
    todo = np.flatnonzero(near >= 0)
    while len(todo):
        todo = todo[x[near[todo]] > x[todo]]
        near[todo] = near[near[todo]]
        todo = todo[near[todo] >= 0]
    return near


def _mirrored(near: np.ndarray) -> np.ndarray:
    return np.where(near >= 0, len(near) - 1 - near, -1)[::-1]


def runs_of(docs: list[np.ndarray], least: int = LEAST, times: int = TIMES) -> list[list[Run]]:
    """(start, length, period) of all runs of each document, by start, then period. docs: a number each word."""
    if times < 2:
        raise ValueError("a run has two periods at least")
    sizes = np.array([len(x) for x in docs], dtype=np.int64)
    out: list[list[Run]] = [[] for _ in docs]
    if not sizes.sum():
        return out
    first = np.cumsum(sizes) - sizes
    suffixes = Suffixes(np.concatenate(docs), np.repeat(np.arange(len(docs)), sizes))
    size, source = suffixes.previous_factors()
    # one period into a run, a factor as long as the rest of it starts earlier
    needed = min(max(least - q, (times - 1) * q) for q in range(1, least + 1))
    blocks: dict[int, list[int]] = {}
    for d in np.unique(np.searchsorted(first, np.flatnonzero(size >= needed), side="right") - 1).tolist():
        step = np.maximum(size[first[d] : first[d] + sizes[d]], 1).tolist()
        at, n, borders = 0, len(step), []
        while at < n:
            borders.append(at)
            at += step[at]
        blocks[d] = [*borders, n]
    if not blocks:
        return out
    for d, found in _at_borders(suffixes, blocks, first, least, times).items():
        out[d] = sorted((i, j - i, p) for (i, j), p in _copied(found, blocks[d], source[first[d] : first[d] + sizes[d]] - first[d]).items())
    return out


def _at_borders(suffixes: Suffixes, blocks: dict[int, list[int]], first: np.ndarray, least: int, times: int) -> dict[int, dict[tuple[int, int], int]]:
    """Per document, the smallest period of each run (start, end) that touches the border of two blocks."""
    doc, border, most, inner = [], [], [], []
    for d, b in blocks.items():
        b = np.array(b, dtype=np.int64)
        own = np.diff(b, append=b[-1])  # the end is a border, of an empty block
        doc.append(np.full(len(b) - 1, d))
        border.append(b[1:] + first[d])
        most.append((own[:-1] + own[1:]) // (times - 1))
        inner.append(own[1:] > 0)
    doc, border, most, inner = map(np.concatenate, (doc, border, most, inner))
    found: dict[int, dict[tuple[int, int], int]] = {}
    table, n = suffixes.tables[0], suffixes.n
    sent = np.cumsum(most)
    for lo, hi in _stretches(sent):
        some = np.arange(lo, hi)
        pick = np.repeat(some, most[some])
        p = np.arange(len(pick)) - np.repeat(np.cumsum(most[some]) - most[some], most[some]) + 1
        b = border[pick]
        for shift in (0, 1):  # the period's other end behind the border, or before it
            x = b - p * shift
            y = x + p
            inside = inner[pick] | (shift == 1)  # behind a document's end lies another one
            ahead = np.flatnonzero(inside & (x >= 0) & (y < n))
            ahead = ahead[table[x[ahead]] == table[y[ahead]]]
            behind = np.flatnonzero(inside & (x >= 1) & (y <= n))
            behind = behind[table[x[behind] - 1] == table[y[behind] - 1]]
            m = np.union1d(ahead, behind)
            start, end = x[m] - suffixes.lcs(x[m], y[m]), y[m] + suffixes.lcp(x[m], y[m])
            long = end - start >= np.maximum(least, times * p[m])
            for d, i, j, q in zip(doc[pick[m[long]]].tolist(), start[long].tolist(), end[long].tolist(), p[m[long]].tolist(), strict=True):
                own, key = found.setdefault(d, {}), (i - int(first[d]), j - int(first[d]))
                own[key] = min(q, own.get(key, q))
    return found


def _stretches(sent: np.ndarray, at_once: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Ranges of borders with about so many periods together."""
    lo = 0
    while lo < len(sent):
        done = sent[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(sent, done + at_once, side="right")))
        yield lo, hi
        lo = hi


def _copied(found: dict[tuple[int, int], int], borders: list[int], source: np.ndarray) -> dict[tuple[int, int], int]:
    """found, with the runs that lie within a block: those within its source, moved."""
    buckets: dict[int, list[tuple[int, int]]] = {}
    for (i, j), p in found.items():
        buckets.setdefault(i, []).append((j, p))
    out = dict(found)
    for b, e in zip(borders, borders[1:], strict=False):
        if e - b < 3 or source[b] < 0:
            continue
        src = int(source[b])
        move, last = b - src, src + e - b
        for i in range(src + 1, last):
            for j, p in tuple(buckets.get(i, ())):
                if j < last and (i + move, j + move) not in out:
                    out[i + move, j + move] = p
                    buckets.setdefault(i + move, []).append((j + move, p))
    return out


def collapsed(n: int, runs: list[Run]) -> np.ndarray:
    """Which of n words stay if each run keeps its first period."""
    stay = np.ones(n, dtype=bool)
    for i, m, p in runs:
        stay[i + p : i + m] = False
    return stay


def repeating(doc_id: int, n: int) -> np.ndarray | None:
    """Places of the words that a tenth of the documents are made of instead: a stretch that repeats; None: as they are."""
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    i = np.arange(n)
    return np.where(i >= a, a + (i - a) % (1 + (n - a) // (3 + g % 8)), i)


def _worked(rows: list[tuple], least: int, times: int) -> Iterator[tuple]:
    """rows of (other values, words) -> the same with their runs."""
    ids: dict[bytes, int] = defaultdict(count().__next__)
    docs = [np.fromiter(map(ids.__getitem__, words), dtype=np.int64, count=len(words)) for _, words in rows]
    for (other, words), runs in zip(rows, runs_of(docs, least, times), strict=True):
        yield other, words, runs


def _grouped_rows(rows: Iterator[tuple], least: int, times: int) -> Iterator[list[tuple]]:
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += len(row[1])
        if size >= GROUP_WORDS or len(held) >= 2048:
            yield list(_worked(held, least, times))
            held, size = [], 0
    if held:
        yield list(_worked(held, least, times))


def runs_report(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256 for each row of docs.

    The words are those of the text, in a tenth of the documents partly replaced by a stretch
    that repeats (``repeating``). start to exponent_milli: of the run with the most periods
    (of equal ones the first by start, then period), null without runs. Null and empty texts
    have no words and no runs; a null doc_id counts as an empty one. Repeated rows give equal
    rows, texts of any length are read whole, and an empty table gives none. Columns other
    than doc_id and text are ignored.
    """

    def words(pdf: pd.DataFrame) -> Iterator[tuple]:
        for d, text in zip(pdf["doc_id"].array, pdf["text"], strict=True):
            own = words_of(text)
            places = repeating("" if pd.isna(d) else int(d), len(own))
            yield d, own if places is None else [own[i] for i in places.tolist()]

    def run(batches: Iterator) -> Iterator:
        for group in _grouped_rows((row for pdf in batches for row in words(pdf)), least, times):
            yield pd.DataFrame([_reported(*x) for x in group], columns=_REPORT).astype(dict.fromkeys(("doc_id", *_REPORT[2:6]), "Int64"))

    kind = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    return map_slices(docs.select(F.col("doc_id").cast("long"), "text"), run, kind)


_REPORT = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def _reported(doc_id: int, words: list[bytes], runs: list[Run]) -> tuple:
    best: Run | None = None
    for r in runs:  # by start, then period: the first of equals stays
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    listed = "".join(f"{i},{m},{p}\n" for i, m, p in runs)
    kept = b" ".join(w for w, s in zip(words, collapsed(len(words), runs).tolist(), strict=True) if s) if runs else b" ".join(words)
    return (doc_id, len(runs), *top, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def collapse_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """docs with, added, runs (an array of start, length, period) and text collapsed: each run keeps its first period.

    The words of a text with runs are joined by one space; other texts stay as they are, null
    and empty ones too. All other columns of docs stay, whatever their names, but for one named
    runs, which is replaced; repeated rows stay apart, and an empty table gives none.
    """
    mine, names = plain_names(docs, "text")
    others = [c for c in names if c != "text"]
    packed = mine.select("text", F.struct(F.lit(0).alias("none"), *others).alias("rest"))

    def run(batches: Iterator) -> Iterator:
        rows = (((rest, text), words_of(text)) for pdf in batches for rest, text in zip(pdf["rest"], pdf["text"], strict=True))
        for group in _grouped_rows(rows, least, times):
            out = [(b" ".join(w for w, s in zip(words, collapsed(len(words), runs).tolist(), strict=True) if s).decode("utf-8", "surrogatepass") if runs else text, rest, [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs]) for (rest, text), words, runs in group]
            yield pd.DataFrame(out, columns=["text", "rest", "runs"])

    rest = packed.schema["rest"].dataType.simpleString()
    done = map_slices(packed, run, f"text string, rest {rest}, runs array<struct<start:long,length:long,period:long>>")
    kept = [(F.col("text") if c == "text" else F.col(f"rest.{c}")).alias(given) for c, given in zip(names, docs.columns, strict=True) if given != "runs"]
    return done.select(*kept, "runs")
