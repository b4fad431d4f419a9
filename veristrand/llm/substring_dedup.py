"""Repeated passages by seed and extend.

Seeds: winnowing picks one anchor, a ``GRAM``-word sequence, in every window of
``LENGTH`` words, by content alone: equal windows have equal anchors. Documents meet on
anchors only. Extend: all windows that chose one anchor span a context to both sides of it;
occurrences with equal context match over the whole of it, and the first document keeps
the words. Contexts that differ under one anchor (ends of a repeat, chance) are extended
word by word: their windows are laid out and matched one at a time. Touching matches merge
into maximal repeats. Each window of LENGTH words that starts in a document of smaller
doc_id is thus found, and no other (64-bit digests, compared under equal anchors only).

Nothing is paired: an anchor shared by many documents costs a row for each. Copies within
one batch of documents are settled at once and only their first goes on, so a passage that
a third of all documents share sends a row for each batch. Anchors frequent in a bounded
sample of documents are dealt out by context, not by anchor.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import SLICE, Scratch, map_slices, n_partitions, small_batches, sorted_groups, tidied

LENGTH = 13
GRAM = 5
#: Documents, at most, that tell which anchors are frequent, and the share that makes them so.
SAMPLE_DOCS, FREQUENT = 2000, 1 / 200
#: Anchors that a task gathers before it settles copies among them.
_ROWS = 200_000
_BASE = 0x9E3779B97F4A7C15 | 1
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_GAP = re.compile(rb"[\x20\x09-\x0D]")
#: Bytes of text that are read at a time, of one document or of many.
_PIECE = 1 << 18
#: Bytes that part words, and a random number for each byte.
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_BYTES = np.random.default_rng(13).integers(0, 2**64, 256, dtype=np.uint64)
#: Rows that are settled at a time.
_AT_ONCE = 50_000


class _Powers:
    up = np.ones(1, dtype=np.uint64)
    down = np.ones(1, dtype=np.uint64)

    @classmethod
    def to(cls, n: int) -> None:
        if len(cls.up) <= n:
            m = max(n + 1, 2 * len(cls.up), 1 << 14)
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                x = np.full(m, base, dtype=np.uint64)
                x[0] = 1
                setattr(cls, name, np.multiply.accumulate(x))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_digests(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text start, and their 64-bit digests; pieces end between words."""
    a = np.frombuffer(raw, dtype=np.uint8)
    starts, digests = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.uint64)]
    low = 0
    while low < len(a):
        high = low + _PIECE
        if high < len(a):
            gap = _GAP.search(raw, high)
            high = gap.end() if gap else len(a)
        part = a[low:high]
        _Powers.to(len(part))
        gaps = np.ones(len(part) + 2, dtype=bool)
        gaps[1:-1] = _SPACE[part]
        turns = np.flatnonzero(gaps[1:] != gaps[:-1])
        s, e = turns[::2], turns[1::2]
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(_BYTES[part] * _Powers.up[: len(part)], out=sums[1:])
        digests.append(_mix((sums[e] - sums[s]) * _Powers.down[s] + (e - s).astype(np.uint64)))
        starts.append(s + low)
        low += len(part)
    return np.concatenate(starts), np.concatenate(digests)


class Text:
    """Digests of any run of a text's words."""

    def __init__(self, raw: bytes):
        self.starts, w = _word_digests(raw)
        self.n = n = len(w)
        _Powers.to(n)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(w * _Powers.up[:n], out=self.sums[1:])

    def runs(self, start: np.ndarray, length) -> np.ndarray:
        return _mix((self.sums[start + length] - self.sums[start]) * _Powers.down[start])

    def anchors(self, edges: np.ndarray) -> tuple[np.ndarray, ...]:
        """For each anchor: its digest, its context's digest, first window, number of windows, document.

        edges: where documents start among the words, and the number of words; no window crosses them.
        """
        windows = max(0, self.n - LENGTH + 1)
        gram = self.runs(np.arange(max(0, self.n - GRAM + 1)), GRAM)
        best, at = gram[:windows], np.arange(windows)
        for k in range(1, LENGTH - GRAM + 1):
            other = gram[k : k + windows]
            better = other <= best  # the last of equal ones
            best, at = np.where(better, other, best), np.where(better, np.arange(k, k + windows), at)
        of = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
        whole = np.flatnonzero(of[:windows] == of[LENGTH - 1 :])
        new = np.flatnonzero(np.diff(at[whole], prepend=-1))
        first, count = whole[new], np.diff(np.r_[new, len(whole)])
        return gram[at[first]], self.runs(first, count + LENGTH - 1), first - edges[of[first]], count, of[first]


#: Kinds of rows: an anchor dealt out by itself, a frequent one dealt out by context, a settled one.
_SEED, _FREQUENT, _SETTLED = 0, 1, 2
_DEALT = "key long, context long, doc_id long, place long"
_MET = "doc_id long, start int, windows int, check int, settled boolean"


def _check(digest: np.ndarray) -> np.ndarray:
    """31 bits of a run's digest: a span is only applied to the text that it came from."""
    return (digest & np.uint64(0x7FFFFFFF)).astype(np.int32)


def _first_holders(key: np.ndarray, context: np.ndarray, doc: np.ndarray, start: np.ndarray, windows: np.ndarray, frequent: np.ndarray):
    """Rows of ``_DEALT``. Within them, all but the first document of a context are settled."""
    order = np.lexsort((doc, context, key))
    a, c, d, s, m = (x[order] for x in (key, context, doc, start, windows))
    new = np.r_[True, (a[1:] != a[:-1]) | (c[1:] != c[:-1])]
    settled = d > d[np.flatnonzero(new)][np.cumsum(new) - 1]
    hot = np.isin(a, frequent)
    to = np.where(settled, _mix(d.astype(np.uint64) + s.astype(np.uint64)), np.where(hot, _mix(a ^ c), a))
    kind = np.where(settled, _SETTLED, np.where(hot, _FREQUENT, _SEED))
    return pd.DataFrame({"key": to.view(np.int64), "context": c.view(np.int64), "doc_id": d, "place": s << 8 | m << 3 | kind})


def _meet(dealt: DataFrame) -> DataFrame:
    """Rows of ``_DEALT`` -> ``_MET``: settled runs, and runs that need a look window by window."""

    schema = to_arrow_schema(T.StructType.fromDDL(_MET))

    def run(batches: Iterator) -> Iterator:
        for pdf in sorted_groups(_gathered_rows(batches), ["key"]):
            key, c, d, place = (pdf[x].to_numpy() for x in ("key", "context", "doc_id", "place"))
            kind = place & 7
            group = np.r_[True, (key[1:] != key[:-1]) | ((kind[1:] == _SETTLED) != (kind[:-1] == _SETTLED))]
            new = group | np.r_[True, c[1:] != c[:-1]]
            settled = (kind == _SETTLED) | (d > d[np.flatnonzero(new)][np.cumsum(new) - 1])
            g = np.cumsum(group) - 1
            many = np.bincount(g, weights=new)[g] > 1
            keep = settled | many | (kind == _FREQUENT)
            place = place[keep]
            columns = [d[keep], (place >> 8).astype(np.int32), (place >> 3 & 31).astype(np.int32), _check(c[keep].view(np.uint64)), settled[keep]]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), schema=schema)

    n = n_partitions(dealt.sparkSession)
    by = ["key", F.col("place").bitwiseAND(2), "context", "doc_id"]  # settled rows apart
    return dealt.repartition(n, "key").sortWithinPartitions(*by).mapInArrow(tidied(run), _MET)


def _gathered_rows(batches: Iterator) -> Iterator:
    """Batches, which are small for the sake of texts, as frames of _AT_ONCE rows or somewhat more."""
    held: list = []
    n = 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= _AT_ONCE:
            yield pa.Table.from_batches(held).to_pandas()
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).to_pandas()


def _gathered(parts: list[tuple]) -> Iterator:
    """Columns of per-document pieces, joined."""
    return (np.concatenate(x) for x in zip(*parts, strict=True))


def _frequent(docs: DataFrame) -> np.ndarray:
    """Anchors in a good share of a bounded sample of documents; a hint for dealing only."""
    ids = [r[0] for r in docs.select("doc_id").where("doc_id is not null").orderBy(F.xxhash64("doc_id")).limit(SAMPLE_DOCS).collect()]
    if not ids:
        return np.zeros(0, dtype=np.uint64)

    def run(batches: Iterator) -> Iterator:
        for pdf in batches:
            for raw in pdf["text"]:
                t = Text(raw or b"")
                if t.n >= LENGTH:
                    yield pd.DataFrame({"anchor": np.unique(t.anchors(np.array([0, t.n]))[0]).view(np.int64)})

    found = map_slices(docs.where(F.col("doc_id").isin(ids)).select(F.col("text").cast("binary").alias("text")), run, "anchor long").groupBy("anchor").count()
    rows = found.where(F.col("count") > max(3, FREQUENT * len(ids))).orderBy(F.desc("count"), "anchor").limit(20_000).collect()
    return np.array([r[0] for r in rows], dtype=np.int64).view(np.uint64)


def _seeds(texts: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(doc_id, text) -> an anchor row each, as ``_DEALT``. Texts are read laid end to end."""

    def run(batches: Iterator) -> Iterator:
        parts: list[tuple] = []
        rows = 0
        for pdf in batches:
            for docs, raws in _laid(pdf["doc_id"].to_numpy(), pdf["text"].tolist()):
                t = Text(b" ".join(raws))
                ends = np.cumsum([len(r) + 1 for r in raws])
                a, c, s, m, of = t.anchors(np.r_[0, np.searchsorted(t.starts, ends)])
                parts.append((a, c, docs[of], s, m))
                rows += len(a)
                if rows > _ROWS:
                    yield _first_holders(*_gathered(parts), frequent)
                    parts, rows = [], 0
        if rows:
            yield _first_holders(*_gathered(parts), frequent)

    return map_slices(texts.select("doc_id", F.col("text").cast("binary").alias("text")), run, _DEALT)


def _laid(docs: np.ndarray, raws: list[bytes]) -> Iterator:
    """Documents in runs of about ``_PIECE`` bytes; a longer text has its own."""
    low = size = 0
    for i, raw in enumerate(raws):
        if size and size + len(raw) > _PIECE:
            yield docs[low:i], raws[low:i]
            low, size = i, 0
        size += len(raw) + 1
    if low < len(raws):
        yield docs[low:], raws[low:]


def _windows(rows: DataFrame) -> DataFrame:
    """(doc_id, packed text, spans to look at) -> a row for each of their windows, as ``_DEALT``."""

    def run(batches: Iterator) -> Iterator:
        parts: list[tuple] = []
        n = 0
        for pdf in batches:
            for d, packed, spans in zip(pdf["doc_id"].tolist(), pdf["packed"], pdf["spans"], strict=True):
                if spans is None or not len(spans):
                    continue
                t = Text(_unpack(packed))
                s, m = _valid(t, spans)
                if len(s):
                    at = np.unique(np.repeat(s, m) + _count_up(m))
                    w = t.runs(at, LENGTH)
                    parts.append((w, w, np.full(len(at), d, dtype=np.int64), at, np.ones(len(at), dtype=np.int64)))
                    n += len(at)
                    if n > _ROWS:
                        yield _first_holders(*_gathered(parts), np.zeros(0, dtype=np.uint64))
                        parts, n = [], 0
        if parts:
            yield _first_holders(*_gathered(parts), np.zeros(0, dtype=np.uint64))

    return map_slices(rows.select("doc_id", "packed", "spans"), run, _DEALT)


def _count_up(m: np.ndarray) -> np.ndarray:
    """0..m[0]-1, 0..m[1]-1, ..."""
    return np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)


def _valid(t: Text, spans) -> tuple[np.ndarray, np.ndarray]:
    """Starts and windows of the spans that fit this text: a repeated doc_id may bring others."""
    if spans is None or not len(spans):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    x = np.asarray(spans, dtype=np.int64).reshape(-1, 3)
    s, m, k = x[x[:, 0] + x[:, 1] + LENGTH - 1 <= t.n].T
    ok = _check(t.runs(s, m + LENGTH - 1)) == k
    return s[ok], m[ok]


def _pack(text: str | None) -> bytes | None:
    return None if text is None else zstandard.ZstdCompressor(level=3).compress(text.encode("utf-8", "surrogatepass"))


def _unpack(packed: bytes | None) -> bytes:
    return b"" if packed is None else zstandard.ZstdDecompressor().decompress(packed)


def _packed(docs: DataFrame) -> DataFrame:
    """docs with ``packed``, texts under zstandard, in place of text: a third of the bytes to shuffle."""
    at = docs.columns.index("text")
    schema = T.StructType([T.StructField("packed", T.BinaryType()) if i == at else f for i, f in enumerate(docs.schema)])

    def run(batches: Iterator) -> Iterator:
        for b in batches:
            out: list = []
            for i in range(0, b.num_rows, SLICE):
                out += [_pack(t) for t in b.column(at).slice(i, SLICE).to_pylist()]
            columns = [pa.array(out, pa.binary()) if i == at else c for i, c in enumerate(b.columns)]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    small_batches(docs.sparkSession)
    return docs.mapInArrow(tidied(run), schema)


def _resolved(docs: DataFrame) -> DataFrame:
    """docs with ``packed`` in place of text, and ``spans``: start, windows and check of each run to remove in turn, or null; without rows of a null doc_id."""
    n = n_partitions(docs.sparkSession)
    known = docs.where("doc_id is not null")
    met = _meet(_seeds(known.where("text is not null").select(F.col("doc_id").cast("long"), "text"), _frequent(known)))
    met = Scratch(docs.sparkSession, "substring").write(met)
    texts = _packed(known).repartition(n, "doc_id")  # planned twice, shuffled once
    span = F.flatten(F.collect_list(F.array("start", "windows", "check"))).alias("spans")
    look = met.where("not settled").groupBy("doc_id").agg(span)
    late = _meet(_windows(texts.join(look, "doc_id", "left"))).where("settled")
    return texts.join(met.where("settled").union(late).groupBy("doc_id").agg(span), "doc_id", "left")


def _removed(t: Text, spans) -> np.ndarray:
    """Mask of the words that the spans cover."""
    edge = np.zeros(t.n + 1, dtype=np.int64)
    s, m = _valid(t, spans)
    np.add.at(edge, s, 1)
    np.add.at(edge, s + m + LENGTH - 1, -1)
    return np.cumsum(edge[:-1]) > 0


def substring_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each row of docs.

    A word goes if a window of 13 consecutive words over it also starts in a document of
    smaller doc_id, judged on the input. Null or empty text: no words, the digest of an
    empty string. Rows with a null doc_id, and repeated rows among themselves, lose nothing
    to each other. Texts of any length are read whole; an empty table gives none. Columns other
    than doc_id and text are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    found = _resolved(docs).select("doc_id", "packed", "spans")
    alone = docs.where("doc_id is null").select("doc_id", F.col("text").cast("binary"), F.lit(None).cast(found.schema["spans"].dataType).alias("spans"))

    def counted(read: Callable[[bytes | None], bytes]) -> Callable[[Iterator], Iterator]:
        def run(batches: Iterator) -> Iterator:
            for pdf in batches:
                out = []
                for given, spans in zip(pdf.iloc[:, 1], pdf["spans"], strict=True):
                    raw = read(given)
                    words = kept = raw.split()
                    if spans is not None and len(spans):
                        gone = _removed(Text(raw), spans)
                        kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                    out.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
                yield pd.DataFrame(out, columns=["n_words", "n_removed", "kept_sha256"]).assign(doc_id=pdf["doc_id"].to_numpy())

        return run

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    return map_slices(found, counted(_unpack), schema).union(map_slices(alone, counted(lambda text: text or b""), schema))


def cut_passages(text: str, gone: list[bool]) -> str:
    """The text without the words marked, with the white space that stood before each other word."""
    out, end = [], 0
    for m, g in zip(_WORD.finditer(text), gone, strict=True):
        if not g:
            out.append(text[end : m.end()])
        end = m.end()
    return "".join(out).strip()


def _cut(raw: bytes | None, spans) -> str | None:
    if raw is None:
        return None
    raw = _unpack(raw)
    text = raw.decode("utf-8", "surrogatepass")
    return text if spans is None or not len(spans) else cut_passages(text, _removed(Text(raw), spans).tolist())


def substring_dedup(docs: DataFrame) -> DataFrame:
    """docs with later copies of passages cut out of the text; n_chars follows where present.

    Documents of which nothing is left are dropped; all other rows and columns stay: null
    texts and those without words, which have nothing to lose, and rows with a null doc_id.
    Repeated rows lose nothing to each other. Texts of any length are read whole; an empty
    table gives none.
    """
    names, schema = docs.columns, docs.schema
    counted = names.index("n_chars") if "n_chars" in names else -1
    inner = [c if c in ("doc_id", "text") else f"c{i}" for i, c in enumerate(names)]  # columns of any name pass
    docs = docs.toDF(*inner)
    rows = _resolved(docs)
    rows = rows.select(*("packed" if c == "text" else c for c in inner), "spans")

    def run(batches: Iterator) -> Iterator:
        at, kinds = names.index("text"), to_arrow_schema(schema)
        for b in batches:
            texts, sizes = [], []
            for i in range(0, b.num_rows, SLICE):
                part = b.slice(i, SLICE)
                spans = part.column(b.num_columns - 1).to_pylist()
                found = [_cut(r, s) for r, s in zip(part.column(at).to_pylist(), spans, strict=True)]
                old = part.column(counted).to_pylist() if counted >= 0 else [None] * len(found)
                sizes += [n if s is None else len(t or "") for t, s, n in zip(found, spans, old, strict=True)]
                texts += [None if s is not None and not t else t for t, s in zip(found, spans, strict=True)]
            columns = list(b.columns[:-1])
            columns[at] = pa.array(texts, kinds.field(at).type)
            if counted >= 0:
                columns[counted] = pa.array(sizes, kinds.field(counted).type)
            out = pa.RecordBatch.from_arrays(columns, names)
            gone = pa.compute.and_(b.column(b.num_columns - 1).is_valid(), columns[at].is_null())
            yield out.filter(pa.compute.invert(gone))

    return rows.mapInArrow(tidied(run), schema).union(docs.where("doc_id is null"))
