"""Cost-balanced packing of tokenised documents into sequences.

A sequence's cost is estimated as a linear part (tokens) plus a quadratic one (attention
within each document's piece). Documents are taken from the longest down, each to the
sequence of lowest cost that has token capacity left; where only part of it fits, the rest
goes on to the next. Sequences are so many that they are all filled; what a bin leaves
over is laid in sequences of powers of two, which need no padding.

One pass: each task tokenises its own rows and packs them in bins of ``BIN_TOKENS`` tokens,
so memory is bounded by a bin and one document, and nothing is shuffled. A rerun of a task
over the same rows gives the same sequences.
"""

from __future__ import annotations

import heapq
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, tidied

LENGTH = 2048
END = 1
BIN_TOKENS = 2_000_000
#: Words whose ids a worker holds at most, and those of them that outlast a task. A bin's rare
#: words alone are some hundred thousand; a worker that can't hold them encodes common ones anew.
WORDS, KEPT = 600_000, 200_000
#: Relative cost of a token, and of a pair of tokens that attend to each other.
LINEAR, QUADRATIC = 1.0, 1.0 / LENGTH
_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, row_id long"
_TASK = 40
#: Sequences of a frame that goes back to the JVM: arrays of ids are large.
FRAME = 64


class Encoder(dict):
    """White-space separated word -> its ids as little-endian 32-bit integers.

    The vocabulary drops white space and never joins across it, so a text's ids are those of
    its words in turn. Words seen are kept, up to a bound; beyond it those seen first stay,
    since the frequent ones are among them. New ones made of Latin letters, with or without
    punctuation behind, go straight to the vocabulary's merges, all others through the whole
    tokenizer.
    """

    def __init__(self, path: str, bound: int = WORDS):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.bound = Tokenizer.from_file(path), bound
        self.merges, self.marks = self.tokenizer.model.tokenize, {b"": b""}
        # the byte-level alphabet: printable bytes stand for themselves, others follow from 256 on
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
        others = [b for b in range(256) if b not in plain]
        self.alphabet = {b: 256 + i for i, b in enumerate(others)}

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= self.bound:
            self.trim()
        x = self[word] = self._encode(word)
        return x

    def trim(self) -> None:
        """Only the words seen first stay, KEPT or half the bound."""
        first = list(islice(self.items(), min(KEPT, self.bound // 2)))
        self.clear()
        self.update(first)

    def _encode(self, word: bytes) -> bytes:
        core = word.rstrip(b".,!?;:")
        mark = word[len(core) :]
        if core.isalpha():  # ASCII letters
            text = core.lower().decode()
        else:
            text = core.decode("utf-8", "replace")
            if not text.isalpha() or max(text) > "\u012f":
                return self._whole(word)
            text = text.lower().encode().decode("latin-1").translate(self.alphabet)
        if mark not in self.marks:
            if len(self.marks) > 10_000:
                self.marks = {b"": b""}
            self.marks[mark] = self._whole(mark)
        return array("I", [t.id for t in self.merges(text)]).tobytes() + self.marks[mark]

    def _whole(self, text: bytes) -> bytes:
        return np.array(self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, dtype="<u4").tobytes()

    def document(self, text: str | None) -> bytes:
        words = (text or "").encode("utf-8", "surrogatepass").split()
        return b"".join([*map(self.__getitem__, words), _END])


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """A worker keeps the vocabulary from one task to the next, and the words it saw first."""
    return Encoder(path)


_END = np.array([END], dtype="<u4").tobytes()


def plan(sizes: list[int], length: int = LENGTH) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Pieces (document, start, length, sequence, offset) of documents of these sizes, and the number of sequences.

    Every token lies in one piece; sequences hold length tokens, or a power of two.
    """
    pieces: list[tuple[int, int, int, int, int]] = []
    sequences = 0
    todo: list[tuple[int, int, int]] = []  # size left, document, start
    for i, n in enumerate(sizes):
        for at in range(0, n - length + 1, length):
            pieces.append((i, at, length, sequences, 0))
            sequences += 1
        if n % length:
            todo.append((n % length, i, n - n % length))
    todo.sort(key=lambda x: (-x[0], x[1]))
    total = sum(x[0] for x in todo)
    rooms = [length] * (total // length)
    rest = total % length
    tail = [1 << b for b in range(length.bit_length(), -1, -1) if rest >> b & 1]
    heap = [(0.0, s) for s in range(len(rooms))]
    rooms += tail
    spare = list(range(len(rooms) - len(tail), len(rooms)))[::-1]
    used = [0] * len(rooms)
    for left, doc, start in todo:
        while left:
            cost, s = heapq.heappop(heap) if heap else (0.0, spare.pop())
            n = min(left, rooms[s] - used[s])
            pieces.append((doc, start, n, sequences + s, used[s]))
            used[s] += n
            start, left = start + n, left - n
            if used[s] < rooms[s]:
                heapq.heappush(heap, (cost + LINEAR * n + QUADRATIC * n * n, s))
    return pieces, sequences + len(rooms)


def pack(docs: DataFrame, tokenizer_path: str, length: int = LENGTH) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, row_id.

    A document is its text's ids and the end id; null or empty text is the end id alone. Very
    long texts span sequences. Documents of equal length are taken in the order they are read.
    Repeated rows are packed as documents of their own, and row_id, a number of the input row,
    tells their pieces apart; an empty table gives none. Numbers of sequences and rows follow
    the tasks that read them: a repeated task gives the same, another dealing of rows others.
    Columns other than doc_id and text are ignored.
    """

    return _binned(docs, tokenizer_path, length, _packed, _SCHEMA)


def _binned(docs: DataFrame, tokenizer_path: str, length: int, lay, schema: str) -> DataFrame:
    """lay's frames for each bin of a task's rows: (row_id, doc_id, ids) triples, first sequence, length.

    lay gives an iterator of frames and the number of sequences.
    """

    def run(batches: Iterator) -> Iterator:
        words = encoder(tokenizer_path)
        first = row = TaskContext.get().partitionId() << _TASK
        held: list[tuple] = []
        tokens = 0
        for pdf in batches:
            for d, text in zip(pdf["doc_id"].array, pdf["text"], strict=True):
                ids = words.document(text)
                held.append((row, d, ids))
                row += 1
                tokens += len(ids) // 4
                if tokens >= BIN_TOKENS:
                    frames, n = lay(held, first, length)
                    yield from frames
                    first, held, tokens = first + n, [], 0
        if held:
            yield from lay(held, first, length)[0]
        words.trim()  # idle workers stay around, and any of them may have had a task
        held = []

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(tidied(run), schema)


def _packed(held: list[tuple], first: int, length: int) -> tuple[Iterator[pd.DataFrame], int]:
    pieces, n = plan([len(ids) // 4 for _, _, ids in held], length)
    rows = [(held[i][1], at, m, zlib.crc32(memoryview(held[i][2])[4 * at : 4 * (at + m)]), len(held[i][2]) // 4, first + s, o, held[i][0]) for i, at, m, s, o in pieces]
    out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "row_id"])
    return iter([out.astype({"doc_id": "Int64"})]), n


def sequences(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, pad: int = 0) -> DataFrame:
    """Packed training rows: sequence_id, ids (padded to length, but for powers of two), segments,
    and of each piece in turn doc_ids, row_ids and starts.

    segments numbers the pieces from 1 along the sequence, 0 for padding. Rows are treated as
    ``pack`` treats them.
    """

    def lay(held: list[tuple], first: int, length: int) -> tuple[Iterator[pd.DataFrame], int]:
        return _laid(held, first, length, pad)

    return _binned(docs, tokenizer_path, length, lay, "sequence_id long, ids array<int>, segments array<int>, doc_ids array<long>, row_ids array<long>, starts array<long>")


def _laid(held: list[tuple], first: int, length: int, pad: int) -> tuple[Iterator[pd.DataFrame], int]:
    pieces, n = plan([len(ids) // 4 for _, _, ids in held], length)
    by: list[list] = [[] for _ in range(n)]
    for i, at, m, s, o in pieces:
        by[s].append((o, i, at, m))
    return (_rows(held, by[k : k + FRAME], first + k, length, pad) for k in range(0, n, FRAME)), n


def _rows(held: list[tuple], by: list[list], first: int, length: int, pad: int) -> pd.DataFrame:
    """Sequences numbered from first on; by: the pieces of each (offset, place in held, start, length)."""
    out: dict[str, list] = {k: [] for k in ("ids", "segments", "doc_ids", "row_ids", "starts")}
    for own in by:
        own.sort()
        row = np.concatenate([np.frombuffer(held[i][2], dtype="<i4", count=m, offset=4 * at) for _, i, at, m in own])
        seg = np.repeat(np.arange(1, len(own) + 1, dtype=np.int32), [m for *_, m in own])
        lack = 0 if len(row) & (len(row) - 1) == 0 else length - len(row)
        out["ids"].append(np.pad(row, (0, lack), constant_values=pad))
        out["segments"].append(np.pad(seg, (0, lack)))
        out["doc_ids"].append([None if pd.isna(held[i][1]) else int(held[i][1]) for _, i, _, _ in own])
        out["row_ids"].append([held[i][0] for _, i, _, _ in own])
        out["starts"].append([at for _, _, at, _ in own])
    return pd.DataFrame({"sequence_id": np.arange(first, first + len(by)), **out})
