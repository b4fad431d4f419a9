"""Language identification by compression.

Every language has a raw-content zstandard dictionary, made of excerpts of a bounded sample
of its texts: of about ``SAMPLE`` documents a stretch of ``EXCERPT`` bytes each, from a place
that a hash chooses, up to ``DICTIONARY`` bytes. With many languages all dictionaries shrink
so that together they stay within ``BUDGET``; none is left out. A whole text is put into
plain words and compressed under each dictionary; the smallest result names the language. A
quick setting decides where the margin is wide; a narrow margin is rejected there and settled
by a thorough one. What stays narrow is marked as not confident.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_slices
from .folds import fold, held_out, sampled

#: Bytes of a dictionary; documents of a language and bytes of each that make it, at most.
DICTIONARY, SAMPLE, EXCERPT = 256_000, 800, 1_000
#: Bytes of all dictionaries together, about.
BUDGET = 32_000_000
#: Relative margin under which the quick result is rejected, and under which none is confident.
QUICK_MARGIN, MARGIN = 0.05, 0.01
PIECE = 1 << 15
UNKNOWN = "und"
#: Runs of letters, and of numerals such as a superscript two or a half, which ``plain`` takes out.
_LETTERS = re.compile(r"[^\W\d_]+")


def plain(text: str | None) -> bytes:
    """Lower-cased words of letters, joined by spaces."""
    if not text:
        return b""
    words = _LETTERS.findall(text.lower())
    if words and not "".join(words).isalpha():
        words = "".join(c if c.isalpha() else " " for c in " ".join(words)).split()
    return " ".join(words).encode("utf-8", "replace")


def _excerpt(text: bytes, at: int) -> bytes:
    """A bounded stretch from a place that the hash at chooses."""
    if len(text) <= EXCERPT:
        return text
    start = at % (len(text) - EXCERPT)
    return text[start : start + EXCERPT].decode("utf-8", "ignore").encode()


def learn(docs: DataFrame) -> dict[str, bytes]:
    """language -> dictionary, of every language of rows outside fold 0; driver memory is bounded
    by BUDGET and one word of overlap a language."""
    known = docs.where("lang is not null and text is not null and doc_id is not null").where(fold() != 0)
    ids = sampled(known.select("doc_id", "lang").distinct(), "lang", SAMPLE)
    rows = known.select("doc_id", "text", "lang").join(F.broadcast(ids), ["doc_id", "lang"])  # about SAMPLE ids a language

    def run(batches: Iterator) -> Iterator:
        for pdf in batches:
            cut = [_excerpt(plain(t), h & 0x7FFFFFFF) for t, h in zip(pdf["text"], pdf["h"], strict=True)]
            yield pd.DataFrame({"lang": pdf["lang"], "h": pdf["h"], "cut": cut})

    cuts = rows.select("lang", "text", F.xxhash64("doc_id").alias("h")).mapInPandas(run, "lang string, h long, cut binary")
    langs = ids.select("lang").distinct().count()
    room = min(DICTIONARY, max(1, BUDGET // max(1, langs)))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        held, size = {}, 0
        for cut in map(bytes, pdf.sort_values(["h", "cut"])["cut"]):
            if size >= room:
                break
            if cut not in held:
                held[cut], size = None, size + len(cut) + 1
        return pd.DataFrame({"lang": pdf["lang"].iloc[:1], "raw": [b"".join(c + b" " for c in held)[-room:]]})

    return {r["lang"]: bytes(r["raw"]) for r in cuts.groupBy("lang").applyInPandas(fill, "lang string, raw binary").collect()}


@dataclass
class Classifier:
    dictionaries: dict[str, bytes]
    quick: list = field(default_factory=list)
    thorough: list = field(default_factory=list)

    def __post_init__(self) -> None:
        self.names = sorted(self.dictionaries)
        frame = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
        slow = zstandard.ZstdCompressionParameters(window_log=20, hash_log=18, chain_log=18, search_log=5, min_match=4, target_length=32, strategy=zstandard.STRATEGY_BTLAZY2, **frame)
        for name in self.names:
            raw = self.dictionaries[name]
            self.quick.append(zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT), **frame))
            held = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(compression_params=slow)
            self.thorough.append(zstandard.ZstdCompressor(compression_params=slow, dict_data=held))

    @staticmethod
    def _sizes(text: bytes, by: list) -> np.ndarray:
        pieces = [text[i : i + PIECE] for i in range(0, len(text), PIECE)]
        return np.array([sum(len(c.compress(p)) for p in pieces) for c in by], dtype=np.float64)

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, confident)."""
        raw = plain(text)
        if not raw or not self.names:
            return UNKNOWN, 0.0, False
        if len(self.names) == 1:
            return self.names[0], 1.0, True
        sizes = self._sizes(raw, self.quick)
        if self._margin(sizes) < QUICK_MARGIN:
            sizes = self._sizes(raw, self.thorough)
        best = int(np.argmin(sizes))
        away = np.exp(-np.minimum(50.0, (sizes - sizes[best]) * (math.log(256) / 16)))
        return self.names[best], float(1 / away.sum()), self._margin(sizes) >= MARGIN

    @staticmethod
    def _margin(sizes: np.ndarray) -> float:
        one, two = np.partition(sizes, 1)[:2]
        return float((two - one) / two)


def language_report(docs: DataFrame, reject: bool = False) -> DataFrame:
    """doc_id, held_out, lang_pred, score, confident for each row of docs.

    lang_pred: a learned language; ``und`` if the text is null or has no letter, and, with
    reject, where the margin stays narrow. Of equal sizes the first language by code point is
    chosen. score: 0 to 1, the chosen language's share. Without a learned language everything is
    ``und``. Very long texts are compressed whole, in pieces. Repeated rows each give a row; an
    empty table gives none. Columns other than doc_id, text and lang are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(learn(docs))

    def run(batches: Iterator) -> Iterator:
        classify = Classifier(held.value)
        for pdf in batches:
            found = [classify(t) for t in pdf["text"]]
            out = pd.DataFrame(found, columns=["lang_pred", "score", "confident"])
            if reject:
                out.loc[~out["confident"], "lang_pred"] = UNKNOWN
            yield out.assign(doc_id=pdf["doc_id"].to_numpy(), held_out=pdf["held_out"].to_numpy())

    return map_slices(docs.select(F.col("doc_id").cast("long"), held_out(), "text"), run, "doc_id long, held_out boolean, lang_pred string, score double, confident boolean")
