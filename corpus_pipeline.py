"""The corpus pipeline: documents from toxicity filter to packed sequences.

Each stage works on what its predecessor kept, read back from Parquet. All stages take any
further columns, whatever their names, and empty tables, which give empty ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veristrand.llm import mixing, near_dedup, packing, substring_dedup, toxicity
from veristrand.llm.common import Scratch, table
from veristrand.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models reject go. Models learn from ``labels`` and from docs;
    without labels of both classes nothing goes. Null and empty texts are scored as having no
    evidence; repeated rows and rows with null ids are judged one by one."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, Jaccard of 0.8 at least, verified.

    Candidates are linked by SimHash fingerprints within three bits (pivot distance tables, as
    in operator 5), and by MinHash bands where a pair at 0.8 differs in more bits than that. The smallest doc_id stays; of rows equal in id and text one. Texts without words (null,
    empty) are copies of each other. Rows with a null doc_id stay: they can't name a group.
    """
    return near_dedup.near_dedup(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document holds are cut out; a text without any stays as it is, and
    one without a word left goes. Texts of any length are read whole."""
    return substring_dedup.substring_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, up to three times, the last pass cut where it ends.
    Documents without words are never taken; a null source is a source."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens: ids and segments, and doc_ids, row_ids and starts of their pieces.
    row_ids tell the passes of one document apart."""
    return packing.sequences(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: SQL can't express the model, the fingerprints or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Every stage's result is a table in the shared folder."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    written = None
    for _, stage in STAGES:
        since = Scratch.made()
        out = scratch.write(stage(spark, docs, sf_dir))
        Scratch.sweep(since)
        if written is not None:
            scratch.drop(written)
        docs = written = out
    return docs
