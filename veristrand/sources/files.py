"""Documents as files in a folder tree."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Folder of files that are done with.
DONE = "_processed"


def list_files(spark: SparkSession, root: str, pattern: str = "*.pdf") -> DataFrame:
    """path, modificationTime, length, content of matching files below root, but for done ones.

    Content is read only by plans that use it, so listings and path joins stay cheap.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return files.where(~F.col("path").rlike(rf"(^|/){DONE}/"))


def content_hash(content: str = "content") -> Column:
    """Identity of a document: the full SHA-256 of its bytes."""
    return F.sha2(content, 256)


def find_one(files: DataFrame, name: str) -> str:
    """The path of the file of this name or path; an error lists up to ten where it is not one."""
    hits = files.where((F.col("path") == name) | F.col("path").endswith("/" + name)).select("path").orderBy("path").limit(11).collect()
    if len(hits) != 1:
        raise ValueError(f"{name!r} names {len(hits) or 'no'} file(s): " + ", ".join(h[0] for h in hits[:10]))
    return hits[0][0]


def unique_papers(files: DataFrame) -> DataFrame:
    """paper_hash, path: the same bytes are the same paper, under its first path."""
    return files.select(content_hash().alias("paper_hash"), "path").groupBy("paper_hash").agg(F.min("path").alias("path"))


def page_counter(count) -> Column:
    """Pages by a function of a file's bytes; whatever fails counts 0."""
    def safe(raw) -> int:
        try:
            return int(count(bytes(raw)))
        except Exception:  # any broken file
            return 0

    @F.pandas_udf(T.IntegerType())
    def pages(content: pd.Series) -> pd.Series:
        return content.map(safe).astype("int32")

    return pages("content")
