"""The boundary to a page reader (OCR)."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_image(image: Column, reader: Callable[[bytes], str]) -> Column:
    """Text of page images by a reader on the executors; whatever fails reads as empty."""

    def safe(raw) -> str:
        try:
            return reader(bytes(raw)) if raw is not None else ""
        except Exception:  # a page that can't be read is an empty one
            return ""

    @F.pandas_udf(T.StringType())
    def text(raw: pd.Series) -> pd.Series:
        return raw.map(safe)

    return text(image)


def language_files(spark: SparkSession, folder: str) -> DataFrame:
    """One row with files, what ``functions.text.language_fingerprint`` reads: language data below a folder by code; null without the folder."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.range(1).select(F.lit(None).cast("map<string,string>").alias("files"))
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.traineddata").load(folder)
    code = F.regexp_extract("path", r"([^/]+)\.traineddata$", 1)
    told = F.format_string("%d:%d000", "length", F.unix_micros("modificationTime"))
    return found.agg(F.map_from_entries(F.collect_list(F.struct(code, told))).alias("files"))
