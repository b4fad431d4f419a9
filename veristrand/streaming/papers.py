"""New documents as a stream: each file goes through the batch once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from ..plans.batch import Tables, run_batch
from ..session import cut_lineage
from ..sources.files import DONE
from ..sources.generator import Generator
from ..sources.tables import Table, update

_FILES = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])


def new_files(spark: SparkSession, root: str, pattern: str = "*.txt", per_trigger: int = 1000) -> DataFrame:
    """path, modificationTime, length, content of matching files below root, as they appear; done ones are left out."""
    files = spark.readStream.schema(_FILES).format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_trigger).load(root)
    return files.where(~F.col("path").rlike(rf"(^|/){DONE}/"))


def paper_stream(tables: Tables, root: str, generator: Generator, clock: Callable[[], float], checkpoint: str, pattern: str = "*.txt", per_trigger: int = 1000, told: Callable[[DataFrame], None] | None = None, **options) -> DataStreamWriter:
    """A writer that hands new files to ``run_batch``, a micro-batch at a time; start it with the trigger wanted.

    The checkpoint remembers which files were handed over, also after a restart. A micro-batch
    that is run again finds its complete papers done, so a paper is stored once. told gets the
    statuses of each.
    """

    def each(files: DataFrame, _: int) -> None:
        found = cut_lineage(files.select("path", "content"))
        statuses = run_batch(tables, root, generator, clock, pattern=pattern, found=found, **options)
        if told:
            told(statuses)

    return new_files(tables.spark, root, pattern, per_trigger).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)


def synced(rows: DataFrame, table: Table, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> DataStreamWriter:
    """A writer that merges a stream of rows into a table: merge(own rows of the keys, new rows) -> next rows, written as a delta."""

    def each(batch: DataFrame, _: int) -> None:
        new = cut_lineage(batch)
        if not new.isEmpty():
            update([table], lambda version: [merge(table.rows_of(new, version), new)])

    return rows.writeStream.foreachBatch(each)
