"""Helpers that the corpus operators share: table reading, shared storage, word splitting."""

from __future__ import annotations

import ctypes
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: White space between words, in every operator of this subpackage.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where it is unset (tests in local mode) a temporary folder is made and set.
    """
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if at is None:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="veristrand-"))
        at = sc.getCheckpointDir()
    return at


_made = threading.local()


class Scratch:
    """Intermediate tables of one query in the shared folder.

    A written table cuts the lineage and survives the loss of any executor.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        _made.__dict__.setdefault("all", []).append(self)

    @staticmethod
    def sweep(since: int) -> None:
        """Delete the tables of scratches made in this thread since there were so many: what they served is written."""
        for s in _made.all[since:]:
            s.clear()
        del _made.all[since:]

    @staticmethod
    def made() -> int:
        return len(_made.__dict__.setdefault("all", []))

    def write(self, df: DataFrame) -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table that no later step reads."""
        self._delete(df.scratch_path)

    def clear(self) -> None:
        """Delete all tables, once what was learned of them is in the driver."""
        self._delete(self.root)

    def _delete(self, at: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def words_of(text: str | None, lower: bool = False) -> list[bytes]:
    """The words of a text as UTF-8; ``bytes.split`` cuts at exactly 0x20 and 0x09-0x0D.

    lower: A-Z become a-z, as ``bytes.lower`` does; other letters stay.
    """
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    return (raw.lower() if lower else raw).split()


def plain_names(docs: DataFrame, *keep: str) -> tuple[DataFrame, list[str]]:
    """docs with its columns named c0, c1, ..., but for those to keep, so that no name clashes with added ones; and the names."""
    names = [c if c in keep else f"c{i}" for i, c in enumerate(docs.columns)]
    return docs.toDF(*names), names


def one_of_each(rows: DataFrame, key: list[str], names: list[str]) -> DataFrame:
    """The first of rows with equal key, by the other columns' values as JSON: no matter how rows are dealt."""
    others = [F.col(c) for c in names if c != "text"]
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(F.to_json(F.struct(*others))))
    return rows.withColumn("nth", nth).where("nth = 1").drop("nth")


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def min_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable index of each of n nodes under the undirected links (a[i], b[i])."""
    lab = np.arange(n)
    while True:
        low = np.minimum(lab[a], lab[b])
        new = lab.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, lab[a], low)
        np.minimum.at(new, lab[b], low)
        new = new[new]
        if np.array_equal(new, lab):
            return lab
        lab = new


def sorted_groups(batches: Iterator, keys: list[str]) -> Iterator:
    """Regroup key-sorted pandas batches so that no key is cut between two of them."""
    import pandas as pd

    held: list = []
    for pdf in batches:
        if not len(pdf):
            continue
        cols = [pdf[k].to_numpy() for k in keys]
        last = np.ones(len(pdf), dtype=bool)
        for c in cols:
            last &= c == c[-1]
        cut = len(pdf) - int(np.argmin(last[::-1])) if not last.all() else 0
        if cut == 0:
            same = held and all(held[-1][k].iloc[-1] == c[0] for k, c in zip(keys, cols, strict=True))
            if held and not same:
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            held.append(pdf)
        else:
            held.append(pdf.iloc[:cut])
            yield pd.concat(held) if len(held) > 1 else held[0]
            held = [pdf.iloc[cut:]]
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


#: Rows of texts that a Python worker holds as objects at a time, and rows of an Arrow batch.
SLICE, BATCH = 256, 1000


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH rows: texts have no bounded length, and a
    batch lies in memory on both sides of the pipe."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH:
        spark.conf.set(key, str(BATCH))


def tidied(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """f, after whose last batch the worker gives freed memory back; idle workers stay around."""

    def run(batches: Iterator) -> Iterator:
        yield from f(batches)
        give_back()

    return run


def give_back() -> None:
    """Freed memory of this worker goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def map_slices(df: DataFrame, f: Callable[[Iterator], Iterator], schema: T.StructType | str) -> DataFrame:
    """Like ``mapInPandas``, but f meets small frames: a worker's memory doesn't follow the batch size."""
    small_batches(df.sparkSession)
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator) -> Iterator:
        for out in f(b.slice(i, SLICE).to_pandas() for b in batches for i in range(0, b.num_rows, SLICE)):
            yield pa.RecordBatch.from_pandas(out, schema=arrow, preserve_index=False)

    return df.mapInArrow(tidied(run), kind)
