"""Session settings that the engine assumes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "veristrand", master: str | None = None, partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with UTC time and adaptive execution; sizes follow the data at run time."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    if master:
        b = b.master(master)
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def scratch_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: what ``spark.checkpoint.dir`` names.

    Only in local mode, where it is unset, a temporary folder serves.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        at = sc.getConf().get("spark.checkpoint.dir", None)
        if at is None and sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        sc.setCheckpointDir(at or "file://" + tempfile.mkdtemp(prefix="veristrand-"))
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """df as a checkpoint in the shared folder."""
    scratch_folder(df.sparkSession)
    return df.checkpoint()


#: Shuffles of a finished query go at once, not when the driver next collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def compressed(df: DataFrame) -> DataFrame:
    """df as a compressed table in the shared folder, after which its shuffles are deleted.

    For rows with texts: a checkpoint holds them uncompressed, beside the shuffles they came by.
    """
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/stored-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
