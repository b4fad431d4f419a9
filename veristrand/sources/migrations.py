"""Steps that bring tables of older layouts to the present one.

A state is a dict of DataFrames by table name. Each step takes what the version before it had.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import IDENTITY_SCHEME, SCHEMA_VERSION
from ..schemas import DIAGRAMS, LEASES, OCR_CACHE, PAPERS
from .tables import WHOLE, Conflict, Root, Table, check_identities, check_version, locks_to_leases, migrate

State = dict[str, DataFrame]
SCHEMAS = {"papers": PAPERS, "diagrams": DIAGRAMS, "ocr_cache": OCR_CACHE, "processing_leases": LEASES}

#: Columns by which a table's rows change: a paper's diagrams are replaced together.
KEYS = {"papers": ("paper_hash",), "diagrams": ("paper_hash",), "ocr_cache": ("paper_hash", "page_idx", "ocr_profile"), "processing_leases": ("resource_key",)}


def _fitted(df: DataFrame | None, schema: T.StructType, spark: SparkSession) -> DataFrame:
    """df with exactly the schema's columns; missing ones are null."""
    if df is None:
        return spark.createDataFrame([], schema)
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))


def steps(spark: SparkSession) -> dict:
    """Version reached -> step: base tables, leases out of locks, a cache by reader profile, full identities."""

    def base(s: State) -> State:
        return s | {k: _fitted(s.get(k), SCHEMAS[k], spark) for k in ("papers", "diagrams")}

    def leases(s: State) -> State:
        out = {k: v for k, v in s.items() if k != "processing_locks"}
        locks = s.get("processing_locks")
        return out | {"processing_leases": locks_to_leases(locks) if locks is not None else _fitted(s.get("processing_leases"), LEASES, spark)}

    def cache(s: State) -> State:
        """Texts of an unknown reader can't be told apart by profile: the cache starts anew."""
        return s | {"ocr_cache": spark.createDataFrame([], OCR_CACHE)}

    def identities(s: State) -> State:
        check_identities(s["papers"])
        return s

    return {1: base, 2: leases, 3: cache, 4: identities}


def upgrade(spark: SparkSession, state: State, version: int, marker: str | None = None) -> State:
    """The state at the present version. Newer versions, unknown markers and, from 4 on, short identities raise before anything changes."""
    check_version(version, marker)
    if version >= SCHEMA_VERSION:
        check_identities(state["papers"])
    return migrate(dict(state), version, steps(spark))[0]


def adopt(spark: SparkSession, root: str, state: State, version: int, marker: str | None = None) -> int:
    """Upgrade tables of an older layout and commit them below root, all in one step, where nothing is yet."""
    ready = upgrade(spark, state, version, marker)
    return Root(spark, root).commit(_staged(spark, root, ready), 0)


def _staged(spark: SparkSession, root: str, ready: State) -> dict:
    return {k: v for name, schema in SCHEMAS.items() for k, v in Table(spark, root, name, schema, KEYS[name]).stage(_fitted(ready.get(name), schema, spark)).items()}


def migrate_root(spark: SparkSession, root: str) -> int:
    """Bring a root in use to the present version, in one commit; the number of its newest commit.

    The steps run on what the newest commit names, as its files have it, and are published
    under the next number: where another writer was first they run again on what it left, and
    of two migrations at once the later finds nothing to do. A failing step changes nothing.
    """
    commits = Root(spark, root)
    while True:
        number = commits.version()
        found = commits.commit_at(number)
        if found["schema_version"] >= SCHEMA_VERSION:
            return number
        state = {name: spark.read.parquet(*(f"{commits.root}/{p}" for p in commits.entry(number, name)["base"].values())) for name in found["tables"]}
        ready = upgrade(spark, state, found["schema_version"], found.get("identity_scheme"))
        tables = {name: {"base": c.base, "deltas": []} for name, c in _staged(spark, root, ready).items()}
        others = {k: v for k, v in found["tables"].items() if k not in (*SCHEMAS, "processing_locks")}
        wrote = {name: {"at": WHOLE, "keys": None} for name in tables}
        try:
            return commits.replace({"schema_version": SCHEMA_VERSION, "identity_scheme": IDENTITY_SCHEME, "tables": others | tables, "wrote": wrote}, number)
        except Conflict:
            continue
