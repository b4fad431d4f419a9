"""Line de-duplication by levelled sorted runs of line hashes, in DataFrame operations only.

A line's key is the line without white space at its ends and with A-Z in lower case; its
hash is two 64-bit numbers. A run is a table of hashes, each with the document that keeps
the line, in buckets of the hash and sorted there. Documents come in batches: a batch's
hashes are anti-joined with each run by a merge of co-bucketed tables (neither side is
shuffled), and those that no run holds become a run of level 0. ``FANOUT`` runs of a level
are compacted into one of the next. So the document that keeps a line is the first to hold
it, in the order of batches; ``line_report`` and ``drop_lines`` deal out a whole table from
the largest doc_id down, ``drop_known_lines`` serves batches as they arrive.

Lines whose hash more than one in ``COMMON`` of all lines have meet their keeper by a
broadcast of those few hashes, which are at most ``COMMON``; all others by a shuffle.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, n_partitions, plain_names

#: Code points of a key, and documents that hold it, from which on its lines are dropped.
LEAST_CHARS, LEAST_DOCS = 40, 5
#: Batches that a whole table is dealt out in, and runs of a level before they are compacted.
BATCHES, FANOUT = 6, 3
COMMON = 10_000
_SPACE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HASH = ["h1", "h2"]
#: What a missing doc_id counts as: smaller than any other.
_NO_ID = -(1 << 63)


def line_key(line: Column) -> Column:
    bare = F.btrim(line, F.lit(_SPACE))
    # translate goes letter by letter, so it is left to lines that lower() would change otherwise
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def lines_of(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """doc, th, pos, h1, h2 of each line whose key is long enough; th: a digest of its text, pos: from 0."""
    lines = docs.select(_doc(), _digest(), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("pos", "line"))
    keys = lines.where(F.char_length("line") >= least_chars).select("doc", "th", "pos", line_key(F.col("line")).alias("key"))
    return keys.where(F.char_length("key") >= least_chars).select("doc", "th", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def _doc() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc")


def _digest() -> Column:
    return F.xxhash64("text", F.lit(12)).alias("th")


class LineRuns:
    """The runs: tables (h1, h2, keeper) whose hashes differ, by level.

    They lie in the shared folder, so they survive the loss of executors. close() takes their
    names out of the session's catalog; the files stay until the scratch is cleared.
    """

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.fanout, self.buckets = spark, fanout, buckets or n_partitions(spark)
        self.scratch = Scratch(spark, "line-runs")
        self.levels: list[list[DataFrame]] = []
        self._names: list[str] = []

    def store(self, rows: DataFrame, *by: str) -> DataFrame:
        """rows as a table in buckets of the hash, sorted by it; by: columns that folders are named by."""
        name = f"line_run_{uuid.uuid4().hex}"
        self._names.append(name)
        writer = rows.write.bucketBy(self.buckets, *_HASH).sortBy(*_HASH)
        (writer.partitionBy(*by) if by else writer).saveAsTable(name, format="parquet", path=f"{self.scratch.root}/{name}")
        return self.spark.table(name)

    def runs(self) -> list[DataFrame]:
        """The oldest, which are the largest, first."""
        return [run for level in reversed(self.levels) for run in level]

    def unseen(self, keys: DataFrame) -> DataFrame:
        """The rows of keys whose hash no run holds."""
        for run in self.runs():
            keys = keys.join(run.select(*_HASH).hint("merge"), _HASH, "left_anti")
        return keys

    def add(self, keys: DataFrame) -> None:
        """keys (h1, h2, keeper), a row each hash: those that no run holds are a new run."""
        self._put(0, self.store(self.unseen(keys)))

    def _put(self, level: int, run: DataFrame) -> None:
        if len(self.levels) == level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            merged = self._union(self.levels[level]).repartition(self.buckets, *_HASH)
            self.levels[level] = []
            self._put(level + 1, self.store(merged))

    def _union(self, runs: list[DataFrame]) -> DataFrame:
        out = runs[0]
        for run in runs[1:]:
            out = out.union(run)
        return out

    def keepers(self) -> DataFrame:
        """(h1, h2, keeper) of all runs."""
        if not self.runs():
            return self.spark.createDataFrame([], "h1 long, h2 long, keeper long")
        return self._union(self.runs())

    def close(self) -> None:
        for name in self._names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self._names = []


def _repeated(docs: DataFrame, least_chars: int, least_docs: int, batches: int) -> DataFrame:
    """(doc, th, pos) of the lines that go: enough documents hold them, and another one keeps them."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "line-dedup")
    lines = scratch.write(lines_of(docs, least_chars))
    shares = F.array(*(F.lit(i / batches) for i in range(1, batches)))
    bounds = lines.agg(F.percentile_approx("doc", shares, F.lit(10_000))).first()[0] if batches > 1 else []
    batch = sum((F.when(F.col("doc") <= b, 1).otherwise(0) for b in sorted(set(bounds or []))), F.lit(0))
    # a hash once a document, then once a batch: a line of many documents is counted where it is read
    held = lines.select(*_HASH, "doc").distinct().withColumn("batch", batch)
    held = held.groupBy(*_HASH, "batch").agg(F.count(F.lit(1)).alias("docs"), F.max("doc").alias("keeper"))
    held = held.withColumn("docs", F.sum("docs").over(Window.partitionBy(*_HASH))).where(F.col("docs") >= least_docs)
    runs = LineRuns(spark)
    try:
        held = runs.store(held, "batch")
        for b in range(len(set(bounds or [])) + 1):
            runs.add(held.where(F.col("batch") == b).select(*_HASH, "keeper"))
        total, longest = lines.count(), held.groupBy(*_HASH).agg(F.max("docs").alias("docs"))
        keepers = scratch.write(runs.keepers().join(longest, _HASH))
    finally:
        runs.close()
    often = F.col("docs") > total / COMMON
    common, rare = F.broadcast(keepers.where(often).drop("docs")), keepers.where(~often).drop("docs")
    met = lines.join(common, _HASH).unionByName(lines.join(common, _HASH, "left_anti").join(rare, _HASH))
    return met.where(F.col("doc") < F.col("keeper")).select("doc", "th", "pos")


def _thinned(docs: DataFrame, drops: DataFrame) -> DataFrame:
    """doc_id, text and columns of docs; added: line_count, gone (number of lines), kept (the text without them).

    drops: (doc, th, pos). Only the places of lines are gathered, those of one text at a time.
    """
    places = drops.groupBy("doc", "th").agg(F.collect_set("pos").alias("places"))
    rows = docs.withColumns({"doc": _doc(), "th": _digest()}).join(places.hint("shuffle_hash"), ["doc", "th"], "left")
    rows = rows.withColumns({"body": F.coalesce("text", F.lit("")), "gone": F.coalesce(F.size("places"), F.lit(0)).cast("long")})
    rows = rows.withColumn("gone", F.greatest("gone", F.lit(0))).withColumn("list", F.split("body", "\n", -1))
    stay = F.array_except(F.sequence(F.lit(0), F.size("list") - 1), "places")
    left = F.array_join(F.transform(stay, lambda i: F.get("list", i)), "\n")
    return rows.withColumns({"line_count": F.size("list").cast("long"), "kept": F.when(F.col("places").isNull(), F.col("body")).otherwise(left)})


def line_report(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, batches: int = BATCHES) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 for each row of docs.

    Lines whose key is long enough and held by enough documents are dropped, but for all such
    lines of the largest doc_id that holds it. A null or empty text is one empty line. Rows of
    one doc_id are one document, and so are all without one, which come before any other; rows
    equal in both give equal results. Texts of any length are read whole; an empty table gives
    none. Columns other than doc_id and text are ignored.
    """
    mine = docs.select("doc_id", "text")
    drops = _repeated(mine, least_chars, least_docs, batches)
    return _thinned(mine, drops).select("doc_id", F.col("line_count").alias("n_lines"), F.col("gone").alias("n_dropped"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def drop_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, batches: int = BATCHES) -> DataFrame:
    """docs without the lines that ``line_report`` counts as dropped; all columns and rows stay.

    A null text stays null, and a text that loses all its lines is empty. Rows are told apart
    and treated as there, whatever other columns are named.
    """
    mine, names = plain_names(docs, "doc_id", "text")
    drops = _repeated(mine.select("doc_id", "text"), least_chars, least_docs, batches)
    return _with_kept(_thinned(mine, drops), names, docs.columns)


def drop_known_lines(docs: DataFrame, runs: LineRuns, least_chars: int = LEAST_CHARS) -> DataFrame:
    """A batch without the lines that an earlier one holds or, of its own, a larger doc_id; its hashes join the runs.

    Rows are treated as by ``drop_lines``, with one document in place of several; an empty
    batch adds an empty run. The batch must read the same when the result is read; a batch
    added twice loses what it held.
    """
    mine, names = plain_names(docs, "doc_id", "text")
    lines = runs.scratch.write(lines_of(mine, least_chars))
    keys = lines.groupBy(*_HASH).agg(F.max("doc").alias("keeper"))
    fresh = runs.scratch.write(runs.unseen(keys))
    runs.add(fresh)
    drops = lines.join(fresh, _HASH, "left").where(F.col("keeper").isNull() | (F.col("doc") < F.col("keeper")))
    return _with_kept(_thinned(mine, drops), names, docs.columns)


def _with_kept(rows: DataFrame, names: list[str], given: list[str]) -> DataFrame:
    text = F.when(F.col("text").isNotNull(), F.col("kept")).alias("text")
    return rows.select(*(text if c == "text" else F.col(c) for c in names)).toDF(*given)


#: The report as DuckDB SQL.
ORACLE_SQL = f"""
    WITH d AS (
      SELECT row_number() OVER () AS n, doc_id, coalesce(doc_id, {_NO_ID}) AS doc, string_split(coalesce(text, ''), chr(10)) AS list FROM documents
    ), l AS (
      SELECT n, doc, unnest(range(1, len(list) + 1)) AS pos, unnest(list) AS line FROM d
    ), k AS (
      SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') AS key FROM l
    ), f AS (
      SELECT key, max(doc) AS keeper FROM k WHERE length(key) >= {LEAST_CHARS} GROUP BY key HAVING count(DISTINCT doc) >= {LEAST_DOCS}
    ), m AS (
      SELECT n, pos, line, f.key IS NOT NULL AND doc <> keeper AS gone FROM k LEFT JOIN f USING (key)
    )
    SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
    FROM m JOIN d USING (n) GROUP BY n
"""
