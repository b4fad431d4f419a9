"""URL filter: a blocked Bloom filter before an exact hash join.

Listed entries are canonical ``host`` and ``path`` pairs; an entry covers its host, all
subdomains, and all paths that start with its own. A url's candidates are its host's
suffixes joined with its path's prefixes (of listed lengths). The filter holds every entry
in one 512-bit block each, eight bits of eight lanes; candidates that it rules out are
gone, the others go through an exact join with the entries, which removes false positives.

The filter's size has a fixed upper bound, so it may be sent to all tasks; with more entries
than it is made for it passes more candidates, and results stay exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (verdict, host, path)
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
#: Verdict of a url that no entry covers.
DEFAULT = "allow"
#: 2**15 blocks of 64 bytes: 2 MB at most.
MAX_BLOCKS = 1 << 15
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """A literal list as a table of verdict, host, path."""
    rows = [F.struct(*(F.lit(x).alias(n) for x, n in zip(r, ("verdict", "host", "path"), strict=True))) for r in rules]
    empty = spark.range(0).select(*(F.lit("").alias(n) for n in ("verdict", "host", "path")))
    return spark.range(1).select(F.explode(F.array(*rows)).alias("r")).select("r.*") if rows else empty


def split_url(url: str = "url") -> tuple[Column, Column]:
    """Canonical host and path."""
    u = F.col(url)
    at = F.coalesce(F.instr(u, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def _entries(rules: DataFrame) -> DataFrame:
    """Listed entries, each once: of contradicting ones the block wins."""
    clean = rules.where("host is not null and path is not null").select(F.translate("host", _UPPER, _LOWER).alias("r_host"), F.col("path").alias("r_path"), "verdict")
    return clean.groupBy("r_host", "r_path").agg(F.max("verdict").alias("r_verdict"))


def _key(host: Column, path: Column) -> tuple[Column, Column]:
    return F.xxhash64(host, path, F.lit(1)), F.xxhash64(path, host, F.lit(2))


def bloom(entries: DataFrame) -> np.ndarray:
    """(blocks, 8) 64-bit lanes. Bits are united in the cluster; the result's size is bounded."""
    n = entries.count()
    blocks = min(MAX_BLOCKS, 1 << max(0, (max(1, n) * 16 // 512)).bit_length())
    one, two = _key(F.col("r_host"), F.col("r_path"))
    lanes = entries.select(F.pmod(one, F.lit(blocks)).alias("block"), F.posexplode(F.array(*[F.shiftright(two, 6 * i).bitwiseAND(63).cast("int") for i in range(8)])).alias("lane", "bit"))
    rows = lanes.groupBy("block", "lane").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("word")).collect()
    out = np.zeros((blocks, 8), dtype=np.int64)
    for r in rows:
        out[r["block"], r["lane"]] = r["word"]
    return out.view(np.uint64)


def may_hold(lanes: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    block = lanes[np.mod(one, len(lanes))]
    bits = (two[:, None] >> (6 * np.arange(8))) & 63
    return ((block >> bits.astype(np.uint64)) & np.uint64(1)).all(axis=1)


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of pages.

    host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path:
    from there up to ``?``, ``#`` or the end; both empty for a null url or one without
    ``://``. rule: the longest entry that covers the url (host length plus path length, ties
    to the longer host), null where none does and the default verdict holds. Repeated rows
    each give a row; urls of any length are judged whole; no pages give no rows, an empty list of
    rules the default everywhere. Columns other than
    the two named are ignored.
    """
    entries = _entries(rules)
    lanes = bloom(entries)
    lengths = sorted(r[0] for r in entries.select(F.length("r_path")).distinct().collect())
    host, path = split_url(url_col)
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    heads = F.transform(F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    pairs = F.flatten(F.transform(suffixes, lambda h: F.transform(heads, lambda p: F.struct(h.alias("h"), p.alias("p")))))
    if not lengths:
        pairs = F.array().cast("array<struct<h:string,p:string>>")

    def run(batches: Iterator) -> Iterator:
        for pdf in batches:
            sizes = pdf["one"].map(len).to_numpy()
            met = np.zeros(0, dtype=bool)
            if sizes.sum():
                met = may_hold(lanes, np.concatenate(pdf["one"].to_numpy()), np.concatenate(pdf["two"].to_numpy()))
            hits = [np.flatnonzero(x).astype(np.int32) for x in np.split(met, np.cumsum(sizes)[:-1])]
            yield pdf[["page_id", "host", "path"]].assign(hits=hits)

    one = F.transform(pairs, lambda x: _key(x["h"], x["p"])[0]).alias("one")
    two = F.transform(pairs, lambda x: _key(x["h"], x["p"])[1]).alias("two")
    kind = pages.schema[id_col].dataType.simpleString()
    rows = rows.select("page_id", "host", "path", one, two).mapInPandas(run, f"page_id {kind}, host string, path string, hits array<int>")
    hits = rows.where(F.size("hits") > 0).select("page_id", "host", "path", F.posexplode("hits").alias("i", "at")).withColumn("hit", F.get(pairs, F.col("at")))
    met = hits.join(entries, (F.col("hit.h") == F.col("r_host")) & (F.col("hit.p") == F.col("r_path")), "left")
    longest = F.struct((F.length("r_host") + F.length("r_path")).alias("n"), F.length("r_host").alias("m"), F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict"))
    best = met.groupBy("page_id", "host", "path").agg(F.count_if(F.col("i") == 0).cast("int").alias("copies"), F.max(F.when(F.col("r_host").isNotNull(), longest)).alias("best"))
    judged = best.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).drop("copy")
    free = rows.where(F.size("hits") == 0).select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    return judged.union(free)
