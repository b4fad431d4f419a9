"""Fill-in-the-middle transformation, in Spark SQL functions only.

``regexp_extract_all`` makes the array of a text's units (its lines); two numbers out of a
hex sha256 of the document's id, read by ``conv``, cut it; ``slice`` and ``array_join``
build prefix, middle and suffix, which are laid out between sentinels in one of two orders.
The text is restored by parsing the sentinels. A cut depends on the document's id and its
number of units alone, so reruns and other partitionings give the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import plain_names

LINES = r"[^\n]*\n|[^\n]+"
#: Sentinels before prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
SEED = 7
#: Documents of a hundred that are transformed, and of those that put the suffix first.
RATE, SUFFIX_FIRST = 100, 50


def numbers(key: Column, n: int) -> Column:
    """The first n groups of eight digits of a key's hex sha256, as unsigned numbers."""
    digest = F.sha2(key.cast("binary"), 256)
    return F.array(*(F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(n)))


def arrange(
    docs: DataFrame, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, unit: str = LINES, sentinels: tuple[str, str, str] = SENTINELS
) -> DataFrame:
    """docs with all columns and, added, units, form, prefix, middle, suffix, arranged.

    units: how many there are; form: plain, psm (prefix, suffix, middle) or spm; arranged: the
    text in that form. Plain are texts that are null, empty or hold a sentinel, and those that
    the rate leaves out; their parts are null. The pattern's matches must cover the text.
    A null doc_id counts as an empty one, repeated rows are cut alike, and texts of any length
    are cut whole; an empty table gives none. Columns of docs with the names added are replaced.
    """
    pre, suf, mid = map(F.lit, sentinels)
    mine, names = plain_names(docs, "doc_id", "text")
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = mine.withColumns({"body": F.coalesce("text", F.lit("")), "h": numbers(key, 4)})
    rows = rows.withColumn("list", F.regexp_extract_all("body", F.lit(unit), F.lit(0)))
    rows = rows.withColumns({"units": F.size("list").cast("long"), "one": _cut(0), "two": _cut(1)})
    rows = rows.withColumns({"low": F.least("one", "two"), "high": F.greatest("one", "two")})
    plain = (F.col("body") == "") | F.contains("body", pre) | F.contains("body", suf) | F.contains("body", mid) | (F.col("h")[2] % 100 >= rate)
    form = F.when(plain, "plain").when(F.col("h")[3] % 100 < suffix_first, "spm").otherwise("psm")
    rows = rows.withColumn("form", form)
    rows = rows.withColumns({"prefix": _part(F.lit(1), F.col("low")), "middle": _part(F.col("low") + 1, F.col("high") - F.col("low")), "suffix": _part(F.col("high") + 1, F.col("units") - F.col("high"))})
    laid = F.when(F.col("form") == "plain", F.col("body"))
    laid = laid.when(F.col("form") == "psm", F.concat(pre, "prefix", suf, "suffix", mid, "middle"))
    laid = laid.otherwise(F.concat(suf, "suffix", pre, "prefix", mid, "middle"))
    added = ["units", "form", "prefix", "middle", "suffix", "arranged"]
    kept = [F.col(c).alias(given) for c, given in zip(names, docs.columns, strict=True) if given not in added]
    return rows.withColumn("arranged", laid).select(*kept, *added)


def _cut(i: int) -> Column:
    return (F.col("h")[i] % (F.size("list") + 1)).cast("int")


def _part(start: Column, length: Column) -> Column:
    return F.when(F.col("form") != "plain", F.array_join(F.slice("list", start.cast("int"), length.cast("int")), ""))


def restore(form: Column, arranged: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text out of its arrangement: what stands between the sentinels, in the text's order."""
    pre, suf, mid = sentinels
    last = F.substring_index(arranged, mid, -1)
    head = F.substring_index(arranged, mid, 1)
    psm = F.concat(F.substring_index(F.substring_index(head, suf, 1), pre, -1), last, F.substring_index(head, suf, -1))
    spm = F.concat(F.substring_index(head, pre, -1), last, F.substring_index(F.substring_index(head, pre, 1), suf, -1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(arranged)


def fim_report(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 for each row of docs.

    Rows are treated as ``arrange`` treats them; columns other than doc_id and text are ignored.
    """
    rows = arrange(docs.select("doc_id", "text"))
    return rows.select(
        "doc_id",
        F.col("units").alias("n"),
        "form",
        F.length("prefix").cast("long").alias("prefix_chars"),
        F.length("middle").cast("long").alias("middle_chars"),
        F.sha2(F.col("arranged").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restore(F.col("form"), F.col("arranged")).cast("binary"), 256).alias("restored_sha256"),
    )


#: The report as DuckDB SQL; it restores by positions of the sentinels.
ORACLE_SQL = r"""
    WITH d AS (
      SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents
    ), h AS (
      SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS u,
             CAST('0x' || substr(x, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(x, 9, 8) AS BIGINT) AS h2,
             CAST('0x' || substr(x, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(x, 25, 8) AS BIGINT) AS h4
      FROM d
    ), c AS (
      SELECT *, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
                  WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
      FROM h
    ), p AS (
      SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS pre, coalesce(array_to_string(u[a + 1:b], ''), '') AS mid, coalesce(array_to_string(u[b + 1:], ''), '') AS suf
      FROM c
    ), o AS (
      SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                          ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END AS y
      FROM p
    ), z AS (
      SELECT *, strpos(y, '<P>') AS ip, strpos(y, '<S>') AS is_, strpos(y, '<M>') AS im FROM o
    )
    SELECT doc_id, CAST(len(u) AS BIGINT) AS n, form,
           CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
           CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
           sha256(y) AS output_sha256,
           sha256(CASE form WHEN 'plain' THEN y
                            WHEN 'psm' THEN substr(y, ip + 3, is_ - ip - 3) || substr(y, im + 3) || substr(y, is_ + 3, im - is_ - 3)
                            ELSE substr(y, ip + 3, im - ip - 3) || substr(y, im + 3) || substr(y, is_ + 3, ip - is_ - 3) END) AS restored_sha256
    FROM z
"""
