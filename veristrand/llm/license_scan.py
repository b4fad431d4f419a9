"""Licence scan by canonical digests.

A text is put into canonical form (case, copyright lines, equivalent spellings,
punctuation, white space) and its digest is looked up among those of known licence texts by
a hash join on entire texts. Whole documents are looked up, and each of their lines, since
short notices are licence texts of one line. The form is made line by line, once: that of a
text is its lines' joined. Lines whose form has no known length aren't hashed. ``known_files``
reads a digest table from a folder of licence texts in place of the built-in list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch
from .license_texts import DIGESTS, KNOWN

# Spelling, and the one that stands for it.
SPELLINGS = [("licence", "license"), ("organisation", "organization"), ("authorise", "authorize"), ("favour", "favor"), ("acknowledgement", "acknowledgment"), ("sub-license", "sublicense"), ("http://", "https://")]
# Words that go on with a sentence behind "copyright", where no holder is named.
SENTENCE = (
    "notice", "notices", "holder", "holders", "owner", "owners", "law", "laws", "interest", "interests", "license", "licenses", "statement", "statements", "protection", "right", "rights", "claim", "claims",
    "treaty", "treaties", "act", "infringement", "material", "materials", "information", "management", "assignment", "permission", "permissions", "ownership", "disclaimer", "disclaimers", "the", "this", "that", "these", "which",
    "and", "or", "nor", "in", "to", "of", "is", "are", "was", "as", "on", "for", "with", "without", "from", "at", "if", "it", "its", "but", "not", "may", "shall", "will", "must", "can", "has", "have", "also", "only", "under", "can't",
)
_YEAR = r"([0-9]{4}|<year>|\[year\]|\[yyyy\]|yyyy)"
#: A copyright line, in lower case: marks and a year, a mark behind the word, or the sign alone; or the rights reserved, alone in their line.
_MARKED = rf"^[ \t]*((copyright|\(c\)|©)[ \t:,]*)+(by[ \t]+)?{_YEAR}|^[ \t]*copyright[ \t:,]*(\(c\)|©)|^[ \t]*©|^[ \t]*all rights reserved[ \t.!\r]*$"
#: A copyright line that names a holder: what follows the word is no word of ``SENTENCE``.
_NAMED, _SENTENCE = r"^[ \t]*copyright[ \t]+[\p{L}<\[]", rf"^[ \t]*copyright[ \t]+({'|'.join(SENTENCE)})([^\p{{L}}\p{{N}}]|$)"


def is_copyright(line: Column) -> Column:
    """Whether a line in lower case is one of copyright. A licence's sentence that happens to be wrapped before the word is none."""
    return F.rlike(line, F.lit(_MARKED)) | (F.rlike(line, F.lit(_NAMED)) & ~F.rlike(line, F.lit(_SENTENCE)))


def canonical_line(line: Column) -> Column:
    """Lower case; nothing of a copyright line; equivalent spellings; words of letters and digits joined by one space."""
    x = F.lower(line)
    x = F.when(is_copyright(x), "").otherwise(x)
    for one, other in SPELLINGS:
        x = F.replace(x, F.lit(one), F.lit(other))
    return F.trim(F.regexp_replace(x, r"[^\p{L}\p{N}]+", F.lit(" ")))


def canonical_lines(text: Column) -> Column:
    """The lines of a text in canonical form, without those that have nothing left."""
    return F.filter(F.transform(F.split(text, "\n"), canonical_line), lambda x: x != "")


def _known(texts: DataFrame) -> DataFrame:
    """license, text -> license, digest, chars: each digest once (of names that share one, the first by code point)."""
    form = texts.select("license", F.array_join(canonical_lines(F.col("text")), " ").alias("form"))
    return form.groupBy(F.sha2("form", 256).alias("digest")).agg(F.min("license").alias("license"), F.min(F.length("form")).alias("chars"))


def known_digests(spark: SparkSession, known: list[tuple[str, str]] = KNOWN, digests: list[tuple[str, str, int]] = DIGESTS) -> DataFrame:
    """The digest table of a list of (license, text) and of digests at hand (license, digest, chars)."""
    rows = F.array(*(F.struct(F.lit(n).alias("license"), F.lit(t).alias("text")) for n, t in known)) if known else F.array().cast("array<struct<license:string,text:string>>")
    given = F.array(*(F.struct(F.lit(d).alias("digest"), F.lit(n).alias("license"), F.lit(c).alias("chars")) for n, d, c in digests)).cast("array<struct<digest:string,license:string,chars:int>>")
    one = spark.range(1)
    return _known(one.select(F.explode(rows).alias("k")).select("k.*")).unionByName(one.select(F.explode(given).alias("k")).select("k.*"))


def known_files(spark: SparkSession, folder: str) -> DataFrame:
    """The digest table of a folder of licence texts, each named by its file without the ending."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.txt|\.md)?$", 1)
    return _known(spark.read.text(folder, wholetext=True).select(name.alias("license"), F.col("value").alias("text")))


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, digest, license, notices for each row of docs.

    digest: of the whole canonical text (null for a null text); license: the known licence
    that the whole text is, or null; notices: known licences among its lines, sorted, joined
    by commas, empty if none. A text over several lines inside a longer document is not found,
    nor is a notice wrapped over two. Only documents with a hit are grouped; the lookup table's
    size decides whether it is broadcast, and only its distinct text lengths go to the driver.
    Very long texts are read whole. Repeated rows count as one document when they agree in
    doc_id and text; an empty table gives none. Columns other than doc_id and text are ignored.
    """
    lengths = [r[0] for r in known.select("chars").distinct().collect()]
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), canonical_lines(F.col("text")).alias("lines"))
    rows = rows.select("doc_id", "th", F.sha2(F.array_join("lines", " "), 256).alias("digest"), F.transform(F.array_distinct(F.filter("lines", lambda x: F.length(x).isin(lengths))), lambda x: F.sha2(x, 256)).alias("some"))
    rows = Scratch(docs.sparkSession, "license").write(rows)
    found = rows.select("doc_id", "th", F.explode("some").alias("digest")).join(known, "digest").groupBy("doc_id", "th").agg(F.array_join(F.array_sort(F.collect_set("license")), ",").alias("notices"))
    whole = rows.select("doc_id", "th", "digest").join(known, "digest", "left")
    hit = found.withColumnsRenamed({"doc_id": "hit_id", "th": "hit_th"})
    out = whole.join(hit, whole["doc_id"].eqNullSafe(hit["hit_id"]) & (whole["th"] == hit["hit_th"]), "left")
    return out.select("doc_id", "digest", "license", F.coalesce("notices", F.lit("")).alias("notices"))


def _sql_line(x: str) -> str:
    for one, other in SPELLINGS:
        x = f"replace({x}, '{one}', '{other}')"
    return rf"trim(regexp_replace({x}, '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


def oracle_sql(known: list[tuple[str, str]] = KNOWN, digests: list[tuple[str, str, int]] = DIGESTS) -> str:
    """The same scan as DuckDB SQL: lines are told apart first, those of copyright by their own words' tests."""
    quoted = [(n, t.replace("'", "''")) for n, t in known]
    values = ", ".join(f"('{n}', '{t}')" for n, t in quoted)
    given = ", ".join(f"('{d}', '{n}')" for n, d, _ in digests)
    words = ", ".join("'" + w.replace("'", "''") + "'" for w in SENTENCE)
    behind = r"regexp_extract(l, '^[ \t]*copyright[ \t]+([\p{L}<\[][\p{L}\p{N}'']*)', 1)"
    marked = rf"regexp_matches(l, '^[ \t]*((copyright|\(c\)|©)[ \t:,]*)+(by[ \t]+)?({_YEAR})') OR regexp_matches(l, '^[ \t]*copyright[ \t:,]*(\(c\)|©)') OR starts_with(ltrim(l, ' ' || chr(9)), '©') OR regexp_matches(l, '^[ \t]*all rights reserved[ \t.!\r]*$')"
    return f"""
        WITH listed(license, text) AS (VALUES {values}),
        d AS (SELECT row_number() OVER () AS n, doc_id, text FROM documents),
        every AS (SELECT 'd' AS side, n, NULL AS license, text FROM d UNION ALL SELECT 'k', row_number() OVER (), license, text FROM listed),
        cut AS (SELECT side, n, license, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos, lower(unnest(string_split(text, chr(10)))) AS l FROM every),
        lines AS (SELECT side, n, license, pos, CASE WHEN {marked} OR ({behind} <> '' AND {behind} NOT IN ({words})) THEN '' ELSE {_sql_line("l")} END AS form FROM cut),
        whole AS (SELECT side, n, any_value(license) AS license, sha256(coalesce(string_agg(form, ' ' ORDER BY pos) FILTER (form <> ''), '')) AS digest FROM lines GROUP BY side, n),
        known AS (SELECT digest, min(license) AS license FROM whole WHERE side = 'k' GROUP BY digest UNION ALL SELECT * FROM (VALUES {given or "(NULL, NULL)"})),
        hits AS (SELECT n, string_agg(DISTINCT k.license, ',' ORDER BY k.license) AS notices FROM lines l JOIN known k ON sha256(l.form) = k.digest WHERE side = 'd' GROUP BY n)
        SELECT doc_id, w.digest, k.license, coalesce(notices, '') AS notices
        FROM d LEFT JOIN whole w ON w.side = 'd' AND w.n = d.n LEFT JOIN known k ON w.digest = k.digest LEFT JOIN hits h ON h.n = d.n
    """
