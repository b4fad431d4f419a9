"""Scalar text functions as native expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import BUNDLE_VERSION, IDENTITY_PATTERN, KINDS, MODEL_TIERS, SECTION_LABELS, TIER_BOUNDS

_SPACE = r"(?U)[\s\x1c-\x1f]+"


def strip(c: Column | str) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def normalise(c: Column | str) -> Column:
    """Case-folded, runs of white space to one space, trimmed: exact where folding is lower case and sharp s."""
    c = F.col(c) if isinstance(c, str) else c
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "ß", "ss"), _SPACE, " "))


@F.pandas_udf(T.StringType())
def normalise_full(text: pd.Series) -> pd.Series:
    """Full Unicode case folding, for text beyond what ``normalise`` covers."""
    return text.map(lambda t: None if t is None else " ".join(t.casefold().split()))


def bounded(c: Column | str, limit: int) -> Column:
    """Stripped and cut to limit characters; blank or null becomes null."""
    c = strip(c)
    return F.when(F.length(c) > 0, F.substring(c, 1, limit))


def evidence_id(chunk: Column, ordinal: Column) -> Column:
    return F.format_string("C%03d-E%03d", chunk, ordinal)


def is_kind(c: Column) -> Column:
    return c.isin(KINDS)


def is_identity(c: Column | str) -> Column:
    """A full lower-case SHA-256; null is not one."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.rlike(IDENTITY_PATTERN), F.lit(False))


def select_model(pages: Column, override: Column | None = None) -> Column:
    """Model tag of a page count, unless one is given."""
    tier = F.lit(MODEL_TIERS["default"])
    for bound, name in reversed(TIER_BOUNDS):
        tier = F.when(pages <= bound, F.lit(MODEL_TIERS[name])).otherwise(tier)
    return tier if override is None else F.coalesce(F.nullif(override, F.lit("")), tier)


def ocr_profile(dpi: Column, lang: Column, tesseract: Column, pdf_library: Column, traineddata: Column, schema: int = 1) -> Column:
    """First twelve digits of the digest over the whole OCR configuration."""
    parts = F.format_string("schema=%d|dpi=%d|lang=%s|tess=%s|pymupdf=%s|td=%s", F.lit(schema), dpi, lang, tesseract, pdf_library, traineddata)
    return F.substring(F.sha2(parts, 256), 1, 12)


def language_fingerprint(langs: Column, files: Column) -> Column:
    """Ten digits over the language data files of langs (joined by "+", in any order), so that a new file is another reader.

    files: a map of each language's "size:mtime in ns", null where there is no such folder.
    """
    codes = F.array_sort(F.split(langs, r"\+"))
    parts = F.transform(codes, lambda c: F.concat(c, F.lit(":"), F.coalesce(F.try_element_at(files, c), F.lit("missing"))))
    return F.when(files.isNull(), "no-tessdata").otherwise(F.substring(F.sha2(F.array_join(parts, "|"), 256), 1, 10))


def strategy(chunks: Column, levels: Column, records: Column) -> Column:
    return F.format_string(f"hierarchical-evidence-v{BUNDLE_VERSION} (%d chunks, %d reduce levels, %d records)", chunks, levels, records)


def section_markdown(section: Column, raw: Column) -> Column:
    label = F.lit(None).cast("string")
    for name, text in SECTION_LABELS.items():
        label = F.when(section == name, F.lit(text)).otherwise(label)
    return F.concat(F.lit("# "), label, F.lit("\n\n"), raw, F.lit("\n"))


def display_path(c: Column, width: int = 58) -> Column:
    return F.when(F.length(c) > width, F.concat(F.lit("…"), F.substring(c, F.length(c) - F.lit(width - 2), F.lit(width - 1)))).otherwise(c)


def bytes_text(n: Column) -> Column:
    """B, KB, MB, GB without decimals, TB with one, halves to even; null: a question mark."""
    out = F.format_string("%.1fTB", F.bround(n / 1024.0**4, 1))
    for power, unit in ((3, "GB"), (2, "MB"), (1, "KB"), (0, "B")):
        out = F.when(n < 1024.0 ** (power + 1), F.concat(F.bround(n / 1024.0**power).cast("long").cast("string"), F.lit(unit))).otherwise(out)
    return F.when(n.isNull(), F.lit("?")).otherwise(out)


def duration_text(seconds: Column) -> Column:
    s = seconds.cast("long")
    h, m, rest = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return F.when(s.isNull(), F.lit("?")).when(h > 0, F.format_string("%dh%dm%ds", h, m, rest)).otherwise(F.format_string("%dm%ds", m, rest))


def epoch_seconds(ts: Column | str) -> Column:
    """Seconds since 1970 of a timestamp, with or without time zone (the session's is UTC)."""
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp")) / 1e6


def iso_seconds(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def template(text: str, **values: Column) -> Column:
    """A prompt template with each ``{name}`` replaced by a column."""
    out = F.lit(text)
    for name, c in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), c)
    return out
