"""Statistics, shapes and redaction of a candidate value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def characters(value: Column) -> Column:
    return F.split(value, "")


def shannon_entropy(value: Column) -> Column:
    """Bits for each character; 0 for an empty value. A character's count is what the value loses without it: the characters are split once."""
    share = lambda c: (F.length(value) - F.length(F.replace(value, c, F.lit("")))) / F.length(value)
    bits = F.aggregate(F.array_distinct(characters(value)), F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))
    return F.when(F.length(value) == 0, F.lit(0.0)).otherwise(bits)


def byte_entropy(value: Column) -> Column:
    """Bits for each byte of the UTF-8 form."""
    return shannon_entropy(F.decode(F.encode(value, "UTF-8"), "ISO-8859-1"))


def char_diversity(value: Column) -> Column:
    """Distinct characters as a share of all."""
    return F.size(F.array_distinct(characters(value))) / F.length(value)


def longest_run(value: Column) -> Column:
    """Length of the longest run of one character."""
    return F.array_max(F.transform(F.regexp_extract_all(value, F.lit(r"(?s)(.)\1*"), F.lit(0)), F.length))


def redact(value: Column) -> Column:
    """``****`` up to eight characters; beyond, an eighth of them (one to four) stays on either side."""
    keep = F.least(F.lit(4), F.greatest(F.lit(1), F.floor(F.length(value) / 8))).cast("int")
    return F.when(F.length(value) <= 8, "****").otherwise(F.concat(F.left(value, keep), F.lit("..."), F.right(value, keep)))


def clean_control(value: Column) -> Column:
    """Control characters become a blank."""
    return F.regexp_replace(value, r"[\x00-\x1F\x7F]", " ")


def escape_csv(value: Column) -> Column:
    """Safe from spreadsheet formulas; quoted where commas, quotes or line ends need it."""
    safe = F.when(value.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), value)).otherwise(value)
    quoted = F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(safe.rlike('[",\r\n]'), quoted).otherwise(safe)


def escape_xml(value: Column) -> Column:
    for raw, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        value = F.replace(value, F.lit(raw), F.lit(escaped))
    return value


def safe_score(value: Column) -> Column:
    """NaN and null count as 0; the rest is held between 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(F.isnan(value), 0.0).otherwise(F.coalesce(value, F.lit(0.0)))))


def is_hex(value: Column) -> Column:
    return value.rlike("^[0-9a-fA-F]+$")


def is_uuid(value: Column) -> Column:
    return value.rlike("^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$")


def is_email(value: Column) -> Column:
    return value.rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$")


def looks_like_identifier(value: Column) -> Column:
    """Up to 64 letters, digits and underscores, beginning with none of the digits."""
    return value.rlike("^[A-Za-z_][A-Za-z0-9_]{0,63}$")


def fold_confusables(value: Column) -> Column:
    """Letters of other scripts that look like Latin ones become these."""
    return F.translate(value, "аеорсухіјѕАВЕКМНОРСТХ", "aeopcyxijsABEKMHOPCTX")


def strip_invisible(value: Column) -> Column:
    """Zero-width characters and soft hyphens go."""
    return F.translate(value, "​‌‍⁠﻿­", "")
