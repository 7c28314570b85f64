"""Shapes that are no credential: the ladder's stages for generic and entropy candidates, by pattern, in the order in which they are asked."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftlake.functions import text as T

#: (stage, pattern). The patterns keep to what Java and RE2 read alike. A value is dropped by the first that it fits.
SOURCE = (
    ("code_expression", r"[(){};]|\[[A-Za-z0-9_'\"]*\]|=>|->|&&|\|\|"),
    ("scope_resolution", r"^[A-Za-z_][A-Za-z0-9_]*(?:::[A-Za-z_][A-Za-z0-9_]*)+$"),
    ("type_name", r"^(?:[A-Z][a-z0-9]+){2,}$"),
    ("camel_case_no_digit", r"^[a-z]+(?:[A-Z][a-z]+)+$"),
    ("constant_name", r"^[A-Z][A-Z]+(?:_[A-Z]+)+$"),
    ("snake_words", r"^[a-z]+(?:_[a-z]+)+$"),
    ("program_id", r"^[a-z]+(?:[._-][a-z]+)*:[a-z][a-z0-9._-]*$"),
    ("kebab_config_id", r"^[a-z][a-z0-9]*(?:-[a-z][a-z0-9]*){2,}$"),
    ("dotted_id", r"^[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)+$"),
    ("numeric_literal", r"^[-+]?(?:0[xX][0-9a-fA-F]{1,8}|[0-9][0-9_]*(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?)[uUlLfF]{0,2}$"),
    ("version_literal", r"^[v^~]?[0-9]+(?:\.[0-9]+){1,3}(?:[-+][0-9A-Za-z.-]+)?$"),
    ("format_directive", r"%[0-9.]*[sdifxqv]|\{[0-9]*\}|\{:[^}]*\}"),
)
PUBLIC = (
    ("versioned_identifier", r"^[a-z][a-z0-9-]*[@/-]v?[0-9]+(?:\.[0-9]+)+$"),
    ("css_selector", r"^[.#][A-Za-z][A-Za-z0-9_-]*(?:[ .#>:][A-Za-z][A-Za-z0-9_-]*)*$"),
    ("hex_color", r"^#(?:[0-9a-fA-F]{3}|[0-9a-fA-F]{6}|[0-9a-fA-F]{8})$"),
    ("metadata_label", r"^[a-z0-9.-]+\.[a-z]{2,}/[a-z0-9._-]+(?:[:=].*)?$"),
    ("advisory_id", r"^(?:CVE-[0-9]{4}-[0-9]{4,}|GHSA(?:-[23456789cfghjmpqrvwx]{4}){3}|CWE-[0-9]+|RFC-?[0-9]+)$"),
    ("artifact_reference", r"^[a-z0-9./_-]+@sha256:[0-9a-f]{64}$|^sha(?:1|256|384|512)[-:][A-Za-z0-9+/=]{20,}$"),
    ("resource_name", r"^arn:[a-z-]+:[a-z0-9-]*:|^urn:[a-z0-9-]+:|^projects/[a-z0-9-]+/"),
    ("shell_template", r"^\$\{?[A-Za-z_]|\$\(|^`|\{\{|%\(|^<[A-Za-z_ -]+>$"),
    ("percent_encoded_markup", r"%3[CcEe]"),
    ("html_handler", r"^on[a-z]+=|^<[a-z]+[ />]"),
    ("mime_type", r"^(?:application|audio|font|image|text|video|multipart)/[a-z0-9.+-]+$"),
    ("timestamp", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T ][0-9]{2}:[0-9]{2}.*)?$"),
    ("ip_address", r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]+)?$"),
    ("host_name", r"^(?:[a-z0-9-]+\.)+(?:com|org|net|io|dev|local|internal)(?::[0-9]+)?$"),
)
TEXT = (
    ("whitespace", r"\s"),
    ("comma_delimited", r"^[A-Za-z0-9_]+(?:,[A-Za-z0-9_]+)+,?$"),
    ("mac_address", r"^(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}$"),
    ("blockchain_address", r"^0x[0-9a-fA-F]{40}$|^bc1[02-9ac-hj-np-z]{25,60}$"),
    ("uri", r"^[A-Za-z][A-Za-z0-9+.-]*:(?://|[^:]*/)"),
    ("path_segments", r"^(?:[A-Za-z]:)?[./~]*[A-Za-z0-9_.-]+(?:[/\\][A-Za-z0-9_.-]+){2,}$"),
    ("file_name", r"^[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)*\.(?:json|ya?ml|toml|txt|md|py|js|ts|go|rs|html|css|png|xml|ini|cfg|conf|sh|sql|csv)$"),
    ("repeated_pair", r"^(?:00|11|22|33|44|55|66|77|88|99|aa|bb|cc|dd|ee|ff|xx){6,}$"),
    ("ascending", r"(?i)0123456789|abcdefghij|qwertyuiop|1234567890"),
    ("mask", r"^[*x.•#-]{4,}|\*{3,}"),
)
STAGES = (*SOURCE, *PUBLIC, *TEXT)


#: Characters of a value whose shape is asked for: longer ones are no credentials, and repeated groups of a pattern take a stack of their length.
MOST = 512


def shape(value: Column) -> Column:
    """The name of the first shape that the value has; null if none, or if it has over MOST characters."""
    return F.when(F.length(value) <= MOST, F.coalesce(*(F.when(value.rlike(rx), name) for name, rx in STAGES)))


#: Joining words of English: three of them in a row of words make prose.
CONNECTORS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "in", "is", "it", "not", "of", "on", "or", "that", "the", "this", "to", "was", "will", "with", "you")


def is_prose(value: Column) -> Column:
    """Five words or more, three of them joining words or a fifth of them all."""
    words = F.filter(F.split(F.lower(value), r"[^a-z']+"), lambda w: w != "")
    joining = F.size(F.filter(words, lambda w: w.isin(*CONNECTORS)))
    return value.rlike(r"\s") & (F.size(words) >= 5) & ((joining >= 3) | (5 * joining >= F.size(words)))


#: Characters of a key in hexadecimal digits that services give out: canonical widths are digests unless the name says it's a key.
KEY_WIDTHS = (32, 40, 48, 64, 96, 128)


def hex_decoy(value: Column, name: Column) -> Column:
    """Hexadecimal digits of a digest's width whose name speaks of a digest, a licence or a revision."""
    return value.rlike("^[0-9a-f]+$|^[0-9A-F]+$") & F.length(value).isin(*KEY_WIDTHS) & F.lower(name).rlike("sha|md5|hash|digest|checksum|integrity|etag|commit|revision|license|licence|serial|fingerprint")


def base64_decoy(value: Column) -> Column:
    """Base64 of binary data: over 120 characters, or a format's first bytes."""
    return value.rlike("^[A-Za-z0-9+/]{120,}={0,2}$") | value.rlike("^(?:iVBORw0KGgo|/9j/|R0lGOD|UEsDB|JVBERi0|H4sI|AAAB)[A-Za-z0-9+/]{8,}")


def example_ladder(value: Column, canonical: Column) -> Column:
    """Content checks of entropy candidates in order; ``canonical`` (the value has a key's own form) releases drops for shape, and only these."""
    content = F.when(value.rlike(r"(?i)example|sample|dummy|placeholder|changeme"), "example_word").when(T.longest_run(value) * 2 > F.length(value), "long_run")
    return F.coalesce(content, F.when(is_prose(value), "english_prose"), F.when(~canonical, shape(value)))


def stopped(value: Column, words: tuple[str, ...], allowed: tuple[str, ...]) -> Column:
    """A detector's own lists: a stopword inside the value, in any case, or an allowed value, literal or ``re:`` pattern."""
    found = F.lit(False)
    for w in words:
        found = found | F.contains(F.lower(value), F.lit(w))
    for a in allowed:
        found = found | (value.rlike(a[3:]) if a.startswith("re:") else value == a)
    return found
