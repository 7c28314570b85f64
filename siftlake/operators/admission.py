"""What may be scanned and how values are taken: admission gates, shared scans, group choice, canaries, triage and allowlists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake.functions import text as T

from .suppress import glob_regex


def propagated(chunks: DataFrame, prefixes: list[tuple[str, str]]) -> DataFrame:
    """doc_id and pattern: patterns whose prefix is in the text, and those whose prefix begins with it or the other way round."""
    with_kin = [(p, [q for q, b in prefixes if a.startswith(b) or b.startswith(a)]) for p, a in prefixes]
    literal = dict(prefixes)
    hits = F.flatten(F.array(*(F.when(F.contains("text", F.lit(literal[p])), F.array(*map(F.lit, kin))).otherwise(F.array().cast("array<string>")) for p, kin in with_kin)))
    return chunks.select("doc_id", F.explode(F.array_distinct(hits)).alias("pattern"))


def scan_distinct(chunks: DataFrame, scan: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The scan's rows for every chunk, though each different text is scanned once only.

    The scan sees one chunk for each text, named by the text's hash and with no base; each chunk that has the text gets the
    matches back at its own place. A null text is none.
    """
    hashed = chunks.where("text IS NOT NULL").withColumn("_hash", F.sha2("text", 256))
    zero = F.lit(0).cast("long")
    once = hashed.groupBy("_hash").agg(F.first("text").alias("text")).select(F.col("_hash").alias("doc_id"), F.lit("").alias("path"), "text", zero.alias("base_line"), zero.alias("base_offset"))
    found = scan(once).withColumnRenamed("doc_id", "_hash").drop("path")
    owners = hashed.select("doc_id", "path", "base_line", "base_offset", "_hash")
    rows = owners.join(found, "_hash")
    return rows.withColumn("line_no", F.col("line_no") + F.col("base_line")).withColumn("byte_offset", F.col("byte_offset") + F.col("base_offset")).drop("_hash", "base_line", "base_offset")


def has_long_run(text: Column, least: int) -> Column:
    """A run of characters that values are made of."""
    return text.rlike(f"[A-Za-z0-9_+/=.:!@#$%^&*-]{{{least},}}")


def value_group(first: Column, second: Column) -> Column:
    """The first group, unless it looks like a name and the second like a value."""
    return F.when(first.rlike("^[A-Za-z0-9_]{1,64}$") & (F.length(second) >= 8) & ~T.looks_like_identifier(second), second).otherwise(first)


def is_whole_value(line: Column, value: Column) -> Column:
    """The value is all that the line assigns, but for quotes and a mark at the end."""
    right = F.regexp_extract(line, "[:=](.*)$", 1)
    return F.regexp_replace(right, "^[ \"';,]+|[ \"';,]+$", "") == value


def bounded_keyword(name: Column) -> Column:
    """``pass`` or ``auth`` begins a word of the name, or a part behind an underscore."""
    return name.rlike("(^|_|[a-z])(pass|auth)(_|$|word|wd|phrase|token|key|[A-Z])") & ~name.rlike("[a-z](pass|auth)")


def with_canary(keys: DataFrame, accounts: DataFrame) -> DataFrame:
    """Adds ``canary``: the key's ``account`` is listed."""
    return keys.join(accounts.withColumn("_listed", F.lit(True)), "account", "left").withColumn("canary", F.coalesce("_listed", F.lit(False))).drop("_listed")


def promising(value: Column) -> Column:
    """Enough different characters and pairs of them, and not a UUID."""
    pairs = F.transform(F.sequence(F.lit(1), F.length(value) - 1), lambda k: F.substring(value, k, F.lit(2)))
    return (T.char_diversity(value) >= 0.3) & ~T.is_uuid(value) & (F.size(F.array_distinct(pairs)) / F.size(pairs) >= 0.5)


ENVELOPE = "version int, detector_digest string, records array<struct<finding_hash: string, detector_id: string, disposition: string, reason: string>>"


def triage(envelopes: DataFrame, digest: str) -> tuple[DataFrame, DataFrame]:
    """Reviewed records of JSON envelopes, and the envelopes that aren't taken, with the reason: not JSON of this kind, another version, or other detectors."""
    parsed = envelopes.withColumn("e", F.from_json("envelope", ENVELOPE))
    fault = F.when(F.col("e.records").isNull(), "malformed").when(F.col("e.version") != 1, "version").when(F.col("e.detector_digest") != digest, "detectors")
    parsed = parsed.withColumn("fault", fault)
    good = parsed.where("fault IS NULL").select(F.explode("e.records").alias("r")).select("r.*")
    return good, parsed.where("fault IS NOT NULL").select("envelope", "fault")


def without_allowed(findings: DataFrame, entries: list[tuple[str, str | None]]) -> DataFrame:
    """Findings whose path no allowlist entry (glob, day of expiry or None) covers. Repeated globs are an error."""
    if len({g for g, _ in entries}) < len(entries):
        raise ValueError("an allowlist names each glob once")
    covered = F.lit(False)
    for glob, expires in entries:
        here = F.col("path").rlike(glob_regex(glob))
        covered = covered | (here if expires is None else here & (F.lit(expires).cast("date") >= F.current_date()))
    return findings.where(~covered)
