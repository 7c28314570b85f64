"""Findings as rows of report formats. Values are redacted before they come here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake.functions.text import escape_csv, escape_xml

#: Exit codes by precedence: what weighs most comes first.
EXIT_CODES = (("interrupted", 130), ("config_error", 2), ("live_found", 10), ("coverage_failed", 13), ("found", 1), ("clean", 0))
LEVELS = ("note", "note", "note", "warning", "error", "error")


def _level() -> Column:
    return F.get(F.array(*map(F.lit, LEVELS)), F.col("severity_rank"))


def jsonl(findings: DataFrame) -> DataFrame:
    """One JSON object for each finding, for ``write.text``."""
    fields = F.struct("detector_id", "service", "severity_rank", "path", "line", "credential_hash")
    return findings.select("doc_id", "k", F.to_json(fields).alias("json"))


def csv(findings: DataFrame) -> DataFrame:
    cells = [escape_csv(F.col(c).cast("string")) for c in ("detector_id", "service", "severity_rank", "path", "line", "credential_hash")]
    return findings.select("doc_id", "k", F.concat_ws(",", *cells).alias("csv"))


def sarif_results(findings: DataFrame) -> DataFrame:
    """``results`` of a SARIF run, one object for each finding."""
    place = F.struct(F.struct(F.struct(F.url_encode("path").alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine")).alias("region")).alias("physicalLocation"))
    row = F.struct(F.col("detector_id").alias("ruleId"), _level().alias("level"), F.struct(F.concat(F.lit("Possible "), F.col("service"), F.lit(" credential")).alias("text")).alias("message"), F.array(place).alias("locations"), F.struct(F.col("credential_hash").alias("credential/v1")).alias("partialFingerprints"))
    return findings.select("doc_id", "k", F.to_json(row).alias("result"))


def gitlab(findings: DataFrame) -> DataFrame:
    """``vulnerabilities`` of a GitLab SAST report, one object for each finding."""
    names = F.array(*map(F.lit, ("Info", "Info", "Low", "Medium", "High", "Critical")))
    row = F.struct(F.sha2(F.concat_ws(":", "detector_id", "credential_hash", "path"), 256).alias("id"), F.lit("secret_detection").alias("category"), F.get(names, F.col("severity_rank")).alias("severity"), F.struct(F.col("path").alias("file"), F.col("line").alias("start_line")).alias("location"))
    return findings.select("doc_id", "k", F.to_json(row).alias("vulnerability"))


def annotations(findings: DataFrame) -> DataFrame:
    """Workflow annotations: one command line for each finding."""
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    level = F.when(_level() == "note", "notice").otherwise(_level())
    return findings.select("doc_id", "k", F.concat(F.lit("::"), level, F.lit(" file="), safe(F.col("path")), F.lit(",line="), F.col("line").cast("string"), F.lit("::"), safe(F.col("detector_id"))).alias("annotation"))


def junit(findings: DataFrame) -> DataFrame:
    """JUnit test cases, one element for each finding."""
    name = escape_xml(F.concat_ws(":", "path", F.col("line").cast("string")))
    return findings.select("doc_id", "k", F.concat(F.lit('<testcase classname="'), escape_xml(F.col("detector_id")), F.lit('" name="'), name, F.lit('"><failure message="'), escape_xml(F.concat(F.lit("rank "), F.col("severity_rank").cast("string"))), F.lit('"/></testcase>')).alias("testcase"))


def envelope(findings: DataFrame, version: str = "1.0") -> DataFrame:
    """Per detector one JSON object with a header and its findings' hashes (distinct, sorted)."""
    return findings.groupBy("detector_id").agg(F.to_json(F.struct(F.lit(version).alias("schema_version"), F.first("detector_id").alias("detector"), F.count("*").alias("n"), F.array_sort(F.collect_set("credential_hash")).alias("hashes"))).alias("envelope"))


def status(gaps: DataFrame) -> DataFrame:
    """Counts of coverage gaps by reason, and the scan's status that they make."""
    counts = gaps.groupBy("reason").agg(F.count("*").alias("n"))
    return counts.withColumn("status", F.when(F.col("reason") == "cancelled", "cancelled").when(F.col("reason") == "recovered", "complete_after_recovery").otherwise("partial"))


def exit_code(events: DataFrame, *keys: str) -> DataFrame:
    """The exit code of each group of ``events`` (kind): that of the kind which weighs most."""
    weight = F.create_map(*(x for n, (kind, _) in enumerate(reversed(EXIT_CODES)) for x in (F.lit(kind), F.lit(n))))
    code = F.create_map(*(x for kind, c in EXIT_CODES for x in (F.lit(kind), F.lit(c))))
    return events.groupBy(*keys).agg(F.max_by(F.element_at(code, F.col("kind")), F.element_at(weight, F.col("kind"))).alias("exit_code"))
