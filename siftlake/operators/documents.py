"""Whole reports as lines: a head, a line or more for each finding, and an end, in an order that ``write.text`` keeps when it is asked for one file.

Each function takes findings (doc_id, k, detector_id, service, severity_rank, path, line, credential_hash, confidence) and gives (part, place, line). Heads and
ends are made of counts and of one row for each detector; no finding passes through the driver.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlake.functions.text import clean_control, escape_csv, escape_xml

from . import report

VERSION = "1.0"
ORDER = ("path", "line", "detector_id", "credential_hash", "doc_id", "k")


def in_order(findings: DataFrame) -> DataFrame:
    """Findings in the order of reports: path, line, detector, value, then their keys; nulls come first."""
    return findings.orderBy(*(F.col(c).asc_nulls_first() for c in ORDER))


def write(lines: DataFrame, path: str, one_file: bool = False) -> None:
    """Write a report's lines as text: sorted over many files, or in one."""
    rows = lines.orderBy("part", "place")
    (rows.coalesce(1) if one_file else rows).select("line").write.text(path)


def _numbered(findings: DataFrame) -> DataFrame:
    """``place``: the rank of a finding, from 1. Ranks of ranges of paths are put together, so no task holds all rows."""
    rows = findings.repartitionByRange(*(F.col(c).asc_nulls_first() for c in ORDER)).sortWithinPartitions(*(F.col(c).asc_nulls_first() for c in ORDER))
    rows = rows.withColumn("_id", F.monotonically_increasing_id())
    return rows.withColumn("place", F.col("_id") + 1).drop("_id")


def _line(df: DataFrame, part: int, place: Column, line: Column) -> DataFrame:
    return df.select(F.lit(part).alias("part"), place.cast("long").alias("place"), line.alias("line"))


def _fixed(df: DataFrame, part: int, *texts: str) -> DataFrame:
    rows = [(part, k, t) for k, t in enumerate(texts)]
    return df.sparkSession.createDataFrame(rows, "part int, place long, line string")


def _first(findings: DataFrame) -> Column:
    """The row is the first of the report."""
    return F.col("place") == 1


def json_array(findings: DataFrame) -> DataFrame:
    """A JSON array with a finding on each line; the commas stand before all but the first."""
    rows = _numbered(findings)
    body = F.concat(F.when(_first(rows), "").otherwise(","), F.to_json(F.struct(*ORDER, "service", "severity_rank", "confidence")))
    return _fixed(findings, 0, "[").unionByName(_line(rows, 1, F.col("place"), body)).unionByName(_fixed(findings, 2, "]"))


def _counts(findings: DataFrame) -> DataFrame:
    return findings.agg(F.count("*").alias("n"), F.count_distinct("detector_id").alias("n_detectors"), F.count_distinct("credential_hash").alias("n_values"))


def json_lines(findings: DataFrame, status: str = "success") -> DataFrame:
    """A first line that tells version, status and counts, then a finding on each line."""
    head = F.to_json(F.struct(F.lit(VERSION).alias("schema_version"), F.lit(status).alias("status"), "n", "n_detectors", "n_values"))
    rows = _numbered(findings)
    return _line(_counts(findings), 0, F.lit(0), head).unionByName(_line(rows, 1, F.col("place"), F.to_json(F.struct(*ORDER, "service", "severity_rank", "confidence"))))


def csv(findings: DataFrame, status: str = "success") -> DataFrame:
    """Status lines in comments, a heading, and a row for each finding with its further columns as sorted JSON."""
    cells = [escape_csv(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in (*ORDER[:4], "service", "severity_rank")]
    metadata = F.to_json(F.map_from_entries(F.array(*(F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in ("confidence", "doc_id", "k")))))
    rows = _numbered(findings)
    head = F.concat(F.lit("# findings: "), F.col("n").cast("string"))
    return (
        _fixed(findings, 0, f"# status: {status}")
        .unionByName(_line(_counts(findings), 1, F.lit(0), head))
        .unionByName(_fixed(findings, 2, ",".join((*ORDER[:4], "service", "severity_rank", "metadata"))))
        .unionByName(_line(rows, 3, F.col("place"), F.concat_ws(",", *cells, escape_csv(metadata))))
    )


def sarif(findings: DataFrame, name: str = "siftlake") -> DataFrame:
    """A SARIF 2.1.0 run: the rules that have findings, and a result on each line with its place, fingerprint and a fix that removes the line's value."""
    open_run = '{"$schema":"https://json.schemastore.org/sarif-2.1.0.json","version":"2.1.0","runs":[{"tool":{"driver":{"name":' + json.dumps(name) + ',"version":"1.0","rules":['
    rules = findings.groupBy("detector_id").agg(F.first("service").alias("service"), F.max("severity_rank").alias("severity_rank"))
    rules = rules.withColumn("place", F.row_number().over(Window.orderBy("detector_id")))  # one row for each detector
    rule = F.struct(F.col("detector_id").alias("id"), F.struct(F.concat("service", F.lit(" credential")).alias("text")).alias("shortDescription"), F.struct(report._level().alias("level")).alias("defaultConfiguration"), F.struct(F.array(F.lit("security"), F.lit("CWE-798")).alias("tags")).alias("properties"))
    rows = _numbered(findings)
    uri = F.replace(F.replace(F.url_encode("path"), F.lit("%2F"), F.lit("/")), F.lit("+"), F.lit("%20"))
    region = F.struct(F.greatest("line", F.lit(1)).alias("startLine"))
    place = F.struct(F.struct(F.struct(uri.alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    change = F.struct(F.struct(uri.alias("uri")).alias("artifactLocation"), F.array(F.struct(region.alias("deletedRegion"))).alias("replacements"))
    result = F.struct(
        F.col("detector_id").alias("ruleId"),
        report._level().alias("level"),
        F.struct(F.concat(F.lit("Possible "), "service", F.lit(" credential")).alias("text")).alias("message"),
        F.array(place).alias("locations"),
        F.struct(F.col("credential_hash").alias("credential/v1")).alias("partialFingerprints"),
        F.array(F.struct(F.struct(F.lit("Revoke the credential and remove it").alias("text")).alias("description"), F.array(change).alias("artifactChanges"))).alias("fixes"),
        F.array(F.struct(F.lit("CWE-798").alias("id"), F.struct(F.lit("CWE").alias("name")).alias("toolComponent"))).alias("taxa"),
    )
    comma = lambda c: F.concat(F.when(F.col("place") == 1, "").otherwise(","), c)
    return (
        _fixed(findings, 0, open_run)
        .unionByName(_line(rules, 1, F.col("place"), comma(F.to_json(rule))))
        .unionByName(_fixed(findings, 2, ']}},"taxonomies":[{"name":"CWE","taxa":[{"id":"CWE-798","name":"Use of Hard-coded Credentials"}]}],"columnKind":"unicodeCodePoints","results":['))
        .unionByName(_line(rows, 3, F.col("place"), comma(F.to_json(result))))
        .unionByName(_fixed(findings, 4, "]}]}"))
    )


def gitlab(findings: DataFrame, status: str = "success") -> DataFrame:
    """A GitLab SAST report with a vulnerability on each line; ``status`` success or failure."""
    rows = _numbered(findings)
    body = report.gitlab(rows.withColumn("doc_id", F.col("place"))).select(F.col("doc_id").alias("place"), "vulnerability")
    scan = {"type": "secret_detection", "status": "success" if status == "success" else "failure", "scanner": {"id": "siftlake", "name": "siftlake", "version": "1.0", "vendor": {"name": "siftlake"}}}
    return (
        _fixed(findings, 0, '{"version":"15.0.0","scan":' + json.dumps(scan) + ',"vulnerabilities":[')
        .unionByName(_line(body, 1, F.col("place"), F.concat(F.when(F.col("place") == 1, "").otherwise(","), "vulnerability")))
        .unionByName(_fixed(findings, 2, "]}"))
    )


def junit(findings: DataFrame) -> DataFrame:
    """A JUnit file: one suite with its counts, and a failed case on each line."""
    rows = _numbered(findings)
    body = report.junit(rows.withColumn("doc_id", F.col("place"))).select(F.col("doc_id").alias("place"), "testcase")
    head = F.concat(F.lit('<testsuites><testsuite name="siftlake" tests="'), F.col("n").cast("string"), F.lit('" failures="'), F.col("n").cast("string"), F.lit('">'))
    return (
        _fixed(findings, 0, '<?xml version="1.0" encoding="UTF-8"?>')
        .unionByName(_line(_counts(findings), 1, F.lit(0), head))
        .unionByName(_line(body, 2, F.col("place"), F.col("testcase")))
        .unionByName(_fixed(findings, 3, "</testsuite></testsuites>"))
    )


def html(findings: DataFrame) -> DataFrame:
    """A page with a table of the findings; what comes from the data is escaped, and nothing is run or loaded."""
    rows = _numbered(findings)
    cells = F.concat(*(F.concat(F.lit("<td>"), escape_xml(clean_control(F.coalesce(F.col(c).cast("string"), F.lit("")))), F.lit("</td>")) for c in ("path", "line", "detector_id", "service", "severity_rank", "credential_hash")))
    head = F.concat(F.lit("<p>"), F.col("n").cast("string"), F.lit(" findings of "), F.col("n_detectors").cast("string"), F.lit(" detectors</p><table>"))
    return (
        _fixed(findings, 0, "<!doctype html><html><head><meta charset='utf-8'><title>Findings</title><style>td{border:1px solid #ccc;padding:2px 6px}</style></head><body>")
        .unionByName(_line(_counts(findings), 1, F.lit(0), head))
        .unionByName(_line(rows, 2, F.col("place"), F.concat(F.lit("<tr>"), cells, F.lit("</tr>"))))
        .unionByName(_fixed(findings, 3, "</table></body></html>"))
    )


def boxes(findings: DataFrame, width: int = 10) -> DataFrame:
    """Text for a terminal: three lines for each finding, with a bar for its confidence."""
    rows = _numbered(findings)
    filled = F.round(F.col("confidence") * width).cast("int")
    bar = F.concat(F.repeat(F.lit("█"), filled), F.repeat(F.lit("░"), F.lit(width) - filled))
    where = F.concat(F.coalesce("path", F.lit("")), F.lit(":"), F.col("line").cast("string"))
    text = F.array(F.concat(F.lit("┌ "), "detector_id", F.lit(" ("), "service", F.lit(")")), F.concat(F.lit("│ "), clean_control(where)), F.concat(F.lit("└ "), bar))
    lines = rows.select("place", F.posexplode(text).alias("n", "line"))
    return lines.select(F.lit(0).alias("part"), (F.col("place") * 3 + F.col("n")).cast("long").alias("place"), "line")
