"""Scan state over runs: what was scanned with which detectors, and what was found, in a folder with versions.

A version is two tables, files (path, stamp) and findings, in a folder of its own. A small manifest, ``current.json``, names the version that holds; it is written beside and
renamed over the old one when both tables are there, so a run that dies leaves the state as it was. Versions that no manifest names are left alone.

Nulls, ties and odd rows: a path that is listed twice with one stamp is scanned once or kept once; a null text is never scanned; a state that can't be used, for whatever of the
reasons in OUTCOMES, means that everything is scanned.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.operators import resolve

from . import engine
from .detectors import BUILT_IN, Detector

VERSION = 1
OUTCOMES = ("loaded", "missing", "unreadable", "malformed", "schema_mismatch", "spec_changed")


def spec_hash(detectors: tuple[Detector, ...], policy: str) -> str:
    """One digest for the detectors, weights included, and the policy."""
    return hashlib.sha256(repr((sorted((repr(d), repr(sorted(d.weights.items()))) for d in detectors), policy)).encode()).hexdigest()


@dataclass(frozen=True)
class Loaded:
    outcome: str
    files: DataFrame | None = None
    findings: DataFrame | None = None


def _context(spark: SparkSession, folder: str):
    jvm = spark._jvm.org.apache.hadoop.fs
    place = jvm.Path(folder)
    return jvm, place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def load(spark: SparkSession, folder: str, spec: str) -> Loaded:
    """The state of a folder, or why there is none that can be used."""
    jvm, _, system = _context(spark, folder)
    manifest = jvm.Path(f"{folder}/current.json")
    try:
        if not system.exists(manifest):
            return Loaded("missing")
        text = "\n".join(r[0] for r in spark.read.text(f"{folder}/current.json").collect())  # one small object
    except (PySparkException, Py4JError):
        return Loaded("unreadable")
    try:
        said = json.loads(text)
        version, known, name = said["version"], said["spec"], said["run"]
    except (ValueError, KeyError, TypeError):
        return Loaded("malformed")
    if version != VERSION:
        return Loaded("schema_mismatch")
    if known != spec:
        return Loaded("spec_changed")
    try:
        return Loaded("loaded", spark.read.parquet(f"{folder}/{name}/files"), spark.read.parquet(f"{folder}/{name}/findings"))
    except PySparkException:
        return Loaded("unreadable")


def swap(spark: SparkSession, folder: str, name: str, spec: str) -> None:
    """Make a written version the one that holds: a rename over the old manifest."""
    jvm, _, system = _context(spark, folder)
    beside = jvm.Path(f"{folder}/{name}/manifest.json")
    out = system.create(beside, True)
    out.write(bytearray(json.dumps({"version": VERSION, "spec": spec, "run": name}).encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.FileContext.getFileContext(system.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(system.makeQualified(beside), system.makeQualified(jvm.Path(f"{folder}/current.json")), options)


def incremental_scan(
    chunks: DataFrame, folder: str, detectors: tuple[Detector, ...] = BUILT_IN, policy: str = "default", controls: engine.Controls = engine.Controls(), stamp: Column | None = None
) -> tuple[DataFrame, str]:
    """Findings of ``chunks``, scanning only what the state in ``folder`` doesn't know, and how the state was loaded; the new state takes its place.

    ``stamp``: what changes when a path's content does, such as size and time of a file; by default the text's digest. With a stamp that is no function of the text, texts that are
    known aren't read. Kept findings are judged by this run's baseline and triage, too; a path that is not among the chunks any more has no findings.
    """
    spark, spec, name = chunks.sparkSession, spec_hash(detectors, policy), f"run-{uuid.uuid4().hex}"
    state = load(spark, folder, spec)
    rows = chunks.withColumn("_stamp", (stamp if stamp is not None else F.sha2("text", 256)).cast("string"))
    fresh, kept, key = rows, None, ["path", "_stamp"]
    if state.outcome == "loaded":
        known = state.files.select("path", F.col("stamp").alias("_stamp")).distinct()
        fresh = rows.join(known, key, "left_anti")
        same = rows.select(*key).distinct().join(known, key, "left_semi").select("path").distinct()
        kept = state.findings.join(same, "path", "left_semi")
        for table in (controls.baseline, controls.triage):
            kept = resolve.not_in_baseline(kept, table) if table is not None else kept
    found = engine.full_scan(fresh.drop("_stamp"), detectors, policy, controls=controls)
    found = found if kept is None else found.unionByName(kept)
    found.write.parquet(f"{folder}/{name}/findings")
    rows.select("path", F.col("_stamp").alias("stamp")).distinct().write.parquet(f"{folder}/{name}/files")
    swap(spark, folder, name, spec)
    return spark.read.parquet(f"{folder}/{name}/findings"), state.outcome
