"""State of scans over runs: what is skipped, what is kept, and what a run that dies leaves."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from siftlake.plans import engine, state
from siftlake.plans.detectors import BUILT_IN

CHUNK = "doc_id long, path string, text string, base_line long, base_offset long"
TOKENS = [f"ghp_{k}aZ9bY8cX7dW6eV5fU4gT3hS2iR1jQ0kP9lO"[:40] for k in range(5)]
DETECTORS = BUILT_IN[1:2]


def rows(spark, *texts):
    return spark.createDataFrame([(k, f"src/{k}.py", t, 0, 0) for k, t in enumerate(texts)], CHUNK)


def test_runs_scan_what_is_new(spark, tmp_path, monkeypatch):
    folder, scanned = str(tmp_path / "state"), []
    real = engine.full_scan
    monkeypatch.setattr(state.engine, "full_scan", lambda chunks, *a, **k: (scanned.append(sorted(r.path for r in chunks.select("path").collect())), real(chunks, *a, **k))[1])
    run = lambda chunks, **more: (lambda f, o: (sorted(r.path for r in f.where("channel = 'pattern'").collect()), o))(*state.incremental_scan(chunks, folder, DETECTORS, "fast", **more))
    first = rows(spark, f"t = {TOKENS[0]}", f"t = {TOKENS[1]}", "nothing", None)
    assert run(first) == (["src/0.py", "src/1.py"], "missing")
    second = rows(spark, f"t = {TOKENS[0]}", "gone", f"t = {TOKENS[2]}", None)
    triage = spark.createDataFrame([(DETECTORS[0].id, hashlib.sha256(TOKENS[0].encode()).hexdigest())], "detector_id string, credential_hash string")
    before = json.loads((tmp_path / "state" / "current.json").read_text())
    with monkeypatch.context() as m:  # dies between the tables and the manifest
        m.setattr(state, "swap", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            run(second)
    assert json.loads((tmp_path / "state" / "current.json").read_text()) == before
    assert run(second) == (["src/0.py", "src/2.py"], "loaded") and scanned[1:] == [["src/1.py", "src/2.py", "src/3.py"]] * 2
    assert run(second, controls=engine.Controls(triage=triage)) == (["src/2.py"], "loaded")


def test_outcomes_of_loading(spark, tmp_path):
    folder, spec = str(tmp_path), state.spec_hash(DETECTORS, "fast")
    manifest = tmp_path / "current.json"
    told = []
    told.append(state.load(spark, folder, spec).outcome)
    for text in ("not json", json.dumps({"version": 99, "spec": spec, "run": "r"}), json.dumps({"version": 1, "spec": "other", "run": "r"}), json.dumps({"version": 1, "spec": spec, "run": "r"})):
        manifest.write_text(text)
        told.append(state.load(spark, folder, spec).outcome)
    for table in ("files", "findings"):
        spark.range(1).select(F.lit("p").alias("path")).write.parquet(f"{folder}/r/{table}")
    told.append(state.load(spark, folder, spec).outcome)
    assert told == ["missing", "malformed", "schema_mismatch", "spec_changed", "unreadable", "loaded"]
    assert state.spec_hash(DETECTORS, "fast") != state.spec_hash(DETECTORS, "deep") != state.spec_hash(BUILT_IN[:1], "deep")
