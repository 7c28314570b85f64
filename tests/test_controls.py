"""What a caller says of findings changes what the whole scan reports, and explain names the stage."""

import hashlib

from siftlake.operators import resolve
from siftlake.plans import engine
from siftlake.plans.detectors import BUILT_IN, Detector, Pattern

CHUNK = "doc_id long, path string, text string, base_line long, base_offset long"
TOKENS = [f"ghp_{k}aZ9bY8cX7dW6eV5fU4gT3hS2iR1jQ0kP9lO"[:40] for k in range(9)]
digest = lambda v: hashlib.sha256(v.encode()).hexdigest()
ID = "github-classic-pat"


def test_every_control_is_a_stage(spark):
    texts = {
        "src/a.py": f"t = {TOKENS[0]}",
        "src/b.py": f"t = {TOKENS[1]}  # siftlake:ignore",
        "src/c.py": f"# siftlake:ignore-next detector={ID}\nt = {TOKENS[2]}",
        "src/d.py": f"# siftlake:ignore-next detector=other\nt = {TOKENS[3]}",
        "vendor/x/e.py": f"t = {TOKENS[4]}",
        "src/f.py": f"t = {TOKENS[5]}",
        "src/g.py": f"t = {TOKENS[6]}",
        "src/h.py": f"t = {TOKENS[7]}",
        "src/i.py": f"t = {TOKENS[8]}",
        "src/j.py": f"commit_secret = {'0a1b2c3d' * 5}\n",
        "a" * 40 + ":src/k.py": "stripe pk_live_" + "a1B2c3D4" * 3,
    }
    chunks = spark.createDataFrame([(k, p, t, 0, 0) for k, (p, t) in enumerate(texts.items())], CHUNK)
    key = "detector_id string, credential_hash string"
    controls = engine.Controls(
        rules=({"path_ends_with": "f.py", "detector": ID},), allow=("vendor/**",), fixtures=(TOKENS[6],), fixture_parts=("none such",),
        calibration=spark.createDataFrame([(ID, 9.0, 1.0)], "detector_id string, alpha double, beta double"),
        verified=spark.createDataFrame([(digest(TOKENS[0]), "live"), (digest(TOKENS[0]), "dead"), (digest(TOKENS[3]), "revoked")], "credential_hash string, outcome string"),
        baseline=spark.createDataFrame([(ID, digest(TOKENS[7])), (ID, digest(TOKENS[7])), (ID, None)], key),
        triage=spark.createDataFrame([(ID, digest(TOKENS[8]))], key),
    )
    client = tuple(d for d in BUILT_IN if d.id == ID) + (Detector("stripe-public", "S", "stripe", "critical", ("pk_live_",), (Pattern(r"pk_live_[A-Za-z0-9]{24}"), Pattern("pk_live_a1B2c3D4", client_safe=True))),)
    stages = {(r.path, r.detector_id): r.stage for r in engine.explain(chunks, client, "fast", controls).where("channel = 'pattern'").collect()}
    assert {p: s for (p, d), s in stages.items() if d == ID} == {
        "src/a.py": "reported", "src/b.py": "inline_directive", "src/c.py": "inline_directive", "src/d.py": "reported", "vendor/x/e.py": "allowed_path",
        "src/f.py": "rule", "src/g.py": "fixture_value", "src/h.py": "in_baseline", "src/i.py": "triaged",
    }
    found = {r.path: r for r in engine.full_scan(chunks, client, "fast", controls=controls).where("channel = 'pattern'").collect()}
    assert set(found) >= {"src/a.py", "src/d.py"} and not set(found) & {"src/b.py", "src/f.py", "src/h.py"}
    assert (found["src/a.py"].reason, found["src/a.py"].severity_rank) == ("live-verification", 5) and found["src/d.py"].severity_rank == 4
    plain = {r.path: r for r in engine.full_scan(chunks, client, "fast").collect()}
    assert found["src/a.py"].confidence == round(plain["src/a.py"].confidence * 0.9, 6)
    assert {r.severity_rank for r in engine.judged(engine.candidates(chunks, client, "fast"), client, "fast").where("detector_id = 'stripe-public'").collect()} == {4, 1}
    whole = engine.explain(chunks, client, "fast").where("path = 'src/j.py'").collect()
    assert {r.stage for r in whole if r.channel == "assignment"} == {"hex_digest"}
    # A baseline of a scan's own findings leaves nothing of them, other than a baseline that was joined behind it.
    own = engine.full_scan(chunks, client, "fast").select(*resolve.KEY)
    assert engine.full_scan(chunks, client, "fast", controls=engine.Controls(baseline=own)).where(f"detector_id = '{ID}'").count() == 0
