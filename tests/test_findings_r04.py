"""What the fourth review found."""

from pyspark.sql import functions as F

from siftlake.plans import engine

CHUNK = "doc_id long, path string, text string, base_line long, base_offset long"


def test_a_reported_value_is_not_reported_decoded_again(spark):
    # The passwords are base64 of UTF-8 by chance; the last line's value only stands in code.
    import base64

    token = "ghp_aZ9bY8cX7dW6eV5fU4gT3hS2iR1jQ0kP9lOm"
    texts = ["url=postgres://app:fda7068bb295@db.example.com/x", "url=postgres://app:0bd4a31bed6b@db.example.com/x", "blob " + base64.b64encode(f"x {token} y".encode()).decode()]
    chunks = spark.createDataFrame([(k, f"f{k}", t, 0, 0) for k, t in enumerate(texts)], CHUNK)
    found = engine.full_scan(chunks).where("detector_id IN ('connection-string', 'github-classic-pat')").collect()
    assert sorted((r.doc_id, r.detector_id, r.channel) for r in found) == [(0, "connection-string", "pattern"), (1, "connection-string", "pattern"), (2, "github-classic-pat", "decoded")]
    stages = {(r.doc_id, r.stage) for r in engine.explain(chunks, policy="default").where("detector_id = 'connection-string' AND channel = 'decoded'").collect()}
    assert stages >= {(0, "decoded_of_finding"), (1, "decoded_of_finding")}


def test_fragments_of_a_stream_meet_only_what_is_near(spark):
    from datetime import datetime, timedelta
    from random import Random

    from siftlake.streaming.events import fragment_stream

    rng, begin = Random(4), datetime(2026, 1, 1)
    rows = [("p", rng.choice("ab"), line, f"v{line}", begin + timedelta(minutes=rng.randrange(300))) for line in sorted({rng.randrange(-900, 2000) for _ in range(700)} | {0, 399, 400, 499, 500, 1199, 1200, 1299, 1300})]
    pairs = fragment_stream(spark.createDataFrame(rows, "path string, prefix string, line long, value string, ts timestamp"), 100, "1 hour")
    close = lambda a, b: a[1] == b[1] and a[2] != b[2] and abs(a[2] - b[2]) < 100 and abs(a[4] - b[4]) <= timedelta(hours=1)
    assert sorted((r.prefix, r.line, r.line_b, r.joined) for r in pairs.collect()) == sorted((a[1], a[2], b[2], a[3] + b[3]) for a in rows for b in rows if close(a, b))
    # Not only path and prefix are equal in the join, so what a fragment meets doesn't grow with the table.
    join = next(x for x in pairs._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in x)
    assert "_at#" in join and "_at_b#" in join


def test_reachability_broadcasts_no_table_of_jumps(spark, monkeypatch):
    # On disk these tables are small whatever they hold, so the planner would take them for small ones.
    from siftlake.sources import packages

    plans, stored = [], packages.stored

    def seen(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return stored(df, name)

    monkeypatch.setattr(packages, "stored", seen)
    edges = spark.range(2, 4000).selectExpr("id AS a", "id div 2 AS b").unionByName(spark.createDataFrame([(4000, 77), (4000, 3999), (9000, 9001), (9001, 9000)], "a long, b long"))
    for few in (packages.FEW, 2):
        monkeypatch.setattr(packages, "FEW", few)
        found = packages.reached(spark.createDataFrame([(4000,), (1500,), (9000,)], "node long"), edges)
        parents, wanted, front = {}, set(), {4000, 1500, 9000}
        for a, b in [(k, k // 2) for k in range(2, 4000)] + [(4000, 77), (4000, 3999), (9000, 9001), (9001, 9000)]:
            parents.setdefault(a, set()).add(b)
        while front:
            wanted |= front
            front = {b for a in front for b in parents.get(a, ())} - wanted
        assert sorted(r.node for r in found.collect()) == sorted(wanted)
        assert ("BroadcastHashJoin" in found.sparkSession.range(9).join(found, F.col("id") == F.col("node"), "left")._jdf.queryExecution().executedPlan().toString()) == (few > 2)
    assert not any("Broadcast" in plan for name, plan in plans if name in ("jump", "others"))


def test_blobs_are_placed_by_one_cut_of_a_text(spark):
    import base64

    from siftlake.operators import decode

    said = base64.b64encode(b"token of several words").decode()
    text = " ".join(f"neverdecodesatall{k}" if k % 7 else said for k in range(50)) + "\n" + "5c6e" * 6
    inner = decode.spliced(spark.createDataFrame([(1, "f", text, 0, 0), (2, "f", "plain", 0, 0), (3, "f", None, 0, 0)], CHUNK), ("base64", "hex", "url", "json"))
    assert [x for x in inner._jdf.queryExecution().optimizedPlan().toString().splitlines() if "aggregate(sequence(" in x and "split(text" in x] == []  # a lambda's expressions are computed for each blob
    places, at = [], text.find(said)
    while at >= 0:
        places.append(at)
        at = text.find(said, at + 1)
    rows = inner.collect()
    assert sorted(r.base_offset + len(r.text.encode()[: r.span.start]) for r in rows if r.via == "base64") == places and len(places) == 8
    assert [(r.text[r.span.start : r.span.end], r.base_line + r.text[: r.span.start].count("\n")) for r in rows if r.via == "hex"] == [("\\n" * 6, 1)]


def test_a_pattern_goes_over_a_text_once_and_marks_are_counted_where_they_are(spark):
    from siftlake.operators import context, extract, windows
    from siftlake.plans.detectors import BUILT_IN

    rows = spark.createDataFrame([(1, "f", "ghp_" + "a1B2" * 9, 0, 0)], CHUNK)
    plan = extract.scan(rows, BUILT_IN[1:2], context=True)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(text") == 1
    texts = ["", None, "a", '"""x""""', "```\n ```\n```", "-----BEGIN PGP MESSAGE-----\n$ANSIBLE_VAULT;1\n-----END PGP MESSAGE-----", "-----BEGIN PGP"]
    for mark in (*windows.MARKS.values(), context.BEGIN_ENCRYPTED, context.END_ENCRYPTED):
        if mark:
            both = spark.createDataFrame([(t,) for t in texts], "t string").select(context.marked(F.col("t"), mark), F.coalesce(F.regexp_count("t", F.lit(mark)), F.lit(0))).collect()
            assert all(a == b for a, b in both)
