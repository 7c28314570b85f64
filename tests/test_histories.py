"""Composed histories and reachability by doubling, against plain loops."""

import random

import numpy as np
from pyspark.sql import functions as F

from siftlake.sources import packages
from siftlake.streaming import composed, events


def test_final_states_and_pauses_equal_a_loop(spark):
    rng = random.Random(3)
    kinds = [*events.KINDS, "overflow", "error", "policy", "stop", "other", None]
    log = [(root, rng.choice(kinds[:8] if k % 50 else kinds), k) for k in range(3000) for root in ([1] if k % 3 else [2, 3])] + [(None, "create", 1)]
    rng.shuffle(log)
    expected = {}
    for root, kind, seq in sorted(log, key=lambda x: x[2]):
        state = expected.get(root, ("indexing", 0))[0]
        expected[root] = (events.STATES[state].get(kind, state), seq)
    df = spark.createDataFrame(log, "root long, kind string, seq long").withColumn("element", F.lit("mine"))
    found = {r.root: (r.state, r.last_seq) for r in events.final_states(df.repartition(5)).collect()}
    assert found == expected
    plan = events.final_states(df)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan

    answers = [(s, k, rng.choice([429, 429, 500, 200, 200, 301, None])) for k in range(800) for s in ("a", "b")] + [("c", k, 429) for k in range(1500)] + [("d", 1, 200)]
    pause, errors = {}, {}
    for s, _, status in sorted(answers, key=lambda x: x[1]):
        p = pause.get(s, 0.5)
        limited, failed = status == 429, status is not None and status >= 500
        pause[s] = min(8.0, p * 2) if limited else 0.5 + (p - 0.5) / 2
        errors[s] = errors.get(s, 0) + 1 if limited or failed else 0
    df = spark.createDataFrame(answers, "service string, seq long, status int").repartition(6)
    found = {r.service: (r.pause, r.pressed, r.n) for r in events.rate_limits(df, most_errors=3).collect()}
    assert {s: (f[0], f[1]) for s, f in found.items()} == {s: (round(pause[s], 6), errors[s] > 3) for s in pause}
    assert found["c"][2] == 1500 and events.rate_limits(df.where("false")).count() == 0 and events.final_states(spark.createDataFrame([], "root long, kind string, seq long")).count() == 0


def test_composition_is_associative():
    rng = np.random.default_rng(2)
    maps = rng.integers(0, 7, (3, 50, 7)).astype(float)
    assert np.array_equal(composed.then(composed.then(*maps[:2]), maps[2]), composed.then(maps[0], composed.then(*maps[1:])))
    assert np.array_equal(composed.reduced(maps[0], composed.then), [_walk(maps[0], s) for s in range(7)])


def _walk(maps, state):
    for m in maps:
        state = m[int(state)]
    return state


def test_numbers_of_rows(spark):
    rows = spark.createDataFrame([(k * 7 % 1000,) for k in range(1000)] + [(5,), (5,)], "x long").repartition(9)
    found = composed.numbered(rows, "x").collect()
    assert sorted(r.number for r in found) == list(range(1, 1003))
    assert [r.x for r in sorted(found, key=lambda r: r.number)] == sorted(r.x for r in found)


def test_reached_in_few_rounds(spark, monkeypatch):
    """A line of 2,000 commits, merges, a cycle, and scopes; the number of written tables is that of a logarithm."""
    n = 2000
    written = []
    real = packages.stored
    monkeypatch.setattr(packages, "stored", lambda df, name: (written.append(name), real(df, name))[1])
    line = spark.createDataFrame([(k, k - 1) for k in range(1, n)], "a long, b long")
    seen = {r.node for r in packages.reached(spark.createDataFrame([(n // 2,)], "node long"), line).collect()}
    assert seen == set(range(n // 2 + 1)) and len(written) < 40

    rng = random.Random(6)
    edges = [(s, k, rng.randrange(40)) for s in ("x", "y") for k in range(40) for _ in range(rng.choice([0, 1, 1, 2, 3]))] + [("x", 3, 3), ("y", 1, 2), ("y", 2, 1), ("y", None, 3)]
    starts = [("x", 3), ("x", 3), ("y", 1), ("z", 9)]
    expected = set(starts)
    while True:
        more = {(s, b) for s, a, b in edges if (s, a) in expected} - expected
        if not more:
            break
        expected |= more
    found = packages.reached(spark.createDataFrame(starts, "package string, node long"), spark.createDataFrame(edges, "package string, a long, b long"), "package").collect()
    assert sorted((r.package, r.node) for r in found) == sorted(expected)
    none = packages.reached(spark.createDataFrame([], "node long"), line)
    assert none.count() == 0 and packages.reached(spark.createDataFrame([(1,)], "node long"), line.where("false")).count() == 1


def _feed(spark, folder, rows, schema, number):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def _batch(spark, folder, schema, make, mode):
    """One run over what is new; a second run goes on from the checkpoint."""
    stream = make(spark.readStream.schema(schema).parquet(f"{folder}/in"))
    out = []
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(lambda df, n: out.extend(df.collect())).start()
    assert query.awaitTermination(60)
    return out


def test_machines_go_on_from_their_checkpoint(spark, tmp_path):
    schema, log = "root long, kind string, seq long", [(1, "barrier", 1), (1, "modify", 2), (2, "overflow", 3), (None, "stop", 4)]
    _feed(spark, tmp_path, log, schema, 0)
    first = {r.root: (r.state, r.last_seq) for r in _batch(spark, tmp_path, schema, events.root_machine, "update")}
    assert first == {1: ("dirty", 2), 2: ("degraded", 3), None: ("stopped", 4)}
    _feed(spark, tmp_path, [(1, "stop", 2), (1, "barrier", 5), (2, "reconcile", 6)], schema, 1)  # what is not newer is left out
    again = {r.root: (r.state, r.last_seq) for r in _batch(spark, tmp_path, schema, events.root_machine, "update")}
    assert again == {1: ("current", 5), 2: ("indexing", 6)}


def test_fragments_are_held_and_evicted(spark, tmp_path):
    from siftlake.streaming import machines

    schema = "path string, prefix string, line long, value string"
    make = lambda s: machines.fragment_cache(s, near=100, most=2)
    _feed(spark, tmp_path, [("p", "k", 1, "a"), ("p", "k", 1, "a"), ("p", "k", 5, "b"), ("q", "k", 1, "z")], schema, 0)
    assert {(r.line, r.line_b, r.joined) for r in _batch(spark, tmp_path, schema, make, "append")} == {(5, 1, "ba"), (1, 5, "ab")}
    _feed(spark, tmp_path, [("p", "k", 9, "c"), ("p", "k", 300, "d"), ("p", "k", 2, "e")], schema, 1)
    # 2 meets 1 and 5; (1, a) is the least of three and goes; 9 meets 2 and 5, and so on; 300 is near none.
    found = {(r.line, r.line_b) for r in _batch(spark, tmp_path, schema, make, "append")}
    assert found == {(2, 1), (1, 2), (2, 5), (5, 2), (9, 5), (5, 9), (9, 2), (2, 9)}


def test_composites_by_policies(spark):
    from siftlake.operators.resolve import Composite, correlated

    policies = (Composite("pair", ("a", "b"), ("c",)), Composite("triple", ("a", "b", "c"), scope="file", bonus=0.1), Composite("one", ("d",)))
    rows = [
        ("a", "1", "x/p", 0.5), ("a", "1", "x/q", 0.4), ("b", "2", "x/q", 0.6), ("c", "3", "x/r", 0.1),  # pair with its option; no triple, as no file has all
        ("a", "1", "y/p", 0.5), ("a", "9", "y/q", 0.5), ("b", "2", "y/p", 0.5),  # two values for a: silent
        ("a", "1", "z/p", 0.5), ("b", "2", "z/p", 0.5), ("c", "3", "z/p", 0.5), ("c", "4", "z/q", 0.5),  # triple in a file; pair without its option, which is ambiguous
        ("d", "5", "w", 0.95), ("d", None, "v/w", 0.9), ("d", "5", None, 0.9), ("e", "6", "x/p", 0.9),
    ]
    df = spark.createDataFrame(rows, "detector_id string, credential_hash string, path string, confidence double")
    found = {(r.policy, r.place): (r.mask, sorted(r.parts), round(r.confidence, 6)) for r in correlated(df, policies).collect()}
    assert found == {("pair", "x"): (7, ["a", "b", "c"], 0.95), ("pair", "z"): (3, ["a", "b"], 0.8), ("triple", "z/p"): (7, ["a", "b", "c"], 0.6), ("one", "w"): (1, ["d"], 1.0)}
    assert correlated(df.where("false"), policies).count() == 0
