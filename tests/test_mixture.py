"""The mixture of experts against numpy and by held-out accuracy."""

import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftlake.operators import mixture
from siftlake.plans import engine
from siftlake.plans.detectors import BUILT_IN


def labelled(n, seed):
    """Random tokens in assignments, and words, paths, digests and placeholders in lines of many kinds."""
    pick = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    words = "alpha build config cluster default deploy engine function gateway handler index library module network".split()
    rows = []
    for k in range(n):
        if k % 2:
            v = "".join(pick.choices(letters, k=pick.randint(20, 44)))
            rows.append((v, f'{pick.choice(["token", "secret", "api_key"])} = "{v}"', "src/a.py", True))
        else:
            v = pick.choice(["_".join(pick.choices(words, k=4)), "/".join(pick.choices(words, k=4)), str(uuid.UUID(int=pick.getrandbits(128))), "%064x" % pick.getrandbits(256), "your_api_key_" + pick.choice(words)])
            rows.append((v, pick.choice([f'key = "{v}"', f"see {v}", f"# sha256 {v}", f"token: {v}"]), pick.choice(["src/a.py", "docs/a.md"]), False))
    return rows


SCHEMA = "value string, line string, path string, label boolean"


def test_gradient_is_the_slope_of_the_loss():
    pick = np.random.default_rng(1)
    x, y = pick.normal(size=(9, 5)), pick.integers(0, 2, 9).astype(float)
    model = mixture.initial(x.mean(0), x.std(0), 3, (4, 3))
    model = mixture.Mixture(model.mean, model.spread, model.parameters + pick.normal(0, 0.1, len(model.parameters)), 3, (4, 3))  # off the bends
    g, _ = model.gradient(x, y)
    for k in pick.integers(0, len(g), 40):
        moved = [mixture.Mixture(model.mean, model.spread, model.parameters + d * (np.arange(len(g)) == k), 3, (4, 3)).gradient(x, y)[1] for d in (1e-6, -1e-6)]
        assert abs((moved[0] - moved[1]) / 2e-6 - g[k]) < 1e-4


def test_fit_scores_held_out_rows(spark):
    rows = spark.createDataFrame([*labelled(600, 1), (None, None, None, True), ("x", "y", "z", None)], SCHEMA)
    model = mixture.fit(rows, steps=25, rate=0.05)
    held = spark.createDataFrame(labelled(300, 2), SCHEMA).withColumn("p", mixture.probability(model, F.col("value"), F.col("line"), F.col("path"))).withColumn("x", mixture.features(F.col("value"), F.col("line"), F.col("path")))
    found = held.collect()
    assert np.mean([(r.p > 0.5) == r.label for r in found]) > 0.97
    x = np.array([r.x for r in found])
    assert x.shape == (300, mixture.FEATURES) and np.isfinite(x).all()

    def alone(v):  # the definition, row by row
        gw, gb, w1, b1, w2, b2, w3, b3 = model._parts()
        v = (v - model.mean) / model.spread
        gate = np.exp(v @ gw + gb)
        logits = [np.maximum(np.maximum(v @ w1[k] + b1[k], 0) @ w2[k] + b2[k], 0) @ w3[k] + b3[k] for k in range(model.experts)]
        z = float(gate @ np.array(logits) / gate.sum())
        return 1.0 if z >= 6 else 0.0 if z <= -6 else 1 / (1 + np.exp(-z))

    assert np.allclose([r.p for r in found], [alone(v) for v in x])
    table = held.select("x", F.col("label").cast("double").alias("y")).repartition(7)
    g, loss = mixture.gradient_of(table, model)
    whole, total = model.gradient(x, np.array([float(r.label) for r in found]))
    assert np.allclose(g, whole / 300) and abs(loss - total / 300) < 1e-9

    chunk = "doc_id long, path string, text string, base_line long, base_offset long"
    token, digest = "aZ3kP0qW9xY7bN2mT5vR8cL1", "%040x" % random.Random(3).getrandbits(160)
    chunks = spark.createDataFrame([(1, "a.py", f"auth_token = '{token}'\nsee commit_key {digest}", 0, 0)], chunk)
    scores = lambda **more: {r.redacted: r.confidence for r in engine.explain(chunks, BUILT_IN[1:2], "fast", engine.Controls(**more)).where("channel = 'assignment'").collect()}
    plain, judged = scores(), scores(model=model)
    assert plain.keys() == judged.keys() and all(judged[k] != plain[k] for k in plain)


def test_odd_rows(spark):
    with pytest.raises(ValueError):
        mixture.fit(spark.createDataFrame([], SCHEMA), steps=1)
    with pytest.raises(ValueError):
        mixture.fit(spark.createDataFrame(labelled(40, 1)[1::2], SCHEMA), steps=1)
    model = mixture.initial(np.zeros(mixture.FEATURES), np.ones(mixture.FEATURES))
    odd = spark.createDataFrame([(None, None, None), ("", "", ""), ("x" * 100_000, None, "p")], "value string, line string, path string")
    p = [r.p for r in odd.select(mixture.probability(model, F.col("value"), F.col("line"), F.col("path")).alias("p")).collect()]
    assert p[0] == p[1] and all(0 <= v <= 1 for v in p)
    many = spark.createDataFrame(labelled(400, 4), SCHEMA)
    n = mixture.sampled(many, 100).count()
    assert 50 < n < 160 and n == mixture.sampled(many.repartition(5), 100).count()
