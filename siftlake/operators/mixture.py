"""A mixture of experts that scores candidates: a gate weighs small networks, and their logits' weighted sum becomes a probability.

Features are DataFrame functions. Fitting is full-batch: each step is one Spark job in which every task sums the gradient over its rows, batch by batch, and Spark adds the sums by
place; the driver holds parameters only. Scoring evaluates batches in numpy.

The fit reads at most ``SAMPLE`` labelled rows, chosen by a digest of value and line, so that reruns agree whatever the partitions; scoring covers all rows.

Nulls and odd rows: rows with a null value, line or label aren't fitted; a null value or line scores as the empty text; equal rows count as often as they occur; a table with labels
of one kind only can't be fitted (ValueError), nor can an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake import storage
from siftlake.functions import text as T

from . import score
from .context import ASSIGNED, COMMENT, DOCUMENTATION_PATH, TEST_PATH

#: Rows that a fit reads, about.
SAMPLE = 50_000
EXPERTS, HIDDEN = 6, (16, 8)
#: Beyond this logit a probability is 0 or 1 as far as the score goes.
SATURATED = 6.0

DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _share(v: Column, letters: str) -> Column:
    return (F.length(v) - F.length(F.translate(v, letters, ""))) / F.greatest(F.length(v), F.lit(1))


def feature_columns(value: Column, line: Column, path: Column) -> dict[str, Column]:
    """What the model sees of a candidate, by name: the value's statistics and shape, its line, and its path."""
    v, own, low = F.coalesce(value, F.lit("")), F.coalesce(line, F.lit("")), F.lower(F.coalesce(path, F.lit("")))
    flag = lambda c: c.cast("double")
    held = lambda rx: flag(v.rlike(rx))
    return {
        "length": F.least(F.length(v), F.lit(128)) / 64,
        "entropy": T.byte_entropy(v),
        "diversity": F.when(v == "", 0.0).otherwise(T.char_diversity(v)),
        "longest_run": F.coalesce(T.longest_run(v), F.lit(0)) / F.greatest(F.length(v), F.lit(1)),
        "digits": _share(v, DIGITS),
        "lower": _share(v, LOWER),
        "upper": _share(v, UPPER),
        "vowels": _share(F.lower(v), "aeiou"),
        "hex": held("^[0-9a-fA-F]+$"),
        "base64": held("^[A-Za-z0-9+/]{16,}={0,2}$"),
        "uuid": held("^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"),
        "words": held("[a-z]{5,}[ _./-][a-z]{5,}"),
        "path_like": held(r"^[./~]|/[A-Za-z_.]+/|\.[a-z]{2,4}$"),
        "turns": F.regexp_count(v, F.lit("[a-z][0-9]|[0-9][a-z]|[A-Z][0-9]|[0-9][A-Z]|[a-z][A-Z]")) / F.greatest(F.length(v), F.lit(1)),
        "prefix": held("^[A-Za-z]{2,8}[_-]"),
        "placeholder": flag(score.is_placeholder(v)),
        "keyword": flag(own.rlike("(?i)token|secret|passw|key|bearer|auth|credential")),
        "digest_word": flag(own.rlike("(?i)sha[0-9]|md5|hash|digest|checksum|commit|uuid")),
        "assigned": flag(own.rlike(ASSIGNED)),
        "comment": flag(own.rlike(COMMENT)),
        "alone": flag(F.trim(own) == v),
        "test_path": flag(low.rlike(TEST_PATH)),
        "documentation": flag(low.rlike(DOCUMENTATION_PATH)),
        "sensitive_path": flag(score.sensitive_path(F.coalesce(path, F.lit("")))),
    }


def features(value: Column, line: Column, path: Column) -> Column:
    return F.array(*(c.cast("double") for c in feature_columns(value, line, path).values()))


FEATURES = 24


def _shapes(n: int, experts: int, hidden: tuple[int, int]) -> list[tuple[int, ...]]:
    """Gate, then three layers of each expert, weights and biases."""
    a, b = hidden
    return [(n, experts), (experts,), (experts, n, a), (experts, a), (experts, a, b), (experts, b), (experts, b), (experts,)]


@dataclass(frozen=True)
class Mixture:
    """``mean`` and ``spread`` standardise the features; ``parameters`` are all weights in one row."""

    mean: np.ndarray
    spread: np.ndarray
    parameters: np.ndarray
    experts: int = EXPERTS
    hidden: tuple[int, int] = HIDDEN

    def _parts(self) -> list[np.ndarray]:
        parts, at = [], 0
        for shape in _shapes(len(self.mean), self.experts, self.hidden):
            size = int(np.prod(shape))
            parts.append(self.parameters[at : at + size].reshape(shape))
            at += size
        return parts

    def _forward(self, x: np.ndarray):
        gw, gb, w1, b1, w2, b2, w3, b3 = self._parts()
        x = (x - self.mean) / self.spread
        gate = x @ gw + gb
        gate = np.exp(gate - gate.max(axis=1, keepdims=True))
        gate /= gate.sum(axis=1, keepdims=True)
        first = np.maximum(np.einsum("mn,kna->mka", x, w1) + b1, 0)
        second = np.maximum(np.einsum("mka,kab->mkb", first, w2) + b2, 0)
        each = np.einsum("mkb,kb->mk", second, w3) + b3
        return x, gate, first, second, each, (gate * each).sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        logit = self._forward(x)[-1]
        return np.where(logit >= SATURATED, 1.0, np.where(logit <= -SATURATED, 0.0, 1 / (1 + np.exp(-np.clip(logit, -SATURATED, SATURATED)))))

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
        """The log loss summed over the rows, and its derivative by all parameters."""
        _, _, w1, _, w2, _, w3, _ = self._parts()
        x, gate, first, second, each, logit = self._forward(x)
        loss = float((np.logaddexp(0, logit) - y * logit).sum())
        d = 0.5 * (1 + np.tanh(logit / 2)) - y
        d_gate = d[:, None] * gate * (each - logit[:, None])
        d_each = d[:, None] * gate
        d_second = d_each[:, :, None] * w3 * (second > 0)
        d_first = np.einsum("mkb,kab->mka", d_second, w2) * (first > 0)
        found = [x.T @ d_gate, d_gate.sum(0), np.einsum("mn,mka->kna", x, d_first), d_first.sum(0), np.einsum("mka,mkb->kab", first, d_second), d_second.sum(0), np.einsum("mk,mkb->kb", d_each, second), d_each.sum(0)]
        return np.concatenate([g.ravel() for g in found]), loss


def initial(mean: np.ndarray, spread: np.ndarray, experts: int = EXPERTS, hidden: tuple[int, int] = HIDDEN, seed: int = 7) -> Mixture:
    pick = np.random.default_rng(seed)
    parts = [pick.normal(0, np.sqrt(2 / shape[-2]), shape) if k in (0, 2, 4) else pick.normal(0, np.sqrt(1 / shape[-1]), shape) if k == 6 else np.zeros(shape) for k, shape in enumerate(_shapes(len(mean), experts, hidden))]
    return Mixture(mean, spread, np.concatenate([p.ravel() for p in parts]), experts, hidden)


def gradient_of(table: DataFrame, model: Mixture) -> tuple[np.ndarray, float]:
    """The mean gradient and loss over a table (x array<double>, y double): sums in the tasks, added by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(model.parameters) + 2)
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                g, loss = model.gradient(x, batch.column("y").to_numpy(zero_copy_only=False))
                total += np.concatenate([g, [loss, batch.num_rows]])
        yield pa.RecordBatch.from_pydict({"at": np.arange(len(total)), "part": total})

    rows = table.select("x", "y").mapInArrow(run, "at long, part double").groupBy("at").agg(F.sum("part").alias("total")).collect()  # one row for each parameter
    total = np.zeros(len(model.parameters) + 2)
    for r in rows:
        total[r.at] = r.total
    return total[:-2] / total[-1], float(total[-2] / total[-1])


def sampled(rows: DataFrame, sample: int) -> DataFrame:
    """About ``sample`` of the labelled rows, by a digest; all, if there are fewer."""
    known = rows.where("value IS NOT NULL AND line IS NOT NULL AND label IS NOT NULL")
    n = known.count()
    place = F.conv(F.substring(F.sha2(F.concat_ws("\x1f", "value", "line"), 256), 1, 8), 16, 10).cast("long")
    return known.where(place < int(min(1.0, sample / max(n, 1)) * (1 << 32))) if n > sample else known


def fit(rows: DataFrame, steps: int = 60, rate: float = 0.02, sample: int = SAMPLE, experts: int = EXPERTS, hidden: tuple[int, int] = HIDDEN) -> Mixture:
    """A model of labelled candidates (value, line, path, label boolean), by Adam over ``steps`` full passes. Both labels weigh what their rows do."""
    spark, path = rows.sparkSession, storage.shared_path(rows.sparkSession, "mixture")
    x = features(F.col("value"), F.col("line"), F.col("path"))
    sampled(rows, sample).select(x.alias("x"), F.col("label").cast("double").alias("y")).write.parquet(path)
    table = spark.read.schema("x array<double>, y double").parquet(path)
    at = range(FEATURES)
    told = table.agg(F.min("y"), F.max("y"), *(F.avg(F.get("x", F.lit(k))) for k in at), *(F.stddev_pop(F.get("x", F.lit(k))) for k in at)).first()
    if told[0] is None or told[0] == told[1]:
        raise ValueError("a fit needs rows of both labels")
    mean, spread = np.array(told[2 : 2 + FEATURES]), np.array(told[2 + FEATURES :])
    model = initial(mean, np.where(spread > 1e-9, spread, 1.0), experts, hidden)
    first, second = np.zeros_like(model.parameters), np.zeros_like(model.parameters)
    for k in range(1, steps + 1):
        g, _ = gradient_of(table, model)
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        step = rate * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.999**k)) + 1e-8)
        model = Mixture(model.mean, model.spread, model.parameters - step, experts, hidden)
    return model


def probability(model: Mixture, value: Column, line: Column, path: Column) -> Column:
    """The model's probability that a candidate is a credential."""

    @F.pandas_udf("double")
    def evaluate(x: pd.Series) -> pd.Series:
        return pd.Series(model.probability(np.stack(x.to_numpy())) if len(x) else [], dtype="float64")

    return evaluate(features(value, line, path))
