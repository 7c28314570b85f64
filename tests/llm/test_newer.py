"""Whitening, mixing and periodic runs: brute force over whole tables, and odd input."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from conftest import DATA
from siftlake.llm import mixing, periodic, queries, whitening
from siftlake.llm.common import table

# 11 Whitening


def numbers_of(vectors):
    return np.floor(np.array(vectors, float) * 1024).astype(np.int64) + 100000


def test_whitening_equals_numpy(spark):
    known = pq.read_table(f"{DATA}/embeddings.parquet").to_pylist()
    x = numbers_of([r["embedding"] for r in known])
    centred = x - x.mean(axis=0)
    covariance = centred.T @ centred / len(x)
    values, components = np.linalg.eigh(covariance)
    values, components = values[::-1], components[:, ::-1]
    found = queries.QUERIES["op11_whitening"](spark, DATA).collect()
    assert len(found) == 8 * len(x) and {r.n for r in found} == {len(x)}
    place = {r["vec_id"]: k for k, r in enumerate(known)}
    white = np.full((len(x), 8), np.nan)
    for r in found:
        white[place[r.vec_id], r.component - 1] = r.whitened
        assert r.deviation == sum((len(x) * int(a) - int(s)) ** 2 for a, s in zip(x[place[r.vec_id]], x.sum(axis=0), strict=True))
        assert abs(r.explained / (values[r.component - 1] / np.trace(covariance)) - 1) < 1e-10 and r.identity_error < 1e-10
    expected = centred @ components[:, :8] / np.sqrt(values[:8])
    signs = np.sign((white * expected).sum(axis=0))
    assert np.abs(white * signs - expected).max() < 1e-9


@pytest.mark.parametrize(("dims", "rows"), [(5, 100), (64, 3), (120, 60), (200, 800)])
def test_jacobi_davidson_equals_a_dense_solver(dims, rows):
    rng = np.random.default_rng(dims)
    c = rng.standard_normal((rows, dims)) * rng.random(dims)
    c -= c.mean(axis=0)
    dense = np.linalg.eigvalsh(c.T @ c / rows)[::-1][:8]
    values, vectors, residuals = whitening.jacobi_davidson(lambda b: c.T @ (c @ b) / rows, dims, 8)
    assert np.abs(values - dense[: len(values)]).max() < 1e-13 * dense[0] and residuals.max() < 1e-12 * dense[0]
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12


def test_minres_equals_a_dense_solver():
    rng = np.random.default_rng(3)
    a = rng.standard_normal((30, 30))
    a, right = a + a.T, rng.standard_normal((30, 4))
    right[:, 2] = 0
    found = whitening.minres(lambda b, which: a @ b, right, 60, 1e-12)
    assert np.abs(found - np.linalg.solve(a, right)).max() < 1e-8 and not found[:, 2].any()


def test_whitening_of_odd_rows(spark, monkeypatch):
    rng = np.random.default_rng(1)
    good = rng.standard_normal((40, 3)).tolist()
    nan, inf = float("nan"), float("inf")
    odd = [None, [1.0, None, 2.0], [nan, 0.0, 0.0], [0.0, inf, 0.0], [], [1.0, 2.0]]
    rows = [(k if k % 7 else None, v, "mine") for k, v in enumerate([*good, good[0], good[0], *odd])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n string").repartition(3)
    monkeypatch.setattr(whitening, "TASK_ROWS", 5)  # several tasks, and sums in groups
    monkeypatch.setattr(whitening, "SUMS_BYTES", 1)
    model = whitening.fit(df)
    found = whitening.whiten(df, model).collect()
    x = numbers_of([*good, good[0], good[0]])
    assert len(found) == 42 and {r.n for r in found} == {42} and all(len(r.whitened) == 3 for r in found)
    assert sorted(r.deviation for r in found) == sorted((np.square(42 * x - x.sum(axis=0)).sum(axis=1)).tolist())
    assert model.identity_error < 1e-10 and abs(sum(model.explained) - 1) < 1e-10
    for few in (df.where("false"), df.limit(0), df.where("embedding is null"), spark.createDataFrame([(1, [1.0, 2.0])] * 3, "vec_id long, embedding array<double>")):
        model = whitening.fit(few)
        assert not len(model.eigenvalues) and whitening.whiten(few, model).where(F.size("whitened") > 0).count() == 0
    large = spark.createDataFrame([(1, [1e300, 1.0]), (2, [-1e300, 2.0]), (3, [4e3, 3.0])], "vec_id long, embedding array<double>")
    found = {r.vec_id: r.deviation for r in whitening.whiten(large, whitening.fit(large)).collect()}
    assert found[1] is None and found[2] is None and found[3] is not None


# 12 Mixing


def shares(sizes, weights=(5, 2, 1), most=3):
    """Targets by definition: what is above a cap is shared again, until none is above."""
    total, order = sum(sizes.values()), sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, target, full = {s: weights[k % len(weights)] for k, s in enumerate(order)}, {}, set()
    while True:
        left = total - sum(most * sizes[s] for s in full)
        rest = sum(weight[s] for s in order if s not in full)
        target = {s: most * sizes[s] if s in full else left * weight[s] / rest for s in order}
        above = {s for s in order if s not in full and target[s] > most * sizes[s]}
        if not above:
            return target
        full |= above


def test_targets_equal_the_definition(spark):
    rng = random.Random(2)
    for n in (1, 2, 7, 40):
        sizes = {f"s{k:02}" if k else None: rng.choice([0, 1, 5, 60, 1000, 50000]) for k in range(n)}
        if not any(sizes.values()):
            sizes[None] = 3
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        found = {r.source: r.target for r in mixing.targets(df, range_rows=3).collect()}
        expected = shares(sizes)
        assert found.keys() == expected.keys() and all(abs(found[s] - expected[s]) <= 1e-9 * max(1, expected[s]) for s in found)


def test_mix_keeps_to_the_targets_whatever_the_ranges(spark):
    docs = table(spark, DATA, "documents")
    once = mixing.mix(docs, ["doc_id", "source"]).select("doc_id", "source", "size", "source_size", "target", "taken").collect()
    again = mixing.mix(docs.repartition(7), ["doc_id", "source"], range_rows=17).select("doc_id", "source", "size", "source_size", "target", "taken").collect()
    assert sorted(map(tuple, once), key=str) == sorted(map(tuple, again), key=str)
    texts = {r["doc_id"]: r["text"] for r in pq.read_table(f"{DATA}/documents.parquet").to_pylist()}
    assert all(r.size == len((texts[r.doc_id] or "").encode().split()) and r.taken <= 3 * r.size for r in once)
    sizes, target, taken = {}, {}, {}
    for r in once:
        sizes[r.source], taken[r.source], target[r.source] = sizes.get(r.source, 0) + r.size, taken.get(r.source, 0) + r.taken, r.target
    expected = shares(sizes)
    assert all(abs(target[s] - expected[s]) < 1e-6 and taken[s] == int(target[s]) for s in sizes)
    other = mixing.mix(docs, ["doc_id"], seed=1).select("doc_id", "taken").collect()
    assert sorted(map(tuple, other)) != sorted((r.doc_id, r.taken) for r in once)


def test_mix_of_odd_rows_and_its_samples(spark):
    rows = [(1, "a b c d", "x"), (None, "same words here", None), (None, "same words here", None), (2, None, "x"), (3, "", "y"), (4, " \t\n", None), (5, "e " * 200, "z")]
    rows += [(9, f"repeated {k}", "x") for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit("mine") for c in ("key", "size", "_range", "_within_size", "_mix_row", "_budget", "extra")})
    mixed = mixing.mix(docs, range_rows=2)
    found = mixed.collect()
    assert len(found) == len(rows) and {r.extra for r in found} == {"mine"}
    assert all(r.taken == 0 for r in found if not r.size)
    for source in ("x", "y", "z", None):
        group = [r for r in found if r.source == source]
        assert sum(r.taken for r in group) == int(group[0].target)
    samples = mixing.samples(mixed).collect()
    assert sum(r.n_words for r in samples) == sum(r.taken for r in found)
    assert all(len((r.text or "").split()) == r.n_words for r in samples)
    assert mixing.mix(docs.where("false")).count() == 0
    blank = mixing.mix(docs.where("trim(coalesce(text, '')) = ''")).collect()
    assert all((r.taken, r.target) == (0, 0.0) for r in blank)


# 13 Periodic runs


def runs_by_definition(numbers, least=24, exponent=3):
    n, found = len(numbers), []
    for q in range(1, n // exponent + 1):
        same = np.r_[False, numbers[q:] == numbers[:-q], False].astype(np.int8)
        edges = np.diff(same)
        for a, z in zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True):
            size = z - a + q
            stretch = numbers[a : a + size]
            if size >= max(least, exponent * q) and not any(np.array_equal(stretch[p:], stretch[:-p]) for p in range(1, q)):
                found.append((a, size, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def test_runs_equal_the_definition_on_dense_repeats():
    rng = random.Random(5)
    for _ in range(400):
        docs = []
        for _ in range(rng.randint(1, 4)):
            n, letters = rng.randint(0, 120), rng.randint(1, 4)
            w = [rng.randrange(letters) for _ in range(n)]
            for _ in range(rng.randint(0, 4) if n > 3 else 0):
                a, q = rng.randrange(n), rng.randint(1, max(1, n // 3))
                for t in range(a, a + rng.randint(1, n - a)):
                    w[t] = w[a + (t - a) % q]
            docs.append(w)
        least, starts = rng.choice([1, 3, 6, 24]), np.r_[0, np.cumsum([len(d) for d in docs])]
        found = periodic.runs_of(np.array([x for d in docs for x in d], np.int64), starts, least)
        assert found.tolist() == [[k, *r] for k, d in enumerate(docs) for r in runs_by_definition(np.array(d), least)]


def test_periodic_query_equals_the_definition(spark):
    found = {r.doc_id: r for r in queries.QUERIES["op13_periodic_runs"](spark, DATA).collect()}
    known = pq.read_table(f"{DATA}/documents.parquet").to_pylist()
    assert len(found) == len(known)
    with_runs = 0
    for r in known:
        w = (r["text"] or "").encode().split()
        n, h = len(w), zlib.crc32(str(r["doc_id"]).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        names = {}
        runs = runs_by_definition(np.array([names.setdefault(x, len(names)) for x in w], np.int64))
        gone = set()
        for s, size, q in runs:
            gone.update(range(s + q, s + size))
        row = found[r["doc_id"]]
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2])) if runs else (None, None, None)
        assert (row.n_runs, row.start, row.length, row.period) == (len(runs), *best)
        assert row.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert row.runs_sha256 == hashlib.sha256("".join(f"{s},{size},{q}\n" for s, size, q in runs).encode()).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()
        with_runs += bool(runs)
    assert with_runs > 10


def test_periodic_runs_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(periodic, "SLICE_BYTES", 50)
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, "la " * 30), (4, "la " * 30), (None, "a b " * 12 + "\x0bc\x0cd"), (5, "x y " * 24), (6, "one\x1ftwo " * 8), (7, "é   " * 20), (8, "w" * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("mine") for c in ("runs", "_text", "n_words", "_best", "start")})
    found = periodic.periodic_runs(docs).withColumn("_best", periodic.strongest(F.col("runs"))).collect()
    by_text = {r.text: r for r in found}
    assert len(found) == len(rows) and {r.start for r in found} == {"mine"}
    assert all(r.runs == [] and r.collapsed == "" for r in found if not (r.text or "").strip(" \t\n"))
    assert [tuple(x) for x in by_text["la " * 30].runs] == [(0, 30, 1)] and by_text["la " * 30].collapsed == "la"
    assert [tuple(x) for x in by_text["a b " * 12 + "\x0bc\x0cd"].runs] == [(0, 24, 2)] and by_text["a b " * 12 + "\x0bc\x0cd"].collapsed == "a b c d"
    assert by_text["x y " * 24].collapsed == "x y" and by_text["one\x1ftwo " * 8].n_words == 8 and by_text["é   " * 20]._best.period == 2
    assert periodic.periodic_runs(docs.where("false")).count() == 0
    short = periodic.periodic_runs(docs.where("doc_id = 6"), least=6).collect()
    assert [tuple(x) for x in short[0].runs] == [(0, 8, 1)]
    with pytest.raises(ValueError):
        periodic.runs_of(np.zeros(3, np.int64), np.array([0, 3]), exponent=2)


# 7 Decontamination: texts that repeat words


def test_repeated_words_take_no_memory_for_each_pair(spark):
    import tracemalloc

    from siftlake.llm import decontaminate

    def points(doc, item, seed):
        """Tiles by definition, from all pairs of places."""
        out, used_doc, used_item = [], set(), set()
        while True:
            best = (0, 0, 0)
            for i in range(len(doc)):
                for j in range(len(item)):
                    n = 0
                    while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n] and i + n not in used_doc and j + n not in used_item:
                        n += 1
                    if n >= seed and n > best[2]:
                        best = (i, j, n)
            if not best[2]:
                return out
            out.append(best)
            used_doc.update(range(best[0], best[0] + best[2]))
            used_item.update(range(best[1], best[1] + best[2]))

    rng = random.Random(9)
    for _ in range(60):
        doc, item = ([rng.randrange(rng.choice([1, 2, 3])) for _ in range(rng.randint(1, 40))] for _ in range(2))
        doc, item, seed = np.array(doc, np.uint64), np.array(item, np.uint64), rng.choice([1, 2, 4])
        if len(item) < seed or len(doc) < seed:
            continue
        hashes = decontaminate.rolling_hashes(doc, seed)
        met = decontaminate._meetings(hashes, np.arange(len(hashes)), decontaminate.rolling_hashes(item, seed), seed)
        assert decontaminate.tiles(doc, item, met, seed) == points(doc.tolist(), item.tolist(), seed)
    docs = spark.createDataFrame([(1, "ha " * 60_000 + "and so on"), (2, "so it goes " * 20_000)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "ha " * 600), (8, "so it goes on and on and it goes so far " * 3), (9, "  "), (None, None)], "item_id long, text string")
    assert [(r.doc_id, r.item_id, r.coverage) for r in decontaminate.leaks(docs, bench).collect()] == [(1, 7, 1.0)]
    known = decontaminate.rolling_hashes(np.zeros(200_000, np.uint64), 5)
    tracemalloc.start()
    met = decontaminate._meetings(known, np.arange(len(known)), decontaminate.rolling_hashes(np.zeros(100, np.uint64), 5), 5)
    assert len(met) == len(known) + 95 and tracemalloc.get_traced_memory()[1] < 300e6
    tracemalloc.stop()
