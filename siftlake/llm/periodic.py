"""Periodic runs of words, found with a dictionary of basic factors.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) of at least ``least`` words and ``exponent`` periods that
no neighbouring word extends. The words of a document get numbers, and then, length by length for 1, 2, 4, 8, ..., every stretch of that many words
gets one: that of the pair of its halves. Stretches with one number are equal words for words; nothing is hashed.

For each length L, a stretch's successor is the next place in its document where the same stretch starts. Neighbouring stretches whose successors are
equally far, d words, propose the period d: their starts and successors form arithmetic progressions. A run of period q and three periods or more holds a stretch
of each start within its first 3q - L words, for the one L with q <= L < 2q; its successor is q words on, as a stretch of q words or more can't recur
sooner in a run of smallest period q. So of the distances within twice a length, those over L / 2 and up to L give every run once; shorter and longer
ones would propose again, in pieces, what another length proposes whole. A proposal is extended word by word to both sides, and what is found twice is kept once.

Only stretches whose both halves recur in the document get a number at the next length, so that ordinary text is through after few lengths.
Documents are independent, and nothing is shuffled. A task holds the words of a slice of documents at a time, SLICE_BYTES of text or one document
if that is longer, at about 100 bytes a word.

Nulls, ties and odd rows: a null or empty text has no words and no runs; repeated rows are each judged by itself; ``doc_id`` is not looked
at, and may be null or missing; own columns stay unless they have the names that are added. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, words

LEAST, EXPONENT = 24, 3
#: Bytes of text that are searched together.
SLICE_BYTES = 4 << 20


def _recurring(names: np.ndarray, at: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the stretches at ``at`` recur in their document, and how far the successor is (0: none)."""
    order = np.lexsort((at, names, owner[at]))
    same = (names[order][1:] == names[order][:-1]) & (owner[at[order][1:]] == owner[at[order][:-1]])
    recurs, far = np.zeros(len(at), bool), np.zeros(len(at), np.int64)
    recurs[order[1:]] = same
    recurs[order[:-1]] |= same
    far[order[:-1]] = np.where(same, np.diff(at[order]), 0)
    return recurs, far


def _reach(numbers: np.ndarray, at: int, far: int, step: int, end: int) -> int:
    """How many words on from ``at`` in the direction ``step``, up to ``end`` exclusive, are equal to the word ``far`` further right."""
    reached, width = 0, 16
    room = max(0, (end - at) * step)
    while reached < room:
        k = np.arange(reached, min(reached + width, room)) * step + at
        differ = np.flatnonzero(numbers[k] != numbers[k + far])
        if len(differ):
            return reached + int(differ[0])
        reached, width = reached + len(k), width * 2
    return reached


def runs_of(numbers: np.ndarray, starts: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> np.ndarray:
    """Runs in documents whose words are ``numbers[starts[i]:starts[i + 1]]``: rows of (document, start, length, period), in this order."""
    if exponent < 3:
        raise ValueError("runs of less than three periods need other distances")
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    at, names, length, found = np.arange(len(numbers)), numbers.astype(np.int64), 1, set()
    while len(at):
        recurs, far = _recurring(names, at, owner)
        near = np.flatnonzero((far > length // 2) & (far <= length))
        if len(near):
            where, distance = at[near], far[near]
            breaks = np.flatnonzero((np.diff(where) != 1) | (np.diff(distance) != 0)) + 1
            first, last = where[np.r_[0, breaks]], where[np.r_[breaks - 1, len(where) - 1]]
            period = distance[np.r_[0, breaks]]
            for a, z, q in zip(first.tolist(), last.tolist(), period.tolist(), strict=True):
                if z - a + length < (exponent - 1) * q:  # a run's starts are all proposed together
                    continue
                low, high = int(starts[owner[a]]), int(starts[owner[a] + 1])
                left = _reach(numbers, a - 1, q, -1, low - 1)
                right = _reach(numbers, z + length, q, 1, high - q)
                size = left + (z - a) + length + right + q
                if size >= max(least, exponent * q):
                    found.add((int(owner[a]), a - left - low, size, q))
        at, names = at[recurs], names[recurs]
        # A stretch of twice the length has a number if its both halves recur.
        second = np.searchsorted(at, at + length)
        inside = second < len(at)
        inside[inside] = (at[second[inside]] == at[inside] + length) & (owner[at[second[inside]]] == owner[at[inside]])
        pairs = names[inside] * (int(names.max(initial=0)) + 1) + names[second[inside]]
        at, names = at[inside], np.unique(pairs, return_inverse=True)[1].astype(np.int64)
        length *= 2
    return np.array(sorted((d, s, q, n) for d, s, n, q in found), np.int64).reshape(-1, 4)[:, [0, 1, 3, 2]]


def _numbers(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of a column of texts one after the other, their numbers, and where each text's words begin (and the end)."""
    split = pc.ascii_split_whitespace(texts.fill_null(""))
    flat, lengths = split.flatten(), np.asarray(split.value_lengths())
    there = np.asarray(pc.greater(pc.binary_length(flat), 0), bool)
    owner = np.repeat(np.arange(len(texts)), lengths)[there]
    flat = flat.filter(pa.array(there))
    coded = flat.dictionary_encode()
    starts = np.searchsorted(owner, np.arange(len(texts) + 1))
    return flat, np.asarray(coded.indices).astype(np.int64), starts


def _slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    first, total = 0, 0
    for k, size in enumerate(sizes.tolist()):
        if k > first and total + size > SLICE_BYTES:
            yield first, k
            first, total = k, 0
        total += size
    if first < len(sizes):
        yield first, len(sizes)


RUN = T.StructType([T.StructField(x, T.LongType()) for x in ("start", "length", "period")])
ADDED = [T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())]


def periodic_runs(docs: DataFrame, text: str = "text", least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """``docs`` with n_words, runs (start in words from 0, length and period, in order of start, then period) and collapsed: the words, joined by
    one space, without those that any run holds after its first period."""
    own = [c for c in docs.columns if c not in [f.name for f in ADDED]]
    schema, at = T.StructType([*docs.select(*own).schema.fields, *ADDED]), own.index(text)
    lists = pa.list_(pa.struct([(f.name, pa.int64()) for f in RUN]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(pc.binary_length(batch.column(at)).fill_null(0)).astype(np.int64)
            for a, z in _slices(sizes):
                part = batch.slice(a, z - a)
                flat, numbers, starts = _numbers(part.column(at))
                found = runs_of(numbers, starts, least, exponent)
                marks = np.zeros(len(numbers) + 1, np.int64)
                begins = starts[found[:, 0]] + found[:, 1]
                np.add.at(marks, begins + found[:, 3], 1)
                np.add.at(marks, begins + found[:, 2], -1)
                stays = np.cumsum(marks[:-1]) == 0
                before = np.concatenate([[0], np.cumsum(stays)])[starts]
                kept = pa.ListArray.from_arrays(pa.array(before, pa.int32()), flat.filter(pa.array(stays)))
                cuts = np.searchsorted(found[:, 0], np.arange(z - a + 1))
                spans = pa.StructArray.from_arrays([pa.array(found[:, c]) for c in (1, 2, 3)], ["start", "length", "period"])
                columns = [*part.columns, pa.array(np.diff(starts)), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), spans).cast(lists), pc.binary_join(kept, " ")]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return docs.select(*own).mapInArrow(search, schema)


def strongest(runs: Column) -> Column:
    """Of ordered runs, the first with the greatest length / period, compared as fractions; null: there is none."""
    better = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    return F.aggregate(runs, F.lit(None).cast(RUN), lambda best, r: F.when(better(best, r), r).otherwise(best))


def planted(doc_id: Column, text: Column) -> Column:
    """The text, in one of ten documents with its words repeated in a period from some word on; the crc32 of doc_id says where."""
    h, w = F.crc32(doc_id.cast("string").cast("binary")), words(text)
    n, g = F.size(w), F.floor(h / 10)
    a = (g % F.nullif(n, F.lit(0))).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    again = F.flatten(F.array_repeat(F.slice(w, a + 1, p), F.ceil((n - a) / p).cast("int")))
    return F.when((h % 10 == 0) & (n > 0), F.concat_ws(" ", F.concat(F.slice(w, F.lit(1), a), F.slice(again, F.lit(1), n - a)))).otherwise(text)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text"))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    listed = F.concat_ws("", F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))))
    found = periodic_runs(docs).withColumn("_best", strongest(F.col("runs")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("_best.start").alias("start"),
        F.col("_best.length").alias("length"),
        F.col("_best.period").alias("period"),
        F.floor(F.expr("(1000 * _best.length) div _best.period")).alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
        "n_words",
    )
