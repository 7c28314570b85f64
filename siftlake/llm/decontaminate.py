"""Benchmark decontamination by greedy string tiling.

Texts are lists of words: letters and digits in lower case. Seeds are the Karp-Rabin hashes of ``seed`` consecutive words (of a shorter
benchmark item, all its words). A document and an item that share a seed are tiled: of all matches of at least a seed's
length, the longest whose words are still free is marked, again and again, in whatever order the passages stand. An item
counts as leaked if its tiles cover at least ``coverage`` of its words.

The benchmark's seeds go to every task if there are at most ``most_seeds`` of them; beyond that, the seeds of documents and items meet
in a join, and only the documents that share one are tiled, a row for each pair.

Nulls, ties and odd rows: null texts and texts without words leak nothing; of equally long matches the one that is earlier in the document,
then in the item, is marked first; repeated documents are judged each by itself; items with the same ``item_id`` are each
an item; a null ``item_id`` stays null in the result; items without words are left out before anything is counted or collected; a word that a text and an item repeat costs their
places' time, not memory; other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table
from .substrings import rolling_hashes

SEED, COVERAGE = 5, 0.5
#: Seeds (and words) of a benchmark that may be sent to every task: 24 bytes each.
MOST_SEEDS = 2_000_000
#: Shared seeds, each with all items that have it, that are in memory at once (but for those of one document).
EXPANDED = 1 << 22
FOUND = "doc_id long, item_id long, tiled_words long, item_words long, coverage double, n_tiles long"
_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64()]
_NAMES = [x.split()[0] for x in FOUND.split(", ")]


def word_hashes(text: Column) -> Column:
    """Hashes of the words: runs of letters and digits, in lower case."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(parts, lambda w: w != ""), lambda w: F.xxhash64(w))


def _equal_runs(doc: np.ndarray, item: np.ndarray, i: int, j: int, n: int, seed: int) -> Iterator[tuple[int, int, int]]:
    """Of a stretch whose hashes agree, the parts of ``seed`` words or more that agree themselves."""
    same = np.concatenate([[False], doc[i : i + n] == item[j : j + n], [False]])
    edges = np.flatnonzero(same[1:] != same[:-1]).tolist()
    return ((i + a, j + a, z - a) for a, z in zip(edges[::2], edges[1::2], strict=True) if z - a >= seed)


def tiles(doc: np.ndarray, item: np.ndarray, at: list[tuple[int, int, int]], seed: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in the document, place in the item, length) of the tiles.

    ``at``: stretches (place in the document, place in the item, words) that agree, as long as they can be. The longest free one is marked, and what is left free of one
    that is partly marked goes back among the others. It ends when no ``seed`` words of the item are free in a row.
    """
    matches = [(-n, i, j) for x in at for i, j, n in _equal_runs(doc, item, *x, seed)]
    heapq.heapify(matches)
    used_doc, used_item, out = np.zeros(len(doc), bool), np.zeros(len(item), bool), []
    room = len(item) >= seed
    while matches and room:
        n, i, j = heapq.heappop(matches)
        free = ~(used_doc[i : i - n] | used_item[j : j - n])
        if free.all():
            out.append((i, j, -n))
            used_doc[i : i - n] = used_item[j : j - n] = True
            gaps = np.diff(np.concatenate([[-1], np.flatnonzero(used_item), [len(item)]])) - 1
            room = bool(gaps.max() >= seed)
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[False], free, [False]]).astype(np.int8))).tolist()
        for a, z in zip(edges[::2], edges[1::2], strict=True):
            if z - a >= seed:
                heapq.heappush(matches, (a - z, i + a, j + a))
    return out


def _judged(doc_id, doc: np.ndarray, item_id, item: np.ndarray, at: list[tuple[int, int, int]], seed: int, coverage: float) -> tuple | None:
    marked = tiles(doc, item, at, min(seed, len(item)))
    n = sum(x[2] for x in marked)
    return (doc_id, item_id, n, len(item), n / len(item), len(marked)) if n >= coverage * len(item) else None


def _rows(found: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True) if found else [()] * 6, _KINDS, strict=True)], _NAMES)


class Items:
    """A benchmark's items and, for each seed length, their sorted seeds with item and place."""

    def __init__(self, items: list[tuple[int | None, np.ndarray]], seed: int):
        self.items, self.seeds = items, {}
        self.lengths = np.array([len(w) for _, w in items], np.int64)
        for size in sorted({min(seed, len(w)) for _, w in items if len(w)}):
            found = [(rolling_hashes(w, size), k) for k, (_, w) in enumerate(items) if min(seed, len(w)) == size]
            hashes = np.concatenate([h for h, _ in found])
            which = np.repeat([k for _, k in found], [len(h) for h, _ in found])
            place = np.concatenate([np.arange(len(h)) for h, _ in found])
            order = np.argsort(hashes, kind="stable")
            self.seeds[size] = (hashes[order], which[order], place[order])

    def shared(self, tokens: np.ndarray, lengths: np.ndarray, coverage: float) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
        """For a batch of documents: (document, item, stretches in which all seeds agree), for each pair that can reach ``coverage``.

        Tiles lie within shared seeds, so the words of an item that any shared seed covers bound what is tiled. This is counted for the
        distinct seeds of a document, and only the pairs that pass get their places.
        """
        starts = np.cumsum(lengths) - lengths
        row = np.repeat(np.arange(len(lengths)), lengths)
        for size, (seeds, which, place) in self.seeds.items():
            hashes = rolling_hashes(tokens, size)
            low = np.minimum(np.searchsorted(seeds, hashes), len(seeds) - 1)
            hit = np.flatnonzero((seeds[low] == hashes) & (row[: len(hashes)] == row[size - 1 :][: len(hashes)]))
            low, doc = low[hit], row[hit]
            # One entry for each document and seed, and of it one for each place of an item that has the seed; some million at a time.
            order = np.lexsort((low, doc))
            first = order[np.concatenate([[True], (doc[order][1:] != doc[order][:-1]) | (low[order][1:] != low[order][:-1])])[: len(order)]]
            times = np.searchsorted(seeds, seeds[low[first]], "right") - low[first]
            total, at = np.concatenate([[0], np.cumsum(times)]), 0
            while at < len(first):
                upto = max(at + 1, int(np.searchsorted(total, total[at] + EXPANDED, "right")) - 1)
                while upto < len(first) and doc[first[upto]] == doc[first[upto - 1]]:  # whole documents
                    upto += 1
                some, n = first[at:upto], times[at:upto]
                entry = np.repeat(low[some] - np.cumsum(n) + n, n) + np.arange(n.sum())
                of, item, where = np.repeat(doc[some], n), which[entry], place[entry]
                order = np.lexsort((where, item, of))
                of, item, where = of[order], item[order], where[order]
                begins = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (item[1:] != item[:-1])]))
                reach = np.append(np.minimum(np.diff(where), size), size)
                reach[np.append(begins[1:], len(of)) - 1] = size
                passed = begins[np.add.reduceat(reach, begins) >= coverage * self.lengths[item[begins]]]
                for k, j in zip(of[passed].tolist(), item[passed].tolist(), strict=True):
                    a, z = np.searchsorted(doc, [k, k + 1])  # hits ascend by document
                    yield k, j, _meetings(hashes[hit[a:z]], hit[a:z] - starts[k], rolling_hashes(self.items[j][1], size), size)
                at = upto


def _meetings(hashes: np.ndarray, places: np.ndarray, item: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """(place in the document, place in the item, words) of the longest stretches in which seeds of ``size`` words agree one after the other.

    The item's places are taken in turn, and the diagonals that go on are carried along as sorted arrays. So what is in memory is the places of one seed, and not all
    places of the document times all of the item, however often both repeat a word.
    """
    order = np.lexsort((places, hashes))
    hashes, places = hashes[order], places[order].astype(np.int64)
    low, high = np.searchsorted(hashes, item), np.searchsorted(hashes, item, "right")
    found: list[np.ndarray] = []
    on, since = np.empty(0, np.int64), np.empty(0, np.int64)  # open diagonals, ascending, and where in the item they began
    for j in range(len(item) + 1):
        now = places[low[j] : high[j]] - j if j < len(item) else np.empty(0, np.int64)
        if not len(on) and not len(now):
            continue
        stays = np.isin(on, now, assume_unique=True)
        ended, began = on[~stays], since[~stays]
        found.append(np.column_stack([ended + began, began, j - began + size - 1]))
        begin = np.full(len(now), j)
        begin[np.searchsorted(now, on[stays])] = since[stays]
        on, since = now, begin
    return [tuple(x) for x in np.concatenate(found).tolist()] if found else []


def leaks(docs: DataFrame, benchmark: DataFrame, seed: int = SEED, coverage: float = COVERAGE, most_seeds: int = MOST_SEEDS) -> DataFrame:
    """A row for each document of ``docs`` (doc_id, text) and item of ``benchmark`` (item_id, text) that leaked into it:
    doc_id, item_id, tiled_words, item_words, coverage (their ratio) and n_tiles."""
    items = benchmark.select("item_id", word_hashes(F.col("text")).alias("words")).where(F.size("words") > 0)  # blank items leak nothing
    n_words = items.agg(F.sum(F.size("words"))).first()[0] or 0
    hashed = docs.select("doc_id", word_hashes(F.col("text")).alias("words"))
    if n_words > most_seeds:
        return _leaks_by_join(hashed, items, seed, coverage)
    known = Items([(r[0], np.array(r[1], np.int64).view(np.uint64)) for r in items.collect()], seed)  # at most most_seeds words
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column(1)
            tokens, lengths = np.asarray(column.flatten()).view(np.uint64), np.asarray(column.value_lengths()).astype(np.int64)
            starts, found = np.cumsum(lengths) - lengths, []
            for k, item, at in known.shared(tokens, lengths, coverage):
                row = _judged(batch.column(0)[k].as_py(), tokens[starts[k] : starts[k] + lengths[k]], *known.items[item], at, seed, coverage)
                if row:
                    found.append(row)
            yield _rows(found)

    return hashed.mapInArrow(run, FOUND)


def _seed_rows(rows: DataFrame, key: str, sizes: list[int], seed: int, whole: bool) -> DataFrame:
    """key and seed (with its length) of each row: the distinct seeds of ``sizes`` words; ``whole``: of its own seed length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, words in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                tokens = np.asarray(words.values).view(np.uint64)
                for size in [min(seed, len(tokens))] if whole else sizes:
                    found = np.unique(rolling_hashes(tokens, size)) if 0 < size <= len(tokens) else tokens[:0]
                    yield pa.RecordBatch.from_arrays([pa.array([k] * len(found), pa.int64()), pa.array(found.view(np.int64)), pa.array([size] * len(found), pa.int64())], [key, "seed", "size"])

    return rows.mapInArrow(run, f"{key} long, seed long, size long")


def _leaks_by_join(hashed: DataFrame, items: DataFrame, seed: int, coverage: float) -> DataFrame:
    items = stored(items.where(F.size("words") > 0).withColumn("item", F.monotonically_increasing_id()), "items")
    docs = stored(hashed.where(F.size("words") > 0).withColumn("doc", F.monotonically_increasing_id()), "document-words")
    sizes = [r[0] for r in items.select(F.least(F.size("words"), F.lit(seed))).distinct().collect()]  # 1 to seed
    of_items = _seed_rows(items.select("item", "words"), "item", sizes, seed, True)
    of_docs = _seed_rows(docs.select("doc", "words"), "doc", sizes, seed, False)
    pairs = of_docs.join(of_items, ["seed", "size"]).select("doc", "item").distinct()
    rows = pairs.join(docs, "doc").join(items.withColumnRenamed("words", "item_words"), "item").select("doc_id", "words", "item_id", "item_words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for k in range(batch.num_rows):
                doc, item = (np.asarray(batch.column(c)[k].values).view(np.uint64) for c in (1, 3))
                known = Items([(batch.column(2)[k].as_py(), item)], seed)
                for _, _, at in known.shared(doc, np.array([len(doc)]), coverage):
                    row = _judged(batch.column(0)[k].as_py(), doc, *known.items[0], at, seed, coverage)
                    if row:
                        found.append(row)
            yield _rows(found)

    return rows.mapInArrow(run, FOUND)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
