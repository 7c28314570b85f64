"""Substring dedup: Rabin-Karp hashes of every window of words, counted in Spark; repeated windows merge into maximal intervals.

A window is ``window`` consecutive words of one document. A word goes if it is covered by a window whose words also
start in a document with a smaller ``doc_id``. Documents are dealt into blocks by a hash; three passes share one exchange:

1. Each block sends the top bits of its window hashes, sorted and as differences, to the part that owns their range.
   A part counts them over all blocks and sends each block those that other blocks have, too.
2. Of these, blocks send whole 64-bit hashes with the smallest ``doc_id`` they have. A part tells each block which of
   its windows start in a document before all of the block's own.
3. Each block marks these windows, and those that its own smaller documents have, merges them into maximal intervals and
   cuts them out.

The first pass has no false negatives, so the result is that of counting whole hashes, at a fraction of the shuffle. A
window that a third of all documents share is one entry for each block, not for each document. Windows are judged by their 64-bit
hashes: two different windows agree with a chance of about the number of windows / 2^64.

A task holds one block, or one part, at a time. Their bytes are bounded (but for a document that is itself larger), and grow with
the square root of the input where it is large, so that a block still has CELL windows for each part: a cell of the table of blocks and
parts is one row, and its bytes are those of its windows. That is 2 MB and 8 MB up to 160 GB, 49 MB and 196 MB at 100 TB.

Nulls, ties and odd rows: a null or empty text has no words; a null ``doc_id`` counts as larger than all others; of rows
with the same ``doc_id`` none is smaller, so they don't remove each other's windows; a text of fewer words than a window
stays; extra columns come along. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, words

WINDOW = 13
#: Least bytes of text in a block, and of text whose windows a part counts, about; windows in a block for each part, at least.
BLOCK_BYTES, PART_BYTES, CELL = 2 << 20, 8 << 20, 16
#: Blocks that a task takes one after the other, about, and tasks at most (then a task takes more blocks).
TASK_BLOCKS, MOST_TASKS = 4, 100_000
#: Bytes of text for each window, about.
WINDOW_BYTES = 6
#: Base of the rolling hash, and factors of the mixing at its end (odd 64-bit constants).
BASE, MIX_1, MIX_2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
LAST_ID = np.iinfo(np.int64).max


def to_bytes(sorted_values: np.ndarray) -> bytes:
    """Ascending unsigned 64-bit values as differences, byte plane by byte plane, so that the zeros lie together."""
    steps = np.diff(sorted_values, prepend=np.uint64(0))
    planes = steps.astype("<u8").view(np.uint8).reshape(-1, 8).T
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    return bytes([width]) + planes[:width].tobytes()


def from_bytes(data: bytes | pa.Buffer) -> np.ndarray:
    data = memoryview(data)
    width, n = data[0], (len(data) - 1) // data[0]
    planes = np.zeros((8, n), np.uint8)
    planes[:width] = np.frombuffer(data, np.uint8, width * n, 1).reshape(width, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def rolling_hashes(tokens: np.ndarray, window: int) -> np.ndarray:
    """Karp-Rabin hashes modulo 2^64 of all windows, mixed so that the top bits are even."""
    n = len(tokens) - window + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = tokens[:n].copy()
    for k in range(1, window):
        h *= BASE
        h += tokens[k : k + n]
    h ^= h >> np.uint64(30)
    h *= MIX_1
    h ^= h >> np.uint64(27)
    h *= MIX_2
    h ^= h >> np.uint64(31)
    return h


class Block:
    """The windows of a block's documents: hash, and place of the first word among the block's words."""

    def __init__(self, rows: pa.Table, window: int):
        column = rows.column("_hashes").combine_chunks()
        self.tokens = np.asarray(column.flatten()).view(np.uint64) if len(column) else np.empty(0, np.uint64)
        self.lengths = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64) if len(column) else np.empty(0, np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self.doc_ids = np.asarray(rows.column("doc_id").combine_chunks().fill_null(LAST_ID)) if rows.num_rows else np.empty(0, np.int64)
        whole = np.zeros(len(self.tokens), bool)
        for a, n in zip(self.starts[:-1].tolist(), self.lengths.tolist(), strict=True):
            whole[a : a + n - window + 1 if n >= window else a] = True
        self.at = np.flatnonzero(whole)
        hashes = rolling_hashes(self.tokens, window)
        self.hashes = hashes[whole[: len(hashes)]]

    def ids(self) -> np.ndarray:
        """The document's id of each window."""
        return self.doc_ids[np.searchsorted(self.starts, self.at, "right") - 1]


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of ``values`` are in ``known``, which ascends."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _begins(sorted_values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]])[: len(sorted_values)])


def _least(ids: np.ndarray, begins: np.ndarray) -> np.ndarray:
    return np.minimum.reduceat(ids, begins) if len(begins) else ids


def _cells(block: int, values: np.ndarray, parts: int, shift: int, *more: np.ndarray) -> list[tuple]:
    """The ascending values cut at the parts' borders: (part, block, values, bytes of what goes with them)."""
    if shift >= 64:
        cuts = [0, len(values)]
    else:
        cuts = np.append(np.searchsorted(values, np.arange(parts, dtype=np.uint64) << np.uint64(shift)), len(values)).tolist()
    return [(p, block, to_bytes(values[a:b]), *(x[a:b].tobytes() for x in more)) for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]


def _table(rows: list[tuple], names: list[str]) -> pa.Table:
    kinds = {"part": pa.int64(), "_block": pa.int64()}
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.Table.from_arrays([pa.array(c, kinds.get(n, pa.binary())) for c, n in zip(columns, names, strict=True)], names)


def remove_repeated(docs: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, part_bytes: int = PART_BYTES) -> DataFrame:
    """``docs`` (doc_id, text and others) with the repeated passages cut out.

    Adds n_words, n_removed and removed (intervals of word numbers from 0, ends exclusive). ``text`` is unchanged where
    nothing is removed, else the kept words joined by one space.
    """
    spark = docs.sparkSession
    own = [c for c in docs.columns if c not in ("_block", "_hashes", "n_words", "n_removed", "removed")]
    docs = docs.select(*own)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # A block has block_bytes / WINDOW_BYTES windows, which go to size / part_bytes parts.
    growth = max(1.0, math.sqrt(CELL * WINDOW_BYTES * size / (block_bytes * part_bytes)))
    block_bytes, part_bytes = block_bytes * growth, part_bytes * growth
    blocks = max(math.ceil(size / block_bytes), min(spark.sparkContext.defaultParallelism, size // 65536 + 1))
    part_bits = max(0, math.ceil(math.log2(max(size, 1) / part_bytes)))  # parts are halves, quarters, ... of all hashes
    parts = 1 << part_bits
    top = 64 - min(60, max(size, 2).bit_length() + 3)  # of a hash, the bits above these are counted first
    extra = [c for c in own if c not in ("doc_id", "text")]
    tasks = min(max(math.ceil(blocks / TASK_BLOCKS), min(blocks, spark.sparkContext.defaultParallelism)), MOST_TASKS)

    dealt = docs.withColumn("_block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("long")).repartition(tasks, "_block")
    hashes = F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("_hashes")
    narrow = dealt.select("_block", "doc_id", *extra, hashes)

    def first(key, rows):
        found = np.unique(Block(rows, window).hashes >> np.uint64(top))
        return _table(_cells(key[0].as_py(), found, parts, 64 - top - part_bits), ["part", "_block", "tops"])

    def shared(rows):
        own_blocks, cells = rows.column("_block").to_pylist(), [from_bytes(x.as_buffer()) for x in rows.column("tops")]
        values = np.sort(np.concatenate(cells))
        values = np.unique(values[1:][values[1:] == values[:-1]])
        out = [(b, to_bytes(x)) for b, v in zip(own_blocks, cells, strict=True) if len(x := v[_among(v, values)])]
        return _table(out, ["_block", "tops"])

    def second(key, rows, told):
        names = ["part", "_block", "whole", "ids"]
        if not rows.num_rows or not told.num_rows:
            return _table([], names)
        block, tops = Block(rows, window), np.sort(np.concatenate([from_bytes(x.as_buffer()) for x in told.column("tops")]))
        mask = _among(block.hashes >> np.uint64(top), tops)
        hashes, ids = block.hashes[mask], block.ids()[mask]
        order = np.argsort(hashes)
        hashes = hashes[order]
        begins = _begins(hashes)
        return _table(_cells(key[0].as_py(), hashes[begins], parts, 64 - part_bits, _least(ids[order], begins)), names)

    def smallest(rows):
        own_blocks, cells = rows.column("_block").to_pylist(), [from_bytes(x.as_buffer()) for x in rows.column("whole")]
        row = np.repeat(np.arange(len(cells), dtype=np.uint16 if len(cells) < 1 << 16 else np.uint32), [len(v) for v in cells])
        values, ids = np.concatenate(cells), np.concatenate([np.frombuffer(x.as_buffer(), "<i8") for x in rows.column("ids")])
        del cells
        order = np.argsort(values)
        values, ids, row = values[order], ids[order], row[order]
        begins = _begins(values)
        late = ids > np.repeat(_least(ids, begins), np.diff(np.append(begins, len(values))))
        values, row = values[late], row[late]
        order = np.argsort(row, kind="stable")  # the values of a block ascend
        values, cuts = values[order], np.searchsorted(row[order], np.arange(len(own_blocks) + 1))
        return _table([(b, to_bytes(values[a:z])) for b, a, z in zip(own_blocks, cuts[:-1], cuts[1:], strict=True) if z > a], ["_block", "whole"])

    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("removed", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))])

    def third(key, rows, told):
        block = Block(rows, window)
        gone = _among(block.hashes, np.sort(np.concatenate([from_bytes(x.as_buffer()) for x in told.column("whole")]))) if told.num_rows else np.zeros(len(block.hashes), bool)
        order, ids = np.argsort(block.hashes), block.ids()
        begins = _begins(block.hashes[order])
        gone[order] |= ids[order] > np.repeat(_least(ids[order], begins), np.diff(np.append(begins, len(order))))
        marks = np.zeros(len(block.tokens) + 1, np.int64)  # +1 where a window begins, -1 after its end
        np.add.at(marks, block.at[gone], 1)
        np.add.at(marks, block.at[gone] + window, -1)
        covered = np.cumsum(marks[:-1]) > 0
        # Most texts stay as they are; only those that are cut are taken out of the column.
        column, cut, removed, n_removed = rows.column("text").combine_chunks(), {}, [], []
        for k, (a, b) in enumerate(zip(block.starts[:-1].tolist(), block.starts[1:].tolist(), strict=True)):
            mask = covered[a:b]
            n_removed.append(int(mask.sum()))
            removed.append([])
            if n_removed[-1]:
                edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8))).tolist()
                removed[-1] = [{"start": s, "end": e} for s, e in zip(edges[::2], edges[1::2], strict=True)]
                kept, last, tokens = [], 0, column[k].as_buffer().to_pybytes().split()
                for s, e in zip(edges[::2], edges[1::2], strict=True):
                    kept += tokens[last:s]
                    last = e
                cut[k] = b" ".join(kept + tokens[last:]).decode()
        spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        if cut:
            changed = pa.array([cut.get(k) for k in range(len(column))], column.type)
            column = pc.if_else(pa.array([k in cut for k in range(len(column))]), changed, column)
        out = rows.select(own).set_column(own.index("text"), "text", column)
        return out.append_column("n_words", pa.array(block.lengths, pa.int64())).append_column("n_removed", pa.array(n_removed, pa.int64())).append_column("removed", pa.array(removed, spans))

    tops = narrow.groupBy("_block").applyInArrow(first, "part long, _block long, tops binary")
    told = tops.groupBy("part").applyInArrow(shared, "_block long, tops binary")
    wholes = narrow.groupBy("_block").cogroup(told.groupBy("_block")).applyInArrow(second, "part long, _block long, whole binary, ids binary")
    told = wholes.groupBy("part").applyInArrow(smallest, "_block long, whole binary")
    return dealt.select("_block", *own, hashes).groupBy("_block").cogroup(told.groupBy("_block")).applyInArrow(third, schema)


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = remove_repeated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = F.sha2(F.concat_ws(" ", words(F.col("text"))), 256)
    return cleaned.select("doc_id", "n_words", "n_removed", digest.alias("kept_sha256"))


OP5_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
g AS (SELECT doc_id, i, sha256(array_to_string(words[i : i + 12], ' ')) AS h FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM w)),
m AS (SELECT h, min(doc_id) AS least FROM g GROUP BY h HAVING min(doc_id) < max(doc_id)),
c AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(range(i, i + 13)) AS p FROM g JOIN m USING (h) WHERE doc_id > least) GROUP BY doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN words ELSE list_filter(words, lambda x, i: NOT list_contains(gone, i)) END, ' '), '')) AS kept_sha256
FROM w LEFT JOIN c USING (doc_id)
"""
