"""Packing by power-of-two decomposition.

Each document's ids are cut into pieces whose lengths are the powers of two in the binary form of its length, full
sequences first. A piece is a sequence by itself: no sequence holds two documents, and none needs padding. Sequences of
equal length share a bucket (``bucket``: the length's logarithm). A task fills a batch of up to ``batch_tokens`` ids for each
bucket and hands it back when it is full (at its end, what is left): ``batch_id`` names the batch, ``place`` the row in it. So a batch
is a matrix without padding, whatever the documents' lengths. ``sequence_id`` and ``batch_id`` are unique in one evaluation of
the result: the partition's number and a running number in it.

Nulls, ties and odd rows: a null or empty text is a document of one id, the end id; repeated rows are packed each by
itself; ``doc_id`` may be null; columns other than doc_id and text are ignored. An empty table gives no pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .tokens import MAX_RUNS, encoder, tokenizer_file

#: Ids in one batch of sequences of equal length.
BATCH_TOKENS = 1 << 16
PIECES = "doc_id long, start long, length long, bucket int, ids binary, doc_tokens long, sequence_id long, offset long, batch_id long, place int"
_KINDS = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def cuts(n: int, longest: int) -> list[int]:
    """Lengths of the pieces of ``n`` ids: as many of ``longest`` as fit, then falling powers of two."""
    return [longest] * (n // longest) + [1 << k for k in reversed(range(longest.bit_length() - 1)) if n % longest >> k & 1]


def pack_powers_of_two(docs: DataFrame, length: int = 1024, end_id: int = 0, tokenizer: str | None = None, added_tokens: bool = False, batch_tokens: int = BATCH_TOKENS, most_runs: int = MAX_RUNS) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text), batch by batch: doc_id, start, length, bucket, ids (little-endian unsigned 32-bit), doc_tokens,
    sequence_id, offset, batch_id and place. ``most_runs``: what a worker's encoder remembers at most."""
    if length < 1 or length & (length - 1) or batch_tokens < length:
        raise ValueError("length must be a power of two, and a batch hold one sequence at least")
    definition, end = tokenizer_file(docs.sparkSession, tokenizer), np.array([end_id], "<u4").tobytes()
    names, kinds = zip(*((n, _KINDS[t]) for n, t in (x.split() for x in PIECES.split(", "))), strict=True)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 33
        encode, sequence, made = encoder(definition, added_tokens, most_runs), first, first
        open_batches: list[list[tuple]] = [[] for _ in range(length.bit_length())]

        def whole(rows: list[tuple]) -> pa.RecordBatch:
            columns = [*zip(*rows, strict=True), [made] * len(rows), range(len(rows))]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids, at = encode(text.as_py()) + end, 0
                n = len(ids) // 4
                for size in cuts(n, length):
                    bucket = size.bit_length() - 1
                    rows = open_batches[bucket]
                    rows.append((doc_id, at, size, bucket, ids[4 * at : 4 * (at + size)], n, sequence, 0))
                    at, sequence = at + size, sequence + 1
                    if len(rows) << bucket >= batch_tokens:
                        yield whole(rows)
                        made += 1
                        rows.clear()
        for rows in open_batches:
            if rows:
                yield whole(rows)
                made += 1

    return docs.select("doc_id", "text").mapInArrow(pieces, PIECES)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_powers_of_two(table(spark, sf_dir, "documents"), added_tokens=True)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket", "batch_id", "place")
