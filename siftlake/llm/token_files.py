"""Token ids in binary files: fixed-width bit packing with block offsets, for random access by numpy.

A file holds documents in ascending ``doc_id`` order; a task begins another when one is full (``FILE_IDS``, ``FILE_DOCS``)::

    "SIFTBIT1" | blocks of BLOCK ids, each id in ``bits`` bits, the first id in the lowest bits
    doc_id int64[n] | doc_id is null uint8[n] | first id of each document, and the end, int64[n + 1]
    byte offset of each block, and of the end, int64[b + 1]
    bits, ids, documents, blocks, byte offset of the tables: int64[5] | "SIFTBIT1"

Nulls and ties: a null text is an empty text; rows with a null ``doc_id`` come first; rows with the same
``doc_id`` follow each other by the text's first ``HEAD`` characters, then by its hash, and keep their own ids; they may be spread over
several tasks, however many they are. An empty table makes no file.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import file_system, shared_path, table
from .tokens import encoder, tokenizer_file, vocabulary_size

MAGIC = b"SIFTBIT1"
#: Ids in a block; a multiple of 64, so that blocks of any width end at a 64-bit word.
BLOCK = 1 << 16
#: A file is full with so many ids, or documents: what a task holds of a file's tables, and what a reader fetches, is bounded by them.
FILE_IDS, FILE_DOCS = 1 << 26, 1 << 18
#: Characters of a text that tell rows of one ``doc_id`` apart when ranges are cut.
HEAD = 64
#: Bytes of input for each range, where that makes more of them than the session's number of partitions.
RANGE_BYTES = 64 << 20
#: Documents that one read unit takes.
UNIT_DOCS = 2048
#: Ids that a reader holds at once (whole documents; a longer document is read by itself, block by block).
READ_IDS = 1 << 20


def _lanes(bits: int):
    """For each of 64 ids in a row: the 64-bit word that it begins in, its shift there, and whether it runs into the next."""
    return [(k, k * bits // 64, np.uint64(k * bits % 64), k * bits % 64 + bits > 64) for k in range(64)]


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids in ``bits`` bits each, the first in the lowest bits; the last byte is filled with zeros."""
    rows = np.zeros((-(-len(ids) // 64), 64), np.uint64)
    rows.ravel()[: len(ids)] = ids
    words = np.zeros((len(rows), bits), "<u8")  # 64 ids take as many words as an id has bits
    for k, word, shift, over in _lanes(bits):
        words[:, word] |= rows[:, k] << shift
        if over:
            words[:, word + 1] |= rows[:, k] >> (np.uint64(64) - shift)
    return words.tobytes()[: -(-len(ids) * bits // 8)]


def unpack(data: bytes, bits: int, count: int) -> np.ndarray:
    n = -(-count // 64)
    words = np.frombuffer(data.ljust(n * bits * 8, b"\0"), "<u8", n * bits).reshape(n, bits)
    rows, mask = np.empty((n, 64), "<u4"), np.uint64((1 << bits) - 1)
    for k, word, shift, over in _lanes(bits):
        value = words[:, word] >> shift
        rows[:, k] = (value | words[:, word + 1] << (np.uint64(64) - shift) if over else value) & mask
    return rows.ravel()[:count]


class Writer:
    def __init__(self, uri: str, bits: int):
        fs, path = file_system(uri)
        self.out, self.bits = fs.open_output_stream(path), bits
        self.out.write(MAGIC)
        self.at, self.held, self.n_held = len(MAGIC), [], 0
        self.docs, self.nulls, self.starts, self.blocks = [], [], [0], []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.starts.append(self.starts[-1] + len(ids))
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= BLOCK:
            held = np.concatenate(self.held)
            whole = len(held) // BLOCK * BLOCK
            for k in range(0, whole, BLOCK):
                self._block(held[k : k + BLOCK])
            self.held, self.n_held = [held[whole:]], len(held) - whole

    def _block(self, ids: np.ndarray) -> None:
        self.blocks.append(self.at)
        data = pack(ids, self.bits)
        self.out.write(data)
        self.at += len(data)

    def close(self) -> tuple[int, int]:
        if self.n_held:
            self._block(np.concatenate(self.held))
        tables = [np.array(self.docs, "<i8"), np.array(self.nulls, np.uint8), np.array(self.starts, "<i8"), np.array([*self.blocks, self.at], "<i8"), np.array([self.bits, self.starts[-1], len(self.docs), len(self.blocks), self.at], "<i8")]
        self.out.write(b"".join(x.tobytes() for x in tables) + MAGIC)
        self.out.close()
        return len(self.docs), self.starts[-1]


class Reader:
    """Random access to a file's documents and ids."""

    def __init__(self, uri: str):
        fs, path = file_system(uri)
        self.file = fs.open_input_file(path)
        size, tail = self.file.size(), 40 + len(MAGIC)
        end = self.file.read_at(tail, size - tail)
        if end[40:] != MAGIC:
            raise ValueError(f"{uri} is not a whole token file")
        self.bits, self.n_ids, self.n_docs, self.n_blocks, at = map(int, np.frombuffer(end[:40], "<i8"))
        self._tables = at
        self.blocks = self._table(17 * self.n_docs + 8, self.n_blocks + 1, "<i8")

    def _table(self, skip: int, count: int, kind: str) -> np.ndarray:
        return np.frombuffer(self.file.read_at(count * np.dtype(kind).itemsize, self._tables + skip), kind)

    def documents(self, first: int, stop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """doc_id, whether it is null, and the first id (with the end) of some documents: reads their part of the tables only."""
        n = stop - first
        return self._table(8 * first, n, "<i8"), self._table(8 * self.n_docs + first, n, "u1").astype(bool), self._table(9 * self.n_docs + 8 * first, n + 1, "<i8")

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids from ``start`` up to ``stop``: reads the blocks that hold them in one range."""
        if start >= stop:
            return np.empty(0, "<u4")
        first, last = start // BLOCK, (stop - 1) // BLOCK + 1
        data = self.file.read_at(int(self.blocks[last] - self.blocks[first]), int(self.blocks[first]))
        count = min(last * BLOCK, self.n_ids) - first * BLOCK
        return unpack(data, self.bits, count)[start - first * BLOCK : stop - first * BLOCK]


def _ranges(docs: DataFrame) -> tuple[int, ...]:
    """The number of ranges, if the files that are read ask for more than the session's number of partitions."""
    leaves, total = docs._jdf.queryExecution().optimizedPlan().collectLeaves(), 0
    for k in range(leaves.size()):
        size = int(str(leaves.apply(k).stats().sizeInBytes()))
        total += size if size < 1 << 60 else 0  # more is Spark's word for unknown
    n = -(-total // RANGE_BYTES)
    return (n,) if n > int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) else ()


def write_token_files(docs: DataFrame, out: str, end_id: int = 2, tokenizer: str | None = None, added_tokens: bool = False) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write the files of each range of ``doc_id`` into the folder ``out``.

    Returns the manifest (part, seq, file, n_docs, n_ids), which names only the files of attempts that succeeded: a task that
    is run again writes other files, which then count. Files ascend with ``doc_id`` by part and seq.
    """
    spark, definition = docs.sparkSession, tokenizer_file(docs.sparkSession, tokenizer)
    bits = max(1, int(max(vocabulary_size(tokenizer) - 1, end_id)).bit_length())
    end = np.array([end_id], "<u4").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, part, writer, seq, name = encoder(definition, added_tokens), TaskContext.get().partitionId(), None, 0, ""

        def closed() -> pa.RecordBatch:
            n_docs, n_ids = writer.close()
            return pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "file": [name], "n_docs": [n_docs], "n_ids": [n_ids]})

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if writer is not None and (writer.starts[-1] >= FILE_IDS or len(writer.docs) >= FILE_DOCS):
                    yield closed()
                    writer, seq = None, seq + 1
                if writer is None:
                    file_system(out)[0].create_dir(file_system(out)[1], recursive=True)
                    name = f"{out}/part-{part:06d}-{seq:06d}-{uuid.uuid4().hex}.bits"
                    writer = Writer(name, bits)
                writer.add(doc_id, np.frombuffer(encode(text.as_py()) + end, "<u4"))
        if writer is not None:
            yield closed()

    # Rows of one doc_id can be in several ranges, equal rows too: they differ in the last key only.
    order = [F.col(c).asc_nulls_first() for c in ("doc_id", "_head", "_hash", "_row")]
    keyed = docs.select("doc_id", "text", F.left("text", F.lit(HEAD)).alias("_head"), F.xxhash64("text").alias("_hash"), F.monotonically_increasing_id().alias("_row"))
    ranged = keyed.repartitionByRange(*_ranges(docs), *order).sortWithinPartitions(*order).select("doc_id", "text")
    manifest = shared_path(spark, "token-manifest")
    schema = "part long, seq long, file string, n_docs long, n_ids long"
    ranged.mapInArrow(write, schema).write.parquet(manifest)
    return spark.read.schema(schema).parquet(manifest)


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    units = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).withColumn("first", F.explode(F.expr(f"sequence(0L, n_docs - 1, {UNIT_DOCS}L)")))
    n = manifest.agg(F.sum(F.ceil(F.col("n_docs") / UNIT_DOCS))).first()[0] or 1

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for unit in batch.to_pylist():
                reader, rows = Reader(unit["file"]), []
                n_docs = min(UNIT_DOCS, reader.n_docs - unit["first"])
                (doc_ids, nulls, starts), k = reader.documents(unit["first"], unit["first"] + n_docs), 0
                while k < n_docs:
                    upto = max(k + 1, int(np.searchsorted(starts, starts[k] + READ_IDS, "right")) - 1)
                    if upto == k + 1 and starts[upto] - starts[k] > READ_IDS:
                        crc = 0
                        for at in range(int(starts[k]), int(starts[upto]), READ_IDS):
                            crc = zlib.crc32(reader.ids(at, min(at + READ_IDS, int(starts[upto]))).tobytes(), crc)
                        crcs = [crc]
                    else:
                        data = reader.ids(int(starts[k]), int(starts[upto])).tobytes()
                        cuts = (starts[k : upto + 1] - starts[k]) * 4
                        crcs = [zlib.crc32(data[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                    rows += [(None if nulls[i] else int(doc_ids[i]), unit["base"] + int(starts[i]), int(starts[i + 1] - starts[i]), c) for i, c in zip(range(k, upto), crcs, strict=True)]
                    k = upto
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return units.repartition(min(int(n), 100_000), "part", "seq", "first").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_path(spark, "token-files")
    return read_token_files(write_token_files(table(spark, sf_dir, "documents"), out, added_tokens=True))
