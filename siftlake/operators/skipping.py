"""Data skipping: a Bloom sketch of the letters in each data file, so that a scan opens only files that can hold a match.

A keyword or required literal stands for its overlapping grams of ``GRAM`` bytes (a shorter one is a gram by itself). The sketch of a file is a bitmap of the grams of its lower-cased
texts. A file can be left out if no pattern has a keyword, and all its required literals, whose grams are all there; a literal that is in a text has all its grams there, so no
match is lost. Sketches don't depend on the catalogue: one serves every later scan.

It speaks of what ``extract.scan`` finds. Decoding, joined fragments and continued lines find values whose keyword isn't in the text as it stands; scans with these read all files.

Nulls and odd rows: null and empty texts set no bits; a file without rows has an empty sketch; a file that is new, or whose size or time has changed since, is read; an empty
catalogue needs no file. Texts may have any length: they are hashed in slices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.plans.detectors import Detector

#: Bytes of a gram, and of those of literals that are shorter; one or two bytes tell nothing, so files aren't left out for them.
GRAM, SHORT = 4, 3
#: Bits of one stored piece: what Spark's bitmap functions hold.
PIECE = 1 << 15
#: Characters that are hashed at once.
SLICE = 1 << 20


def _hashed(data: np.ndarray, width: int, bits: int) -> np.ndarray:
    """Places of all grams of ``width`` bytes in the bitmap."""
    if len(data) < width:
        return np.empty(0, np.int64)
    gram = np.zeros(len(data) - width + 1, np.uint64)
    for k in range(width):
        gram |= data[k : len(data) - width + 1 + k].astype(np.uint64) << np.uint64(8 * k)
    gram = (gram + np.uint64(width << 40)) * np.uint64(0x9E3779B97F4A7C15)  # the golden ratio's multiplier; wraps
    return ((gram >> np.uint64(32)) % np.uint64(bits)).astype(np.int64)


def places(literal: str, bits: int) -> list[int]:
    """The bits that a text with this literal has set; none for a literal that is too short to tell."""
    data = np.frombuffer(literal.lower().encode(), np.uint8)
    width = GRAM if len(data) >= GRAM else SHORT
    return sorted(set(_hashed(data, width, bits).tolist()))


def _grams(pieces: int):
    bits = pieces * PIECE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}

        def rows():
            for key, flags in held.items():
                for piece in np.flatnonzero(flags.reshape(pieces, PIECE).any(axis=1)).tolist():
                    yield (*key, piece, np.packbits(flags[piece * PIECE : (piece + 1) * PIECE], bitorder="little").tobytes())

        def flush() -> Iterator[pa.RecordBatch]:
            out = list(rows())
            held.clear()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.binary()), strict=True)], ["file", "piece", "bits"])

        for batch in batches:
            for file, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if (file,) not in held and len(held) >= 64:  # a task may have many small files
                    yield from flush()
                flags = held.setdefault((file,), np.zeros(bits, bool))
                text = text.as_py() or ""
                for at in range(0, len(text), SLICE):  # slices overlap by a gram
                    data = np.frombuffer(text[at : at + SLICE + GRAM].encode("utf-8", "surrogatepass"), np.uint8)
                    for width in (SHORT, GRAM):
                        flags[_hashed(data, width, bits)] = True
        yield from flush()

    return run


def sketches(spark: SparkSession, data: str, text: str = "text", pieces: int = 32) -> DataFrame:
    """The sketch of each Parquet file below ``data``: file, size, changed, pieces, and bits, a map of the pieces that aren't empty.

    Grams become bits in the task that reads them, and Spark unites the pieces of a file, so at most ``pieces`` times 4 KB of a task's part of a file is exchanged. One piece holds 32,768
    bits; the default of 32 pieces keeps files of some 100 MB of prose under a third full.
    """
    texts = spark.read.parquet(data).select(F.col("_metadata.file_path").alias("file"), F.lower(text).alias("text"))
    parts = texts.mapInArrow(_grams(pieces), "file string, piece long, bits binary").groupBy("file", "piece").agg(F.bitmap_or_agg("bits").alias("bits"))
    whole = parts.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("piece", "bits"))).alias("bits"))
    files = data_files(spark, data)
    return files.join(whole, "file", "left").select("file", "size", "changed", F.lit(pieces).alias("pieces"), F.coalesce("bits", F.create_map().cast("map<long,binary>")).alias("bits"))


def data_files(spark: SparkSession, data: str) -> DataFrame:
    """The Parquet files below a path, without opening them: file, size, changed."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(data)
    return listed.select(F.col("_metadata.file_path").alias("file"), F.col("length").alias("size"), F.col("modificationTime").alias("changed"))


def _needs(detectors: tuple[Detector, ...], bits: int) -> list[tuple[list[list[int]], list[int]]]:
    """For each pattern: the bits of each of its keywords, and those that it needs whatever the keyword."""
    return [([places(k, bits) for k in d.keywords], sorted({b for r in p.required for b in places(r, bits)})) for d in detectors for p in d.patterns if d.keywords]


def may_match(sketch: DataFrame, detectors: tuple[Detector, ...]) -> DataFrame:
    """Sketches of files that can hold a match of one of the detectors. Bits are tested with numpy, batch by batch; a file's row is all that is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        needs: dict[int, list] = {}
        for batch in batches:
            keep = []
            for pieces, found in zip(batch.column("pieces").to_pylist(), batch.column("bits").to_pylist(), strict=True):
                flags = np.zeros((pieces, PIECE), bool)
                for piece, data in found:
                    flags[piece] = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[:PIECE]
                flags = flags.ravel()
                wanted = needs.setdefault(pieces, _needs(detectors, pieces * PIECE))
                keep.append(any(flags[required].all() and any(flags[k].all() for k in keys) for keys, required in wanted))
            yield batch.select(["file", "size", "changed"]).filter(pa.array(keep, pa.bool_()))

    return sketch.select("file", "size", "changed", "pieces", "bits").mapInArrow(run, "file string, size long, changed timestamp")


def files_to_read(spark: SparkSession, data: str, sketch: DataFrame, detectors: tuple[Detector, ...]) -> DataFrame:
    """The files below ``data`` that a scan by these detectors has to open (file): those that can match, and those that the sketch doesn't know as they are now."""
    now, key = data_files(spark, data), ["file", "size", "changed"]
    unknown = now.join(sketch.select(*key), key, "left_anti")
    return now.join(may_match(sketch, detectors), key, "left_semi").unionByName(unknown).select("file")


def read_matching(spark: SparkSession, data: str, sketch: DataFrame, detectors: tuple[Detector, ...]) -> DataFrame:
    """The rows of the files that have to be opened. Their names are what the driver lists for any read of these files; no file is opened to choose them."""
    names = [r.file for r in files_to_read(spark, data, sketch, detectors).collect()]
    whole = spark.read.parquet(data)
    return spark.read.schema(whole.schema).parquet(*names) if names else whole.limit(0)
