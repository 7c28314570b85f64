"""Queries: scans that skip files, candidates scored by a mixture of experts, and strings of binary sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake import storage
from siftlake.functions import text as T
from siftlake.operators import extract, mixture, skipping
from siftlake.sources.binaries import section_strings
from siftlake.sources.tables import SEEDED, read, scan_sql, seeded_chunks

from . import engine
from .detectors import BUILT_IN
from .registry import query

#: Detectors whose keywords few texts hold.
RARE = tuple(d for d in BUILT_IN if d.id in ("github-classic-pat", "gitlab-pat", "slack-bot-token", "stripe-live-key"))


@query(f"WITH {SEEDED}, {scan_sql(RARE, 'seeded')} SELECT doc_id, detector_id, sha256(value) AS credential_hash, line_no, byte_offset FROM matches")
def scan_skipping(spark: SparkSession, folder: str) -> DataFrame:
    """A scan of files that are laid out by what their texts end with, of which the sketch lets it open only those that can match."""
    data, beside = storage.shared_path(spark, "skipping-data"), storage.shared_path(spark, "skipping-sketch")
    seeded_chunks(read(spark, folder, "documents")).repartitionByRange(F.pmod("doc_id", F.lit(10)), "doc_id").write.parquet(data)
    skipping.sketches(spark, data).write.parquet(beside)
    found = extract.scan(skipping.read_matching(spark, data, spark.read.parquet(beside), RARE), RARE)
    return found.select("doc_id", "detector_id", F.sha2("value", 256).alias("credential_hash"), "line_no", "byte_offset")


@query()
def mixture_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates of the texts that are certain either way (a known format that nothing drops; an assignment or token that the ladder drops), scored by a model that is fitted on four fifths of the values."""
    path = storage.shared_path(spark, "mixture-candidates")
    judged = engine.judged(engine.candidates(seeded_chunks(read(spark, folder, "documents")), policy="fast"), policy="fast")
    named = F.col("channel") == "pattern"
    label = F.when(named & F.col("stage").isNull(), True).when(~named & F.col("stage").isNotNull(), False)
    held_out = F.pmod(F.crc32(F.encode("value", "UTF-8")), F.lit(5)) == 0
    judged.select("doc_id", "detector_id", "channel", "value", "line", "path", label.alias("label"), held_out.alias("held_out")).where("label IS NOT NULL").write.parquet(path)
    rows = spark.read.parquet(path)
    model = mixture.fit(rows.where("NOT held_out"), steps=40, rate=0.05)
    p = mixture.probability(model, F.col("value"), F.col("line"), F.col("path"))
    return rows.select("doc_id", "detector_id", "channel", T.redact(F.col("value")).alias("redacted"), "label", "held_out", F.round(p, 6).alias("probability"))


def _section(kind: int, body: Column) -> Column:
    """A WebAssembly section: its id, its length in five groups of seven bits, and its bytes."""
    n = F.octet_length(body)
    groups = (F.lpad(F.hex((F.shiftright(n, 7 * k).bitwiseAND(127)).bitwiseOR(128 if k < 4 else 0)), 2, "0") for k in range(5))
    return F.concat(F.unhex(F.concat(F.lit(f"{kind:02X}"), *groups)), body)


@query("""SELECT doc_id, 'wasm' AS format, 'data' AS section, 'ascii' AS encoding, sha256(run) AS text_hash FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[ -~]{6,}')) AS run FROM documents)
UNION ALL SELECT doc_id, 'wasm', 'key', 'utf-16', sha256('ghp_' || sha256(doc_id::VARCHAR)[1:36]) FROM documents""")
def binary_sections(spark: SparkSession, folder: str) -> DataFrame:
    """Strings of WebAssembly files whose data sections are the whole texts, and whose own sections hold a token in UTF-16."""
    key = F.concat(F.lit("ghp_"), F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 36))
    content = F.concat(F.unhex(F.lit("0061736D01000000")), _section(11, F.encode(F.coalesce("text", F.lit("")), "UTF-8")), _section(0, F.concat(F.unhex(F.lit("036B6579")), F.encode(key, "UTF-16LE"))))
    files = read(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("path"), content.alias("content"))
    return section_strings(files).select(F.col("path").cast("long").alias("doc_id"), "format", "section", "encoding", F.sha2("text", 256).alias("text_hash"))
