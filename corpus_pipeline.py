"""A training corpus from ``documents``: stages that each take and return the table, written as Parquet in between.

Language ID drops documents without a letter or far from every language; near-dedup keeps the document with the smallest
``doc_id`` of each group; substring dedup cuts repeated passages out of the texts (and drops documents of which nothing is left);
decontamination drops documents with a leaked benchmark item; packing gives the training sequences.

All stages run in the same executors, whose Python workers and off-heap buffers keep what they once took. So the stages bound the bytes of an Arrow
batch, in the session (``run`` puts the session's own bound back), and packing remembers fewer runs than ``op6_packing``; neither changes a result.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.llm.common import shared_path, stored, table
from siftlake.llm.decontaminate import leaks
from siftlake.llm.language import UNKNOWN, learn_profiles, predict
from siftlake.llm.minhash import near_duplicates
from siftlake.llm.packing import pack_powers_of_two
from siftlake.llm.substrings import remove_repeated

#: Least score of a document's language. Texts in a learned language score 0.4 and more; 0 shares no n-gram with any.
LEAST_SCORE = 0.2
#: Bytes of an Arrow batch of a stage, about. Spark's bound is 64 MB, which each task holds in buffers on both sides.
BATCH_BYTES, BATCH_CONF = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
#: Runs that a packing worker remembers at most.
MOST_RUNS = 200_000


def _small_batches(stage: Callable) -> Callable:
    @wraps(stage)
    def bounded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(BATCH_CONF))
        if now > BATCH_BYTES:
            spark.conf.set(BATCH_CONF, str(BATCH_BYTES))
        return stage(spark, docs, sf_dir)

    return bounded


@_small_batches
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = predict(docs, learn_profiles(docs.select("doc_id", "text", "lang")))
    return judged.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE)).drop("lang_pred", "score")


def _keyed(docs: DataFrame) -> DataFrame:
    """Each row as ``_row``, with ``_key``: a positive number for its doc_id (null or not) and text. Decisions are about rows, not about ids."""
    key = F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text").bitwiseAND((1 << 63) - 1)
    return docs.select(key.alias("_key"), F.struct(*docs.columns).alias("_row"))


@_small_batches
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicate texts: that with the smallest ``doc_id`` (null counts as largest), and one of rows that repeat it.

    Rows that share a ``doc_id`` are documents of their own; a text without words is in no group, but a row that repeats it goes.
    """
    keyed = _keyed(docs)
    grouped = near_duplicates(keyed.select(F.col("_key").alias("doc_id"), "_row.text")).select(F.col("doc_id").alias("_key"), "component_id").distinct()
    ids = keyed.select("_key", "_row.doc_id").distinct()
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_key"))
    kept = stored(grouped.join(ids, "_key").groupBy("component_id").agg(first.alias("first")).select("first._key"), "kept")
    # Rows that repeat a document go before the exchange, so that no task meets all of a hot one's; columns without an order (maps) come along.
    return keyed.dropDuplicates(["_key"]).join(kept.hint("merge"), "_key", "left_semi").select("_row.*")


@_small_batches
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = remove_repeated(docs).where("n_removed = 0 OR n_removed < n_words")
    return cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


@_small_batches
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a leaked benchmark item go, whatever their ``doc_id``."""
    keyed = _keyed(docs)
    found = leaks(keyed.select(F.col("_key").alias("doc_id"), "_row.text"), table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("_key")).distinct()
    return keyed.join(found, "_key", "left_anti").select("_row.*")


@_small_batches
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_powers_of_two(docs, added_tokens=True, most_runs=MOST_RUNS)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("decontamination", decontamination), ("packing", packing)]
#: SQL can't express the stages; tests/llm/test_pipeline.py compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, bound = table(spark, sf_dir, "documents"), spark.conf.get(BATCH_CONF)
    try:
        for name, stage in STAGES:
            path = shared_path(spark, f"pipeline-{name}")
            stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
    finally:
        spark.conf.set(BATCH_CONF, bound)
    return docs
