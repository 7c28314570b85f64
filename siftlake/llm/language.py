"""Language identification by rank-order profiles of character n-grams and their out-of-place distance.

A profile lists the most frequent n-grams (1 to 3 letters, words marked by a blank on either side) of a language in the
order of their counts. A document's own list is made from its whole text; its distance to a profile is the sum, over its
n-grams, of how far their ranks differ, or ``size`` for n-grams that the profile lacks. The nearest profile wins; the score is 1
minus the distance as a share of the largest possible. Ties go to the n-gram, and to the language, that sorts first.

Profiles are learned on a sample of at most about ``sample`` documents of each language (a bound of the fit, chosen by a hash of
doc_id; documents with fewer than ``sample`` in their language all count). Predictions read every document whole.

Nulls and odd rows: a text that is null or has no letter is ``und`` with score 0, as is any text if nothing was learned; rows without
a language or text aren't learned from; repeated rows are predicted each by itself; extra columns come along.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

PROFILE = 300
SAMPLE = 3000
#: Distinct languages that profiles are made for at most: they are sent to every task, 16 bytes for each n-gram of each, so 96 MB at most.
MAX_LANGUAGES = 20_000
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point itself if it is a letter, else 0."""
    return np.fromiter((c if chr(c).isalpha() else 0 for c in range(0x110000)), np.uint32, 0x110000)


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a text's letters (three code points of 21 bits in an integer, a blank as 1) and their counts."""
    if not text:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    points = _letters()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")].astype(np.int64)
    letter = points > 0
    if not letter.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # of a run of other characters, the first stays, as the blank
    points = np.concatenate([[1], np.maximum(points[keep], 1), [1]])
    if points[-2] == 1:
        points = points[:-1]
    one, two = points[points != 1], points[:-1] << 21 | points[1:]
    return np.unique(np.concatenate([one, two, two[:-1] << 21 | points[2:]]), return_counts=True)


def ranked(keys: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` most frequent n-grams in order; equal counts by the n-gram."""
    if len(keys) > size:  # all that can be in front, then their order
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        front = counts >= least
        keys, counts = keys[front], counts[front]
    return keys[np.lexsort((keys, -counts))[:size]]


def learn_profiles(docs: DataFrame, size: int = PROFILE, sample: int = SAMPLE) -> dict[str, list[int]]:
    """The profile of each language of ``docs`` (doc_id, text, lang); rows whose text or language is null are left out."""
    known = docs.where("text IS NOT NULL AND lang IS NOT NULL")
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return {}
    # At most MAX_LANGUAGES rows.
    shares = known.sparkSession.createDataFrame([(k, min(1.0, sample / n)) for k, n in counts.items()], "lang string, share double")
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = known.join(F.broadcast(shares), "lang").where(place < F.col("share")).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                keys, n = ngrams(text.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys, pa.int64()), pa.array(n, pa.int64())], ["lang", "gram", "n"])

    grams = chosen.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    found = grams.withColumn("place", place).where(F.col("place") <= size).orderBy("lang", "place").select("lang", "gram").collect()  # size rows for each language
    profiles: dict[str, list[int]] = {}
    for lang, gram in found:
        profiles.setdefault(lang, []).append(gram)
    return profiles


def predict(docs: DataFrame, profiles: dict[str, list[int]], size: int = PROFILE) -> DataFrame:
    """``docs`` (text and others) with lang_pred and score."""
    own = [c for c in docs.columns if c not in ("lang_pred", "score")]
    docs = docs.select(*own)
    names = sorted(profiles)
    # The n-grams of all profiles in order, each with its language and rank: only what the profiles hold, whatever their number.
    grams = np.array([g for n in names for g in profiles[n]], np.int64)
    langs = np.repeat(np.arange(len(names), dtype=np.int32), [len(profiles[n]) for n in names])
    places = np.concatenate([np.arange(len(profiles[n]), dtype=np.int32) for n in names]) if names else np.empty(0, np.int32)
    order = np.lexsort((langs, grams))
    sent = docs.sparkSession.sparkContext.broadcast((names, grams[order], langs[order], places[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, keys, langs, places = sent.value
        for batch in batches:
            found, scores = [], []
            for text in batch.column(batch.schema.get_field_index("text")):
                own, counts = ngrams(text.as_py())
                if not len(own) or not names:
                    found.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                own = ranked(own, counts, size)
                low, high = np.searchsorted(keys, own), np.searchsorted(keys, own, "right")
                times = high - low
                entry = np.repeat(low - np.cumsum(times) + times, times) + np.arange(times.sum())
                # All n-grams are ``size`` places off, but those that a profile has.
                nearer = size - np.abs(places[entry] - np.repeat(np.arange(len(own)), times))
                far = size * len(own) - np.bincount(langs[entry], weights=nearer, minlength=len(names))
                best = int(far.argmin())
                found.append(names[best])
                scores.append(1.0 - float(far[best]) / (size * len(own)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(run, schema)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1
    profiles = learn_profiles(docs.where(~held_out).select("doc_id", "text", "lang"))
    return predict(docs.select("doc_id", "text"), profiles).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
