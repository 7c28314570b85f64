"""The pipeline's stages against brute force on the smallest tables."""

import random
from collections import Counter

import corpus_pipeline
import pyarrow as pa
import pytest
from conftest import DATA
from pyspark.sql import functions as F
from siftlake.llm.common import stored, table
from test_llm import brute_components, brute_removed, texts_of


def test_stages_equal_brute_force(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_dedup", "substring_dedup", "decontamination", "packing"]
    docs, results = table(spark, DATA, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = results[name] = stored(stage(spark, docs, DATA), name)
        assert name == "packing" or docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    rows = lambda n: [(r.doc_id, r.text) for r in results[n].collect()]
    assert {d for d, _ in rows("language_id")} == {d for d, t, _, _ in texts_of() if any(c.isalpha() for c in t)}
    kept = {d for d, (_, _, k) in brute_components(rows("language_id"), 5).items() if k}
    assert {d for d, _ in rows("near_dedup")} == kept
    want = Counter((d, text) for (d, n, gone, text), c in brute_removed(rows("near_dedup"), 13).items() if gone < n or not n)
    assert Counter((d, " ".join(t.split())) for d, t in rows("substring_dedup")) == want
    bench = [" ".join(r.text.lower().split()) for r in table(spark, DATA, "benchmark").collect()]
    clean = {d for d, _ in rows("decontamination")}
    for d, t in rows("substring_dedup"):
        whole = " ".join(t.lower().split())
        assert not (any(b in whole for b in bench) and d in clean)
    assert len(clean) >= len(want) - 15
    last = results["packing"]
    assert {r.doc_id for r in last.select("doc_id").distinct().collect()} == clean
    assert last.where(F.length("ids") != 4 * F.col("length")).count() == 0


def test_stages_take_odd_rows(spark):
    rows = [(1, None, None, None, None), (None, "some words in a text " * 20, "en", "a", 5), (None, "some words in a text " * 20, "en", "a", 5), (2, "some words in a text " * 20, "en", None, 5), (2, "some words in a text " * 20, "en", None, 5), (3, "", "de", "b", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    # No letter: gone. Of rows with equal texts that with the smallest id stays.
    for df, n in ((docs, 1), (docs.limit(0), 0)):
        for name, stage in corpus_pipeline.STAGES[:4]:
            df = stored(stage(spark, df, DATA), name)
        assert df.count() == n


def test_stages_decide_on_rows_not_ids(spark):
    rng = random.Random(12)
    say = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    one, other, lone, lost = say(80), say(80), say(80), say(80)
    near = " ".join(["changed", *one.split()[1:]])
    item = next(r.text for r in table(spark, DATA, "benchmark").collect() if r.text and len(r.text.split()) > 20)
    rows = [(1, one), (1, other), (2, near), (None, lone), (None, lone), (None, near), (None, lost), (3, f"{say(30)} {item} {say(30)}"), (None, f"{say(30)} {item} {say(30)}"), (4, None), (4, None), (5, "")]
    docs = spark.createDataFrame([(d, t, "en", "a", 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").withColumn("_number", F.lit("mine"))
    kept = corpus_pipeline.near_dedup(spark, docs, DATA)
    assert kept.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([rows[k] for k in (0, 1, 3, 6, 7, 8, 9, 11)])
    clean = corpus_pipeline.decontamination(spark, docs, DATA)
    assert Counter((r.doc_id, r.text) for r in clean.collect()) == Counter(r for k, r in enumerate(rows) if k not in (7, 8))


def test_near_dedup_keeps_columns_without_an_order(spark):
    rows = [(1, "one text of some words here", {"a": 1}), (1, "one text of some words here", {"b": 2}), (2, "another text altogether it is", None), (None, None, {"c": 3}), (None, None, {"c": 3})]
    docs = spark.createDataFrame(rows, "doc_id long, text string, more map<string, int>")
    kept = corpus_pipeline.near_dedup(spark, docs, "").collect()
    assert sorted((r.doc_id, r.text) for r in kept if r.doc_id) == [(1, rows[0][1]), (2, rows[2][1])] and len(kept) == 3


@pytest.mark.parametrize("stage", ["language_id", "near_dedup", "substring_dedup", "decontamination", "packing"])
def test_stages_bound_the_bytes_of_batches(spark, stage):
    def seen(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["n", "bytes"])

    docs = spark.range(0, 1500, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.lit("word "), F.col("id").cast("string")), 1000).alias("text"), F.lit("en").alias("lang"), F.lit("a").alias("source"), F.lit(1).alias("n_chars"))
    bound = spark.conf.get(corpus_pipeline.BATCH_CONF)
    try:
        dict(corpus_pipeline.STAGES)[stage](spark, docs.limit(3), DATA)
        found = docs.select("doc_id", "text").mapInArrow(seen, "n long, bytes long").collect()
        assert sum(r.n for r in found) == 1500 and max(r.bytes for r in found) < 2 * corpus_pipeline.BATCH_BYTES
        spark.conf.set(corpus_pipeline.BATCH_CONF, "1m")  # a smaller bound of the session stays
        dict(corpus_pipeline.STAGES)[stage](spark, docs.limit(3), DATA)
        assert spark.conf.get(corpus_pipeline.BATCH_CONF) == "1m"
    finally:
        spark.conf.set(corpus_pipeline.BATCH_CONF, bound)


def test_packing_remembers_few_runs():
    import public_tokenizers
    from siftlake.llm.tokens import Encoder

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        definition = f.read()
    few, many = Encoder(definition, True, most_runs=20), Encoder(definition, True)
    for text in (" ".join(f"w{k % 50} x{k} caf\u00e9{k % 7}" for k in range(300)), "again w1 x1 w1"):
        assert few(text) == many(text)
        assert len(few.runs) + len(few.runs.before) <= 20
