"""Data skipping: files that can't match aren't opened, and nothing is lost."""

import random

from pyspark.sql import functions as F

from siftlake.operators import extract, skipping
from siftlake.plans.detectors import BUILT_IN, Detector, Pattern

CHUNK = "doc_id long, path string, text string, base_line long, base_offset long"
DETECTORS = tuple(d for d in BUILT_IN if d.id in ("github-classic-pat", "stripe-live-key"))


def written(spark, folder, *groups):
    """A Parquet file for each group of texts."""
    n = 0
    for group in groups:
        rows = [(n + k, f"f{n + k}", t, 0, 0) for k, t in enumerate(group)]
        n += len(group)
        spark.createDataFrame(rows, CHUNK).coalesce(1).write.mode("append").parquet(folder)
    return folder


def opened(frame):
    """Files that the scans of a plan read, by their metrics."""
    frame.write.format("noop").mode("overwrite").save()
    frame.collect()
    plan, found = frame._jdf.queryExecution().executedPlan(), []

    def walk(node):
        metrics = node.metrics()
        if metrics.contains("numFiles"):
            found.append(metrics.apply("numFiles").value())
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            walk(node.executedPlan())
        children = node.children()
        for k in range(children.size()):
            walk(children.apply(k))

    walk(plan)
    return sum(found)


def values(rows, detectors=DETECTORS):
    return sorted((r.doc_id, r.detector_id, r.value, r.line_no) for r in extract.scan(rows, detectors).collect())


def test_only_files_that_can_match_are_opened(spark, tmp_path):
    token, key = "ghp_" + "aB3" * 12, "sk_live_" + "x1" * 12
    prose = [" ".join(random.Random(k).choices("the quick brown fox jumps over lazy dogs and ghosts".split(), k=200)) for k in range(8)]
    data = written(spark, str(tmp_path / "data"), prose[:4], [f"t = {token.upper()[:4].lower()}{token[4:]}", None], prose[4:], [None, ""], [f"é\U0001f600 {key}"], [])
    sketch = skipping.sketches(spark, data)
    sketch.write.parquet(str(tmp_path / "sketch"))
    sketch = spark.read.parquet(str(tmp_path / "sketch"))
    n_files = skipping.data_files(spark, data).count()
    assert sketch.count() == n_files
    found = skipping.read_matching(spark, data, sketch, DETECTORS)
    assert values(found) == values(spark.read.parquet(data)) and len(values(found)) == 2
    assert opened(found.select("text")) == 2 < n_files == opened(spark.read.parquet(data).select("text"))
    assert skipping.read_matching(spark, data, sketch, DETECTORS[:1]).count() == 2
    assert skipping.read_matching(spark, data, sketch, ()).count() == 0
    written(spark, data, [f"later {token}"])  # a file that the sketch doesn't know
    assert len(values(skipping.read_matching(spark, data, sketch, DETECTORS))) == 3


def test_no_literal_is_ever_missed(spark, tmp_path):
    pick = random.Random(5)
    letters = "abcdefgh-_é東\U0001f600 "
    texts = ["".join(pick.choices(letters, k=pick.randint(0, 40))) for _ in range(60)]
    data = written(spark, str(tmp_path / "data"), *[texts[k : k + 6] for k in range(0, 60, 6)])
    sketch = skipping.sketches(spark, data, pieces=1)
    for n in (1, 2, 3, 4, 5, 9):
        literals = [t[at : at + n] for t in texts if len(t) >= n for at in [pick.randrange(len(t) - n + 1)]]
        for literal in literals[:4]:
            one = (Detector("d", "d", "s", "low", (literal,), (Pattern(".", required=(literal,)),)),)
            rows = skipping.read_matching(spark, data, sketch, one)
            holds = F.contains(F.lower("text"), F.lit(literal.lower()))
            assert rows.where(holds).count() == spark.read.parquet(data).where(holds).count() > 0


def test_slices_of_long_texts_share_no_seam(monkeypatch):
    import pyarrow as pa

    text = "".join(random.Random(1).choices("abcdefghijklmnop", k=300))
    rows = lambda: list(skipping._grams(1)(iter([pa.RecordBatch.from_pydict({"file": ["f"], "text": [text]})])))
    whole = rows()
    monkeypatch.setattr(skipping, "SLICE", 7)
    assert rows()[0].column("bits").to_pylist() == whole[0].column("bits").to_pylist()
