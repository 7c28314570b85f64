"""Long texts in the scan: blocks with owned matches, decoding without a limit, every place of what repeats."""

import base64
import time

import pytest
from pyspark.sql import functions as F

from conftest import DATA
from siftlake.operators import decode, extract, windows
from siftlake.plans import engine
from siftlake.plans.detectors import BUILT_IN, Companion, Detector, Pattern, Relation
from siftlake.sources.tables import read, seeded_chunks

CHUNK = "doc_id long, path string, text string, base_line long, base_offset long"
TOKENS = ["ghp_" + f"{k:02d}aZ9bY8cX7dW6eV5fU4gT3hS2iR1jQ0kP9l"[:36] for k in range(4)]


def chunk(spark, *texts):
    return spark.createDataFrame([(k, f"f{k}", t, 0, 0) for k, t in enumerate(texts)], CHUNK)


def test_blocks_share_out_a_text(spark):
    texts = ["", None, "a", "one\ntwo\n" * 300, "word " * 900, "x" * 5000, "é\n" * 700 + "y" * 2500 + "\nend", "\n" * 3000, "a b c\r\n" * 400]
    for size, reach, lines in ((100, 20, 0), (256, 64, 3), (1 << 20, 10, 0)):
        rows = windows.blocks(chunk(spark, *texts), size, reach, lines).collect()
        by_doc = {}
        for r in rows:
            by_doc.setdefault(r.doc_id, []).append(r)
        assert sorted(by_doc) == [k for k, t in enumerate(texts) if t is not None]
        for k, found in by_doc.items():
            text, at = texts[k], 0
            for r in sorted(found, key=lambda r: r._skip + r._own.start):
                assert text[r._skip : r._skip + len(r.text)] == r.text and r._skip + r._own.start == at
                assert (r.base_line, r.base_offset) == (text[: r._skip].count("\n"), len(text[: r._skip].encode()))
                at = r._skip + r._own.end
            assert at == len(text)


@pytest.mark.parametrize("policy", ["fast", "deep"])
def test_windowed_scan_equals_the_whole(spark, policy):
    """All documents, with seeded values and blobs in the middle, by blocks and in one."""
    docs = seeded_chunks(read(spark, DATA, "documents"))
    if policy == "deep":
        blob = F.base64(F.encode(F.concat(F.lit("k ghp_"), F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 36), F.lit(" z")), "UTF-8"))
        half = (F.length("text") / 2).cast("int")
        docs = docs.withColumn("text", F.concat(F.left("text", half), F.lit("\n"), blob, F.lit(" "), blob, F.lit("\n"), F.substring("text", half + 1, F.length("text"))))
    wanted = ("doc_id", "path", "detector_id", "value", "line_no", "byte_offset", "context", F.to_json("companions"), "channel")
    part, whole = (sorted((str(tuple(r)) for r in engine.candidates(docs, BUILT_IN, policy, window).select(*wanted).distinct().collect())) for window in (4096, 1 << 30))
    assert part == whole and len(part) > 200


def test_state_and_companions_cross_blocks(spark):
    far = "filler line\n" * 600
    wanted = (Detector("k", "K", "s", "low", ("key1",), (Pattern("KEY1"),), (Companion("near", "peer=([a-z]+)", 1, 40),)),)
    lines = [f"{n} " + "z" * 60 for n in range(30)]
    texts = ["```\n" + far + "KEY1", "```\n" + far + "```\n" + far + "x = KEY1", "-----BEGIN PGP MESSAGE-----\n" + far + "KEY1", far + "\n".join(["peer=abc", *lines, "KEY1"]) + far, far + "peer=no\n" + "\n" * 41 + "KEY1"]
    rows = extract.scan(chunk(spark, *texts), wanted, context=True, window=1024).collect()
    assert {r.doc_id: r.context for r in rows} == {0: "documentation", 1: "assignment", 2: "encrypted", 3: "unknown", 4: "unknown"}
    assert {r.doc_id: r.companions.get("near") for r in rows if r.doc_id > 2} == {3: "abc", 4: None}
    assert all(texts[r.doc_id][r.at :].startswith("KEY1") and texts[r.doc_id].count("\n", 0, r.at) + 1 == r.line_no for r in rows)


def test_long_texts_are_decoded_and_repeats_keep_their_places(spark):
    """A token in base64 behind more than a million characters; one on two lines; one in a blob of many blocks' length."""
    blob = lambda t: base64.b64encode(f"x {t} y".encode()).decode()
    large = base64.b64encode(("words and more " * 9000 + TOKENS[2] + " end").encode()).decode()
    texts = ["some words here\n" * 70_000 + blob(TOKENS[0]), f"a {blob(TOKENS[1])}\n\nb {blob(TOKENS[1])}\nend", f"v {large}\n"]
    found = engine.full_scan(chunk(spark, *texts), BUILT_IN[1:2], "default").collect()
    assert {(r.doc_id, r.line_no, r.channel, tuple(r.locations)) for r in found} == {(0, 70_001, "decoded", ()), (1, 1, "decoded", (3,)), (2, 1, "decoded", ())}


def test_cost_is_linear_in_the_text(spark):
    """Five million characters with a match on every tenth line: the tenth of them takes about the tenth of the time."""
    line = "plain words in a row\n" * 9
    make = lambda n: "".join(f"{line}t = ghp_{k:036d}\n" for k in range(n))
    seconds = []
    for n in (2_400, 24_000):
        rows = chunk(spark, make(n))
        began = time.time()
        assert extract.scan(rows, BUILT_IN[1:2], context=True, window=engine.WINDOW).count() == n
        seconds.append(time.time() - began)
    assert seconds[1] < 40 * max(seconds[0], 0.5)


def test_relations_are_one_pass(spark):
    def wanted(n):
        return (Detector("a", "A", "s", "low", ("aa",), (Pattern("aa[0-9]+"),), relations=tuple(Relation("conflicts", f"b{k}", k + 1) for k in range(n))), *(Detector(f"b{k}", "B", "s", "low", ("bb",), (Pattern(f"bb{k}"),)) for k in range(n)))

    rows = chunk(spark, "aa1\n\n\nbb2\naa5")
    scans = [extract.with_relations(extract.scan(rows, wanted(n)), wanted(n))._jdf.queryExecution().executedPlan().toString().count("Scan ExistingRDD") for n in (1, 3, 5)]
    assert scans[0] == scans[1] == scans[2]
    assert sorted((r.detector_id, r.line_no) for r in extract.with_relations(extract.scan(rows, wanted(3)), wanted(3)).collect()) == [("b2", 4)]
    # By definition, over random matches, sides and distances.
    import random

    rng = random.Random(4)
    found = [(rng.randrange(3), f"f{rng.randrange(2)}", rng.choice("abcd"), k // 3, 10 * k + rng.randrange(9) if k % 7 else None) for k in range(400)]
    matches = spark.createDataFrame(found, "doc_id long, path string, detector_id string, line_no long, byte_offset long")
    cases = [Relation(kind, "b", lines, size, side) for kind in ("requires", "conflicts") for lines, size in ((0, None), (2, 30), (5, None)) for side in ("any", "before", "after")]
    for r in cases:
        detectors = (Detector("a", "A", "s", "low", ("a",), (Pattern("a"),), relations=(r, Relation("conflicts", "c", 1))),)

        def near(own, other, r):
            side = True
            if r.direction != "any" or r.within_bytes is not None:
                if own[4] is None or other[4] is None:
                    return False
                side = r.direction == "any" or (other[4] < own[4] if r.direction == "before" else other[4] > own[4])
                side = side and (r.within_bytes is None or abs(other[4] - own[4]) <= r.within_bytes)
            return side and own[:2] == other[:2] and other[2] == r.detector and abs(own[3] - other[3]) <= r.within_lines

        def stays(own):
            if own[2] != "a":
                return True
            return (any(near(own, o, r) for o in found) == (r.kind == "requires")) and not any(near(own, o, detectors[0].relations[1]) for o in found)

        expected = sorted(map(str, (o for o in found if stays(o))))
        assert sorted(str(tuple(x)) for x in extract.with_relations(matches, detectors).collect()) == expected, r


def test_decoding_of_one_place_by_two_decoders_is_one_finding(spark):
    rows = decode.splice_through(chunk(spark, "k " + b"x ghp_ab \n".hex() + " z"), 2, ("hex", "base64"))
    assert [r.via for r in rows.where("text LIKE '%ghp@_ab%' ESCAPE '@'").collect()] == ["hex"]


def test_candidates_equal_plain_python(spark):
    """All documents: patterns, assignments and tokens by Python's own regular expressions, with places and classes by counting."""
    import math
    import re
    from collections import Counter

    from siftlake.operators import context

    docs = seeded_chunks(read(spark, DATA, "documents"))
    found = engine.candidates(docs, BUILT_IN, "fast", 4096).where("channel IN ('pattern', 'assignment', 'entropy')")
    got = Counter((r.doc_id, r.detector_id, r.value, r.line_no, r.byte_offset, r.context) for r in found.collect())

    def entropy(v):
        counts = Counter(v.encode())
        return -sum(n / len(v.encode()) * math.log2(n / len(v.encode())) for n in counts.values())

    def place(text, path, start):
        before, line = text[:start], text[text.rfind("\n", 0, start) + 1 :].split("\n", 1)[0]
        count = lambda rx: len(re.findall(rx, before, re.M))
        if count(context.BEGIN_ENCRYPTED) > count(context.END_ENCRYPTED):
            kind = "encrypted"
        elif re.search(context.TEST_PATH, path.lower()):
            kind = "test"
        elif re.search(context.DOCUMENTATION_PATH, path.lower()) or count('"""') % 2 or count("^```") % 2:
            kind = "documentation"
        else:
            kind = next((k for k, rx in (("comment", context.COMMENT), ("assignment", context.ASSIGNED), ("string", "[\"'`]")) if re.search(rx, line)), "unknown")
        return line, before.count("\n") + 1, len(before.encode()), kind

    expected = Counter()
    detectors = [*(d for d in BUILT_IN if d.id not in engine.GENERIC), engine.ASSIGNMENT, engine.ENTROPY_TOKEN]
    for r in docs.collect():
        for d in detectors:
            if not any(k in r.text.lower() for k in d.keywords):
                continue
            for p in d.patterns:
                for m in re.finditer(p.regex, r.text, re.ASCII):
                    value, start = m.group(p.group), m.start(p.group)
                    line, line_no, offset, kind = place(r.text, r.path, start)
                    if d is engine.ENTROPY_TOKEN:
                        e = entropy(value)
                        if not (re.search("(?i)token|secret|password|key|bearer", line) and e >= 3.5) and not (line.strip(" ") == value and e >= 4.5):
                            continue
                    expected[(r.doc_id, d.id, value, line_no, offset, kind)] += 1
    assert got == expected and len(expected) > 150
