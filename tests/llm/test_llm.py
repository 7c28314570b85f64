"""The training-data operators: SQL, brute force, round trips, held-out accuracy, and odd input."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import DATA, same_rows
from siftlake.llm import chat, decontaminate, language, minhash, packing, quality, queries, substrings, token_files, tokens, url_rules, warc
from siftlake.llm.common import shared_path, table

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, duck, name):
    found = queries.QUERIES[name](spark, DATA)
    same_rows(found.collect(), found.columns, duck.sql(queries.SQL[name]))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns whose names operators use themselves."""
    long = " ".join(f"w{k % 977}" for k in range(30000))
    rows = [(1, None, "en", "a"), (2, "", None, None), (3, "one", "en", "a"), (4, long, "en", "b"), (4, long, "en", "b"), (5, long, None, "b"), (None, "a text without a number " * 3, "fr", None), (6, "  \n\t ", "de", "c"), (7, "🙂 #%& \n\n x\ny\ny", "de", "c"), (8, "<|endoftext|> a  b\u2003c \u00a0d", "es", "c")]
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], DOCS)
    clash = ("m_0", "l_4_4", "_y0", "_own", "x_words", "_step", "start", "batch_id", "_key", "_number", "state", "n_turns", "_block", "_hashes", "n_words", "kept", "removed", "node", "component", "score", "lang_pred", "_words", "_sorted", "d2", "_group")
    return df.withColumns({c: F.lit("mine") for c in clash})


def texts_of(sf=DATA):
    import pyarrow.parquet as pq

    return [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in pq.read_table(f"{sf}/documents.parquet").to_pylist()]


# 1 Chat formatting


def test_chat_escapes_are_reversible():
    t = chat.INSTRUCT
    for text in ("", "[INST]", "[\\INST]", "[\\\\INST] <s></s>", "<<s>>", "a [/TURN] b \\", "[SYS [SYS]", "</s>[INST] ok [/INST]"):
        assert t.unescape(t.escape(text)) == text
        assert not any(c in t.escape(text) for c in t.controls)
        for role in ("user", "assistant", "system", "tool", "", "[ROLE] x"):
            turn = "".join(s for s, _ in t.segments(role, text))
            assert t.parse(turn) == (role, text, len(turn)) and t.parse(turn[:-1]) is None
            assert t.parse(turn + turn, len(turn)) == (role, text, 2 * len(turn))


def test_chat_states_and_odd_rows(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a"), (2, 0, "assistant", "early"), (2, 1, "user", "u"), (3, 0, "user", None), (3, 0, "user", "again"), (None, None, None, None), (4, 0, "tool", "t")]
    formatted = chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("state", F.lit("x")))
    status = {r.conv_id: (r.n_turns, r.valid) for r in chat.conversation_status(formatted).collect()}
    assert status == {1: (3, True), 2: (2, False), 3: (2, False), None: (1, False), 4: (1, False)}
    back = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    assert back[1].loss_chars == 1 and back[2].loss_chars == 5 and back[3].turns_sha256 == hashlib.sha256(b"user\n\nuser\nagain\n").hexdigest()
    assert {k: (r.n_turns, r.valid) for k, r in back.items()} == status and back[1].state == "assistant" and back[4].state == "invalid"
    assert chat.read_back(formatted.limit(0)).count() == 0
    # Turns are found by their marks, however the formatted text is cut into rows.
    cut = formatted.select("conv_id", F.col("turn_no"), F.posexplode("segments")).select("conv_id", (F.col("turn_no") * 3 + F.col("pos")).alias("turn_no"), F.array("col").alias("segments"))
    assert sorted(map(tuple, chat.read_back(cut).collect()), key=str) == sorted(map(tuple, back.values()), key=str)


# 2 Quality rules


def base_rules(text):
    words = [w.decode() for w in (text or "").encode().split()]
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            covered.update(range(i, i + 5))
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), len(words) < 10 or 100 * len(covered) > 20 * len(words))


def test_quality_base_rules(spark, odd):
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    for df in (table(spark, DATA, "documents"), odd):
        want = Counter((r.doc_id, *base_rules(r.text)) for r in df.select("doc_id", "text").collect())
        got = quality.judge_quality(df, least=5)
        assert Counter(tuple(r) for r in got.select("doc_id", *columns).collect()) == want
        assert got.where("base_failed AND kept").count() == 0
        assert df is not odd or got.where("m_0 = 'mine' AND _y0 = 'mine' AND _own = 'mine' AND _group = 'mine'").count() == df.count()
    assert quality.judge_quality(odd.limit(0)).count() == 0


def numpy_estimate(data, exact=False):
    """Mean and covariance by the steps of the operator, from the better of two starts; with the operator's histogram steps, or the exact share."""
    floors = np.diag(np.square(quality.FLOORS))
    distance = lambda m, c: np.einsum("ij,jk,ik->i", data - m, np.linalg.inv(c), data - m)
    bins = np.floor(data * 64)
    middle = lambda x: np.sort(x, axis=0)[(len(x) + 1) // 2 - 1]
    med = middle(bins)
    spread = middle(np.abs(bins - med))
    starts = []
    for m, c in (((med + 0.5) / 64, np.diag(np.square(1.4826 * spread / 64)) + floors), (data.mean(axis=0), np.cov(data.T, bias=True) + floors)):
        for _ in range(quality.STEPS):
            d2 = distance(m, c)
            if exact:
                near = data[np.argsort(d2)[: int(0.75 * len(data))]]
            else:
                steps = np.floor(np.log2(d2 + 1e-9) * quality.BINS)
                near = data[steps <= np.sort(steps)[math.ceil(0.75 * len(data)) - 1]]
            m, c = near.mean(axis=0), np.cov(near.T, bias=True) * quality.factor_of(0.75) + floors
        starts.append((np.linalg.slogdet(c)[1], m, c))
    _, m, c = min(starts, key=lambda x: x[0])
    inside = data[distance(m, c) <= quality.bound_of(0.975)]
    return inside.mean(axis=0), np.cov(inside.T, bias=True) * quality.factor_of(0.975) + floors


def test_quality_judges_documents_as_numpy_does(spark):
    """The query's d2 and kept over all documents of the smallest table."""
    groups, vectors = defaultdict(list), {}
    for doc_id, text, lang, source in texts_of():
        n, chars, symbols, dup, repeats, failed = base_rules(text)
        lines = sum(bool(x.encode().split()) for x in (text or "").split("\n"))
        if not failed:
            vectors[doc_id] = np.array([math.log1p(n), math.log(chars / n), math.log1p(1000 * symbols / chars), math.log1p(100 * dup / max(lines, 1)), math.log1p(100 * repeats / n)])
            groups[lang, source].append(doc_id)
    pools, least = defaultdict(list), 20
    for (lang, source), ids in groups.items():
        pools[(lang, source) if len(ids) >= least else (lang, "*")] += ids
    last = defaultdict(list)
    for key, ids in pools.items():
        last[key if len(ids) >= least else ("*", "*")] += ids
    want = {}
    for ids in last.values():
        data = np.array([vectors[d] for d in ids])
        m, c = numpy_estimate(data) if len(ids) >= least else (None, None)
        for d in ids:
            want[d] = float((vectors[d] - m) @ np.linalg.inv(c) @ (vectors[d] - m)) if m is not None else None
    got = {r.doc_id: r for r in quality.judge_quality(table(spark, DATA, "documents"), least=least).collect()}
    assert sum(v is not None for v in want.values()) > 100
    for d, r in got.items():
        assert r.kept == (not r.base_failed and (want[d] is None or want[d] <= quality.CUTOFF))
        assert r.base_failed or r.d2 is want[d] is None or abs(r.d2 - want[d]) <= 1e-6 * max(1, want[d])


def test_quality_factors():
    assert abs(quality.bound_of(0.975) - 12.833) < 1e-3 and abs(quality.bound_of(0.9995) - 22.1) < 0.01
    assert abs(quality.factor_of(0.75) - 1.412) < 1e-3 and abs(quality.factor_of(0.975) - 1.055) < 1e-3


def test_quality_estimates_equal_numpy(spark):
    rng = np.random.default_rng(5)
    clean, bad = rng.normal(size=(900, 5)), rng.normal(6, 0.5, size=(100, 5))
    data = np.concatenate([clean, bad])
    rows = spark.createDataFrame(list(map(tuple, data.tolist())), ", ".join(f"{n} double" for n in quality.NAMES)).withColumn("_group", F.struct(F.lit("x").alias("_lang"), F.lit("y").alias("_source")))
    found = quality.robust_estimates(rows).first()
    mean = np.array([found[f"m_{i}"] for i in range(5)])
    # The same steps in numpy, from the better of the two starts.
    floors = np.diag(np.square(quality.FLOORS))
    distance = lambda m, c: np.einsum("ij,jk,ik->i", data - m, np.linalg.inv(c), data - m)
    starts = []
    med = np.median(data, axis=0)
    for m, c in ((med, np.diag(np.square(1.4826 * np.median(np.abs(data - med), axis=0))) + floors), (data.mean(axis=0), np.cov(data.T, bias=True) + floors)):
        for _ in range(quality.STEPS):
            near = data[np.argsort(distance(m, c))[: int(0.75 * len(data))]]
            m, c = near.mean(axis=0), np.cov(near.T, bias=True) * quality.factor_of(0.75) + floors
        starts.append((np.linalg.slogdet(c)[1], m, c))
    _, m, c = min(starts, key=lambda x: x[0])
    inside = data[distance(m, c) <= quality.bound_of(0.975)]
    assert np.allclose(mean, inside.mean(axis=0), atol=0.05)
    assert np.abs(mean).max() < 0.3  # the tenth that lies far off doesn't move it


def test_quality_rejects_repeated_lines_and_symbols(spark):
    rng = random.Random(6)
    say = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 8))) for _ in range(n))
    clean = [(d, "\n".join(say(12) for _ in range(rng.randrange(10, 20))), "en", "a") for d in range(300)]
    lines = "\n".join(f"{say(12)}\nagain" for _ in range(15))  # half of the lines are repeats, but no five words are
    symbols = "\n".join(f"{say(12)} ###" for _ in range(15))
    found = quality.judge_quality(spark.createDataFrame([*clean, (1000, lines, "en", "a"), (1001, symbols, "en", "a")], "doc_id long, text string, lang string, source string"))
    got = {r.doc_id: (r.kept, r.base_failed) for r in found.collect()}
    assert got[1000] == got[1001] == (False, False)
    assert sum(got[d][0] for d in range(300)) >= 297


# 3 MinHash


def brute_components(rows, size, percent=80):
    sets = {}
    for doc_id, text in rows:
        words = (text or "").translate(LOWER).encode().split()
        sets[doc_id] = frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1)) if len(words) >= size else frozenset([tuple(words)] if words else [])
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: (len(sets[d]), root(d), root(d) == d) for d in ids}


def near_copies(seed=3):
    """Chains and stars of near copies, copies, and texts of no and one word."""
    rng, rows = random.Random(seed), []
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    few = [word() for _ in range(4)]
    for _ in range(4):
        base = [word() for _ in range(120)]
        last = base
        for k in range(50):
            text = list(last if k % 2 else base)
            for _ in range(rng.randrange(1, 12)):
                at, how = rng.randrange(len(text) - 1), rng.randrange(4)
                if how == 0:
                    text[at] = word()
                elif how == 1:
                    text[at] = rng.choice(few)
                elif how == 2:
                    del text[at]
                else:
                    text[at], text[at + 1] = text[at + 1], text[at]
            last = text
            rows.append(" ".join(text))
            if k % 5 == 0:
                rows.append(" ".join(text).upper())
    rows += ["", "one", "One", "two words", "two  words", None]
    order = list(range(len(rows)))
    rng.shuffle(order)
    return [(d, rows[k]) for d, k in enumerate(order)]


@pytest.mark.parametrize("size", [2, 5])
def test_minhash_equals_brute_force(spark, size):
    rows = near_copies()
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found.collect()} == brute_components(rows, size)


def test_minhash_links_rows_of_one_id(spark):
    rng = random.Random(11)
    say = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(60))
    t, u, v = say(), say(), say()
    near = " ".join([*u.split()[:-1], "changed"])
    rows = [(1, t), (5, t), (5, u), (7, u), (8, near), (9, v), (9, v), (10, v), (10, say())]
    for size in (2, 5):
        found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size).collect()
        assert Counter((r.doc_id, r.component_id) for r in found) == Counter([(1, 1), (5, 1), (5, 1), (7, 1), (8, 1), (9, 9), (9, 9), (10, 9), (10, 9)])
    found = minhash.near_duplicates(spark.createDataFrame([(1, t), (2, u), (2, v), (3, v)], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in found} == {(1, 1), (2, 2), (3, 2)}


def met_pairs(spark, leader, members):
    """What _meeting finds in the star of a leader (node 0) and members (nodes 1, 2, ...), and the links that it has to find."""
    alike = lambda x, y: 100 * len(x & y) >= 80 * len(x | y)
    every = [leader, *members]
    star = spark.createDataFrame([(0, k) for k in range(1, len(every))], "a long, b long")
    labels = spark.createDataFrame([(0, 0), *((k, 0) for k, m in enumerate(every) if k and alike(leader, m))], "node long, component long")
    sets = spark.createDataFrame([(k, len(m), bytearray(substrings.to_bytes(np.array(sorted(m), np.uint64)))) for k, m in enumerate(every)], "node long, n long, members binary")
    found = {(r.a, r.b) for r in minhash._meeting(star, labels, sets, 80).collect()}
    linked = {k for k, m in enumerate(every) if alike(leader, m)}
    return found, {(i, j) for i in range(1, len(every)) for j in range(i + 1, len(every)) if not {i, j} <= linked and alike(every[i], every[j])}


def test_minhash_meets_pairs_with_prefixes_of_unlike_lengths(spark):
    # One lacks 20 of the leader's 100 shingles and is linked, one 22 and is open; they share 13 of these, most behind the shorter prefix.
    # Members that lack the first 8 shared ones too make the other shared ones rarer or more frequent.
    both, first, second = set(range(13)), set(range(13, 20)), set(range(20, 29))
    for often in (set(), set(range(8)), set(range(5, 13)), first | second):
        fill = [set(range(100)) - {e} - {99 - n} for n, e in enumerate(sorted(often))]
        found, wanted = met_pairs(spark, set(range(100)), [set(range(100)) - both - first, set(range(100)) - both - second, *fill])
        assert (1, 2) in wanted and wanted <= found


def test_minhash_meets_all_links_of_a_star(spark):
    rng = random.Random(8)
    for _ in range(3):
        leader, few = set(range(100)), [rng.sample(range(100), 24) for _ in range(4)]
        members = [leader - set(rng.sample(rng.choice(few), rng.randrange(12, 24))) - set(rng.sample(range(100), rng.randrange(4))) | set(rng.sample(range(200, 230), rng.randrange(6))) for _ in range(60)]
        found, wanted = met_pairs(spark, leader, members)
        assert wanted and wanted <= found


def test_minhash_odd_rows(spark, odd):
    found = minhash.near_duplicates(odd).collect()
    assert len(found) == odd.count()
    by = {r.doc_id: r for r in found}
    assert by[5].component_id == 4 and by[1].component_id == 1 and by[1].n_shingles == 0 and by[None].component_id is None and by[None].kept
    assert minhash.near_duplicates(odd.limit(0)).count() == 0


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 1 << 62, 1000).astype(np.uint64))
    b = np.concatenate([a[:800], np.unique(rng.integers(0, 1 << 62, 200).astype(np.uint64))])
    s = minhash.signatures([a, np.unique(b)], 512)
    assert abs((s[0] == s[1]).mean() - 800 / 1200) < 0.08


def test_components_of_long_chains(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "a long, b long")
    assert {(r.node, r.component) for r in minhash.components(links).collect()} == {(k, 0) for k in range(41)} | {(100, 100), (101, 100)}


# 4 WARC


def test_warc_records_and_ranges(spark):
    big = "<p>" + "x" * 200
    rows = [(3, "http://a/", big), (1, None, big), (2, "http://b/\r\nx", big), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (None, "n", big), (7, "é", "é" * 60)]
    out = shared_path(spark, "warc-test")
    index = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("x")), out)
    assert index.count() == len(rows)
    got = {r.page_id: r for r in warc.read_records(index).collect()}
    assert {k: r.record_type for k, r in got.items()} == {3: "revisit", 1: "response", 2: "revisit", 4: "response", 5: "response", 6: "response", None: "response", 7: "response"}
    assert got[3].refers_to == 1 and got[3].payload is None and bytes(got[7].payload).decode() == "é" * 60
    one = warc.read_records(index.where("page_id = 4")).collect()
    assert len(one) == 1 and bytes(one[0].payload) == b"short"
    assert warc.read_records(index.limit(0)).count() == 0
    assert warc.joined_ranges([(0, 10), (12, 5), (200, 5)], gap=4, most=100) == [(0, 17, [0, 1]), (200, 205, [2])]


def test_warc_query_of_repeated_page_ids(spark, tmp_path):
    a, b = "<p>" + "a" * 200, "<p>" + "b" * 300
    urls = ["http://a/x y\t%20é", "\u2028 ", None, "http://c"]
    rows = [(1, urls[0], a), (1, urls[1], b), (2, urls[2], b), (3, urls[3], a), (3, urls[3], a)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    got = sorted(map(tuple, warc.op4_warc(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted([(1, 203, digest(a), "response", None), (1, 303, digest(b), "response", None), (2, 303, digest(b), "revisit", 1), (3, 203, digest(a), "revisit", 1), (3, 203, digest(a), "revisit", 1)], key=str)
    index = warc.write_archives(table(spark, str(tmp_path), "pages"), shared_path(spark, "warc-test"))
    assert sorted(r.url for r in warc.read_records(index).collect()) == sorted([urls[0], urls[1], "", urls[3], urls[3]])


# 5 Substring dedup


def brute_removed(rows, window):
    """Words of each row that go."""
    first, words = {}, [(doc_id, (text or "").encode().split()) for doc_id, text in rows]
    key = lambda d: 1 << 63 if d is None else d
    for doc_id, w in words:
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, key(doc_id)), key(doc_id))
    out = []
    for doc_id, w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < key(doc_id):
                gone.update(range(i, i + window))
        out.append((doc_id, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return Counter(out)


@pytest.mark.parametrize("block_bytes", [256, 4096, 8 << 20])
def test_substrings_equal_brute_force(spark, block_bytes):
    rng, rows = random.Random(9), []
    passages = [" ".join(rng.choice("abcdef") * 2 + str(rng.randrange(50)) for _ in range(rng.randrange(5, 40))) for _ in range(12)]
    for d in range(80):
        parts = [" ".join(str(rng.randrange(10**6)) for _ in range(rng.randrange(0, 30))) + " " + (rng.choice(passages) if rng.random() < 0.7 else "") for _ in range(4)]
        rows.append((d if d % 17 else None, "\n".join(parts) if d % 11 else None))
    rows += rows[:5]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("extra", F.lit(1))
    found = substrings.remove_repeated(df, window=6, block_bytes=block_bytes, part_bytes=block_bytes)
    got = Counter((r.doc_id, r.n_words, r.n_removed, " ".join((r.text or "").split())) for r in found.collect())
    assert got == brute_removed(rows, 6)
    assert all(sum(x.end - x.start for x in r.removed) == r.n_removed for r in found.collect())


def test_substrings_odd_rows(spark, odd):
    found = substrings.remove_repeated(odd).collect()
    assert len(found) == odd.count() and found[0].kept == "mine"
    assert {r.n_removed for r in found if r.doc_id == 5} == {30000} and {r.n_removed for r in found if r.doc_id == 4} == {0}
    assert substrings.remove_repeated(odd.limit(0)).count() == 0


def test_packed_values_come_back():
    for values in (np.array([], np.uint64), np.array([0], np.uint64), np.array([5, 5, 2**64 - 1], np.uint64)):
        assert (substrings.from_bytes(substrings.to_bytes(values)) == values).all()


# 6 and 10 Packing and token files


@pytest.fixture(scope="session")
def plain_ids():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_the_tokenizer(spark, plain_ids):
    encode = tokens.Encoder(tokens.tokenizer_file(spark).value)
    rng = random.Random(2)
    pieces = ["a", "It's", "don't", " ", "  ", "\n", " \n", "\t", "\u00a0", "\u2003", "\x1c", "é", "中文", "123", "!!", "#", "_x", "<|endoftext|>", "🙂", "\x85", "I'll,"]
    pieces += ["\n\n", "'s", "'", "\r", "\u01c5", "я", "٣", "²", "\u0301", "\U0001fae8", "\u3000", "½", "\x0b", "ß", "x\u0378"]
    for text in ["", " ", "a", *("".join(rng.choice(pieces) for _ in range(rng.randrange(30))) for _ in range(1500)), *(t for _, t, _, _ in texts_of()[:40])]:
        assert np.frombuffer(encode(text), "<u4").tolist() == plain_ids(text), repr(text)


def test_encoder_cuts_long_texts(spark, plain_ids, monkeypatch):
    monkeypatch.setattr(tokens, "CUT", 40)
    monkeypatch.setattr(tokens, "MAX_RUNS", 60)
    encode = tokens.Encoder(tokens.tokenizer_file(spark).value)
    for _, text, _, _ in texts_of()[:60]:
        text = (text or "").replace(" e", "  e").replace(" o", "\n\no").replace(" a", " \u3000a")
        assert np.frombuffer(encode(text), "<u4").tolist() == plain_ids(text)


def test_queries_take_added_tokens_as_the_tokenizer_does(spark, tmp_path):
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    plain, encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), tokens.Encoder(tokens.tokenizer_file(spark).value, added_tokens=True)
    ids = lambda text: plain.encode(text, add_special_tokens=False).ids
    assert ids("a <|endoftext|> b") == [64, 220, 50256, 275]
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n y", "<|endoftext", "no such token"]
    for text in texts:
        assert np.frombuffer(encode(text), "<u4").tolist() == ids(text), repr(text)
    docs = spark.createDataFrame([(d, t, "en", "a", len(t)) for d, t in enumerate(texts)], DOCS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    crc = lambda text, end: zlib.crc32(np.array([*ids(text), end], "<u4").tobytes())
    assert {r.doc_id: r.doc_tokens for r in packing.op6_packing(spark, str(tmp_path)).collect()} == {d: len(ids(t)) + 1 for d, t in enumerate(texts)}
    assert {r.doc_id: r.doc_tokens for r in corpus_pipeline.packing(spark, docs, "").collect()} == {d: len(ids(t)) + 1 for d, t in enumerate(texts)}
    assert {r.doc_id: (r.n_tokens, r.ids_crc32) for r in token_files.op10_token_files(spark, str(tmp_path)).collect()} == {d: (len(ids(t)) + 1, crc(t, 2)) for d, t in enumerate(texts)}


def test_packing_cuts_every_document_once(spark, odd, plain_ids):
    for df in (table(spark, DATA, "documents"), odd):
        rows, pieces = df.select("doc_id", "text").collect(), packing.pack_powers_of_two(df).collect()
        assert len({p.sequence_id for p in pieces}) == len(pieces)
        assert all(p.length & (p.length - 1) == 0 and p.length <= 1024 and p.offset == 0 and p.length == 1 << p.bucket and len(p.ids) == 4 * p.length for p in pieces)
        got = defaultdict(list)
        for p in pieces:
            got[(p.doc_id, p.doc_tokens)].append((p.start, bytes(p.ids)))
        want = Counter((r.doc_id, np.array([*plain_ids(r.text), 0], "<u4").tobytes()) for r in rows)
        for (doc_id, n), parts in got.items():
            starts = sorted({s for s, _ in parts})
            whole = b"".join(next(b for s, b in parts if s == start) for start in starts)
            assert len(whole) == 4 * n and (doc_id, whole) in want
        assert sum(p.length for p in pieces) == sum(len(b) // 4 * c for (_, b), c in want.items())
    assert packing.pack_powers_of_two(odd.limit(0)).count() == 0
    batches = defaultdict(list)
    for p in packing.pack_powers_of_two(table(spark, DATA, "documents"), batch_tokens=2048).collect():
        batches[p.batch_id].append(p)
    # Each batch is a matrix: rows of one length, numbered, and no more than fit; all but one of a task and length are full.
    assert all(len({p.length for p in b}) == 1 and sorted(p.place for p in b) == list(range(len(b))) and len(b) * b[0].length <= 2048 for b in batches.values())
    open_ones = Counter((k >> 33, b[0].length) for k, b in batches.items() if len(b) * b[0].length < 2048)
    assert set(open_ones.values()) == {1} and len(batches) > len(open_ones)
    assert packing.cuts(2500, 1024) == [1024, 1024, 256, 128, 64, 4] and packing.cuts(1, 1024) == [1]


@pytest.mark.parametrize("bits", [1, 3, 7, 16, 17, 31, 32])
def test_bit_packing_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1001).astype("<u4")
    data = token_files.pack(ids, bits)
    assert len(data) == -(-1001 * bits // 8) and (token_files.unpack(data, bits, 1001) == ids).all()
    planes = [int(i) >> k & 1 for i in ids for k in range(bits)]
    assert data == np.packbits(planes, bitorder="little").tobytes()


def test_token_files_roll_and_spread_equal_rows(spark, plain_ids, monkeypatch, tmp_path):
    monkeypatch.setattr(token_files, "RANGE_BYTES", 400)
    monkeypatch.setattr(token_files, "FILE_DOCS", 7)
    monkeypatch.setattr(token_files, "FILE_IDS", 600)
    monkeypatch.setattr(token_files, "UNIT_DOCS", 3)
    texts = [None, "", "word " * 700] + [f"text {k} " * (k % 9) for k in range(60)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "the same")] * 90 + [(5, "tie b"), (5, "tie a")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(6).write.parquet(str(tmp_path / "docs"))
    df = spark.read.parquet(str(tmp_path / "docs"))
    manifest = token_files.write_token_files(df, shared_path(spark, "tokens-test")).orderBy("part", "seq").collect()
    assert max(r.n_docs for r in manifest) == 7 and len({r.part for r in manifest}) > 2
    files = spark.createDataFrame(manifest, "part long, seq long, file string, n_docs long, n_ids long")
    got = sorted(map(tuple, token_files.read_token_files(files).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((d for d, _ in rows), key=lambda d: -1 if d is None else d)
    assert [r[1] for r in got] == [sum(r[2] for r in got[:k]) for k in range(len(got))]
    want = sorted((-1 if d is None else d, len(plain_ids(t)) + 1) for d, t in rows)
    assert sorted((-1 if r[0] is None else r[0], r[2]) for r in got) == want
    nulls = {r.part for r in manifest for reader in [token_files.Reader(r.file)] if reader.documents(0, 1)[1][0]}
    assert len(nulls) > 1  # equal rows are in several ranges


def test_token_files(spark, odd, plain_ids, monkeypatch):
    monkeypatch.setattr(token_files, "READ_IDS", 5000)
    for df in (table(spark, DATA, "documents"), odd):
        out = shared_path(spark, "tokens-test")
        manifest = token_files.write_token_files(df, out)
        got = sorted(map(tuple, token_files.read_token_files(manifest).collect()), key=lambda r: r[1])
        start, want = 0, []
        for r in sorted(df.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, (r.text or "").encode())):
            ids = np.array([*plain_ids(r.text), 2], "<u4")
            want.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
            start += len(ids)
        assert got == want
    reader = token_files.Reader(manifest.orderBy("part", "seq").first().file)
    whole = reader.ids(0, reader.n_ids)
    assert (reader.ids(3, reader.n_ids - 1) == whole[3:-1]).all()
    assert token_files.read_token_files(token_files.write_token_files(odd.limit(0), shared_path(spark, "tokens-test"))).count() == 0


# 7 Decontamination


def test_decontamination_catches_reordered_passages(spark):
    rng = random.Random(4)
    say = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    item = say(40)
    docs = [
        (1, " ".join(say(50) + item + say(50))),
        (2, " ".join(say(9) + item[20:] + say(30) + item[:20] + say(5))),
        (3, " ".join(say(100) + item[:12])),
        (4, ", ".join(x.upper() for x in item)),
        (5, None),
        (None, " ".join(item)),
        (6, " ".join(item[:20] * 2)),
        (7, "Short one"),
    ]
    bench = [(1, " ".join(item)), (2, None), (3, ""), (4, "short one"), (None, " ".join(say(10)))]
    a, b = spark.createDataFrame(docs, "doc_id long, text string").withColumn("words", F.lit(1)), spark.createDataFrame(bench, "item_id long, text string")
    for most in (10**6, 0):
        found = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(a, b, coverage=0.6, most_seeds=most).collect()}
        assert set(found) == {(1, 1), (2, 1), (4, 1), (None, 1), (7, 4)}
        assert found[(2, 1)].n_tiles == 2 and found[(2, 1)].coverage == 1.0
    assert decontaminate.leaks(a.limit(0), b).count() == 0 and decontaminate.leaks(a, b.limit(0)).count() == 0


def brute_tiles(doc, item, seed):
    """Greedy string tiling from its definition: the longest match of free words is marked, again and again. Returns the marked words and tiles."""
    used_doc, used_item, marked, n_tiles = set(), set(), 0, 0
    while True:
        best = (0, 0, 0)
        for i in range(len(doc)):
            for j in range(len(item)):
                n = 0
                while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n] and i + n not in used_doc and j + n not in used_item:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < seed:
            return marked, n_tiles
        used_doc.update(range(i, i + n))
        used_item.update(range(j, j + n))
        marked, n_tiles = marked + n, n_tiles + 1


def brute_leaks(docs, items, seed=5, coverage=0.5):
    """(doc_id, item_id) to tiled words and tiles, over all documents and items that share any ``seed`` words (without them nothing is tiled)."""
    import regex

    split = lambda t: [w for w in regex.split(r"[^\p{L}\p{N}]+", (t or "").lower()) if w]
    grams = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    split_items = [(k, w, min(seed, len(w))) for k, t in items if (w := split(t))]
    found = {}
    for doc_id, text in docs:
        words = split(text)
        of_size = {n: grams(words, n) for n in {n for _, _, n in split_items}}
        for item_id, item, size in split_items:
            if of_size[size] & grams(item, size):
                n, tiles = brute_tiles(words, item, size)
                if n >= coverage * len(item):
                    found[doc_id, item_id] = (n, len(item), tiles)
    return found


def test_decontamination_equals_brute_force_over_documents(spark):
    """The whole smallest table (but for texts of over 3000 characters, which take brute force hours), broadcast seeds and join alike."""
    docs = table(spark, DATA, "documents").where("length(text) <= 3000")
    bench = table(spark, DATA, "benchmark")
    want = brute_leaks([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])
    assert want
    for most in (10**6, 0):
        got = {(r.doc_id, r.item_id): (r.tiled_words, r.item_words, r.n_tiles) for r in decontaminate.leaks(docs, bench, most_seeds=most).collect()}
        assert got == want
    whole = [{(r.doc_id, r.item_id): tuple(r) for r in decontaminate.leaks(table(spark, DATA, "documents"), bench, most_seeds=most).collect()} for most in (10**6, 0)]
    assert whole[0] == whole[1] and set(want) <= set(whole[0])


def test_decontamination_with_phrases_that_all_items_share(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "EXPANDED", 50)
    rng = random.Random(7)
    say = lambda n: [f"w{rng.randrange(300)}" for _ in range(n)]
    phrase = say(8)
    items = [(k, " ".join(phrase + say(12) + (phrase if k % 3 else say(8)))) for k in range(12)] + [(None, "w1 w2"), (20, "w3"), (20, " ".join(phrase))]
    docs = [(d, " ".join(say(20) + rng.choice(items)[1].split()[rng.randrange(4) :] + phrase * (d % 3) + say(20))) for d in range(40)] + [(None, None), (41, "")]
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    numbered = b.withColumn("item_id", F.coalesce("item_id", F.lit(-1)) * 1000 + F.length("text"))
    want = brute_leaks(docs, [(r.item_id, r.text) for r in numbered.collect()])
    for most in (10**6, 0):
        assert {(r.doc_id, r.item_id): (r.tiled_words, r.item_words, r.n_tiles) for r in decontaminate.leaks(a, numbered, most_seeds=most).collect()} == want
        assert decontaminate.leaks(a, b, most_seeds=most).count() == len(want)


def test_tiles_are_greedy():
    doc, item = np.array([1, 2, 3, 9, 4, 5, 6, 7, 9, 3, 4], np.uint64), np.array([1, 2, 3, 4, 5, 6, 7], np.uint64)
    at = decontaminate._meetings(substrings.rolling_hashes(doc, 2), np.arange(10), substrings.rolling_hashes(item, 2), 2)
    assert sorted(decontaminate.tiles(doc, item, at, 2)) == [(0, 0, 3), (4, 3, 4)]


# 8 Language


def test_language_held_out_accuracy(spark):
    lang = {d: x for d, _, x, _ in texts_of()}
    rows = [r for r in language.op8_language(spark, DATA).collect() if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in rows) >= 0.97 * len(rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)


def brute_language(texts, learned, size):
    """Language and score of each text by the definition of the out-of-place distance, in plain Python."""

    def profile(rows):
        counts = Counter()
        for text in rows:
            clean = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
            padded = "\1" + "\1".join(clean) + "\1" if clean else ""
            for n in (1, 2, 3):
                counts.update(g for g in (padded[i : i + n] for i in range(len(padded) - n + 1)) if g != "\1")
        code = lambda g: sum(ord(c) << 21 * k for k, c in enumerate(reversed(g)))
        return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], code(x[0])))[:size]]

    places = {lang: {g: k for k, g in enumerate(profile(rows))} for lang, rows in learned.items()}
    out = []
    for text in texts:
        own = profile([text])
        far = {lang: sum(abs(p[g] - k) if g in p else size for k, g in enumerate(own)) for lang, p in places.items()}
        best = min(sorted(far), key=far.get) if own else None
        out.append((best, 1 - far[best] / (size * len(own))) if own else ("und", 0.0))
    return out


def test_language_equals_brute_force(spark):
    rows = [(d, t, x) for d, t, x, _ in texts_of()]
    learned = defaultdict(list)
    for d, t, x in rows:
        if x is not None and t is not None and zlib.crc32(str(d).encode()) % 3 != 1:
            learned[x].append(t)
    want = brute_language([t for _, t, _ in rows], learned, language.PROFILE)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.op8_language(spark, DATA).collect()}
    for (d, _, _), (lang, score) in zip(rows, want, strict=True):
        assert got[d][0] == lang and abs(got[d][1] - score) < 1e-12


def test_language_odd_rows(spark, odd):
    profiles = language.learn_profiles(table(spark, DATA, "documents"))
    found = language.predict(odd, profiles)
    assert found.count() == odd.count()
    assert {r.doc_id for r in found.where("lang_pred = 'und'").collect()} == {1, 2, 6}
    assert language.learn_profiles(odd.limit(0)) == {} and language.predict(odd, {}).where("lang_pred <> 'und'").count() == 0
    keys, counts = language.ngrams("Aa b")
    grams = {tuple(x for x in (k >> 42, k >> 21 & 0x1FFFFF, k & 0x1FFFFF) if x): n for k, n in zip(keys.tolist(), counts.tolist(), strict=True)}
    assert grams[(97,)] == 2 and grams[(1, 97)] == 1 and grams[(97, 1)] == 1 and grams[(98, 1)] == 1 and grams[(1, 98, 1)] == 1


# 9 URL rules


def test_url_rules(spark):
    urls = [None, "no scheme", "http://EXAMPLE.com/en/x", "http://www.example.com/en/", "http://a.b.net/fr/1", "http://net", "http://com/", "http://xexample.com/en/", "a://b.com?x=/en/", "http://example.com/en", "http://é.com/\n/x?y"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("rule", F.lit("mine"))
    df = df.unionAll(df.where("page_id = 2"))
    rules = spark.createDataFrame(url_rules.RULES, "host string, path string, verdict string")
    got = {r.page_id: (r.host, r.rule, r.verdict) for r in url_rules.judge_urls(df, rules).collect()}
    assert got == {0: ("", None, "allow"), 1: ("", None, "allow"), 2: ("example.com", "example.com/en/", "block"), 3: ("www.example.com", "www.example.com/en/", "allow"), 4: ("a.b.net", "net/fr/", "block"), 5: ("net", None, "allow"), 6: ("com", "com/", "allow"), 7: ("xexample.com", "com/", "allow"), 8: ("b.com", None, "allow"), 9: ("example.com", "com/", "allow"), 10: ("é.com", "com/", "allow")}
    assert url_rules.judge_urls(df, rules).count() == len(urls) + 1
    assert url_rules.judge_urls(df, rules.limit(0)).where("verdict <> 'allow'").count() == 0
