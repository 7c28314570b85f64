"""Decoders against the standard library, detectors' own fields, the whole scan by cases, sources and reports as whole documents."""

import base64
import html
import io
import ipaddress
import json
import quopri
import random
import tarfile
import xml.dom.minidom

import pytest
from pyspark.sql import functions as F

from conftest import DATA
from siftlake import storage
from siftlake.functions import codecs
from siftlake.functions import text as T
from siftlake.operators import context, decode, documents, extract, resolve, score, shapes, windows
from siftlake.plans import engine
from siftlake.plans.detectors import BUILT_IN, Companion, Detector, Pattern, Relation, audit, capturing_groups, load, numbered
from siftlake.sources import files, packages, structured
from siftlake.sources.tables import findings, read
from siftlake.streaming import events

CHUNKS = "doc_id long, path string, text string, base_line long, base_offset long"


def chunk(spark, *texts, path="src/app.py"):
    return spark.createDataFrame([(k, path, t, 0, 0) for k, t in enumerate(texts)], CHUNKS)


def column(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r.x for r in rows.select("k", expression(F.col("v")).alias("x")).orderBy("k").collect()]


# Decoders.


def test_decoders_equal_the_standard_library(spark):
    rng = random.Random(3)
    plain = ["token=Abc123", "naïve café ☕", "a", "x" * 50, *("".join(rng.choice("abc déf=&<>\"'\\%☕") for _ in range(rng.randrange(1, 40))) for _ in range(40))]
    b32 = [base64.b32encode(p.encode()).decode() for p in plain]
    assert column(spark, b32, codecs.decode_base32) == plain
    assert column(spark, [x.rstrip("=").lower() for x in b32], codecs.decode_base32) == plain
    crock = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHJKMNPQRSTVWXYZ")
    assert column(spark, [x.rstrip("=").translate(crock) for x in b32], codecs.decode_crockford) == plain
    assert column(spark, ["A", "ABC", "0AB", "ABCDEF1", None], codecs.decode_base32) == [None] * 5
    assert column(spark, [html.escape(p) for p in plain], lambda c: decode.html_entities(F.replace(c, F.lit("&#x27;"), F.lit("&apos;")))) == plain
    assert column(spark, ["".join(f"&#{ord(c)};" for c in p) for p in plain], decode.numeric_entities) == plain
    assert column(spark, [json.dumps(p)[1:-1] for p in plain if "\\" not in p and '"' not in p], decode.unicode_escapes) == [p for p in plain if "\\" not in p and '"' not in p]
    assert column(spark, [r"😀 \x41\u{1F600}", r"\ud83d alone"], decode.unicode_escapes)[0] == "😀 A😀"
    assert column(spark, [json.dumps(p)[1:-1] for p in plain], codecs.decode_json_escapes) == plain
    ascii_only = [p for p in plain if p.isascii() and "%" not in p]
    assert column(spark, [quopri.encodestring(p.encode(), quotetabs=True).decode() for p in ascii_only], decode.quoted_printable) == ascii_only
    assert column(spark, ["".join(f"\\{b:03o}" for b in p.encode()) for p in ascii_only if p.isascii()], decode.octal_escapes) == ascii_only
    z85 = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ.-:+=^!/*?&<>()[]{}@%$#"

    def to_z85(data):
        out = ""
        for k in range(0, len(data), 4):
            n = int.from_bytes(data[k : k + 4], "big")
            out += "".join(z85[n // 85**i % 85] for i in (4, 3, 2, 1, 0))
        return out

    four = [p + " " * (-len(p.encode()) % 4) for p in plain]
    assert column(spark, [to_z85(p.encode()) for p in four], decode.z85) == four
    js = [f"atob('{base64.b64encode(p.encode()).decode()}')" for p in four if len(p) > 6] + [f"atob(\"{base64.b64encode(b'hello world').decode()[::-1]}\".split('').reverse().join(''))"]
    assert column(spark, js, decode.javascript_static) == [p for p in four if len(p) > 6] + ["hello world"]


def test_every_decoder_is_in_the_scan(spark):
    token = "ghp_" + "a1B2c3D4e5F6" * 3
    shown = f"x {token} y"
    octets = "".join(f"\\{b:03o}" for b in shown.encode())
    blobs = {
        "base64": base64.b64encode(shown.encode()).decode(),
        "hex": shown.encode().hex(),
        "url": "".join(f"%{b:02X}" for b in shown.encode()),
        "quoted-printable": "".join(f"={b:02X}" for b in shown.encode()),
        "html-named-entity": f"&lt;a&gt;{token[:4]}&lt;{token[4:]}",
        "html-numeric-entity": "".join(f"&#{b};" for b in shown.encode()),
        "octal-escape": octets,
        "mime-encoded-word": f"=?utf-8?b?{base64.b64encode(shown.encode()).decode()}?=",
        "json": '"a ' + "\\u0067\\u0068\\u0070_" + token[4:] + ' "',
        "unicode-escape": "".join(f"\\x{b:02x}" for b in shown.encode()),
        "javascript-static": f"atob('{base64.b64encode(shown.encode()).decode()[::-1]}'.split('').reverse().join(''))",
        "reverse": token[::-1],
        "caesar": token.translate(str.maketrans("abcdefghijklmnopqrstuvwxyz", "defghijklmnopqrstuvwxyzabc")).translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "DEFGHIJKLMNOPQRSTUVWXYZABC")),
    }
    names = list(blobs)
    rows = chunk(spark, *(f"first\nsecond\nv {blobs[n]} end\nlast" for n in names))
    found = engine.candidates(rows, BUILT_IN[1:2], "default").where("channel = 'decoded'").select("doc_id", "value", "line_no").distinct().collect()
    got = {names[r.doc_id]: (r.value, r.line_no) for r in found}
    for n in names:
        if n != "html-named-entity":  # an escaped mark splits this token
            assert got[n] == (token, 3), n


def test_decoding_reports_and_bounds(spark):
    rows = chunk(spark, "a" * 50, "b" * 5)
    taken, gaps = decode.within_decode_limit(rows, 10)
    assert [r.doc_id for r in taken.collect()] == [1] and [(r.doc_id, r.n_chars) for r in gaps.collect()] == [(0, 50)]
    made = spark.createDataFrame([(1, 1, "hex", "aa"), (1, 1, "hex", "bbb"), (1, 2, "hex", "c")], "doc_id long, depth int, via string, text string")
    kept, cut = decode.admitted(made, 2, 4)
    assert [r.text for r in kept.collect()] == ["aa"] and [tuple(r) for r in cut.collect()] == [(1, 2)]
    assert column(spark, ["ab\0cdefghijk", "abcdefgh1", "a b c"], decode.screened) == [False, True, False]


def test_very_long_lines_and_values(spark):
    """Patterns with repeated groups don't take a stack of the text's length."""
    long = [" ".join(f"w{k}" for k in range(30000)), '"' + "a\\n" * 30000 + '"', "%41" * 30000, "a_b" * 30000, "key = \"" + "\\\\x" * 30000 + '"', ".".join(["a"] * 30000), "\\u0041" * 20000]
    rows = chunk(spark, *long)
    assert {r.via for r in decode.decode_through(rows, 1, ("json", "url", "unicode-escape", "base64", "hex")).collect()} >= {"json", "url", "unicode-escape"}
    lines = extract.lines(rows)
    assert context.line_roles(lines).where("role = 'prose'").count() >= 1
    assert lines.select(shapes.shape(F.col("line")).alias("s")).where("s IS NOT NULL").count() == 0
    assert structured.hcl_pairs(lines).count() == 1
    assert windows.continuations(rows, "doc_id").count() == 0
    assert engine.candidates(rows, BUILT_IN, "fast").count() >= 0


def test_codes_and_addresses(spark):
    assert column(spark, ["", "a", "foobar", "é"], codecs.fnv1a_32) == [0x811C9DC5, 0xE40C292C, 0xBF9CF968, fnv("é".encode())]
    hosts = ["::1", "::", "fe80::1", "fd12:3456::", "2001:db8::8", "2606:4700::1111", "ff02::1", "::ffff:10:1", "1:2:3:4:5:6:7:8", "1:2:3", "1::2::3", ":::", "1:2:3:4:5:6:7:8:9", "g::1", "12345::"]
    packed = lambda h: ipaddress.ip_address(h).packed.hex()
    full = [":".join(packed(h)[k : k + 4] for k in range(0, 32, 4)) if valid(h) else None for h in hosts]
    assert column(spark, hosts, codecs.full_ipv6) == full
    assert column(spark, ["::1", "fd12::1", "2606:4700::1111"], codecs.is_bogon_6) == [True, True, False]
    urls = ["http://localhost/x", "https://a.example.com/", "http://10.0.0.1:80/", "http://[fe80::1]/", "http://db/", "http://u:p@192.168.1.1/", "mailto:x", "https://8.8.8.8"]
    assert column(spark, urls, codecs.is_private_url) == [True, False, True, True, True, True, None, False]
    assert column(spark, ["\\\\?\\c:\\a\\b", "\\\\?\\UNC\\srv\\x", "d:/x", "/a/b"], codecs.plain_path) == ["C:/a/b", "//srv/x", "D:/x", "/a/b"]
    oid = "a" * 64
    pointer = f"version https://git-lfs.github.com/spec/v1\noid sha256:{oid}\nsize 12\n"
    assert [x and tuple(x) for x in column(spark, [pointer, "no", pointer + "x"], codecs.git_lfs_pointer)] == [(oid, 12), None, None]
    part = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
    jwt = [f"{part({'alg': 'none', 'typ': 'JWT'})}.{part({'sub': 'abc', 'exp': 5})}.x", f"{part({'alg': 'RS256'})}.{part({'a': 'é'})}.x", "a.b.c", f"{part({'typ': 'x'})}.{part({'a': 1})}.x"]
    assert [x and (x.algorithm, x.expired, x.claims) for x in column(spark, jwt, lambda c: codecs.jwt_findings(c, F.lit(10)))] == [("none", True, "exp:1,sub:3"), ("known", None, "a:1"), None, None]


def fnv(data):
    h = 0x811C9DC5
    for b in data:
        h = (h ^ b) * 0x01000193 % (1 << 32)
    return h


def valid(host):
    try:
        return isinstance(ipaddress.ip_address(host), ipaddress.IPv6Address)
    except ValueError:
        return False


# Detectors and the scan.


def test_detector_fields_are_read(tmp_path):
    (tmp_path / "a.toml").write_text(r"""
[detector]
id = "a"
name = "A"
service = "s"
severity = "high"
keywords = ["AB_"]
min_confidence = 0.6
stopwords = ["Sample"]
allowlist_values = ["AB_0"]
validators = [{ type = "crc32-base62" }]
credential_shape = { exact_length = 7 }
[[detector.patterns]]
regex = 'AB_[0-9]+'
client_safe = true
[[detector.companions]]
name = "secret"
regex = 'secret["]? ?[:=] ?["]?([a-z(]{4,})'
within_lines = 3
requirement = "forbidden"
[[detector.detector_relations]]
kind = "requires"
detector = "b"
within_lines = 4
within_bytes = 100
direction = "after"
""")
    d = load(str(tmp_path))[0]
    assert (d.min_confidence, d.stopwords, d.allowed, d.validators, d.exact_length) == (0.6, ("sample",), ("AB_0",), ("crc32-base62",), 7)
    assert d.companions[0].group == 1 and d.companions[0].forbidden and d.patterns[0].client_safe
    assert d.relations == (Relation("requires", "b", 4, 100, "after"),)
    assert [capturing_groups(x) for x in ("a", "(a)", "(?:a)(b)", r"\((a)[(]", "(?P<x>a)(?<y>b)", "(?<=a)b", "[]()](a)")] == [0, 1, 1, 1, 2, 0, 1]
    assert audit((d,)) == [] and ("x", "a pattern can match the empty text") in audit((Detector("x", "X", "s", "low", ("xyz",), (Pattern("a*"),)),))


def test_anchors_find_what_the_plain_scan_finds(spark):
    """Windows of one text, null and repeated ids, keywords that overlap, and a large catalogue."""
    values = [f"k{k:03d}_" + f"{k:024x}" for k in range(0, 40, 3)]
    text = "\n".join(f"line {v} end" for v in values)
    rows = windows.windowed(chunk(spark, text, "GHP_ none", f"ghp_{'a' * 36} and ghp_{'b' * 36}"), 400, 60)
    rows = rows.unionByName(rows.withColumn("doc_id", F.lit(None).cast("long"))).unionByName(rows)
    catalogue = (*BUILT_IN, *numbered(40))
    plain, fast = (sorted(map(tuple, extract.scan(rows, catalogue, anchors=a).collect()), key=str) for a in (False, True))
    assert plain == fast and len(plain) > 3 * len(values)


def test_cases_of_the_whole_scan(spark):
    """Contracts of a synthetic detector with all its fields: what is reported, and what drops the rest."""
    key = Detector(
        "acme-key", "Acme Key", "acme", "high", ("acme_",), (Pattern(r"acme_[0-9A-Za-z]{20}\b"),), prefix="acme_", exact_length=25, stopwords=("fixture",), allowed=("re:^acme_A{5}",),
        companions=(Companion("id", r"acme_id *= *([a-z0-9]{6})", 1, 2, required=True), Companion("off", "acme (disabled)", 1, 1, forbidden=True)),
        relations=(Relation("conflicts", "acme-test", 1),),
    )
    other = Detector("acme-test", "Acme Test", "acme", "low", ("acmetest",), (Pattern("acmetest[0-9]{6}"),))
    good = "acme_9aZ8bY7cX6dW5eV4fU3g"
    texts = [
        f"acme_id = abc123\nkey = {good}",  # 0 reported
        f"key = {good}",  # 1 no required companion
        f"acme_id = abc123\n\n\n\nkey = {good}",  # 2 companion too far
        f"acme_id = abc123\nkey = {good} # acme disabled",  # 3 forbidden companion
        f"acme_id = abc123\nkey = {good}\nacmetest123456",  # 4 conflict
        "acme_id = abc123\nkey = acme_fixture5eV4fU3gT2hS1",  # 5 stopword
        "acme_id = abc123\nkey = acme_AAAAA5eV4fU3gT2hS1iR",  # 6 allowed value
        f"acme_id = abc123\n# key = {good}",  # 7 comment
        f"acme_id = abc123\nexample_key = acme_example0000000000000",  # 8 placeholder
        f"acme_id = abc123\nblob = {base64.b64encode(f'k {good} z'.encode()).decode()}",  # 9 decoded
        'acme_id = abc123\nkey = "acme_9aZ8bY7c" +\n  "X6dW5eV4fU3g"',  # 10 over two lines
    ]
    found = engine.full_scan(chunk(spark, *texts), (key, other), "default").where("detector_id = 'acme-key'").collect()
    assert {r.doc_id: (r.channel, r.line_no, r.companions["id"], r.tier) for r in found if r.doc_id not in (9, 10)} == {0: ("pattern", 2, "****", "confirmed")}
    # Companions of decoded and joined values are looked for in their own surroundings.
    assert {r.doc_id: r.channel for r in found if r.doc_id == 9} == {9: "decoded"}
    told = {(r.doc_id, r.stage) for r in engine.explain(chunk(spark, *texts), (key, other), "fast").where("detector_id = 'acme-key'").collect()}
    assert {(0, "reported"), (5, "detector_list"), (6, "detector_list"), (8, "placeholder")} <= told
    assert not {d for d, _ in told} & {1, 2, 3, 4} and {s for d, s in told if d == 7} & {"hard_suppressed_context", "below_min_confidence"}


def test_relations_know_side_and_distance(spark):
    rows = spark.createDataFrame([(1, "a", 1, 0), (1, "b", 2, 50), (2, "a", 5, 90), (2, "b", 4, 10), (3, "a", 1, 0)], "doc_id long, detector_id string, line_no long, byte_offset long")
    a, b = rows.where("detector_id = 'a'"), rows.where("detector_id = 'b'")
    ids = lambda df: sorted(r.doc_id for r in df.collect())
    assert ids(extract.related(a, b, 1, "requires")) == [1, 2]
    assert ids(extract.related(a, b, 1, "requires", direction="after")) == [1]
    assert ids(extract.related(a, b, 1, "requires", within_bytes=60)) == [1]
    assert ids(extract.related(a, b, 1, "conflicts", direction="before")) == [1, 3]


def test_places_of_matches(spark):
    texts = ["x = KEY1", "# KEY1", "```\nKEY1", 'a\n"""\nKEY1\n"""', "-----BEGIN PGP MESSAGE-----\nKEY1", "say 'KEY1'", "KEY1", '"""\n"""\nKEY1']
    wanted = (Detector("k", "K", "s", "low", ("key1",), (Pattern("KEY1"),)),)
    got = {r.doc_id: r.context for r in extract.scan(chunk(spark, *texts), wanted, context=True).collect()}
    assert got == dict(enumerate(["assignment", "comment", "documentation", "documentation", "encrypted", "string", "unknown", "unknown"]))
    path = chunk(spark, "x = KEY1", path="src/tests/a.py").unionByName(chunk(spark, "x = KEY1", path="docs/a.txt"))
    assert sorted(r.context for r in extract.scan(path, wanted, context=True).collect()) == ["documentation", "test"]


def test_shapes_prose_and_lists(spark):
    cases = {"a::b::c": "scope_resolution", "someValueName": "camel_case_no_digit", "foo(bar)": "code_expression", "1.2.3-rc1": "version_literal", "CVE-2024-12345": "advisory_id", "arn:aws:iam::1:role/x": "resource_name", "0x" + "a" * 40: "blockchain_address", "x7Gh2Kq9LmZ4": None, "00:11:22:33:44:55": "mac_address", "text/html": "mime_type"}
    assert column(spark, list(cases), shapes.shape) == list(cases.values())
    assert column(spark, ["this is the end of it all", "a1b2 c3d4 e5f6 g7h8 i9j0", "ae0b1a2e3a4e5a6"], shapes.is_prose) == [True, False, False]
    assert column(spark, ["my-pass-1", "bypass", "userPass", "compass"], lambda c: context.bounded_words(c, ("pass", "auth"))) == [True, False, True, False]
    assert column(spark, [base64.b64encode(b"please call me back soon").decode(), base64.b64encode(b"tok 12345 x y").decode(), "short"], context.decoded_benign) == [True, False, False]
    assert column(spark, ["elpmaxe-yek", "real"], context.mirrored_placeholder) == [True, False]
    assert column(spark, ["f" * 40, "g" * 40], lambda c: shapes.hex_decoy(c, F.lit("commit_id"))) == [True, False]
    assert [k for k, _ in score.EVIDENCE] == list(dict(score.EVIDENCE)) and len(score.EVIDENCE) == 19


# Sources.


def test_tokens_of_values(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from siftlake.functions.tokens import token_counter, word_like

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    values = ["information", "x7Gh2Kq9LmZ4vB1n", "", "administrator_password", "é", None]
    n = column(spark, values, token_counter(spark))
    assert n == [len(tokenizer.encode(v or "", add_special_tokens=False).ids) for v in values]
    assert column(spark, values[:2], lambda c: word_like(c, token_counter(spark)(c))) == [True, False]


def test_sources_by_name(spark, tmp_path):
    with pytest.raises(ValueError, match="retired"):
        packages.source("fs")
    with pytest.raises(ValueError, match="no source"):
        packages.source("nowhere")
    (tmp_path / "a.txt").write_text("hello")
    assert [r.text for r in packages.source("filesystem")(spark, str(tmp_path)).collect()] == ["hello"]
    kept, gaps = packages.from_text(spark, "x" * 20, most=10)
    assert kept.count() == 0 and [r.reason for r in gaps.collect()] == ["too_large"]
    assert packages.from_text(spark, "abc")[0].first().text == "abc"


def tar(files):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        for name, data in files.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def test_container_images(spark):
    import hashlib

    layer = tar({"a/b.txt": b"one", "a/.wh.gone": b""})
    digest = lambda x: hashlib.sha256(x).hexdigest()
    config = b"{}"
    manifest = json.dumps({"config": {"digest": f"sha256:{digest(config)}"}, "layers": [{"digest": f"sha256:{digest(layer)}"}, {"digest": f"sha256:{'0' * 64}"}]}).encode()
    oci = tar({"index.json": json.dumps({"manifests": [{"digest": f"sha256:{digest(manifest)}"}]}).encode(), f"blobs/sha256/{digest(manifest)}": manifest, f"blobs/sha256/{digest(config)}": config, f"blobs/sha256/{digest(layer)}": layer, f"blobs/sha256/{'0' * 64}": layer})
    rows = spark.createDataFrame([(1, bytearray(oci)), (2, bytearray(b"no tar")), (3, None), (4, bytearray(tar({"x": b"y"})))], "doc_id long, content binary")
    got = sorted((r.doc_id, r.path or "", r.state) for r in packages.image_members(rows).collect() if r.layer != "config")
    assert got == [(1, "", "bad_digest"), (1, "a/b.txt", "read"), (1, "a/gone", "whiteout"), (2, "", "invalid"), (3, "", "invalid"), (4, "", "invalid")]
    small = packages.image_members(rows.where("doc_id = 1"), most=2).where("path = 'a/b.txt'").first()
    assert bytes(small.content) == b"on" and small.state == "truncated"


def test_archives_in_archives(spark):
    import bz2
    import gzip
    import zipfile

    import zstandard

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "one")
        z.writestr("in.tar", tar({"b.txt": b"two", "c.gz": gzip.compress(b"three")}))
    rows = [("x/y.zip", out.getvalue()), ("z.txt.zst", zstandard.ZstdCompressor().compress(b"four")), ("w.bz2", bz2.compress(b"five")), ("plain", b"text"), ("bad.gz", b"\x1f\x8b\x08broken"), ("none", None)]
    found = files.archive_members(spark.createDataFrame([(p, None if c is None else bytearray(c)) for p, c in rows], "path string, content binary"))
    got = sorted(((r.path, r.member, bytes(r.content) if r.content is not None else None, r.state) for r in found.collect()), key=str)
    want = [("bad.gz", None, None, "invalid"), ("none", None, None, "not_an_archive"), ("plain", None, None, "not_an_archive"), ("w.bz2", "w", b"five", "read"), ("x/y.zip", "a.txt", b"one", "read"), ("x/y.zip", "in.tar!b.txt", b"two", "read"), ("x/y.zip", "in.tar!c.gz", b"three", "read"), ("z.txt.zst", "z.txt", b"four", "read")]
    assert got == sorted(want, key=str)
    small = files.archive_members(spark.createDataFrame([("w.bz2", bytearray(bz2.compress(b"five")))], "path string, content binary"), most=2).first()
    assert bytes(small.content) == b"fi" and small.state == "truncated"


def test_ignore_files(spark):
    rules = files.ignore_rules(spark.createDataFrame([(".gitignore", "*.log\n# no\n/build/\ndocs/**/x.md\n\n"), ("a/.gitignore", "!keep.log\ntmp?")], "path string, text string"))
    paths = ["m.py", "e.log", "a/e.log", "a/keep.log", "keep.log", "build/o", "a/build/o", "docs/x.md", "docs/p/q/x.md", "docs/y.md", "a/tmp1/z", "tmp1", "a/b/tmp2"]
    kept = {r.path for r in files.not_ignored(spark.createDataFrame([(p,) for p in paths], "path string"), rules).collect()}
    assert kept == {"m.py", "a/keep.log", "a/build/o", "docs/y.md", "tmp1"}


def test_pages_and_continuations(spark):
    page = "<html><style>x{}</style><script>var a=1</script><!-- no --><p>Tom &amp; Jerry&#33;</p>\n<b>end</b>"
    assert column(spark, [page], structured.page_text) == ["Tom & Jerry! end"]
    long = "k = '" + "ab' +\n  '" * 90 + "'"
    texts = ["a = 'x' +\n  'y' +\n  'z'\nb = 1", "k=ab\\\ncd", "f(a +\nb)", '{"a": ["b",\n "c"]}', long, "\n".join(["x"] * 3000 + [long]), None, ""]
    for size in (1 << 15, 700):
        found = windows.continuations(chunk(spark, *texts), "doc_id", size=size)
        assert sorted((r.doc_id, r.line_no, r.n_lines, r.line) for r in found.collect()) == [(0, 1, 3, "a = 'xyz'"), (1, 1, 2, "k=abcd"), (4, 1, 91, f"k = '{'ab' * 90}'"), (5, 3001, 91, f"k = '{'ab' * 90}'")]
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_fragments_meet_however_many_there_are(spark):
    rows = spark.createDataFrame([("p", "k", n * 7, f"v{n}") for n in range(60)], "path string, prefix string, line long, value string")
    pairs = {(r.line, r.line_b) for r in windows.joined_fragments(rows).collect()}
    assert pairs == {(a * 7, b * 7) for a in range(60) for b in range(60) if a != b and abs(a - b) * 7 < 100}
    assert windows.joined_fragments(rows, most=8).count() == 56


# Reports and state.


def test_report_documents_are_whole(spark):
    rows = findings(read(spark, DATA, "documents")).where("doc_id < 17")
    text = lambda df: "\n".join(r.line for r in df.orderBy("part", "place").collect())
    n = rows.count()
    array = json.loads(text(documents.json_array(rows)))
    assert len(array) == n and [(x["path"], x["line"]) for x in array] == sorted((x["path"], x["line"]) for x in array)
    head, *lines = text(documents.json_lines(rows)).split("\n")
    assert json.loads(head)["n"] == n == len(lines) and all(map(json.loads, lines))
    run = json.loads(text(documents.sarif(rows)))["runs"][0]
    assert len(run["results"]) == n and {r["ruleId"] for r in run["results"]} == {r["id"] for r in run["tool"]["driver"]["rules"]} and run["results"][0]["fixes"]
    assert len(json.loads(text(documents.gitlab(rows)))["vulnerabilities"]) == n
    assert len(xml.dom.minidom.parseString(text(documents.junit(rows))).getElementsByTagName("testcase")) == n
    page = text(documents.html(rows.withColumn("path", F.lit("<script>"))))
    assert page.count("<tr>") == n and "<script>" not in page
    table = text(documents.csv(rows)).split("\n")
    assert table[0] == "# status: success" and table[1] == f"# findings: {n}" and len(table) == n + 3
    assert text(documents.boxes(rows)).count("┌") == n
    empty = rows.limit(0)
    assert json.loads(text(documents.json_array(empty))) == [] and json.loads(text(documents.sarif(empty)))["runs"][0]["results"] == []
    assert [(r.path, r.line) for r in documents.in_order(rows).collect()] == [(x["path"], x["line"]) for x in array]


def test_locations_targets_and_windows(spark):
    rows = [(1, 0, "d", "h", "p", 5, 50), (1, 1, "d", "h", "p", 5, 40), (1, 2, "d", "h", "p", 9, 90), (2, 0, "d", "h", "q", 1, 10), (2, 1, "d", "h", "q", 60, 600)]
    found = spark.createDataFrame([(*r, 0.5, "s", 1) for r in rows], "doc_id long, k int, detector_id string, credential_hash string, path string, line long, offset long, confidence double, service string, severity_rank int")
    one = resolve.dedup(found, "credential", locations=True).first()
    assert (one.path, one.line, [tuple(x) for x in one.additional], one.n_additional) == ("q", 1, [("p", 5), ("p", 9), ("q", 60)], 3)
    assert [[tuple(x) for x in r.additional] for r in resolve.dedup(found, "file", locations=True).orderBy("path").collect()] == [[("p", 9)], [("q", 60)]]
    assert sorted((r.path, r.line) for r in resolve.near_once(found, 50).collect()) == [("p", 5), ("q", 1), ("q", 60)]
    targets = spark.createDataFrame([(1, "10.0.0.2", 7), (1, "10.0.0.1", 9), (2, "b", 40), (2, "a", 40), (3, "c", 1)], "doc_id long, target string, line long")
    got = {(r.doc_id, r.k): (r.target, r.relation, r.distance) for r in resolve.nearest_targets(found, targets).collect()}
    assert got == {(1, 0): ("10.0.0.2", "same_file", 2), (1, 1): ("10.0.0.2", "same_file", 2), (1, 2): ("10.0.0.1", "same_line", 0), (2, 0): ("a", "same_file", 39), (2, 1): ("a", "same_file", 20)}
    inner = spark.createDataFrame([(2, 0, "z")], "doc_id long, k int, target string")
    assert {r.relation for r in resolve.nearest_targets(found, targets, inner).where("doc_id = 2 AND k = 0").collect()} == {"decoded"}


def test_shared_folder_is_cleared(spark):
    import os

    held = storage.stored(spark.range(3), "cleared")
    path = held.inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path) and storage.clear(spark) > 0 and not os.path.exists(path)


def test_states_of_roots(spark):
    rows = [(1, "barrier", 1), (1, "modify", 2), (2, "overflow", 1), (2, "modify", 2), (2, "reconcile", 3), (3, "barrier", 1), (3, "policy", 2), (4, "stop", 1), (4, "barrier", 2)]
    got = {r.root: r.state for r in events.final_states(spark.createDataFrame(rows, "root long, kind string, seq long")).collect()}
    assert got == {1: "dirty", 2: "indexing", 3: "stale-policy", 4: "stopped"}
    assert set(events.STATES) == {"indexing", "current", "dirty", "degraded", "blocked", "stale-policy", "stopped"}


def test_byte_entropy_of_all_bytes(spark):
    import math
    from collections import Counter

    values = ["aabb", "é", "", "zzzz", "a1B2c3D4"]
    want = [-sum(n / len(v.encode()) * math.log2(n / len(v.encode())) for n in Counter(v.encode()).values()) if v else 0.0 for v in values]
    assert column(spark, values, T.byte_entropy) == pytest.approx(want)

