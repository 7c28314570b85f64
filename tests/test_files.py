"""Encodings, binaries and ignore files of a folder."""

import gzip
import random

from siftlake.sources import files


def test_what_is_text(spark, tmp_path):
    rng = random.Random(1)
    cases = {
        "utf8.txt": "key = é".encode(),
        "marked8.txt": b"\xef\xbb\xbfkey",
        "wide.txt": "key = ö\nline".encode("utf-16"),
        "wide_le.txt": "password = secret".encode("utf-16-le"),
        "wide_be.txt": "password = secret".encode("utf-16-be"),
        "odd_wide.txt": "key = 1".encode("utf-16") + b"\x41",
        "latin.txt": "clé = été".encode("latin-1"),
        "zero.txt": b"a line with \0 a zero byte and more words",
        "noise.bin": bytes(rng.randrange(256) for _ in range(4000)),
        "packed.dat": gzip.compress(b"text " * 500),
        "code.o": b"\x7fELF" + bytes(60),
    }
    for name, data in cases.items():
        (tmp_path / name).write_bytes(data)
    chunks, gaps = files.read_files(spark, str(tmp_path))
    texts = {r.path.rsplit("/", 1)[1]: r.text for r in chunks.collect()}
    assert texts == {
        "utf8.txt": "key = é", "marked8.txt": "key", "wide.txt": "key = ö\nline", "wide_le.txt": "password = secret", "wide_be.txt": "password = secret", "odd_wide.txt": "key = 1�",
        "latin.txt": "cl� = �t�", "zero.txt": "a line with \0 a zero byte and more words",
    }
    assert {r.path.rsplit("/", 1)[1]: r.reason for r in gaps.collect()} == dict.fromkeys(("noise.bin", "packed.dat", "code.o"), "binary")


def test_ignore_files_of_folders(spark, tmp_path):
    for name, text in {".gitignore": "*.log\n/out/\n", "a.txt": "a", "b.log": "b", "out/c.txt": "c", "in/out/d.txt": "d", "in/.ignore": "!keep.log\nsecret.*\n", "in/keep.log": "k", "in/.env": "e", ".git/config": "g", "in/secret.txt": "s", "secret.txt": "t"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    chunks, gaps = files.read_files(spark, str(tmp_path))
    assert sorted(r.text for r in chunks.collect()) == ["a", "d", "e", "k", "t"]
    assert sorted((r.path.rsplit("/", 1)[1], r.reason) for r in gaps.collect()) == [("b.log", "ignored"), ("c.txt", "ignored"), ("secret.txt", "ignored")]
    assert files.read_files(spark, str(tmp_path), ignore=False)[0].count() == 10
