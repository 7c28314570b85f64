"""Every registered query against DuckDB on the same tables."""

import pytest

from conftest import DATA, same_rows
from siftlake.plans import deep, engine, findings, ladder, policies, registry, scans, sketched, wider  # noqa: F401


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, duck, name):
    found = registry.QUERIES[name](spark, DATA)
    same_rows(found.collect(), found.columns, duck.sql(registry.SQL[name]))


def test_checksums_tell_valid_tokens(spark):
    assert all(r.made_valid == r.valid for r in registry.QUERIES["crc32_base62"](spark, DATA).collect())


def test_checksum_verdicts_are_those_that_were_made(spark):
    rows = registry.QUERIES["checksum_verdicts"](spark, DATA).collect()
    assert rows and all(r.checksum == "valid" and r.made_valid and r.confidence == 0.9 for r in rows)


def test_streams_and_scans_without_sql(spark, duck):
    final = {r.root: r.state for r in registry.QUERIES["guard_final_states"](spark, DATA).collect()}
    assert {r.root: r.state for r in registry.QUERIES["guard_machine"](spark, DATA).collect()} == final
    for r in registry.QUERIES["bootstrap_interval"](spark, DATA).collect():
        mean = duck.sql(f"SELECT avg(value) FROM events WHERE event_type = '{r.event_type}'").fetchall()[0][0]
        assert abs(r.mean - mean) < 1e-9 and r.low < mean < r.high
    assert {(r.line_no is not None, r.channel) for r in registry.QUERIES["scan_depth2"](spark, DATA).collect()} == {(True, "decoded")}
    found = registry.QUERIES["scan_full"](spark, DATA).collect()
    told = registry.QUERIES["scan_explain"](spark, DATA).where("stage = 'reported'").select("doc_id", "detector_id", "redacted").distinct().collect()
    assert {(r.doc_id, r.detector_id, r.redacted) for r in found} <= {tuple(r) for r in told}


def test_decoding_queries_read_the_texts(spark, tmp_path):
    import base64

    plain, token = "token=abcdefgh12345678ijkl9012", "ghp_abcdefghij0123456789ABCDEFGHIJ012345"
    inner = base64.b64encode(b"inner " + plain.encode().hex().encode()).decode()
    outer = base64.b64encode(f"x {token} y".encode()).decode()
    turned = token[:4].translate(str.maketrans("ghp", "jks"))
    blobs = {"decode_base64": base64.b64encode(plain.encode()).decode(), "decode_hex": plain.encode().hex(), "decode_url": plain.replace("=", "%3D"), "decode_reverse": token[::-1], "decode_depth2": inner, "decode_caesar": f"={turned}", "scan_decoded": outer}
    for name, blob in blobs.items():
        folder = tmp_path / name
        rows = [(6, f"some words\n{blob}\nand more", "en", "a", 9), (7, None, None, None, None)]
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(folder / "documents.parquet"))
        found = [r.doc_id for r in registry.QUERIES[name](spark, str(folder)).collect()]
        assert sorted(found) == [6, 6, 7], name


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
