"""Queries: admission, attribution and confidence policies, further decoders, and triage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.functions import codecs as C
from siftlake.functions import text as T
from siftlake.operators import admission, decode, extract, score
from siftlake.sources.tables import FINDINGS, SEEDED, findings, read, seeded_chunks

from .detectors import BUILT_IN
from .registry import query
from .scans import DIVERSITY, ENTROPY, LINES, SCAN, SEEDED_ASSIGNED, TOKENS, quoted


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "documents")


def _seeded(spark: SparkSession, folder: str) -> DataFrame:
    return seeded_chunks(_docs(spark, folder))


PREFIXES = [("p1", "sk_"), ("p2", "sk_live_"), ("p3", "ghp_"), ("p4", "AK"), ("p5", "AKIA")]


@query(f"""WITH {SEEDED}, p (pattern, prefix) AS (VALUES {', '.join(f"('{a}', '{b}')" for a, b in PREFIXES)}), hit AS (SELECT doc_id, pattern, prefix FROM seeded, p WHERE contains(text, prefix))
SELECT DISTINCT h.doc_id, o.pattern FROM hit h JOIN p o ON starts_with(o.prefix, h.prefix) OR starts_with(h.prefix, o.prefix)""")
def prefix_propagation(spark: SparkSession, folder: str) -> DataFrame:
    return admission.propagated(_seeded(spark, folder), PREFIXES)


@query(f"""{SCAN} SELECT doc_id, count(*)::BIGINT AS n FROM matches GROUP BY 1""")
def scan_distinct_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Each different text is scanned once; its copies get the matches."""
    found = admission.scan_distinct(_seeded(spark, folder), lambda rows: extract.scan(rows, BUILT_IN))
    return found.groupBy("doc_id").agg(F.count("*").alias("n"))


@query(f"WITH {SEEDED} SELECT doc_id, regexp_matches(text, '[A-Za-z0-9_+/=.:!@#$%^&*-]{{32,}}') AS admitted FROM seeded")
def entropy_run_admission(spark: SparkSession, folder: str) -> DataFrame:
    return _seeded(spark, folder).select("doc_id", admission.has_long_run(F.col("text"), 32).alias("admitted"))


@query(f"""WITH {SEEDED}, {LINES.format(table='seeded')}, m AS (SELECT doc_id, line_no, unnest(regexp_extract_all(line, '([A-Za-z_]+) ?[=:] ?"?([A-Za-z0-9_/+-]{{8,}})', 1)) AS a, unnest(regexp_extract_all(line, '([A-Za-z_]+) ?[=:] ?"?([A-Za-z0-9_/+-]{{8,}})', 2)) AS b FROM lines)
SELECT doc_id, line_no, sha256(CASE WHEN regexp_matches(a, '^[A-Za-z0-9_]{{1,64}}$') AND length(b) >= 8 AND NOT regexp_matches(b, '^[A-Za-z_][A-Za-z0-9_]{{0,63}}$') THEN b ELSE a END) AS value_hash FROM m""")
def group_fallback(spark: SparkSession, folder: str) -> DataFrame:
    """Where the first group holds a name, the value is in the other."""
    rx = '([A-Za-z_]+) ?[=:] ?"?([A-Za-z0-9_/+-]{8,})'
    a, b = (F.regexp_extract_all("line", F.lit(rx), F.lit(k)) for k in (1, 2))
    rows = extract.lines(_seeded(spark, folder)).select("doc_id", "line_no", F.explode(F.arrays_zip(a.alias("a"), b.alias("b"))).alias("m"))
    return rows.select("doc_id", "line_no", F.sha2(admission.value_group(F.col("m.a"), F.col("m.b")), 256).alias("value_hash"))


@query(f"""{SEEDED_ASSIGNED}, l AS (SELECT a.*, line FROM assigned a JOIN lines USING (doc_id, line_no)) SELECT doc_id, line_no, sha256(value) AS credential_hash, trim(regexp_extract(line, '[:=](.*)$', 1), ' "'';,') = value AS whole FROM l""")
def whole_assignment_value(spark: SparkSession, folder: str) -> DataFrame:
    rows = _seeded(spark, folder)
    found = extract.assignments(rows).join(extract.lines(rows), ["doc_id", "line_no"])
    return found.select("doc_id", "line_no", F.sha2("value", 256).alias("credential_hash"), admission.is_whole_value(F.col("line"), F.col("value")).alias("whole"))


@query(f"""WITH {SEEDED}, {LINES.format(table='seeded')}, k AS (SELECT doc_id, line_no, unnest(regexp_extract_all(line, '[A-Za-z_]*(?:pass|auth)[A-Za-z_]*')) AS name FROM lines) SELECT doc_id, line_no, name, regexp_matches(name, '(^|_|[a-z])(pass|auth)(_|$|word|wd|phrase|token|key|[A-Z])') AND NOT regexp_matches(name, '[a-z](pass|auth)') AS bounded FROM k""")
def keyword_boundary(spark: SparkSession, folder: str) -> DataFrame:
    """Whether ``pass`` and ``auth`` begin a word of their own in the names that hold them."""
    rows = extract.lines(_seeded(spark, folder)).select("doc_id", "line_no", F.explode(F.regexp_extract_all("line", F.lit("[A-Za-z_]*(?:pass|auth)[A-Za-z_]*"), F.lit(0))).alias("name"))
    return rows.withColumn("bounded", admission.bounded_keyword(F.col("name")))


@query(f"""{SCAN}, a AS (SELECT doc_id, value, list_reduce(list_transform(range(5, 15), lambda k: (strpos('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', substr(value, k, 1)) - 1)::BIGINT), lambda x, y: x * 32 + y) AS acc FROM matches WHERE detector_id = 'aws-access-key'),
b AS (SELECT doc_id, (((acc >> 2) & 140737488355200) >> 7)::VARCHAR AS account FROM a) SELECT doc_id, (account[-1:]) IN ('1', '7') AS canary FROM b""")
def canary_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Keys of listed accounts; here those that end in 1 or 7 are listed."""
    keys = extract.scan(_seeded(spark, folder), BUILT_IN[:1]).withColumn("account", C.aws_account(F.col("value")))
    listed = keys.select("account").distinct().where(F.right("account", F.lit(1)).isin("1", "7"))
    return admission.with_canary(keys, listed).select("doc_id", "canary")


GENERIC_SQL = "least(0.95::DOUBLE, 0.5::DOUBLE + CASE WHEN e >= 4.5 THEN 0.2 WHEN e >= 3.5 THEN 0.1 ELSE 0 END + CASE WHEN length(value) >= 32 THEN 0.15 WHEN length(value) >= 20 THEN 0.05 ELSE 0 END)"


@query(f"{SEEDED_ASSIGNED}, e AS (SELECT *, {ENTROPY.format(v='value')} AS e FROM assigned) SELECT doc_id, line_no, sha256(value) AS credential_hash, round(({GENERIC_SQL})::DOUBLE, 6) AS generic, round((least(0.9::DOUBLE, CASE WHEN e >= 5.8 THEN 0.75::DOUBLE WHEN e >= 4.5 THEN 0.65 ELSE 0.55 END + 0.1))::DOUBLE, 6) AS fallback FROM e")
def generic_confidence(spark: SparkSession, folder: str) -> DataFrame:
    rows = extract.assignments(_seeded(spark, folder)).withColumn("e", T.shannon_entropy(F.col("value")))
    return rows.select("doc_id", "line_no", F.sha2("value", 256).alias("credential_hash"), F.round(score.generic_confidence(F.col("e"), F.length("value")), 6).alias("generic"), F.round(score.fallback_confidence(F.col("e"), F.lit(True)), 6).alias("fallback"))


@query("""WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents), d AS (SELECT w, count(*) AS n FROM w GROUP BY 1), p AS (SELECT w[i : i + 1] AS pair, n FROM (SELECT w, n, unnest(range(1, length(w))) AS i FROM d)), c AS (SELECT pair, sum(n) + 1 AS n FROM p GROUP BY 1),
m AS (SELECT pair, ln(n / sum(n) OVER (PARTITION BY pair[1])) AS log_p FROM c), t AS (SELECT w, w[i : i + 1] AS pair FROM (SELECT w, unnest(range(1, length(w))) AS i FROM d WHERE length(w) >= 6))
SELECT w AS word, round(avg(log_p), 6) AS mean_log_p FROM t JOIN m USING (pair) GROUP BY 1""")
def bigram_randomness(spark: SparkSession, folder: str) -> DataFrame:
    """Mean log probability of the letter pairs of every word of six letters and more, by the texts' own model."""
    docs = _docs(spark, folder)
    words = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word")).where("length(word) >= 6").distinct()
    return score.randomness(words, score.bigram_model(docs.select(F.col("text").alias("word")))).select("word", F.round("mean_log_p", 6).alias("mean_log_p"))


@query(f"""{TOKENS}, s AS (SELECT DISTINCT value FROM v WHERE length(value) BETWEEN 16 AND 128), b AS (SELECT value, list_transform(range(1, length(value)), lambda i: substr(value, i, 2)) AS pairs FROM s)
SELECT value, {DIVERSITY.format(v='value')} >= 0.3 AND NOT regexp_matches(value, '^[0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{12}}$') AND len(list_distinct(pairs)) / len(pairs) >= 0.5 AS promising FROM b""")
def probabilistic_gate(spark: SparkSession, folder: str) -> DataFrame:
    values = _seeded(spark, folder).select(F.explode(F.regexp_extract_all("text", F.lit('[^ \n"]{4,}'), F.lit(0))).alias("value")).where("length(value) BETWEEN 16 AND 128").distinct()
    return values.withColumn("promising", admission.promising(F.col("value")))


# Further decoders: texts are encoded in the query, and come back.


def _round_trip(spark: SparkSession, folder: str, encode, decoder) -> DataFrame:
    rows = _docs(spark, folder).select("doc_id", encode(F.sha2(F.col("doc_id").cast("string"), 256)).alias("shown"))
    return rows.select("doc_id", F.sha2(decoder(F.col("shown")), 256).alias("text_hash"))


TRIP = "SELECT doc_id, sha256(sha256(doc_id::VARCHAR)) AS text_hash FROM documents"


def _per_character(column: Column, make) -> Column:
    return F.array_join(F.transform(F.split(column, ""), make), "")


@query(TRIP)
def decode_html_entities(spark: SparkSession, folder: str) -> DataFrame:
    return _round_trip(spark, folder, lambda c: _per_character(c, lambda x: F.concat(F.lit("&#"), F.ascii(x).cast("string"), F.lit(";"))), decode.html_entities)


@query(TRIP)
def decode_unicode_escapes(spark: SparkSession, folder: str) -> DataFrame:
    return _round_trip(spark, folder, lambda c: _per_character(c, lambda x: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(F.ascii(x))), 4, "0"))), decode.unicode_escapes)


@query(TRIP)
def decode_octal_escapes(spark: SparkSession, folder: str) -> DataFrame:
    return _round_trip(spark, folder, lambda c: _per_character(c, lambda x: F.concat(F.lit("\\"), F.lpad(F.conv(F.ascii(x).cast("string"), 10, 8), 3, "0"))), decode.octal_escapes)


@query(TRIP)
def decode_quoted_printable(spark: SparkSession, folder: str) -> DataFrame:
    return _round_trip(spark, folder, lambda c: _per_character(c, lambda x: F.concat(F.lit("="), F.hex(F.ascii(x)))), decode.quoted_printable)


@query(TRIP)
def decode_z85(spark: SparkSession, folder: str) -> DataFrame:
    """Hashes packed as Z85 in the query, and unpacked."""
    digits = F.lit(decode.Z85)

    def packed(c: Column) -> Column:
        raw = F.encode(c, "UTF-8")
        group = lambda k: F.conv(F.hex(F.substring(raw, k * 4 + 1, F.lit(4))), 16, 10).cast("long")
        return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.array(*(F.substring(digits, (F.floor(group(k) / 85**p) % 85 + 1).cast("int"), F.lit(1)) for p in (4, 3, 2, 1, 0))))), "")

    return _round_trip(spark, folder, packed, decode.z85)


@query(TRIP)
def decode_mime_words(spark: SparkSession, folder: str) -> DataFrame:
    return _round_trip(spark, folder, lambda c: F.concat(F.lit("=?utf-8?B?"), F.translate(F.base64(F.encode(c, "UTF-8")), "\r\n", ""), F.lit("?=")), decode.mime_words)


# Triage and allowlists.


@query(f"""WITH {FINDINGS}, r AS (SELECT doc_id, k, credential_hash, detector_id, CASE WHEN confidence < 0.6 THEN 'false_positive' ELSE 'confirmed' END AS disposition FROM findings)
SELECT detector_id, disposition, count(*)::BIGINT AS n, count(DISTINCT credential_hash)::BIGINT AS n_values FROM r GROUP BY 1, 2""")
def triage_import(spark: SparkSession, folder: str) -> DataFrame:
    """Reviews as JSON envelopes, one for each document, imported."""
    rows = findings(_docs(spark, folder))
    record = F.struct(F.col("credential_hash").alias("finding_hash"), "detector_id", F.when(F.col("confidence") < 0.6, "false_positive").otherwise("confirmed").alias("disposition"), F.lit("reviewed").alias("reason"))
    envelopes = rows.groupBy("doc_id").agg(F.to_json(F.struct(F.lit(1).alias("version"), F.lit("d1").alias("detector_digest"), F.collect_list(record).alias("records"))).alias("envelope"))
    good, _ = admission.triage(envelopes, "d1")
    return good.groupBy("detector_id", "disposition").agg(F.count("*").alias("n"), F.count_distinct("finding_hash").alias("n_values"))


@query(f"""WITH {FINDINGS} SELECT doc_id, k, detector_id FROM findings WHERE NOT (starts_with(path, 'src2/')) AND detector_id <> 'entropy-token'""")
def allowlist_expiry(spark: SparkSession, folder: str) -> DataFrame:
    """Entries that have expired allow nothing any more."""
    entries = [("src2/**", "2999-01-01"), ("src3/**", "2001-01-01")]
    rows = findings(_docs(spark, folder))
    return admission.without_allowed(rows, entries).where("detector_id <> 'entropy-token'").select("doc_id", "k", "detector_id")
