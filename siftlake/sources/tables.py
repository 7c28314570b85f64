"""Tables of a folder, chunks of text made from them, and rows derived from documents that hold credential-like values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftlake.plans.detectors import BUILT_IN, ENTROPY_TOKEN, SEVERITIES, Detector


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def chunks(docs: DataFrame) -> DataFrame:
    """Documents as chunks: doc_id, path, text, base_line and base_offset."""
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("und")), F.concat(F.col("doc_id"), F.lit(".txt")))
    return docs.select("doc_id", path.alias("path"), "text", F.lit(0).cast("long").alias("base_line"), F.lit(0).cast("long").alias("base_offset"))


def seeded_chunks(docs: DataFrame) -> DataFrame:
    """Chunks with lines behind each text that hold a value made from a hash of its doc_id: keys, tokens, passwords and look-alikes.

    The values are synthetic; they let detectors be exercised on data of any size.
    """
    hexes = F.sha2(F.col("doc_id").cast("string"), 256)
    upper = F.translate(F.upper("_hex"), "0189", "GHIJ")
    digits = F.translate("_hex", "abcdef", "012345")
    part = lambda c, a, n: F.substring(c, a, n)
    kinds = [
        F.concat(F.lit("aws_access_key_id = AKIA"), part(upper, 1, 16), F.lit("\nregion = eu-west-1\naws_secret_access_key = "), part("_hex", 1, 40)),
        F.concat(F.lit("GH_TOKEN=ghp_"), part("_hex", 1, 36)),
        F.concat(F.lit("# bot\nslack: xoxb-"), part(digits, 1, 12), F.lit("-"), part(digits, 13, 12), F.lit("-"), part("_hex", 1, 24)),
        F.concat(F.lit('password = "'), part("_hex", 1, 20), F.lit('"')),
        F.concat(F.lit("# sample only\napi_key: example"), part("_hex", 1, 16)),
        F.concat(F.lit("url=postgres://app:"), part("_hex", 1, 12), F.lit("@db.example.com/x")),
        F.concat(F.lit("bearer eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIx"), part("_hex", 1, 8), F.lit("In0."), part("_hex", 1, 43)),
        F.concat(F.lit("sha256 checksum "), F.col("_hex")),
        F.concat(F.lit("secret="), part("_hex", 1, 8), F.lit("-"), part("_hex", 9, 4), F.lit("-4"), part("_hex", 13, 3), F.lit("-a"), part("_hex", 16, 3), F.lit("-"), part("_hex", 19, 12)),
        F.concat(F.lit("pay: sk_live_"), part("_hex", 1, 24)),
    ]
    rows = chunks(docs).withColumn("_hex", hexes)
    line = F.get(F.array(*kinds), F.pmod(F.col("doc_id"), F.lit(10)).cast("int"))
    return rows.withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), line)).drop("_hex")


def findings(docs: DataFrame) -> DataFrame:
    """What a scan by four detectors finds in the texts and in three lines behind each, whose values recur over documents and paths.

    doc_id, k (its number in the document), detector_id, service, severity_rank, credential_hash, path, line, offset and confidence.
    """
    from siftlake.operators import extract, score
    from siftlake.functions import text as T

    hexes = F.sha2(F.pmod(F.col("doc_id"), F.lit(97)).cast("string"), 256)
    upper, digits, part = F.translate(F.upper("_hex"), "0189", "GHIJ"), F.translate("_hex", "abcdef", "012345"), F.substring
    kinds = F.array(
        F.concat(F.lit("id AKIA"), part(upper, 1, 16)),
        F.concat(F.lit('password = "'), part("_hex", 1, 20), F.lit('"')),
        F.concat(F.lit("slack: xoxb-"), part(digits, 1, 12), F.lit("-"), part(digits, 13, 12), F.lit("-"), part("_hex", 1, 24)),
        F.concat(F.lit("bearer "), part("_hex", 1, 40)),
    )
    line = lambda n: F.get(kinds, F.pmod(F.col("doc_id") + n, F.lit(4)).cast("int"))
    path = F.concat(F.coalesce("source", F.lit("")), F.lit("/"), F.coalesce("lang", F.lit("")), F.lit("/f"), F.pmod(F.col("doc_id"), F.lit(40)).cast("string"), F.lit(".txt"))
    zero = F.lit(0).cast("long")
    rows = docs.withColumn("_hex", hexes).select("doc_id", path.alias("path"), F.concat_ws("\n", F.coalesce("text", F.lit("")), line(0), line(1), line(2)).alias("text"), zero.alias("base_line"), zero.alias("base_offset"))
    found = extract.with_detector(extract.scan(rows, FOUND_BY), FOUND_BY)
    order = Window.partitionBy("doc_id").orderBy("byte_offset", "detector_id", "value")
    return found.select(
        "doc_id",
        (F.row_number().over(order) - 1).alias("k"),
        "detector_id",
        "service",
        "severity_rank",
        F.sha2("value", 256).alias("credential_hash"),
        "path",
        F.col("line_no").alias("line"),
        F.col("byte_offset").alias("offset"),
        F.round(score.generic_confidence(T.shannon_entropy(F.col("value")), F.length("value")), 6).alias("confidence"),
    )


#: The same in DuckDB: common table expressions to put in front of a query.
CHUNKS = """chunks AS (SELECT doc_id, coalesce(source, 'unknown') || '/' || coalesce(lang, 'und') || '/' || doc_id || '.txt' AS path, text, 0::BIGINT AS base_line, 0::BIGINT AS base_offset FROM documents)"""
SEEDED = """hexed AS (SELECT *, sha256(doc_id::VARCHAR) AS h FROM documents),
spelt AS (SELECT *, translate(upper(h), '0189', 'GHIJ') AS u, translate(h, 'abcdef', '012345') AS d FROM hexed),
seeded AS (SELECT doc_id, coalesce(source, 'unknown') || '/' || coalesce(lang, 'und') || '/' || doc_id || '.txt' AS path, coalesce(text, '') || chr(10) || CASE doc_id % 10
  WHEN 0 THEN 'aws_access_key_id = AKIA' || u[1:16] || chr(10) || 'region = eu-west-1' || chr(10) || 'aws_secret_access_key = ' || h[1:40]
  WHEN 1 THEN 'GH_TOKEN=ghp_' || h[1:36]
  WHEN 2 THEN '# bot' || chr(10) || 'slack: xoxb-' || d[1:12] || '-' || d[13:24] || '-' || h[1:24]
  WHEN 3 THEN 'password = "' || h[1:20] || '"'
  WHEN 4 THEN '# sample only' || chr(10) || 'api_key: example' || h[1:16]
  WHEN 5 THEN 'url=postgres://app:' || h[1:12] || '@db.example.com/x'
  WHEN 6 THEN 'bearer eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIx' || h[1:8] || 'In0.' || h[1:43]
  WHEN 7 THEN 'sha256 checksum ' || h
  WHEN 8 THEN 'secret=' || h[1:8] || '-' || h[9:12] || '-4' || h[13:15] || '-a' || h[16:18] || '-' || h[19:30]
  ELSE 'pay: sk_live_' || h[1:24] END AS text FROM spelt)"""
ENTROPY = "list_sum(list_transform(list_distinct(string_split({v}, '')), lambda x: -(len(list_filter(string_split({v}, ''), lambda y: y = x)) / length({v})) * log2(len(list_filter(string_split({v}, ''), lambda y: y = x)) / length({v}))))"


def scan_sql(detectors: tuple[Detector, ...], table: str, prefix: str = "") -> str:
    """Common table expressions, up to ``{prefix}matches``: doc_id, detector_id, value, byte_offset and line_no of what the detectors find in a table."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    parts = []
    for d in detectors:
        for p in d.patterns:
            rx, keys = quoted(p.regex), " OR ".join(f"contains(lower(text), {quoted(k)})" for k in d.keywords)
            parts.append(f"SELECT doc_id, {quoted(d.id)} AS detector_id, regexp_split_to_array(text, {rx}) AS parts, regexp_extract_all(text, {rx}) AS whole, regexp_extract_all(text, {rx}, {p.group}) AS own, text FROM {table} WHERE {keys}")
    return f"""{prefix}found AS ({' UNION ALL '.join(parts)}),
{prefix}each AS (SELECT *, unnest(range(1, len(whole) + 1)) AS i FROM {prefix}found),
{prefix}placed AS (SELECT doc_id, detector_id, own[i] AS value, text, list_sum(list_transform(parts[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(whole[1:i - 1], lambda x: length(x))), 0) + strpos(whole[i], own[i]) - 1 AS start FROM {prefix}each),
{prefix}matches AS (SELECT doc_id, detector_id, value, octet_length(encode(left(text, start::INT)))::BIGINT AS byte_offset, (length(left(text, start::INT)) - length(replace(left(text, start::INT), chr(10), '')) + 1)::BIGINT AS line_no FROM {prefix}placed WHERE value <> '')"""


FOUND_BY = (*(d for d in BUILT_IN if d.id in ("aws-access-key", "generic-secret", "slack-bot-token")), ENTROPY_TOKEN)
_LINE = """CASE (doc_id + {n}) % 4 WHEN 0 THEN 'id AKIA' || u[1:16] WHEN 1 THEN 'password = "' || h[1:20] || '"' WHEN 2 THEN 'slack: xoxb-' || d[1:12] || '-' || d[13:24] || '-' || h[1:24] ELSE 'bearer ' || h[1:40] END"""
FINDINGS = f"""f_hexed AS (SELECT *, sha256((doc_id % 97)::VARCHAR) AS h FROM documents), f_spelt AS (SELECT *, translate(upper(h), '0189', 'GHIJ') AS u, translate(h, 'abcdef', '012345') AS d FROM f_hexed),
f_seeded AS (SELECT doc_id, coalesce(source, '') || '/' || coalesce(lang, '') || '/f' || (doc_id % 40)::VARCHAR || '.txt' AS path, coalesce(text, '') || chr(10) || {_LINE.format(n=0)} || chr(10) || {_LINE.format(n=1)} || chr(10) || {_LINE.format(n=2)} AS text FROM f_spelt),
{scan_sql(FOUND_BY, 'f_seeded', 'f_')}, f_scored AS (SELECT *, {ENTROPY.format(v='value')} AS e FROM f_matches),
findings AS (SELECT m.doc_id, (row_number() OVER (PARTITION BY m.doc_id ORDER BY byte_offset, detector_id, value) - 1)::INT AS k, detector_id, CASE detector_id WHEN 'aws-access-key' THEN 'aws' WHEN 'slack-bot-token' THEN 'slack' ELSE 'generic' END AS service,
  (CASE detector_id {' '.join(f"WHEN '{d.id}' THEN {SEVERITIES.index(d.severity)}" for d in FOUND_BY)} END)::INT AS severity_rank, sha256(value) AS credential_hash, path, line_no AS line, byte_offset AS "offset",
  round(least(0.95::DOUBLE, 0.5::DOUBLE + CASE WHEN e >= 4.5 THEN 0.2::DOUBLE WHEN e >= 3.5 THEN 0.1 ELSE 0 END + CASE WHEN length(value) >= 32 THEN 0.15::DOUBLE WHEN length(value) >= 20 THEN 0.05 ELSE 0 END), 6) AS confidence
  FROM f_scored m JOIN f_seeded s ON s.doc_id = m.doc_id)"""
