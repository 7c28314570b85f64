"""Queries: where matches stand, shapes that are no credential, evidence, checksums, and the scan with all producers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.functions import codecs as C
from siftlake.functions import text as T
from siftlake.operators import context, extract, score, shapes
from siftlake.sources.tables import FINDINGS, SEEDED, chunks, findings, read, seeded_chunks

from . import engine
from .detectors import BUILT_IN, numbered
from .registry import query
from .scans import LINES, REDACTED, SCAN, SEEDED_ASSIGNED, quoted


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "documents")


def _seeded(spark: SparkSession, folder: str) -> DataFrame:
    return seeded_chunks(_docs(spark, folder))


CONTEXT_SQL = f"""CASE WHEN opened > closed THEN 'encrypted' WHEN regexp_matches(lower(path), {quoted(context.TEST_PATH)}) THEN 'test' WHEN regexp_matches(lower(path), {quoted(context.DOCUMENTATION_PATH)}) OR quotes % 2 = 1 OR fences % 2 = 1 THEN 'documentation'
 WHEN regexp_matches(line, {quoted(context.COMMENT)}) THEN 'comment' WHEN regexp_matches(line, {quoted(context.ASSIGNED)}) THEN 'assignment' WHEN regexp_matches(line, '["''`]') THEN 'string' ELSE 'unknown' END"""


def _before(regex: str) -> str:
    return f"coalesce(sum(len(regexp_extract_all(line, {quoted(regex)}))) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"


@query(f"""WITH {SEEDED}, l AS (SELECT doc_id, path, string_split(text, chr(10)) AS s FROM (SELECT * REPLACE (CASE doc_id % 7 WHEN 0 THEN 'tests/' || path WHEN 1 THEN 'docs/' || path ELSE path END AS path, CASE WHEN doc_id % 5 = 0 THEN '```' || chr(10) || text ELSE text END AS text) FROM seeded)),
lines AS (SELECT doc_id, path, unnest(range(1, len(s) + 1)) AS line_no, unnest(s) AS line FROM l),
c AS (SELECT *, {_before(context.BEGIN_ENCRYPTED)} AS opened, {_before(context.END_ENCRYPTED)} AS closed, {_before('"""')} AS quotes, {_before('^```')} AS fences FROM lines)
SELECT doc_id, {CONTEXT_SQL} AS context, count(*)::BIGINT AS n FROM c GROUP BY 1, 2""")
def line_context_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Classes of all lines of the texts, some of which stand in folders of tests and documentation, and some behind a code fence."""
    rows = _seeded(spark, folder).withColumn("path", F.concat(F.when(F.col("doc_id") % 7 == 0, "tests/").when(F.col("doc_id") % 7 == 1, "docs/").otherwise(""), "path"))
    rows = rows.withColumn("text", F.concat(F.when(F.col("doc_id") % 5 == 0, "```\n").otherwise(""), "text"))
    return context.line_contexts(extract.lines(rows, "path"), F.col("path")).groupBy("doc_id", "context").agg(F.count("*").alias("n"))


ROLE_SQL = "CASE WHEN m OR marks % 2 = 1 THEN 'fence' " + " ".join(f"WHEN regexp_matches(line, {quoted(rx)}) THEN {quoted(name)}" for name, rx in context.ROLES) + " ELSE 'code' END"


@query(f"""WITH {SEEDED}, {LINES.format(table="(SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '```' || chr(10) || text || chr(10) || '```' || chr(10) || '$ ls' ELSE text END AS text FROM seeded)")},
f AS (SELECT *, starts_with(line, '```') AS m, sum(starts_with(line, '```')::INT) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS marks FROM lines),
r AS (SELECT *, {ROLE_SQL} AS role FROM f), n AS (SELECT *, CASE WHEN lag(role) OVER (PARTITION BY doc_id ORDER BY line_no) = role THEN 0 ELSE 1 END AS fresh FROM r),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS run FROM n)
SELECT doc_id, role, min(line_no) AS first_line, max(line_no) AS last_line FROM i GROUP BY doc_id, role, run""")
def document_roles(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of lines of one role in all texts, every fourth of them inside a code fence with a command behind it."""
    fenced = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("```\n"), "text", F.lit("\n```\n$ ls"))).otherwise(F.col("text"))
    return context.role_spans(extract.lines(_seeded(spark, folder).withColumn("text", fenced)))


SHAPE_SQL = f"CASE WHEN length(value) > {shapes.MOST} THEN NULL " + " ".join(f"WHEN regexp_matches(value, {quoted(rx)}) THEN {quoted(name)}" for name, rx in shapes.STAGES) + " END"


@query(f"""WITH {SEEDED}, v AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[^\\n"]{{4,40}}') || regexp_extract_all(text, '[^ \\n"]{{4,}}')) AS value FROM seeded UNION SELECT url FROM pages UNION SELECT unnest(regexp_extract_all(html, '[^ \\n"]{{4,}}')) FROM pages)
SELECT coalesce({SHAPE_SQL}, 'reported') AS shape, count(*)::BIGINT AS n FROM v WHERE value IS NOT NULL GROUP BY 1""")
def shape_histogram(spark: SparkSession, folder: str) -> DataFrame:
    """Shapes of all distinct words and stretches of the texts and pages, and of the pages' addresses."""
    each = lambda c, *rx: F.explode(F.concat(*(F.regexp_extract_all(c, F.lit(r), F.lit(0)) for r in rx))).alias("value")
    pages = read(spark, folder, "pages")
    values = _seeded(spark, folder).select(each("text", '[^\n"]{4,40}', '[^ \n"]{4,}')).union(pages.select("url")).union(pages.select(each("html", '[^ \n"]{4,}'))).where("value IS NOT NULL").distinct()
    return values.groupBy(F.coalesce(shapes.shape(F.col("value")), F.lit("reported")).alias("shape")).agg(F.count("*").alias("n"))


@query(f"""WITH {LINES.format(table='documents')}, w AS (SELECT doc_id, line, list_filter(regexp_split_to_array(lower(line), '[^a-z'']+'), lambda x: x <> '') AS words FROM lines),
j AS (SELECT *, len(list_filter(words, lambda x: list_contains([{', '.join(map(quoted, shapes.CONNECTORS))}], x))) AS n FROM w)
SELECT doc_id, count(*) FILTER (WHERE regexp_matches(line, '\\s') AND len(words) >= 5 AND (n >= 3 OR 5 * n >= len(words)))::BIGINT AS n_prose FROM j GROUP BY 1""")
def prose_lines(spark: SparkSession, folder: str) -> DataFrame:
    return extract.lines(chunks(_docs(spark, folder))).groupBy("doc_id").agg(F.count_if(shapes.is_prose(F.col("line"))).alias("n_prose"))


@query(f"""{SCAN}, r AS (SELECT CASE WHEN detector_id = 'generic-secret' THEN 'generic-assignment' WHEN detector_id IN ('private-key-block', 'json-web-token', 'connection-string') THEN 'structural-grammar' ELSE 'vendor-pattern' END AS reason FROM matches),
t (reason, tier) AS (VALUES {', '.join(f"('{a}', '{b}')" for a, b in score.EVIDENCE)})
SELECT reason, tier, count(*)::BIGINT AS n FROM r JOIN t USING (reason) GROUP BY 1, 2""")
def evidence_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """Reasons and tiers of what a scan of the texts finds."""
    found = extract.scan(_seeded(spark, folder), BUILT_IN)
    channel = F.when(F.col("detector_id").isin(*engine.GENERIC), "assignment").otherwise("pattern")
    none = F.array().cast("array<string>")
    rows = found.withColumn("reason", score.evidence_reason(F.col("detector_id"), channel, F.lit("unknown"), F.col("path"), F.lit("none"), none, F.lit(False)))
    return rows.groupBy("reason", score.evidence_tier(F.col("reason")).alias("tier")).agg(F.count("*").alias("n"))


@query()
def checksum_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens behind the texts, every third with a right checksum: the verdict, and the confidence that it makes. ``made_valid``: what it has to be."""
    body = F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 30)
    right = C.base62(F.crc32(F.encode(body, "UTF-8")), 6)
    token = F.concat(F.lit("ghp_"), body, F.when(F.col("doc_id") % 3 == 0, right).otherwise(F.reverse(right)))
    rows = chunks(_docs(spark, folder)).withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit("\nx "), token))
    found = extract.scan(rows, tuple(d for d in BUILT_IN if d.id == "github-classic-pat")).where(F.col("value").isNotNull()).withColumn("confidence", F.lit(0.7))
    found = found.withColumn("checksum", score.checksum_verdict(F.col("value"), F.array(F.lit("crc32-base62"))))
    made = (F.col("doc_id") % 3 == 0) | (right_of(F.col("value")) == F.right("value", F.lit(6)))
    return score.by_checksum(found.withColumn("made_valid", made)).select("doc_id", "checksum", "confidence", "made_valid")


def right_of(token):
    """The six digits that a token's body asks for."""
    return C.base62(F.crc32(F.encode(F.substring(token, 5, 30), "UTF-8")), 6)


@query(f"""WITH {FINDINGS} SELECT severity_rank AS before, (CASE WHEN detector_id = 'slack-bot-token' THEN 1 ELSE greatest(0, severity_rank - (k = 1)::INT - (doc_id % 3 = 1)::INT) END)::INT AS after, count(*)::BIGINT AS n FROM findings GROUP BY 1, 2""")
def severity_adjust(spark: SparkSession, folder: str) -> DataFrame:
    outcome = F.when(F.col("doc_id") % 3 == 1, "revoked").otherwise("live")
    after = score.adjusted_severity(F.col("severity_rank"), F.col("k") == 1, F.col("detector_id") == "slack-bot-token", outcome)
    return findings(_docs(spark, folder)).groupBy(F.col("severity_rank").alias("before"), after.alias("after")).agg(F.count("*").alias("n"))


SERVICES = tuple(sorted({d.service for d in BUILT_IN if d.service != "generic"}))


@query(f"""WITH {SEEDED}, {LINES.format(table='seeded')}, s AS (SELECT doc_id, line_no, list_sort(list_intersect([{', '.join(map(quoted, SERVICES))}], regexp_extract_all(lower(line), '[a-z0-9]+'))) AS services FROM lines)
SELECT doc_id, line_no, array_to_string(services, ',') AS services FROM s WHERE len(services) > 0""")
def service_context(spark: SparkSession, folder: str) -> DataFrame:
    """Lines that name a service."""
    rows = extract.lines(_seeded(spark, folder)).withColumn("services", F.array_join(context.names_service(F.col("line"), SERVICES), ","))
    return rows.where("services <> ''").select("doc_id", "line_no", "services")


BYTE_ENTROPY = "(SELECT -sum(p * log2(p)) FROM (SELECT count(*) / any_value(t) AS p FROM (SELECT unnest(range(1, len(hex(encode({v}))) // 2 + 1)) AS i, hex(encode({v})) AS h, (len(hex(encode({v}))) // 2)::DOUBLE AS t) GROUP BY substr(h, (2 * i - 1)::INT, 2)))"


@query(f"""WITH {LINES.format(table='documents')}, w AS (SELECT DISTINCT unnest(regexp_extract_all(line, '[^ \\n]{{12,}}')) AS value FROM lines),
h AS (SELECT value, hex(encode(value)) AS h FROM w), b AS (SELECT value, len(h) // 2 AS n, unnest(list_transform(range(0, len(h) // 2), lambda i: h[2 * i + 1 : 2 * i + 2])) AS b FROM h),
c AS (SELECT value, b, count(*) AS c, any_value(n)::DOUBLE AS n FROM b GROUP BY 1, 2) SELECT sha256(value) AS value_hash, round(sum(-(c / n) * log2(c / n)), 6) AS entropy FROM c GROUP BY value""")
def byte_entropy_values(spark: SparkSession, folder: str) -> DataFrame:
    """Entropy for each byte of the long words of the texts, accents and all."""
    words = extract.lines(chunks(_docs(spark, folder))).select(F.explode(F.regexp_extract_all("line", F.lit(r"[^ \n]{12,}"), F.lit(0))).alias("value")).distinct()
    return words.select(F.sha2("value", 256).alias("value_hash"), F.round(T.byte_entropy(F.col("value")), 6).alias("entropy"))


@query(f"""WITH {SEEDED} SELECT doc_id, sha256(v) AS credential_hash, length(v)::INT AS n_chars FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?:ghp_|sk_live_)[A-Za-z0-9]{{10}}[A-Za-z0-9_-]*')) AS v FROM seeded)""")
def prefix_extension(spark: SparkSession, folder: str) -> DataFrame:
    """Values that a pattern cuts short after ten characters, with what follows them."""
    regex = "(?:ghp_|sk_live_)[A-Za-z0-9]{10}"
    rows = _seeded(spark, folder).select("doc_id", F.explode(extract.extended(F.col("text"), regex)).alias("v"))
    return rows.select("doc_id", F.sha2("v", 256).alias("credential_hash"), F.length("v").alias("n_chars"))


@query(f"{SEEDED_ASSIGNED} SELECT doc_id, line_no, {REDACTED.format(v='value')} AS redacted FROM assigned WHERE NOT (contains(lower(value), 'ample') OR value = 'none' OR regexp_matches(value, '^[0-9a-f]{{8}}-'))")
def detector_lists(spark: SparkSession, folder: str) -> DataFrame:
    """Assigned values that no list of a detector's own drops."""
    rows = extract.assignments(_seeded(spark, folder)).where(~shapes.stopped(F.col("value"), ("ample",), ("none", "re:^[0-9a-f]{8}-")))
    return rows.select("doc_id", "line_no", T.redact(F.col("value")).alias("redacted"))


FULL_NAMED = f"""{SCAN}, h AS (SELECT doc_id, detector_id, sha256(value) AS credential_hash, line_no, byte_offset FROM matches WHERE detector_id <> 'generic-secret')
SELECT h.doc_id, detector_id, credential_hash, line_no, byte_offset, 'pattern' AS channel, CASE WHEN detector_id IN ('json-web-token', 'connection-string') THEN 'structural-grammar' WHEN detector_id = 'aws-access-key' THEN 'required-companion' ELSE 'vendor-pattern' END AS reason FROM h"""


@query(FULL_NAMED)
def scan_full_named(spark: SparkSession, folder: str) -> DataFrame:
    """What the whole scan, with all producers and decoding, reports by named detectors: every seeded credential, at its place, with its reason."""
    found = engine.full_scan(_seeded(spark, folder)).where(~F.col("detector_id").isin(engine.ASSIGNMENT.id, engine.ENTROPY_TOKEN.id))
    return found.select("doc_id", "detector_id", "credential_hash", "line_no", "byte_offset", "channel", "reason")


@query(FULL_NAMED)
def scan_windowed(spark: SparkSession, folder: str) -> DataFrame:
    """The same over blocks of 4,096 characters: what a match needs is found in its block or beside it, at the same place."""
    found = engine.full_scan(_seeded(spark, folder), policy="fast", window=4096).where(~F.col("detector_id").isin(engine.ASSIGNMENT.id, engine.ENTROPY_TOKEN.id))
    return found.select("doc_id", "detector_id", "credential_hash", "line_no", "byte_offset", "channel", "reason")


@query(f"""WITH f AS ({FULL_NAMED}), p AS (SELECT doc_id, coalesce(source, 'unknown') || '/' || coalesce(lang, 'und') || '/' || doc_id || '.txt' AS path FROM documents)
SELECT f.*, (CASE detector_id WHEN 'stripe-live-key' THEN 5 WHEN 'aws-access-key' THEN 5 WHEN 'github-classic-pat' THEN CASE WHEN doc_id % 20 = 11 THEN 4 ELSE 5 END WHEN 'slack-bot-token' THEN 4 WHEN 'json-web-token' THEN 3 ELSE 4 END)::INT AS severity_rank
FROM (SELECT * REPLACE (CASE WHEN detector_id = 'json-web-token' AND doc_id % 20 = 6 THEN 'live-verification' ELSE reason END AS reason) FROM f) f JOIN p USING (doc_id)
WHERE NOT (detector_id = 'slack-bot-token' AND contains(path, '/de/')) AND NOT starts_with(path, 'src1/') AND NOT (detector_id = 'github-classic-pat' AND doc_id % 20 = 1) AND NOT (detector_id = 'stripe-live-key' AND doc_id % 20 = 9)""")
def scan_policies(spark: SparkSession, folder: str) -> DataFrame:
    """The whole scan with a rule, an allowed path, a baseline, triage, and verdicts that lower a severity or confirm a finding."""
    docs, hexes = _docs(spark, folder), F.sha2(F.col("doc_id").cast("string"), 256)
    part = lambda a, n: F.substring(hexes, a, n)
    known = lambda k, ident, value: docs.where(F.col("doc_id") % 20 == k).select(F.lit(ident).alias("detector_id"), F.sha2(value, 256).alias("credential_hash"))
    github = F.concat(F.lit("ghp_"), part(1, 36))
    web = F.concat(F.lit("eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIx"), part(1, 8), F.lit("In0."), part(1, 43))
    verdict = lambda k, value, said: known(k, "", value).select("credential_hash", F.lit(said).alias("outcome"))
    controls = engine.Controls(
        rules=({"detector": "slack-bot-token", "path_contains": "/de/"},),
        allow=("src1/**",),
        baseline=known(1, "github-classic-pat", github),
        triage=known(9, "stripe-live-key", F.concat(F.lit("sk_live_"), part(1, 24))),
        verified=verdict(11, github, "revoked").unionByName(verdict(6, web, "live")),
    )
    found = engine.full_scan(_seeded(spark, folder), policy="fast", controls=controls).where(~F.col("detector_id").isin(engine.ASSIGNMENT.id, engine.ENTROPY_TOKEN.id))
    return found.select("doc_id", "detector_id", "credential_hash", "line_no", "byte_offset", "channel", "reason", "severity_rank")


@query()
def scan_full(spark: SparkSession, folder: str) -> DataFrame:
    """The whole scan: all its findings."""
    found = engine.full_scan(_seeded(spark, folder))
    return found.withColumn("companions", F.array_join(F.map_keys("companions"), ",")).withColumn("others", F.array_join("others", ",")).withColumn("locations", F.array_join(F.transform("locations", lambda x: x.cast("string")), ","))


@query()
def scan_explain(spark: SparkSession, folder: str) -> DataFrame:
    """Every candidate of the texts and the stage that drops it."""
    return engine.explain(_seeded(spark, folder), policy="fast")


MANY = 600


@query(f"""{SCAN}, k AS (SELECT doc_id, 'k' || lpad((doc_id % {MANY})::VARCHAR, 3, '0') || '_' || sha256(doc_id::VARCHAR)[1:24] AS v, text FROM seeded)
SELECT doc_id, detector_id, sha256(value) AS credential_hash, line_no FROM matches WHERE detector_id <> 'generic-secret'
UNION ALL SELECT doc_id, 'synthetic-' || substr(v, 2, 3), sha256(v), (length(text) - length(replace(text, chr(10), '')) + 2)::BIGINT FROM k""")
def detector_scan_catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """A scan by more than 600 patterns: the built-in ones, and those of a catalogue of which each text holds one value."""
    return catalogue_scan(spark, folder, anchors=True)


def catalogue_scan(spark: SparkSession, folder: str, anchors: bool) -> DataFrame:
    n = F.lpad((F.col("doc_id") % MANY).cast("string"), 3, "0")
    rows = _seeded(spark, folder).withColumn("text", F.concat("text", F.lit("\nkey k"), n, F.lit("_"), F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 24)))
    found = extract.scan(rows, (*(d for d in BUILT_IN if d.id not in engine.GENERIC), *numbered(MANY)), anchors=anchors)
    return found.select("doc_id", "detector_id", F.sha2("value", 256).alias("credential_hash"), "line_no")


@query()
def token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Long words of the texts with their number of tokens, and whether that makes them words of a language; each distinct one is encoded once."""
    from siftlake.functions.tokens import token_counter, word_like

    words = extract.lines(_seeded(spark, folder)).select(F.explode(F.regexp_extract_all("line", F.lit(r"[^ \n]{8,}"), F.lit(0))).alias("value")).distinct()
    counted = words.withColumn("n_tokens", token_counter(spark)(F.col("value")))
    return counted.select(F.sha2("value", 256).alias("value_hash"), "n_tokens", word_like(F.col("value"), F.col("n_tokens")).alias("word_like"))
