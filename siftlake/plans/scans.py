"""Queries: extraction, detectors, scalars, scores and suppression."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.functions import codecs as C
from siftlake.functions import text as T
from siftlake.operators import extract as E
from siftlake.operators import score, suppress
from siftlake.sources.tables import CHUNKS, ENTROPY, FINDINGS, SEEDED, chunks, findings, read, scan_sql, seeded_chunks

from .detectors import BUILT_IN, SEVERITIES, detector_table, search
from .registry import query


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "documents")


def _seeded(spark: SparkSession, folder: str) -> DataFrame:
    return seeded_chunks(_docs(spark, folder))


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


# Pieces of DuckDB SQL.
LINES = "lines AS (SELECT doc_id, unnest(range(1, len(s) + 1))::BIGINT AS line_no, unnest(s) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM {table}))"
ASSIGNED = f"assigned AS (SELECT doc_id, line_no, lower(unnest(regexp_extract_all(line, {quoted(E.ASSIGNMENT)}, 1))) AS keyword, unnest(regexp_extract_all(line, {quoted(E.ASSIGNMENT)}, 2)) AS value FROM lines)"
SEEDED_ASSIGNED = f"WITH {SEEDED}, {LINES.format(table='seeded')}, {ASSIGNED}"
DIVERSITY = "len(list_distinct(string_split({v}, ''))) / length({v})"
RUN = "list_max(list_transform(range(1, length({v}) + 1), lambda i: length(regexp_extract(substr({v}, i), '^(?:' || regexp_escape(substr({v}, i, 1)) || ')+'))))"
REDACTED = "CASE WHEN length({v}) <= 8 THEN '****' ELSE left({v}, least(4, greatest(1, length({v}) // 8))::INT) || '...' || right({v}, least(4, greatest(1, length({v}) // 8))::INT) END"
PLACEHOLDER = "(" + " OR ".join(f"contains(lower({{v}}), '{w}')" for w in score.PLACEHOLDERS) + " OR (length({v}) >= 16 AND 4 * (length({v}) - length(replace(lower({v}), 'x', ''))) > 3 * length({v})) OR ends_with({v}, 'EXAMPLE'))"


def _located_sql(regex: str, table: str = "documents") -> str:
    rx = quoted(regex)
    return f"""
WITH p AS (SELECT doc_id, text, regexp_split_to_array(text, {rx}) AS parts, regexp_extract_all(text, {rx}) AS found FROM {table}),
s AS (SELECT doc_id, text, found[i] AS value, list_sum(list_transform(parts[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS start
  FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM p))
SELECT doc_id, value, octet_length(encode(left(text, start::INT)))::BIGINT AS byte_offset, (length(left(text, start::INT)) - length(replace(left(text, start::INT), chr(10), '')) + 1)::BIGINT AS line_no FROM s"""


@query("""WITH t AS (SELECT lang, string_split(text, chr(10)) AS s FROM documents), l AS (SELECT lang, unnest(s) AS line FROM t)
SELECT lang, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE trim(line) = '')::BIGINT AS n_blank, max(length(line))::BIGINT AS longest FROM l GROUP BY lang""")
def lines_explode(spark: SparkSession, folder: str) -> DataFrame:
    rows = E.lines(chunks(_docs(spark, folder)))
    rows = rows.join(_docs(spark, folder).select("doc_id", "lang"), "doc_id")
    return rows.groupBy("lang").agg(F.count("*").alias("n_lines"), F.count_if(F.trim("line") == "").alias("n_blank"), F.max(F.length("line")).cast("long").alias("longest"))


@query(f"""{SEEDED_ASSIGNED} SELECT doc_id, line_no, keyword, {REDACTED.format(v='value')} AS redacted, sha256(value) AS credential_hash, round({ENTROPY.format(v='value')}, 6) AS entropy FROM assigned""")
def scan_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The flagship: every assigned credential-like value, redacted, with its hash and entropy."""
    found = E.assignments(_seeded(spark, folder))
    return found.select("doc_id", "line_no", "keyword", T.redact(F.col("value")).alias("redacted"), F.sha2("value", 256).alias("credential_hash"), F.round(T.shannon_entropy(F.col("value")), 6).alias("entropy"))


@query(f"WITH {LINES.format(table='documents')}, {ASSIGNED} SELECT doc_id, line_no, keyword, sha256(value) AS credential_hash FROM assigned")
def generic_assignment_extract(spark: SparkSession, folder: str) -> DataFrame:
    return E.assignments(chunks(_docs(spark, folder))).select("doc_id", "line_no", "keyword", F.sha2("value", 256).alias("credential_hash"))


@query(_located_sql(E.EMAIL))
def email_extract(spark: SparkSession, folder: str) -> DataFrame:
    return E.located(chunks(_docs(spark, folder)), E.EMAIL)


@query(_located_sql(E.IPV4))
def match_offsets(spark: SparkSession, folder: str) -> DataFrame:
    return E.located(chunks(_docs(spark, folder)), E.IPV4)


@query(f"WITH {SEEDED}, m AS (SELECT doc_id, unnest(regexp_extract_all(text, {quoted(E.USERINFO)}, 1)) AS user_name, unnest(regexp_extract_all(text, {quoted(E.USERINFO)}, 2)) AS value FROM seeded) SELECT doc_id, user_name, {REDACTED.format(v='value')} AS redacted, length(value)::INT AS n_chars FROM m")
def url_userinfo_extract(spark: SparkSession, folder: str) -> DataFrame:
    user, value = (F.regexp_extract_all("text", F.lit(E.USERINFO), F.lit(k)) for k in (1, 2))
    rows = _seeded(spark, folder).select("doc_id", F.explode(F.arrays_zip(user.alias("user_name"), value.alias("value"))).alias("m"))
    return rows.select("doc_id", "m.user_name", T.redact(F.col("m.value")).alias("redacted"), F.length("m.value").alias("n_chars"))


@query(f"""WITH {SEEDED}, {LINES.format(table='seeded')}, t AS (SELECT doc_id, line_no, unnest(regexp_extract_all(line, {quoted(E.TOKEN)})) AS value FROM lines WHERE regexp_matches(line, '(?i)token|secret|password|key|bearer'))
SELECT doc_id, line_no, sha256(value) AS credential_hash, round({ENTROPY.format(v='value')}, 6) AS entropy FROM t WHERE round({ENTROPY.format(v='value')}, 6) >= 3.5""")
def entropy_token_lines(spark: SparkSession, folder: str) -> DataFrame:
    return E.entropy_tokens(_seeded(spark, folder), 3.5).select("doc_id", "line_no", F.sha2("value", 256).alias("credential_hash"), "entropy")


SCAN = f"WITH {SEEDED}, {scan_sql(BUILT_IN, 'seeded')}\n"
SCAN_COLUMNS = f"doc_id, detector_id, {REDACTED.format(v='value')} AS redacted, sha256(value) AS credential_hash, line_no, byte_offset"


def _reported(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "detector_id", T.redact(F.col("value")).alias("redacted"), F.sha2("value", 256).alias("credential_hash"), "line_no", "byte_offset")


@query(f"{SCAN} SELECT {SCAN_COLUMNS} FROM matches")
def detector_scan(spark: SparkSession, folder: str) -> DataFrame:
    return _reported(E.scan(_seeded(spark, folder), BUILT_IN))


@query(f"{SCAN} SELECT {SCAN_COLUMNS} FROM matches")
def detector_scan_anchors(spark: SparkSession, folder: str) -> DataFrame:
    return _reported(E.scan(_seeded(spark, folder), BUILT_IN, anchors=True))


RANKS = "CASE detector_id " + " ".join(f"WHEN {quoted(d.id)} THEN {SEVERITIES.index(d.severity)}" for d in BUILT_IN) + " END"
SERVICES = "CASE detector_id " + " ".join(f"WHEN {quoted(d.id)} THEN {quoted(d.service)}" for d in BUILT_IN) + " END"


@query(f"{SCAN} SELECT {SERVICES} AS service, ({RANKS})::INT AS severity_rank, count(*)::BIGINT AS n, count(DISTINCT value)::BIGINT AS n_values FROM matches GROUP BY ROLLUP (1, 2)")
def detector_severity_rollup(spark: SparkSession, folder: str) -> DataFrame:
    found = E.with_detector(E.scan(_seeded(spark, folder), BUILT_IN), BUILT_IN)
    return found.rollup("service", "severity_rank").agg(F.count("*").alias("n"), F.count_distinct("value").alias("n_values"))


@query(f"""WITH d (detector_id, name, service, keywords) AS (VALUES {', '.join(f"({quoted(d.id)}, {quoted(d.name)}, {quoted(d.service)}, {quoted(' '.join(d.keywords))})" for d in BUILT_IN)}),
hit AS (SELECT detector_id FROM d WHERE contains(lower(detector_id || ' ' || name || ' ' || service || ' ' || keywords), 'git')), {SEEDED}
SELECT h.detector_id, count(s.doc_id)::BIGINT AS n_documents FROM hit h LEFT JOIN d USING (detector_id) LEFT JOIN seeded s ON list_has_any([1], list_transform(string_split(d.keywords, ' '), lambda k: CASE WHEN contains(lower(s.text), k) THEN 1 ELSE 0 END)) GROUP BY 1""")
def detector_keyword_search(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold a keyword of the detectors found by a search in the catalogue."""
    hits = search(detector_table(spark), "git").select("detector_id")
    near = E.triggered(_seeded(spark, folder), BUILT_IN).select("detector_id", "doc_id").distinct()
    return hits.join(near, "detector_id", "left").groupBy("detector_id").agg(F.count("doc_id").alias("n_documents"))


@query(f"""{SCAN}, {LINES.format(table='seeded')}, c AS (SELECT doc_id, line_no AS c_line, unnest(regexp_extract_all(line, {quoted(BUILT_IN[0].companions[0].regex)}, 1)) AS companion_value FROM lines),
j AS (SELECT m.*, c_line, companion_value, row_number() OVER (PARTITION BY m.doc_id, line_no, byte_offset ORDER BY abs(line_no - c_line), c_line, companion_value) AS n
  FROM matches m LEFT JOIN c ON m.doc_id = c.doc_id AND abs(line_no - c_line) <= 5 WHERE detector_id = 'aws-access-key')
SELECT doc_id, line_no, sha256(value) AS credential_hash, CASE WHEN companion_value IS NOT NULL THEN 'secret_key' END AS companion, sha256(companion_value) AS companion_hash FROM j WHERE n = 1""")
def companion_range_join(spark: SparkSession, folder: str) -> DataFrame:
    rows, wanted = _seeded(spark, folder), BUILT_IN[:1]
    found = E.companions(E.scan(rows, wanted), rows, wanted)
    return found.select("doc_id", "line_no", F.sha2("value", 256).alias("credential_hash"), "companion", F.sha2("companion_value", 256).alias("companion_hash"))


def _relation_sql(how: str) -> str:
    return f"""{SCAN} SELECT doc_id, line_no, sha256(value) AS credential_hash FROM matches m WHERE detector_id = 'generic-secret' AND {how} EXISTS (SELECT 1 FROM matches o WHERE o.doc_id = m.doc_id AND o.detector_id <> 'generic-secret' AND abs(o.line_no - m.line_no) <= 3)"""


def _relation(spark: SparkSession, folder: str, how: str) -> DataFrame:
    found = E.scan(_seeded(spark, folder), BUILT_IN)
    own, other = found.where("detector_id = 'generic-secret'"), found.where("detector_id <> 'generic-secret'")
    return E.related(own, other, 3, how).select("doc_id", "line_no", F.sha2("value", 256).alias("credential_hash"))


@query(_relation_sql("NOT"))
def relation_subsumes(spark: SparkSession, folder: str) -> DataFrame:
    return _relation(spark, folder, "subsumes")


@query(_relation_sql(""))
def relation_requires(spark: SparkSession, folder: str) -> DataFrame:
    return _relation(spark, folder, "requires")


@query(f"""WITH {SEEDED}, words AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS w FROM seeded),
v AS (SELECT DISTINCT regexp_extract(w, '[A-Za-z0-9_+/=.-]{{8,64}}') AS value FROM words WHERE regexp_matches(w, '[A-Za-z0-9_+/=.-]{{8,64}}'))
SELECT value, round({ENTROPY.format(v='value')}, 6) AS entropy, round({DIVERSITY.format(v='value')}, 6) AS diversity, ({RUN.format(v='value')})::INT AS longest_run, {REDACTED.format(v='value')} AS redacted, sha256(value) AS credential_hash FROM v""")
def value_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Entropy, diversity, longest run, redaction and hash of the first token of every line."""
    rx = "[A-Za-z0-9_+/=.-]{8,64}"
    values = E.lines(_seeded(spark, folder)).where(F.col("line").rlike(rx)).select(F.regexp_extract("line", f"({rx})", 1).alias("value")).distinct()
    v = F.col("value")
    return values.select("value", F.round(T.shannon_entropy(v), 6).alias("entropy"), F.round(T.char_diversity(v), 6).alias("diversity"), T.longest_run(v).alias("longest_run"), T.redact(v).alias("redacted"), F.sha2(v, 256).alias("credential_hash"))


STAGE_SQL = f"""CASE WHEN length(value) < 8 THEN 'below_min_length' WHEN length(value) > 256 THEN 'value_too_long'
 WHEN lower(value) IN ({', '.join(map(quoted, suppress.EMPTY_DIGESTS))}) OR ends_with(value, 'EXAMPLE') OR regexp_matches(value, '(?i)0123456789abcdef|abcdefgh|12345678') THEN 'known_example'
 WHEN {PLACEHOLDER.format(v='value')} THEN 'placeholder'
 WHEN regexp_matches(value, '^[0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{12}}$') THEN 'uuid'
 WHEN regexp_matches(value, '^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}$') THEN 'email'
 WHEN length(value) IN (32, 40, 64, 128) AND regexp_matches(value, '^[0-9a-fA-F]+$') THEN 'hex_digest'
 WHEN regexp_matches(value, '^\\$\\{{?[A-Za-z_]|\\{{\\{{|%\\(|^<[a-z_-]+>$') THEN 'shell_template'
 WHEN regexp_matches(value, '^[a-z][a-z0-9+.-]*://|^\\.{{0,2}}/[A-Za-z0-9_./-]*$') THEN 'url_or_path'
 WHEN regexp_matches(value, '^v?[0-9]+(\\.[0-9]+){{1,3}}$') THEN 'version' WHEN regexp_matches(value, '^[0-9.,_+-]+$') THEN 'numeric'
 WHEN regexp_matches(value, '^[A-Za-z0-9_-]+\\.(json|ya?ml|toml|txt|md|py|js|ts|go|rs|html|css|png)$') THEN 'file_name'
 WHEN regexp_matches(value, '^[A-Za-z_]+(\\.[A-Za-z_]+)+$') THEN 'dotted_identifier' WHEN regexp_matches(value, '^[A-Za-z_]+$') THEN 'identifier_without_digit'
 WHEN regexp_matches(value, '^[a-z]+(-[a-z]+)+$') THEN 'kebab_words' WHEN {DIVERSITY.format(v='value')} < 0.1 THEN 'low_diversity'
 WHEN length(value) >= 10 AND {RUN.format(v='value')} / length(value) > 0.8 THEN 'degenerate_run' WHEN {ENTROPY.format(v='value')} < 2.5 THEN 'entropy_below_floor' END"""
TOKENS = f"WITH {SEEDED}, v AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^ \\n\"]{{4,}}')) AS value FROM seeded)"


@query(f"{TOKENS}, s AS (SELECT DISTINCT value FROM v), t AS (SELECT {STAGE_SQL} AS stage FROM s) SELECT coalesce(stage, 'reported') AS stage, count(*)::BIGINT AS n FROM t GROUP BY 1")
def stage_histogram(spark: SparkSession, folder: str) -> DataFrame:
    """What the ladder says of every distinct token of the texts."""
    values = _seeded(spark, folder).select(F.explode(F.regexp_extract_all("text", F.lit('[^ \n"]{4,}'), F.lit(0))).alias("value")).distinct()
    return values.select(F.coalesce(suppress.stage(F.col("value")), F.lit("reported")).alias("stage")).groupBy("stage").agg(F.count("*").alias("n"))


@query(f"{SEEDED_ASSIGNED} SELECT doc_id, line_no, sha256(value) AS credential_hash, {STAGE_SQL} AS stage FROM assigned")
def suppressed_assignments(spark: SparkSession, folder: str) -> DataFrame:
    return E.assignments(_seeded(spark, folder)).select("doc_id", "line_no", F.sha2("value", 256).alias("credential_hash"), suppress.stage(F.col("value")).alias("stage"))


@query(f"{SEEDED_ASSIGNED} SELECT doc_id, line_no, sha256(value) AS credential_hash FROM assigned WHERE NOT {PLACEHOLDER.format(v='value')}")
def placeholder_filter(spark: SparkSession, folder: str) -> DataFrame:
    return E.assignments(_seeded(spark, folder)).where(~score.is_placeholder(F.col("value"))).select("doc_id", "line_no", F.sha2("value", 256).alias("credential_hash"))


@query(f"""WITH {SEEDED}, p AS (SELECT doc_id, text, strpos(text, 'checksum ') + 8 AS pos FROM seeded WHERE contains(text, 'checksum ')),
q AS (SELECT doc_id, substr(text, greatest(pos + 16 - 15, 1), least(pos + 16, 16)) AS front, substr(text, pos + 16 + 32 + 1, 16) AS behind FROM p)
SELECT doc_id, regexp_matches(front, '[0-9a-fA-F]{{8,}}$') AND regexp_matches(behind, '^[0-9a-fA-F]{{8,}}') AS in_hex FROM q""")
def hex_context(spark: SparkSession, folder: str) -> DataFrame:
    """Whether 32 digits inside a checksum are seen as part of a longer run."""
    rows = _seeded(spark, folder).where(F.contains("text", F.lit("checksum ")))
    start = F.instr("text", "checksum ") + 8 + 16
    return rows.select("doc_id", suppress.hex_context(F.col("text"), start, F.lit(32)).alias("in_hex"))


PATH_SQL = "CASE " + " ".join(f"WHEN regexp_matches(lower(path), {quoted(rx)}) THEN {quoted(name)}" for name, rx in suppress.PATH_CLASSES) + " ELSE 'plain' END"


@query(f"WITH p AS (SELECT regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages) SELECT {PATH_SQL} AS path_class, count(*)::BIGINT AS n FROM p GROUP BY 1")
def path_class(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "pages").select(F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^?#]*)", 1).alias("path"))
    return rows.groupBy(suppress.path_class(F.col("path")).alias("path_class")).agg(F.count("*").alias("n"))


RULES = [{"detector": "entropy-token", "severity_lte": 1}, {"path_starts_with": "src1/", "service": "aws"}, {"path_regex": "/de/f[0-9]\\.txt$"}]


@query(f"WITH {FINDINGS} SELECT doc_id, k, detector_id, path FROM findings WHERE NOT (detector_id = 'entropy-token' AND severity_rank <= 1 OR starts_with(path, 'src1/') AND service = 'aws' OR regexp_matches(path, '/de/f[0-9]\\.txt$'))")
def rule_suppress(spark: SparkSession, folder: str) -> DataFrame:
    return findings(_docs(spark, folder)).where(~suppress.rules(RULES)).select("doc_id", "k", "detector_id", "path")


@query(f"WITH {FINDINGS} SELECT doc_id, k, path FROM findings WHERE NOT (regexp_matches(path, '^src[0-9]/en/[^/]*$') OR regexp_matches(path, '^(?:[^/]+/)*f1[^/]\\.txt$'))")
def glob_allowlist(spark: SparkSession, folder: str) -> DataFrame:
    return findings(_docs(spark, folder)).where(~suppress.allowed(F.col("path"), ["src?/en/*", "**/f1?.txt"])).select("doc_id", "k", "path")


@query(f"""WITH {SEEDED}, {LINES.format(table='seeded')}, l AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS before FROM lines)
SELECT doc_id, line_no, regexp_matches(line, '(?i)(#|//) ?sample only') OR coalesce(regexp_matches(before, '(?i)(#|//) ?sample only'), false) AS ignored FROM l WHERE regexp_matches(line, '(?i)api_key|token|secret')""")
def inline_directive_lag(spark: SparkSession, folder: str) -> DataFrame:
    rows = suppress.with_directive(E.lines(_seeded(spark, folder)))
    return rows.where(F.col("line").rlike("(?i)api_key|token|secret")).select("doc_id", "line_no", "ignored")


@query(f"""WITH {LINES.format(table='documents')}, t AS (SELECT *, coalesce(sum(len(regexp_extract_all(line, '\\.'))) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS inside FROM lines)
SELECT doc_id, count(*) FILTER (WHERE inside)::BIGINT AS n_inside FROM t GROUP BY doc_id""")
def docstring_toggle(spark: SparkSession, folder: str) -> DataFrame:
    """Lines inside, by the parity of markers before them; full stops take the part of quotes, as texts have these."""
    rows = suppress.with_toggle(E.lines(chunks(_docs(spark, folder))), r"\.")
    return rows.groupBy("doc_id").agg(F.count_if("inside").alias("n_inside"))


CONFIDENCE_SQL = f"""least(1.0::DOUBLE, (CASE WHEN e >= 4.5 THEN 0.2::DOUBLE WHEN e >= 3.5 THEN 0.12 WHEN e >= 3.0 THEN 0.05 ELSE 0 END + CASE WHEN starts_with(value, 'AKIA') OR starts_with(value, 'ghp_') THEN 0.35 ELSE 0 END
  + 0.2 + CASE WHEN keyword = 'token' OR keyword = 'secret' THEN 0.1 ELSE 0 END) * CASE WHEN e < 2 AND length(value) > 10 THEN 0.6 ELSE 1 END)"""


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    rows, v = E.assignments(_seeded(spark, folder)), F.col("value")
    signals = {"has_literal_prefix": v.startswith("AKIA") | v.startswith("ghp_"), "has_context_anchor": F.lit(True), "keyword_nearby": F.col("keyword").isin("token", "secret")}
    return rows.withColumn("e", T.shannon_entropy(v)).withColumn("confidence", score.base_confidence(F.col("e"), F.length(v), **signals))


SCORED = f"{SEEDED_ASSIGNED}, e AS (SELECT *, {ENTROPY.format(v='value')} AS e FROM assigned), scored AS (SELECT *, {CONFIDENCE_SQL} AS confidence FROM e)"


@query(f"{SCORED} SELECT doc_id, line_no, sha256(value) AS credential_hash, round(confidence::DOUBLE, 6) AS confidence FROM scored")
def base_confidence(spark: SparkSession, folder: str) -> DataFrame:
    return _scored(spark, folder).select("doc_id", "line_no", F.sha2("value", 256).alias("credential_hash"), F.round("confidence", 6).alias("confidence"))


PENALISED = f"confidence * CASE WHEN {PLACEHOLDER.format(v='value')} THEN 0.05 ELSE 1 END * CASE WHEN {DIVERSITY.format(v='value')} < 0.1 THEN 0.1 ELSE 1 END * CASE WHEN length(value) >= 10 AND {RUN.format(v='value')} / length(value) > 0.8 THEN 0.1 ELSE 1 END"


@query(f"{SCORED} SELECT doc_id, line_no, sha256(value) AS credential_hash, round(({PENALISED})::DOUBLE, 6) AS confidence FROM scored")
def post_match_penalty(spark: SparkSession, folder: str) -> DataFrame:
    return _scored(spark, folder).select("doc_id", "line_no", F.sha2("value", 256).alias("credential_hash"), F.round(score.penalised(F.col("confidence"), F.col("value")), 6).alias("confidence"))


@query(f"""{SCAN}, c AS (SELECT *, 0.4::DOUBLE AS confidence FROM matches), p AS (SELECT *, list_has_any([true], list_transform(['AKIA', 'ghp_', 'xoxb-', 'sk_live_'], lambda x: starts_with(value, x))) AND NOT {PLACEHOLDER.format(v='value')} AND {RUN.format(v='value')} / length(value) <= 0.8 AS known FROM c)
SELECT doc_id, detector_id, sha256(value) AS credential_hash, CASE WHEN known THEN greatest(confidence, 0.8) ELSE confidence END AS confidence FROM p""")
def prefix_floor(spark: SparkSession, folder: str) -> DataFrame:
    found = E.scan(_seeded(spark, folder), BUILT_IN)
    return found.select("doc_id", "detector_id", F.sha2("value", 256).alias("credential_hash"), score.prefix_floor(F.lit(0.4), F.col("value"), ("AKIA", "ghp_", "xoxb-", "sk_live_")).alias("confidence"))


@query(f"""WITH {FINDINGS}, c AS (SELECT *, (['assignment', 'string', 'unknown', 'comment', 'documentation', 'test', 'encrypted'])[(doc_id + k) % 7 + 1] AS context FROM findings),
m AS (SELECT *, confidence * CASE context WHEN 'assignment' THEN 1.0 WHEN 'string' THEN 0.9 WHEN 'comment' THEN 0.4 WHEN 'documentation' THEN 0.3 WHEN 'test' THEN 0.3 WHEN 'encrypted' THEN 0.05 ELSE 0.8 END AS score FROM c)
SELECT context, count(*)::BIGINT AS n, round(avg(score), 6) AS score, count(*) FILTER (WHERE context IN ('documentation', 'test', 'comment') AND score < 0.5 OR context = 'encrypted' AND score < 0.8)::BIGINT AS n_suppressed FROM m GROUP BY context""")
def context_multiplier(spark: SparkSession, folder: str) -> DataFrame:
    names = ("assignment", "string", "unknown", "comment", "documentation", "test", "encrypted")
    rows = findings(_docs(spark, folder)).withColumn("context", F.get(F.array(*map(F.lit, names)), F.pmod(F.col("doc_id") + F.col("k"), F.lit(7)).cast("int")))
    rows = rows.withColumn("score", F.col("confidence") * score.context_multiplier(F.col("context")))
    return rows.groupBy("context").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("score"), F.count_if(score.hard_suppressed(F.col("context"), F.col("score"))).alias("n_suppressed"))


@query(f"""WITH {FINDINGS}, l AS (SELECT detector_id, 1 + count(*) FILTER (WHERE confidence >= 0.5) AS alpha, 1 + count(*) FILTER (WHERE confidence < 0.5) AS beta FROM findings WHERE detector_id <> 'aws-access-key' GROUP BY 1)
SELECT doc_id, k, detector_id, round(confidence * coalesce(CASE WHEN alpha + beta > 2 THEN alpha / (alpha + beta) ELSE 1 END, 1), 6) AS confidence FROM findings LEFT JOIN l USING (detector_id)""")
def calibration_multiplier(spark: SparkSession, folder: str) -> DataFrame:
    rows = findings(_docs(spark, folder))
    counters = rows.where("detector_id <> 'aws-access-key'").groupBy("detector_id").agg((F.count_if(F.col("confidence") >= 0.5) + 1).alias("alpha"), (F.count_if(F.col("confidence") < 0.5) + 1).alias("beta"))
    return score.calibrated(rows, counters).select("doc_id", "k", "detector_id", F.round("confidence", 6).alias("confidence"))


@query(f"""WITH {FINDINGS}, t (reason, tier) AS (VALUES {', '.join(f"('{a}', '{b}')" for a, b in score.EVIDENCE)}),
r AS (SELECT *, CASE WHEN detector_id = 'entropy-token' THEN 'entropy-only' WHEN detector_id = 'generic-secret' THEN 'generic-assignment' WHEN confidence > 0.9 THEN 'checksum-valid' ELSE 'vendor-pattern' END AS reason FROM findings)
SELECT tier, reason, count(*)::BIGINT AS n FROM r JOIN t USING (reason) GROUP BY 1, 2""")
def evidence_tier_join(spark: SparkSession, folder: str) -> DataFrame:
    reason = F.when(F.col("detector_id") == "entropy-token", "entropy-only").when(F.col("detector_id") == "generic-secret", "generic-assignment").when(F.col("confidence") > 0.9, "checksum-valid").otherwise("vendor-pattern")
    tiers = spark.createDataFrame(list(score.EVIDENCE), "reason string, tier string")
    return findings(_docs(spark, folder)).withColumn("reason", reason).join(tiers, "reason").groupBy("tier", "reason").agg(F.count("*").alias("n"))


@query(f"WITH {FINDINGS} SELECT severity_rank AS before, greatest(0, severity_rank - (confidence < 0.5)::INT)::INT AS after, count(*)::BIGINT AS n FROM findings GROUP BY 1, 2")
def severity_downgrade(spark: SparkSession, folder: str) -> DataFrame:
    after = score.lowered(F.col("severity_rank"), F.when(F.col("confidence") < 0.5, 1).otherwise(0))
    return findings(_docs(spark, folder)).groupBy(F.col("severity_rank").alias("before"), after.alias("after")).agg(F.count("*").alias("n"))


@query(f"""WITH {FINDINGS} SELECT path, count(*)::BIGINT AS n, bool_or(list_has_any(string_split(lower(path), '/'), ['de', 'example'])) AS fixture,
 bool_or({' OR '.join(f"contains(lower(path), '{m.lower()}')" for m in score.SENSITIVE)}) AS is_sensitive FROM findings GROUP BY path""")
def path_signals(spark: SparkSession, folder: str) -> DataFrame:
    rows = findings(_docs(spark, folder)).groupBy("path").agg(F.count("*").alias("n"))
    fixture = F.arrays_overlap(F.split(F.lower("path"), "/"), F.array(F.lit("de"), F.lit("example")))
    return rows.select("path", "n", fixture.alias("fixture"), score.sensitive_path(F.col("path")).alias("is_sensitive"))


@query(f"""{SCAN}, a AS (SELECT doc_id, value, list_reduce(list_transform(range(5, 15), lambda k: (strpos('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', substr(value, k, 1)) - 1)::BIGINT), lambda x, y: x * 32 + y) AS acc FROM matches WHERE detector_id = 'aws-access-key')
SELECT doc_id, CASE WHEN regexp_matches(value, '^(AKIA|ASIA)[A-Z2-7]{{16}}$') THEN lpad((((acc >> 2) & 140737488355200) >> 7)::VARCHAR, greatest(12, length((((acc >> 2) & 140737488355200) >> 7)::VARCHAR))::INT, '0') END AS account FROM a""")
def aws_account_decode(spark: SparkSession, folder: str) -> DataFrame:
    found = E.scan(_seeded(spark, folder), BUILT_IN[:1])
    return found.select("doc_id", C.aws_account(F.col("value")).alias("account"))


@query()
def crc32_base62(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens whose last six characters are the CRC-32 of the rest in base 62, and the same with one character changed: the first are valid, the others not."""
    body = F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 30)
    good = F.concat(F.lit("ghp_"), body, C.base62(F.crc32(F.encode(body, "UTF-8")), 6))
    rows = _docs(spark, folder).select("doc_id", F.explode(F.array(F.struct(F.lit(True).alias("made_valid"), good.alias("token")), F.struct(F.lit(False).alias("made_valid"), F.concat(F.left(good, F.lit(39)), F.lit("!")).alias("token")))).alias("t"))
    return rows.select("doc_id", "t.made_valid", C.crc32_base62_valid(F.col("t.token"), "ghp_").alias("valid"))


@query("""SELECT doc_id, 'HS256' AS alg, 'user-' || doc_id AS subject, doc_id * 1000 AS expires, doc_id * 1000 < 500000 AS expired FROM documents""")
def jwt_claims(spark: SparkSession, folder: str) -> DataFrame:
    """Header and claims of tokens made from each document's id, read back from the tokens."""
    url_safe = lambda c: F.rtrim(F.translate(F.base64(F.encode(c, "UTF-8")), "+/", "-_"), F.lit("="))
    claims = F.concat(F.lit('{"sub":"user-'), F.col("doc_id").cast("string"), F.lit('","exp":'), (F.col("doc_id") * 1000).cast("string"), F.lit("}"))
    token = F.concat_ws(".", url_safe(F.lit('{"alg":"HS256","typ":"JWT"}')), url_safe(claims), F.lit("c2ln"))
    rows = _docs(spark, folder).select("doc_id", token.alias("token"))
    header, body = C.jwt_part(F.col("token"), 0), C.jwt_part(F.col("token"), 1)
    expires = F.get_json_object(body, "$.exp").cast("long")
    return rows.select("doc_id", F.get_json_object(header, "$.alg").alias("alg"), F.get_json_object(body, "$.sub").alias("subject"), expires.alias("expires"), (expires < 500000).alias("expired"))


@query("SELECT (props->>'$.k')::BIGINT AS k, count(*)::BIGINT AS n, count(props->>'$.none[0].x')::BIGINT AS n_none FROM events GROUP BY 1")
def json_selector_props(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "events").select(C.json_selector(F.col("props"), "$.k").cast("long").alias("k"), C.json_selector(F.col("props"), "$.none[0].x").alias("none"))
    return rows.groupBy("k").agg(F.count("*").alias("n"), F.count("none").alias("n_none"))


BOGON_SQL = " OR ".join(f"n BETWEEN {(low := sum(int(p) << 8 * (3 - k) for k, p in enumerate(first.split('.'))))} AND {low + (1 << 32 - bits) - 1}" for first, bits in C.RESERVED)


@query(f"""WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, {quoted(E.IPV4)})) AS ip FROM documents), p AS (SELECT *, list_transform(string_split(ip, '.'), lambda x: x::BIGINT) AS b FROM m),
q AS (SELECT *, CASE WHEN list_max(b) <= 255 THEN ((b[1] * 256 + b[2]) * 256 + b[3]) * 256 + b[4] END AS n FROM p)
SELECT doc_id, ip, n AS number, {BOGON_SQL} AS bogon FROM q""")
def bogon_addresses(spark: SparkSession, folder: str) -> DataFrame:
    rows = E.located(chunks(_docs(spark, folder)), E.IPV4).withColumnRenamed("value", "ip")
    return rows.select("doc_id", "ip", C.ipv4_number(F.col("ip")).alias("number"), C.is_bogon(F.col("ip")).alias("bogon"))
