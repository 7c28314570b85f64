"""Queries: sources, decoding, windows, findings together, reports, verification, statistics and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.functions import text as T
from siftlake.operators import decode, extract, report, resolve, score, stats, verify, windows
from siftlake.sources import files
from siftlake.sources.tables import CHUNKS, FINDINGS, SEEDED, chunks, findings, read, seeded_chunks
from siftlake.storage import stored
from siftlake.streaming import events as S

from .registry import query
from .scans import LINES, quoted


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "documents")


def _found(spark: SparkSession, folder: str) -> DataFrame:
    return findings(_docs(spark, folder))


# Findings together.


@query(f"WITH {FINDINGS} SELECT detector_id, count(*)::BIGINT AS n, count(DISTINCT credential_hash)::BIGINT AS n_values FROM findings GROUP BY 1")
def dedup_none(spark: SparkSession, folder: str) -> DataFrame:
    return resolve.dedup(_found(spark, folder), "none").groupBy("detector_id").agg(F.count("*").alias("n"), F.count_distinct("credential_hash").alias("n_values"))


def _dedup_sql(keys: str, path: str) -> str:
    return f"""WITH {FINDINGS}, r AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY "offset", path, line) AS rn FROM findings)
SELECT {keys}, {path} max(line) FILTER (WHERE rn = 1) AS line, min("offset") AS "offset", count(*)::BIGINT AS n_matches, (count(DISTINCT (path, line)) - 1)::BIGINT AS n_additional, max(confidence) AS confidence FROM r GROUP BY {keys}"""


@query(_dedup_sql("detector_id, credential_hash, path", ""))
def dedup_file(spark: SparkSession, folder: str) -> DataFrame:
    return resolve.dedup(_found(spark, folder), "file")


@query(_dedup_sql("detector_id, credential_hash", "max(path) FILTER (WHERE rn = 1) AS path,"))
def dedup_credential(spark: SparkSession, folder: str) -> DataFrame:
    return resolve.dedup(_found(spark, folder), "credential")


@query(f"""WITH {FINDINGS}, r AS (SELECT *, row_number() OVER (PARTITION BY credential_hash, path ORDER BY starts_with(detector_id, 'entropy'), confidence DESC, severity_rank DESC, detector_id, "offset", doc_id) AS rn FROM findings)
SELECT credential_hash, path, max(detector_id) FILTER (WHERE rn = 1) AS detector_id, max(confidence) FILTER (WHERE rn = 1) AS confidence, max(severity_rank) FILTER (WHERE rn = 1) AS severity_rank, max(line) FILTER (WHERE rn = 1) AS line,
 coalesce(string_agg(DISTINCT detector_id, ',' ORDER BY detector_id) FILTER (WHERE rn > 1), '') AS losers FROM r GROUP BY 1, 2""")
def cross_detector_winner(spark: SparkSession, folder: str) -> DataFrame:
    return resolve.winners(_found(spark, folder))


@query(f"""WITH {FINDINGS}, s AS (SELECT path, line AS "start", line + 20 AS "end", count(*) AS n FROM findings GROUP BY ALL), o AS (SELECT *, max("end") OVER (PARTITION BY path ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
i AS (SELECT *, sum(CASE WHEN reach >= "start" THEN 0 ELSE 1 END) OVER (PARTITION BY path ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS island FROM o)
SELECT path, min("start") AS "start", max("end") AS "end", sum(n)::BIGINT AS n_spans FROM i GROUP BY path, island""")
def span_coalesce(spark: SparkSession, folder: str) -> DataFrame:
    return resolve.coalesced(_found(spark, folder).select("path", F.col("line").alias("start"), (F.col("line") + 20).alias("end")), "path")


@query(f"""WITH {FINDINGS} SELECT credential_hash, count(DISTINCT path)::BIGINT AS n_paths, CASE WHEN min(service) = max(service) THEN min(service) ELSE 'multiple' END AS service, max(severity_rank) AS severity_rank, least(1.0::DOUBLE, max(confidence) + 0.15::DOUBLE) AS confidence
FROM findings GROUP BY 1 HAVING count(DISTINCT path) >= 2""")
def value_reuse(spark: SparkSession, folder: str) -> DataFrame:
    return resolve.value_reuse(_found(spark, folder))


@query(f"""WITH {FINDINGS}, p AS (SELECT *, path || '/' || doc_id::VARCHAR || '/' || detector_id AS deep FROM findings), f AS (SELECT *, regexp_replace(deep, '/[^/]*$', '') AS folder FROM p WHERE detector_id IN ('aws-access-key', 'slack-bot-token')),
g AS (SELECT folder, list(DISTINCT deep) FILTER (WHERE detector_id = 'aws-access-key') AS a, list(DISTINCT deep) FILTER (WHERE detector_id = 'slack-bot-token') AS b, max(confidence) AS best FROM f GROUP BY 1)
SELECT 'composite:aws-access-key+slack-bot-token@' || folder AS composite_id, a[1] AS first_path, b[1] AS second_path, least(1.0::DOUBLE, best + 0.3::DOUBLE) AS confidence FROM g WHERE len(a) = 1 AND len(b) = 1 AND a[1] <> b[1]""")
def composite_correlation(spark: SparkSession, folder: str) -> DataFrame:
    rows = _found(spark, folder).withColumn("path", F.concat_ws("/", "path", F.col("doc_id").cast("string"), "detector_id"))
    return resolve.composites(rows, ("aws-access-key", "slack-bot-token"))


@query(f"""WITH {FINDINGS}, p AS (SELECT *, path || '/' || (doc_id % 50) || '/' || doc_id AS deep FROM findings),
f AS (SELECT 'keys' AS policy, regexp_replace(deep, '/[^/]*$', '') AS place, detector_id, credential_hash, confidence FROM p UNION ALL SELECT 'login', deep, detector_id, credential_hash, confidence FROM p),
g AS (SELECT policy, place, max(confidence) FILTER (WHERE detector_id IN ('aws-access-key', 'generic-secret') OR (policy = 'keys' AND detector_id = 'slack-bot-token')) AS best, count(DISTINCT credential_hash) FILTER (WHERE detector_id = 'aws-access-key') AS a,
 count(DISTINCT credential_hash) FILTER (WHERE detector_id = 'slack-bot-token') AS s, count(DISTINCT credential_hash) FILTER (WHERE detector_id = 'generic-secret') AS g FROM f GROUP BY 1, 2)
SELECT policy, place, (CASE WHEN policy = 'keys' AND g = 1 THEN 7 ELSE 3 END)::INT AS mask, round(least(1.0::DOUBLE, best + CASE WHEN policy = 'login' THEN 0.1::DOUBLE WHEN g = 1 THEN 0.35::DOUBLE ELSE 0.3::DOUBLE END), 6) AS confidence
FROM g WHERE a = 1 AND CASE policy WHEN 'keys' THEN s = 1 ELSE g = 1 END""")
def composite_policies(spark: SparkSession, folder: str) -> DataFrame:
    """Keys with a token of the same folder and, if there is one, its password; and keys with a password of the same file. Places with two values for a part are silent."""
    rows = _found(spark, folder).withColumn("path", F.concat_ws("/", "path", (F.col("doc_id") % 50).cast("string"), F.col("doc_id").cast("string")))
    policies = (resolve.Composite("keys", ("aws-access-key", "slack-bot-token"), ("generic-secret",)), resolve.Composite("login", ("aws-access-key", "generic-secret"), scope="file", bonus=0.1))
    return resolve.correlated(rows, policies).select("policy", "place", "mask", F.round("confidence", 6).alias("confidence"))


BEFORE = "findings WHERE doc_id % 5 <> 0 AND (doc_id + k) % 7 <> 0"
AFTER = "findings WHERE (doc_id * 3 + k) % 4 <> 0"


def _halves(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rows = _found(spark, folder).withColumn("credential_hash", F.sha2(F.concat_ws(":", "doc_id", (F.col("k") % 2).cast("string")), 256))
    return rows.where("doc_id % 5 <> 0 AND (doc_id + k) % 7 <> 0"), rows.where("(doc_id * 3 + k) % 4 <> 0")


HALVES = f"WITH {FINDINGS.replace('findings AS', 'plain AS')}, findings AS (SELECT * REPLACE (sha256(doc_id::VARCHAR || ':' || (k % 2)::VARCHAR) AS credential_hash) FROM plain), b AS (SELECT * FROM {BEFORE}), a AS (SELECT * FROM {AFTER})"


@query(f"{HALVES} SELECT doc_id, k, detector_id FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.detector_id = a.detector_id AND b.credential_hash = a.credential_hash)")
def baseline_anti(spark: SparkSession, folder: str) -> DataFrame:
    before, after = _halves(spark, folder)
    return resolve.not_in_baseline(after, before).select("doc_id", "k", "detector_id")


@query(f"""{HALVES} SELECT detector_id, credential_hash, CASE WHEN NOT coalesce(o, false) THEN 'new' WHEN NOT coalesce(n, false) THEN 'removed' ELSE 'unchanged' END AS state
FROM (SELECT DISTINCT detector_id, credential_hash, true AS o FROM b) FULL JOIN (SELECT DISTINCT detector_id, credential_hash, true AS n FROM a) USING (detector_id, credential_hash)""")
def baseline_diff_full_outer(spark: SparkSession, folder: str) -> DataFrame:
    return resolve.diff(*_halves(spark, folder))


@query(f"WITH {CHUNKS}, s AS (SELECT path, sha256(text) AS h FROM chunks WHERE doc_id % 3 <> 1 UNION ALL SELECT path, sha256(text || 'x') FROM chunks WHERE doc_id % 3 = 1) SELECT doc_id, path, sha256(text) AS content_hash FROM chunks c WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.path = c.path AND s.h = sha256(c.text))")
def incremental_anti(spark: SparkSession, folder: str) -> DataFrame:
    """A third of the documents changed since they were last seen."""
    rows = chunks(_docs(spark, folder))
    old = F.when(F.col("doc_id") % 3 == 1, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    seen = rows.select("path", "base_offset", F.sha2(old, 256).alias("content_hash"), F.lit("v1").alias("spec_hash"))
    return resolve.changed(rows, seen, "v1").select("doc_id", "path", "content_hash")


@query(f"""WITH {FINDINGS}, {LINES.format(table='documents')}, t AS (SELECT doc_id, line_no AS t_line, unnest(regexp_extract_all(line, {quoted(extract.IPV4 + '|' + extract.EMAIL)})) AS target FROM lines),
j AS (SELECT f.doc_id, k, target, abs(line - t_line) AS distance, confidence, row_number() OVER (PARTITION BY f.doc_id, k ORDER BY abs(line - t_line), t_line, target) AS rn FROM findings f JOIN t ON t.doc_id = f.doc_id WHERE sha256(target) NOT IN (SELECT credential_hash FROM findings))
SELECT doc_id, k, target, CASE WHEN distance = 0 THEN 'same_line' ELSE 'same_file' END AS relation, distance, round(confidence * pow(0.85, least(4, distance // 25)), 6) AS confidence FROM j WHERE rn = 1""")
def access_target_nearest(spark: SparkSession, folder: str) -> DataFrame:
    rows = extract.lines(chunks(_docs(spark, folder)))
    targets = rows.select("doc_id", F.col("line_no").alias("line"), F.explode(F.regexp_extract_all("line", F.lit(extract.IPV4 + "|" + extract.EMAIL), F.lit(0))).alias("target"))
    found = stored(_found(spark, folder), "findings")  # hashes, no values; it is read twice
    return resolve.nearest_targets(found, targets).withColumn("confidence", F.round("confidence", 6))


@query(f"""WITH {FINDINGS}, u AS (SELECT detector_id, credential_hash, line, 0 AS src FROM findings WHERE k = 0 UNION ALL SELECT detector_id, credential_hash, line, 1 FROM findings WHERE k > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY detector_id, credential_hash ORDER BY src, line) AS rn FROM u) SELECT detector_id, credential_hash, line, src = 1 AS decoded FROM r WHERE rn = 1""")
def union_unique(spark: SparkSession, folder: str) -> DataFrame:
    rows = _found(spark, folder)
    pick = ["detector_id", "credential_hash", "line"]
    return resolve.union_unique(rows.where("k = 0").select(*pick), rows.where("k > 0").select(*pick), "detector_id", "credential_hash")


@query(f"""WITH {FINDINGS}, l AS (SELECT *, lag(line) OVER (PARTITION BY path, detector_id, credential_hash ORDER BY line, "offset", doc_id) AS before FROM findings)
SELECT path, detector_id, credential_hash, line FROM l WHERE before IS NULL OR line - before > 50""")
def near_window_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """One finding for each run of the same value whose lines are at most 50 apart."""
    return resolve.near_once(_found(spark, folder), 50).select("path", "detector_id", "credential_hash", "line")


# Decoding.

def _plain() -> F.Column:
    return F.concat(F.lit("token="), F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 24))


def _behind(line: F.Column) -> F.Column:
    return F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), line)


def _encoded(spark: SparkSession, folder: str, how: str) -> DataFrame:
    """Each document's text, and behind it a line with an encoded assignment made from its id."""
    plain = _plain()
    value = {"base64": F.base64(F.encode(plain, "UTF-8")), "hex": F.lower(F.hex(F.encode(plain, "UTF-8"))), "url": F.replace(plain, F.lit("="), F.lit("%3D")), "reverse": F.reverse(F.concat(F.lit("ghp_"), F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 36)))}
    twice = F.translate(F.base64(F.encode(F.concat(F.lit("inner "), value["hex"]), "UTF-8")), "\r\n", "")
    return _docs(spark, folder).select("doc_id", _behind(F.concat(F.lit("blob: "), twice if how == "twice" else value[how])).alias("text"))


def _assigned(rows: DataFrame) -> DataFrame:
    """Hash of the assigned value in decoded texts."""
    value = F.regexp_extract("text", extract.ASSIGNMENT, 2)
    return rows.where(F.col("text").rlike(extract.ASSIGNMENT)).select("doc_id", "depth", "via", F.sha2(value, 256).alias("credential_hash"))


@query("SELECT doc_id, 1 AS depth, 'base64' AS via, sha256(sha256(doc_id::VARCHAR)[1:24]) AS credential_hash FROM documents")
def decode_base64(spark: SparkSession, folder: str) -> DataFrame:
    return _assigned(decode.decode_through(_encoded(spark, folder, "base64"), 1, ("base64",)))


@query("SELECT doc_id, 1 AS depth, 'hex' AS via, sha256(sha256(doc_id::VARCHAR)[1:24]) AS credential_hash FROM documents")
def decode_hex(spark: SparkSession, folder: str) -> DataFrame:
    return _assigned(decode.decode_through(_encoded(spark, folder, "hex"), 1, ("hex",)))


@query("SELECT doc_id, 1 AS depth, 'url' AS via, sha256(sha256(doc_id::VARCHAR)[1:24]) AS credential_hash FROM documents")
def decode_url(spark: SparkSession, folder: str) -> DataFrame:
    return _assigned(decode.decode_through(_encoded(spark, folder, "url"), 1, ("url",)))


@query("SELECT doc_id, sha256('ghp_' || sha256(doc_id::VARCHAR)[1:36]) AS credential_hash FROM documents")
def decode_reverse(spark: SparkSession, folder: str) -> DataFrame:
    rows = decode.decode_through(_encoded(spark, folder, "reverse"), 1, ("reverse",)).where(F.col("text").startswith("ghp_"))
    return rows.select("doc_id", F.sha2("text", 256).alias("credential_hash"))


@query("SELECT doc_id, 2 AS depth, 'base64/hex' AS via, sha256(sha256(doc_id::VARCHAR)[1:24]) AS credential_hash FROM documents")
def decode_depth2(spark: SparkSession, folder: str) -> DataFrame:
    return _assigned(decode.decode_through(_encoded(spark, folder, "twice"), 2, ("base64", "hex")))


@query("SELECT doc_id, (doc_id % 25 + 1)::INT AS shift, 'ghp_' AS prefix FROM documents")
def decode_caesar(spark: SparkSession, folder: str) -> DataFrame:
    """Each document's text, and behind it a prefix shifted by a number of letters that depends on the document."""
    from siftlake.functions.codecs import caesar

    shifted = F.coalesce(*(F.when(F.col("doc_id") % 25 + 1 == s, caesar(F.lit("=ghp_"), s)) for s in range(1, 26)))
    return decode.caesar_hits(_docs(spark, folder).select("doc_id", _behind(shifted).alias("text")), ("ghp_",))


@query("SELECT doc_id, sha256(text) AS text_hash FROM documents")
def decode_json_escape(spark: SparkSession, folder: str) -> DataFrame:
    """Texts written as JSON strings, and read back."""
    from siftlake.functions.codecs import decode_json_escapes

    body = F.regexp_extract(F.to_json(F.struct(F.col("text").alias("v"))), r'(?s)^\{"v":"(.*)"\}$', 1)
    return _docs(spark, folder).select("doc_id", F.sha2(decode_json_escapes(body), 256).alias("text_hash"))


@query("SELECT doc_id, sha256(text) AS text_hash, 'inflated' AS state FROM documents")
def decode_gzip_base64(spark: SparkSession, folder: str) -> DataFrame:
    """Texts packed by gzip, and inflated again."""
    import pandas as pd

    def squeeze(frames):
        import zlib

        for frame in frames:
            out = []
            for text in frame["text"]:
                worker = zlib.compressobj(6, zlib.DEFLATED, 31)
                out.append(worker.compress(text.encode()) + worker.flush())
            yield pd.DataFrame({"doc_id": frame["doc_id"], "payload": out})

    packed = _docs(spark, folder).select("doc_id", "text").mapInPandas(squeeze, "doc_id long, payload binary")
    return decode.inflate(packed).select("doc_id", F.sha2("text", 256).alias("text_hash"), "state")


# Windows, seams, chains, diffs and fragments.


@query("""WITH w AS (SELECT doc_id, text, unnest(range(0, greatest(0, ceil((length(text) - 1000) / 900.0))::BIGINT + 1)) AS window_no FROM documents)
SELECT doc_id, window_no::INT AS window_no, octet_length(encode(left(text, (window_no * 900)::INT)))::BIGINT AS base_offset, (length(left(text, (window_no * 900)::INT)) - length(replace(left(text, (window_no * 900)::INT), chr(10), '')))::BIGINT AS base_line, sha256(substr(text, window_no * 900 + 1, 1000)) AS text_hash FROM w""")
def window_ranges(spark: SparkSession, folder: str) -> DataFrame:
    rows = windows.windowed(chunks(_docs(spark, folder)), 1000, 100)
    return rows.select("doc_id", "window_no", "base_offset", "base_line", F.sha2("text", 256).alias("text_hash"))


@query("""WITH w AS (SELECT doc_id, text, unnest(range(0, greatest(0, ceil((length(text) - 500) / 500.0))::BIGINT + 1)) AS n FROM documents), c AS (SELECT doc_id, n, substr(text, n * 500 + 1, 500) AS t FROM w), l AS (SELECT *, lead(t) OVER (PARTITION BY doc_id ORDER BY n) AS nx FROM c)
SELECT doc_id, n::INT AS window_no, sha256(right(t, 40) || left(nx, 40)) AS seam_hash FROM l WHERE nx IS NOT NULL""")
def chunk_seam_lead(spark: SparkSession, folder: str) -> DataFrame:
    rows = windows.seams(windows.windowed(chunks(_docs(spark, folder)), 500, 0), 40)
    return rows.select("doc_id", "window_no", F.sha2("seam", 256).alias("seam_hash"))


@query(f"""WITH {LINES.format(table='documents')}, b AS (SELECT *, CASE WHEN coalesce(regexp_matches(lag(line) OVER (PARTITION BY doc_id ORDER BY line_no), 'e\\.$'), false) THEN 0 ELSE 1 END AS begins FROM lines),
c AS (SELECT *, sum(begins) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS chain FROM b)
SELECT doc_id, min(line_no) AS line_no, count(*)::BIGINT AS n_lines, sha256(string_agg(line, '' ORDER BY line_no)) AS line_hash FROM c GROUP BY doc_id, chain""")
def multiline_islands(spark: SparkSession, folder: str) -> DataFrame:
    rows = windows.continued(extract.lines(chunks(_docs(spark, folder))), r"e\.$")
    return rows.select("doc_id", "line_no", "n_lines", F.sha2("line", 256).alias("line_hash"))


@query(f"""WITH {LINES.format(table='documents')} SELECT doc_id, 'src/f' || doc_id || '.txt' AS path, (CASE WHEN line_no <= 3 THEN 10 + line_no - 1 ELSE 200 + line_no - 4 END)::BIGINT AS new_line, sha256(line) AS line_hash FROM lines WHERE line_no % 2 = 1""")
def diff_hunk_forward_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Each text as a unified diff of two hunks, every other line added; the added ones with their places in the new file."""
    rows = extract.lines(chunks(_docs(spark, folder)))
    body = rows.select("doc_id", (F.col("line_no") * 10).alias("line_no"), F.concat(F.when(F.col("line_no") % 2 == 1, "+").otherwise(" "), "line").alias("line"))
    heads = _docs(spark, folder).select("doc_id", F.explode(F.array(F.struct(F.lit(1).cast("long").alias("line_no"), F.concat(F.lit("+++ b/src/f"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("line")), F.struct(F.lit(2).cast("long").alias("line_no"), F.lit("@@ -1,3 +10,3 @@").alias("line")), F.struct(F.lit(35).cast("long").alias("line_no"), F.lit("@@ -90,9 +200,9 @@").alias("line")))).alias("h")).select("doc_id", "h.*")
    return windows.added_lines(body.unionByName(heads)).select("doc_id", "path", F.col("new_line").cast("long").alias("new_line"), F.sha2("line", 256).alias("line_hash"))


@query(f"""WITH {FINDINGS}, g AS (SELECT DISTINCT path || '#' || doc_id AS path, detector_id AS prefix, line, left(credential_hash, 6) AS value FROM findings), r AS (SELECT *, row_number() OVER (PARTITION BY path, prefix ORDER BY line DESC, value DESC) AS rn FROM g), t AS (SELECT * FROM r)
SELECT a.path, a.prefix, a.line, b.line AS line_b, a.value || b.value AS joined FROM t a JOIN t b ON a.path = b.path AND a.prefix = b.prefix AND (a.line <> b.line OR a.value <> b.value) AND abs(a.line - b.line) < 100""")
def fragment_self_join(spark: SparkSession, folder: str) -> DataFrame:
    path = F.concat("path", F.lit("#"), F.col("doc_id").cast("string")).alias("path")
    rows = _found(spark, folder).select(path, F.col("detector_id").alias("prefix"), "line", F.left("credential_hash", F.lit(6)).alias("value"))
    return windows.joined_fragments(rows)


@query(f"""WITH {LINES.format(table='documents')} SELECT doc_id, line_no, sha256(string_agg(line, chr(10)) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) AS context_hash FROM lines""")
def context_window(spark: SparkSession, folder: str) -> DataFrame:
    rows = windows.surrounding(extract.lines(chunks(_docs(spark, folder))), 2)
    return rows.select("doc_id", "line_no", F.sha2("context", 256).alias("context_hash"))


@query("""WITH h AS (SELECT doc_id, text, unnest(range(0, 3)) AS n FROM documents), s AS (SELECT doc_id, n * 100 AS "start", n * 100 + 60 + doc_id % 80 AS "end" FROM h), g AS (SELECT doc_id, unnest(range(0, 4)) AS seg_no FROM documents)
SELECT s.doc_id, s."start"::BIGINT AS "start", s."end"::BIGINT AS "end", seg_no FROM s JOIN g ON g.doc_id = s.doc_id AND s."start" >= seg_no * 120 AND s."end" <= seg_no * 120 + 120""")
def segment_attribution(spark: SparkSession, folder: str) -> DataFrame:
    ids = _docs(spark, folder).select("doc_id")
    hits = ids.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(2)))).select("doc_id", (F.col("n") * 100).cast("long").alias("start"), (F.col("n") * 100 + 60 + F.col("doc_id") % 80).alias("end"))
    segments = ids.withColumn("seg_no", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long")))).select("doc_id", "seg_no", (F.col("seg_no") * 120).alias("seg_start"), (F.col("seg_no") * 120 + 120).alias("seg_end"))
    return extract.attributed(hits, segments).select("doc_id", "start", "end", "seg_no")


# Sources.


@query("""WITH a AS (SELECT page_id, unnest(list_transform(regexp_extract_all(html, '(?is)<script[^>]*>(.*?)</script>', 1), lambda t: {'kind': 'script', 't': t}) || list_transform(regexp_extract_all(html, '(?:href|src|content)="([^"]*)"', 1), lambda t: {'kind': 'attribute', 't': t})) AS c FROM pages)
SELECT page_id, c.kind AS kind, count(*)::BIGINT AS n, sum(length(c.t))::BIGINT AS n_chars FROM a WHERE c.t <> '' GROUP BY 1, 2""")
def page_parts(spark: SparkSession, folder: str) -> DataFrame:
    return files.page_parts(read(spark, folder, "pages")).groupBy("page_id", "kind").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"))


@query(r"""SELECT page_id, regexp_replace(regexp_replace(url, '^([A-Za-z][A-Za-z0-9+.-]*://)[^/?#@]*@', '\1'), '([?&][^=&#]*)=[^&#]*', '\1=***', 'g') AS url FROM pages""")
def redact_urls(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "pages").select("page_id", files.redact_url(F.col("url")).alias("url"))


@query("SELECT page_id AS doc_id, 0 AS entry, 'request' AS side, url, sha256(url) AS text_hash FROM pages UNION ALL SELECT page_id, 0, 'response', url, sha256(html) FROM pages")
def har_bodies(spark: SparkSession, folder: str) -> DataFrame:
    """Pages as HTTP captures in JSON, and their bodies read back."""
    entry = F.struct(F.struct("url", F.col("url").alias("body")).alias("request"), F.struct(F.lit(200).alias("status"), F.col("html").alias("body")).alias("response"))
    captures = read(spark, folder, "pages").select(F.col("page_id").alias("doc_id"), F.to_json(F.struct(F.struct(F.array(entry).alias("entries")).alias("log"))).alias("har"))
    return files.har_bodies(captures).select("doc_id", "entry", "side", "url", F.sha2("text", 256).alias("text_hash"))


@query(rf"""WITH {SEEDED}, {LINES.format(table='seeded')}, rx AS (SELECT doc_id, line_no, regexp_extract(line, {quoted(files.ENV)}, ['key', 'a', 'b', 'c']) AS m FROM lines WHERE regexp_matches(line, {quoted(files.ENV)}))
SELECT doc_id, line_no, m.key AS key, sha256(m.a || m.b || m.c) AS value_hash FROM rx""")
def env_pairs(spark: SparkSession, folder: str) -> DataFrame:
    rows = files.env_pairs(extract.lines(seeded_chunks(_docs(spark, folder))))
    return rows.select("doc_id", "line_no", "key", F.sha2("value", 256).alias("value_hash"))


@query("SELECT doc_id, len(regexp_extract_all(html, '[ -~]{6,}'))::INT AS n_runs FROM (SELECT page_id AS doc_id, regexp_replace(html, '[^ -~]', chr(1), 'g') AS html FROM pages)")
def binary_strings(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "pages").select(F.col("page_id").alias("doc_id"), F.size(files.printable_runs(F.encode("html", "UTF-8"))).alias("n_runs"))


@query("""WITH k AS (SELECT doc_id, (['gzip', 'zip', 'pdf', 'elf', 'png', NULL])[doc_id % 6 + 1] AS kind FROM documents) SELECT kind, count(*)::BIGINT AS n FROM k GROUP BY 1""")
def magic_sniff(spark: SparkSession, folder: str) -> DataFrame:
    """Texts behind the first bytes of six kinds of file."""
    heads = F.get(F.array(*map(F.lit, ("1F8B", "504B0304", "25504446", "7F454C46", "89504E47", "41"))), F.pmod("doc_id", F.lit(6)).cast("int"))
    rows = _docs(spark, folder).select(F.concat(F.unhex(heads), F.encode(F.concat(F.lit("."), F.coalesce("text", F.lit(""))), "UTF-8")).alias("content"))
    return rows.groupBy(files.magic(F.col("content")).alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT 'read' AS kind, count(*)::BIGINT AS n, coalesce(sum(length(text)), 0)::BIGINT AS n_chars FROM documents WHERE length(text) <= 2000 UNION ALL SELECT 'too_large', count(*), coalesce(sum(length(text)), 0)::BIGINT FROM documents WHERE length(text) > 2000")
def source_limits(spark: SparkSession, folder: str) -> DataFrame:
    kept, gaps = files.within_limits(chunks(_docs(spark, folder)), 2000)
    summary = lambda df, kind, n: df.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"), F.coalesce(F.sum(n), F.lit(0)).alias("n_chars"))
    return summary(kept, "read", F.length("text").cast("long")).unionByName(summary(gaps, "too_large", F.col("n_chars")))


@query("""SELECT coalesce(CASE WHEN regexp_matches(lower(url), '\\.(png|jpg|lock)$') THEN 'extension' WHEN list_contains(string_split(url, '/'), 'fr') THEN 'folder' END, 'read') AS reason, count(*)::BIGINT AS n FROM (SELECT url || CASE WHEN page_id % 4 = 0 THEN '.PNG' ELSE '' END AS url FROM pages) GROUP BY 1""")
def exclude_predicates(spark: SparkSession, folder: str) -> DataFrame:
    """Page addresses as paths: every fourth ends as an image, and ``fr`` folders count as vendored."""
    path = F.regexp_replace(F.concat("url", F.when(F.col("page_id") % 4 == 0, ".PNG").otherwise("")), "/fr(/|$)", "/vendor$1")
    return read(spark, folder, "pages").groupBy(F.coalesce(files.skipped(path), F.lit("read")).alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT conv_id, turn, role, 'conversation/' || role AS source_type, sha256(text) AS text_hash FROM conversations WHERE text <> ''")
def conversation_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "conversations").where("text <> ''").select("conv_id", "turn", "role", F.concat(F.lit("conversation/"), "role").alias("source_type"), F.sha2("text", 256).alias("text_hash"))


# Reports and verification.


@query(f"""WITH {FINDINGS} SELECT doc_id, k, '{{"detector_id":"' || detector_id || '","service":"' || service || '","severity_rank":' || severity_rank || ',"path":"' || path || '","line":' || line || ',"credential_hash":"' || credential_hash || '"}}' AS json FROM findings""")
def report_jsonl(spark: SparkSession, folder: str) -> DataFrame:
    return report.jsonl(_found(spark, folder))


@query(f"WITH {FINDINGS} SELECT doc_id, k, detector_id || ',' || service || ',' || severity_rank || ',' || path || ',' || line || ',' || credential_hash AS csv FROM findings")
def report_csv(spark: SparkSession, folder: str) -> DataFrame:
    return report.csv(_found(spark, folder))


@query(f"""WITH {FINDINGS} SELECT doc_id, k, '{{"ruleId":"' || detector_id || '","level":"' || (['note', 'note', 'note', 'warning', 'error', 'error'])[severity_rank + 1] || '","message":{{"text":"Possible ' || service || ' credential"}},"locations":[{{"physicalLocation":{{"artifactLocation":{{"uri":"' || replace(path, '/', '%2F') || '"}},"region":{{"startLine":' || line || '}}}}}}],"partialFingerprints":{{"credential/v1":"' || credential_hash || '"}}}}' AS result FROM findings""")
def report_sarif(spark: SparkSession, folder: str) -> DataFrame:
    return report.sarif_results(_found(spark, folder))


@query(f"""WITH {FINDINGS} SELECT doc_id, k, '{{"id":"' || sha256(detector_id || ':' || credential_hash || ':' || path) || '","category":"secret_detection","severity":"' || (['Info', 'Info', 'Low', 'Medium', 'High', 'Critical'])[severity_rank + 1] || '","location":{{"file":"' || path || '","start_line":' || line || '}}}}' AS vulnerability FROM findings""")
def report_gitlab(spark: SparkSession, folder: str) -> DataFrame:
    return report.gitlab(_found(spark, folder))


@query(f"WITH {FINDINGS} SELECT doc_id, k, '::' || (['notice', 'notice', 'notice', 'warning', 'error', 'error'])[severity_rank + 1] || ' file=' || path || ',line=' || line || '::' || detector_id AS annotation FROM findings")
def report_annotations(spark: SparkSession, folder: str) -> DataFrame:
    return report.annotations(_found(spark, folder))


@query(f"""WITH {FINDINGS} SELECT doc_id, k, '<testcase classname="' || detector_id || '" name="' || path || ':' || line || '"><failure message="rank ' || severity_rank || '"/></testcase>' AS testcase FROM findings""")
def report_junit(spark: SparkSession, folder: str) -> DataFrame:
    return report.junit(_found(spark, folder))


@query(f"WITH {FINDINGS} SELECT detector_id, '{{\"schema_version\":\"1.0\",\"detector\":\"' || detector_id || '\",\"n\":' || count(*) || ',\"hashes\":[' || string_agg(DISTINCT '\"' || credential_hash || '\"', ',' ORDER BY '\"' || credential_hash || '\"') || ']}}' AS envelope FROM findings GROUP BY 1")
def report_envelope(spark: SparkSession, folder: str) -> DataFrame:
    return report.envelope(_found(spark, folder))


@query("SELECT 'too_large' AS reason, count(*)::BIGINT AS n, 'partial' AS status FROM documents WHERE length(text) > 2000 HAVING count(*) > 0")
def scan_status(spark: SparkSession, folder: str) -> DataFrame:
    return report.status(files.within_limits(chunks(_docs(spark, folder)), 2000)[1])


@query(f"WITH {FINDINGS} SELECT path, CASE WHEN bool_or(severity_rank >= 5) THEN 10 WHEN bool_or(confidence < 0.05) THEN 13 WHEN bool_or(severity_rank >= 2) THEN 1 ELSE 0 END AS exit_code FROM findings GROUP BY 1")
def exit_codes(spark: SparkSession, folder: str) -> DataFrame:
    kinds = F.array_compact(F.array(F.lit("clean"), F.when(F.col("severity_rank") >= 5, "live_found"), F.when(F.col("confidence") < 0.05, "coverage_failed"), F.when(F.col("severity_rank") >= 2, "found")))
    return report.exit_code(_found(spark, folder).select("path", F.explode(kinds).alias("kind")), "path")


@query(f"""WITH {FINDINGS}, r AS (SELECT *, (CASE WHEN (doc_id + k) % 11 = 0 THEN 429 WHEN (doc_id + k) % 7 = 0 THEN 500 WHEN (doc_id + k) % 3 = 0 THEN 401 ELSE 200 END) AS status, (CASE WHEN doc_id % 5 = 0 THEN 'key was revoked' WHEN doc_id % 4 = 0 THEN 'invalid key' ELSE 'ok' END) AS body FROM findings)
SELECT CASE WHEN status = 429 THEN 'rate_limited' WHEN status >= 500 THEN 'error' WHEN contains(body, 'revoked') THEN 'revoked' WHEN status = 200 AND NOT contains(body, 'invalid') THEN 'live' WHEN status IN (401, 403) OR contains(body, 'invalid') THEN 'dead' ELSE 'unverifiable' END AS outcome, count(*)::BIGINT AS n FROM r GROUP BY 1""")
def verify_recorded(spark: SparkSession, folder: str) -> DataFrame:
    x = F.col("doc_id") + F.col("k")
    status = F.when(x % 11 == 0, 429).when(x % 7 == 0, 500).when(x % 3 == 0, 401).otherwise(200)
    body = F.when(F.col("doc_id") % 5 == 0, "key was revoked").when(F.col("doc_id") % 4 == 0, "invalid key").otherwise("ok")
    rows = _found(spark, folder).withColumn("status", status).withColumn("body", body)
    return rows.groupBy(verify.outcome(F.col("status"), F.col("body")).alias("outcome")).agg(F.count("*").alias("n"))


@query("WITH h AS (SELECT page_id, regexp_extract(url, '://([^/?#:]*)', 1) AS host FROM pages) SELECT page_id, host, host = 'example.com' OR ends_with(host, '.example.com') OR host = 'example.org' OR ends_with(host, '.example.org') AS allowed FROM h")
def domain_allowlist(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "pages").select("page_id", F.regexp_extract("url", "://([^/?#:]*)", 1).alias("host"))
    return rows.withColumn("allowed", verify.allowed_host(F.col("host"), ("example.com", "example.org")))


# Statistics and truth.


@query("""WITH j AS (SELECT source, quality = 1 AS truth, length(text) > 1000 AS found FROM documents JOIN labels USING (doc_id)), c AS (SELECT source, count(*) FILTER (WHERE truth AND found)::BIGINT AS tp, count(*) FILTER (WHERE NOT truth AND found)::BIGINT AS fp, count(*) FILTER (WHERE truth AND NOT found)::BIGINT AS fn FROM j GROUP BY 1),
p AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM c)
SELECT source, tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM p""")
def score_prf_by_category(spark: SparkSession, folder: str) -> DataFrame:
    """How well length tells quality, for each source: the metrics of any finder against labels."""
    rows = _docs(spark, folder).join(read(spark, folder, "labels"), "doc_id").select("source", (F.col("quality") == 1).alias("truth"), (F.length("text") > 1000).alias("found"))
    found = stats.precision_recall(rows, "source")
    return found.select("source", "tp", "fp", "fn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query("WITH m AS (SELECT event_type, median(value) AS med FROM events GROUP BY 1) SELECT event_type, round(med, 6) AS median, round(median(abs(value - med)), 6) AS mad, count(*)::BIGINT AS n FROM events JOIN m USING (event_type) GROUP BY 1, 2")
def robust_median_mad(spark: SparkSession, folder: str) -> DataFrame:
    found = stats.median_and_spread(read(spark, folder, "events"), "value", "event_type")
    return found.select("event_type", F.round("median", 6).alias("median"), F.round("mad", 6).alias("mad"), "n")


@query("WITH r AS (SELECT l_returnflag, l_extendedprice / l_quantity AS x FROM lineitem), s AS (SELECT l_returnflag, count(*)::BIGINT AS n, avg(x) AS mean, stddev_samp(x) AS sd FROM r GROUP BY 1) SELECT l_returnflag, n, round(mean, 4) AS mean, round(mean - 1.96 * sd / sqrt(n), 4) AS low, round(mean + 1.96 * sd / sqrt(n), 4) AS high FROM s")
def paired_ratio_ci(spark: SparkSession, folder: str) -> DataFrame:
    found = stats.paired_ratio(read(spark, folder, "lineitem"), "l_extendedprice", "l_quantity", "l_returnflag")
    return found.select("l_returnflag", "n", *(F.round(c, 4).alias(c) for c in ("mean", "low", "high")))


@query(f"""WITH {FINDINGS}, b AS (SELECT detector_id, least(19, floor(confidence * 20))::BIGINT AS bin, confidence > 0.3 AS truth FROM findings), c AS (SELECT detector_id, bin, count(*) FILTER (WHERE truth) AS good, count(*) AS n FROM b GROUP BY 1, 2),
s AS (SELECT *, sum(good) OVER w / sum(n) OVER w AS share FROM c WINDOW w AS (PARTITION BY detector_id ORDER BY bin DESC ROWS UNBOUNDED PRECEDING)) SELECT detector_id, min(bin) / 20 AS floor FROM s WHERE share >= 0.9 GROUP BY 1""")
def floor_recommendation(spark: SparkSession, folder: str) -> DataFrame:
    rows = _found(spark, folder).select("detector_id", "confidence", (F.col("confidence") > 0.3).alias("truth"))
    return stats.floor_by_detector(rows)


@query("""WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents), p AS (SELECT w[i : i + 1] AS pair FROM (SELECT w, unnest(range(1, length(w))) AS i FROM w)), c AS (SELECT pair, count(*) + 1 AS n FROM p GROUP BY 1)
SELECT pair, round(ln(n / sum(n) OVER (PARTITION BY pair[1])), 6) AS log_p FROM c""")
def bigram_model(spark: SparkSession, folder: str) -> DataFrame:
    """Log probabilities of letter pairs over all texts, for the randomness of tokens."""
    rows = _docs(spark, folder).select(F.col("text").alias("word"))
    return score.bigram_model(rows).select("pair", F.round("log_p", 6).alias("log_p"))


@query("SELECT source, lang, count(*)::BIGINT AS n FROM documents GROUP BY ROLLUP (source, lang)")
def coverage_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return stats.events_counts(_docs(spark, folder), "source", "lang")


@query("SELECT doc_id, translate(text, 'аеорсух', 'aeopcyx') = text AS plain, length(text)::INT AS n_chars FROM documents")
def homoglyph_fold(spark: SparkSession, folder: str) -> DataFrame:
    folded = T.strip_invisible(T.fold_confusables(F.col("text")))
    return _docs(spark, folder).select("doc_id", (folded == F.col("text")).alias("plain"), F.length(folded).alias("n_chars"))


# Streams.


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def events_tumbling(spark: SparkSession, folder: str) -> DataFrame:
    return S.run(S.tumbling(S.event_stream(spark, folder)), "tumbling")


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM g)
SELECT user_id, min(ts) AS start, count(*)::BIGINT AS n FROM s GROUP BY user_id, no""")
def events_session(spark: SparkSession, folder: str) -> DataFrame:
    return S.run(S.sessions(S.event_stream(spark, folder)), "sessions")


@query("SELECT DISTINCT user_id, event_type FROM events")
def events_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """All events are there at once, so the watermark has forgotten none."""
    return S.run(S.first_seen(S.event_stream(spark, folder)), "first-seen", "append").select("user_id", "event_type")


@query("""WITH e AS (SELECT user_id % 8 AS root, '/u/' || user_id AS path, CASE WHEN event_type IN ('view', 'purchase') THEN 'modify' WHEN event_type = 'error' THEN 'remove' ELSE 'create' END AS kind, event_id AS seq, time_bucket(INTERVAL 10 MINUTE, ts) AS start FROM events),
l AS (SELECT root, path, start, list(kind ORDER BY seq) AS kinds FROM e GROUP BY 1, 2, 3)
SELECT root, path, start, list_reduce(kinds, lambda a, b: CASE WHEN a = 'remove' AND b IN ('create', 'modify') OR a = 'create' AND b = 'modify' THEN 'create' ELSE b END) AS kind, len(kinds)::INT AS n_events FROM l""")
def guard_coalesce(spark: SparkSession, folder: str) -> DataFrame:
    return S.run(S.coalesced(S.change_events(S.event_stream(spark, folder))), "coalesced")


@query("SELECT user_id % 8 AS root, CASE WHEN count(*) > 8192 THEN 'degraded' ELSE 'dirty' END AS state, count(*)::BIGINT AS n_seen, max(event_id) AS last_seq FROM events GROUP BY 1")
def guard_roots(spark: SparkSession, folder: str) -> DataFrame:
    return S.run(S.root_states(S.change_events(S.event_stream(spark, folder))), "roots", "update")
