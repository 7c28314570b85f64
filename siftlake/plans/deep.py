"""Queries: decoding of the blobs inside whole texts, places of decoded findings, caps and limits, tokens with structure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.functions import codecs as C
from siftlake.functions import text as T
from siftlake.operators import decode, extract, windows
from siftlake.sources.tables import chunks, read

from . import engine
from .detectors import BUILT_IN
from .registry import query
from .scans import LINES


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "documents")


def _secret() -> Column:
    return F.concat(F.lit("token="), F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 24))


def _with_blob(spark: SparkSession, folder: str, blob: Column, words: int = 4) -> DataFrame:
    """Whole texts with a blob of their own first words in the middle of them: behind the first half of the lines."""
    docs = _docs(spark, folder).withColumn("text", F.coalesce("text", F.lit("")))
    lines = F.split("text", "\n")
    half = (F.size(lines) / 2).cast("int")
    text = F.concat_ws("\n", F.array_join(F.slice(lines, F.lit(1), half), "\n"), F.concat(F.lit("blob "), blob), F.array_join(F.slice(lines, half + 1, F.size(lines)), "\n"))
    return docs.withColumn("text", text)


def _base64(value: Column) -> Column:
    return F.translate(F.base64(F.encode(value, "UTF-8")), "\r\n", "")


HALVED = """halved AS (SELECT doc_id, source, lang, s[1:len(s) // 2] AS a, s[len(s) // 2 + 1:] AS b FROM (SELECT *, string_split(coalesce(text, ''), chr(10)) AS s FROM documents)),
mixed AS (SELECT doc_id, source, lang, array_to_string(a, chr(10)) || chr(10) || 'blob ' || {blob} || chr(10) || array_to_string(b, chr(10)) AS text, len(a) AS above FROM halved)"""
PLAIN = "'token=' || sha256(doc_id::VARCHAR)[1:24]"


@query(f"""WITH {HALVED.format(blob=f"lower(hex(encode({PLAIN})))")}, t AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '(?:[0-9a-fA-F]{{2}}){{8,}}')) AS blob FROM mixed),
d AS (SELECT DISTINCT doc_id, TRY(decode(unhex(blob))) AS said FROM t) SELECT doc_id, sha256(said) AS text_hash FROM d WHERE said <> ''""")
def decode_hex_blobs(spark: SparkSession, folder: str) -> DataFrame:
    """All hexadecimal runs of the whole texts that are UTF-8."""
    rows = decode.decode_through(_with_blob(spark, folder, F.lower(F.hex(F.encode(_secret(), "UTF-8")))), 1, ("hex",))
    return rows.select("doc_id", F.sha2("text", 256).alias("text_hash"))


@query(f"""WITH {HALVED.format(blob=f"to_base64(encode({PLAIN}))")}, t AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9+/_-]{{12,}}={{0,2}}')) AS blob FROM mixed),
n AS (SELECT doc_id, rtrim(translate(blob, '-_', '+/'), '=') AS digits FROM t), d AS (SELECT DISTINCT doc_id, TRY(decode(from_base64(rpad(digits, ((length(digits) + 3) // 4 * 4)::INT, '=')))) AS said FROM n)
SELECT doc_id, sha256(said) AS text_hash FROM d WHERE said LIKE 'token=%'""")
def decode_base64_blobs(spark: SparkSession, folder: str) -> DataFrame:
    """All base64 runs of the whole texts that say an assignment."""
    rows = decode.decode_through(_with_blob(spark, folder, _base64(_secret())), 1, ("base64",))
    return rows.where("text LIKE 'token=%'").select("doc_id", F.sha2("text", 256).alias("text_hash"))


@query(f"""WITH {HALVED.format(blob=f"replace({PLAIN}, '=', '%3D')")}, t AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._~%-]*%[0-9A-Fa-f]{{2}}[A-Za-z0-9._~%-]*')) AS blob FROM mixed)
SELECT doc_id, sha256(url_decode(blob)) AS text_hash FROM t WHERE NOT regexp_matches(blob, '%([^0-9A-Fa-f]|.[^0-9A-Fa-f]|.?$)')""")
def decode_url_blobs(spark: SparkSession, folder: str) -> DataFrame:
    """All per cent escapes of the whole texts."""
    rows = decode.decode_through(_with_blob(spark, folder, F.replace(_secret(), F.lit("="), F.lit("%3D"))), 1, ("url",))
    return rows.select("doc_id", F.sha2("text", 256).alias("text_hash"))


@query(f"""WITH {HALVED.format(blob="reverse('ghp_' || sha256(doc_id::VARCHAR)[1:36])")}, t AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_-]{{16,}}')) AS blob FROM mixed)
SELECT doc_id, sha256(reverse(blob)) AS text_hash FROM t WHERE contains(reverse(blob), 'ghp_') AND reverse(blob) <> blob""")
def decode_reverse_blobs(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of the whole texts that hold a known prefix backwards."""
    blob = F.reverse(F.concat(F.lit("ghp_"), F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 36)))
    rows = decode.decode_through(_with_blob(spark, folder, blob), 1, {"reverse": decode.for_prefixes(("ghp_",))["reverse"]})
    return rows.select("doc_id", F.sha2("text", 256).alias("text_hash"))


CAESAR = "translate('ghp_' || sha256(doc_id::VARCHAR)[1:36], 'abcdefghijklmnopqrstuvwxyz', substr('abcdefghijklmnopqrstuvwxyzabcdefghijklmnopqrstuvwxyz', (doc_id % 25 + 2)::INT, 26))"


@query("SELECT doc_id, sha256('ghp_' || sha256(doc_id::VARCHAR)[1:36]) AS text_hash FROM documents")
def decode_caesar_blobs(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of the whole texts that hold a known prefix shifted by some letters, turned back."""
    token = F.concat(F.lit("ghp_"), F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 36))
    blob = F.coalesce(*(F.when(F.col("doc_id") % 25 + 1 == s, C.caesar(token, s)) for s in range(1, 26)))
    rows = decode.decode_through(_with_blob(spark, folder, blob), 1, {"caesar": decode.for_prefixes(("ghp_",))["caesar"]})
    return rows.where("text LIKE 'ghp@_%' ESCAPE '@'").select("doc_id", F.sha2("text", 256).alias("text_hash"))


@query("SELECT doc_id, ['quoted-printable', 'html-numeric-entity', 'octal-escape', 'unicode-escape', 'base32', 'javascript-static'][(doc_id % 6 + 1)::INT] AS via, sha256('token=' || sha256(doc_id::VARCHAR)[1:24]) AS text_hash FROM documents")
def decode_other_blobs(spark: SparkSession, folder: str) -> DataFrame:
    """Assignments in the middle of the texts in six further codes, by document: each is read by its own decoder among all."""
    codes = F.transform(F.regexp_extract_all(F.hex(F.encode(_secret(), "UTF-8")), F.lit(".."), F.lit(0)), lambda x: x)
    number = lambda x, base: F.conv(x, 16, base)
    join = lambda f: F.array_join(F.transform(codes, f), "")
    digits = F.lpad(F.array_join(F.transform(codes, lambda x: F.lpad(number(x, 2), 8, "0")), ""), 240, "0")
    base32 = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(47)), lambda k: F.substring(F.lit(C.BASE32), F.conv(F.substring(digits, k * 5 + 1, F.lit(5)), 2, 10).cast("int") + 1, F.lit(1))), "")
    made = (
        join(lambda x: F.concat(F.lit("="), x)),
        join(lambda x: F.concat(F.lit("&#"), number(x, 10), F.lit(";"))),
        join(lambda x: F.concat(F.lit("\\"), F.lpad(number(x, 8), 3, "0"))),
        join(lambda x: F.concat(F.lit("\\u00"), x)),
        base32,
        F.concat(F.lit("atob('"), F.reverse(_base64(_secret())), F.lit("'.split('').reverse().join(''))")),
    )
    blob = F.get(F.array(*made), F.pmod(F.col("doc_id"), F.lit(6)).cast("int"))
    names = ("quoted-printable", "html-numeric-entity", "octal-escape", "unicode-escape", "base32", "javascript-static")
    rows = decode.decode_through(_with_blob(spark, folder, blob), 1, names).where("text LIKE 'token=%'")
    return rows.select("doc_id", "via", F.sha2("text", 256).alias("text_hash"))


@query(f"""WITH {HALVED.format(blob="to_base64(encode('x ghp_' || sha256(doc_id::VARCHAR)[1:36] || ' y'))")}
SELECT doc_id, greatest(above, 1) + 1 AS line_no, sha256('ghp_' || sha256(doc_id::VARCHAR)[1:36]) AS credential_hash, 'base64' AS via FROM mixed""")
def splice_places(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens that stand in base64 in the middle of the texts: found in the decoded text, at the blob's own line."""
    token = F.concat(F.lit("x ghp_"), F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 36), F.lit(" y"))
    inner = decode.splice_through(chunks(_with_blob(spark, folder, _base64(token))), 1, ("base64", "hex"))
    found = extract.scan(inner, BUILT_IN[1:2], context=True, keep=("via", "span")).where((F.col("at") < F.col("span.end")) & (F.col("at") >= F.col("span.start")))
    return found.select("doc_id", "line_no", F.sha2("value", 256).alias("credential_hash"), "via").distinct()


@query("""WITH w AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z0-9_-]{16,}'))) AS blob FROM documents), d AS (SELECT DISTINCT doc_id, reverse(blob) AS said FROM w WHERE reverse(blob) <> blob),
r AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY said) AS rn, sum(length(said)) OVER (PARTITION BY doc_id ORDER BY said ROWS UNBOUNDED PRECEDING) AS total FROM d)
SELECT doc_id, count(*)::BIGINT AS n_children, count(*) FILTER (WHERE NOT (rn <= 5 AND total <= 110))::BIGINT AS n_cut FROM r GROUP BY 1""")
def decode_caps(spark: SparkSession, folder: str) -> DataFrame:
    """Decoded chunks of the texts, and how many of each document a report with caps leaves out."""
    rows = decode.decode_through(_docs(spark, folder), 1, ("reverse",))
    _, cut = decode.admitted(rows, 5, 110)
    counts = rows.groupBy("doc_id").agg(F.count("*").alias("n_children"))
    return counts.join(cut, "doc_id", "left").select("doc_id", "n_children", F.coalesce("n_cut", F.lit(0)).alias("n_cut"))


@query("SELECT doc_id, 'not_decoded' AS reason, length(text)::BIGINT AS n_chars FROM documents WHERE length(text) > 3000")
def decode_limit(spark: SparkSession, folder: str) -> DataFrame:
    return decode.within_decode_limit(chunks(_docs(spark, folder)), 3000)[1].select("doc_id", "reason", "n_chars")


GOES_ON_SQL = windows.GOES_ON.replace("*+", "*").replace("?+", "?").replace("'", "''")


@query(f"""WITH s AS (SELECT doc_id, sha256(doc_id::VARCHAR)[1:24] AS v, coalesce(text, '') AS text FROM documents),
m AS (SELECT doc_id, text || chr(10) || 'api_token = "' || v[1:8] || (CASE WHEN doc_id % 2 = 0 THEN '" +' || chr(10) || '  "' ELSE chr(92) || chr(10) END) || v[9:16] || (CASE WHEN doc_id % 2 = 0 THEN '" +' || chr(10) || '  "' ELSE chr(92) || chr(10) END) || v[17:24] || '"' AS text FROM s),
j AS (SELECT doc_id, string_split(regexp_replace(text, '{GOES_ON_SQL}', chr(64976), 'g'), chr(10)) AS lines FROM m),
l AS (SELECT doc_id, unnest(range(1, len(lines) + 1)) AS k, unnest(lines) AS line FROM j),
n AS (SELECT *, length(line) - length(replace(line, chr(64976), '')) AS more, k + coalesce(sum(length(line) - length(replace(line, chr(64976), ''))) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line_no FROM l)
SELECT doc_id, line_no::BIGINT AS line_no, (more + 1)::BIGINT AS n_lines, sha256(replace(line, chr(64976), '')) AS line_hash FROM n WHERE more > 0""")
def multiline_values(spark: SparkSession, folder: str) -> DataFrame:
    """All values of the texts that go on over several lines, and one behind each text that goes on over three, by a plus or a backslash."""
    value = lambda a: F.substring(F.sha2(F.col("doc_id").cast("string"), 256), a, 8)
    plus = F.concat(F.lit('\napi_token = "'), value(1), F.lit('" +\n  "'), value(9), F.lit('" +\n  "'), value(17), F.lit('"'))
    back = F.concat(F.lit('\napi_token = "'), value(1), F.lit("\\\n"), value(9), F.lit("\\\n"), value(17), F.lit('"'))
    rows = chunks(_docs(spark, folder)).withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 2 == 0, plus).otherwise(back)))
    return windows.continuations(rows, "doc_id").select("doc_id", "line_no", "n_lines", F.sha2("line", 256).alias("line_hash"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'none' WHEN event_id % 3 = 1 THEN 'known' ELSE 'unknown' END AS algorithm, epoch(ts) < 1767225600 AS expired, 'event:' || length(event_type) || ',exp:' || length(epoch(ts)::BIGINT::VARCHAR) || ',sub:' || length(user_id::VARCHAR) AS claims FROM events""")
def jwt_analysis(spark: SparkSession, folder: str) -> DataFrame:
    """Events as claims of JSON web tokens: algorithm, expiry, and claims by the length of their values."""
    alg = F.get(F.array(*map(F.lit, ("none", "HS256", "XX1"))), F.pmod(F.col("event_id"), F.lit(3)).cast("int"))
    part = lambda s: F.rtrim(F.translate(_base64(F.to_json(s)), "+/", "-_"), F.lit("="))
    claims = F.struct(F.col("user_id").cast("string").alias("sub"), F.unix_timestamp("ts").alias("exp"), F.col("event_type").alias("event"))
    token = F.concat_ws(".", part(F.struct(alg.alias("alg"), F.lit("JWT").alias("typ"))), part(claims), F.lit("c2ln"))
    rows = read(spark, folder, "events").select("event_id", C.jwt_findings(token, F.lit(1767225600)).alias("f"))
    return rows.select("event_id", "f.algorithm", "f.expired", "f.claims")


@query("""SELECT doc_id, length(coalesce(text, ''))::BIGINT AS size, sha256(coalesce(text, '')) AS oid FROM documents WHERE doc_id % 2 = 0""")
def lfs_pointers(spark: SparkSession, folder: str) -> DataFrame:
    """Every other text as a pointer of Git LFS, found among the others as they are."""
    body = F.coalesce("text", F.lit(""))
    pointer = F.concat(F.lit("version https://git-lfs.github.com/spec/v1\noid sha256:"), F.sha2(body, 256), F.lit("\nsize "), F.length(body).cast("string"), F.lit("\n"))
    rows = _docs(spark, folder).select("doc_id", C.git_lfs_pointer(F.when(F.col("doc_id") % 2 == 0, pointer).otherwise(body)).alias("p"))
    return rows.where("p IS NOT NULL").select("doc_id", "p.size", "p.oid")


@query(r"""SELECT page_id, upper(left('c:', 1)) || ':/' || replace(url, '\', '/') AS path FROM pages""")
def plain_paths(spark: SparkSession, folder: str) -> DataFrame:
    r"""Addresses as Windows paths with a verbatim prefix, written plainly."""
    path = F.concat(F.lit("\\\\?\\c:\\"), F.replace(F.col("url"), F.lit("/"), F.lit("\\")))
    return read(spark, folder, "pages").select("page_id", C.plain_path(path).alias("path"))


@query("""WITH h AS (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) AS host FROM pages) SELECT page_id, CASE WHEN page_id % 4 = 0 THEN true WHEN host = '' THEN NULL ELSE NOT regexp_matches(host, '[.:]') OR regexp_matches(host, '\\.(localhost|local|internal|lan|home\\.arpa)$') END AS private FROM pages JOIN h USING (page_id)""")
def private_urls(spark: SparkSession, folder: str) -> DataFrame:
    """Which addresses lead to this machine or network; every fourth is made to by its host."""
    hosts = F.get(F.array(*map(F.lit, ("http://localhost:80/", "http://[fd00::1]/", "http://10.2.3.4/x", "http://[::1]:8/"))), F.pmod(F.floor(F.col("page_id") / 4), F.lit(4)).cast("int"))
    url = F.when(F.col("page_id") % 4 == 0, hosts).otherwise(F.col("url"))
    return read(spark, folder, "pages").select("page_id", C.is_private_url(url).alias("private"))


@query(f"""WITH {LINES.format(table='documents')}, w AS (SELECT DISTINCT unnest(regexp_extract_all(line, '[^ ]+')) AS value FROM lines), b AS (SELECT value, list_transform(range(1, len(hex(encode(value))) // 2 + 1), lambda i: ('0x' || hex(encode(value))[2 * i - 1 : 2 * i])::BIGINT) AS bytes FROM w)
SELECT sha256(value) AS value_hash, list_reduce(list_prepend(2166136261::BIGINT, bytes), lambda a, x: ((xor(a, x)::HUGEINT * 16777619) % 4294967296)::BIGINT) AS fnv FROM b""")
def fnv_values(spark: SparkSession, folder: str) -> DataFrame:
    """FNV-1a hashes of the words of the texts."""
    words = extract.lines(chunks(_docs(spark, folder))).select(F.explode(F.regexp_extract_all("line", F.lit("[^ ]+"), F.lit(0))).alias("value")).distinct()
    return words.select(F.sha2("value", 256).alias("value_hash"), C.fnv1a_32(F.col("value")).alias("fnv"))


@query()
def scan_depth2(spark: SparkSession, folder: str) -> DataFrame:
    """The whole scan under the deep preset, over tokens that stand in hexadecimal digits inside base64."""
    token = F.concat(F.lit("x ghp_"), F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 36), F.lit(" y"))
    blob = _base64(F.concat(F.lit("in "), F.lower(F.hex(F.encode(token, "UTF-8")))))
    found = engine.full_scan(chunks(_with_blob(spark, folder, blob)), BUILT_IN[1:2], policy="deep").where("channel = 'decoded'")
    return found.select("doc_id", "line_no", "credential_hash", "channel", T.redact(F.col("redacted")).alias("redacted"))
