"""Queries: further sources, structured files, statistics, report documents, verification steps and change logs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.operators import documents, extract, stats, verify
from siftlake.sources import packages, structured
from siftlake.sources.tables import FINDINGS, chunks, findings, read
from siftlake.streaming import events as S

from .registry import query
from .scans import LINES


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "documents")


def _found(spark: SparkSession, folder: str) -> DataFrame:
    return findings(_docs(spark, folder))


# Sources.


@query("SELECT 'documents' AS source, count(*)::BIGINT AS n, sum(length(text))::BIGINT AS n_chars FROM documents UNION ALL SELECT 'pages', count(*), sum(length(html))::BIGINT FROM pages UNION ALL SELECT 'conversations', count(*), sum(length(text))::BIGINT FROM conversations UNION ALL SELECT 'events', count(*), sum(length(props))::BIGINT FROM events")
def source_factory(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of all tables, read by their sources' names."""
    out = None
    for name in ("documents", "pages", "conversations", "events"):
        rows = packages.source(name)(spark, folder).agg(F.lit(name).alias("source"), F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("SELECT doc_id, sha1(encode('blob ' || octet_length(encode(coalesce(text, '')))) || unhex('00') || encode(coalesce(text, ''))) AS blob_id FROM documents")
def git_blob_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return packages.git_blobs(chunks(_docs(spark, folder))).select("doc_id", "blob_id")


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'added' ELSE 'modified' END AS change FROM documents WHERE doc_id % 5 = 0 OR doc_id % 3 = 0")
def staged_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Texts against a manifest from before every third was changed and every fifth was added."""
    rows = chunks(_docs(spark, folder))
    old = packages.git_blobs(rows.where("doc_id % 5 <> 0").withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit("x"))).otherwise(F.col("text"))))
    return packages.staged(packages.git_blobs(rows), old.select("path", "blob_id")).select("doc_id", "change")


@query("""WITH RECURSIVE m AS (SELECT source AS package, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents),
e AS (SELECT a.package, a.doc_id AS a, b.doc_id AS b FROM m a JOIN m b ON a.package = b.package AND b.n // 2 = a.n WHERE a.doc_id % 7 <> 3),
r AS (SELECT package, doc_id FROM m WHERE n = 1 UNION SELECT e.package, e.b FROM r JOIN e ON e.a = r.doc_id)
SELECT m.doc_id, CASE WHEN n = 1 THEN 'root' WHEN r.doc_id IS NOT NULL THEN 'referenced' ELSE 'orphaned' END AS role FROM m LEFT JOIN r ON r.doc_id = m.doc_id WHERE m.package IS NOT NULL""")
def tex_package_roles(spark: SparkSession, folder: str) -> DataFrame:
    """Sources as TeX packages: the first text of each is the root, and the n-th includes the 2n-th and the one behind it, some of them in a comment only."""
    from pyspark.sql import Window

    rows = _docs(spark, folder).where("source IS NOT NULL").withColumn("n", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")))
    parts = rows.select("source", F.floor(F.col("n") / 2).alias("n"), F.concat(F.lit("\\input{f"), F.col("doc_id").cast("string"), F.lit("}")).alias("x")).groupBy("source", "n").agg(F.concat_ws("", F.collect_list("x")).alias("included"))
    rows = rows.join(parts, ["source", "n"], "left")
    line = F.concat(F.when(F.col("doc_id") % 7 == 3, "\n% ").otherwise("\n"), F.coalesce("included", F.lit("")))
    clean = F.translate(F.coalesce("text", F.lit("")), "\\%", "  ")
    text = F.concat(F.when(F.col("n") == 1, "\\documentclass{article}\n").otherwise(""), clean, line)
    members = rows.select(F.col("source").alias("package"), F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(".tex")).alias("name"), text.alias("text"))
    roles = packages.tex_roles(members)
    return roles.select(F.regexp_extract("name", "[0-9]+", 0).cast("long").alias("doc_id"), "role")


@query("""WITH RECURSIVE h AS (SELECT max(o_orderkey) AS c FROM orders), r AS (SELECT c FROM h UNION SELECT o_orderkey // 2 FROM r JOIN orders ON o_orderkey = r.c WHERE o_orderkey > 1)
SELECT o_orderkey AS tag, o_orderkey IN (SELECT c FROM r) AS reachable FROM orders""")
def tag_reachability(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as commits, whose parent has half their number, and as tags: which of them the last commit's history holds."""
    orders = read(spark, folder, "orders").select(F.col("o_orderkey").cast("long").alias("commit"))
    commits = orders.withColumn("parent", F.when(F.col("commit") > 1, F.floor(F.col("commit") / 2)))
    head = orders.agg(F.max("commit").alias("commit"))
    tags = orders.select(F.col("commit").alias("tag"), F.col("commit").alias("target"), F.lit("release").alias("message"))
    return packages.tag_messages(tags, commits, head).select("tag", "reachable")


@query("""WITH RECURSIVE n AS (SELECT o_orderkey AS c, row_number() OVER (ORDER BY o_orderkey) AS k FROM orders), t AS (SELECT 3 * count(*) // 4 AS k FROM n),
r AS (SELECT n.c, n.k FROM n, t WHERE n.k = t.k UNION ALL SELECT n.c, n.k FROM r JOIN n ON n.k = r.k - 1 WHERE r.k > 1 AND r.k % 1000 <> 0)
SELECT c AS tag, c IN (SELECT c FROM r) AS reachable FROM n""")
def tag_line(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as commits of one line, each on the one before, cut at every thousandth; which of them the history of a head at three quarters holds."""
    from siftlake.streaming.composed import numbered

    orders = numbered(read(spark, folder, "orders").select(F.col("o_orderkey").cast("long").alias("commit")), "commit")
    before = orders.select(F.col("commit").alias("parent"), (F.col("number") + 1).alias("number"))
    commits = orders.join(before, "number", "left").select("commit", F.when((F.col("number") % 1000) != 0, F.col("parent")).alias("parent"))
    head = orders.where(F.col("number") == orders.count() * 3 // 4).select("commit")
    tags = orders.select(F.col("commit").alias("tag"), F.col("commit").alias("target"), F.lit("release").alias("message"))
    return packages.tag_messages(tags, commits, head).select("tag", "reachable")


@query(f"""WITH {LINES.format(table='documents')} SELECT doc_id, 0 AS cell, 'code' AS kind, line_no::INT AS line_no, sha256(line) AS line_hash FROM lines UNION ALL SELECT doc_id, 1, 'output', 1, sha256(coalesce(lang, '')) FROM documents""")
def notebook_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Texts as notebooks of one cell of code and one with an output."""
    code = F.struct(F.lit("code").alias("cell_type"), F.transform(F.split("text", "\n"), lambda x: F.concat(x, F.lit("\n"))).alias("source"))
    shown = F.struct(F.lit("code").alias("cell_type"), F.array().cast("array<string>").alias("source"), F.array(F.struct(F.array(F.coalesce("lang", F.lit(""))).alias("text"))).alias("outputs"))
    book = F.concat(F.lit('{"nbformat":4,"cells":['), F.to_json(code), F.lit(","), F.to_json(shown), F.lit("]}"))
    rows = structured.notebook_lines(_docs(spark, folder).where("text IS NOT NULL").select("doc_id", book.alias("text")))
    return rows.select("doc_id", "cell", "kind", "line_no", F.sha2("line", 256).alias("line_hash"))


@query("SELECT doc_id, 'db.main.password' AS key, sha256(coalesce(text, '')) AS value_hash FROM documents UNION ALL SELECT doc_id, 'output.lang', sha256(coalesce(lang, '')) FROM documents")
def terraform_state_values(spark: SparkSession, folder: str) -> DataFrame:
    """Texts as an attribute, and languages as an output, of Terraform state files."""
    resource = F.struct(F.lit("db").alias("type"), F.lit("main").alias("name"), F.array(F.struct(F.struct(F.coalesce("text", F.lit("")).alias("password")).alias("attributes"))).alias("instances"))
    outputs = F.struct(F.struct(F.coalesce("lang", F.lit("")).alias("value"), F.lit(True).alias("sensitive")).alias("lang"))
    rows = structured.terraform_state(_docs(spark, folder).select("doc_id", F.to_json(F.struct(F.lit(4).alias("version"), F.array(resource).alias("resources"), outputs.alias("outputs"))).alias("text")))
    return rows.select("doc_id", "key", F.sha2("value", 256).alias("value_hash"))


FIRST = "coalesce(regexp_extract(text, '[A-Za-z]+'), '')"


@query(f"""WITH w AS (SELECT doc_id, {FIRST} || 'x' AS w FROM documents) SELECT doc_id, 4::BIGINT AS line_no, 'DB_WORD' AS key, w AS value FROM w UNION ALL SELECT doc_id, 5, 'NUM', doc_id::VARCHAR FROM w UNION ALL SELECT doc_id, 9, 'OTHER', w FROM w""")
def compose_values(spark: SparkSession, folder: str) -> DataFrame:
    """Compose files around each text's first word, with its variables in a list and in a map."""
    w, n = F.concat(F.regexp_extract(F.coalesce("text", F.lit("")), "[A-Za-z]+", 0), F.lit("x")), F.col("doc_id").cast("string")
    text = F.concat(F.lit("services:\n  db:\n    environment:\n      - DB_WORD="), w, F.lit("\n      - NUM="), n, F.lit("\n    image: pg\n  web:\n    environment: # of the web\n      OTHER: '"), w, F.lit("'\n    ports: x\nPLAIN: y"))
    rows = _docs(spark, folder).select("doc_id", text.alias("text"), F.lit(0).cast("long").alias("base_line"))
    return structured.compose_environment(extract.lines(rows))


@query(f"SELECT doc_id, 5::BIGINT AS line_no, 'word' AS key, {FIRST} || 'x' AS value FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 7, 'plain', {FIRST} || 'x' FROM documents WHERE doc_id % 2 = 0")
def kubernetes_values(spark: SparkSession, folder: str) -> DataFrame:
    """Manifests around each text's first word; every other is a secret, the others are configurations."""
    w = F.concat(F.regexp_extract(F.coalesce("text", F.lit("")), "[A-Za-z]+", 0), F.lit("x"))
    kind = F.when(F.col("doc_id") % 2 == 0, "Secret").otherwise("ConfigMap")
    text = F.concat(F.lit("apiVersion: v1\nkind: "), kind, F.lit("\nmetadata:\ndata:\n  word: "), F.translate(F.base64(F.encode(w, "UTF-8")), "\r\n", ""), F.lit("\nstringData:\n  plain: "), w)
    rows = _docs(spark, folder).select("doc_id", text.alias("text"), F.lit(0).cast("long").alias("base_line"))
    return structured.kubernetes_secrets(extract.lines(rows))


@query(f"SELECT doc_id, 2::BIGINT AS line_no, 'resource db main' AS block, 'password' AS key, {FIRST} || 'x' AS value FROM documents UNION ALL SELECT doc_id, 4, 'tags', 'owner', {FIRST} || 'x' FROM documents UNION ALL SELECT doc_id, 6, 'resource db main', 'after', 'y' FROM documents")
def hcl_values(spark: SparkSession, folder: str) -> DataFrame:
    """Terraform files around each text's first word, with nested blocks."""
    w = F.concat(F.regexp_extract(F.coalesce("text", F.lit("")), "[A-Za-z]+", 0), F.lit("x"))
    text = F.concat(F.lit('resource "db" "main" {\n  password = "'), w, F.lit('"\n  tags = {\n    owner = "'), w, F.lit('" # who\n  }\n  after = "y"\n  made = "${var.x}"\n}\n'))
    rows = _docs(spark, folder).select("doc_id", text.alias("text"), F.lit(0).cast("long").alias("base_line"))
    return structured.hcl_pairs(extract.lines(rows))


@query("SELECT page_id AS doc_id, 0 AS entry, 'request' AS side, 'header' AS kind, 'Referer' AS name, sha256(url) AS value_hash FROM pages UNION ALL SELECT page_id, 0, 'request', 'query', 'q', sha256(page_id::VARCHAR) FROM pages UNION ALL SELECT page_id, 0, 'response', 'cookie', 'sid', sha256(md5(url)) FROM pages")
def har_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Pages as HTTP captures with a header, a query parameter and a cookie."""
    pair = lambda n, v: F.array(F.struct(F.lit(n).alias("name"), v.alias("value")))
    entry = F.struct(F.struct("url", pair("Referer", F.col("url")).alias("headers"), pair("q", F.col("page_id").cast("string")).alias("queryString")).alias("request"), F.struct(pair("sid", F.md5("url")).alias("cookies")).alias("response"))
    captures = read(spark, folder, "pages").select(F.col("page_id").alias("doc_id"), F.to_json(F.struct(F.struct(F.array(entry).alias("entries")).alias("log"))).alias("har"))
    return structured.har_pairs(captures).select("doc_id", "entry", "side", "kind", "name", F.sha2("value", 256).alias("value_hash"))


@query(r"""WITH b AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g') AS t FROM pages)
SELECT page_id, sha256(trim(regexp_replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&amp;', '&'), '\s+', ' ', 'g'))) AS text_hash FROM b WHERE NOT contains(t, '&#')""")
def page_visible_text(spark: SparkSession, folder: str) -> DataFrame:
    """What pages show (those without numeric entities, which SQL has no reading for)."""
    rows = read(spark, folder, "pages")
    bare = F.regexp_replace(F.regexp_replace("html", r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    return rows.where(~F.contains(bare, F.lit("&#"))).select("page_id", F.sha2(structured.page_text(F.col("html")), 256).alias("text_hash"))


@query("SELECT page_id AS doc_id, 'src/' || page_id || '.ts' AS source, sha256(html) AS text_hash FROM pages")
def source_map_contents(spark: SparkSession, folder: str) -> DataFrame:
    """Pages as the contents of source maps."""
    name = F.concat(F.lit("src/"), F.col("page_id").cast("string"), F.lit(".ts"))
    maps = read(spark, folder, "pages").select(F.col("page_id").alias("doc_id"), F.to_json(F.struct(F.lit(3).alias("version"), F.array(name).alias("sources"), F.array("html").alias("sourcesContent"), F.lit("AAAA").alias("mappings"))).alias("text"))
    return structured.source_map_files(maps).select("doc_id", "source", F.sha2("text", 256).alias("text_hash"))


@query("SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'scheme' WHEN 1 THEN 'user_info' WHEN 2 THEN 'private_host' END AS refused FROM pages")
def fetch_screen(spark: SparkSession, folder: str) -> DataFrame:
    """Addresses that may not be fetched: some with another scheme, with user info, or at a private host."""
    rest = F.regexp_replace("url", "^[a-z]+://[^/]*", "")
    url = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("ftp://example.com"), rest)).when(F.col("page_id") % 5 == 1, F.concat(F.lit("https://a:b@example.com"), rest)).when(F.col("page_id") % 5 == 2, F.concat(F.lit("http://169.254.169.254"), rest)).otherwise(F.concat(F.lit("https://example.com"), rest))
    return read(spark, folder, "pages").select("page_id", structured.fetch_allowed(url).alias("refused"))


@query("SELECT page_id AS doc_id, 'app/page.html' AS path, 'read' AS state, sha256(html) AS content_hash FROM pages UNION ALL SELECT page_id, 'etc/old', 'whiteout', NULL FROM pages")
def container_layers(spark: SparkSession, folder: str) -> DataFrame:
    """Pages as files in the layer of an image, beside a path that the layer removes."""

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        import json
        import tarfile

        def tar(files: dict[str, bytes]) -> bytes:
            out = io.BytesIO()
            with tarfile.open(fileobj=out, mode="w") as t:
                for name, data in files.items():
                    info = tarfile.TarInfo(name)
                    info.size = len(data)
                    t.addfile(info, io.BytesIO(data))
            return out.getvalue()

        for frame in frames:
            images = []
            for html in frame["html"]:
                layer = tar({"app/page.html": html.encode(), "etc/.wh.old": b""})
                images.append(tar({"manifest.json": json.dumps([{"Config": "c.json", "Layers": ["l/layer.tar"]}]).encode(), "c.json": b"{}", "l/layer.tar": layer}))
            yield pd.DataFrame({"doc_id": frame["page_id"], "content": images})

    images = read(spark, folder, "pages").where("html IS NOT NULL").select("page_id", "html").mapInPandas(pack, "doc_id long, content binary")
    return packages.image_members(images).where("layer <> 'config'").select("doc_id", "path", "state", F.sha2("content", 256).alias("content_hash"))


# Statistics.


@query("SELECT event_type, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.9) AS q90 FROM events GROUP BY 1")
def robust_quantiles(spark: SparkSession, folder: str) -> DataFrame:
    return stats.quantiles(read(spark, folder, "events"), "value", (0.25, 0.9), "event_type")


@query("""WITH m AS (SELECT event_type, median(value) AS med FROM events GROUP BY 1), d AS (SELECT event_type, any_value(med) AS med, median(abs(value - med)) AS mad FROM events JOIN m USING (event_type) GROUP BY 1)
SELECT event_id, round(0.6745 * (value - med) / mad, 6) AS z, coalesce(abs(0.6745 * (value - med) / mad) > 3.5, false) AS outlier FROM events JOIN d USING (event_type)""")
def modified_z_outliers(spark: SparkSession, folder: str) -> DataFrame:
    return stats.modified_z(read(spark, folder, "events"), "value", "event_type").select("event_id", F.round("z", 6).alias("z"), "outlier")


@query("""WITH a AS (SELECT user_id % 5 AS g, value FROM events WHERE event_type = 'click'), b AS (SELECT user_id % 5 AS g, value FROM events WHERE event_type = 'view')
SELECT g, round(sum(sign(a.value - b.value)) / count(*), 9) AS delta FROM a JOIN b USING (g) GROUP BY 1""")
def cliffs_delta(spark: SparkSession, folder: str) -> DataFrame:
    """How the values of clicks compare with those of views, in five groups of users."""
    rows = read(spark, folder, "events").select((F.col("user_id") % 5).alias("g"), "value", "event_type")
    return stats.cliffs_delta(rows, "value", "event_type", "click", "view", "g").select("g", F.round("delta", 9).alias("delta"))


@query()
def bootstrap_interval(spark: SparkSession, folder: str) -> DataFrame:
    return stats.bootstrap_mean(read(spark, folder, "events"), "value", "event_id", "event_type", rounds=50)


@query(f"""WITH {LINES.format(table='documents')}, w AS (SELECT doc_id, unnest(regexp_extract_all(line, '[A-Za-z]{{9,}}')) AS v FROM lines), f AS (SELECT DISTINCT doc_id, v FROM w), t AS (SELECT DISTINCT doc_id, substr(v, 2, length(v) - 2) AS v FROM w WHERE length(v) % 2 = 0)
SELECT f.doc_id, f.v AS found_value, t.v AS true_value FROM f JOIN t ON f.doc_id = t.doc_id AND (contains(f.v, t.v) OR contains(t.v, f.v))""")
def truth_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """Long words of the texts as findings, and the inner parts of some as labelled values: which belong together."""
    words = extract.lines(chunks(_docs(spark, folder))).select("doc_id", F.explode(F.regexp_extract_all("line", F.lit("[A-Za-z]{9,}"), F.lit(0))).alias("value")).distinct()
    truth = words.where(F.length("value") % 2 == 0).select("doc_id", F.lit("secret").alias("label"), F.substring("value", F.lit(2), F.length("value") - 2).alias("value")).distinct()
    return stats.against_truth(words, truth, "doc_id").select("doc_id", "found_value", "true_value")


# Report documents.


@query(f"""WITH {FINDINGS} SELECT '[' AS line UNION ALL SELECT ']' UNION ALL SELECT '{{"path":' || to_json(path) || ',"line":' || line || ',"detector_id":"' || detector_id || '","credential_hash":"' || credential_hash || '","doc_id":' || doc_id || ',"k":' || k || ',"service":"' || service || '","severity_rank":' || severity_rank || ',"confidence":' || confidence || '}}' FROM findings""")
def report_json_array(spark: SparkSession, folder: str) -> DataFrame:
    """A whole report as a JSON array, line by line (here without the commas that stand before all but the first)."""
    return documents.json_array(_found(spark, folder)).select(F.regexp_replace("line", r"^,", "").alias("line"))


@query(f"WITH {FINDINGS} SELECT rule, count(*)::BIGINT AS n, min(level) AS level FROM (SELECT detector_id AS rule, ['note', 'note', 'note', 'warning', 'error', 'error'][severity_rank + 1] AS level FROM findings) GROUP BY 1")
def report_sarif_run(spark: SparkSession, folder: str) -> DataFrame:
    """Results of a whole SARIF run by rule, read back from its lines."""
    lines = documents.sarif(_found(spark, folder)).where("part = 3").select(F.regexp_replace("line", "^,", "").alias("line"))
    rows = lines.select(F.get_json_object("line", "$.ruleId").alias("rule"), F.get_json_object("line", "$.level").alias("level"))
    return rows.groupBy("rule").agg(F.count("*").alias("n"), F.min("level").alias("level"))


@query(f"""WITH {FINDINGS} SELECT path, count(*)::BIGINT AS n FROM findings GROUP BY 1""")
def report_html(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of a whole HTML report by path, read back from its lines."""
    rows = documents.html(_found(spark, folder)).where("part = 2").select(F.regexp_extract("line", "^<tr><td>([^<]*)</td>", 1).alias("path"))
    return rows.groupBy("path").agg(F.count("*").alias("n"))


@query(f"""WITH {FINDINGS}, r AS (SELECT *, round(confidence * 10)::INT AS f FROM findings) SELECT detector_id, repeat('█', f) || repeat('░', 10 - f) AS bar, count(*)::BIGINT AS n FROM r GROUP BY 1, 2""")
def report_boxes(spark: SparkSession, folder: str) -> DataFrame:
    """Detectors and confidence bars of a report for the terminal, read back from its lines."""
    rows = documents.boxes(_found(spark, folder))
    own = lambda n: rows.where(F.col("place") % 3 == n)
    heads = own(0).select(F.floor(F.col("place") / 3).alias("i"), F.regexp_extract("line", "^┌ ([^ ]+)", 1).alias("detector_id"))
    bars = own(2).select(F.floor(F.col("place") / 3).alias("i"), F.regexp_extract("line", "^└ (.*)$", 1).alias("bar"))
    return heads.join(bars, "i").groupBy("detector_id", "bar").agg(F.count("*").alias("n"))


# Verification from recorded answers.


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'live' WHEN 1 THEN 'dead' WHEN 2 THEN 'rate_limited' WHEN 3 THEN 'revoked' WHEN 4 THEN 'live' ELSE 'error' END AS outcome FROM events""")
def aws_probe_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """Events as recorded answers of a caller-identity request."""
    at = lambda values: F.get(F.array(*map(F.lit, values)), F.pmod(F.col("event_id"), F.lit(6)).cast("int"))
    status, code = at((200, 403, 400, 403, 403, 503)), at(("", "InvalidClientTokenId", "Throttling", "ExpiredToken", "AccessDenied", ""))
    return read(spark, folder, "events").select("event_id", verify.aws_outcome(status, code).alias("outcome"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_type WHEN 1 THEN 'sha256:' || sha256(event_type)[1:16] END AS shown FROM events")
def evidence_sensitivity(spark: SparkSession, folder: str) -> DataFrame:
    name = F.get(F.array(*map(F.lit, ("region", "email", "token"))), F.pmod(F.col("event_id"), F.lit(3)).cast("int"))
    return read(spark, folder, "events").select("event_id", verify.shown_evidence(name, F.col("event_type")).alias("shown"))


@query("""WITH a AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 200 WHEN 1 THEN 429 WHEN 2 THEN 503 END AS status, (event_id % 5 + 1)::INT AS attempt FROM events)
SELECT event_id, (status IS NULL OR status IN (408, 425, 429) OR status BETWEEN 500 AND 599) AND attempt < 4 AS retry, CASE WHEN (status IS NULL OR status IN (408, 425, 429) OR status BETWEEN 500 AND 599) AND attempt < 4 THEN least(8.0, 0.5 * pow(2, attempt - 1))::DOUBLE END AS wait FROM a""")
def retry_classes(spark: SparkSession, folder: str) -> DataFrame:
    status = F.get(F.array(F.lit(200), F.lit(429), F.lit(503), F.lit(None)), F.pmod(F.col("event_id"), F.lit(4)).cast("int"))
    rows = read(spark, folder, "events").select("event_id", verify.retry_class(status, (F.col("event_id") % 5 + 1).cast("int")).alias("r"))
    return rows.select("event_id", "r.retry", "r.wait")


@query("""WITH s AS (SELECT user_id, event_id, coalesce(sum((value::INT % 5)::DOUBLE) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM (SELECT user_id, event_id, floor(value) AS value FROM events)) SELECT user_id, count(*)::BIGINT AS n FROM s WHERE spent < 6 GROUP BY 1""")
def deadline_budget(spark: SparkSession, folder: str) -> DataFrame:
    """Each user's events as attempts that take some seconds: how many begin within the budget."""
    rows = read(spark, folder, "events").select("user_id", F.col("event_id").alias("attempt"), (F.floor("value").cast("int") % 5).cast("double").alias("seconds"))
    return verify.within_budget(rows, 6.0, "user_id").groupBy("user_id").agg(F.count("*").alias("n"))


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'nothing_extracted' WHEN 1 THEN 'host_not_allowed' ELSE 'ready' END AS state FROM pages")
def verification_chain(spark: SparkSession, folder: str) -> DataFrame:
    """Pages as first answers, whose id fills the address of a second step."""
    pages = read(spark, folder, "pages")
    first = pages.select("page_id", F.to_json(F.struct(F.struct(F.when(F.col("page_id") % 3 > 0, F.col("page_id").cast("string")).alias("id")).alias("user"))).alias("body"))
    second = pages.select("page_id", F.when(F.col("page_id") % 3 == 1, "https://other.test/{{extracted}}").otherwise("https://api.example.com/{{extracted}}").alias("template"))
    return verify.chained(first, second, "$.user.id", ("example.com",), "page_id").select("page_id", "state")


# Change logs and state.


def _log(events: DataFrame) -> DataFrame:
    """Events as a change log of all kinds."""
    kind = F.get(F.array(*map(F.lit, ("create", "modify", "remove", "barrier", "overflow", "reconcile", "rename"))), F.pmod(F.col("event_id"), F.lit(7)).cast("int"))
    return events.select(F.pmod("user_id", F.lit(8)).alias("root"), F.concat(F.lit("/u/"), F.col("user_id").cast("string")).alias("path"), kind.alias("kind"), (F.col("event_id") + 1).alias("seq"), "ts")


@query("""WITH RECURSIVE l AS (SELECT user_id % 8 AS root, ['create', 'modify', 'remove', 'barrier', 'overflow', 'reconcile', 'rename'][event_id % 7 + 1] AS kind, event_id + 1 AS seq, row_number() OVER (PARTITION BY user_id % 8 ORDER BY event_id) AS n FROM events),
s AS (SELECT root, 'indexing' AS state, 0::BIGINT AS n, 0::BIGINT AS seq FROM (SELECT DISTINCT root FROM l) UNION ALL
 SELECT l.root, CASE WHEN s.state = 'indexing' THEN CASE l.kind WHEN 'barrier' THEN 'current' WHEN 'overflow' THEN 'degraded' ELSE s.state END WHEN s.state = 'current' THEN CASE WHEN l.kind IN ('create', 'modify', 'remove', 'rename') THEN 'dirty' WHEN l.kind = 'overflow' THEN 'degraded' ELSE s.state END
  WHEN s.state = 'dirty' THEN CASE l.kind WHEN 'barrier' THEN 'current' WHEN 'overflow' THEN 'degraded' ELSE s.state END WHEN s.state = 'degraded' AND l.kind = 'reconcile' THEN 'indexing' ELSE s.state END, l.n, l.seq FROM s JOIN l ON l.root = s.root AND l.n = s.n + 1)
SELECT root, max(seq) AS last_seq, arg_max(state, n) AS state FROM s GROUP BY root""")
def guard_final_states(spark: SparkSession, folder: str) -> DataFrame:
    return S.final_states(_log(read(spark, folder, "events")))


@query("""WITH l AS (SELECT user_id % 8 AS root, '/u/' || user_id AS path, ['create', 'modify', 'remove', 'barrier', 'overflow', 'reconcile', 'rename'][event_id % 7 + 1] AS kind, event_id + 1 AS seq FROM events), s AS (SELECT root, path, max(seq) AS seq FROM l WHERE seq <= 400 AND kind = 'create' GROUP BY 1, 2),
a AS (SELECT root, max(seq) AS top FROM s GROUP BY 1), n AS (SELECT l.root, path, arg_max(kind, seq) AS kind, max(seq) AS seq FROM l LEFT JOIN a ON a.root = l.root WHERE (top IS NULL OR seq > top) AND kind IN ('create', 'modify', 'remove') GROUP BY 1, 2)
SELECT coalesce(s.root, n.root) AS root, coalesce(s.path, n.path) AS path, greatest(coalesce(n.seq, 0), coalesce(s.seq, 0)) AS seq FROM s FULL JOIN n ON s.root = n.root AND s.path = n.path WHERE n.kind IS NULL OR n.kind <> 'remove'""")
def snapshot_replay(spark: SparkSession, folder: str) -> DataFrame:
    """What is there after a snapshot of the log's first part and the replay of the rest."""
    log = _log(read(spark, folder, "events"))
    snapshot = log.where("seq <= 400 AND kind = 'create'").groupBy("root", "path").agg(F.max("seq").alias("seq"))
    return S.replayed(snapshot, log)


@query("""WITH RECURSIVE l AS (SELECT user_id % 8 AS root, ['create', 'modify', 'remove', 'barrier', 'overflow', 'reconcile', 'rename'][event_id % 7 + 1] AS kind, event_id + 1 AS seq, row_number() OVER (PARTITION BY user_id % 8 ORDER BY event_id) AS n FROM events),
s AS (SELECT root, 'indexing' AS state, 0::BIGINT AS n, 0::BIGINT AS seq FROM (SELECT DISTINCT root FROM l) UNION ALL
 SELECT l.root, CASE WHEN s.state = 'indexing' THEN CASE l.kind WHEN 'barrier' THEN 'current' WHEN 'overflow' THEN 'degraded' ELSE s.state END WHEN s.state = 'current' THEN CASE WHEN l.kind IN ('create', 'modify', 'remove', 'rename') THEN 'dirty' WHEN l.kind = 'overflow' THEN 'degraded' ELSE s.state END
  WHEN s.state = 'dirty' THEN CASE l.kind WHEN 'barrier' THEN 'current' WHEN 'overflow' THEN 'degraded' ELSE s.state END WHEN s.state = 'degraded' AND l.kind = 'reconcile' THEN 'indexing' ELSE s.state END, l.n, l.seq FROM s JOIN l ON l.root = s.root AND l.n = s.n + 1)
SELECT root, max(seq) AS last_seq, arg_max(state, n) AS state FROM s GROUP BY root""")
def guard_machine(spark: SparkSession, folder: str) -> DataFrame:
    """The roots' states as a stream with state: what each has come to after the last batch that held changes of it."""
    after = S.run(S.root_machine(_log(S.event_stream(spark, folder))), "guard-machine", "update")
    return after.groupBy("root").agg(F.max_by("state", "last_seq").alias("state"), F.max("last_seq").alias("last_seq"))


@query("""WITH RECURSIVE l AS (SELECT event_type AS service, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n, CASE WHEN event_id % 4 = 0 THEN 429 WHEN event_id % 9 = 0 THEN 500 ELSE 200 END AS status FROM events),
s AS (SELECT DISTINCT event_type AS service, 0::BIGINT AS n, 0.5::DOUBLE AS pause, 0 AS errors FROM events UNION ALL SELECT l.service, l.n, CASE WHEN status = 429 THEN least(8, pause * 2) ELSE 0.5 + (pause - 0.5) / 2 END, CASE WHEN status >= 429 THEN errors + 1 ELSE 0 END FROM s JOIN l ON l.service = s.service AND l.n = s.n + 1)
SELECT service, round(arg_max(pause, n), 6) AS pause, arg_max(errors, n) > 50 AS pressed, max(n) AS n FROM s GROUP BY 1""")
def rate_limiter(spark: SparkSession, folder: str) -> DataFrame:
    """Events as answers of services: the pause that they leave."""
    status = F.when(F.col("event_id") % 4 == 0, 429).when(F.col("event_id") % 9 == 0, 500).otherwise(200)
    return S.rate_limits(read(spark, folder, "events").select(F.col("event_type").alias("service"), F.col("event_id").alias("seq"), status.alias("status")))


@query("SELECT event_id % 10 = 3 AS malformed, count(*)::BIGINT AS n FROM events GROUP BY 1")
def malformed_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Events as lines of JSON, every tenth cut off: what can be read, and what can't."""
    line = F.to_json(F.struct("event_id", "event_type"))
    rows = read(spark, folder, "events").select(F.when(F.col("event_id") % 10 == 3, F.left(line, F.lit(9))).otherwise(line).alias("value"))
    good, bad = S.split_readable(rows, "event_id long, event_type string")
    count = lambda df, flag: df.agg(F.lit(flag).alias("malformed"), F.count("*").alias("n"))
    return count(good, False).unionByName(count(bad, True))


@query("SELECT doc_id AS root, CASE doc_id % 5 WHEN 0 THEN 'missing' WHEN 1 THEN 'schema_mismatch' WHEN 2 THEN 'spec_changed' WHEN 3 THEN 'invalid_hash' ELSE 'loaded' END AS status FROM documents")
def incremental_load(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the state of each text's last scan can be used."""
    docs, n = _docs(spark, folder), F.col("doc_id") % 5
    states = docs.where(n != 0).select(F.col("doc_id").alias("root"), F.when(n == 1, 1).otherwise(2).alias("schema_version"), F.when(n == 2, "old").otherwise("new").alias("spec_hash"), F.when(n == 3, "zz").otherwise(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("content_hash"))
    return S.load_state(states, docs.select(F.col("doc_id").alias("root")), 2, "new")


@query("""WITH f AS (SELECT '/u/' || user_id % 20 AS path, event_type AS prefix, event_id AS line, ts FROM events WHERE event_id % 2 = 0) SELECT a.path, a.prefix, a.line, b.line AS line_b, 'v' || a.line || 'v' || b.line AS joined FROM f a JOIN f b ON a.path = b.path AND a.prefix = b.prefix AND abs(a.line - b.line) < 100 AND a.line <> b.line AND abs(epoch(a.ts) - epoch(b.ts)) <= 36000""")
def fragment_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Every other event as a fragment of a value: pairs of one path and prefix, as a stream."""
    rows = S.event_stream(spark, folder).where("event_id % 2 = 0").select(F.concat(F.lit("/u/"), (F.col("user_id") % 20).cast("string")).alias("path"), F.col("event_type").alias("prefix"), F.col("event_id").alias("line"), F.concat(F.lit("v"), F.col("event_id").cast("string")).alias("value"), "ts")
    return S.run(S.fragment_stream(rows, 100, "10 hours"), "fragments", "append")
