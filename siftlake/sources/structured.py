"""Structured files as key-value rows: notebooks, Terraform state and files, compose files, Kubernetes secrets, HTTP captures in full, pages in full."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlake.functions.codecs import decode_base64

NOTEBOOK = "struct<cells: array<struct<cell_type: string, source: array<string>, outputs: array<struct<text: array<string>>>>>>"


def notebook_lines(files: DataFrame) -> DataFrame:
    """Lines of the cells of notebooks (doc_id, text): doc_id, cell, kind (code, markdown, output ...), line_no (in the cell, 1-based) and line."""
    cells = files.select("doc_id", F.posexplode(F.from_json("text", NOTEBOOK)["cells"]).alias("cell", "c"))
    empty = F.array().cast("array<string>")
    outputs = F.flatten(F.coalesce(F.transform("c.outputs", lambda o: F.coalesce(o["text"], empty)), F.array(empty)))
    parts = F.array(F.struct(F.col("c.cell_type").alias("kind"), F.coalesce("c.source", empty).alias("lines")), F.struct(F.lit("output").alias("kind"), outputs.alias("lines")))
    rows = cells.select("doc_id", "cell", F.explode(parts).alias("p")).select("doc_id", "cell", "p.kind", F.posexplode("p.lines").alias("at", "line"))
    return rows.select("doc_id", "cell", "kind", (F.col("at") + 1).alias("line_no"), F.regexp_replace("line", r"\r?\n$", "").alias("line"))


STATE = "struct<resources: array<struct<type: string, name: string, instances: array<struct<attributes: map<string, string>>>>>, outputs: map<string, struct<value: string, sensitive: boolean>>>"


def terraform_state(files: DataFrame) -> DataFrame:
    """Attributes of resources and outputs of Terraform state files (doc_id, text): doc_id, key (``type.name.attribute`` or ``output.name``) and value."""
    rows = files.select("doc_id", F.from_json("text", STATE).alias("s"))
    attributes = rows.select("doc_id", F.explode("s.resources").alias("r")).select("doc_id", "r.type", "r.name", F.explode("r.instances").alias("i")).select("doc_id", "type", "name", F.explode("i.attributes").alias("key", "value"))
    outputs = rows.select("doc_id", F.explode("s.outputs").alias("key", "o")).select("doc_id", F.concat(F.lit("output."), "key").alias("key"), F.col("o.value").alias("value"))
    return attributes.select("doc_id", F.concat_ws(".", "type", "name", "key").alias("key"), "value").unionByName(outputs).where("value IS NOT NULL")


YAML_PAIR = r"""^( *)(?:- )?["']?([A-Za-z_][A-Za-z0-9_.-]*)["']?(?:: |=)\s*(?:"([^"]*)"|'([^']*)'|([^#\s"'][^#]*?))\s*(?:#.*)?$"""


def _pairs(lines: DataFrame) -> DataFrame:
    """Lines that hold a key and a plain value: doc_id, line_no, indent, key and value."""
    value = F.concat(*(F.regexp_extract("line", YAML_PAIR, k) for k in (3, 4, 5)))
    return lines.where(F.col("line").rlike(YAML_PAIR)).select("doc_id", "line_no", F.length(F.regexp_extract("line", YAML_PAIR, 1)).alias("indent"), F.regexp_extract("line", YAML_PAIR, 2).alias("key"), value.alias("value"))


def _below(lines: DataFrame, head: str) -> DataFrame:
    """Lines that stand deeper than the last line before them that is ``head:``, with nothing as shallow between."""
    order = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    indent = F.length(F.regexp_extract("line", "^( *)", 1))
    full = F.col("line").rlike(r"\S")
    opens = F.col("line").rlike(rf"^ *{head}:\s*(?:#.*)?$")
    rows = lines.withColumn("_indent", indent).withColumn("_head", F.last(F.when(opens, F.struct(indent.alias("depth"), F.col("line_no").alias("at"))), ignorenulls=True).over(order))
    own = Window.partitionBy("doc_id", "_head.at").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    shallow = full & ((F.col("_indent") < F.col("_head.depth")) | ((F.col("_indent") == F.col("_head.depth")) & ~F.col("line").rlike("^ *- "))) & (F.col("line_no") > F.col("_head.at"))
    rows = rows.where("_head IS NOT NULL").withColumn("_left", F.max(shallow).over(own))
    return rows.where(~F.col("_left") & (F.col("line_no") > F.col("_head.at"))).drop("_indent", "_head", "_left")


def compose_environment(lines: DataFrame) -> DataFrame:
    """Variables below ``environment:`` of compose files (doc_id, line_no, line), written as a list or as a map: doc_id, line_no, key and value."""
    return _pairs(_below(lines, "environment")).select("doc_id", "line_no", "key", "value")


def kubernetes_secrets(lines: DataFrame) -> DataFrame:
    """Values of Kubernetes secrets (doc_id, line_no, line): those below ``data:`` decoded from base64, those below ``stringData:`` as they are."""
    secret = lines.where(F.col("line").rlike(r"^kind:\s*[\"']?Secret[\"']?\s*$")).select("doc_id").distinct()
    own = lines.join(secret, "doc_id", "left_semi")
    coded = _pairs(_below(own, "data")).select("doc_id", "line_no", "key", decode_base64(F.trim("value")).alias("value"))
    return coded.unionByName(_pairs(_below(own, "stringData")).select("doc_id", "line_no", "key", "value")).where("value IS NOT NULL")


HCL_PAIR = r"""^\s*["']?([A-Za-z_][A-Za-z0-9_-]*)["']?\s*=\s*"((?:[^"\\]|\\.)*+)"\s*,?\s*(?:#.*|//.*)?$"""


def hcl_pairs(lines: DataFrame) -> DataFrame:
    """String values of Terraform files (doc_id, line_no, line) with the path of the blocks that are open: doc_id, line_no, block, key and value.

    A block opens with a line that ends in a brace, and closes with one that begins with it; values with interpolation are left out. ``block`` is the innermost
    open block's head, without quotes.
    """
    order = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    opens, closes = F.col("line").rlike(r"\{\s*(?:#.*)?$"), F.col("line").rlike(r"^\s*\}")
    rows = lines.withColumn("_depth", F.sum(F.when(opens, 1).when(closes, -1).otherwise(0)).over(order))
    head = F.trim(F.regexp_replace(F.regexp_replace("line", r"\s*=?\s*\{\s*(?:#.*)?$", ""), '"', ""))
    level = Window.partitionBy("doc_id", "_depth").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_head", F.last(F.when(opens, head), ignorenulls=True).over(level))
    pair = F.col("line").rlike(HCL_PAIR) & ~F.col("line").rlike(r"\$\{")
    return rows.where(pair).select("doc_id", "line_no", F.coalesce("_head", F.lit("")).alias("block"), F.regexp_extract("line", HCL_PAIR, 1).alias("key"), F.regexp_extract("line", HCL_PAIR, 2).alias("value"))


PAIR = "array<struct<name: string, value: string>>"
CAPTURE = f"log struct<entries: array<struct<request: struct<url: string, headers: {PAIR}, cookies: {PAIR}, queryString: {PAIR}>, response: struct<headers: {PAIR}, cookies: {PAIR}>>>>"


def har_pairs(captures: DataFrame) -> DataFrame:
    """Headers, cookies and query parameters of HTTP captures (doc_id, har as JSON): doc_id, entry, side, kind, name and value."""
    rows = captures.select("doc_id", F.posexplode(F.from_json("har", CAPTURE)["log"]["entries"]).alias("entry", "e"))
    kinds = [("request", "header", "e.request.headers"), ("request", "cookie", "e.request.cookies"), ("request", "query", "e.request.queryString"), ("response", "header", "e.response.headers"), ("response", "cookie", "e.response.cookies")]
    empty = F.array().cast("array<struct<side: string, kind: string, name: string, value: string>>")
    parts = F.flatten(F.array(*(F.coalesce(_tagged(s, k, c), empty) for s, k, c in kinds)))
    return rows.select("doc_id", "entry", F.explode(parts).alias("p")).select("doc_id", "entry", "p.*").where("value IS NOT NULL")


def _tagged(side: str, kind: str, column: str) -> Column:
    return F.transform(column, lambda p: F.struct(F.lit(side).alias("side"), F.lit(kind).alias("kind"), p["name"].alias("name"), p["value"].alias("value")))


def page_text(html: Column) -> Column:
    """What a page shows: its text without scripts, styles, comments and marks; entities are read, and white space is one blank."""
    from siftlake.operators.decode import html_entities

    bare = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(html_entities(F.regexp_replace(bare, r"(?s)<[^>]*>", " ")), r"\s+", " "))


MAP = "struct<version: int, sources: array<string>, sourcesContent: array<string>>"


def source_map_files(maps: DataFrame) -> DataFrame:
    """Source files inside JavaScript source maps (doc_id, text): doc_id, source and text."""
    rows = maps.select("doc_id", F.from_json("text", MAP).alias("m")).where("m.sourcesContent IS NOT NULL")
    return rows.select("doc_id", F.explode(F.arrays_zip(F.col("m.sources").alias("source"), F.col("m.sourcesContent").alias("text"))).alias("f")).select("doc_id", "f.source", "f.text").where("text IS NOT NULL")


def fetch_allowed(url: Column) -> Column:
    """Why an address may not be fetched: no scheme of the web, user info in it, or a host that is private; null if it may."""
    from siftlake.functions.codecs import is_private_url

    return F.when(~url.rlike("(?i)^https?://"), "scheme").when(url.rlike("^[A-Za-z]+://[^/?#]*@"), "user_info").when(F.coalesce(is_private_url(url), F.lit(True)), "private_host")
