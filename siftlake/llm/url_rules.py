"""URL filters: host-suffix and path-prefix expressions, an equi-join on short hash prefixes, then full digests and precedence.

Each URL is expanded into host suffixes (at labels) times path prefixes (at the lengths that rules have), so its
expressions hold every rule that can fit. The first eight hex digits of an expression's SHA-256 are joined with those of
the rules; a hit counts only if the full digests agree. Of the rules that fit, the longest wins; of equally long ones
that with the longer host, then a block before an allow.

Nulls, ties and odd rows: a URL that is null or has no ``://`` has an empty host and path, and no rule fits; rules with
an empty host fit nothing; repeated rows of pages are judged each by itself; repeated rules count once; other columns
come along, save those with names of the result. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table

#: (host, path, verdict)
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
#: Hex digits of the short hash that the join is on.
SHORT = 8


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty if it is null or has no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    cut = F.regexp_extract(F.coalesce(rest, F.lit("")), r"(?s)^([^/?#]*)([^?#]*)", 0)
    return ascii_lower(F.regexp_extract(cut, r"(?s)^([^/?#]*)", 1)), F.regexp_extract(cut, r"(?s)^[^/?#]*(.*)$", 1)


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``pages`` (url and others) with host, path, rule (the rule that decides, or null) and verdict.

    ``rules``: host, path, verdict. The distinct shapes of the rules (host labels and path lengths; a host has under 128 labels
    and a path at most some thousand characters) come to the driver, so that only expressions that can hit are made.
    """
    listed = rules.select(ascii_lower(F.col("host")).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), "verdict").where("rule_host != ''")
    listed = listed.groupBy("rule_host", "rule_path").agg(F.max("verdict").alias("rule_verdict"))  # block after allow
    listed = listed.withColumn("rule", F.concat("rule_host", "rule_path")).withColumn("rule_digest", F.sha2("rule", 256))
    listed = listed.select(F.substring("rule_digest", 1, SHORT).alias("short"), "rule_digest", "rule", "rule_verdict", F.length("rule").alias("rule_chars"), F.length("rule_host").alias("host_chars"))
    shapes = rules.where("host != ''").agg(F.collect_set(F.size(F.split("host", r"\."))).alias("labels"), F.collect_set(F.length(F.coalesce("path", F.lit("")))).alias("chars")).first()
    labels, chars = (F.array(*map(F.lit, sorted(x or []))).cast("array<int>") for x in shapes)

    host, path = url_parts(F.col("url"))
    own = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    rows = pages.select(F.monotonically_increasing_id().alias("_row"), F.struct(*own).alias("_page"), host.alias("host"), path.alias("path"))
    suffixes = F.transform(F.filter(labels, lambda k: (F.col("host") != "") & (k <= F.size(F.split("host", r"\.")))), lambda k: F.concat_ws(".", F.slice(F.split("host", r"\."), -k, k)))
    prefixes = F.transform(F.filter(chars, lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    rows = rows.withColumn("expression", F.explode_outer(F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))))
    rows = rows.withColumn("digest", F.sha2("expression", 256)).withColumn("short", F.substring("digest", 1, SHORT))
    hits = rows.join(listed, "short", "left").withColumn("fits", F.col("digest") == F.col("rule_digest"))
    best = F.max(F.when(F.col("fits"), F.struct("rule_chars", "host_chars", "rule_verdict", "rule"))).alias("best")
    judged = hits.groupBy("_row").agg(F.first("_page").alias("_page"), F.first("host").alias("host"), F.first("path").alias("path"), best)
    return judged.select("_page.*", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"))


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = ", ".join(f"('{host}', '{path}', '{verdict}')" for host, path, verdict in RULES)
    rules = spark.sql(f"SELECT * FROM VALUES {values} AS rules (host, path, verdict)")
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


OP9_SQL = r"""
WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r
), v (rule_host, rule_path, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m AS (
  SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(verdict, length(rule_host || rule_path)) AS verdict
  FROM p, v WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id
)
SELECT p.page_id, host, path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM p LEFT JOIN m USING (page_id)
"""
