"""Verification offline: requests as rows, and verdicts from recorded responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OUTCOMES = ("live", "dead", "revoked", "rate_limited", "unverifiable", "skipped", "error")


def outcome(status: Column, body: Column, policy: str = "status_with_error_backstop") -> Column:
    """What a recorded response says of a credential, under a success policy."""
    limited, broken = status == 429, status.isNull() | (status >= 500)
    bad = body.rlike("(?i)revoked|disabled"), body.rlike("(?i)invalid|unauthori[sz]ed|error")
    good = {"status_authoritative": status == 200, "status_with_error_backstop": (status == 200) & ~bad[1], "body_positive": (status == 200) & body.rlike('(?i)"ok" ?: ?true')}[policy]
    return F.when(limited, "rate_limited").when(broken, "error").when(bad[0], "revoked").when(F.coalesce(good, F.lit(False)), "live").when(status.isin(401, 403) | bad[1], "dead").otherwise("unverifiable")


def allowed_host(host: Column, domains: tuple[str, ...]) -> Column:
    """The host is one of the domains or below one."""
    found = F.lit(False)
    for d in domains:
        found = found | (F.lower(host) == d) | F.endswith(F.lower(host), F.lit(f".{d}"))
    return found


def filled(template: str, values: dict[str, Column], escape: bool) -> Column:
    """A template with ``{{name}}`` marks, filled; values are escaped for URLs if wanted. A missing value makes the result null."""
    import re

    parts = []
    for k, part in enumerate(re.split(r"\{\{([a-z_.]+)\}\}", template)):
        if k % 2 and part not in values:
            raise ValueError(f"no value for {part}")
        parts.append((F.url_encode(values[part]) if escape else values[part]) if k % 2 else F.lit(part))
    return F.concat(*parts)


def requests(findings: DataFrame, url: str, auth: str = "bearer") -> DataFrame:
    """Request rows for findings with ``value``: url and the authorisation header. Nothing is sent."""
    header = {"bearer": F.concat(F.lit("Bearer "), "value"), "basic": F.concat(F.lit("Basic "), F.base64(F.encode(F.concat("value", F.lit(":")), "UTF-8"))), "none": F.lit(None).cast("string")}[auth]
    return findings.withColumn("url", filled(url, {"match": F.col("value")}, True)).withColumn("authorization", header)


def missing_references(template: str, values: dict[str, Column]) -> list[str]:
    """The names in a template that no value is there for."""
    import re

    return sorted({x for x in re.findall(r"\{\{([a-z_.]+)\}\}", template) if x not in values})


def aws_outcome(status: Column, code: Column) -> Column:
    """What a recorded answer of a caller-identity request says of a key pair, by its error code."""
    dead = code.isin("InvalidClientTokenId", "SignatureDoesNotMatch", "UnrecognizedClientException", "InvalidAccessKeyId")
    return F.when(status == 200, "live").when(code.isin("Throttling", "RequestLimitExceeded") | (status == 429), "rate_limited").when(code == "ExpiredToken", "revoked").when(dead, "dead").when(code == "AccessDenied", "live").when(status.isNull() | (status >= 500), "error").otherwise("unverifiable")


#: How evidence of a provider may be shown, by what it is.
SENSITIVITY = {"account_id": "public", "region": "public", "scope": "public", "user_name": "hashed", "email": "hashed", "organization": "hashed", "token": "secret", "refresh_token": "secret", "private_key": "secret"}


def shown_evidence(name: Column, value: Column) -> Column:
    """Public evidence as it is, hashed as the first digits of its SHA-256, secret not at all; what isn't known counts as secret."""
    kind = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in SENSITIVITY.items() for x in pair)), name), F.lit("secret"))
    return F.when(kind == "public", value).when(kind == "hashed", F.concat(F.lit("sha256:"), F.left(F.sha2(value, 256), F.lit(16))))


def retry_class(status: Column, attempt: Column, most: int = 4, base: float = 0.5, longest: float = 8.0) -> Column:
    """Whether a recorded attempt is to be repeated, and after how many seconds: (retry, wait). Doubled each time, up to the longest."""
    again = (status.isNull() | status.isin(408, 425, 429) | status.between(500, 599)) & (attempt < most)
    return F.struct(again.alias("retry"), F.when(again, F.least(F.lit(longest), base * F.pow(F.lit(2.0), attempt - 1))).alias("wait"))


def within_budget(attempts: DataFrame, seconds: float, *keys: str) -> DataFrame:
    """Attempts (keys, attempt, seconds) that begin before the budget of their group is spent."""
    order = Window.partitionBy(*keys).orderBy("attempt").rowsBetween(Window.unboundedPreceding, -1)
    return attempts.withColumn("_spent", F.coalesce(F.sum("seconds").over(order), F.lit(0.0))).where(F.col("_spent") < seconds).drop("_spent")


def chained(first: DataFrame, second: DataFrame, extract: str, domains: tuple[str, ...], *keys: str) -> DataFrame:
    """The second step of verifications: what the JSON selector takes from the first answer (keys, body) fills ``{{extracted}}`` in the second's address (keys, template).

    A step whose host isn't allowed is skipped, and says so.
    """
    from siftlake.functions.codecs import json_selector

    rows = first.join(second, list(keys)).withColumn("extracted", json_selector(F.col("body"), extract))
    url = F.replace("template", F.lit("{{extracted}}"), F.url_encode(F.coalesce("extracted", F.lit(""))))
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1)
    state = F.when(F.col("extracted").isNull(), "nothing_extracted").when(~allowed_host(host, domains), "host_not_allowed").otherwise("ready")
    return rows.select(*keys, url.alias("url"), state.alias("state"))
