"""The detector catalogue as data: a small built-in one, and a loader for folders of detector TOML files."""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Severities from low to high.
SEVERITIES = ("info", "client-safe", "low", "medium", "high", "critical")
#: Patterns that one scan may hold: they are literals of its plan.
MAX_PATTERNS = 5000


@dataclass(frozen=True)
class Pattern:
    regex: str
    group: int = 0
    required: tuple[str, ...] = ()
    client_safe: bool = False


@dataclass(frozen=True)
class Companion:
    """``required``: a match without it is dropped; ``forbidden``: a match with it is."""

    name: str
    regex: str
    group: int
    within_lines: int
    required: bool = False
    forbidden: bool = False


@dataclass(frozen=True)
class Relation:
    """To matches of another detector in the same document: ``requires`` one, or yields to it (``subsumes``: there, ``conflicts``: either).

    ``direction``: the other stands before, after or in any place; within_bytes is no bound if it is None.
    """

    kind: str
    detector: str
    within_lines: int
    within_bytes: int | None = None
    direction: str = "any"


@dataclass(frozen=True)
class Detector:
    id: str
    name: str
    service: str
    severity: str
    keywords: tuple[str, ...]
    patterns: tuple[Pattern, ...]
    companions: tuple[Companion, ...] = ()
    prefix: str = ""
    min_confidence: float = 0.0
    relations: tuple[Relation, ...] = ()
    exact_length: int = 0
    min_length: int = 0
    max_length: int = 0
    stopwords: tuple[str, ...] = ()
    allowed: tuple[str, ...] = ()
    validators: tuple[str, ...] = ()
    weights: dict = field(default_factory=dict, compare=False)
    generic: bool = False


def capturing_groups(regex: str) -> int:
    """How many groups of a pattern capture: parentheses that are not escaped, not in a class, and not special (but for named ones)."""
    n, k, inside = 0, 0, False
    while k < len(regex):
        if regex[k] == "\\":
            k += 1
        elif inside:
            inside = regex[k] != "]"
        elif regex[k] == "[":
            inside, k = True, k + (2 if regex[k + 1 : k + 3] == "^]" else 1 if regex[k + 1 : k + 2] == "]" else 0)
        elif regex[k] == "(" and (regex[k + 1 : k + 2] != "?" or re.match(r"\?P?<[A-Za-z]", regex[k + 1 :])):
            n += 1
        k += 1
    return n


def _d(ident: str, name: str, service: str, severity: str, keywords: str, regex: str, group: int = 0, prefix: str = "", companions: tuple[Companion, ...] = ()) -> Detector:
    return Detector(ident, name, service, severity, tuple(keywords.split()), (Pattern(regex, group),), companions, prefix)


#: Ids and names that findings are addressed by, and token formats that the services document publicly. Patterns keep to what Java
#: and RE2 read alike.
BUILT_IN = (
    _d("aws-access-key", "AWS Access Key", "aws", "critical", "akia asia", r"(?:AKIA|ASIA)[0-9A-Z]{16}\b", prefix="AKIA", companions=(Companion("secret_key", r"(?i)secret_access_key[=: \"']+([0-9a-zA-Z/+]{40})", 1, 5),)),
    _d("github-classic-pat", "GitHub Classic PAT", "github", "critical", "ghp_", r"ghp_[A-Za-z0-9]{36}\b", prefix="ghp_"),
    _d("github-fine-grained-pat", "GitHub Fine-grained PAT", "github", "critical", "github_pat_", r"github_pat_[A-Za-z0-9]{22}_[A-Za-z0-9]{59}\b", prefix="github_pat_"),
    _d("gitlab-pat", "GitLab PAT", "gitlab", "critical", "glpat-", r"glpat-[A-Za-z0-9_-]{20}\b", prefix="glpat-"),
    _d("slack-bot-token", "Slack Bot Token", "slack", "high", "xoxb-", r"xoxb-[0-9]{10,13}-[0-9]{10,13}-[A-Za-z0-9]{24}\b", prefix="xoxb-"),
    _d("stripe-live-key", "Stripe Live Key", "stripe", "critical", "sk_live_", r"sk_live_[A-Za-z0-9]{24,99}\b", prefix="sk_live_"),
    _d("stripe-publishable-key", "Stripe Publishable Key", "stripe", "low", "pk_live_", r"pk_live_[A-Za-z0-9]{24,99}\b", prefix="pk_live_"),
    _d("google-api-key", "Google API Key", "google", "high", "aiza", r"AIza[0-9A-Za-z_-]{35}", prefix="AIza"),
    _d("npm-token", "npm Token", "npm", "high", "npm_", r"npm_[A-Za-z0-9]{36}\b", prefix="npm_"),
    _d("pypi-token", "PyPI Token", "pypi", "high", "pypi-", r"pypi-[A-Za-z0-9_-]{16,}", prefix="pypi-"),
    _d("sendgrid-key", "SendGrid Key", "sendgrid", "high", "sg.", r"SG\.[A-Za-z0-9_-]{22}\.[A-Za-z0-9_-]{43}", prefix="SG."),
    _d("json-web-token", "JSON Web Token", "generic", "medium", "eyj", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", prefix="eyJ"),
    _d("private-key-block", "Private Key", "generic", "critical", "private", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    _d("connection-string", "Connection String", "generic", "high", "://", r"[a-z][a-z0-9+.-]*://[A-Za-z0-9_.-]+:([^@/ \"'\n]{6,})@", 1),
    _d("generic-secret", "Generic Secret", "generic", "medium", "token secret password api_key apikey", r"(?i)(?:token|secret|password|api_?key)[\"']? ?[:=] ?[\"']?([A-Za-z0-9_+/.=-]{8,128})", 1),
)


#: Long tokens on lines with a credential keyword; their entropy is judged by the caller.
ENTROPY_TOKEN = Detector("entropy-token", "High-entropy Token", "generic", "low", ("token", "secret", "password", "key", "bearer"), (Pattern(r"[A-Za-z0-9+/_-]{20,}"),))


def numbered(n: int) -> tuple[Detector, ...]:
    """A catalogue of ``n`` detectors of one synthetic form, ``k007_`` and 24 hexadecimal digits: to try plans with many patterns."""
    return tuple(_d(f"synthetic-{k:03d}", f"Synthetic {k}", "synthetic", "low", f"k{k:03d}_", rf"k{k:03d}_[0-9a-f]{{24}}\b", prefix=f"k{k:03d}_") for k in range(n))


def _anywhere(regex: str) -> str:
    """Patterns are blind to case, unless they say otherwise."""
    return regex if regex.startswith("(?-i)") else f"(?i){regex}"


def _companion(c: dict) -> Companion:
    """The group is the one that is named, or the only one that captures; else the whole match."""
    group = c["group"] if c.get("group") is not None else 1 if capturing_groups(c["regex"]) == 1 else 0
    requirement = c.get("requirement") or ("required" if c.get("required") else "optional")
    if requirement not in ("optional", "required", "forbidden"):
        raise ValueError(f"companion {c['name']}: unknown requirement {requirement}")
    return Companion(c["name"], _anywhere(c["regex"]), group, c["within_lines"], requirement == "required", requirement == "forbidden")


def _from_spec(spec: dict) -> Detector:
    patterns = tuple(Pattern(_anywhere(p["regex"]), p.get("group") or 0, tuple(p.get("required_literals", ())), bool(p.get("client_safe"))) for p in spec.get("patterns", ()))
    relations = tuple(Relation(r["kind"], r["detector"], r["within_lines"], r.get("within_bytes"), r.get("direction", "any")) for r in spec.get("detector_relations", ()))
    if any(r.kind not in ("requires", "subsumes", "conflicts") or r.direction not in ("any", "before", "after") for r in relations):
        raise ValueError(f"{spec['id']}: unknown relation")
    validators = tuple(v if isinstance(v, str) else v["type"] for v in spec.get("validators", ()))
    return Detector(
        spec["id"], spec["name"], spec["service"], spec["severity"], tuple(k.lower() for k in spec.get("keywords", ())), patterns, tuple(map(_companion, spec.get("companions", ()))),
        min_confidence=spec.get("min_confidence", 0.0), relations=relations, exact_length=spec.get("credential_shape", {}).get("exact_length", 0), min_length=spec.get("min_len", 0), max_length=spec.get("max_len", 0),
        stopwords=tuple(w.lower() for w in spec.get("stopwords", ())), allowed=tuple(spec.get("allowlist_values", ())), validators=validators, weights=spec.get("match_confidence", {}), generic=spec.get("kind") == "phase2-generic",
    )


def load(folder: str) -> tuple[Detector, ...]:
    """Detectors from a folder of TOML files, one each. Any fault in any file is an error; ids must differ."""
    found: dict[str, Detector] = {}
    for path in sorted(Path(folder).glob("*.toml")):
        spec = tomllib.loads(path.read_text(encoding="utf-8")).get("detector")
        if spec is None:
            continue
        for key in ("id", "name", "service", "severity"):
            if not spec.get(key):
                raise ValueError(f"{path}: no {key}")
        if spec["severity"] not in SEVERITIES:
            raise ValueError(f"{path}: unknown severity {spec['severity']}")
        if spec["id"] in found:
            raise ValueError(f"{path}: {spec['id']} is there already")
        found[spec["id"]] = _from_spec(spec)
    return tuple(found.values())


def overlay(base: tuple[Detector, ...], more: tuple[Detector, ...], replace: bool = False) -> tuple[Detector, ...]:
    """Both catalogues; an id that both have is an error, unless ``replace`` lets the second win."""
    both = {d.id: d for d in base}
    clash = sorted(both.keys() & {d.id for d in more})
    if clash and not replace:
        raise ValueError(f"detectors defined twice: {', '.join(clash)}")
    return tuple((both | {d.id: d for d in more}).values())


def detector_table(spark: SparkSession, detectors: tuple[Detector, ...] = BUILT_IN) -> DataFrame:
    rows = [(d.id, d.name, d.service, d.severity, SEVERITIES.index(d.severity), list(d.keywords)) for d in detectors]
    return spark.createDataFrame(rows, "detector_id string, name string, service string, severity string, severity_rank int, keywords array<string>")


def pattern_table(spark: SparkSession, detectors: tuple[Detector, ...] = BUILT_IN) -> DataFrame:
    rows = [(d.id, k, p.regex, p.group, list(d.keywords), list(p.required)) for d in detectors for k, p in enumerate(d.patterns)]
    return spark.createDataFrame(rows, "detector_id string, pattern_no int, regex string, grp int, keywords array<string>, required array<string>")


def audit(detectors: tuple[Detector, ...]) -> list[tuple[str, str]]:
    """(detector id, fault): what makes a detector useless or slow, found without any data."""
    faults = []
    for d in detectors:
        tests = (
            ("no pattern", not d.patterns and not d.generic),
            ("no keyword: it can't be triggered", not d.keywords and not d.generic),
            ("a keyword of under three letters triggers nearly everywhere", any(len(k) < 3 for k in d.keywords)),
            ("a pattern's group is beyond those that capture", any(p.group > capturing_groups(p.regex) for p in d.patterns)),
            ("a companion's group is beyond those that capture", any(c.group > capturing_groups(c.regex) for c in d.companions)),
            ("a pattern can match the empty text", any(_matches_nothing(p.regex) for p in d.patterns)),
            ("a relation to itself", any(r.detector == d.id for r in d.relations)),
        )
        faults += [(d.id, name) for name, holds in tests if holds]
    return faults


def _matches_nothing(regex: str) -> bool:
    try:
        return re.match(regex, "") is not None
    except re.error:
        return False


def search(table: DataFrame, wanted: str) -> DataFrame:
    """Detectors whose id, name, service or a keyword contains the text, in any case."""
    from pyspark.sql import functions as F

    has = lambda c: F.contains(F.lower(c), F.lit(wanted.lower()))
    return table.where(has(F.col("detector_id")) | has(F.col("name")) | has(F.col("service")) | F.exists("keywords", has))
