"""Suppression: an ordered ladder of named stages, rules, globs and directives in the text. Each drop carries its stage."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlake.functions import text as T

from .score import is_placeholder

#: Widths of hexadecimal digests, and the digests of an empty input.
DIGEST_WIDTHS = (32, 40, 64, 128)
EMPTY_DIGESTS = ("d41d8cd98f00b204e9800998ecf8427e", "da39a3ee5e6b4b0d3255bfef95601890afd80709", "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855")

#: Stages in order: the first that holds names the drop. They judge a candidate ``value``.
STAGES = (
    ("below_min_length", lambda v: F.length(v) < 8),
    ("value_too_long", lambda v: F.length(v) > 256),
    ("known_example", lambda v: F.lower(v).isin(*EMPTY_DIGESTS) | F.endswith(v, F.lit("EXAMPLE")) | v.rlike("(?i)0123456789abcdef|abcdefgh|12345678")),
    ("placeholder", is_placeholder),
    ("uuid", T.is_uuid),
    ("email", T.is_email),
    ("hex_digest", lambda v: F.length(v).isin(*DIGEST_WIDTHS) & T.is_hex(v)),
    ("shell_template", lambda v: v.rlike(r"^\$\{?[A-Za-z_]|\{\{|%\(|^<[a-z_-]+>$")),
    ("url_or_path", lambda v: v.rlike(r"^[a-z][a-z0-9+.-]*://|^\.{0,2}/[A-Za-z0-9_./-]*$")),
    ("version", lambda v: v.rlike(r"^v?[0-9]+(\.[0-9]+){1,3}$")),
    ("numeric", lambda v: v.rlike(r"^[0-9.,_+-]+$")),
    ("file_name", lambda v: v.rlike(r"^[A-Za-z0-9_-]+\.(json|ya?ml|toml|txt|md|py|js|ts|go|rs|html|css|png)$")),
    ("dotted_identifier", lambda v: v.rlike(r"^[A-Za-z_]+(\.[A-Za-z_]+)+$")),
    ("identifier_without_digit", lambda v: v.rlike("^[A-Za-z_]+$")),
    ("kebab_words", lambda v: v.rlike("^[a-z]+(-[a-z]+)+$")),
    ("low_diversity", lambda v: T.char_diversity(v) < 0.1),
    ("degenerate_run", lambda v: (F.length(v) >= 10) & (T.longest_run(v) / F.length(v) > 0.8)),
    ("entropy_below_floor", lambda v: T.shannon_entropy(v) < 2.5),
)


def stage(value: Column) -> Column:
    """The name of the first stage that drops the value; null: it is reported."""
    return F.coalesce(*(F.when(test(value), name) for name, test in STAGES))


def hex_context(text: Column, start: Column, length: Column, radius: int = 16, least: int = 8) -> Column:
    """The value stands inside a longer run of hex digits: ``least`` of them right before and right after."""
    before = F.substring(text, F.greatest(start - radius + 1, F.lit(1)), F.least(start, F.lit(radius)))
    after = F.substring(text, start + length + 1, F.lit(radius))
    return before.rlike(f"[0-9a-fA-F]{{{least},}}$") & after.rlike(f"^[0-9a-fA-F]{{{least},}}")


#: Path classes in order: the first whose pattern is in the lower-case path.
PATH_CLASSES = (("vendored", r"(^|/)(vendor|node_modules|third_party|dist)/"), ("minified", r"\.min\.(js|css)$"), ("ci", r"(^|/)\.(github|gitlab|circleci)(/|$)"), ("i18n", r"(^|/)(locales?|i18n|translations|en|fr|de|es)/"), ("test", r"(^|/)(tests?|spec|fixtures?)/"))


def path_class(path: Column) -> Column:
    return F.coalesce(*(F.when(F.lower(path).rlike(rx), name) for name, rx in PATH_CLASSES), F.lit("plain"))


#: Conditions of a rule: key to a test of the finding.
CONDITIONS = {
    "detector": lambda x: F.col("detector_id") == x,
    "service": lambda x: F.col("service") == x,
    "severity_lte": lambda x: F.col("severity_rank") <= x,
    "severity": lambda x: F.col("severity_rank") == x,
    "path_eq": lambda x: F.coalesce("path", F.lit("")) == x,
    "path_contains": lambda x: F.contains(F.coalesce("path", F.lit("")), F.lit(x)),
    "path_starts_with": lambda x: F.startswith(F.coalesce("path", F.lit("")), F.lit(x)),
    "path_ends_with": lambda x: F.endswith(F.coalesce("path", F.lit("")), F.lit(x)),
    "path_regex": lambda x: F.coalesce("path", F.lit("")).rlike(x),
    "credential_hash": lambda x: F.col("credential_hash") == x,
}


def rules(tables: list[dict]) -> Column:
    """One condition for rule tables: all keys of a table must hold, any table is enough. Empty tables and unknown keys are errors."""
    if any(not t for t in tables) or any(k not in CONDITIONS for t in tables for k in t):
        raise ValueError("a rule needs conditions, and only known ones")
    return reduce(lambda a, b: a | b, (reduce(lambda a, b: a & b, (CONDITIONS[k](v) for k, v in t.items())) for t in tables), F.lit(False))


def glob_regex(glob: str) -> str:
    """A path glob (``*`` within a part, ``**`` over parts, ``?``) as a regular expression for whole paths."""
    if len(glob.split("/")) > 256:
        raise ValueError("a glob has at most 256 parts")
    out, k = "", 0
    while k < len(glob):
        if glob.startswith("**/", k):
            out, k = out + "(?:[^/]+/)*", k + 3
        elif glob.startswith("**", k):
            out, k = out + ".*", k + 2
        else:
            out, k = out + {"*": "[^/]*", "?": "[^/]"}.get(glob[k], re.escape(glob[k])), k + 1
    return f"^{out}$"


def allowed(path: Column, globs: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (path.rlike(glob_regex(g)) for g in globs), F.lit(False))


#: A comment that drops findings of its own line, or of the next one; of one detector, if it names one.
DIRECTIVE = r"(?i)(?:#|//|/\*|--|;|<!--|%)\s*siftlake:ignore(-next)?(?:\s+detector=([A-Za-z0-9_-]+))?"


def directed(line: Column, above: Column, detector_id: Column) -> Column:
    """A directive on the match's line, or one for the next line above it, speaks of this detector or of all."""

    def says(text: Column, following: str) -> Column:
        scope = F.regexp_extract(text, DIRECTIVE, 2)
        return text.rlike(DIRECTIVE) & (F.lower(F.regexp_extract(text, DIRECTIVE, 1)) == following) & ((scope == "") | (scope == detector_id))

    return says(line, "") | says(above, "-next")


def with_directive(lines: DataFrame, directive: str = r"(?i)(#|//) ?sample only") -> DataFrame:
    """Adds ``ignored``: the line itself or the one before carries the directive. Lines: doc_id, line_no, line."""
    before = F.lag("line").over(Window.partitionBy("doc_id").orderBy("line_no"))
    return lines.withColumn("ignored", F.col("line").rlike(directive) | F.coalesce(before.rlike(directive), F.lit(False)))


def with_toggle(lines: DataFrame, marker: str) -> DataFrame:
    """Adds ``inside``: an odd number of markers (docstring quotes, code fences) stands on the lines before."""
    before = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("inside", F.coalesce(F.sum(F.regexp_count("line", F.lit(marker))).over(before), F.lit(0)) % 2 == 1)
