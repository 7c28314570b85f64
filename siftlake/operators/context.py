"""Where a match stands: comments, documentation, tests, encrypted blocks, assignments; roles of lines in documents."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlake.functions import text as T

COMMENT = r"^\s*(?:#|//|/\*|\*|--|;|<!--|%)"
ASSIGNED = r"""[A-Za-z0-9_\])"'-]\s*(?::=|=>|=|:)\s*["']?\S"""
TEST_PATH = r"(^|/)(tests?|specs?|__tests__|fixtures?|testdata)(/|$)|(^|/)test_[^/]*$|[._-](test|spec)\.[A-Za-z]+$"
DOCUMENTATION_PATH = r"(^|/)docs?(/|$)|(^|/)(readme|changelog|contributing|license)[^/]*$|\.(md|rst|adoc)$"
BEGIN_ENCRYPTED, END_ENCRYPTED = r"-----BEGIN PGP MESSAGE-----|\$ANSIBLE_VAULT;", r"-----END PGP MESSAGE-----"

#: What a text must hold for a mark to be in it: a search that is quicker than the mark's pattern.
SIGNS = {BEGIN_ENCRYPTED: ("-----BEGIN PGP MESSAGE-----", "$ANSIBLE_VAULT;"), END_ENCRYPTED: ("-----END PGP MESSAGE-----",), '"""': ('"""',), "(?md)^```": ("```",)}


def marked(text: Column, mark: str) -> Column:
    """How often a mark stands in a text."""
    return F.when(reduce(or_, (F.contains(text, F.lit(x)) for x in SIGNS[mark])), F.regexp_count(text, F.lit(mark))).otherwise(0)


def context_of(line: Column, before: Column, path: Column, state: Column | None = None) -> Column:
    """The class of the place of a match: ``line`` holds it, ``before`` is the text that ends where it begins; ``state``: the marks that came before that, if it is a block's.

    In order: an encrypted block that is open, a test's path, documentation (its path, an open docstring or code fence), a comment, an assignment, a quoted
    string, unknown.
    """
    low = F.lower(F.coalesce(path, F.lit("")))
    marks = lambda name, rx: marked(before, rx) + (F.lit(0) if state is None else state[name])
    opened = marks("opened", BEGIN_ENCRYPTED) > marks("closed", END_ENCRYPTED)
    quoted = (marks("quotes", '"""') % 2 == 1) | (marks("fences", "(?md)^```") % 2 == 1)
    return (
        F.when(opened, "encrypted")
        .when(low.rlike(TEST_PATH), "test")
        .when(low.rlike(DOCUMENTATION_PATH) | quoted, "documentation")
        .when(line.rlike(COMMENT), "comment")
        .when(line.rlike(ASSIGNED), "assignment")
        .when(line.rlike("[\"'`]"), "string")
        .otherwise("unknown")
    )


def line_contexts(lines: DataFrame, path: Column) -> DataFrame:
    """Adds ``context`` to whole lines (doc_id, line_no, line): the same classes, with running counts of the marks on the lines before."""
    before = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    count = lambda rx: F.coalesce(F.sum(F.regexp_count("line", F.lit(rx))).over(before), F.lit(0))
    low = F.lower(F.coalesce(path, F.lit("")))
    rows = lines.withColumn("_open", count(BEGIN_ENCRYPTED) > count(END_ENCRYPTED)).withColumn("_quoted", (count('"""') % 2 == 1) | (count("^```") % 2 == 1))
    found = F.when(F.col("_open"), "encrypted").when(low.rlike(TEST_PATH), "test").when(low.rlike(DOCUMENTATION_PATH) | F.col("_quoted"), "documentation")
    found = found.when(F.col("line").rlike(COMMENT), "comment").when(F.col("line").rlike(ASSIGNED), "assignment").when(F.col("line").rlike("[\"'`]"), "string").otherwise("unknown")
    return rows.withColumn("context", found).drop("_open", "_quoted")


#: Roles of lines outside of code fences, in order: the first whose pattern fits.
ROLES = (("roff", r"^\.(?:TH|SH|SS|TP|PP|B|I|BR|IR)(?:\s|$)"), ("shell", r"^\s*(?:\$|#!|>>>) ?\S"), ("heading", r"^#{1,6} \S"), ("list", r"^\s*(?:[-*+]|[0-9]+\.) \S"), ("prose", r"^(?:[^\s={}<>;]+ ){5}[^={}<>;]*[^\s={}<>;]$"), ("blank", r"^\s*$"))


def line_roles(lines: DataFrame) -> DataFrame:
    """Adds ``role``: fence for a fence's marks and what is inside, else one of ROLES, or code."""
    here = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    mark = F.col("line").rlike("^```")
    rows = lines.withColumn("_marks", F.sum(F.when(mark, 1).otherwise(0)).over(here))
    outside = F.coalesce(*(F.when(F.col("line").rlike(rx), name) for name, rx in ROLES), F.lit("code"))
    return rows.withColumn("role", F.when(mark | (F.col("_marks") % 2 == 1), "fence").otherwise(outside)).drop("_marks")


def role_spans(lines: DataFrame) -> DataFrame:
    """Runs of lines of one role: doc_id, role, first_line, last_line."""
    order = Window.partitionBy("doc_id").orderBy("line_no")
    rows = line_roles(lines)
    new = F.when(F.lag("role").over(order) == F.col("role"), 0).otherwise(1)
    rows = rows.withColumn("_new", new).withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("doc_id", "role", "_run").agg(F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line")).drop("_run")


def names_service(context: Column, services: tuple[str, ...]) -> Column:
    """Sorted services that the words of a context name; empty if none."""
    words = F.regexp_extract_all(F.lower(context), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_sort(F.array_intersect(F.array(*map(F.lit, sorted(set(services)))), words))


def bounded_words(value: Column, words: tuple[str, ...]) -> Column:
    """One of the words stands in the value as a word of its own: neither letter nor digit beside it, or a change of case."""
    plain = reduce(lambda a, b: f"{a}|{b}", map(re.escape, words))
    return F.lower(value).rlike(f"(?:^|[^a-z0-9])(?:{plain})(?:$|[^a-z0-9])") | value.rlike(f"[a-z0-9](?:{'|'.join(re.escape(w.capitalize()) for w in words)})(?:$|[^a-z])")


def surroundings(text: Column, start: Column, value: Column, most: int = 8192) -> Column:
    """The line of a match and what stands around it on either side, up to ``most`` characters."""
    return F.substring(text, F.greatest(start - most // 2 + 1, F.lit(1)), F.length(value) + most)


def line_at(text: Column, start: Column) -> Column:
    """The line that holds character ``start`` (from 0)."""
    return F.concat(F.substring_index(F.left(text, start), "\n", -1), F.substring_index(F.substring(text, start + 1, F.length(text)), "\n", 1))


def fixture_value(value: Column, exact: tuple[str, ...] = (), parts: tuple[str, ...] = ()) -> Column:
    """The value is a listed fixture, or holds a listed part."""
    found = value.isin(*exact) if exact else F.lit(False)
    return reduce(lambda a, p: a | F.contains(value, F.lit(p)), parts, found)


def decoded_benign(value: Column) -> Column:
    """A base64 value that says plain text of several words: nothing secret, but a message."""
    from siftlake.functions.codecs import decode_base64

    said = decode_base64(F.when(F.length(value) >= 12, value))
    return F.coalesce(said.rlike(r"^[\x20-\x7e\n\t]+$") & (F.size(F.split(said, " ")) >= 3) & ~said.rlike("[0-9]{4,}"), F.lit(False))


def mirrored_placeholder(value: Column) -> Column:
    """Backwards it is a placeholder."""
    from .score import is_placeholder

    return is_placeholder(F.reverse(value))


def decoded_suppression(value: Column, around: Column, named: Column) -> Column:
    """Why a match in decoded text is dropped: an unnamed detector's value of low entropy, an example around it, a placeholder backwards; null: it isn't."""
    from .score import is_placeholder

    return F.when(~named & (T.byte_entropy(value) < 4.0), "decoded_entropy_unanchored").when(is_placeholder(around), "decoded_parent_example").when(mirrored_placeholder(value), "decoded_reversed_placeholder")
