"""Lines, spans, and candidates from chunks: patterns, generic assignments, entropy tokens, and what stands near them."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlake.functions import text as T
from siftlake.plans.detectors import ENTROPY_TOKEN, MAX_PATTERNS, SEVERITIES, Companion, Detector

from . import windows
from .context import context_of, line_at
from .suppress import hex_context

ASSIGNMENT = r"""(?i)(token|secret|password|passwd|api_?key)["']? ?[:=] ?["']?([A-Za-z0-9_+/.=-]{8,128})"""
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
IPV4 = r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b"
USERINFO = r"[a-z][a-z0-9+.-]*://([A-Za-z0-9_.-]+):([^@/ \"'\n]+)@"
TOKEN = ENTROPY_TOKEN.patterns[0].regex


def lines(chunks: DataFrame, *more: str) -> DataFrame:
    """A row for each line: doc_id (and ``more`` columns), line_no (1-based, plus the chunk's base) and line."""
    split = F.posexplode(F.split("text", "\n"))
    return chunks.select("doc_id", *more, "base_line", split.alias("_at", "line")).select("doc_id", *more, (F.col("base_line") + F.col("_at") + 1).alias("line_no"), "line")


def spans(parts: Column, found: Column) -> Column:
    """The matches of a pattern with the place of their first character, from what is between them and what they are: array of (start, value).

    Both are columns that are there already, as an expression inside a lambda would be computed for each match.
    """
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, value: string>>").alias("out"))

    def step(acc: Column, k: Column) -> Column:
        at = acc["at"] + F.length(F.get(parts, k))
        value = F.get(found, k)
        return F.struct((at + F.length(value)).alias("at"), F.concat(acc["out"], F.array(F.struct(at.alias("start"), value.alias("value")))).alias("out"))

    return F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), begin, step, lambda acc: acc["out"])


def located(chunks: DataFrame, regex: str) -> DataFrame:
    """A row for each match: doc_id, value, byte_offset and line_no, both with the chunk's base."""
    rows = chunks.withColumn("_found", F.regexp_extract_all("text", F.lit(regex), F.lit(0))).where(F.size("_found") > 0)
    rows = rows.withColumn("_parts", F.split("text", regex, -1)).select("*", F.explode(spans(F.col("_parts"), F.col("_found"))).alias("_span"))
    before = F.left("text", F.col("_span.start"))
    return rows.select("doc_id", F.col("_span.value").alias("value"), (F.col("base_offset") + F.octet_length(before)).alias("byte_offset"), (F.col("base_line") + F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).alias("line_no"))


def assignments(chunks: DataFrame) -> DataFrame:
    """Values that are assigned to a credential-like name: doc_id, line_no, keyword, value."""
    rows = lines(chunks).where(F.col("line").rlike(ASSIGNMENT))
    words, values = (F.regexp_extract_all("line", F.lit(ASSIGNMENT), F.lit(k)) for k in (1, 2))
    rows = rows.select("doc_id", "line_no", F.explode(F.arrays_zip(words.alias("keyword"), values.alias("value"))).alias("m"))
    return rows.select("doc_id", "line_no", F.lower("m.keyword").alias("keyword"), F.col("m.value").alias("value"))


def entropy_tokens(chunks: DataFrame, least: float) -> DataFrame:
    """Long tokens on lines with a credential keyword whose entropy is at least ``least`` bits."""
    rows = lines(chunks).where(F.col("line").rlike("(?i)token|secret|password|key|bearer"))
    rows = rows.select("doc_id", "line_no", F.explode(F.regexp_extract_all("line", F.lit(TOKEN), F.lit(0))).alias("value"))
    return rows.withColumn("entropy", F.round(T.shannon_entropy(F.col("value")), 6)).where(F.col("entropy") >= least)


def triggered(chunks: DataFrame, detectors: tuple[Detector, ...]) -> DataFrame:
    """Chunks with the patterns that can match them: one of the keywords and all required literals are there, in any case."""
    return chunks.select("*", F.explode(_triggered(F.lower("text"), detectors)).alias("_p")).select("*", "_p.detector_id", "_p.pattern_no").drop("_p")


def _triggered(low: Column, detectors: tuple[Detector, ...]) -> Column:
    """The patterns that can match, as (detector_id, pattern_no). A keyword is one search in generated code, whatever patterns ask for it."""
    has = {k: F.contains(low, F.lit(k)) for d in detectors for k in (*d.keywords, *(x.lower() for p in d.patterns for x in p.required))}

    def can(d: Detector, n: int) -> Column:
        return reduce(and_, (has[x.lower()] for x in d.patterns[n].required), reduce(or_, (has[k] for k in d.keywords), F.lit(False)))

    rows = (F.when(can(d, n), F.struct(F.lit(d.id).alias("detector_id"), F.lit(n).alias("pattern_no"))) for d, n in _each(detectors))
    return F.array_compact(F.array(*rows))


def _each(detectors: tuple[Detector, ...]) -> list[tuple[Detector, int]]:
    found = [(d, k) for d in detectors for k, _ in enumerate(d.patterns)]
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} patterns in one scan")
    return found


def _texts(values) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def _triggered_by_anchor(low: Column, detectors: tuple[Detector, ...]) -> Column:
    """As ``_triggered``, by a text's distinct anchors: the first three letters of each keyword. Numbers of patterns, in order.

    One pass with a look-ahead finds anchors that overlap, too, and a table in the plan says which patterns an anchor stands for; so a
    chunk's candidates are an array in its row, and nothing is joined or shuffled. Every text that holds a keyword holds its anchor, so
    nothing is lost; keywords and required literals are confirmed for the candidates only.
    """
    each = _each(detectors)
    anchors: dict[str, list[int]] = {}
    for n, (d, _) in enumerate(each):
        for k in sorted({k[:3] for k in d.keywords}):
            anchors.setdefault(k, []).append(n)
    known = sorted(anchors)
    met = F.array_distinct(F.regexp_extract_all(low, F.lit(f"(?=({'|'.join(map(re.escape, known))}))"), F.lit(1)))
    stands_for = F.array(*(F.array(*map(F.lit, anchors[k])) for k in known))
    at = lambda g: F.array_position(_texts(known), g).cast("int") - 1
    candidates = F.array_distinct(F.flatten(F.transform(met, lambda g: F.get(stands_for, at(g)))))
    keywords, required = (F.array(*(_texts(what(d, k)) for d, k in each)) for what in (lambda d, k: d.keywords, lambda d, k: [x.lower() for x in d.patterns[k].required]))
    sure = lambda n: F.exists(F.get(keywords, n), lambda k: F.contains(low, k)) & F.forall(F.get(required, n), lambda k: F.contains(low, k))
    return F.filter(candidates, sure)


def lines_needed(detectors: tuple[Detector, ...]) -> int:
    """How many lines around a match its companions may stand in."""
    return max((c.within_lines for d in detectors for c in d.companions), default=0)


def scan(chunks: DataFrame, detectors: tuple[Detector, ...], anchors: bool = False, context: bool = False, keep: tuple[str, ...] = (), window: int = 0) -> DataFrame:
    """All non-empty matches of the detectors: doc_id, path, detector_id, pattern_no, value, line_no and byte_offset.

    With ``context`` also the ``line`` of the match and the one ``above``, whether it stands ``in_hex`` digits, the class of its place, ``at``, its first character in the chunk (from 0), and ``companions``, a map of names
    to the nearest values; ``keep``: further columns of the chunks.

    A pattern's group is the value; a match whose group took no part gives no row. Without ``anchors``, patterns are literals that are
    compiled once for each task, and a chunk is tested for all keywords: right for some dozens of patterns. With them, a
    candidate's pattern is looked up in its row, so the plan stays small however many patterns there are.

    ``window``: texts of more characters are searched block by block, see ``windows.blocks``; a match is found in the block in which it begins. Keywords are looked for in the
    whole text all the same. That bounds what a match's place costs, and what it has to be near for a companion or the line around it: the blocks beside its own.
    """
    low = F.col("_low")
    rows = windows.once(chunks.withColumn("_low", F.lower("text"))) if anchors else chunks.withColumn("_low", F.lower("text"))
    rows = windows.once(rows.withColumn("_can", _triggered_by_anchor(low, detectors) if anchors else _triggered(low, detectors)).drop("_low")).where(F.size("_can") > 0)
    own = []
    if window:
        rows, own = windows.blocks(rows, window, lines=lines_needed(detectors)), ["_own", "_skip", "_state"]
    if anchors:
        each = _each(detectors)
        rows = rows.withColumn("_n", F.explode("_can")).withColumn("detector_id", F.get(_texts(d.id for d, _ in each), F.col("_n"))).withColumn("pattern_no", F.get(F.array(*(F.lit(k) for _, k in each)), F.col("_n")))
        regex = F.get(_texts(d.patterns[k].regex for d, k in each), F.col("_n"))
        group = F.get(F.array(*(F.lit(d.patterns[k].group) for d, k in each)), F.col("_n"))
        whole, inner, parts = F.regexp_extract_all("text", regex, F.lit(0)), F.regexp_extract_all("text", regex, group), F.split("text", regex, -1)
    else:
        rows = rows.withColumn("_p", F.explode("_can")).select("*", "_p.detector_id", "_p.pattern_no").drop("_p")

        def by_pattern(make) -> Column:
            out = None
            for d, n in _each(detectors):
                here, found = (F.col("detector_id") == d.id) & (F.col("pattern_no") == n), make(d.patterns[n])
                out = F.when(here, found) if out is None else out.when(here, found)
            return out

        whole = by_pattern(lambda p: F.regexp_extract_all("text", F.lit(p.regex), F.lit(0)))
        inner = by_pattern(lambda p: F.regexp_extract_all("text", F.lit(p.regex), F.lit(p.group)) if p.group else F.col("_whole"))
        parts = by_pattern(lambda p: F.split("text", p.regex, -1))
    rows = windows.once(rows.drop("_can").withColumn("_whole", whole)).where(F.size("_whole") > 0).withColumn("_inner", inner)
    rows = rows.withColumn("_parts", parts).withColumn("_spans", spans(F.col("_parts"), F.col("_whole")))
    first = lambda s, k: F.instr(s["value"], F.get("_inner", k)) - 1
    pairs = F.transform("_spans", lambda s, k: F.struct((s["start"] + first(s, k)).alias("start"), F.get("_inner", k).alias("value"), s["start"].alias("begin")))
    if window:  # the whole match's beginning decides
        pairs = F.filter(pairs, lambda m: (m["begin"] >= F.col("_own.start")) & (m["begin"] < F.col("_own.end")))
    rows = rows.select("doc_id", "path", "text", "base_line", "base_offset", "detector_id", "pattern_no", *keep, *own, F.explode(pairs).alias("m")).where("m.value <> ''")
    before = F.left("text", F.col("m.start"))
    line, state = line_at(F.col("text"), F.col("m.start")), F.col("_state") if window else None
    at = F.col("m.start") + (F.col("_skip") if window else F.lit(0))
    head = F.substring_index(before, "\n", -2)
    above = F.when(F.contains(head, F.lit("\n")), F.substring_index(head, "\n", 1)).otherwise("")
    in_hex = hex_context(F.col("text"), F.col("m.start"), F.length("m.value"))
    more = [line.alias("line"), above.alias("above"), in_hex.alias("in_hex"), context_of(line, before, F.col("path"), state).alias("context"), at.alias("at"), _companions_of(detectors, F.col("text"), F.col("m.start")).alias("companions")] if context else []
    line_no = F.col("base_line") + F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1
    return rows.select("doc_id", "path", "detector_id", "pattern_no", F.col("m.value").alias("value"), line_no.alias("line_no"), (F.col("base_offset") + F.octet_length(before)).alias("byte_offset"), *more, *keep)


def extended(text: Column, regex: str, more: str = "[A-Za-z0-9_-]*") -> Column:
    """Matches of a pattern with what goes on behind them without a break: values that a pattern of fixed length cuts short."""
    return F.regexp_extract_all(text, F.lit(f"(?:{regex})(?:{more})"), F.lit(0))


def with_detector(matches: DataFrame, detectors: tuple[Detector, ...]) -> DataFrame:
    """Adds service and severity_rank."""
    pairs = lambda f: F.create_map(*(x for d in detectors for x in (F.lit(d.id), F.lit(f(d)))))
    return matches.withColumn("service", F.element_at(pairs(lambda d: d.service), F.col("detector_id"))).withColumn("severity_rank", F.element_at(pairs(lambda d: SEVERITIES.index(d.severity)), F.col("detector_id")))


def _nearest(c: Companion, text: Column, start: Column) -> Column:
    """(distance in lines, line, value) of the companion that is nearest to the match at ``start``; null if none is within its lines."""
    above = F.substring_index(F.left(text, start), "\n", -(c.within_lines + 1))
    window = F.concat(above, F.substring_index(F.substring(text, start + 1, F.length(text)), "\n", c.within_lines + 1))
    own = F.length(above) - F.length(F.replace(above, F.lit("\n"), F.lit("")))
    values = lambda line: F.filter(F.regexp_extract_all(line, F.lit(c.regex), F.lit(c.group)), lambda v: v != "")
    found = F.transform(F.split(window, "\n"), lambda line, k: F.transform(values(line), lambda v: F.struct(F.abs(k - own).alias("away"), k.alias("line"), v.alias("value"))))
    return F.when(window.rlike(c.regex), F.array_min(F.flatten(found)))


def _companions_of(detectors: tuple[Detector, ...], text: Column, start: Column) -> Column:
    """The companions of a row's detector by name. They are looked for in the lines around the match, in its row: nothing is joined."""
    none = F.map_from_arrays(_texts([]), _texts([]))
    found = None
    for d in detectors:
        if d.companions:
            pairs = F.array(*(F.struct(F.lit(c.name).alias("name"), _nearest(c, text, start)["value"].alias("value")) for c in d.companions))
            here, value = F.col("detector_id") == d.id, F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))
            found = F.when(here, value) if found is None else found.when(here, value)
    return none if found is None else found.otherwise(none)


def with_required(rows: DataFrame, detectors: tuple[Detector, ...]) -> DataFrame:
    """Rows with a map ``companions``, but for those that lack a required one or have a forbidden one."""
    for d in detectors:
        for c in d.companions:
            if c.required or c.forbidden:
                has = F.map_contains_key("companions", F.lit(c.name))
                rows = rows.where((F.col("detector_id") != d.id) | (has if c.required else ~has))
    return rows


def near_companions(matches: DataFrame, chunks: DataFrame, detectors: tuple[Detector, ...]) -> DataFrame:
    """The nearest companion of each kind within its lines of a match: the match's columns with companion and companion_value.

    All companions are looked for in one pass over the lines of the documents that have a match which may have one.
    """
    wanted = [(d.id, c) for d in detectors for c in d.companions]
    if not wanted:
        return matches.where("false").withColumns({"companion": F.lit(""), "companion_value": F.lit("")})
    own = matches.where(F.col("detector_id").isin(*sorted({i for i, _ in wanted})))
    held = chunks.join(own.select("doc_id").distinct(), "doc_id", "left_semi")

    def of(ident: str, c) -> Column:
        row = lambda v: F.struct(F.lit(ident).alias("c_detector"), F.lit(c.name).alias("companion"), F.lit(c.within_lines).alias("within"), v.alias("companion_value"))
        return F.transform(F.regexp_extract_all("line", F.lit(c.regex), F.lit(c.group)), row)

    hits = F.flatten(F.array(*(of(i, c) for i, c in wanted)))
    near = lines(held).select(F.col("doc_id").alias("c_doc"), F.col("line_no").alias("c_line"), F.explode(hits).alias("c")).select("c_doc", "c_line", "c.*").where("companion_value <> ''")
    close = (own.doc_id == near.c_doc) & (own.detector_id == near.c_detector) & (F.abs(own.line_no - near.c_line) <= near.within)
    order = Window.partitionBy("doc_id", "detector_id", "line_no", "byte_offset", "companion").orderBy(F.abs(F.col("line_no") - F.col("c_line")), "c_line", "companion_value")
    joined = own.join(near, close).withColumn("_n", F.row_number().over(order)).where("_n = 1")
    return joined.select(*matches.columns, "companion", "companion_value")


def with_companions(matches: DataFrame, chunks: DataFrame, detectors: tuple[Detector, ...]) -> DataFrame:
    """Adds ``companions``, a map of names to values. Matches that lack a required companion, or have a forbidden one, are left out."""
    key = ["doc_id", "detector_id", "line_no", "byte_offset"]
    pairs = F.array_sort(F.collect_set(F.struct("companion", "companion_value")))
    found = near_companions(matches, chunks, detectors).groupBy(*key).agg(F.map_from_entries(pairs).alias("companions"))
    rows = matches.join(found, key, "left").select(*matches.columns, F.coalesce("companions", F.map_from_arrays(_texts([]), _texts([]))).alias("companions"))
    return with_required(rows, detectors)


def companions(matches: DataFrame, chunks: DataFrame, detectors: tuple[Detector, ...]) -> DataFrame:
    """A row for each match and companion that it has (null without any): matches with companion and companion_value; see ``with_companions``."""
    rows = with_companions(matches, chunks, detectors)
    return rows.select(*matches.columns, F.explode_outer("companions").alias("companion", "companion_value"))


def related(matches: DataFrame, other: DataFrame, within_lines: int, how: str, within_bytes: int | None = None, direction: str = "any") -> DataFrame:
    """Matches with (``requires``) or without (``conflicts``, ``subsumes``) one of ``other`` in the same document, near and on the side that is wanted."""
    b = other.select(F.col("doc_id").alias("_doc"), F.col("line_no").alias("_line"), F.col("byte_offset").alias("_byte"))
    near = (matches.doc_id == b["_doc"]) & (F.abs(matches.line_no - b["_line"]) <= within_lines)
    if within_bytes is not None:
        near = near & (F.abs(matches.byte_offset - b["_byte"]) <= within_bytes)
    if direction != "any":
        near = near & ((b["_byte"] < matches.byte_offset) if direction == "before" else (b["_byte"] > matches.byte_offset))
    return matches.join(b, near, {"requires": "left_semi", "conflicts": "left_anti", "subsumes": "left_anti"}[how])


def with_relations(matches: DataFrame, detectors: tuple[Detector, ...]) -> DataFrame:
    """Applies the detectors' relations, each to the matches as they were found, within a document and path.

    One pass, however many relations there are: matches that take part in one are dealt to stretches of lines, a match as itself to its own stretch and as a neighbour to
    those beside it. In a stretch the nearest of the other detectors' matches on either side decide, as running maxima in the order of bytes (or of lines, where
    a relation asks for nothing else). No pairs are made, and a document is as many groups as it has stretches. A match without a byte offset satisfies no
    relation that asks for bytes or a side.
    """
    every = [(d.id, r) for d in detectors for r in d.relations]
    if not every:
        return matches
    width = max(r.within_lines for _, r in every) + 1
    involved = sorted({i for i, _ in every} | {r.detector for _, r in every})
    others = sorted({r.detector for _, r in every})
    stretch = F.floor(F.col("line_no") / width)
    places = F.when(F.col("detector_id").isin(*others), F.array(stretch, stretch - 1, stretch + 1)).when(F.col("detector_id").isin(*involved), F.array(stretch)).otherwise(F.array(F.lit(None).cast("long")))
    # Matches that take part in none pass by themselves: each to a group of its own.
    alone = F.when(~F.col("detector_id").isin(*involved), F.monotonically_increasing_id())
    rows = matches.withColumn("_alone", alone).select("*", stretch.alias("_stretch"), F.explode(places).alias("_place"))
    near = Window.partitionBy("doc_id", "path", "_place", "_alone")
    by_byte, by_byte_down = near.orderBy("byte_offset"), near.orderBy(F.col("byte_offset").desc())
    by_line, by_line_down = near.orderBy("line_no"), near.orderBy(F.col("line_no").desc())
    upto, strictly = (Window.unboundedPreceding, 0), (Window.unboundedPreceding, -1)
    faults = []
    for ident, r in every:
        other = F.col("detector_id") == r.detector
        place = F.when(other & F.col("byte_offset").isNotNull(), F.struct("byte_offset", "line_no"))
        if r.within_bytes is None and r.direction == "any":
            above, below = F.max(F.when(other, F.col("line_no"))).over(by_line.rangeBetween(*upto)), F.min(F.when(other, F.col("line_no"))).over(by_line_down.rangeBetween(*upto))
            met = F.coalesce(F.col("line_no") - above <= r.within_lines, F.lit(False)) | F.coalesce(below - F.col("line_no") <= r.within_lines, F.lit(False))
        else:
            reach = upto if r.direction == "any" else strictly
            sides = {"before": F.max(place).over(by_byte.rangeBetween(*reach)), "after": F.min(place).over(by_byte_down.rangeBetween(*reach))}
            met = F.lit(False)
            for side, found in sides.items():
                if r.direction in ("any", side):
                    close = F.abs(F.col("line_no") - found["line_no"]) <= r.within_lines
                    if r.within_bytes is not None:
                        close = close & (F.abs(F.col("byte_offset") - found["byte_offset"]) <= r.within_bytes)
                    met = met | F.coalesce(close & F.col("byte_offset").isNotNull(), F.lit(False))
        faults.append((F.col("detector_id") == ident) & (~met if r.kind == "requires" else met))
    judged = rows.withColumn("_fault", reduce(or_, faults))
    return judged.where(((F.col("_place") == F.col("_stretch")) | F.col("_place").isNull()) & ~F.col("_fault")).select(*matches.columns)


def attributed(hits: DataFrame, segments: DataFrame) -> DataFrame:
    """Hits (doc_id, start, end) with the segment (doc_id, seg_no, seg_start, seg_end) that holds all of them; hits over a border go."""
    inside = (F.col("start") >= F.col("seg_start")) & (F.col("end") <= F.col("seg_end"))
    return hits.join(segments, "doc_id").where(inside)
