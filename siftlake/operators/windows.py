"""Chunks of long texts, their seams, continued lines, diffs and fragments of values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def windowed(chunks: DataFrame, size: int, overlap: int) -> DataFrame:
    """Texts cut into windows of ``size`` characters that overlap: window_no, base_offset (bytes) and base_line go on from the chunk's."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be less than the size")
    n = F.length(F.coalesce("text", F.lit("")))
    last = F.greatest(F.lit(0), F.ceil((n - size) / (size - overlap))).cast("int")
    rows = chunks.select("*", F.explode(F.sequence(F.lit(0), last)).alias("window_no"))
    start = F.col("window_no") * (size - overlap)
    before = F.left("text", start)
    rows = rows.withColumn("base_offset", F.col("base_offset") + F.octet_length(before)).withColumn("base_line", F.col("base_line") + F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))))
    return rows.withColumn("text", F.substring(F.col("text"), start + 1, F.lit(size)))


def once(rows: DataFrame) -> DataFrame:
    """The rows, with their columns computed once: a generator of one row stands between, so that what follows, a filter too, doesn't repeat their expressions."""
    return rows.select(F.explode(F.array(F.struct(*rows.columns))).alias("_row")).select("_row.*")


#: A character that no text holds (a noncharacter of Unicode): where a line goes on with the next. It counts as a line's end.
JOINT = "\ufdd0"
#: Characters on either side of a block that are shown beside it.
REACH = 1 << 12
MARKS = {"opened": "", "closed": "", "quotes": '"""', "fences": "(?md)^```"}


def _cut(size: int) -> str:
    """A block: what is left if that is short, else whole lines, else whole words, else up to the end of a run that could be one value."""
    least, run = size // 2, rf"[A-Za-z0-9+/_=.%&;#\\{JOINT}-]"
    return rf"(?s).{{0,{size}}}\z|.{{{least - 1},{size - 1}}}\n|.{{{least - 1},{size - 1}}}\s|.{{{size}}}{run}*+"


def line_ends(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, f"\n{JOINT}", ""))


def blocks(chunks: DataFrame, size: int, reach: int = REACH, lines: int = 0) -> DataFrame:
    """Chunks whose text is over ``size`` characters, cut into blocks, each with its surroundings; all in the row, in linear time.

    A block is some whole lines (of a line that is longer than a block, whole words), at least half of ``size``. ``text`` has up to ``reach`` characters of the blocks beside
    it (more where ``lines`` lines need them), whole lines if there are any. ``_own``: which of its characters are the block's own; every character of
    the chunk is some block's own, so that what begins in a block's own part is found once. ``_skip``: the chunk's characters before ``text``; base_line and
    base_offset go on with them, as does ``_state``, the encrypted blocks, docstring marks and fences that were begun before. Null texts give no block.
    """
    from .context import BEGIN_ENCRYPTED, END_ENCRYPTED, marked

    marks = MARKS | {"opened": BEGIN_ENCRYPTED, "closed": END_ENCRYPTED}
    columns = [c for c in chunks.columns if c not in ("text", "base_line", "base_offset")]
    n = F.length("text")
    pieces = F.when(n <= size, F.array("text")).otherwise(F.filter(F.regexp_extract_all("text", F.lit(_cut(size)), F.lit(0)), lambda x: x != ""))
    rows = once(chunks.where("text IS NOT NULL").select(*columns, "base_line", "base_offset", pieces.alias("_pieces")))
    measures = {"lines": line_ends, "bytes": F.octet_length, "chars": F.length} | {k: (lambda x, rx=rx: marked(x, rx)) for k, rx in marks.items()}
    measured = lambda x: {k: f(x).cast("long") for k, f in measures.items()}
    nothing = F.struct(*(F.lit(0).cast("long").alias(k) for k in measures))

    def step(acc: Column, piece: Column) -> Column:
        now = F.struct(*((acc["now"][k] + v).alias(k) for k, v in measured(piece).items()))
        return F.struct(now.alias("now"), F.concat(acc["all"], F.array(now)).alias("all"))

    earlier = F.slice("_pieces", F.lit(1), F.size("_pieces") - 1)  # nothing is counted in a chunk of one block
    before = F.aggregate(earlier, F.struct(nothing.alias("now"), F.array(nothing).alias("all")), step, lambda acc: acc["all"])
    rows = rows.select(*columns, "base_line", "base_offset", "_pieces", F.posexplode(before).alias("_at", "_before"))
    above, below = F.coalesce(F.get("_pieces", F.col("_at") - 1), F.lit("")), F.coalesce(F.get("_pieces", F.col("_at") + 1), F.lit(""))
    left, right = F.right(above, F.lit(reach)), F.left(below, F.lit(reach))
    if lines:
        more_left, more_right = F.substring_index(above, "\n", -(lines + 1)), F.substring_index(below, "\n", lines)
        left = F.when(F.length(more_left) > reach, more_left).otherwise(left)
        right = F.when(F.length(more_right) > reach, more_right).otherwise(right)
    # A piece of a line, or of a word, would look like one of its own.
    left = F.when(F.length(left) < F.length(above), F.when(F.contains(left, F.lit("\n")), F.regexp_replace(left, r"(?s)\A[^\n]*+\n", "")).otherwise(F.regexp_replace(left, r"\A\S++", ""))).otherwise(left)
    right = F.when(F.length(right) < F.length(below), F.regexp_replace(right, r"\n[^\n]*+\z", "\n")).otherwise(right)
    rows = once(rows.select(*columns, "base_line", "base_offset", "_before", left.alias("_left"), F.get("_pieces", F.col("_at")).alias("_piece"), right.alias("_right")))
    counted = {k: F.col("_before")[k] - v for k, v in measured(F.col("_left")).items()}
    start = F.length("_left")
    return rows.select(
        *columns,
        F.concat("_left", "_piece", "_right").alias("text"),
        (F.col("base_line") + counted["lines"]).alias("base_line"),
        (F.col("base_offset") + counted["bytes"]).alias("base_offset"),
        counted["chars"].alias("_skip"),
        F.struct(start.alias("start"), (start + F.length("_piece")).alias("end")).alias("_own"),
        F.struct(*(counted[k].alias(k) for k in marks)).alias("_state"),
    )


def seams(windows: DataFrame, width: int) -> DataFrame:
    """Between neighbouring windows of a document that don't overlap: the end of one and the beginning of the next."""
    following = F.lead("text").over(Window.partitionBy("doc_id").orderBy("window_no"))
    return windows.withColumn("_next", following).where("_next IS NOT NULL").select("doc_id", "window_no", F.concat(F.right("text", F.lit(width)), F.left("_next", F.lit(width))).alias("seam"))


def continued(lines: DataFrame, end: str = r",$") -> DataFrame:
    """Lines joined with those that they continue on: a line that ends in ``end`` goes on with the next."""
    order = Window.partitionBy("doc_id").orderBy("line_no")
    begins = F.when(F.coalesce(F.lag("line").over(order).rlike(end), F.lit(False)), 0).otherwise(1)
    rows = lines.withColumn("_new", begins).withColumn("_chain", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return rows.groupBy("doc_id", "_chain").agg(F.min("line_no").alias("line_no"), F.count("*").alias("n_lines"), F.array_join(F.transform(parts, lambda p: p["line"]), "").alias("line")).drop("_chain")


#: How a line says that it goes on, with the next line's beginning: a backslash; or a string that ends (before an operator that joins strings, or none), or a plus, where
#: the next line begins with a string.
GOES_ON = r"""(?:["'`][^\S\n]*+[+.&,]?+[^\S\n]*+)?+\\[^\S\n]*+\n[^\S\n]*+(?:[+.&]?[^\S\n]*+["'`])?+|(?:["'`][^\S\n]*+[+.&,]?+|\+)[^\S\n]*+\n[^\S\n]*+[+.&]?+[^\S\n]*+["'`]"""


#: What a line ends in that may go on.
LINE_END = r"""["'`\\+][^\S\n]*+[+.&,\\]?+[^\S\n]*+\\?+[^\S\n]*+\n"""


def folded(text: Column) -> Column:
    """The text with JOINT for each line's end at which a line goes on, and the marks and quotes around it; JSON stays as it is."""
    plain = F.translate(text, JOINT, " ")
    json = text.rlike(r"\A\s*+[\[{]") & F.try_parse_json(text).isNotNull()
    return F.when(text.rlike(GOES_ON) & ~json, F.regexp_replace(plain, GOES_ON, JOINT)).otherwise(plain)


def continuations(chunks: DataFrame, *keys: str, size: int = 1 << 15) -> DataFrame:
    """Values that are written over several lines, as one line: ``keys``, line_no (the first), n_lines and line, without the marks and quotes between.

    The lines of a text are folded in its row, so nothing is shuffled, and a chain may have any number of lines. ``chunks``: keys, text, base_line.
    """
    from .extract import spans

    chain = rf"(?md)^[^\n{JOINT}]*+{JOINT}[^\n]*+"
    ends = chunks.where(F.col("text").rlike(LINE_END))  # a quick look at what few texts have
    rows = once(ends.select(*keys, "base_line", F.lit(0).cast("long").alias("base_offset"), folded(F.col("text")).alias("text"))).where(F.contains("text", F.lit(JOINT)))
    rows = blocks(rows, size, 0).withColumn("_chains", F.regexp_extract_all("text", F.lit(chain), F.lit(0))).where(F.size("_chains") > 0)
    rows = rows.select(*keys, "text", "base_line", F.explode(spans(F.split("text", chain, -1), F.col("_chains"))).alias("_span"))
    before, found = F.left("text", F.col("_span.start")), F.col("_span.value")
    return rows.select(*keys, (F.col("base_line") + line_ends(before) + 1).alias("line_no"), (line_ends(found) + 1).cast("long").alias("n_lines"), F.replace(found, F.lit(JOINT), F.lit("")).alias("line"))


def added_lines(diff: DataFrame) -> DataFrame:
    """Added lines of unified diffs with the file and the line number there. ``diff``: doc_id, line_no, line."""
    order = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    header, hunk = F.regexp_extract("line", r"^\+\+\+ b/(.*)$", 1), F.regexp_extract("line", r"^@@ -[0-9]+(?:,[0-9]+)? \+([0-9]+)", 1)
    rows = diff.withColumn("_file", F.last(F.when(header != "", header), ignorenulls=True).over(order))
    rows = rows.withColumn("_base", F.last(F.when(hunk != "", F.struct(hunk.cast("int").alias("base"), F.col("line_no").alias("at"))), ignorenulls=True).over(order))
    held = F.when(F.col("line").rlike(r"^[+ ]") & ~F.col("line").rlike(r"^\+\+\+ "), 1).otherwise(0)
    own = Window.partitionBy("doc_id", "_base").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_before", F.coalesce(F.sum(held).over(own), F.lit(0)))
    keep = F.col("line").rlike(r"^\+") & ~F.col("line").rlike(r"^\+\+\+ ") & F.col("_base").isNotNull()
    return rows.where(keep).select("doc_id", F.col("_file").alias("path"), (F.col("_base.base") + F.col("_before")).alias("new_line"), F.substring("line", 2, 1 << 30).alias("line"))


def joined_fragments(fragments: DataFrame, near: int = 100, most: int | None = None) -> DataFrame:
    """Values of one path and name prefix whose lines are less than ``near`` apart, joined in both orders.

    The join is on path, prefix and stretches of ``near`` lines (a stretch and its neighbours), so a scope of any size is spread. ``most``: only so many last
    fragments of a scope, by (line, value), as for a bounded cache. ``fragments``: path, prefix, line, value; the same one counts once.
    """
    rows = fragments.select("path", "prefix", "line", "value").distinct()
    if most is not None:
        order = Window.partitionBy("path", "prefix").orderBy(F.desc("line"), F.desc("value"))
        rows = rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")
    stretch = F.floor(F.col("line") / near)
    own = rows.withColumn("_at", stretch)
    other = rows.select("path", "prefix", F.col("line").alias("line_b"), F.col("value").alias("value_b"), F.explode(F.array(stretch - 1, stretch, stretch + 1)).alias("_at"))
    different = (F.col("line") != F.col("line_b")) | (F.col("value") != F.col("value_b"))
    return own.join(other, ["path", "prefix", "_at"]).where(different & (F.abs(F.col("line") - F.col("line_b")) < near)).select("path", "prefix", "line", "line_b", F.concat("value", "value_b").alias("joined"))


def surrounding(lines: DataFrame, radius: int) -> DataFrame:
    """Each line with the ``radius`` lines on either side."""
    near = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(-radius, radius)
    return lines.withColumn("context", F.array_join(F.collect_list("line").over(near), "\n"))


def capped(text: Column, most: int) -> tuple[Column, Column]:
    """The first ``most`` characters of a text, and whether that cut it: for previews, never for scanning."""
    return F.left(text, F.lit(most)), F.length(text) > most
