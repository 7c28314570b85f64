"""Decode-through: encoded blobs in chunks become chunks of their own, again and again, to a bounded depth."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlake.functions import codecs as C
from siftlake.storage import stored

from . import windows

WORD = r"\S{8,}"
#: Decoders in order: the shape of a blob, what else it must show (null: nothing), and what it says. A decoder gives null where a blob isn't one.
#: Those of detectors' prefixes, reverse and caesar, are made by ``for_prefixes``.
DECODERS: dict[str, tuple[str, str | None, Callable[[Column], Column]]] = {
    "base64": (r"[A-Za-z0-9+/_-]{12,}={0,2}", None, C.decode_base64),
    "hex": (r"(?:[0-9a-fA-F]{2}){8,}", None, C.decode_hex),
    "url": (r"(?<![A-Za-z0-9._~%-])(?:[A-Za-z0-9._~-]|%(?![0-9A-Fa-f]{2}))*+%[0-9A-Fa-f]{2}[A-Za-z0-9._~%-]*+", None, C.decode_url),
    "quoted-printable": (WORD, "=[0-9A-F]{2}.*=[0-9A-F]{2}", lambda v: quoted_printable(v)),
    "html-named-entity": (WORD, "&(?:lt|gt|quot|apos|amp);", lambda v: named_entities(v)),
    "html-numeric-entity": (WORD, "&#[xX]?[0-9a-fA-F]{1,7};.*&#[xX]?[0-9a-fA-F]{1,7};", lambda v: numeric_entities(v)),
    "octal-escape": (WORD, r"\\[0-3][0-7]{2}.*\\[0-3][0-7]{2}", lambda v: octal_escapes(v)),
    "mime-encoded-word": (r"=\?[uU][tT][fF]-8\?[bB]\?[A-Za-z0-9+/=]+\?=", None, lambda v: mime_words(v)),
    "json": (r'"(?:[^"\\\n]|\\.){8,}+"', r"\\", lambda v: C.decode_json_escapes(F.substring(v, F.lit(2), F.length(v) - 2))),
    "unicode-escape": (WORD, r"\\(?:u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2})", lambda v: unicode_escapes(v)),
    "z85": (r"[0-9A-Za-z.:+=^!/*?&<>()\[\]{}@%$#-]{20,}", None, lambda v: z85(v)),
    "javascript-static": (r"""atob\(['"][A-Za-z0-9+/=]{8,}['"](?:\.split\(['"]{2}\)\.reverse\(\)\.join\(['"]{2}\))?\)""", None, lambda v: javascript_static(v)),
    "reverse": (r"[A-Za-z0-9_-]{16,}", None, F.reverse),
    "base32": (r"[A-Z2-7]{16,}={0,6}", None, C.decode_base32),
}
#: Those that a scan uses; base32 is there, but not among them.
DEFAULT = tuple(d for d in DECODERS if d != "base32")
#: Characters of the parent's text on either side of a blob that go into the child's text.
AROUND = 512
#: Characters of a text that are searched for blobs at once, and before a blob that may name it.
WINDOW, NAME = 1 << 15, 64
CHUNK = ("doc_id", "path", "text", "base_line", "base_offset")


def for_prefixes(prefixes: tuple[str, ...]) -> dict[str, tuple[str, str | None, Callable[[Column], Column]]]:
    """Reverse and Caesar decoders for tokens that hold a known prefix backwards, or shifted by 1 to 25 letters."""
    known = [p for p in prefixes if len(p) >= 3]
    if not known:
        return {}
    turn = lambda p, s: p.translate(str.maketrans(LOW + LOW.upper(), LOW[s:] + LOW[:s] + LOW[s:].upper() + LOW[:s].upper()))
    shifted = {s: "|".join(re.escape(turn(p, s)) for p in known if turn(p, s) != p) for s in range(1, 26)}

    def back(value: Column) -> Column:
        return F.coalesce(*(F.when(value.rlike(shifted[s]), C.caesar(value, 26 - s)) for s in shifted if shifted[s]))

    return {
        "reverse": (r"[A-Za-z0-9_-]{16,}", "|".join(re.escape(p[::-1]) for p in known), F.reverse),
        "caesar": (r"[A-Za-z0-9_-]{16,}", "|".join(x for x in shifted.values() if x), back),
    }


def _blobs(decoders: dict) -> Column:
    """The blobs of ``text`` that a decoder takes: array of (decoder, blob, decoded)."""

    def of(name: str) -> Column:
        regex, sign, decode = decoders[name]
        found = F.array_distinct(F.regexp_extract_all("text", F.lit(regex), F.lit(0)))
        if sign:  # a text without the sign isn't cut into words at all
            found = F.when(F.col("text").rlike(f"(?s){sign}"), F.filter(found, lambda b: b.rlike(sign)))
        made = F.transform(found, lambda b: F.struct(F.lit(name).alias("decoder"), b.alias("blob"), decode(b).alias("decoded")))
        return F.coalesce(F.filter(made, lambda c: c["decoded"].isNotNull() & (c["decoded"] != "") & (c["decoded"] != c["blob"])), F.array().cast("array<struct<decoder: string, blob: string, decoded: string>>"))

    return F.concat(*map(of, decoders))


def _chosen(decoders) -> dict:
    return dict(decoders) if isinstance(decoders, dict) else {d: DECODERS[d] for d in decoders}


def children(chunks: DataFrame, decoders, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Chunks (``keys``, depth, via, text) made of the blobs in ``chunks``: one for each different decoded text, with the decoder in ``via``."""
    rows = chunks.select(*keys, "depth", "via", F.explode(_blobs(_chosen(decoders))).alias("c"))
    fresh = rows.select(*keys, (F.col("depth") + 1).alias("depth"), F.concat_ws("/", F.when(F.col("via") != "", F.col("via")), F.col("c.decoder")).alias("via"), F.col("c.decoded").alias("text"))
    return fresh.groupBy(*keys, "depth", "text").agg(F.min("via").alias("via")).select(*keys, "depth", "via", "text")


def decode_through(chunks: DataFrame, depth: int, decoders=DEFAULT, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """All chunks that decoding reaches in up to ``depth`` steps, the given ones left out; a text that a smaller depth had isn't decoded again.

    A plan of ``depth`` unions; depth is small.
    """
    level, out = chunks.select(*keys, F.lit(0).alias("depth"), F.lit("").alias("via"), "text"), None
    for _ in range(depth):
        level = children(level, decoders, keys)
        if out is not None:
            both = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in (*keys, "text")]
            level = level.alias("a").join(out.select(*keys, "text").alias("b"), both, "left_anti")
        out = level if out is None else out.unionByName(level)
    return out


def _placed(rows: DataFrame, decoders: dict, columns: list[str]) -> DataFrame:
    """A row for each blob of ``text`` that a decoder takes, every place of one that repeats: ``columns`` and c (decoder, blob, decoded, start).

    In steps whose columns are computed once, as an expression inside a lambda would be computed for each blob: first what the shapes find says, then the texts are cut at a
    shape only where one of its blobs is taken.
    """

    def of(name: str) -> Column:
        regex, sign, decode = decoders[name]
        found = F.regexp_extract_all("text", F.lit(regex), F.lit(0))
        if sign and regex == WORD:  # most of a text is words: one without the sign isn't cut into them at all
            found = F.when(F.col("text").rlike(f"(?s){sign}"), found)
        said = F.transform(found, lambda b: F.struct(b.alias("blob"), (F.when(b.rlike(sign), decode(b)) if sign else decode(b)).alias("decoded")))
        told = F.transform(said, lambda c: F.struct(c["blob"].alias("blob"), F.when((c["decoded"] != "") & (c["decoded"] != c["blob"]), c["decoded"]).alias("decoded")))
        return F.struct(F.lit(name).alias("decoder"), told.alias("all"))

    rows = windows.once(rows.select(*columns, F.array(*map(of, decoders)).alias("_all")))
    rows = rows.select(*columns, F.explode(F.filter("_all", lambda x: F.exists(x["all"], lambda c: c["decoded"].isNotNull()))).alias("_x"))
    parts = F.coalesce(*(F.when(F.col("_x.decoder") == name, F.split("text", regex, -1)) for name, (regex, _, _) in decoders.items()))
    rows = windows.once(rows.select(*columns, F.col("_x.decoder").alias("_decoder"), F.col("_x.all").alias("_told"), parts.alias("_parts")))
    kind = "array<struct<decoder: string, blob: string, decoded: string, start: int>>"

    def step(acc: Column, k: Column) -> Column:
        at, one = acc["at"] + F.length(F.get("_parts", k)), F.get("_told", k)
        here = F.struct(F.col("_decoder").alias("decoder"), one["blob"].alias("blob"), one["decoded"].alias("decoded"), at.alias("start"))
        return F.struct((at + F.length(one["blob"])).alias("at"), F.when(one["decoded"].isNotNull(), F.concat(acc["out"], F.array(here))).otherwise(acc["out"]).alias("out"))

    begin = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))
    return rows.select(*columns, F.explode(F.aggregate(F.sequence(F.lit(0), F.size("_told") - 1), begin, step, lambda acc: acc["out"])).alias("c"))


def spliced(chunks: DataFrame, decoders, around: int = AROUND, window: int = WINDOW) -> DataFrame:
    """Chunks in which a blob is replaced by what it says, with its surroundings: doc_id, path, text, base_line, base_offset, via, span and parent.

    ``base_line`` and ``base_offset`` are those of the text's beginning in the root, so that what is found before or in the blob has the
    blob's place; each place of a blob that repeats gives a chunk. ``span``: where the decoded text stands in ``text`` (characters from 0, end exclusive). ``parent``: what
    stands before the blob on its line, up to NAME characters. Of chunks that are decoded themselves, only blobs that reach into their span count. What several decoders read
    alike at one place is one chunk, under the first decoder. Texts of over ``window`` characters are read block by block, so their length is no limit.
    """
    again = "via" in chunks.columns
    more = ["via", "span"] if again else []
    rows = windows.blocks(chunks.select(*CHUNK, *more), window, max(around, windows.REACH))
    rows = _placed(rows, _chosen(decoders), [*CHUNK, *more, "_own", "_skip"]).where((F.col("c.start") >= F.col("_own.start")) & (F.col("c.start") < F.col("_own.end")))
    if again:
        rows = rows.where((F.col("_skip") + F.col("c.start") < F.col("span.end")) & (F.col("_skip") + F.col("c.start") + F.length("c.blob") > F.col("span.start")))
    rows = rows.withColumn("_at", F.col("c.start")).withColumn("_from", F.greatest(F.lit(0), F.col("_at") - around))
    before, skipped = F.substring("text", F.col("_from") + 1, F.col("_at") - F.col("_from")), F.left("text", F.col("_from"))
    after = F.substring("text", F.col("_at") + F.length("c.blob") + 1, F.lit(around))
    return rows.select(
        "doc_id",
        "path",
        F.concat(before, F.col("c.decoded"), after).alias("text"),
        (F.col("base_line") + F.length(skipped) - F.length(F.replace(skipped, F.lit("\n"), F.lit("")))).alias("base_line"),
        (F.col("base_offset") + F.octet_length(skipped)).alias("base_offset"),
        F.concat_ws("/", F.when(F.col("via") != "", F.col("via")) if again else F.lit(None).cast("string"), F.col("c.decoder")).alias("via"),
        F.struct((F.col("_at") - F.col("_from")).alias("start"), (F.col("_at") - F.col("_from") + F.length("c.decoded")).alias("end")).alias("span"),
        F.substring_index(F.right(before, F.lit(NAME)), "\n", -1).alias("parent"),
    )


def splice_through(chunks: DataFrame, depth: int, decoders=DEFAULT) -> DataFrame:
    """Spliced chunks of up to ``depth`` steps with their depth. All in the row: nothing is shuffled. What is decoded further is stored, as two plans read it."""
    level, out = chunks.select(*CHUNK), None
    for k in range(1, depth + 1):
        level = spliced(level, decoders) if k == depth else stored(spliced(level, decoders), "spliced")
        out = level.withColumn("depth", F.lit(k)) if out is None else out.unionByName(level.withColumn("depth", F.lit(k)))
    return out


def screened(text: Column) -> Column:
    """Decoded text that is worth a scan: no zero character, and a run that a value could be. What fails is still decoded further."""
    return ~F.contains(text, F.lit("\0")) & text.rlike("[A-Za-z0-9_+/=.-]{8,}")


def within_decode_limit(chunks: DataFrame, most: int = 1 << 20) -> tuple[DataFrame, DataFrame]:
    """Chunks of up to ``most`` characters, and coverage rows (doc_id, path, reason, n_chars) for the others: for callers with a budget of their own. Scans decode all."""
    n = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    return chunks.where(n <= most), chunks.where(n > most).select("doc_id", "path", F.lit("not_decoded").alias("reason"), n.alias("n_chars"))


def admitted(rows: DataFrame, most: int, most_chars: int) -> tuple[DataFrame, DataFrame]:
    """Decoded chunks (doc_id, depth, via, text) within the caps of each root, and what was cut: doc_id, n_cut. For reports that need a bound; scans take all.

    In the order of depth, way and text; of each root the first ``most``, and those whose characters together are at most ``most_chars``.
    """
    order = Window.partitionBy("doc_id").orderBy("depth", "via", "text")
    total = F.sum(F.length("text").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    placed = rows.withColumn("_in", (F.row_number().over(order) <= most) & (total <= most_chars))
    return placed.where("_in").drop("_in"), placed.where("NOT _in").groupBy("doc_id").agg(F.count("*").alias("n_cut"))


LOW = "abcdefghijklmnopqrstuvwxyz"


def caesar_hits(chunks: DataFrame, prefixes: tuple[str, ...]) -> DataFrame:
    """Texts in which a known prefix stands shifted by 1 to 25 letters: shift and prefix. Only shifted prefixes are looked for."""
    shifted = [(s, p) for s in range(1, 26) for p in prefixes]
    turn = lambda p, s: p.translate(str.maketrans(LOW + LOW.upper(), LOW[s:] + LOW[:s] + LOW[s:].upper() + LOW[:s].upper()))
    found = F.filter(F.array(*(F.struct(F.lit(s).alias("shift"), F.lit(p).alias("prefix"), F.lit(turn(p, s)).alias("shown")) for s, p in shifted)), lambda x: F.contains("text", x["shown"]))
    return chunks.select("doc_id", F.explode(found).alias("x")).select("doc_id", "x.shift", "x.prefix")


def inflate(chunks: DataFrame, most: int = 1 << 24) -> DataFrame:
    """``payload`` (gzip or zlib bytes) of each row as ``text``, up to ``most`` bytes; ``state``: inflated, truncated or invalid."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zlib

        for frame in frames:
            out = []
            for doc_id, payload in zip(frame["doc_id"], frame["payload"], strict=True):
                try:
                    worker = zlib.decompressobj(47)
                    data = worker.decompress(bytes(payload), most)
                    out.append((doc_id, data.decode("utf-8", "replace"), "inflated" if worker.eof else "truncated"))
                except (zlib.error, TypeError):
                    out.append((doc_id, None, "invalid"))
            yield pd.DataFrame(out, columns=["doc_id", "text", "state"])

    return chunks.select("doc_id", "payload").mapInPandas(run, "doc_id long, text string, state string")


#: The digits of Z85.
Z85 = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ.-:+=^!/*?&<>()[]{}@%$#"


def _numbered(text: Column, regex: str, base: int) -> Column:
    """Every match's number (in group 1) as the character with that code; what stands between stays."""
    parts, codes = F.split(text, regex, -1), F.regexp_extract_all(text, F.lit(regex), F.lit(1))
    letter = lambda code: F.decode(F.unhex(F.lpad(F.conv(code, base, 16), 8, "0")), "UTF-32")
    return F.array_join(F.transform(F.arrays_zip(parts.alias("p"), codes.alias("c")), lambda x: F.concat(x["p"], F.coalesce(letter(x["c"]), F.lit("")))), "")


def named_entities(text: Column) -> Column:
    """Named entities of the common kind; the ampersand's last, so that nothing is read twice."""
    for name, letter in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&")):
        text = F.replace(text, F.lit(f"&{name};"), F.lit(letter))
    return text


def numeric_entities(text: Column) -> Column:
    return _numbered(_numbered(text, "&#([0-9]{1,7});", 10), "&#[xX]([0-9a-fA-F]{1,6});", 16)


def html_entities(text: Column) -> Column:
    """Numeric entities, decimal and hexadecimal, and named ones of the common kind."""
    return named_entities(numeric_entities(text))


#: A surrogate pair that is written as two escapes: its groups are the ten low bits of each, in hexadecimal digits of the whole.
_PAIR = r"\\u([dD][89abAB][0-9a-fA-F]{2})\\u([dD][c-fC-F][0-9a-fA-F]{2})"


def _joined_pairs(text: Column) -> Column:
    """Surrogate pairs as one escape in braces, ``\\u{1f600}``."""
    code = lambda x: F.conv(x, 16, 10).cast("long")
    parts, high, low = F.split(text, _PAIR, -1), F.regexp_extract_all(text, F.lit(_PAIR), F.lit(1)), F.regexp_extract_all(text, F.lit(_PAIR), F.lit(2))
    whole = lambda h, w: F.concat(F.lit("\\u{"), F.lower(F.hex((code(h) - 0xD800) * 0x400 + code(w) - 0xDC00 + 0x10000)), F.lit("}"))
    zipped = F.arrays_zip(parts.alias("p"), high.alias("h"), low.alias("w"))
    return F.when(text.rlike(_PAIR), F.array_join(F.transform(zipped, lambda x: F.concat(x["p"], F.coalesce(whole(x["h"], x["w"]), F.lit("")))), "")).otherwise(text)


def unicode_escapes(text: Column) -> Column:
    r"""``\uXXXX``, also in surrogate pairs, ``\u{X}`` and ``\xNN``."""
    found = _numbered(_joined_pairs(text), r"\\u\{([0-9a-fA-F]{1,6})\}", 16)
    return _numbered(_numbered(found, r"\\u([0-9a-fA-F]{4})", 16), r"\\x([0-9a-fA-F]{2})", 16)


def javascript_static(text: Column) -> Column:
    """What ``atob("…")`` gives, also where the string is turned round by split, reverse and join; null for other code."""
    inner = F.regexp_extract(text, r"""['"]([A-Za-z0-9+/=]{8,})['"]""", 1)
    return C.decode_base64(F.when(F.contains(text, F.lit(".reverse()")), F.reverse(inner)).otherwise(inner))


def octal_escapes(text: Column) -> Column:
    return _numbered(text, r"\\([0-3][0-7]{2})", 8)


def quoted_printable(text: Column) -> Column:
    """Soft line breaks go; coded bytes, read as UTF-8, come back."""
    return F.try_url_decode(F.regexp_replace(F.replace(F.replace(F.regexp_replace(text, "=\r?\n", ""), F.lit("%"), F.lit("%25")), F.lit("+"), F.lit("%2B")), "=([0-9A-F]{2})", "%$1"))


def mime_words(text: Column) -> Column:
    """The text of a MIME word in base64 and UTF-8; null if it isn't one."""
    return C.decode_base64(F.nullif(F.regexp_extract(text, r"^=\?[uU][tT][fF]-8\?[bB]\?([A-Za-z0-9+/=]+)\?=$", 1), F.lit("")))


def z85(text: Column) -> Column:
    """Text of a Z85 value; null if it isn't one."""
    # Group by group, so that a long value costs its length only.
    value = lambda five: F.aggregate(F.sequence(F.lit(1), F.lit(5)), F.lit(0).cast("long"), lambda acc, p: acc * 85 + F.instr(F.lit(Z85), F.substring(five, p, F.lit(1))) - 1)
    hexes = F.array_join(F.transform(F.regexp_extract_all(text, F.lit(".{5}"), F.lit(0)), lambda five: F.lpad(F.hex(value(five)), 8, "0")), "")
    good = (F.length(text) >= 5) & (F.length(text) % 5 == 0) & (F.translate(text, Z85, "") == "")
    return F.when(good, F.try_validate_utf8(F.unhex(hexes).cast("string")))
