"""Files, archives, pages, captures and key-value files as chunks; what isn't read is told in coverage rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from siftlake.operators.suppress import glob_regex

#: First bytes of file formats, in hex.
MAGIC = (("gzip", "1F8B"), ("zstd", "28B52FFD"), ("xz", "FD377A585A00"), ("lz4", "04224D18"), ("bzip2", "425A68"), ("zip", "504B0304"), ("pdf", "25504446"), ("wasm", "0061736D"), ("exe", "4D5A"), ("elf", "7F454C46"), ("bmp", "424D"), ("png", "89504E47"))
SKIPPED_EXTENSIONS = ("png", "jpg", "jpeg", "gif", "ico", "woff", "woff2", "ttf", "mp3", "mp4", "lock", "map")
SKIPPED_FOLDERS = ("node_modules", ".git", "vendor", "target", "dist", "__pycache__")


def magic(content: Column) -> Column:
    """Name of the format that the first bytes tell; null if none."""
    head = F.hex(F.substring(content, 1, 8))
    return F.coalesce(*(F.when(F.startswith(head, F.lit(h)), name) for name, h in MAGIC))


#: Formats whose bytes aren't text, and the share of control characters beyond which bytes are none.
PACKED = ("gzip", "zstd", "xz", "lz4", "bzip2", "zip", "pdf", "wasm", "elf", "png")
MOST_CONTROLS = 0.05
_CONTROLS = "".join(map(chr, [*range(9), 11, *range(14, 27), *range(28, 32), 127]))


def wide(content: Column) -> Column:
    """How bytes are written in UTF-16: ``UTF-16`` with a byte-order mark, ``UTF-16LE`` or ``UTF-16BE`` if every other of the first bytes is zero; null if they aren't."""
    head = F.hex(F.substring(content, 1, 64))
    marked = F.startswith(head, F.lit("FFFE")) | F.startswith(head, F.lit("FEFF"))
    return F.when(marked, "UTF-16").when(head.rlike("^(?:(?!00)..00){4,}(?:..)?$"), "UTF-16LE").when(head.rlike("^(?:00(?!00)..){4,}(?:..)?$"), "UTF-16BE")


def looks_binary(content: Column) -> Column:
    """A packed format, or too many control characters among all bytes. Text in UTF-16 is none, nor is one with bytes that aren't UTF-8, or a zero byte here and there."""
    bytes_ = F.decode(content, "ISO-8859-1")
    controls = F.length(bytes_) - F.length(F.translate(bytes_, _CONTROLS, ""))
    return F.coalesce(wide(content).isNull() & (magic(content).isin(*PACKED) | (controls > MOST_CONTROLS * F.length(bytes_))), F.lit(False))


@F.pandas_udf(StringType())
def _from_wide(content: pd.Series, form: pd.Series) -> pd.Series:
    return pd.Series([None if c is None else bytes(c).decode(f, "replace") for c, f in zip(content, form, strict=True)])


def decoded(content: Column) -> Column:
    """Text of bytes in UTF-8 or UTF-16, with a byte-order mark or without; invalid sequences become replacement characters. Only bytes in UTF-16 leave the JVM."""
    form = wide(content)
    plain = F.when(F.startswith(F.hex(F.substring(content, 1, 3)), F.lit("EFBBBF")), F.substring(content, 4, 1 << 30)).otherwise(content)
    return F.coalesce(_from_wide(F.when(form.isNotNull(), content), form), F.make_valid_utf8(plain.cast("string")))


def skipped(path: Column) -> Column:
    """Why a path isn't read: its extension or a folder; null if it is."""
    extension = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(extension.isin(*SKIPPED_EXTENSIONS), "extension").when(F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, SKIPPED_FOLDERS))), "folder")


#: Names of files that say which paths beside and below them aren't read.
IGNORE_FILES = (".gitignore", ".ignore", ".siftignore")


def hidden_files(spark: SparkSession, root: str, most: int) -> DataFrame:
    """Files below ``root`` that Spark's listing leaves out, as their name or a folder's begins with a dot or an underscore: path, length and content (null beyond ``most``).

    The driver lists them, as Spark does for the others; tasks read them through Arrow's file systems. Folders of SKIPPED_FOLDERS are left out.
    """
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = base.getFileSystem(spark._jsc.hadoopConfiguration())
    base, found = system.makeQualified(base), []
    listing = system.listFiles(base, True)
    while listing.hasNext():
        status = listing.next()
        path = status.getPath().toString()
        below = path[len(base.toString()) :].strip("/").split("/")
        if any(x.startswith((".", "_")) for x in below) and not set(below) & set(SKIPPED_FOLDERS):
            found.append((path, status.getLen()))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for frame in frames:
            for path, length in zip(frame["path"], frame["length"], strict=True):
                content = None
                if length <= most:
                    source, name = fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
                    with source.open_input_stream(name) as stream:
                        content = stream.read()
                yield pd.DataFrame({"path": [path], "length": [length], "content": [content]})

    paths = spark.createDataFrame(found, "path string, length long")
    return paths.repartition(max(1, min(len(found) // 64, 1000))).mapInPandas(run, "path string, length long, content binary")


def read_files(spark: SparkSession, root: str, most: int = 1 << 27, glob: str = "*", ignore: bool = True) -> tuple[DataFrame, DataFrame]:
    """Files below ``root``: chunks (path, text, size_bytes) and coverage rows (path, reason) for those that aren't read.

    Files whose names begin with a dot are read, too. With ``ignore``, the rules of ignore files hold for the paths below their folders (reason ``ignored``); paths are judged before any content is opened.
    """
    plain = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root).select("path", "length", "content")
    name = F.element_at(F.split("path", "/"), -1)
    hidden = hidden_files(spark, root, most)
    files = plain.unionByName(hidden.where(name.rlike(glob_regex(glob)) & ~name.isin(*IGNORE_FILES if ignore else [])))
    reason = F.coalesce(skipped(F.col("path")), F.when(F.col("length") > most, "too_large"))
    listed = files.select("path", F.col("length").alias("size_bytes"), "content", reason.alias("reason"))
    if ignore:
        rules = ignore_rules(hidden.where(name.isin(*IGNORE_FILES)).select("path", decoded(F.col("content")).alias("text")))
        paths = files.select("path")
        ignored = paths.join(not_ignored(paths, rules), "path", "left_anti").withColumn("_ignored", F.lit("ignored"))
        listed = listed.join(ignored, "path", "left").select("path", "size_bytes", "content", F.coalesce("reason", "_ignored").alias("reason"))
    kept = listed.where("reason IS NULL").withColumn("reason", F.when(looks_binary(F.col("content")), "binary"))
    chunks = kept.where("reason IS NULL").select("path", decoded(F.col("content")).alias("text"), "size_bytes")
    return chunks, listed.where("reason IS NOT NULL").select("path", "reason").unionByName(kept.where("reason IS NOT NULL").select("path", "reason"))


def archive_members(files: DataFrame, most: int = 1 << 26, depth: int = 3) -> DataFrame:
    """Members of ``files`` (path, content) that are zip, tar (packed or not), gzip, bzip2, xz or zstd: path, member, content and state.

    Archives inside of archives are opened up to ``depth`` levels; their members are named after them, with ``!`` between. Together at most ``most`` bytes of each
    file are unpacked; state says ``truncated`` for what goes beyond, ``invalid`` for broken archives.
    """

    def opened(content: bytes, left: list[int]) -> Iterator[tuple[str, bytes, str]] | None:
        """Name, content and state of the members; None if this is no archive."""
        import bz2
        import gzip
        import io
        import lzma
        import tarfile
        import zipfile

        def taken(stream) -> tuple[bytes, str]:
            data = stream.read(left[0] + 1)
            state = "read" if len(data) <= left[0] else "truncated"
            data = data[: left[0]]
            left[0] -= len(data)
            return data, state

        def of_zip():
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                for info in z.infolist():
                    if not info.is_dir():
                        yield info.filename, *taken(z.open(info))

        def of_tar():
            with tarfile.open(fileobj=io.BytesIO(content), mode="r:*") as t:
                for info in t:
                    if info.isfile():
                        yield info.name, *taken(t.extractfile(info))

        def single(opener):
            yield "", *taken(opener(io.BytesIO(content)))

        if content.startswith(b"PK") and zipfile.is_zipfile(io.BytesIO(content)):
            return of_zip()
        try:
            tarfile.open(fileobj=io.BytesIO(content), mode="r:*").close()
            return of_tar()
        except (tarfile.TarError, EOFError, OSError, lzma.LZMAError):
            pass
        openers = {b"\x1f\x8b": gzip.open, b"BZh": bz2.open, b"\xfd7zXZ": lzma.open}
        try:
            import zstandard

            openers[b"\x28\xb5\x2f\xfd"] = zstandard.ZstdDecompressor().stream_reader
        except ImportError:
            pass
        return next((single(o) for head, o in openers.items() if content.startswith(head)), None)

    def members(content: bytes, prefix: str, levels: int, left: list[int]) -> Iterator[tuple[str | None, bytes | None, str]]:
        try:
            found = opened(content, left)
            if found is None:
                yield prefix or None, None, "not_an_archive"
                return
            for name, data, state in found:
                name = f"{prefix}!{name}" if prefix and name else prefix or name
                inner = opened(data, left) is not None if levels > 1 and state == "read" else False
                if inner:
                    yield from members(data, name, levels - 1, left)
                else:
                    yield name, data, state
        except Exception as fault:  # every library has faults of its own for broken archives
            if isinstance(fault, MemoryError):
                raise
            yield prefix or None, None, "invalid"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                own = (path or "").rsplit("/", 1)[-1].rsplit(".", 1)[0]
                rows = [(path, own if m == "" else m, c, s) for m, c, s in members(bytes(content or b""), "", depth, [most])]
                yield pd.DataFrame(rows, columns=["path", "member", "content", "state"])

    return files.select("path", "content").mapInPandas(run, "path string, member string, content binary, state string")


def ignore_rules(files: DataFrame) -> DataFrame:
    """Rules of ignore files (path, text): folder, seq, keep (the rule begins with ``!``) and regex, for paths below the folder."""
    lines = files.select(F.regexp_replace("path", r"[^/]*$", "").alias("folder"), F.posexplode(F.split("text", r"\r?\n")).alias("seq", "line")).withColumn("line", F.rtrim("line"))
    rules = lines.where((F.col("line") != "") & ~F.col("line").startswith("#")).withColumn("keep", F.col("line").startswith("!"))
    glob = F.regexp_replace(F.regexp_replace("line", "^!", ""), "/$", "")
    plain = F.regexp_replace(glob, r"([.+^$(){}|\\\[\]])", r"\\$1")
    for mark, regex in (("**/", "\x01"), ("/**", "\x02"), ("**", "\x03"), ("*", "[^/]*"), ("?", "[^/]"), ("\x01", "(?:[^/]+/)*"), ("\x02", "/.*"), ("\x03", ".*")):
        plain = F.replace(plain, F.lit(mark), F.lit(regex))
    head = F.when(glob.contains("/"), "").otherwise("(?:.*/)?")
    return rules.select("folder", "seq", "keep", F.concat(F.lit("^"), head, F.regexp_replace(plain, "^/", ""), F.lit("(?:/.*)?$")).alias("regex"))


def not_ignored(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Files (path and others) that no rule of a folder above them ignores: of the rules that fit, the last one of the deepest folder decides."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.concat(F.array_join(F.slice(parts, F.lit(1), n), "/"), F.when(n > 0, "/").otherwise("")))
    each = files.select("path", F.explode(above).alias("folder")).distinct()
    rest = F.substring("path", F.length("folder") + 1, F.length("path"))
    hits = each.join(rules, "folder").where(F.regexp(rest, F.col("regex")))
    dropped = hits.groupBy("path").agg(F.max_by("keep", F.struct(F.length("folder"), "seq")).alias("keep")).where("NOT keep")
    return files.join(dropped, "path", "left_anti")


def printable_runs(content: Column, least: int = 6) -> Column:
    """Runs of printable ASCII in bytes."""
    return F.regexp_extract_all(F.decode(content, "ISO-8859-1"), F.lit(f"[ -~]{{{least},}}"), F.lit(0))


def page_parts(pages: DataFrame) -> DataFrame:
    """Scripts, attributes and text of HTML pages as chunks: page_id, kind and text."""
    kinds = {"script": (r"(?is)<script[^>]*>(.*?)</script>", 1), "attribute": (r"(?:href|src|content)=\"([^\"]*)\"", 1)}

    def parts(kind: str) -> Column:
        regex, group = kinds[kind]
        return F.transform(F.regexp_extract_all("html", F.lit(regex), F.lit(group)), lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("text")))

    return pages.select("page_id", F.explode(F.concat(*map(parts, kinds))).alias("c")).select("page_id", "c.kind", "c.text").where("text <> ''")


def redact_url(url: Column) -> Column:
    """A URL without user info, and with the values of query parameters hidden."""
    bare = F.regexp_replace(url, r"^([A-Za-z][A-Za-z0-9+.-]*://)[^/?#@]*@", "$1")
    return F.regexp_replace(bare, r"([?&][^=&#]*)=[^&#]*", "$1=***")


HAR = "log struct<entries: array<struct<request: struct<url: string, body: string>, response: struct<status: int, body: string>>>>"


def har_bodies(captures: DataFrame) -> DataFrame:
    """Bodies of HTTP captures (doc_id, har as JSON): doc_id, entry, side, url and text."""
    rows = captures.select("doc_id", F.posexplode(F.from_json("har", HAR)["log"]["entries"]).alias("entry", "e"))
    sides = F.array(F.struct(F.lit("request").alias("side"), F.col("e.request.body").alias("text")), F.struct(F.lit("response").alias("side"), F.col("e.response.body").alias("text")))
    return rows.select("doc_id", "entry", F.col("e.request.url").alias("url"), F.explode(sides).alias("s")).select("doc_id", "entry", "s.side", "url", "s.text").where("text IS NOT NULL")


ENV = r"""^\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_.]*)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^#\s]*))"""


def env_pairs(lines: DataFrame) -> DataFrame:
    """Keys and values of dotenv lines (doc_id, line_no, line)."""
    value = F.concat(*(F.regexp_extract("line", ENV, k) for k in (2, 3, 4)))
    return lines.where(F.col("line").rlike(ENV)).select("doc_id", "line_no", F.regexp_extract("line", ENV, 1).alias("key"), value.alias("value"))


def within_limits(chunks: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Chunks of at most ``most`` characters, and coverage rows for the others."""
    return chunks.where(F.length("text") <= most), chunks.where(F.length("text") > most).select("doc_id", "path", F.lit("too_large").alias("reason"), F.length("text").cast("long").alias("n_chars"))
