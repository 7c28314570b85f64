"""WARC archives, index first: the index holds each record's offset, length, URL and digest, and reads go by byte ranges.

Every task writes its records, each a gzip member, to an archive of its own, and hands back the index rows; Spark commits
the index, so only archives of attempts that succeeded are ever read. A read takes the selected index rows in the order
of file and offset, joins ranges that lie close together, and fetches each joined range at once.

Of records with equal payloads of at least ``least`` bytes, that with the smallest ``page_id`` is a response, and the others
are revisits that refer to it and hold no payload.

Nulls and odd rows: null html is an empty payload; a null url is written as an empty one; a url with white space or
control characters, which a record's head can't hold, stands there with per cent escapes and a mark, and reading undoes them; pages with a null ``page_id`` are
responses and never referred to; a revisit's payload is that of the response with its page_id and digest; rows that repeat a ``page_id`` with the same payload are responses each;
other columns are ignored. An empty table makes no archive.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import file_system, shared_path, stored, table

LEAST = 100
#: Reads join ranges that lie no further apart, up to a size.
GAP, JOINED = 64 << 10, 8 << 20
#: Bytes of archives that one read task takes, about.
TASK_BYTES = 16 << 20
#: The date of all records, so that archives don't change from run to run.
DATE = "2024-01-01T00:00:00Z"
INDEX = "page_id long, file string, offset long, length long, url string, payload_digest string, record_type string"


def revisits(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, digest and refers_to (the smallest page_id with the same payload) of pages that are revisits."""
    keyed = pages.where(F.col("page_id").isNotNull() & (F.octet_length("html") >= least)).select("page_id", _digest().alias("digest"))
    first = keyed.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where("refers_to < last").drop("last")
    # Written, as a join with a table may split a digest that many pages share, and one with an aggregation may not.
    first = stored(first, "first-payloads")
    return keyed.join(first, "digest").where("page_id <> refers_to").select("page_id", "digest", "refers_to").distinct()


def _digest():
    return F.sha2(F.encode(F.coalesce("html", F.lit("")), "UTF-8"), 256)


#: Characters of a url that a record's head can't hold.
_UNSAFE = re.compile(r"[\x00-\x20\x7f-\xa0\u2028\u2029]")


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A WARC record, uncompressed."""
    name = lambda i: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{i}')}>"
    block = b"" if refers_to is not None else payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {name(page_id)}",
        f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {quote(url)}", "X-URL-Escaped: yes"] if _UNSAFE.search(url) else [f"WARC-Target-URI: {url}"]),
        f"WARC-Payload-Digest: sha256:{digest}",
        *([] if page_id is None else [f"X-Page-ID: {page_id}"]),
        *([] if refers_to is None else [f"WARC-Refers-To: {name(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]),
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join([*head, "", ""]).encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    block = rest[: int(headers["content-length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a WARC record is cut off")
    return headers, block


def write_archives(pages: DataFrame, out: str, least: int = LEAST) -> DataFrame:
    """Write ``pages`` (page_id, url, html) into the folder ``out``; returns the index."""
    spark = pages.sparkSession
    pages = pages.select("page_id", "url", "html", _digest().alias("digest")).join(revisits(pages, least), ["page_id", "digest"], "left")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, name, offset = None, "", 0
        for batch in batches:
            rows = []
            for page_id, url, refers_to, html in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3)), batch.column(2), strict=True):
                if stream is None:
                    fs, path = file_system(out)
                    fs.create_dir(path, recursive=True)
                    name = f"part-{uuid.uuid4().hex}.warc.gz"
                    stream = fs.open_output_stream(f"{path}/{name}", compression=None)
                payload = (html.as_py() or "").encode()
                digest = hashlib.sha256(payload).hexdigest()
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                data = packer.compress(record(page_id, url or "", payload, digest, refers_to)) + packer.flush()
                stream.write(data)
                rows.append((page_id, f"{out}/{name}", offset, len(data), url, digest, "response" if refers_to is None else "revisit"))
                offset += len(data)
            if rows:
                columns = zip(*rows, strict=True)
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], [x.split()[0] for x in INDEX.split(", ")])
        if stream is not None:
            stream.close()

    index = shared_path(spark, "warc-index")
    pages.select("page_id", "url", "html", "refers_to").mapInArrow(write, INDEX).write.parquet(index)
    return spark.read.schema(INDEX).parquet(index)


def joined_ranges(rows: list[tuple[int, int]], gap: int = GAP, most: int = JOINED) -> list[tuple[int, int, list[int]]]:
    """Ranges (offset, length) in ascending order, as fewer reads: (start, end, numbers of the ranges inside)."""
    out: list[tuple[int, int, list[int]]] = []
    for k, (offset, length) in enumerate(rows):
        if out and offset - out[-1][1] <= gap and offset + length - out[-1][0] <= most:
            start, end, inside = out[-1]
            inside.append(k)
            out[-1] = (start, max(end, offset + length), inside)
        else:
            out.append((offset, offset + length, [k]))
    return out


def read_records(selected: DataFrame) -> DataFrame:
    """The records of ``selected`` index rows, as their archives hold them: page_id, url, record_type, digest, refers_to and payload (null for revisits)."""
    size = selected.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, min(100_000, -(-size // TASK_BYTES)))
    schema = "page_id long, url string, record_type string, payload_digest string, refers_to long, payload binary"
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    number = lambda x: None if x is None else int(x)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, current = None, None
        for batch in batches:
            files, offsets, lengths = (batch.column(k).to_pylist() for k in range(3))
            first = 0
            while first < len(files):
                last = first
                while last < len(files) and files[last] == files[first]:
                    last += 1
                if files[first] != current:
                    fs, path = file_system(files[first])
                    current, source = files[first], fs.open_input_file(path)
                for start, end, inside in joined_ranges(list(zip(offsets[first:last], lengths[first:last], strict=True))):
                    data, rows = source.read_at(end - start, start), []
                    for k in inside:
                        at = offsets[first + k] - start
                        headers, block = parse(zlib.decompress(data[at : at + lengths[first + k]], 31))
                        kind = headers["warc-type"]
                        rows.append((number(headers.get("x-page-id")), unquote(headers["warc-target-uri"]) if "x-url-escaped" in headers else headers["warc-target-uri"], kind, headers["warc-payload-digest"].removeprefix("sha256:"), number(headers.get("x-refers-to-page-id")), block if kind == "response" else None))
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in schema.split(", ")])
                first = last

    placed = selected.select("file", "offset", "length").repartitionByRange(int(tasks), "file", "offset").sortWithinPartitions("file", "offset")
    return placed.mapInArrow(read, schema)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = write_archives(table(spark, sf_dir, "pages"), shared_path(spark, "warc"))
    own = [F.length("payload").cast("long").alias("own_bytes"), F.sha2("payload", 256).alias("own_digest")]
    records = stored(read_records(index).select("page_id", "record_type", "refers_to", "payload_digest", *own), "warc-records")
    responses = records.where("record_type = 'response'")
    # What a revisit stands for is what its response holds: that with its page_id, and with the digest that the revisit's record names.
    held = responses.select(F.col("page_id").alias("refers_to"), F.col("own_digest").alias("payload_digest"), F.col("own_bytes").alias("payload_bytes")).distinct()
    again = records.where("record_type = 'revisit'").join(held, ["refers_to", "payload_digest"], "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    plain = responses.select("page_id", F.col("own_bytes").alias("payload_bytes"), F.col("own_digest").alias("payload_digest"), "record_type", "refers_to")
    return plain.unionByName(again.select(*columns))


OP4_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS n, sha256(payload) AS digest FROM p),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY digest) END AS first_id FROM d)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM f
"""
