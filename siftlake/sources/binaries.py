"""Strings of binary files by section: ELF, PE and WebAssembly.

A file is one row's bytes; its sections come from its own tables, and each byte belongs to one part: the first section that covers it, or none (section ``""``). A run of printable
characters never crosses parts. Sections without bytes in the file (ELF's NOBITS) have none.

Nulls and odd files: null and empty content has no strings; a file of another format, or whose tables can't be read, is one part without a section (``format`` is then ``raw``);
sections that reach beyond the end are cut there; a null path stays null.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "path string, format string, section string, encoding string, offset long, address long, text string"
#: Rows that a task hands on at once.
BATCH = 8192
#: Names of WebAssembly's sections, by id.
WASM = ("custom", "type", "import", "function", "table", "memory", "global", "export", "start", "element", "code", "data", "datacount", "tag")

#: (name, first byte in the file, number of bytes, address)
Part = tuple[str, int, int, int]


def _text(data: bytes, at: int) -> str:
    return data[at : data.index(b"\0", at)].decode("utf-8", "replace")


def elf_sections(data: bytes) -> list[Part]:
    wide, order = data[4] == 2, "<" if data[5] == 1 else ">"
    table, (entry, count, names) = struct.unpack_from(order + ("Q" if wide else "I"), data, 40 if wide else 32)[0], struct.unpack_from(order + "HHH", data, 58 if wide else 46)
    form = order + ("IIQQQQI" if wide else "IIIIIII")
    rows = lambda k: struct.unpack_from(form, data, table + k * entry)
    if entry < struct.calcsize(form):
        raise ValueError("rows of sections are too short")
    if table and count == 0:  # too many for the header: the first row says how many
        count = rows(0)[5]
    if names == 0xFFFF:
        names = rows(0)[6]
    if not table or not count:
        return []
    strings = rows(names)[4]
    return [(_text(data, strings + name), at, size, address) for name, kind, _, address, at, size, _ in map(rows, range(count)) if kind not in (0, 8) and size]


def pe_sections(data: bytes) -> list[Part]:
    head = struct.unpack_from("<I", data, 60)[0]
    if data[head : head + 4] != b"PE\0\0":
        raise ValueError("no PE header")
    count, optional = struct.unpack_from("<H", data, head + 6)[0], struct.unpack_from("<H", data, head + 20)[0]
    rows = (struct.unpack_from("<8sIIII", data, head + 24 + optional + 40 * k) for k in range(count))
    return [(name.rstrip(b"\0").decode("utf-8", "replace"), at, size, address) for name, _, address, size, at in rows if size]


def _leb(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value, shift, at = value | (byte & 127) << shift, shift + 7, at + 1
        if byte < 128:
            return value, at
        if shift > 63:
            raise ValueError("number too long")


def wasm_sections(data: bytes) -> list[Part]:
    """A custom section has its own name; addresses are places in the file."""
    at, found = 8, []
    while at < len(data):
        kind = data[at]
        size, begin = _leb(data, at + 1)
        end, name = begin + size, WASM[kind] if kind < len(WASM) else str(kind)
        if kind == 0:
            n, begin = _leb(data, begin)
            name, begin = data[begin : begin + n].decode("utf-8", "replace"), begin + n
        found.append((name, begin, max(0, end - begin), begin))
        at = end
    return found


#: First bytes of a format, its name, and what reads its sections.
FORMATS = ((b"\x7fELF", "elf", elf_sections), (b"MZ", "pe", pe_sections), (b"\0asm", "wasm", wasm_sections))


def parts(data: bytes) -> tuple[str, list[Part]]:
    """The format, and parts that cover all bytes once, in order."""
    for head, name, sections in FORMATS:
        if data.startswith(head):
            try:
                found = sections(data)
            except (struct.error, IndexError, ValueError, OverflowError):
                break
            whole, at = [], 0
            for section, begin, size, address in sorted(found, key=lambda p: p[1]):
                end = min(begin + size, len(data))
                if begin > at:
                    whole.append(("", at, min(begin, len(data)) - at, at))
                if end > max(begin, at):
                    skip = max(0, at - begin)
                    whole.append((section, begin + skip, end - begin - skip, address + skip))
                at = max(at, min(begin, len(data)), end)
            return name, [*whole, ("", at, len(data) - at, at)] if at < len(data) else whole
    return "raw", [("", 0, len(data), 0)]


def section_strings(files: DataFrame, least: int = 6) -> DataFrame:
    """Runs of at least ``least`` printable characters in files (path, content): path, format, section, encoding (ascii or utf-16), offset and address of the first byte, and text."""

    def strings(path: str | None, data: bytes) -> Iterator[tuple]:
        kinds = (("ascii", re.compile(rb"[ -~]{%d,}" % least), "ascii"), ("utf-16", re.compile(rb"(?:[ -~]\0){%d,}" % least), "utf-16-le"))
        name, found = parts(data)
        for section, begin, size, address in found:
            for encoding, runs, codec in kinds:
                for run in runs.finditer(data, begin, begin + size):
                    yield path, name, section, encoding, run.start(), address + run.start() - begin, run.group().decode(codec)

    columns = ("path", "format", "section", "encoding", "offset", "address", "text")
    types = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], list(columns))
        held: list[tuple] = []
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                for row in strings(path, content.as_py() or b""):
                    held.append(row)
                    if len(held) >= BATCH:
                        yield made(held)
                        held = []
        if held:
            yield made(held)

    return files.select("path", "content").mapInArrow(run, SCHEMA)
