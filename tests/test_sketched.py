"""Strings of hand-made binary files, and the scores of the mixture's query."""

import struct

from conftest import DATA
from siftlake.plans import registry, sketched  # noqa: F401
from siftlake.sources import binaries


def elf(wide, order, sections):
    """An ELF file of (name, bytes, address), with a NOBITS section."""
    names, body, rows, base = b"\0", b"", [], 64 if wide else 52
    for name, data, address in [*sections, (".bss", None, 0x9000), (".shstrtab", b"", 0)]:
        at = len(names)
        names += name.encode() + b"\0"
        rows.append([at, 8 if data is None else 1, 0, address, base + len(body), 4096 if data is None else len(data), 0])
        body += data or b""
    rows[-1][4:6] = base + len(body), len(names)
    body += names
    form, entry = order + ("IIQQQQI" if wide else "IIIIIII"), 64 if wide else 40
    table = b"".join(struct.pack(form, *r).ljust(entry, b"\0") for r in [[0] * 7, *rows])
    head = bytearray(b"\x7fELF" + bytes([2 if wide else 1, 1 if order == "<" else 2]) + bytes(base - 6))
    struct.pack_into(order + ("Q" if wide else "I"), head, 40 if wide else 32, base + len(body))
    struct.pack_into(order + "HHH", head, 58 if wide else 46, entry, len(rows) + 1, len(rows))
    return bytes(head) + body + table


def pe(sections):
    head = bytearray(64)
    head[:2], head[60:64] = b"MZ", struct.pack("<I", 64)
    start = 64 + 24 + 40 * len(sections)
    rows, body = b"", b""
    for name, data, address in sections:
        rows += struct.pack("<8sIIII", name.encode(), len(data), address, len(data), start + len(body)).ljust(40, b"\0")
        body += data
    return bytes(head) + (b"PE\0\0" + struct.pack("<HH", 0x8664, len(sections))).ljust(24, b"\0") + rows + body


def test_sections_and_addresses(spark):
    sections = [(".text", b"\x01\x02code here\x00", 0x1000), (".rodata", "wide key".encode("utf-16-le") + b"\0\0\x01plain key\x01", 0x2000)]
    files = {f"elf{w}{o}": elf(w, o, sections) for w in (True, False) for o in "<>"} | {"pe": pe(sections) + b"overlay text"}
    files |= {"other": b"\x00no format\x00", "broken": b"\x7fELF\x02\x01broken table" + b"\xff" * 80, "short": b"MZ", "empty": b"", "null": None}
    rows = [tuple(r) for r in binaries.section_strings(spark.createDataFrame(list(files.items()), "path string, content binary")).collect()]
    got = {}
    for path, form, section, encoding, offset, address, text in rows:
        data = files[path]
        assert data[offset : offset + len(text)] == text.encode() if encoding == "ascii" else data[offset : offset + 2 * len(text)].decode("utf-16-le") == text
        got.setdefault(path, set()).add((form, section, encoding, address, text))
    for path in files:
        if path.startswith(("elf", "pe")):
            form = path[:3].rstrip("TF") if path.startswith("elf") else "pe"
            assert {(form, ".text", "ascii", 0x1002, "code here"), (form, ".rodata", "utf-16", 0x2000, "wide key"), (form, ".rodata", "ascii", 0x2013, "plain key")} <= got[path], path
    assert {(s, t) for _, s, _, _, t in got["pe"]} >= {("", "overlay text")}
    assert got["other"] == {("raw", "", "ascii", 1, "no format")} and {t for *_, t in got["broken"]} == {"broken table"}
    assert not {"short", "empty", "null"} & got.keys()


def test_parts_cover_all_bytes_once():
    data = pe([("a", b"x" * 30, 0), ("b", b"y" * 20, 0)])
    row = data.index(b"b\0\0\0\0\0\0\0")
    overlapping = data[: row + 20] + struct.pack("<I", data.index(b"x" * 30) + 10) + data[row + 24 :]  # the second section begins inside the first
    for content in (data, overlapping, data[:-15], b"\0asm\x01\0\0\0\x0b\x03abc\x00\x05\x01nrst"):
        name, parts = binaries.parts(content)
        assert name != "raw" and parts[0][1] == 0
        assert [p[1] for p in parts[1:]] + [len(content)] == [p[1] + p[2] for p in parts]


def test_mixture_tells_held_out_values(spark):
    held = [r for r in registry.QUERIES["mixture_scores"](spark, DATA).collect() if r.held_out]
    assert len(held) > 10 and len({r.label for r in held}) == 2
    assert sum((r.probability > 0.5) == r.label for r in held) / len(held) > 0.9
