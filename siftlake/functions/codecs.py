"""Decoders, checksums and tokens with structure."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def decode_base64(value: Column) -> Column:
    """Text of a standard or URL-safe base64 value, padded or not; null if it isn't one."""
    standard = F.rtrim(F.translate(value, "-_", "+/"), F.lit("="))
    padded = F.rpad(standard, (F.ceil(F.length(standard) / 4) * 4).cast("int"), F.lit("="))
    return F.when(value.rlike(r"^[A-Za-z0-9+/_-]+={0,2}$"), F.try_validate_utf8(F.try_to_binary(padded, F.lit("base64")).cast("string")))


def decode_hex(value: Column) -> Column:
    return F.when(value.rlike("^([0-9a-fA-F]{2})+$"), F.try_validate_utf8(F.unhex(value).cast("string")))


def decode_url(value: Column) -> Column:
    return F.try_url_decode(value)


def decode_json_escapes(value: Column) -> Column:
    """What a JSON string with this body says; null if it isn't one."""
    return F.get_json_object(F.concat(F.lit('{"v":"'), value, F.lit('"}')), "$.v")


def caesar(value: Column, shift: int) -> Column:
    low = "abcdefghijklmnopqrstuvwxyz"
    turned = low[shift % 26 :] + low[: shift % 26]
    return F.translate(value, low + low.upper(), turned + turned.upper())


def base62(number: Column, width: int) -> Column:
    """A number in base 62, padded with zeros to ``width`` digits."""
    digit = lambda k: F.substring(F.lit(BASE62), (F.floor(number / 62**k) % 62 + 1).cast("int"), F.lit(1))
    return F.concat(*(digit(k) for k in reversed(range(width))))


def crc32_base62_valid(token: Column, prefix: str, suffix: int = 6) -> Column:
    """The last ``suffix`` characters are the CRC-32, in base 62, of what is between the prefix and them."""
    body = F.substring(token, F.lit(len(prefix) + 1), F.length(token) - len(prefix) - suffix)
    return token.startswith(prefix) & (F.right(token, F.lit(suffix)) == base62(F.crc32(F.encode(body, "UTF-8")), suffix))


def aws_account(key_id: Column) -> Column:
    """The account number inside an access key id; null if it isn't one.

    The first ten characters behind the prefix are 50 bits in base 32; of the upper 48, bits 7 to 46 are the account.
    """
    value = F.aggregate(F.sequence(F.lit(5), F.lit(14)), F.lit(0).cast("long"), lambda acc, k: acc * 32 + F.instr(F.lit(BASE32), F.substring(key_id, k, F.lit(1))) - 1)
    account = F.shiftright(F.shiftright(value, 2).bitwiseAND(F.lit(0x7FFFFFFFFF80)), 7)
    return F.when(key_id.rlike("^(AKIA|ASIA)[A-Z2-7]{16}$"), F.lpad(account.cast("string"), F.greatest(F.lit(12), F.length(account.cast("string"))), F.lit("0")))


def jwt_part(token: Column, part: int) -> Column:
    """Header (0) or claims (1) of a JSON web token as JSON text; null if it isn't one."""
    return F.when(token.rlike(r"^[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*$"), decode_base64(F.get(F.split(token, r"\."), F.lit(part))))


def json_selector(text: Column, path: str) -> Column:
    """The value at a ``$.a[0].b`` path; bad syntax is an error at once, a missing value is null."""
    import re

    if len(path) > 1024 or path.count(".") + path.count("[") > 64 or not re.fullmatch(r"\$(\.[A-Za-z_][A-Za-z0-9_-]*|\[\d+\])*", path):
        raise ValueError(f"not a selector: {path}")
    return F.get_json_object(text, path)


def ipv4_number(text: Column) -> Column:
    """An IPv4 address as a number; null if it isn't one."""
    parts = F.split(text, r"\.")
    number = F.aggregate(parts, F.lit(0).cast("long"), lambda acc, p: acc * 256 + p.try_cast("long"))
    return F.when(text.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & F.forall(parts, lambda p: p.try_cast("int") <= 255), number)


#: First addresses and prefix lengths of IPv4 ranges that are private or reserved (RFC 6890).
RESERVED = (("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4))


def is_bogon(text: Column) -> Column:
    number, found = ipv4_number(text), F.lit(False)
    for first, bits in RESERVED:
        low = sum(int(p) << 8 * (3 - k) for k, p in enumerate(first.split(".")))
        found = found | number.between(low, low + (1 << 32 - bits) - 1)
    return found


#: The digits of Crockford's base 32.
CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def _bits32(digits: Column, alphabet: str) -> Column:
    """Bytes of base-32 digits: eight digits are five bytes; the bits that are left at the end go."""
    number = lambda at: F.aggregate(F.sequence(F.lit(1), F.lit(8)), F.lit(0).cast("long"), lambda acc, k: acc * 32 + F.greatest(F.lit(0), F.instr(F.lit(alphabet), F.substring(digits, at * 8 + k, F.lit(1))) - 1))
    n_groups = F.ceil(F.length(digits) / 8).cast("int")
    hexes = F.array_join(F.transform(F.sequence(F.lit(0), n_groups - 1), lambda g: F.lpad(F.hex(number(g)), 10, "0")), "")
    return F.unhex(F.left(hexes, (F.floor(F.length(digits) * 5 / 8) * 2).cast("int")))


def decode_base32(value: Column) -> Column:
    """Text of a base-32 value (RFC 4648), padded or not, in any case; null if it isn't one."""
    digits = F.rtrim(F.upper(value), F.lit("="))
    return F.when(digits.rlike("^[A-Z2-7]{2,}$") & ~(F.length(digits) % 8).isin(1, 3, 6), F.try_validate_utf8(_bits32(digits, BASE32).cast("string")))


def decode_crockford(value: Column) -> Column:
    """Text of a value in Crockford's base 32; hyphens don't count, and look-alikes are read as the digits they stand for."""
    digits = F.translate(F.upper(value), "OIL-", "011")
    return F.when(digits.rlike(f"^[{CROCKFORD}]{{2,}}$") & ~(F.length(digits) % 8).isin(1, 3, 6), F.try_validate_utf8(_bits32(digits, CROCKFORD).cast("string")))


def fnv1a_32(value: Column) -> Column:
    """The 32-bit FNV-1a hash of the UTF-8 bytes."""
    hexes = F.hex(F.encode(value, "UTF-8"))
    codes = F.transform(F.regexp_extract_all(hexes, F.lit(".."), F.lit(0)), lambda x: F.conv(x, 16, 10).cast("long"))
    return F.aggregate(codes, F.lit(0x811C9DC5).cast("long"), lambda acc, b: (acc.bitwiseXOR(b) * F.lit(0x01000193).cast("long")).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))


def jwt_findings(token: Column, now: Column) -> Column:
    """What a JSON web token's parts say: kind of algorithm, type, whether it has expired, and its claims by name and length of value; null if it is none.

    A token of over 16 KiB is none. Values of claims are never shown.
    """
    header, claims = jwt_part(token, 0), jwt_part(token, 1)
    named = F.from_json(claims, "map<string, string>")
    alg = F.lower(F.get_json_object(header, "$.alg"))
    kind = F.when(alg == "none", "none").when(alg.rlike("^(hs|rs|es|ps)(256|384|512)$|^eddsa$"), "known").otherwise("unknown")
    shown = F.array_join(F.array_sort(F.transform(F.map_entries(named), lambda e: F.concat(e["key"], F.lit(":"), F.length(e["value"]).cast("string")))), ",")
    fields = F.struct(kind.alias("algorithm"), F.get_json_object(header, "$.typ").alias("typ"), (F.get_json_object(claims, "$.exp").try_cast("double") < now).alias("expired"), shown.alias("claims"))
    return F.when((F.length(token) <= 16384) & header.isNotNull() & named.isNotNull() & (F.get_json_object(header, "$.alg").isNotNull()), fields)


def git_lfs_pointer(text: Column) -> Column:
    """The object id and size that a Git LFS pointer file names; null for other texts."""
    regex = r"^version https://git-lfs\.github\.com/spec/v1\n(?:ext-[^\n]*\n)*oid sha256:([0-9a-f]{64})\nsize ([0-9]+)\n?$"
    return F.when((F.length(text) <= 1024) & text.rlike(regex), F.struct(F.regexp_extract(text, regex, 1).alias("oid"), F.regexp_extract(text, regex, 2).try_cast("long").alias("size")))


def plain_path(path: Column) -> Column:
    """A path with forward slashes, and without a verbatim prefix; a drive letter in upper case."""
    bare = F.regexp_replace(F.regexp_replace(path, r"^\\\\\?\\UNC\\", r"\\\\"), r"^\\\\[?.]\\", "")
    flat = F.replace(bare, F.lit("\\"), F.lit("/"))
    return F.when(flat.rlike("^[a-zA-Z]:"), F.concat(F.upper(F.left(flat, F.lit(1))), F.substring(flat, 2, 1 << 20))).otherwise(flat)


#: First digits of IPv6 ranges that are private or reserved (RFC 6890), as patterns of the address written in full.
RESERVED_6 = r"^(0{4}:){7}000[01]$|^f[cd]|^fe[89ab]|^ff|^2001:0db8:|^0100:0000:0000:0000:|^2002:|^0{4}:0{4}:0{4}:0{4}:0{4}:ffff:"


def full_ipv6(text: Column) -> Column:
    """An IPv6 address as eight groups of four digits in lower case; null if it isn't one."""
    low = F.lower(text)
    halves = F.split(low, "::", -1)
    groups = lambda part: F.filter(F.split(part, ":"), lambda g: g != "")
    head, tail = groups(F.get(halves, F.lit(0))), F.coalesce(groups(F.get(halves, F.lit(1))), F.array().cast("array<string>"))
    short = F.size(halves) == 2
    room = 8 - F.size(head) - F.size(tail)
    full = F.concat(head, F.array_repeat(F.lit("0"), F.greatest(F.lit(0), room)), tail)
    good = low.rlike("^[0-9a-f:]{2,39}$") & (F.size(halves) <= 2) & F.when(short, room >= 1).otherwise((room == 0) & ~low.rlike("^:|:$")) & F.forall(full, lambda g: F.length(g) <= 4)
    return F.when(good & ~low.rlike(":::|^:[^:]|[^:]:$"), F.array_join(F.transform(full, lambda g: F.lpad(g, 4, "0")), ":"))


def is_bogon_6(text: Column) -> Column:
    return full_ipv6(text).rlike(RESERVED_6)


def is_private_url(url: Column) -> Column:
    """The URL's host is this machine, a name of the local network, or a reserved address; false for public ones, null without a host."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))
    bare = F.translate(host, "[]", "")
    local = bare.rlike(r"^localhost$|\.(localhost|local|internal|lan|home\.arpa)$") | ~bare.rlike("[.:]")
    return F.when(host != "", F.coalesce(is_bogon(bare), F.lit(False)) | F.coalesce(is_bogon_6(bare), F.lit(False)) | local)
