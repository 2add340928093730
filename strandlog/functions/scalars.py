"""Scalar functions as Column expressions: no Python runs for them on executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import model

PREAMBLE = 0xD5A7  # fixed value
MESSAGE_BITS = 40


def _bin(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("binary")


def sha256_hex(c: Column | str) -> Column:
    return F.sha2(_bin(c), 256)


def uuid_text(hex32: Column) -> Column:
    """8-4-4-4-12 groups of 32 lower-case hex digits."""
    cut = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *[F.substring(hex32, a, n) for a, n in cut])


def derive_stream_id(value: Column | str) -> Column:
    """The first 16 bytes of the SHA-256, with version nibble 5 and variant 10, as text."""
    h = sha256_hex(value)
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3)).bitwiseOR(8)))
    return uuid_text(F.concat(F.substring(h, 1, 12), F.lit("5"), F.substring(h, 14, 3), variant, F.substring(h, 18, 15)))


def put_le(c: Column | str, width: int) -> Column:
    """Hex of an integer as `width` little-endian bytes (two's complement)."""
    c = F.col(c) if isinstance(c, str) else c
    wide = F.lpad(F.lower(F.hex(c.cast("long"))), 16, "0")
    return F.concat(*[F.substring(wide, 15 - 2 * k, 2) for k in range(width)])


def get_le(hexed: Column, first: int, width: int) -> Column:
    """The unsigned little-endian integer at byte `first` of a hex text; eight bytes wrap to two's complement."""
    parts = [F.conv(F.substring(hexed, 2 * (first + k) + 1, 2), 16, 10).cast("long") for k in range(width)]
    out = parts[0]
    for k in range(1, width):
        out = out.bitwiseOR(F.shiftleft(parts[k], 8 * k))
    return out


def feed_descriptor(label: Column, uri: Column, preserve: Column) -> Column:
    """Payload of a feed descriptor, as hex: magic, version 1, sizes, flags, label, uri."""
    lab, u = _bin(label), _bin(uri)
    return F.concat(
        F.lit(model.DESCRIPTOR_MAGIC.hex()),
        put_le(F.lit(1), 2),
        put_le(F.octet_length(lab), 2),
        put_le(F.octet_length(u), 4),
        put_le(F.when(preserve, 1).otherwise(0), 4),
        F.lower(F.hex(lab)),
        F.lower(F.hex(u)),
    )


def decode_feed_descriptor(payload: Column) -> Column:
    """struct<label, uri, preserve_source>, null where the payload is no descriptor."""
    h = F.lower(F.hex(payload))
    n, u = get_le(h, 6, 2), get_le(h, 8, 4)
    size = F.octet_length(payload)
    ok = (size >= 16) & (F.substring(h, 1, 8) == model.DESCRIPTOR_MAGIC.hex()) & (get_le(h, 4, 2) == 1) & (n > 0) & (size == 16 + n + u)
    text = lambda at, n: F.decode(F.unhex(F.substr(h, (2 * at + 1).cast("int"), (2 * n).cast("int"))), "UTF-8")
    return F.when(ok, F.struct(text(F.lit(16), n).alias("label"), text(16 + n, u).alias("uri"), (get_le(h, 12, 4).bitwiseAND(1) == 1).alias("preserve_source")))


def valid_label(c: Column) -> Column:
    """1 to 128 visible ASCII characters without '='."""
    return F.coalesce(c.rlike(r"\A[\x21-\x3c\x3e-\x7e]{1,128}\z"), F.lit(False))


def redacted_uri(uri: Column) -> Column:
    """Without user information (up to the first '@' of the authority), query and fragment; only if there is a '://'."""
    plain = F.regexp_replace(uri, r"\A((?:(?!://)[\s\S])*://)[^/?#@]*@", "$1")
    return F.when(F.contains(uri, F.lit("://")), F.regexp_replace(plain, r"[?#][\s\S]*\z", "")).otherwise(uri)


def uri_host(uri: Column) -> Column:
    """Lower-cased host, in brackets if it is an IPv6 address; null without '://'."""
    authority = F.regexp_extract(uri, r"\A(?:(?!://)[\s\S])*://([^/?#]*)", 1)
    bare = F.regexp_replace(authority, r"\A[\s\S]*@", "")
    host = F.when(F.startswith(bare, F.lit("[")), F.when(F.contains(bare, F.lit("]")), F.regexp_extract(bare, r"\A([^\]]*\])", 1)).otherwise(bare)).otherwise(F.substring_index(bare, ":", 1))
    return F.when(F.contains(uri, F.lit("://")), F.lower(host))


# Hosts that are private by their text alone.
PRIVATE_NAMES = ["localhost", "0.0.0.0", "[::]", "[::1]"]
PRIVATE_PREFIXES = ["127.", "10.", "192.168.", "169.254."]


def private_host(uri: Column) -> Column:
    """Whether a URI's host is private by its text (a lexical rule: names that begin like such addresses count)."""
    host = uri_host(uri)
    out = host.isin(PRIVATE_NAMES) | F.endswith(host, F.lit(".localhost"))
    for p in PRIVATE_PREFIXES:
        out = out | F.startswith(host, F.lit(p))
    # The second part as far as it is a number; text that is none, or too large, counts as private.
    part = F.regexp_extract(host, r"\A172\.([^.]*)\.", 1)
    number = F.regexp_extract(part, r"\A[ \t-\r]*([+-]?[0-9]+)", 1)
    value = number.try_cast("int")
    odd = value.isNull() | value.between(16, 31)
    return F.coalesce(out | (host.rlike(r"\A172\.[^.]*\.") & odd), F.lit(False))


# IPv4 networks that are not globally routable, as (network, prefix length).
UNROUTABLE = [
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24),
    ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4),
]


def ipv4_number(text: str) -> int:
    a, b, c, d = map(int, text.split("."))
    return a << 24 | b << 16 | c << 8 | d


def routable_ipv4(number: Column) -> Column:
    """number: an IPv4 address as an unsigned integer."""
    out = F.lit(False)
    for network, bits in UNROUTABLE:
        out = out | (F.shiftright(number, 32 - bits) == (ipv4_number(network) >> (32 - bits)))
    return ~out


def ipv6_groups(address: Column) -> Column:
    """The eight 16-bit groups of an IPv6 address given as text (with or without '::', a zone or a dotted IPv4 end); null if it is none."""
    text = F.lower(F.regexp_replace(address, "%.*$", ""))
    tail = F.regexp_extract(text, r"(?:^|:)([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)$", 1)
    parts = F.transform(F.split(tail, r"\."), lambda x: x.try_cast("int"))
    dotted = F.concat(F.format_string("%x", F.get(parts, F.lit(0)) * 256 + F.get(parts, F.lit(1))), F.lit(":"), F.format_string("%x", F.get(parts, F.lit(2)) * 256 + F.get(parts, F.lit(3))))
    whole = tail == ""
    small = F.forall(parts, lambda x: x.between(0, 255))
    text = F.when(whole, text).when(small, F.concat(F.substr(text, F.lit(1), F.length(text) - F.length(tail)), dotted))
    fields = lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, ":"))
    cut = F.instr(text, "::")
    left, right = fields(F.substring_index(text, "::", 1)), fields(F.when(cut > 0, F.substr(text, cut + 2)).otherwise(F.lit("")))
    missing = 8 - F.size(left) - F.size(right)
    groups = F.when((cut == 0) & (F.size(left) == 8), left).when((cut > 0) & (missing > 0), F.concat(left, F.array_repeat(F.lit("0"), missing), right))
    good = F.forall(groups, lambda g: g.rlike("^[0-9a-f]{1,4}$"))
    return F.when(good, F.transform(groups, lambda g: F.conv(g, 16, 10).cast("long")))


def routable_ipv6(address: Column) -> Column:
    """Whether an IPv6 address may be connected to: its global range without documentation addresses; a mapped IPv4 address as that one. Null if it is none."""
    g = ipv6_groups(address)
    at = lambda k: F.get(g, F.lit(k))
    mapped = F.forall(F.slice(g, 1, 5), lambda x: x == 0) & (at(5) == 0xFFFF)
    inside = (F.shiftright(at(0), 13) == 1) & ~((at(0) == 0x2001) & (at(1) == 0xDB8))
    return F.when(mapped, routable_ipv4(at(6) * 65536 + at(7))).otherwise(inside)


def crc8(code: Column) -> Column:
    """Polynomial 0x07, start 0, over the high byte and the low byte of a 16-bit code: long division, bit by bit."""
    step = lambda c, k: F.when(F.shiftright(c, 15).bitwiseAND(1) == 1, F.shiftleft(c, 1).bitwiseXOR(F.lit(0x0700))).otherwise(F.shiftleft(c, 1)).bitwiseAND(0xFFFF)
    # The remainder stands in the upper byte; sixteen steps have consumed both bytes.
    return F.shiftright(F.aggregate(F.sequence(F.lit(0), F.lit(15)), code.cast("int"), step), 8).bitwiseAND(0xFF)


def message(code: Column) -> Column:
    """Preamble, code and check value in one number of 40 bits."""
    return F.lit(PREAMBLE << 24).cast("long").bitwiseOR(F.shiftleft(code.cast("long"), 8)).bitwiseOR(crc8(code).cast("long"))


def message_bits(code: Column) -> Column:
    """The 40 bits, highest first."""
    m = message(code)
    return F.transform(F.sequence(F.lit(39), F.lit(0), F.lit(-1)), lambda k: F.call_function("shiftright", m, k).bitwiseAND(F.lit(1).cast("long")).cast("int"))


def hamming16(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b).bitwiseAND(0xFFFF))


def samples_per_bit(rate: Column, milliseconds: int) -> Column:
    return F.floor(rate.cast("long") * milliseconds / 1000)


def amplitude(dbfs: Column) -> Column:
    return F.lit(32767.0) * F.pow(F.lit(10.0), dbfs / 20.0)


def to_sample(value: Column) -> Column:
    """Nearest 16-bit sample, halves away from zero."""
    return F.least(F.greatest(F.round(value), F.lit(-32768.0)), F.lit(32767.0)).cast("int")


def goertzel_power(signal: Column, omega: float) -> Column:
    """Power of an array of samples at an angle of `omega` a sample, by the two-term recurrence in order."""
    import math

    k = 2.0 * math.cos(omega)
    zero = F.struct(F.lit(0.0).alias("p"), F.lit(0.0).alias("q"))
    step = lambda s, x: F.struct((x.cast("double") + F.lit(k) * s["p"] - s["q"]).alias("p"), s["p"].alias("q"))
    power = lambda s: s["q"] * s["q"] + s["p"] * s["p"] - F.lit(k) * s["p"] * s["q"]
    return F.aggregate(signal, zero, step, power)


def accepted(value: Column, confidence: Column, minimum: float = 0.30, wrong: int = 2) -> Column:
    """Whether a read message of 40 bits counts as a mark: few wrong bits in the preamble, a CRC that fits its code, enough confidence."""
    code = F.shiftright(value, 8).bitwiseAND(0xFFFF)
    near = hamming16(F.shiftright(value, 24).cast("int"), F.lit(PREAMBLE)) <= wrong
    return near & (value.bitwiseAND(0xFF) == crc8(code)) & (confidence >= minimum)
