"""Key encoders: a column expression, its driver-side twin and a text parser for each.

Keys compare as unsigned bytes, so signed integers, kept in two's complement, sort after the positive ones. An encoder is `ordered`
if the source column already sorts like its key; queries then compile to predicates on that column, which reach the Parquet scan.
"""

from __future__ import annotations

import ipaddress
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Encoder:
    name: str
    column: Callable[[Column], Column]
    encode: Callable[[Any], bytes]
    parse: Callable[[str], Any] | None = None
    ordered: bool = False
    #: The source column is text, so a key prefix is a text prefix.
    text: bool = False

    def from_string(self, text: str) -> bytes:
        if self.parse is None:
            raise ValueError(f"index keys of kind {self.name} have no text form")
        return self.encode(self.parse(text))


def _wide(width: int) -> Callable[[Column], Column]:
    mask = (1 << 8 * width) - 1
    if width == 8:
        return lambda c: F.unhex(F.lpad(F.hex(c.cast("bigint")), 16, "0"))
    return lambda c: F.unhex(F.lpad(F.hex(c.cast("bigint").bitwiseAND(F.lit(mask))), 2 * width, "0"))


def _unsigned(width: int) -> Encoder:
    def encode(value: int) -> bytes:
        return int(value).to_bytes(width, "big")

    # conv covers the whole unsigned range, whatever the type of the column
    column = (lambda c: F.unhex(F.lpad(F.conv(c.cast("string"), 10, 16), 16, "0"))) if width == 8 else _wide(width)
    return Encoder(f"uint{8 * width}", column, encode, int, ordered=True)


def _signed(name: str, width: int) -> Encoder:
    def encode(value: int) -> bytes:
        return (int(value) & (1 << 8 * width) - 1).to_bytes(width, "big")

    return Encoder(name, _wide(width), encode, int)


def _truth(text: str) -> bool:
    if text.lower() not in ("true", "false", "t", "f", "1", "0"):
        raise ValueError(f"not a truth value: {text!r}")
    return text.lower() in ("true", "t", "1")


uint64, uint32, uint16 = _unsigned(8), _unsigned(4), _unsigned(2)
int64, int32, int16 = _signed("int64", 8), _signed("int32", 4), _signed("int16", 2)
#: The plain integer key has 32 bits in an index and 64 in map and set values.
integer, map_integer = _signed("int", 4), _signed("map_int", 8)
boolean = Encoder("bool", lambda c: F.when(c, F.unhex(F.lit("54"))).otherwise(F.unhex(F.lit("46"))), lambda v: b"T" if v else b"F", _truth, ordered=True)
string = Encoder("string", lambda c: c.cast("binary"), lambda v: v.encode() if isinstance(v, str) else bytes(v), str, ordered=True, text=True)
binary = Encoder("binary", lambda c: c, bytes, lambda s: s.encode(), ordered=True)

MAPPED = "00000000000000000000FFFF"


def ipv4_number(text: Column) -> Column:
    """A dotted IPv4 address as a number, with arithmetic only."""
    part = F.split(text, "\\.")
    return sum((F.get(part, k).cast("bigint") * (1 << 8 * (3 - k)) for k in range(1, 4)), F.get(part, 0).cast("bigint") * (1 << 24))


def ipv4_text(number: Column) -> Column:
    octet = lambda k: F.shiftright(number, 8 * k).bitwiseAND(F.lit(255)).cast("string")
    return F.concat_ws(".", octet(3), octet(2), octet(1), octet(0))


def masked(number: Column, bits: Column) -> Column:
    """An IPv4 number with only its leading bits; no shift by 32 is needed for a length of 0."""
    size = F.pow(F.lit(2.0), 32 - bits).cast("bigint")
    return number - F.pmod(number, size)


def ip_bytes(value: Any) -> bytes:
    """An address as 16 bytes, IPv4 in its mapped form."""
    ip = ipaddress.ip_address(str(value))
    return b"\x00" * 10 + b"\xff\xff" + ip.packed if ip.version == 4 else ip.packed


ipv4 = Encoder("ipv4", lambda c: F.unhex(F.concat(F.lit(MAPPED), F.lpad(F.hex(ipv4_number(c)), 8, "0"))), ip_bytes, str)


def _ip_column(c: Column) -> Column:
    @F.pandas_udf("binary")
    def parse(texts):  # IPv6 text has no builtin parser
        return texts.map(lambda t: None if t is None else ip_bytes(t))

    return parse(c)


ip = Encoder("ip", _ip_column, ip_bytes, str)


def prefix_bytes(value: Any) -> bytes:
    """A network as its masked 16 bytes and one byte of unmapped length."""
    net = ipaddress.ip_network(str(value), strict=False)
    return ip_bytes(net.network_address) + bytes([net.prefixlen])


def _ipv4_prefix_column(c: Column) -> Column:
    bits = F.coalesce(F.get(F.split(c, "/"), 1).cast("int"), F.lit(32))
    net = masked(ipv4_number(F.get(F.split(c, "/"), 0)), bits)
    return F.unhex(F.concat(F.lit(MAPPED), F.lpad(F.hex(net), 8, "0"), F.lpad(F.hex(bits.cast("bigint")), 2, "0")))


ipv4_prefix = Encoder("ipv4_prefix", _ipv4_prefix_column, prefix_bytes, str)
#: Encoders of map and set keys by type name; more can be registered.
REGISTRY: dict[str, Encoder] = {e.name: e for e in (uint64, uint32, uint16, int64, int32, int16, integer, map_integer, boolean, string, binary, ip, ipv4, ipv4_prefix)}


def register_key_type(encoder: Encoder) -> None:
    if encoder.name in REGISTRY:
        raise ValueError(f"key type {encoder.name} is registered already")
    REGISTRY[encoder.name] = encoder


def each(encoder: Encoder, column: Column) -> Column:
    """Keys of an array's elements."""
    return F.transform(column, encoder.column)


def map_keys(column: Column, encoder: Encoder = string) -> Column:
    return each(encoder, F.array_sort(F.map_keys(column)))


def successor(prefix: bytes) -> bytes | None:
    """The least key above all that begin with prefix; none if there is no such key."""
    bare = prefix.rstrip(b"\xff")
    return bare[:-1] + bytes([bare[-1] + 1]) if bare else None


def begins(key: Column, prefix: bytes) -> Column:
    """key begins with prefix, as a range, which reaches the scan where a test for a prefix doesn't."""
    if not prefix:
        return key.isNotNull()
    end = successor(prefix)
    out = key >= F.lit(prefix)
    return out if end is None else out & (key < F.lit(end))


def encode_lpm(data: bytes, bits: int) -> bytes:
    """Data masked to its leading bits, then the length in two bytes."""
    size = (bits + 7) // 8
    if len(data) < size:
        raise ValueError(f"{bits} bits don't fit {len(data)} bytes")
    out = bytearray(data[:size])
    if bits % 8:
        out[-1] &= 0xFF << (8 - bits % 8) & 0xFF
    return bytes(out) + bits.to_bytes(2, "big")


def decode_lpm(key: bytes) -> tuple[bytes, int]:
    return key[:-2], int.from_bytes(key[-2:], "big")


def bit_text(data: bytes, bits: int) -> str:
    """The leading bits as text of 0 and 1."""
    return "".join(f"{b:08b}" for b in data)[:bits]


def network_bits(text: str) -> str:
    """A network or a bare address (a network of one host) as bits; IPv4 in its mapped form."""
    net = ipaddress.ip_network(str(text), strict=False)
    return bit_text(ip_bytes(net.network_address), net.prefixlen + (96 if net.version == 4 else 0))


def ipv4_bits(number: Column, bits: Column | None = None) -> Column:
    """The leading bits of an IPv4 number as text."""
    out = F.lpad(F.bin(number), 32, "0")
    return out if bits is None else F.substring(out, F.lit(1), bits)
