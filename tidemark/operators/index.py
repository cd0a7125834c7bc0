"""Indexes and queries. An index is an expression over a row; nothing is stored for it."""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark import errors
from tidemark.functions import keys

NAME = re.compile("^[a-z][a-z0-9_\\-]{0,30}$")
REVISION = "__revision__"


@dataclass(frozen=True)
class Query:
    """An index's name and a key; the access method is chosen by the call."""

    index: str
    key: bytes
    value: Any = None
    bits: str | None = None


def by_revision(revision: int) -> Query:
    return Query(REVISION, revision.to_bytes(8, "big"), revision)


@dataclass(frozen=True)
class Index:
    """Keys of a column by an encoder: one a row, or with multi one for each element of an array (or key of a map)."""

    name: str
    column: str
    encoder: keys.Encoder = keys.string
    unique: bool = False
    multi: bool = False
    is_map: bool = False

    def key(self) -> Column:
        return self.encoder.column(F.col(f"`{self.column}`"))

    def keys(self) -> Column:
        """Zero or more keys, as an array."""
        if self.is_map:
            return keys.map_keys(F.col(f"`{self.column}`"), self.encoder)
        if self.multi:
            return F.coalesce(keys.each(self.encoder, F.col(f"`{self.column}`")), F.array().cast("array<binary>"))
        return F.when(F.col(f"`{self.column}`").isNotNull(), F.array(self.key())).otherwise(F.array().cast("array<binary>"))

    @property
    def native(self) -> bool:
        """Queries can compile to predicates on the column itself."""
        return self.encoder.ordered and not self.multi and not self.is_map

    def query(self, value: Any) -> Query:
        return Query(self.name, self.encoder.encode(value), value)

    def query_from_object(self, row: dict) -> Query:
        own = self.object_keys(row)
        return Query(self.name, own[0] if own else b"")

    def query_from_key(self, key: bytes) -> Query:
        return Query(self.name, bytes(key))

    def query_from_string(self, text: str) -> Query:
        if self.encoder.parse is None:
            raise errors.TableError(f"index {self.name} can't be queried by text")
        return self.query(self.encoder.parse(text))

    def object_keys(self, row: dict) -> list[bytes]:
        value = row.get(self.column)
        if value is None:
            return []
        if self.is_map:
            return [self.encoder.encode(v) for v in sorted(value)]
        return [self.encoder.encode(v) for v in value] if self.multi else [self.encoder.encode(value)]

    def object_to_key(self, row: dict) -> bytes:
        return self.query_from_object(row).key


@dataclass(frozen=True)
class LPMIndex:
    """Bit prefixes of a column: CIDR text (kind "ip"), or integers of `width` bits cut to the length in another column."""

    name: str
    column: str
    unique: bool = True
    kind: str = "ip"
    width: int = 128
    length: str | None = None
    multi: bool = False

    def bits(self) -> Column:
        """The prefix as text of 0 and 1."""
        return self._bits_of(F.col(f"`{self.column}`"))

    def all_bits(self) -> Column:
        return F.transform(F.col(f"`{self.column}`"), self._bits_of) if self.multi else F.array(self.bits())

    def _bits_of(self, c: Column) -> Column:
        if self.kind == "ip":
            # dotted IPv4 only, in mapped form: 96 bits, then the network's own
            size = F.coalesce(F.get(F.split(c, "/"), 1).cast("int"), F.lit(32))
            return F.concat(F.lit("0" * 80 + "1" * 16), keys.ipv4_bits(keys.ipv4_number(F.get(F.split(c, "/"), 0)), size))
        size = F.lit(self.width) if self.length is None else F.col(f"`{self.length}`").cast("int")
        return F.substring(F.lpad(F.bin(c.cast("bigint")), self.width, "0"), F.lit(1), size)

    def query(self, value: Any, length: int | None = None) -> Query:
        """A network or an address as text, or an integer with the length of its prefix."""
        if self.kind == "ip":
            return Query(self.name, b"", value, keys.network_bits(value))
        return Query(self.name, b"", value, f"{int(value):0{self.width}b}"[: self.width if length is None else length])

    query_prefix = query

    def query_bits(self, data: bytes, length: int) -> Query:
        return Query(self.name, keys.encode_lpm(data, length), None, keys.bit_text(data, length))

    def query_from_string(self, text: str) -> Query:
        return self.query(text) if self.kind == "ip" else self.query(*map(int, text.split("/")))

    def object_bits(self, row: dict) -> list[str]:
        value = row.get(self.column)
        if value is None:
            return []
        if self.kind == "ip":
            return [keys.network_bits(v) for v in (value if self.multi else [value])]
        return [self.query(value, self.width if self.length is None else row[self.length]).bits]


def check_name(name: str) -> None:
    if not NAME.match(name):
        raise errors.InvalidName(f"invalid table name {name!r}")


def check_indexes(table: str, primary: Index | LPMIndex, secondary: tuple) -> None:
    """What must hold before a table is made; a bit-prefix index can't be primary."""
    if isinstance(primary, LPMIndex):
        raise errors.TableError("a bit-prefix index can't be primary", table)
    if not primary.name:
        raise errors.TableError("the primary index has no name", table)
    if not primary.unique or primary.multi or primary.is_map:
        raise errors.PrimaryNotUnique("the primary index must be unique", table)
    seen = {primary.name}
    for x in secondary:
        if not x.name:
            raise errors.TableError("an index has no name", table)
        if x.name.startswith("__"):
            raise errors.ReservedPrefix(f"index {x.name!r} begins with the reserved __", table)
        if x.name in seen:
            raise errors.DuplicateIndex(f"index {x.name!r} is there twice", table)
        seen.add(x.name)
