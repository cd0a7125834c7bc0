"""Access methods over a table's live rows: all, list, prefix, lower bound and by revision.

Rows carry `_pk` (the primary key's bytes) and `_revision`. Each method is one filter and, for its order, one sort; none shuffles to remove
duplicates, as a row's first matching key is found within the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.keys import begins
from tidemark.operators.index import REVISION, Index, Query

PK, REV, KEY = "_pk", "_revision", "_key"


def all_rows(live: DataFrame) -> DataFrame:
    return live.orderBy(PK)


def list_(live: DataFrame, index: Index, q: Query, ordered: bool = True) -> DataFrame:
    """All rows with exactly this key, by primary key."""
    if q.index == REVISION:
        return live.filter(F.col(REV) == q.value)
    if index.native and q.value is not None:
        found = live.filter(F.col(f"`{index.column}`") == F.lit(q.value))
    elif index.multi or index.is_map:
        found = live.filter(F.array_contains(index.keys(), F.lit(q.key)))
    else:
        found = live.filter(index.key() == F.lit(q.key))
    return found.orderBy(PK) if ordered else found


def get(live: DataFrame, index: Index, q: Query) -> DataFrame:
    """The first of list_: no row, or one."""
    found = list_(live, index, q, ordered=False)
    if index is not None and index.unique and not index.multi and not index.is_map:
        # a unique index that isn't primary isn't enforced; the last writer has the key
        return found.orderBy(F.desc(REV)).limit(1)
    return found.orderBy(PK).limit(1)


def _ranged(live: DataFrame, index: Index, native: Column | None, test) -> DataFrame:
    """Rows with a key that passes test, in order of key, then primary key."""
    if not (index.multi or index.is_map):
        found = live.filter(native if native is not None else test(index.key()))
        return found.withColumn(KEY, index.key()).filter(F.col(KEY).isNotNull()).orderBy(KEY, PK)
    if index.unique:  # once for each matching key
        return live.withColumn(KEY, F.explode(F.array_distinct(F.filter(index.keys(), test)))).orderBy(KEY, PK)
    # once for each object, at its first matching key
    return live.withColumn(KEY, F.array_min(F.filter(index.keys(), test))).filter(F.col(KEY).isNotNull()).orderBy(KEY, PK)


def prefix(live: DataFrame, index: Index, q: Query) -> DataFrame:
    """Rows with a key that begins with the query's; an integer's key is as wide as its type, so its prefix query is an exact one."""
    native = None
    if index.native and index.encoder.text and isinstance(q.value, str):
        native = F.startswith(F.col(f"`{index.column}`"), F.lit(q.value))
    elif index.native and q.value is not None and not index.encoder.text:
        native = F.col(f"`{index.column}`") == F.lit(q.value)
    return _ranged(live, index, native, lambda k: begins(k, q.key))


def lower_bound(live: DataFrame, index: Index, q: Query) -> DataFrame:
    """Rows with a key at or above the query's, ascending."""
    if q.index == REVISION:
        return live.filter(F.col(REV) >= q.value).orderBy(REV)
    native = F.col(f"`{index.column}`") >= F.lit(q.value) if index.native and q.value is not None else None
    return _ranged(live, index, native, lambda k: k >= F.lit(q.key))


def first(live: DataFrame) -> DataFrame:
    return live.limit(1)


def project(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Columns by name, whatever their case; a name that isn't there raises."""
    known = {c.lower(): c for c in rows.columns}
    if missing := [c for c in columns if c.lower() not in known]:
        raise KeyError(f"unknown columns: {', '.join(missing)}")
    return rows.select(*(known[c.lower()] for c in columns))


def grep(rows: DataFrame, pattern: str, columns: list[str] | None = None) -> DataFrame:
    """Rows whose text form matches a regular expression."""
    shown = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (columns or rows.columns) if c not in (PK, KEY)]
    return rows.filter(F.concat_ws("  ", *shown).rlike(pattern))
