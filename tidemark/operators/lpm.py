"""Longest-prefix-match operators. A stored prefix is text of 0 and 1; the order is (bits padded with 0, length)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.access import PK, REV
from tidemark.operators.index import LPMIndex, Query

BITS, LEN = "_bits", "_len"
#: Prefix tables of up to this many rows are broadcast to the probes; they are counted first.
BROADCAST_ROWS = 200_000


def entries(live: DataFrame, index: LPMIndex) -> DataFrame:
    """One row for each stored prefix; of a unique index only the last writer's."""
    rows = live.withColumn(BITS, F.explode(F.array_distinct(index.all_bits()))).withColumn(LEN, F.length(BITS))
    if not index.unique:
        return rows
    last = rows.groupBy(BITS).agg(F.max(REV).alias("__rev")).withColumnRenamed(BITS, "__bits")
    return rows.join(last, (F.col(BITS) == F.col("__bits")) & (F.col(REV) == F.col("__rev"))).drop("__bits", "__rev")


def in_order(rows: DataFrame, width: int) -> DataFrame:
    return rows.orderBy(F.rpad(BITS, width, "0"), LEN, PK)


def all_entries(live: DataFrame, index: LPMIndex) -> DataFrame:
    return in_order(entries(live, index), index.width)


def prefix(live: DataFrame, index: LPMIndex, q: Query) -> DataFrame:
    """Stored prefixes within the query's; objects with several come several times."""
    return in_order(entries(live, index).filter(F.startswith(BITS, F.lit(q.bits))), index.width)


def lower_bound(live: DataFrame, index: LPMIndex, q: Query) -> DataFrame:
    padded = F.rpad(BITS, index.width, "0")
    at = q.bits.ljust(index.width, "0")
    return in_order(entries(live, index).filter((padded > at) | (padded == at) & (F.col(LEN) >= len(q.bits))), index.width)


def list_(live: DataFrame, index: LPMIndex, q: Query, covering: bool = False) -> DataFrame:
    """All objects at the one prefix that answers a key, by primary key.

    A key of full width gets the longest stored prefix that covers it. A shorter key gets, of the prefixes within it, the one that covers all of
    these, or none if there is no such one; if there are none within it, the longest that covers it. covering: always the latter.
    """
    own = entries(live, index)
    covers = F.startswith(F.lit(q.bits), F.col(BITS))
    best = own.filter(covers).agg(F.max_by(BITS, LEN).alias("__best"))
    if len(q.bits) < index.width and not covering:
        within = own.filter(F.startswith(BITS, F.lit(q.bits)))
        # one prefix covers all if it covers the first and the last of them
        ends = within.agg(F.min_by(BITS, LEN).alias("top"), F.min(BITS).alias("low"), F.max(BITS).alias("high"))
        top = F.when(F.startswith("low", "top") & F.startswith("high", "top"), F.col("top"))
        best = ends.crossJoin(best).select(F.when(F.col("top").isNull(), F.col("__best")).otherwise(top).alias("__best"))
    return own.join(F.broadcast(best), F.col(BITS) == F.col("__best"), "left_semi").orderBy(PK)


def get(live: DataFrame, index: LPMIndex, q: Query, covering: bool = False) -> DataFrame:
    return list_(live, index, q, covering).limit(1)


def probe(probes: DataFrame, bits: Column, stored: DataFrame, keep: list[str]) -> DataFrame:
    """Longest match for many full-width keys at once: probes with `match`, a struct of stored's columns named in keep.

    stored has BITS and LEN. A key meets only prefixes that equal it cut to one of the lengths that occur, so this is an equi-join
    over a small explode, never a comparison of all pairs. Prefixes are broadcast only if they are few. Every probe comes back as
    often as it is there; match is null where no prefix covers it, where its bits are null, or where nothing is stored. Of equal prefixes the
    greatest struct is taken.
    """
    lengths = sorted(r[0] for r in stored.select(LEN).distinct().collect())  # no more than the key's width
    few = stored.select(F.col(BITS).alias("__stored"), F.col(LEN).alias("__len"), F.struct(*keep).alias("__match"))
    few = F.broadcast(few) if stored.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else few
    # one answer for each distinct key, so that keys that repeat cost one row in the join
    keys = probes.select(bits.alias("__bits")).filter(F.col("__bits").isNotNull()).distinct()
    cut = keys.select("__bits", F.explode(F.array(*[F.substring("__bits", 1, n) for n in lengths]) if lengths else F.array().cast("array<string>")).alias("__cut"))
    hit = cut.join(few, F.col("__cut") == F.col("__stored"))
    best = hit.groupBy(F.col("__bits").alias("__key")).agg(F.max_by("__match", F.struct("__len", "__match")).alias("match"))
    own = [F.col(f"`{c}`") for c in probes.columns if c != "match"]
    return probes.withColumn("__bits", bits).join(best, F.col("__bits") == F.col("__key"), "left").select(*own, "match")
