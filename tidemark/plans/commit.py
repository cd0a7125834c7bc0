"""Bulk commits as plans: revisions by a distributed running count, last writer by key, layers of what commits touched.

An operations frame has the object's columns, `_op` ("insert" or "delete"), `_seq` (its order, a long) and `_pk`.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.access import PK, REV

def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one is set only where none is configured and all run on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder, in order of a column within its files so that ranges prune."""
    path = f"{shared_dir(df.sparkSession)}/tables/{name}-{uuid.uuid4().hex}"
    (df.sortWithinPartitions(by) if by else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def running_count(df: DataFrame, order: str, counted: Column, into: str, start: int = 0) -> DataFrame:
    """df with start plus the number of rows up to each, in order, for which counted holds. No task holds more than a range."""
    return numbered(df, order, counted, into, start)[0]


def dealt(df: DataFrame, order: str, name: str = "ranges") -> DataFrame:
    """df in as many ranges of the order column as the session has shuffle partitions, written with `__range`, so that ranges can't change under a retry."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(df.repartitionByRange(n, order).withColumn("__range", F.spark_partition_id()), name)


def numbered(df: DataFrame, order: str, counted: Column, into: str, start: int = 0, name: str = "ranges") -> tuple[DataFrame, int]:
    """running_count, and the count after the last row."""
    return counted_up(dealt(df.withColumn("__counted", counted.cast("bigint")), order, name), order, into, start)


def counted_up(ranged: DataFrame, order: str, into: str, start: int) -> tuple[DataFrame, int]:
    """The running sum of `__counted` over dealt ranges, whose own sums, one number each, come to the driver and go back as offsets."""
    totals = dict(ranged.groupBy("__range").agg(F.sum("__counted")).collect())
    offsets, total = [], start
    for k in sorted(totals):
        offsets.append((k, total))
        total += totals[k] or 0
    w = Window.partitionBy("__range").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    table = F.broadcast(ranged.sparkSession.createDataFrame(offsets, "__k int, __offset bigint"))  # a row for each range
    out = ranged.join(table, F.col("__range") == F.col("__k")).withColumn(into, (F.col("__offset") + F.sum("__counted").over(w)).cast("bigint"))
    return out.drop("__range", "__counted", "__k", "__offset"), total


class Layer(NamedTuple):
    """What one or more commits wrote: a row for each key that they touched (columns, _pk, _revision, `_op`), and their number.

    `_op` is insert, delete (the row is the one deleted, for the graveyard) or gone (deleted while nobody tracked deletions).
    """

    rows: DataFrame
    count: int


def layer(rows: DataFrame, columns: list[str], name: str) -> Layer:
    """rows as a layer, written in order of the key."""
    out = written(rows.select(*columns, PK, REV, "_op"), name, PK)
    return Layer(out, out.count())


def stacked(layers: Sequence[Layer], columns: list[str], ops: tuple[str, ...]) -> DataFrame:
    """The newest row of each key over layers, oldest first, where its operation is one of ops.

    Each layer is compared once with the keys of all newer ones, so the oldest and largest is shuffled at most once, and filters on columns reach every scan.
    """
    out, newer = None, None
    for x in reversed(layers):
        rows = x.rows.filter(F.col("_op").isin(*ops))
        rows = rows if newer is None else rows.join(newer, PK, "left_anti")
        rows = rows.select(*columns, PK, REV, "_op")
        out = rows if out is None else rows.unionByName(out)
        newer = x.rows.select(PK) if newer is None else newer.unionByName(x.rows.select(PK))
    return out


#: A layer is written together with all later ones once it has no more than so many times their rows.
RATIO = 2


def compact(layers: tuple[Layer, ...], columns: list[str], low: int, name: str) -> tuple[Layer, ...]:
    """Layers of which each has over RATIO times the rows of all later ones: the newest are written together as far as needed, older ones stay as they are.

    So a commit writes what it touches, and a row is rewritten a logarithmic number of times. Deletions stay in a layer while older layers may hold their keys;
    in the oldest, those that every tracker has seen (up to the revision low) go.
    """
    later = [sum(y.count for y in layers[k + 1 :]) for k in range(len(layers))]
    first = next((k for k, x in enumerate(layers[:-1]) if x.count <= RATIO * later[k]), None)
    if first is None:
        return layers
    kept = stacked(layers[first:], columns, ("insert", "delete", "gone"))
    if not first:
        kept = kept.filter((F.col("_op") == "insert") | (F.col("_op") == "delete") & (F.col(REV) > low))
    return (*layers[:first], layer(kept, columns, name))


def inserted(ops: DataFrame, columns: list[str], revision: int, name: str = "ops") -> tuple[Layer, int]:
    """merged for inserts alone: each has an effect, so neither the rows that are there nor a key's earlier operations are looked up."""
    counted, top = numbered(ops.drop("_op"), "_seq", F.lit(True), REV, revision, name)
    # the last writer of a key, by a partial aggregation, so that a hot key isn't gathered
    final = counted.groupBy(F.col(PK).alias("__pk")).agg(F.max_by(F.struct(*columns, PK, REV), REV).alias("__row")).select("__row.*")
    return layer(final.withColumn("_op", F.lit("insert")), columns, name), top


def merged(base: DataFrame, ops: DataFrame, columns: list[str], revision: int, tracked: bool, name: str = "ops") -> tuple[Layer, int]:
    """The layer and revision of ops over the live rows: insert replaces, delete of what isn't there has no effect and no revision.

    Whether a deletion has an effect depends on the key's operation before it. That is looked up within ranges of the order, and across them from one row
    for each key and range, so that a key with a large share of all operations is spread over the ranges.
    """
    ranged = dealt(ops, "_seq", name)
    inserts = F.col("_op") == "insert"
    row = F.struct(*columns)
    each = ranged.groupBy(F.col(PK).alias("__pk"), F.col("__range").alias("__r")).agg(F.max_by("_op", "_seq").alias("__op"), F.max_by(F.when(inserts, row), F.when(inserts, F.col("_seq"))).alias("__row"))
    there = base.select(PK, F.lit(True).alias("__base"))
    across = Window.partitionBy("__pk").orderBy("__r")
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    each = each.join(there, F.col("__pk") == F.col(PK), "left").drop(PK)
    each = each.select("__pk", "__r", F.coalesce(F.lag("__op").over(across) == "insert", F.col("__base"), F.lit(False)).alias("__there"), F.last("__row", ignorenulls=True).over(earlier).alias("__far"))
    within = Window.partitionBy(PK, "__range").orderBy("_seq")
    near = F.last(F.when(inserts, row), ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, -1))
    known = ranged.withColumn("__lag", F.lag("_op").over(within)).withColumn("__near", near if tracked else F.lit(None).cast("string"))
    known = known.join(each, (F.col(PK) == F.col("__pk")) & (F.col("__range") == F.col("__r"))).drop("__pk", "__r")
    effective = inserts | F.coalesce(F.col("__lag") == "insert", F.col("__there"))
    prior = F.coalesce("__near", "__far") if tracked else F.lit(None).cast("string")
    marked = written(known.filter(effective).withColumn("__prior", prior).withColumn("__counted", F.lit(1).cast("bigint")).drop("__lag", "__near", "__far", "__there"), name)
    counted, top = counted_up(marked, "_seq", REV, revision)
    last = F.max_by(F.struct(row.alias("__new"), "_op", REV, "__prior"), "_seq").alias("__row")
    final = counted.groupBy(PK).agg(last).select(PK, "__row.*")
    if not tracked:
        op = F.when(inserts, "insert").otherwise("gone").alias("_op")
        return layer(final.select("__new.*", PK, REV, op), columns, name), top
    # a deletion keeps the row that it deleted: of the key's last insert in ops, else the one there
    old = base.select(F.col(PK).alias("__pk"), row.alias("__old"))
    kept = F.when(inserts, F.col("__new")).otherwise(F.coalesce("__prior", "__old")).alias("__kept")
    return layer(final.join(old, F.col(PK) == F.col("__pk"), "left").select(kept, PK, REV, "_op").select("__kept.*", PK, REV, "_op"), columns, name), top


#: Merges that may be applied in any grouping, so that partial results combine before the shuffle.
FOLDS = {"sum": (F.sum, lambda a, b: a + b), "max": (F.max, F.greatest), "min": (F.min, F.least)}


def modified(base: DataFrame, rows: DataFrame, order: str, columns: list[str], folds: dict[str, str]) -> DataFrame:
    """Modify in bulk: rows of a key folded together and into the row that is there, a column by its fold or else the last value.

    Result: columns, _pk, the order of the key's last row, and how many rows there were.
    """
    last = lambda c: F.max_by(F.col(c), F.col(order))
    grouped = rows.groupBy(PK).agg(*[(FOLDS[folds[c]][0](c) if c in folds else last(c)).alias(c) for c in columns], F.max(order).alias(order), F.count(F.lit(1)).alias("_n"))
    old = base.select(F.col(PK).alias("__pk"), F.struct(*columns).alias("__old"))
    both = grouped.join(old, F.col(PK) == F.col("__pk"), "left")
    pick = lambda c: F.when(F.col("__old").isNull(), F.col(c)).otherwise(FOLDS[folds[c]][1](F.col(f"__old.{c}"), F.col(c))) if c in folds else F.col(c)
    return both.select(*[pick(c).alias(c) for c in columns], PK, order, "_n")


def guarded(base: DataFrame, ops: DataFrame, columns: list[str]) -> DataFrame:
    """Compare-and-swap and -delete in bulk, one operation a key: ops with `_expected` get `_result` (ok, missing or conflict) and had_old.

    An expected revision of 0 doesn't guard.
    """
    at = base.select(F.col(PK).alias("__pk"), F.col(REV).alias("__rev"))
    both = ops.join(at, F.col(PK) == F.col("__pk"), "left")
    free = F.col("_expected") == 0
    result = F.when(free | (F.col("__rev") == F.col("_expected")), "ok").when(F.col("__rev").isNull(), "missing").otherwise("conflict")
    return both.withColumn("_result", result).withColumn("_had_old", F.col("__rev").isNotNull()).drop("__pk", "__rev")


def changes(live: DataFrame, graveyard: DataFrame, columns: list[str], after_update: int, after_delete: int, until: int | None = None) -> DataFrame:
    """The change feed (columns, _pk, rev, deleted) after two cursors, in order of revision: the latest state of a key, or its deletion."""
    pick = lambda df, after, gone: df.filter(F.col(REV) > after).select(*columns, PK, F.col(REV).alias("rev"), F.lit(gone).alias("deleted"))
    out = pick(live, after_update, False).unionByName(pick(graveyard, after_delete, True))
    return (out if until is None else out.filter(F.col("rev") <= until)).orderBy("rev")
