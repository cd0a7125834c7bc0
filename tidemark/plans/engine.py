"""The engine: immutable table versions behind one reference, snapshots, and atomic transactions over several tables.

A version is a stack of written layers, each with what one or more commits touched, plus a small overlay of rows changed since (kept on the driver and no
larger than FOLD). Single-row operations go to the overlay; frames of operations are planned as merges (see commit.py) and written as a layer before they
are published, so that a failure leaves the old version. Readers merge the layers; layers of like size are written together.
"""

from __future__ import annotations

import threading
import time
import warnings
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import errors
from tidemark.metrics import NoMetrics, txn_key
from tidemark.operators import access, lpm
from tidemark.operators.access import PK, REV
from tidemark.operators.index import REVISION, Index, LPMIndex, Query, check_indexes, check_name
from tidemark.plans import commit
from tidemark.streaming.watch import Delta, Watch, Watches

#: Rows of an overlay before it is folded into the version's frame.
FOLD = 2000
#: Layers that a transaction may stack before it writes some together; each commit does so where their sizes ask for it.
DEEP = 8
#: Columns that the engine adds to a table's own.
RESERVED = frozenset(("_pk", "_revision", "_seq", "_op"))


@dataclass(frozen=True)
class TableSpec:
    name: str
    schema: T.StructType
    primary: Index
    secondary: tuple[Index | LPMIndex, ...] = ()
    header: tuple[str, ...] | None = None
    row: Callable[[dict], list[str]] | None = None

    def __post_init__(self) -> None:
        check_name(self.name)
        if taken := sorted(RESERVED & set(self.schema.fieldNames())):
            raise errors.ReservedColumn(f"columns {taken} are the engine's own", self.name)
        check_indexes(self.name, self.primary, self.secondary)

    @property
    def columns(self) -> list[str]:
        return self.schema.fieldNames()

    @property
    def indexes(self) -> list[str]:
        return sorted([self.primary.name, *(x.name for x in self.secondary)])

    def index(self, name: str) -> Index | LPMIndex:
        """By name; an empty name is the primary one."""
        for x in (self.primary, *self.secondary):
            if x.name == (name or self.primary.name):
                return x
        if name == REVISION:
            return self.primary
        raise errors.UnknownIndex(f"no index {name!r}", self.name)

    def pk(self, row: dict) -> bytes:
        keys = self.primary.object_keys(row)
        if not keys:
            raise errors.TableError("the object has no primary key", self.name)
        return keys[0]


@dataclass(frozen=True)
class Version:
    """A table at a commit. base and dead are the live rows and the graveyard of its layers, with _pk and _revision; over and grave are what changed since: _pk to (row, revision), or none where a base row is gone.

    low is the revision up to which deletions have left the graveyard.
    """

    revision: int = 0
    layers: tuple[commit.Layer, ...] = ()
    low: int = 0
    base: DataFrame | None = None
    dead: DataFrame | None = None
    over: dict[bytes, tuple[dict, int] | None] = field(default_factory=dict)
    grave: dict[bytes, tuple[dict, int] | None] = field(default_factory=dict)
    pending: frozenset[str] = frozenset()
    ever: bool = False
    last_write: float = 0.0


class Table:
    """A registered table."""

    def __init__(self, engine: Engine, spec: TableSpec, number: int) -> None:
        self.engine, self.spec, self.number, self.lock = engine, spec, number, threading.RLock()
        self.trackers: dict[int, Any] = {}
        self.watches = Watches()
        self.owner: str | None = None

    @property
    def name(self) -> str:
        return self.spec.name

    def full_schema(self) -> T.StructType:
        return T.StructType([*self.spec.schema.fields, T.StructField(PK, T.BinaryType()), T.StructField(REV, T.LongType())])

    def frame(self, rows: dict[bytes, tuple[dict, int] | None]) -> DataFrame:
        data = [(*(r[0].get(c) for c in self.spec.columns), k, r[1]) for k, r in rows.items() if r is not None]
        return self.engine.spark.createDataFrame(data, self.full_schema())

    def combined(self, base: DataFrame | None, over: dict) -> DataFrame:
        fresh = self.frame(over)
        if base is None:
            return fresh
        if not over:
            return base
        # the overlay is bounded by FOLD, so its keys may be broadcast
        gone = self.engine.spark.createDataFrame([(k,) for k in over], T.StructType([T.StructField(PK, T.BinaryType())]))
        return base.join(F.broadcast(gone), PK, "left_anti").select(*self.spec.columns, PK, REV).unionByName(fresh)

    def stacked(self, v: Version, layers: tuple[commit.Layer, ...]) -> Version:
        """v with these layers."""
        rows = lambda op: commit.stacked(layers, self.spec.columns, (op,)).drop("_op") if layers else None
        dead = rows("delete")
        return replace(v, layers=layers, base=rows("insert"), dead=dead if dead is None else dead.filter(F.col(REV) > v.low))

    def pushed(self, v: Version, top: commit.Layer) -> Version:
        """v with one more layer."""
        layers = (*v.layers, top) if top.count else v.layers
        return self.stacked(v, commit.compact(layers, self.spec.columns, v.low, self.name) if len(layers) > DEEP else layers)

    def folded(self, v: Version) -> Version:
        """v with its overlay written as a layer."""
        if not v.over and not v.grave:
            return v
        blank = dict.fromkeys(self.spec.columns)
        state = {k: (*r, "insert") if r is not None else (*g, "delete") if (g := v.grave.get(k)) is not None else (blank, v.revision, "gone") for k, r in v.over.items()}
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in (*self.full_schema().fields, T.StructField("_op", T.StringType()))])
        rows = self.engine.spark.createDataFrame([(*(r.get(c) for c in self.spec.columns), k, rev, op) for k, (r, rev, op) in state.items()], schema)
        return self.pushed(replace(v, over={}, grave={}), commit.layer(rows, self.spec.columns, self.name))

    def live(self, v: Version) -> DataFrame:
        return self.combined(v.base, v.over)

    def graveyard(self, v: Version) -> DataFrame:
        return self.combined(v.dead, v.grave)


class Reader:
    """Reads of tables at the versions that it holds."""

    def __init__(self, engine: Engine, versions: dict[str, Version]) -> None:
        self.engine, self.versions = engine, versions

    def _at(self, table: Table) -> Version:
        if table.name not in self.versions:
            raise errors.TableNotRegistered("not registered", table.name)
        return self.versions[table.name]

    def frame(self, table: Table) -> DataFrame:
        """The live rows, unordered, with _pk and _revision."""
        return table.live(self._at(table))

    def graveyard(self, table: Table) -> DataFrame:
        return table.graveyard(self._at(table))

    def all(self, table: Table) -> DataFrame:
        return access.all_rows(self.frame(table))

    def _call(self, kind: str, table: Table, q: Query) -> DataFrame:
        index = table.spec.index(q.index)
        if isinstance(index, LPMIndex):
            return getattr(lpm, kind)(self.frame(table), index, q)
        return getattr(access, kind)(self.frame(table), index, q)

    def get(self, table: Table, q: Query) -> DataFrame:
        return self._call("get", table, q)

    def list(self, table: Table, q: Query) -> DataFrame:
        return self._call("list_", table, q)

    def prefix(self, table: Table, q: Query) -> DataFrame:
        return self._call("prefix", table, q)

    def lower_bound(self, table: Table, q: Query) -> DataFrame:
        return self._call("lower_bound", table, q)

    def revision(self, table: Table) -> int:
        return self._at(table).revision

    def num_objects(self, table: Table) -> int:
        return self.frame(table).count()

    def initialized(self, table: Table) -> bool:
        return not self._at(table).pending

    def pending_initializers(self, table: Table) -> list[str]:
        return sorted(self._at(table).pending)

    # the notifying twins: the rows and a watch that fires once they may have changed
    def _watched(self, kind: str, table: Table, q: Query, match: Callable[[Delta], bool]) -> tuple[DataFrame, Watch]:
        watch = table.watches.add(match, self.engine.current(table) is not self._at(table))
        return self._call(kind, table, q), watch

    def _touches(self, table: Table, q: Query, exact: bool) -> Callable[[Delta], bool]:
        index = table.spec.index(q.index)
        if q.index == REVISION or isinstance(index, LPMIndex):
            return lambda d: True
        own = lambda k: k == q.key if exact else k.startswith(q.key)
        return lambda d: d.bulk or any(own(k) for row in (d.old, d.new) if row is not None for k in index.object_keys(row))

    def get_watch(self, table: Table, q: Query) -> tuple[DataFrame, Watch]:
        return self._watched("get", table, q, self._touches(table, q, True))

    def list_watch(self, table: Table, q: Query) -> tuple[DataFrame, Watch]:
        return self._watched("list_", table, q, self._touches(table, q, True))

    def prefix_watch(self, table: Table, q: Query) -> tuple[DataFrame, Watch]:
        return self._watched("prefix", table, q, self._touches(table, q, False))

    def lower_bound_watch(self, table: Table, q: Query) -> tuple[DataFrame, Watch]:
        return self._watched("lower_bound", table, q, lambda d: True)

    def all_watch(self, table: Table) -> tuple[DataFrame, Watch]:
        return self.all(table), table.watches.add(lambda d: True, self.engine.current(table) is not self._at(table))

    def initialized_watch(self, table: Table) -> tuple[bool, Watch]:
        done = self.initialized(table)
        return done, table.watches.add(lambda d: d.initialized, done or self.engine.current(table).pending == frozenset())


class WriteTxn(Reader):
    """An exclusive transaction over tables; reads see its own writes. A context manager: commits, or aborts on an exception."""

    def __init__(self, engine: Engine, tables: Iterable[Table], handle: str) -> None:
        own = {t.name: t for t in tables}
        self.tables = sorted(own.values(), key=lambda t: t.number)
        began = time.time()
        for t in self.tables:
            t.lock.acquire()
            t.owner = f"{handle} (since {time.time():.3f})"
        engine.metrics.duration("acquire", txn_key(handle, list(own)), time.time() - began)
        self.base = engine.snapshot()
        super().__init__(engine, dict(self.base.versions))
        self.handle, self.began, self.closed = handle, time.time(), False
        self.deltas: dict[str, list[Delta]] = {t.name: [] for t in self.tables}
        self.finished: list[tuple[Table, str]] = []
        self.fetched: dict[str, tuple[DataFrame, dict[bytes, tuple[dict, int]]]] = {}

    def __enter__(self) -> WriteTxn:
        return self

    def __exit__(self, kind, *_: Any) -> None:
        if kind is None:
            self.commit()
        else:
            self.abort()

    def __del__(self) -> None:
        if not getattr(self, "closed", True):
            warnings.warn("a write transaction was neither committed nor aborted", ResourceWarning, stacklevel=2)

    def _mine(self, table: Table) -> Version:
        if self.closed:
            raise errors.TransactionClosed("transaction is closed")
        if table.name not in self.deltas:
            raise errors.NotLockedForWriting("not locked for writing", table.name)
        return self.versions[table.name]

    def _old(self, table: Table, v: Version, pk: bytes) -> tuple[dict, int] | None:
        if pk in v.over:
            return v.over[pk]
        if v.base is None:
            return None
        base, known = self.fetched.get(table.name, (None, {}))
        if base is v.base and pk in known:
            return known[pk]
        return self._rows(table, v.base, [pk])[pk]

    @staticmethod
    def _rows(table: Table, base: DataFrame, pks: list[bytes]) -> dict[bytes, tuple[dict, int] | None]:
        out: dict[bytes, tuple[dict, int] | None] = dict.fromkeys(pks)
        for r in base.filter(F.col(PK).isin(*[F.lit(bytes(k)) for k in pks])).collect():
            row = r.asDict(recursive=True)
            out[bytes(row[PK])] = {c: row[c] for c in table.spec.columns}, row[REV]
        return out

    def prefetch(self, table: Table, pks: list[bytes], at_once: int = 1000) -> None:
        """Reads the rows with these keys in one job for every so many, so that what follows in this transaction needs no job for each."""
        v = self._mine(table)
        if v.base is None:
            return
        wanted = list(dict.fromkeys(k for k in pks if k not in v.over))
        found: dict[bytes, tuple[dict, int] | None] = {}
        for k in range(0, len(wanted), at_once):
            found |= self._rows(table, v.base, wanted[k : k + at_once])
        self.fetched[table.name] = v.base, found

    def _put(self, table: Table, v: Version, pk: bytes, new: dict | None, old: tuple[dict, int] | None) -> None:
        rev = v.revision + 1
        over, grave = dict(v.over), dict(v.grave)
        if new is None:
            over[pk] = None
            if table.trackers:
                grave[pk] = (old[0], rev)
        else:
            over[pk] = (new, rev)
            if v.dead is not None or pk in grave:
                grave[pk] = None
        self.versions[table.name] = replace(v, revision=rev, over=over, grave=grave)
        self.deltas[table.name].append(Delta(pk, old and old[0], new))

    def insert(self, table: Table, row: dict) -> tuple[dict | None, bool]:
        """Upsert; the row that was there and whether one was."""
        return self._upsert(table, row, None, None)

    def insert_watch(self, table: Table, row: dict) -> tuple[dict | None, bool, Watch]:
        old, had = self.insert(table, row)
        pk, own = table.spec.pk(row), len(self.deltas[table.name])
        return old, had, table.watches.add(lambda d: d.bulk or d.pk == pk, False, skip=(self, own))

    def modify(self, table: Table, row: dict, merge: Callable[[dict, dict], dict]) -> tuple[dict | None, bool]:
        """Upsert of merge(old, row) where there is an old row, else of row."""
        return self._upsert(table, row, merge, None)

    def compare_and_swap(self, table: Table, revision: int, row: dict) -> tuple[dict | None, bool]:
        """Upsert if the row there has this revision; 0 doesn't guard."""
        return self._upsert(table, row, None, revision)

    def _upsert(self, table: Table, row: dict, merge, guard: int | None) -> tuple[dict | None, bool]:
        v, row = self._mine(table), {c: row.get(c) for c in table.spec.columns}
        pk = table.spec.pk(row)
        old = self._old(table, v, pk)
        if guard:
            if old is None:
                raise errors.ObjectNotFound("object not found")
            if old[1] != guard:
                raise errors.RevisionNotEqual(f"revision is {old[1]}, not {guard}")
        self._put(table, v, pk, merge(dict(old[0]), row) if merge and old else row, old)
        return (old[0], True) if old else (None, False)

    def delete(self, table: Table, row: dict) -> tuple[dict | None, bool]:
        return self._remove(table, row, None)

    def compare_and_delete(self, table: Table, revision: int, row: dict) -> tuple[dict | None, bool]:
        """Delete if the row there has this revision; 0 doesn't guard."""
        return self._remove(table, row, revision)

    def _remove(self, table: Table, row: dict, guard: int | None) -> tuple[dict | None, bool]:
        v = self._mine(table)
        pk = table.spec.pk(row)
        old = self._old(table, v, pk)
        if old is None:
            return None, False
        if guard and old[1] != guard:
            raise errors.RevisionNotEqual(f"revision is {old[1]}, not {guard}")
        self._put(table, v, pk, None, old)
        return old[0], True

    def delete_all(self, table: Table) -> None:
        """Every row, in order of primary key, each with a revision of its own."""
        v = self._mine(table)
        if v.base is None:
            for pk in sorted(k for k, r in v.over.items() if r is not None):
                now = self.versions[table.name]
                self._put(table, now, pk, None, now.over[pk])
            return
        ranked = self.frame(table)
        order = commit.written(ranked.repartitionByRange(PK).sortWithinPartitions(PK).withColumn("_seq", F.monotonically_increasing_id()), table.name)
        self.apply(table, order.drop(REV).withColumn("_op", F.lit("delete")), "_seq")

    def delete_where(self, table: Table, rows: DataFrame) -> None:
        """Deletes the rows that a query found, in order of primary key."""
        keys = rows.select(PK).distinct()
        order = commit.written(self.frame(table).join(keys, PK, "left_semi").repartitionByRange(PK).sortWithinPartitions(PK).withColumn("_seq", F.monotonically_increasing_id()), table.name)
        self.apply(table, order.drop(REV).withColumn("_op", F.lit("delete")), "_seq")

    def insert_frame(self, table: Table, rows: DataFrame, order_by: str) -> None:
        """Upserts of a frame's rows in order of a column of unique integers."""
        self.apply(table, rows.withColumn("_op", F.lit("insert")), order_by, inserts=True)

    def delete_frame(self, table: Table, rows: DataFrame, order_by: str) -> None:
        self.apply(table, rows.withColumn("_op", F.lit("delete")), order_by)

    def apply(self, table: Table, ops: DataFrame, order_by: str, inserts: bool = False) -> None:
        """A frame of operations (`_op` is insert or delete) in order of a column of unique integers; inserts: all are inserts."""
        v = table.folded(self._mine(table))
        cols = table.spec.columns
        known = [F.col(f"`{c}`").cast(table.spec.schema[c].dataType).alias(c) if c in ops.columns else F.lit(None).cast(table.spec.schema[c].dataType).alias(c) for c in cols]
        staged = ops.select(*known, "_op", F.col(f"`{order_by}`").cast("bigint").alias("_seq")).withColumn(PK, table.spec.primary.key())
        if inserts:
            top, rev = commit.inserted(staged, cols, v.revision, table.name)
        else:
            top, rev = commit.merged(table.live(v), staged, cols, v.revision, bool(table.trackers), table.name)
        self._bulk(table, v, top, rev)

    def _bulk(self, table: Table, v: Version, top: commit.Layer, revision: int) -> None:
        self.versions[table.name] = replace(table.pushed(v, top), revision=revision)
        self.deltas[table.name].append(Delta(b"", None, None, bulk=True))

    def modify_frame(self, table: Table, rows: DataFrame, order_by: str, folds: dict[str, str]) -> None:
        """Modify in bulk with merges that combine: columns by their fold (sum, max, min), others by the last value. Each row counts as a revision."""
        v = table.folded(self._mine(table))
        cols = table.spec.columns
        staged = rows.select(*cols, F.col(f"`{order_by}`").cast("bigint").alias("__order")).withColumn(PK, table.spec.primary.key())
        # every row is one revision: a key's row has that of its last
        counted, rev = commit.numbered(staged, "__order", F.lit(True), REV, v.revision, table.name)
        done = commit.modified(table.live(v), counted, REV, cols, folds).withColumn("_op", F.lit("insert"))
        self._bulk(table, v, commit.layer(done, cols, table.name), rev)

    def guard_frame(self, table: Table, ops: DataFrame, order_by: str) -> DataFrame:
        """Compare-and-swap and -delete in bulk, one operation a key, in order of a column of unique integers: `_op` takes effect where `_expected` is the revision of
        the row there, or 0. A delete of what isn't there has no effect, whatever it expects.

        Result: ops with _pk, `_result` (ok, missing or conflict) and `_had_old`, written before the operations that are ok are applied. A null expectation is a conflict.
        """
        keyed = ops.withColumn(PK, table.spec.primary.key()).withColumn("_expected", F.coalesce(F.col("_expected").cast("bigint"), F.lit(-1)))
        results = commit.written(commit.guarded(self.frame(table), keyed, table.spec.columns), f"{table.name}-results")
        self.apply(table, results.filter("_result = 'ok'"), order_by)
        return results

    def register_initializer(self, table: Table, name: str) -> Callable[[WriteTxn], None]:
        """Marks the table as not yet loaded until the returned function is called with a transaction on it."""
        v = self._mine(table)
        if name in v.pending:
            raise errors.TableError(f"initializer {name!r} is registered already", table.name)
        self.versions[table.name] = replace(v, pending=v.pending | {name}, ever=True)
        called: list[bool] = []

        def done(txn: WriteTxn) -> None:
            now = txn._mine(table)
            if not called:
                called.append(True)
                txn.versions[table.name] = replace(now, pending=now.pending - {name})

        return done

    def changes(self, table: Table):
        """A change iterator from here: all live rows first, then what follows."""
        from tidemark.streaming.changes import ChangeIterator

        return ChangeIterator(table, self._mine(table).revision)

    def commit(self) -> Reader | None:
        """Publishes all tables at once; a snapshot at that point, or none if the transaction is over."""
        if self.closed:
            return None
        spans = {}
        for t in self.tables:
            v = self.versions[t.name]
            if len(v.over) > FOLD or len(v.grave) > FOLD:
                v = t.folded(v)
            if v.layers is not self.base.versions[t.name].layers:
                v = t.stacked(v, commit.compact(v.layers, t.spec.columns, v.low, t.name))
            spans[t.name] = replace(v, last_write=time.time())
        before = self.base.versions
        snap = self.engine.publish(spans)
        for t in self.tables:
            started = bool(before[t.name].pending) and not spans[t.name].pending
            t.watches.fire(self.deltas[t.name], started, self)
            self.engine.metrics.gauge("revision", f"{self.handle}/{t.name}", spans[t.name].revision)
        self._close()
        return snap

    def abort(self) -> None:
        if not self.closed:
            for t in self.tables:
                t.watches.drop(self)
            self._close()

    def _close(self) -> None:
        self.closed = True
        for t in self.tables:
            t.owner = None
            t.lock.release()
        self.engine.metrics.duration("txn", txn_key(self.handle, list(self.deltas)), time.time() - self.began)


class Engine:
    """The tables of one driver."""

    def __init__(self, spark: SparkSession, metrics: NoMetrics | None = None, name: str = "db") -> None:
        self.spark, self.metrics, self.name = spark, metrics or NoMetrics(), name
        self._lock = threading.Lock()
        self._tables: dict[str, Table] = {}
        self._root: dict[str, Version] = {}

    def create_table(self, spec: TableSpec) -> Table:
        with self._lock:
            if spec.name in self._tables:
                raise errors.DuplicateTable("there is a table of that name", spec.name)
            table = Table(self, spec, len(self._tables))
            self._tables[spec.name] = table
            self._root = self._root | {spec.name: Version()}
        return table

    def tables(self) -> list[Table]:
        return list(self._tables.values())

    def table(self, name: str) -> Table | None:
        return self._tables.get(name)

    def handle(self, name: str) -> Handle:
        return Handle(self, name)

    def snapshot(self) -> Reader:
        """A read transaction: the root as it is now."""
        return Reader(self, self._root)

    read = snapshot

    def write(self, *tables: Table, handle: str | None = None) -> WriteTxn:
        if missing := [t.name for t in tables if self._tables.get(t.name) is not t]:
            raise errors.TableNotRegistered("not registered", missing[0])
        return WriteTxn(self, tables, handle or self.name)

    def current(self, table: Table) -> Version:
        return self._root[table.name]

    def publish(self, versions: dict[str, Version]) -> Reader:
        with self._lock:
            self._root = self._root | versions
            return Reader(self, self._root)

    def gc(self) -> dict[str, int]:
        """Drops graveyard rows that every tracker has seen; the low watermark of each table. Nothing is written: their rows leave the files when layers are next written together."""
        out = {}
        for t in self.tables():
            with t.lock:
                v = self.current(t)
                low = min([v.revision, *(x.revision for x in t.trackers.values())])
                out[t.name] = low
                grave = {k: r for k, r in v.grave.items() if r is None or r[1] > low}
                if grave != v.grave or low > v.low:
                    self.publish({t.name: t.stacked(replace(v, grave=grave, low=low), v.layers)})
                self.metrics.gauge("low_watermark", f"{self.name}/{t.name}", low)
        return out

    def describe(self) -> DataFrame:
        """A row for each table, by name."""
        snap = self.snapshot()
        rows = [(t.name, snap.num_objects(t), snap.graveyard(t).count(), ", ".join(t.spec.indexes), ", ".join(snap.pending_initializers(t)), t.owner or "", snap.revision(t)) for t in sorted(self.tables(), key=lambda t: t.name)]
        return self.spark.createDataFrame(rows, "name string, objects long, zombies long, indexes string, initializers string, lock string, revision long")

    def start(self) -> Engine:
        return self

    def stop(self) -> None:
        self.gc()

    def __enter__(self) -> Engine:
        return self.start()

    def __exit__(self, *_: Any) -> None:
        self.stop()


class Handle:
    """An engine under a name, for metrics and lock info."""

    def __init__(self, engine: Engine, name: str) -> None:
        self.engine, self.name = engine, name

    def write(self, *tables: Table) -> WriteTxn:
        return self.engine.write(*tables, handle=self.name)

    def snapshot(self) -> Reader:
        return self.engine.snapshot()

    read = snapshot


