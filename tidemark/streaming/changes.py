"""Change feeds: iterators with delete tracking, and observers."""

from __future__ import annotations

import itertools
import threading
import weakref
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans import commit
from tidemark.streaming.watch import Watch

_numbers = itertools.count(1)


@dataclass
class Tracker:
    """How far an iterator has seen deletions; those at or below go from the graveyard once all have."""

    revision: int

    def mark(self, revision: int) -> None:
        self.revision = max(self.revision, revision)


@dataclass(frozen=True)
class Change:
    obj: dict
    rev: int
    deleted: bool


class ChangeIterator:
    """Changes since the last call, the newest state of each key, in order of revision."""

    def __init__(self, table, revision: int) -> None:
        self.table, self.number = table, next(_numbers)
        self.tracker = Tracker(revision)
        self.seen_update, self.seen_delete = 0, revision
        self._open = True
        table.trackers[self.number] = self.tracker
        weakref.finalize(self, table.trackers.pop, self.number, None)

    def frame(self, reader) -> DataFrame:
        """The changes that next() would give, as (object's columns, _pk, rev, deleted), without taking them."""
        base = getattr(reader, "base", reader)  # of a transaction, what is committed
        v = base.versions[self.table.name]
        return commit.changes(self.table.live(v), self.table.graveyard(v), self.table.spec.columns, self.seen_update, self.seen_delete)

    def next(self, reader) -> tuple[Iterator[Change], Watch]:
        """The changes, taken one by one, and a watch: fired already while there may be more, else one that fires on the next commit."""
        if not self._open:
            raise ValueError("the change iterator is closed")
        base = getattr(reader, "base", reader)
        v = base.versions[self.table.name]
        rows = self.frame(base).limit(1).count()
        stale = self.table.engine.current(self.table) is not v
        watch = self.table.watches.add(lambda d: True, bool(rows) or stale)
        return self._take(self.frame(base)) if rows else iter(()), watch

    def _take(self, rows: DataFrame) -> Iterator[Change]:
        cols = self.table.spec.columns
        for r in rows.toLocalIterator():
            own = r.asDict(recursive=True)
            change = Change({c: own[c] for c in cols}, r["rev"], r["deleted"])
            self.take(change.rev, change.deleted)
            yield change

    def take(self, rev: int, deleted: bool) -> None:
        """Advances past a change."""
        if deleted:
            self.seen_delete = rev
            self.tracker.mark(rev)
        else:
            self.seen_update = rev

    def take_all(self, reader) -> DataFrame:
        """All changes as a frame, written before the cursors move past them."""
        base = getattr(reader, "base", reader)
        out = commit.written(self.frame(base), f"{self.table.name}-changes", "rev")
        top = base.versions[self.table.name].revision
        self.seen_update = self.seen_delete = top
        self.tracker.mark(top)
        return out.orderBy("rev")

    def close(self) -> None:
        if self._open:
            self._open = False
            self.table.trackers.pop(self.number, None)
            self.table.engine.gc()


def compacted(log: DataFrame, key: str, order: str, since: int, until: int | None = None) -> DataFrame:
    """The newest row of each key in a range of a revisioned log: a partial aggregation, so that a hot key isn't gathered."""
    ranged = log.filter(F.col(order) > since)
    if until is not None:
        ranged = ranged.filter(F.col(order) <= until)
    row = F.struct(*log.columns)
    return ranged.groupBy(F.col(key).alias("__key")).agg(F.max_by(row, F.col(order)).alias("__row")).select("__row.*")


def observe(engine, table, callback: Callable[[Change], None], stop: threading.Event, interval: float = 0.05) -> threading.Thread:
    """Pushes every change to a callback until stop is set."""
    with engine.write(table) as txn:
        changes = txn.changes(table)

    def run() -> None:
        while not stop.is_set():
            found, watch = changes.next(engine.snapshot())
            for c in found:
                callback(c)
            while not watch.wait(interval) and not stop.is_set():
                pass
        changes.close()

    thread = threading.Thread(target=run, daemon=True)
    thread.start()
    return thread


