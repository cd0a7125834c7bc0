"""Derived tables: a table kept in step with another's changes."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.access import PK

INSERT, UPDATE, DELETE, SKIP = "insert", "update", "delete", "skip"


class Derived:
    """Applies transform to each round of changes, in one transaction on the output.

    transform gets the changes (the input's columns, rev, deleted) and returns the output's columns with rev and `_action`: insert, update (only what is
    there), delete or skip. The output stays uninitialized until the input is initialized and was processed.
    """

    def __init__(self, changes, source, out, transform: Callable[[DataFrame], DataFrame]) -> None:
        self.changes, self.source, self.out, self.transform = changes, source, out, transform
        self.engine = source.engine
        with self.engine.write(out) as w:
            self.done = w.register_initializer(out, "derive")
        self.ready = False

    def step(self) -> int:
        """One round; the number of output operations."""
        snap = self.engine.snapshot()
        found = self.changes.frame(snap)
        acted = self.transform(found.drop(PK)).filter(F.col("_action") != SKIP)
        with self.engine.write(self.out) as w:
            there = w.frame(self.out).select(F.col(PK).alias("__pk"), F.lit(True).alias("__there"))
            keyed = acted.withColumn("__key", self.out.spec.primary.key())
            known = keyed.join(there, F.col("__key") == F.col("__pk"), "left")
            ops = known.filter((F.col("_action") != UPDATE) | F.col("__there")).withColumn("_op", F.when(F.col("_action") == DELETE, "delete").otherwise("insert"))
            before = w.revision(self.out)
            w.apply(self.out, ops.drop("__key", "__pk", "__there", "_action"), "rev")
            n = w.revision(self.out) - before
            if not self.ready and snap.initialized(self.source):
                self.ready = True
                self.done(w)
        top = snap.revision(self.source)
        self.changes.take(top, False)
        self.changes.take(top, True)
        return n

    def run(self, stop: threading.Event, interval: float = 0.05) -> threading.Thread:
        """Rounds until stop is set; an error ends the job and is kept in self.error."""
        self.error: Exception | None = None

        def loop() -> None:
            try:
                while not stop.is_set():
                    _, watch = self.engine.snapshot().all_watch(self.source)
                    self.step()
                    while not watch.wait(interval) and not stop.is_set():
                        pass
            except Exception as e:  # the job ends with its error
                self.error = e

        thread = threading.Thread(target=loop, daemon=True)
        thread.start()
        return thread
