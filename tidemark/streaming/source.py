"""A Structured Streaming source over a revisioned log: offsets are revisions, a batch is the newest state of each key in its range.

The log is a Parquet folder in the shared store with one part per commit, rows (object's columns, _pk, _revision, _deleted), that executors read themselves.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tidemark.operators.access import PK, REV
from tidemark.plans import commit
from tidemark.streaming.changes import compacted

GONE = "_deleted"


class Log:
    """An append-only log of a table's changes."""

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark = spark
        self.path = path or f"{commit.shared_dir(spark)}/log-{id(self)}"

    def append(self, changes: DataFrame) -> None:
        """Adds a change frame (rev and deleted as ChangeIterator gives them); a folder for each range of revisions."""
        rows = changes.withColumnRenamed("rev", REV).withColumnRenamed("deleted", GONE)
        top = rows.agg(F.max(REV)).first()[0]
        if top is not None:
            rows.write.mode("overwrite").parquet(f"{self.path}/commit={top:020d}")

    def read(self) -> DataFrame:
        return self.spark.read.option("basePath", self.path).parquet(self.path).drop("commit")

    def between(self, after: int, until: int | None = None) -> DataFrame:
        """The newest change of each key in (after, until]."""
        return compacted(self.read(), PK, REV, after, until).orderBy(REV)

    def at(self, revision: int) -> DataFrame:
        """The live rows at a revision."""
        return compacted(self.read(), PK, REV, 0, revision).filter(~F.col(GONE)).drop(GONE)

    def stream(self) -> DataFrame:
        """Changes as they are appended, in file order; foreachBatch gets whole commits."""
        return self.spark.readStream.schema(self.read().schema).option("recursiveFileLookup", "true").parquet(self.path)


def feed(log: Log, callback: Callable[[DataFrame, int], None], checkpoint: str):
    """A query that hands each micro-batch to a callback, compacted and in order of revision; restarts go on where it stopped."""

    def batch(df: DataFrame, number: int) -> None:
        callback(compacted(df, PK, REV, 0).orderBy(REV), number)

    return log.stream().writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()


class Range(InputPartition):
    def __init__(self, after: int, until: int) -> None:
        self.after, self.until = after, until


class RevisionReader(DataSourceStreamReader):
    """Serves a small feed given as JSON lines (rev, deleted, obj): the reader for tables behind a server."""

    def __init__(self, options: dict) -> None:
        self.url, self.table = options["url"], options["table"]
        self.acknowledged = 0

    def _ask(self, after: int) -> Iterator[dict]:
        from tidemark.operators.index import by_revision
        from tidemark.sources.http import RemoteTable

        for obj, rev in RemoteTable(self.url, self.table).lower_bound(by_revision(after + 1)):
            yield {"rev": rev, "obj": obj}

    def initialOffset(self) -> dict:
        return {"rev": 0}

    def latestOffset(self) -> dict:
        last = self.acknowledged
        for x in self._ask(last):
            last = max(last, x["rev"])
        return {"rev": last}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [Range(start["rev"], end["rev"])]

    def read(self, partition: Range) -> Iterator[tuple]:
        for x in self._ask(partition.after):
            if x["rev"] <= partition.until:
                yield x["rev"], json.dumps(x["obj"])

    def commit(self, end: dict) -> None:
        self.acknowledged = end["rev"]


class RevisionSource(DataSource):
    """format("tidemark") with the options url and table: rows (rev, obj) of a remote table's updates, by revision."""

    @classmethod
    def name(cls) -> str:
        return "tidemark"

    def schema(self) -> str:
        return "rev bigint, obj string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return RevisionReader(self.options)
