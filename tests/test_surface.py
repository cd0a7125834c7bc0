"""Dumps, shell, HTTP, streaming, derived tables, reconciler and values on small fixtures."""

import io
import json
import threading
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import errors
from tidemark.functions import keys, status, values
from tidemark.metrics import Metrics
from tidemark.operators import derive, reconcile
from tidemark.operators.index import Index, by_revision
from tidemark.plans.engine import Engine, TableSpec
from tidemark.sources import dump
from tidemark.sources.http import RemoteTable, Server
from tidemark.sources.shell import Shell
from tidemark.streaming.changes import observe
from tidemark.streaming.source import Log, RevisionSource, feed

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("tags", T.ArrayType(T.StringType()))])
ID, TAGS = Index("id", "id", keys.uint64, unique=True), Index("tags", "tags", multi=True)


@pytest.fixture
def db(spark):
    return Engine(spark, Metrics())


@pytest.fixture
def table(db):
    t = db.create_table(TableSpec("test1", SCHEMA, ID, (TAGS,)))
    with db.write(t) as w:
        for k, tags in ((1, ["foo"]), (2, ["foo"]), (3, ["foobar"]), (4, ["baz"])):
            w.insert(t, {"id": k, "tags": tags})
    return t


def test_dump(db, table):
    out = io.StringIO()
    dump.write_json(db.read(), out)
    assert [x["id"] for x in json.loads(out.getvalue())["test1"]] == [1, 2, 3, 4]

    class Bad:
        def to_json(self):
            raise ValueError("no")

    assert json.loads(dump.safe_json(Bad())) == "marshalling failed: no"


def test_shell(db, table, tmp_path):
    sh = Shell(db)
    one = tmp_path / "a.yaml"
    one.write_text("id: 9\ntags: [\"x\"]\n---\nid: 10\ntags:\n  - y\n")
    sh.run(f"db/insert test1 {one}")
    assert sh.run("db/get test1 9 --columns id") == "id\n9\n"
    bad = tmp_path / "b.yaml"
    bad.write_text("id: 11\n---\nnope: 1\n")
    with pytest.raises(ValueError):
        sh.run(f"db/insert test1 {bad}")
    assert db.read().revision(table) == 6
    assert sh.run("db/list -i tags test1 foo --columns id").split() == ["id", "1", "2"]
    assert sh.run("db/prefix test1 foo -i tags -f json --delete").count("\n") == 3
    want = tmp_path / "want"
    want.write_text("id   tags\n4    baz\n9    x\n10   y\n")
    sh.run(f"db/cmp test1 {want}")
    with pytest.raises(AssertionError):
        sh.run(f"db/cmp test1 {want} --timeout 10ms --grep baz")
    with pytest.raises(AssertionError):
        sh.run("db/empty test1")
    sh.run("db/initialized --timeout 1s")
    assert "test1" in sh.run("db") and "test1" in sh.run("db/dump") and sh.complete("db/sh") == ["db/show"]
    assert "baz" in sh.run("db/watch test1")
    with pytest.raises(errors.TableNotRegistered):
        sh.run("db/show other")


def test_http(db, table):
    with Server(db) as s:
        remote = RemoteTable(s.url, "test1")
        assert [o["id"] for o, _ in remote.list(TAGS.query("foo"))] == [1, 2]
        assert remote.get(ID.query(3)) == ({"id": 3, "tags": ["foobar"]}, 3)
        assert [o["id"] for o, _ in remote.lower_bound(by_revision(0))] == [1, 2, 3, 4]
        with pytest.raises(errors.TableError):
            remote.get(Index("other", "id").query("1"))
        with pytest.raises(errors.TableError):
            RemoteTable(s.url, "missing").get(ID.query(1))
        feed_ = remote.changes()
        assert [next(feed_)["obj"]["id"] for _ in range(4)] == [1, 2, 3, 4]
        with db.write(table) as w:
            w.delete(table, {"id": 2})
        assert next(feed_) == {"rev": 5, "deleted": True, "obj": {"id": 2, "tags": ["foo"]}}
        feed_.close()


def test_streaming_source(spark, db, table, tmp_path):
    with Server(db) as s:
        spark.dataSource.register(RevisionSource)
        q = spark.readStream.format("tidemark").options(url=s.url, table="test1").load().writeStream.format("memory").queryName("tidemark_rows").start()
        q.processAllAvailable()
        q.stop()
    assert [r.rev for r in spark.table("tidemark_rows").orderBy("rev").collect()] == [1, 2, 3, 4]


def test_log(spark, db, table, tmp_path):
    with db.write(table) as w:
        changes = w.changes(table)
    log = Log(spark, f"file://{tmp_path}/log")
    log.append(changes.take_all(db.read()))
    with db.write(table) as w:
        w.delete(table, {"id": 1})
        w.insert(table, {"id": 2, "tags": ["new"]})
    log.append(changes.take_all(db.read()))
    assert [(r.id, r._deleted) for r in log.between(4).collect()] == [(1, True), (2, False)]
    assert sorted(r.id for r in log.at(4).collect()) == [1, 2, 3, 4]
    assert sorted(r.id for r in log.at(6).collect()) == [2, 3, 4]
    seen = []
    q = feed(log, lambda df, n: seen.extend(r.id for r in df.collect()), f"file://{tmp_path}/check")
    q.processAllAvailable()
    q.stop()
    assert sorted(set(seen)) == [1, 2, 3, 4]
    changes.close()


def test_observe(db, table):
    seen, stop = [], threading.Event()
    thread = observe(db, table, seen.append, stop)
    until = time.time() + 30
    while len(seen) < 4 and time.time() < until:
        time.sleep(0.05)
    stop.set()
    thread.join(30)
    assert [c.obj["id"] for c in seen] == [1, 2, 3, 4]


def test_derive(spark, db):
    src = db.create_table(TableSpec("src", SCHEMA, ID))
    out = db.create_table(TableSpec("out", T.StructType([T.StructField("id", T.LongType()), T.StructField("deleted", T.BooleanType())]), ID))
    with db.write(src) as w:
        loading = w.register_initializer(src, "load")
        changes = w.changes(src)
    tag = F.array_contains("tags", "skip")
    action = F.when(tag, derive.SKIP).when(~F.col("deleted"), derive.INSERT).when(F.array_contains("tags", "delete"), derive.DELETE).otherwise(derive.UPDATE)
    d = derive.Derived(changes, src, out, lambda c: c.select("id", "deleted", "rev", action.alias("_action")))
    with db.write(src) as w:
        for k, t in ((1, []), (2, []), (3, ["skip"])):
            w.insert(src, {"id": k, "tags": t})
    d.step()
    got = lambda: sorted((r["id"], r["deleted"]) for r in db.read().frame(out).collect())
    assert got() == [(1, False), (2, False)] and not db.read().initialized(out)
    with db.write(src) as w:
        loading(w)
        w.delete(src, {"id": 2})
        w.insert(src, {"id": 1, "tags": ["delete"]})
        w.delete(src, {"id": 1})
    d.step()
    assert got() == [(2, True)] and db.read().initialized(out)


class Target(reconcile.Operations):
    def __init__(self):
        self.log, self.faulty = [], set()

    def _do(self, what, obj):
        self.log.append((what, obj["id"]))
        if obj["id"] in self.faulty:
            raise ValueError("faulty")

    def update(self, reader, rev, obj):
        self._do("update", obj)

    def delete(self, reader, rev, obj):
        self._do("delete", obj)

    def prune(self, reader, objects):
        self.log.append(("prune", len(list(objects))))


STATUS = T.StructType([T.StructField("kind", T.StringType()), T.StructField("updated_at", T.DoubleType()), T.StructField("error", T.StringType()), T.StructField("id", T.LongType())])


def test_reconciler(db):
    t = db.create_table(TableSpec("objs", T.StructType([T.StructField("id", T.LongType()), T.StructField("status", STATUS)]), ID))
    ops = Target()
    r = reconcile.Reconciler(t, ops, reconcile.Options(prune_interval=10, refresh_interval=10))
    with db.write(t) as w:
        loading = w.register_initializer(t, "load")
        for k in (1, 2, 3):
            w.insert(t, {"id": k, "status": status.pending(now=0.0).row()})
    ops.faulty = {1}
    r.round(now=100.0)
    assert ops.log == [("update", 1), ("update", 2), ("update", 3)]
    kinds = lambda: {x["id"]: x["status"]["kind"] for x in db.read().frame(t).collect()}
    assert kinds() == {1: "Error", 2: "Done", 3: "Done"} and r.health()[0] == "Degraded"
    assert r.retries.wait(now=100.0) == pytest.approx(0.2) and r.wait_until_reconciled(1)[1] > 0
    ops.faulty, ops.log = set(), []
    r.round(now=100.1)
    assert ops.log == []
    r.round(now=101.0)
    assert ops.log == [("update", 1)] and kinds()[1] == "Done" and r.retries.low_watermark() == 0 and r.health() == ("OK", "3 object(s)")
    with db.write(t) as w:
        loading(w)
        w.delete(t, {"id": 2})
    ops.faulty, ops.log = {2}, []
    r.round(now=102.0)
    assert ops.log == [("delete", 2), ("prune", 2)]
    ops.faulty, ops.log = set(), []
    r.round(now=103.0)
    assert ops.log == [("delete", 2)] and not r.retries.errors()
    assert r.refresh(now=200.0) == 2 and set(kinds().values()) == {"Refreshing"}
    ops.log = []
    r.round(now=200.0)
    assert sorted(ops.log) == [("prune", 2), ("update", 1), ("update", 3)]


def test_retries():
    r = reconcile.Retries(0.1, 1.0)
    delays = [r.add(b"a", {}, 5, False, ValueError(), now=0.0) for _ in range(5)]
    assert delays == pytest.approx([0.2, 0.4, 0.8, 1.0, 1.0])
    r.add(b"b", {}, 3, True, ValueError(), now=0.0)
    assert r.top()[0] == b"b" and r.low_watermark() == 3
    assert r.pop()[0] == b"b" and r.top()[0] == b"a"
    r.clear(b"a")
    assert r.top() is None and len(r.errors()) == 1


def test_status():
    s = status.error("bad", now=1.0)
    assert status.Status.from_json(s.to_json()) == s and str(s).startswith("Error: bad (")
    with pytest.raises(ValueError):
        status.Status.from_json('{"kind": "Other"}')
    many = status.StatusSet()
    assert many.get("x").kind == "Pending" and many.get("x").id == many.id
    many = many.set("a", status.done()).set("b", s)
    assert str(many) == "Errored: b (bad), Done: a" and set(many.all()) == {"a", "b"}
    assert {x.kind for x in many.pending().all().values()} == {"Pending"}
    assert [status.pretty_duration(x) for x in (5e-6, 0.0123, 1.5, 90, 7200)] == ["5.0us", "12.3ms", "1.5s", "1.5m", "2.0h"]


def test_values(spark):
    df = spark.sql("SELECT map('2_two', 2, '1_one', 1, '3_three', 3) AS m, array('foo', 'bar', 'baz', 'foo') AS s")
    m, s = F.col("m"), F.col("s")
    r = df.select(
        values.map_json(m).alias("j"),
        F.transform(values.map_lower_bound(m, F.lit("2")), lambda e: e["value"]).alias("lb"),
        F.transform(values.map_prefix(m, "2"), lambda e: e["value"]).alias("p"),
        values.new_set(s).alias("set"),
        values.map_equal(m, values.map_set(m, F.lit("1_one"), F.lit(1))).alias("eq"),
        values.map_update(m, F.create_map(F.lit("1_one"), F.lit(9))).alias("u"),
        values.set_json(s).alias("sj"),
        values.map_equal(values.map_from_json(values.map_json(m), "int"), m).alias("back"),
    ).first()
    assert r.j == '[{"k":"1_one","v":1},{"k":"2_two","v":2},{"k":"3_three","v":3}]'
    assert (r.lb, r.p, r.set, r.eq, r.u["1_one"], r.sj, r.back) == ([2, 3], [2], ["bar", "baz", "foo"], True, 9, '["bar","baz","foo"]', True)
