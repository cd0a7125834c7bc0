"""Tables, transactions, reads, change feeds and bit prefixes on small fixtures."""

import threading

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import errors
from tidemark.functions import keys
from tidemark.operators import access, lpm
from tidemark.operators.index import Index, LPMIndex, by_revision
from tidemark.plans import commit
from tidemark.plans.engine import Engine, TableSpec
from tidemark.streaming.watch import Cancelled, Watch, WatchSet

SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("key", T.StringType()),
        T.StructField("prefix", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
    ]
)
ID = Index("id", "id", keys.uint64, unique=True)
TAGS = Index("tags", "tags", multi=True)
NET = LPMIndex("prefix", "prefix")


def obj(id_, tags=(), prefix=None, key=""):
    return {"id": id_, "key": key, "prefix": prefix, "tags": list(tags)}


@pytest.fixture
def db(spark):
    return Engine(spark)


@pytest.fixture
def objects(db):
    return db.create_table(TableSpec("test1", SCHEMA, ID, (TAGS, NET)))


def ids(frame, col="id"):
    return [r[col] for r in frame.collect()]


def test_golden_reads(db, objects):
    with db.write(objects) as w:
        w.insert(objects, obj(1, ["bar", "foo"], "10.0.0.0/8"))
        w.insert(objects, obj(2, ["baz", "foo"], "10.1.2.3/32"))
    r = db.read()
    assert ids(r.get(objects, TAGS.query("bar"))) == [1]
    assert ids(r.list(objects, TAGS.query("foo"))) == [1, 2]
    assert ids(r.prefix(objects, TAGS.query("ba"))) == [1, 2]
    for text, want in (("10.1.2.3/32", [2]), ("10.0.0.0/8", [1]), ("10.1.0.0/16", [2])):
        assert ids(r.get(objects, NET.query(text))) == want
    for text, want in (("0.0.0.0/0", [1, 2]), ("10.0.0.0/8", [1, 2]), ("10.1.2.3/32", [2])):
        assert ids(r.prefix(objects, NET.query(text))) == want
    for text, want in (("0.0.0.0/0", [1, 2]), ("10.0.0.0/8", [1, 2]), ("10.1.0.0/16", [2])):
        assert ids(r.lower_bound(objects, NET.query(text))) == want
    for n, want in ((0, [1, 2]), (1, [1, 2]), (2, [2]), (3, [])):
        assert ids(r.lower_bound(objects, ID.query(n))) == want
    assert ids(r.lower_bound(objects, by_revision(2))) == [2]
    with db.write(objects) as w:
        w.delete_where(objects, w.lower_bound(objects, ID.query(2)))
    assert ids(db.read().all(objects)) == [1]
    assert ids(r.all(objects)) == [1, 2]  # a snapshot doesn't change


def test_exact_is_not_prefix(spark, db):
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("tag", T.StringType())])
    id_, tag = Index("id", "id", unique=True), Index("tag", "tag")
    t = db.create_table(TableSpec("tags", schema, id_, (tag,)))
    with db.write(t) as w:
        for a, b in (("aa", "a"), ("b", "bb"), ("z", "b")):
            w.insert(t, {"id": a, "tag": b})
    r = db.read()
    assert ids(r.list(t, tag.query("a"))) == ["aa"] and ids(r.list(t, id_.query("a"))) == []
    assert ids(r.prefix(t, tag.query("aa"))) == []
    assert ids(r.prefix(t, tag.query("b"))) == ["z", "b"]
    assert ids(r.lower_bound(t, tag.query("aa"))) == ["z", "b"]


def test_revisions_and_guards(db, objects):
    w = db.write(objects)
    w.insert(objects, obj(1))
    w.abort()
    assert db.read().revision(objects) == 0 and ids(db.read().all(objects)) == []
    with pytest.raises(errors.TransactionClosed):
        w.insert(objects, obj(1))
    with db.write(objects) as w:
        with pytest.raises(errors.ObjectNotFound):
            w.compare_and_swap(objects, 1, obj(1))
        assert w.insert(objects, obj(1)) == (None, False)
        assert w.compare_and_swap(objects, 1, obj(1, ["x"]))[1]
        with pytest.raises(errors.RevisionNotEqual):
            w.compare_and_swap(objects, 1, obj(1, ["y"]))
        with pytest.raises(errors.RevisionNotEqual):
            w.compare_and_delete(objects, 1, obj(1))
        assert w.revision(objects) == 2
        assert w.delete(objects, obj(7)) == (None, False)
        assert w.compare_and_delete(objects, 2, obj(1))[1]
        assert w.compare_and_delete(objects, 2, obj(1)) == (None, False)
    assert db.read().revision(objects) == 3
    other = db.create_table(TableSpec("other", SCHEMA, ID))
    with db.write(other) as w, pytest.raises(errors.NotLockedForWriting):
        w.insert(objects, obj(1))


def test_modify(db, objects):
    join = lambda old, new: new | {"tags": sorted({*old["tags"], *new["tags"]})}
    with db.write(objects) as w:
        w.modify(objects, obj(1, ["foo"]), lambda *_: pytest.fail("there is nothing to merge"))
        w.modify(objects, obj(1, ["bar"]), join)
        assert ids(w.list(objects, TAGS.query("foo"))) == ids(w.list(objects, TAGS.query("bar"))) == [1]


def test_changes(db, objects):
    with db.write(objects) as w:
        for k in (42, 71, 83):
            w.insert(objects, obj(k))
        a, b = w.changes(objects), w.changes(objects)
    assert ids(db.read().graveyard(objects)) == []
    got, watch = a.next(db.read())
    assert [(c.obj["id"], c.deleted) for c in got] == [(42, False), (71, False), (83, False)] and watch.fired
    got, watch = a.next(db.read())
    assert not list(got) and not watch.fired
    with db.write(objects) as w:
        w.delete(objects, obj(42))
        w.delete(objects, obj(71))
    assert watch.fired
    with db.write(objects) as w:
        w.insert(objects, obj(71))
        w.delete(objects, obj(71))
    assert db.read().graveyard(objects).count() == 2
    got, _ = a.next(db.read())
    assert [(c.obj["id"], c.deleted, c.rev) for c in got] == [(42, True, 4), (71, True, 7)]
    got = b.take_all(db.read()).collect()
    assert [(r["id"], r["deleted"]) for r in got] == [(83, False), (42, True), (71, True)]
    db.gc()
    assert db.read().graveyard(objects).count() == 0
    a.close()
    b.close()


@pytest.mark.parametrize("fold", [True, False])
def test_bulk_equals_sequence(spark, db, fold):
    import random

    rnd = random.Random(7)
    ops = [(n, rnd.randrange(12), rnd.random() < 0.4) for n in range(150)]
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("n", T.LongType())])
    frames, rows = (db.create_table(TableSpec(n, schema, ID)) for n in ("frames", "rows"))
    with db.write(frames, rows) as w:
        w.changes(frames), w.changes(rows)
        keep = w.changes(frames), w.changes(rows)
    for part in (ops[:80], ops[80:90], ops[90:95], ops[95:]):
        with db.write(frames, rows) as w:
            w.apply(frames, spark.createDataFrame([(i, n, "delete" if d else "insert") for n, i, d in part], "id long, n long, _op string"), "n")
            for n, i, d in part:
                (w.delete if d else w.insert)(rows, {"id": i, "n": n})
    r = db.read()
    both = [sorted((x["id"], x["n"], x["_revision"]) for x in f.collect()) for f in (r.frame(frames), r.frame(rows), r.graveyard(frames), r.graveyard(rows))]
    assert r.revision(frames) == r.revision(rows) and both[0] == both[1] and both[2] == both[3]
    assert keep


def test_layers(spark, db):
    """A commit writes what it touches; layers of like size are written together; readers see one table."""
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("n", T.LongType())])
    t = db.create_table(TableSpec("layers", schema, ID))
    with db.write(t) as w:
        keep = w.changes(t)
        w.insert_frame(t, spark.range(20000).withColumn("n", F.lit(0)), "id")
    first = db.current(t).layers[0]
    for k in range(4):
        with db.write(t) as w:
            w.insert_frame(t, spark.range(100 * k, 100 * k + 50).withColumn("n", F.lit(k + 1)), "id")
            w.delete_frame(t, spark.range(100 * k + 50, 100 * k + 60).withColumn("n", F.lit(None).cast("long")), "id")
        now = db.current(t)
        assert now.layers[0] is first and sum(x.count for x in now.layers[1:]) == 60 * (k + 1)
        assert all(a.count > commit.RATIO * b.count for a, b in zip(now.layers, now.layers[1:], strict=False))
    r = db.read()
    assert r.num_objects(t) == 19960 and r.revision(t) == 20240
    assert {(x["n"], x["count"]) for x in r.frame(t).groupBy("n").count().collect()} == {(0, 19760), (1, 50), (2, 50), (3, 50), (4, 50)}
    dead = r.graveyard(t).collect()
    assert sorted(x["id"] for x in dead) == [100 * k + j for k in range(4) for j in range(50, 60)] and {x["n"] for x in dead} == {0}
    keep.take_all(r)
    db.gc()
    assert db.read().graveyard(t).count() == 0 and r.graveyard(t).count() == 40 and db.current(t).layers[0] is first
    with db.write(t) as w:
        w.delete_where(t, w.frame(t).filter("id >= 10000"))
    with db.write(t) as w:
        w.insert_frame(t, spark.range(10000).withColumn("n", F.lit(9)), "id")
    now = db.current(t)
    assert len(now.layers) == 1 and now.layers[0].rows.filter("_op <> 'insert'").count() == 10000
    assert db.read().num_objects(t) == 10000 and db.read().graveyard(t).count() == 10000
    keep.close()


def test_folded_overlay(spark, db, monkeypatch):
    """An overlay past its bound becomes a layer, deletions and tracked rows included."""
    monkeypatch.setattr("tidemark.plans.engine.FOLD", 5)
    t = db.create_table(TableSpec("folded", T.StructType([T.StructField("id", T.LongType(), False), T.StructField("n", T.LongType(), False)]), ID))
    with db.write(t) as w:
        keep = w.changes(t)
        w.insert_frame(t, spark.range(100).withColumn("n", F.lit(0)), "id")
    with db.write(t) as w:
        for k in range(6):
            w.delete(t, {"id": k})
        w.insert(t, {"id": 0, "n": 5})
    v, r = db.current(t), db.read()
    assert not v.over and not v.grave and len(v.layers) == 2
    assert r.num_objects(t) == 95 and sorted(ids(r.graveyard(t))) == [1, 2, 3, 4, 5] and r.revision(t) == 107
    assert {x["n"] for x in r.frame(t).filter("id = 0").collect()} == {5}
    keep.close()


def test_guard_frame(spark, db):
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("n", T.LongType())])
    t = db.create_table(TableSpec("guarded", schema, ID))
    with db.write(t) as w:
        w.insert_frame(t, spark.range(4).withColumn("n", F.lit(0)), "id")
    ops = [(0, 7, "insert", 1), (1, 7, "insert", 1), (2, None, "delete", 3), (3, None, "delete", 9), (8, 7, "insert", 5), (9, 7, "insert", 0), (10, None, "delete", 0), (11, 7, "insert", None)]
    with db.write(t) as w:
        found = w.guard_frame(t, spark.createDataFrame(ops, "id long, n long, _op string, _expected long"), "id")
    assert {x["id"]: (x["_result"], x["_had_old"]) for x in found.collect()} == {
        0: ("ok", True), 1: ("conflict", True), 2: ("ok", True), 3: ("conflict", True), 8: ("missing", False), 9: ("ok", False), 10: ("ok", False), 11: ("missing", False)}
    assert sorted((x["id"], x["n"], x["_revision"]) for x in db.read().frame(t).collect()) == [(0, 7, 5), (1, 0, 2), (3, 0, 4), (9, 7, 7)]
    with pytest.raises(errors.RevisionNotEqual), db.write(t) as w:
        w.compare_and_delete(t, 9, {"id": 1})
    with db.write(t) as w:
        assert w.compare_and_delete(t, 0, {"id": 1})[1]


def test_delete_all(spark, db):
    schema = T.StructType([T.StructField("id", T.LongType())])
    t = db.create_table(TableSpec("all", schema, ID))
    with db.write(t) as w:
        keep = w.changes(t)
        w.insert_frame(t, spark.range(100), "id")
    with db.write(t) as w:
        w.delete_all(t)
    r = db.read()
    assert r.num_objects(t) == 0 and r.revision(t) == 200
    assert [(x["id"], x["_revision"]) for x in r.graveyard(t).orderBy("id").collect()] == [(k, 101 + k) for k in range(100)]
    keep.close()


def test_watches(db, objects):
    with db.write(objects) as w:
        w.insert(objects, obj(42, ["a", "b"]))
        w.insert(objects, obj(71, ["ab"]))
    rows, watch = db.read().prefix_watch(objects, TAGS.query("ab"))
    assert ids(rows) == [71]
    with db.write(objects) as w:
        w.insert(objects, obj(12, ["bc"]))
    assert not watch.fired
    with db.write(objects) as w:
        *_, own = w.insert_watch(objects, obj(99, ["abcd"]))
    assert watch.fired and not own.fired
    with db.write(objects) as w:
        w.delete(objects, obj(99))
    assert own.fired


def test_watch_set():
    a, b, c = Watch(), Watch(), Watch()
    s = WatchSet(a, b, c)
    a.fire(), b.fire()
    assert s.wait(settle=0.01) == [a, b] and s.has(c) and not s.has_any(a, b)
    cancel = threading.Event()
    cancel.set()
    with pytest.raises(Cancelled):
        WatchSet().wait(cancel)
    c.fire()
    with pytest.raises(Cancelled) as e:
        s.wait(cancel, settle=5)
    assert e.value.closed == [c]


def test_initializers(db, objects):
    with db.write(objects) as w:
        one, two = w.register_initializer(objects, "one"), w.register_initializer(objects, "two")
        with pytest.raises(errors.TableError):
            w.register_initializer(objects, "one")
    done, watch = db.read().initialized_watch(objects)
    assert not done and db.read().pending_initializers(objects) == ["one", "two"]
    with db.write(objects) as w:
        one(w)
    assert not watch.fired
    with db.write(objects) as w:
        two(w)
        assert w.initialized(objects)
    assert watch.fired and db.read().initialized(objects)


def test_names_and_specs(db):
    for name in ("a", "abc123", "a1_bc", "a-b"):
        TableSpec(name, SCHEMA, ID)
    for name in ("", "123", "ABC", "a" * 50, "a^*%"):
        with pytest.raises(errors.InvalidName):
            TableSpec(name, SCHEMA, ID)
    with pytest.raises(errors.ReservedPrefix):
        TableSpec("t", SCHEMA, ID, (Index("__x", "key"),))
    with pytest.raises(errors.DuplicateIndex):
        TableSpec("t", SCHEMA, ID, (TAGS, TAGS))
    with pytest.raises(errors.PrimaryNotUnique):
        TableSpec("t", SCHEMA, TAGS)
    with pytest.raises(errors.TableError):
        TableSpec("t", SCHEMA, NET)
    with pytest.raises(errors.ReservedColumn):
        TableSpec("t", type(SCHEMA)([*SCHEMA.fields, type(SCHEMA.fields[0])("_op", SCHEMA.fields[0].dataType)]), ID)
    db.create_table(TableSpec("a", SCHEMA, ID))
    with pytest.raises(errors.DuplicateTable):
        db.create_table(TableSpec("a", SCHEMA, ID))


def test_lpm_ports(spark):
    rows = [(10, 0x1234, 16), (20, 0x1234, 16), (30, 0x1200, 8)]
    live = spark.createDataFrame(rows, "id long, port long, bits int").withColumn("_pk", keys.uint64.column(F.col("id"))).withColumn("_revision", F.col("id"))
    x = LPMIndex("port", "port", unique=False, kind="int", width=16, length="bits")
    assert ids(lpm.get(live, x, x.query(0x1234))) == [10]
    assert ids(lpm.list_(live, x, x.query(0x1234))) == [10, 20]
    assert ids(lpm.prefix(live, x, x.query(0x1234, 8))) == [30, 10, 20]
    assert ids(lpm.list_(live, x, x.query(0x1200, 4))) == [30]
    assert ids(lpm.list_(live, x, x.query(0xFF00, 8))) == []
    probes = spark.createDataFrame([(0x1234,), (0x12FF,), (0x0001,), (0x12FF,), (None,)], "p long")
    got = lpm.probe(probes, F.lpad(F.bin("p"), 16, "0"), lpm.entries(live.filter("id <> 20"), x), ["id"]).collect()
    assert sorted(((r["p"], r["match"] and r["match"]["id"]) for r in got), key=str) == sorted([(0x1234, 10), (0x12FF, 30), (0x12FF, 30), (0x0001, None), (None, None)], key=str)
    none = lpm.probe(probes, F.lpad(F.bin("p"), 16, "0"), lpm.entries(live.limit(0), x), ["id"]).collect()
    assert len(none) == 5 and all(r["match"] is None for r in none)


def test_encoders(spark):
    cases = [
        (keys.uint64, "bigint", [0, 1, 255, 2**62]),
        (keys.uint32, "bigint", [0, 2**32 - 1]),
        (keys.uint16, "int", [7, 65535]),
        (keys.int64, "bigint", [-1, 0, 5, -(2**63)]),
        (keys.int32, "int", [-1, 3]),
        (keys.int16, "int", [-2, 3]),
        (keys.boolean, "boolean", [True, False]),
        (keys.string, "string", ["", "é", "foo"]),
        (keys.ipv4, "string", ["1.2.3.4", "255.0.0.1"]),
        (keys.ipv4_prefix, "string", ["10.0.0.100/8", "1.2.3.4/32", "0.0.0.0/0"]),
        (keys.ip, "string", ["::1", "10.0.0.1"]),
    ]
    for enc, kind, values in cases:
        got = spark.createDataFrame([(v,) for v in values], f"v {kind}").select("v", enc.column(F.col("v")).alias("k")).collect()
        assert [(r.v, bytes(r.k)) for r in got] == [(v, enc.encode(v)) for v in values], enc.name
    assert keys.prefix_bytes("10.0.0.100/8") == keys.prefix_bytes("10.0.0.0/8")
    assert keys.successor(b"a\xff") == b"b" and keys.successor(b"\xff") is None
    assert keys.decode_lpm(keys.encode_lpm(b"\xff\xff", 12)) == (b"\xff\xf0", 12)


def test_pushdown(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("_pk", keys.uint64.column(F.col("o_orderkey"))).withColumn("_revision", F.lit(1))
    x = Index("id", "o_orderkey", keys.uint64, unique=True)
    plan = access.lower_bound(orders, x, x.query(1000))._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(o_orderkey,1000)" in plan


def test_limiter():
    from tidemark.operators.reconcile import Limiter

    x = Limiter(10.0, 5.0)
    assert [x.take(0.0, 3), x.take(0.0, 3), x.take(0.0, 3)] == [3, 2, 0]
    assert [x.take(0.25, 9), x.take(100.0, 9), x.take(50.0, 9)] == [2, 5, 0]
    x.back(1)
    assert x.take(100.0, 9) == 1 and 0 < x.wait() <= 0.1


def test_prefetch(spark):
    """Rows read at once are those read one by one, also after writes in the transaction."""
    db = Engine(spark)
    t = db.create_table(TableSpec("t", SCHEMA, ID))
    names = SCHEMA.fieldNames()
    rows = spark.createDataFrame([tuple(k if n == names[0] else None for n in names) for k in range(20)], SCHEMA)
    with db.write(t) as w:
        w.insert_frame(t, rows, order_by=names[0])
    with db.write(t) as w:
        keys_ = [t.spec.pk({**dict.fromkeys(names), names[0]: k}) for k in (3, 5, 99, 3)]
        alone = [w._old(t, w.versions["t"], k) for k in keys_]
        w.prefetch(t, keys_, at_once=2)
        assert [w._old(t, w.versions["t"], k) for k in keys_] == alone and alone[0][0][names[0]] == 3 and alone[2] is None
        w.delete(t, alone[0][0])
        assert w._old(t, w.versions["t"], keys_[0]) is None
